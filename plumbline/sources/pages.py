"""Drawings as a Spark data source: an input partition for each page, a schema for each table.

    pages.register(spark)
    spark.read.format("sheets").option("path", folder).option("table", "words").option("pages", "1-3").load()

Options: ``path`` (a document or a folder of them), ``table`` (sheets, paths, words,
spans or errors), ``pages`` (1-3,7), ``suffix`` of the documents in a folder,
``pages_in_partition`` (1), and ``decoder``, a name ``module:attribute`` of a decoder.
Filters on doc_id and page_number go into the reader where
``spark.sql.python.filterPushdown.enabled`` is set: pages that they exclude are neither
planned nor decoded.

A decoder is called with a document's path and gives an object with ``page_count`` and
``page(n)``, the rows of page n by table.  It raises ``PageError`` for documents that it
can't open.  Such documents, folders in the place of
documents, missing paths, empty documents and pages that a document lacks give no
rows but one of the table ``errors`` (doc_id, page_number, kind, error); the reading of
other documents goes on.
"""

from __future__ import annotations

import importlib
import json
import os
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.operators import sequence
from plumbline.sources import schemas

TABLES = {"sheets": schemas.SHEETS, "paths": schemas.PATHS, "words": schemas.WORDS, "spans": schemas.SPANS, "errors": "doc_id string, page_number int, kind string, error string"}


class PageError(ValueError):
    """A document or page that can't be read, with its kind: missing, folder, locked, empty, damaged or selection."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


class Document(Protocol):
    page_count: int

    def page(self, number: int) -> dict[str, list[dict[str, Any]]]: ...


class LineDrawing:
    """A document of JSON lines, one for each page: {"width_pt", "height_pt", "paths", "words", "spans"}.

    A line {"locked": true} makes the document locked.  Lines are read and parsed when
    their page is asked for, onward from the last one; a page's ``offset`` lets another
    reader ``resume`` there, so that no one reads the whole document for some of its pages.
    """

    def __init__(self, path: str):
        self.path, self.file, self.next, self.starts = path, open(path, "rb"), 1, None
        first = next((x for x in self.file if x.strip()), b"")
        if b'"locked"' in first and json.loads(first).get("locked"):
            raise PageError("locked", "the document needs a password")
        self.file.seek(0)

    def offset(self, number: int) -> int:
        """Where a page's line begins."""
        if self.starts is None:
            at, self.starts = 0, array("q")
            with open(self.path, "rb") as f:
                for x in f:
                    if x.strip():
                        self.starts.append(at)
                    at += len(x)
        return self.starts[number - 1] if number else 0

    @property
    def page_count(self) -> int:
        self.offset(0)
        return len(self.starts)

    def resume(self, number: int, offset: int) -> None:
        self.file.seek(offset)
        self.next = number

    def line(self, number: int) -> bytes:
        if number < self.next:
            self.resume(1, 0)
        for x in self.file:
            if x.strip():
                self.next += 1
                if self.next > number:
                    return x
        raise IndexError(f"no page {number}")

    def page(self, number: int) -> dict[str, list[dict[str, Any]]]:
        try:
            found = json.loads(self.line(number))
            return {"sheets": [{k: found[k] for k in ("width_pt", "height_pt")}], **{t: found.get(t, []) for t in ("paths", "words", "spans")}}
        except (ValueError, KeyError, AttributeError) as e:
            raise PageError("damaged", f"page {number}: {type(e).__name__}: {e}") from e


@dataclass
class Pages(InputPartition):
    """Pages of a document, or why there are none."""

    path: str
    doc_id: str
    numbers: Sequence[int] = ()
    offset: int | None = None
    kind: str | None = None
    error: str | None = None


def compact(numbers: list[int]) -> Sequence[int]:
    """Numbers one after the other as a range, others as they are."""
    whole = range(numbers[0], numbers[-1] + 1)
    return whole if list(whole) == numbers else tuple(numbers)


def named(name: str) -> Callable[[str], Document]:
    """What ``module:attribute`` names."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def documents(path: str, suffix: str) -> list[tuple[str, str]]:
    """(path, doc_id) of documents below a folder in order, or of the document itself."""
    if not os.path.isdir(path):
        return [(path, os.path.basename(path))]
    found = []
    for folder, folders, names in os.walk(path):
        for n in [*names, *folders]:
            if n.endswith(suffix) and not n.startswith((".", "_")):
                where = os.path.join(folder, n)
                found.append((where, os.path.relpath(where, path)))
    return sorted(found)


def opened(path: str, decoder: Callable[[str], Document], counted: bool = True) -> Document:
    """A document; whatever is wrong with it is a ``PageError``.  Pages known to be there need not be ``counted`` again."""
    if not os.path.exists(path):
        raise PageError("missing", f"no such file: {path}")
    if os.path.isdir(path):
        raise PageError("folder", f"a folder, not a document: {path}")
    try:
        document = decoder(path)
    except PageError:
        raise
    except Exception as e:  # noqa: BLE001  any error of a decoder means a document that can't be opened
        raise PageError("damaged", f"{type(e).__name__}: {e}") from e
    if counted and not document.page_count:
        raise PageError("empty", "the document has no pages")
    return document


#: Comparisons that the reader takes over, by the class of the pushed filter.
COMPARISONS: dict[type, Callable[[Any, Any], bool]] = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


#: Rows of small pages that make one batch.
ROWS = 4096


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.table, self.schema = options.get("table", "sheets"), schema
        self.path, self.spec, self.suffix = options["path"], options.get("pages", "all"), options.get("suffix", ".jsonl")
        self.each, self.decoder = int(options.get("pages_in_partition", "1")), options.get("decoder", f"{LineDrawing.__module__}:LineDrawing")
        self.pushed: list[tuple[str, type, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            if type(f) in COMPARISONS and column in ("doc_id", "page_number") and self.table != "errors":
                self.pushed.append((column, type(f), f.value))
            else:
                yield f

    def wants(self, column: str, value: Any) -> bool:
        return all(COMPARISONS[kind](value, wanted) for c, kind, wanted in self.pushed if c == column)

    def partitions(self) -> list[Pages]:
        decoder, found = named(self.decoder), []
        for path, doc in documents(self.path, self.suffix):
            if not self.wants("doc_id", doc):
                continue
            try:
                document = opened(path, decoder)
                count, offset = document.page_count, getattr(document, "offset", lambda n: None)
                try:
                    numbers = sequence.page_range(self.spec, count)
                except ValueError as e:
                    raise PageError("selection", str(e)) from e
                numbers = [n for n in numbers if self.wants("page_number", n)]
                found += [Pages(path, doc, compact(numbers[i : i + self.each]), offset(numbers[i])) for i in range(0, len(numbers), self.each)]
            except PageError as e:
                if self.table == "errors":
                    found.append(Pages(path, doc, kind=e.kind, error=str(e)))
        return found or [Pages("", "")]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        if partition.kind:
            yield batch([{"doc_id": partition.doc_id, "kind": partition.kind, "error": partition.error}])
        if not partition.numbers:
            return
        document = opened(partition.path, named(self.decoder), partition.offset is None)
        if partition.offset is not None:
            document.resume(partition.numbers[0], partition.offset)
        held: list[dict] = []
        for n in partition.numbers:
            own = {"doc_id": partition.doc_id, "page_number": n}
            try:
                rows = document.page(n)
                if self.table != "errors":
                    held += [{**r, **own} for r in rows.get(self.table, [])]
            except PageError as e:
                if self.table == "errors":
                    held.append({**own, "kind": e.kind, "error": str(e)})
            if len(held) >= ROWS:
                yield batch(held)
                held = []
        if held:
            yield batch(held)


class PageSource(DataSource):
    """The format ``sheets``."""

    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> str:
        table = self.options.get("table", "sheets")
        if table not in TABLES:
            raise ValueError(f"no such table: {table}; there are {', '.join(TABLES)}")
        return TABLES[table]

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Make the format ``sheets`` known, and let filters reach its reader."""
    spark.dataSource.register(PageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
