"""Table functions for SQL, registered by one call.

    tables.register(spark)
    SELECT * FROM walk_reply(TABLE(SELECT doc_id, page_number, response FROM replies))
    SELECT * FROM cluster_lines(TABLE(words) PARTITION BY (doc_id, page_number) ORDER BY (y0, x0, x1, word), 3.0)
    SELECT * FROM group_spans(TABLE(spans) PARTITION BY (doc_id, page_number) ORDER BY (y0, x0))
    SELECT * FROM attach(TABLE(items) PARTITION BY (doc_id, page_number) ORDER BY (n, kind))

They take rows by their names and give what ``annotate.walk``, ``sequence.cluster_lines``,
``sequence.group_spans`` and ``drawing.attach`` do.  Sheets are the partitions of the
table arguments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from plumbline.operators import annotate, drawing, sequence

KEY = "doc_id string, page_number int"


class WalkReply:
    """Numbers and boxes of replies (response), a batch at a time: no state, so no partition is needed."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        at, columns = annotate.walked(batch.column("response"))
        own = [batch.column("doc_id").take(at), batch.column("page_number").cast(pa.int32()).take(at)]
        yield pa.Table.from_arrays([*own, *columns], names=["doc_id", "page_number", *(f.name for f in annotate.WALKED_ARROW)])


class _Sheet:
    """Keeps a partition's rows, in the order that SQL gives them, until its end."""

    make: Callable[[list], list[tuple]]

    def __init__(self) -> None:
        self.held: list[Row] = []

    def eval(self, row: Row) -> None:
        self.held.append(row)

    def terminate(self) -> Iterator[tuple]:
        if self.held:
            key = (self.held[0]["doc_id"], self.held[0]["page_number"])
            for found in self.made():
                yield (*key, *found)

    def made(self) -> list[tuple]:
        return type(self).make(self.held)


class ClusterLines(_Sheet):
    """Words as lines within a tolerance."""

    tolerance = 0.0

    def eval(self, row: Row, tolerance: float) -> None:
        self.tolerance = float(tolerance)
        self.held.append(row)

    def made(self) -> list[tuple]:
        return sequence.lines_of(self.held, self.tolerance)


class GroupSpans(_Sheet):
    """Spans that nearly touch on one line, joined."""

    make = staticmethod(sequence.joined_spans)


class Attach(_Sheet):
    """Numbers dealt to leaders and spans."""

    make = staticmethod(drawing.dealt_numbers)


FUNCTIONS = {
    "walk_reply": (WalkReply, f"{KEY}, {annotate.WALKED}"),
    "cluster_lines": (ClusterLines, f"{KEY}, {sequence.LINES}"),
    "group_spans": (GroupSpans, f"{KEY}, {sequence.JOINED}"),
    "attach": (Attach, f"{KEY}, {drawing.PAIRS}"),
}


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    for name, (cls, schema) in FUNCTIONS.items():
        made = arrow_udtf(cls, returnType=schema) if cls is WalkReply else udtf(cls, returnType=schema, useArrow=True)
        spark.udtf.register(name, made)
