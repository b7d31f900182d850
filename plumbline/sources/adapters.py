"""Optional edges: PDF decoding and model calls.

Both take a callable and run it on the executors, so the library needs neither a
PDF decoder nor a network.  Write their results once and read them many times: a
repeated task would decode or call again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import sequence

DECODED = "doc_id string, table string, row string"
REPLIES = "doc_id string, page_number int, response string, error string, attempts int, elapsed double"


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of PDF files, listed and read by Spark."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")


def decode(files: DataFrame, decoder: Callable[[bytes], Iterator[tuple[str, str]]], pages: str = "all") -> DataFrame:
    """Rows (doc_id, table, row as JSON) of each file; ``decoder`` yields (table, row).

    ``pages`` names the pages wanted (1-3,7).  A file that can't be opened, needs a
    password or has no page gives one row of the table ``error`` and stops no other.
    """
    wanted = None if pages.strip().lower() in ("", "all") else pages

    def rows_of(content: bytes) -> list[tuple[str, str]]:
        found = list(decoder(content))
        numbers = [json.loads(row).get("page_number") for table, row in found if table == "sheets"]
        if not numbers:
            raise ValueError("the document has no pages")
        if wanted is None:
            return found
        keep = set(sequence.page_range(wanted, max(numbers)))
        return [(table, row) for table, row in found if json.loads(row).get("page_number") in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                try:
                    rows = [(r.path, *x) for x in rows_of(bytes(r.content))]
                except Exception as e:  # noqa: BLE001  any error of a decoder is an error row
                    rows = [(r.path, "error", json.dumps({"error": f"{type(e).__name__}: {e}"}))]
                yield pd.DataFrame(rows, columns=["doc_id", "table", "row"])

    return files.mapInPandas(run, DECODED)


def decoded_table(decoded: DataFrame, name: str, schema: str) -> DataFrame:
    """One table of what ``decode`` gave, typed; the file is its doc_id."""
    own = ", ".join(p.strip() for p in schema.split(", ") if not p.startswith("doc_id "))
    return decoded.where(F.col("table") == name).select("doc_id", F.from_json("row", own).alias("r")).select("doc_id", "r.*")


def classify(message: str) -> str:
    """The driver-side twin of ``text.error_class``."""
    low = message.lower()
    return next((name for name, parts in (("retryable", text.RETRYABLE), ("fatal", text.FATAL), ("no_schema", text.NO_SCHEMA)) if any(p in low for p in parts)), "other")


def call_models(prompts: DataFrame, client: Callable[[], Callable[[str], str]], check: Callable[[str], str | None], attempts: int = 3, parallel: int = 4, pause: float = 1.0) -> DataFrame:
    """Replies to prompts (doc_id, page_number, prompt); errors become rows, never failures.

    ``client`` makes one call function for each Python worker; ``check`` names what is
    wrong with a reply.  Transport errors are tried again unchanged, bad replies
    with a note on what was wrong, fatal errors not at all.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                began, error, reply, prompt, n = time.time(), None, None, r.prompt, 0
                for n in range(1, attempts + 1):
                    try:
                        reply = ask(prompt)
                    except Exception as e:  # noqa: BLE001  any error of a client is an error row
                        error, reply = str(e), None
                        if classify(error) == "fatal":
                            break
                        time.sleep(min(pause * 2 ** (n - 1), 30.0) if n < attempts else 0)
                        continue
                    error = check(reply)
                    if error is None:
                        break
                    prompt = f"{r.prompt}\n\nThe last reply could not be used: {error}"
                out.append((r.doc_id, r.page_number, reply if error is None else None, error, n, time.time() - began))
            yield pd.DataFrame(out, columns=["doc_id", "page_number", "response", "error", "attempts", "elapsed"])

    return prompts.repartition(parallel).mapInPandas(run, REPLIES)
