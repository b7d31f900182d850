"""Replies and marks of a sheet that arrive apart, joined by keyed state.

A stream of events (sheet, at, kind, ...) has marks (mark_id, value, ord, and ``of``, how
many the sheet has) and replies (response, error), in any order and maybe repeated.  A
sheet is complete when it has its reply and all its marks: it leaves as one row, and its
state shrinks to a flag that later repeats are recognised by.  A timer ``wait`` after the
sheet's first event drops what is left; a sheet that was not complete leaves then as it
is, marked so.  State is bounded by the sheets of that time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import DataType, DoubleType, LongType, StringType, StructField, StructType

from plumbline.operators import selection

EVENTS = "doc_id string, page_number int, at timestamp, kind string, mark_id string, value double, ord bigint, of bigint, response string, error string"
SHEETS = "doc_id string, page_number int, response string, error string, marks array<struct<mark_id:string,value:double,ord:bigint>>, complete boolean"
BY = ["doc_id", "page_number"]
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _fields(**kinds: DataType) -> StructType:
    """A schema without a session, as state has no other."""
    return StructType([StructField(k, t) for k, t in kinds.items()])


class SheetState(StatefulProcessor):
    """One sheet: its reply, its marks by id, how many there are, and whether it has left."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reply = handle.getValueState("reply", _fields(response=StringType(), error=StringType()))
        self.marks = handle.getMapState("marks", _fields(mark_id=StringType()), _fields(value=DoubleType(), ord=LongType()))
        self.size = handle.getValueState("size", _fields(n=LongType(), had=LongType()))
        self.left = handle.getValueState("left", _fields(n=LongType()))

    def _row(self, key: tuple, complete: bool) -> Row:
        marks = [(k[0], v[0], v[1]) for k, v in self.marks.iterator()]
        response, error = self.reply.get() if self.reply.exists() else (None, None)
        return Row(doc_id=key[0], page_number=key[1], response=response, error=error, marks=sorted(marks, key=lambda m: (m[2], m[0])), complete=complete)

    def _drop(self) -> None:
        self.reply.clear()
        self.marks.clear()
        self.size.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.left.exists():
            return
        first, of, had = None, None, 0
        if self.size.exists():
            of, had = self.size.get()
        for r in rows:
            at = int(r.at.timestamp() * 1000)
            first = at if first is None else min(first, at)
            if r.kind == "reply":
                self.reply.update((r.response, r.error))
            elif r.kind == "mark":
                if r.mark_id is not None and not self.marks.containsKey((r.mark_id,)):
                    self.marks.updateValue((r.mark_id,), (r.value, r.ord))
                    had += 1
                of = of if r.of is None else r.of
        if first is not None and not list(self.handle.listTimers()):
            self.handle.registerTimer(first + self.wait)
        self.size.update((of, had))
        if self.reply.exists() and of is not None and had >= of:
            yield self._row(key, True)
            self._drop()
            self.left.update((1,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.left.exists():
            yield self._row(key, False)
        self._drop()
        self.left.clear()

    def close(self) -> None:
        pass


def whole_sheets(events: DataFrame, wait: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A row for each sheet once it is complete, or when its time is over (``SHEETS``)."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    ms = spark.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {wait})").first()[0]
    timed = events.withWatermark("at", late)
    return timed.groupBy(*BY).transformWithState(SheetState(ms), StructType.fromDDL(SHEETS), "append", "eventTime")


def report(sheets: DataFrame) -> DataFrame:
    """Report rows of ``whole_sheets``; marks come from the rows themselves."""
    replies = sheets.select(*BY, "error", F.try_parse_json("response").alias("response"))
    marks = sheets.select(*BY, F.explode("marks").alias("m")).select(*BY, "m.mark_id", "m.value", F.col("m.ord").cast("int").alias("ord"))
    return selection.report(replies, marks, BY).join(sheets.select(*BY, "complete"), BY)


def report_each(events: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, wait: str = "1 hour", late: str = "10 minutes") -> StreamingQuery:
    """Report rows of each micro-batch's whole sheets; ``write`` gets them with the batch number, which makes it repeatable."""
    made = whole_sheets(events, wait, late)

    def batch(df: DataFrame, number: int) -> None:
        kept = df.persist()  # the state's rows are read three times
        write(report(kept), number)
        kept.unpersist()

    return made.writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).foreachBatch(batch).start()
