"""Arriving replies as a stream: the batch report on every micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators import selection
from plumbline.sources import schemas


def replies(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines files of replies as they arrive."""
    return spark.readStream.schema(schemas.RESPONSES).json(path)


def report_each(stream: DataFrame, marks: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Report rows of each micro-batch; ``write`` gets them with the batch number, which makes it repeatable."""
    by = ["doc_id", "page_number"]

    def batch(df: DataFrame, number: int) -> None:
        write(selection.report(df.withColumn("response", F.try_parse_json("response")), marks, by), number)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def totals(stream: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Calls, failures and seconds of each window of time; needs a timestamp ``at``."""
    timed = stream.withWatermark("at", late)
    return timed.groupBy(F.window("at", window)).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.sum("elapsed").alias("elapsed"))
