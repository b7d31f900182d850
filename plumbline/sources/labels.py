"""Ground-truth label files: one value, a sum or a total on each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOTAL = "^(?:\\S+\\s+)*-\\s*(\\d+)\\s*$"


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(values, totals, errors) of lines (page_number, pos, line).

    A line is a value, values joined by +, or words and a dash before the total;
    blank lines mean nothing, any other line is an error.
    """
    line = F.trim(F.col("line"))
    rows = lines.withColumn("line", line).where("line <> ''")
    total = F.regexp_extract("line", TOTAL, 1)
    is_total, is_sum = total != "", F.col("line").rlike("^\\d+(?:\\+\\d+)*$")
    values = rows.where(is_sum & ~is_total).select("page_number", "pos", F.posexplode(F.split("line", "\\+")).alias("part", "v"))
    values = values.select("page_number", "pos", "part", F.col("v").cast("long").alias("value"))
    totals = rows.where(is_total).groupBy("page_number").agg(F.max_by(total.cast("long"), "pos").alias("total"))
    return values, totals, rows.where(~is_sum & ~is_total).select("page_number", "pos", "line")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files named ``..._NN.txt`` as (page_number, pos, line)."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    page = F.regexp_extract("file", "_(\\d+)\\.txt$", 1).cast("int")
    return files.select(page.alias("page_number"), F.posexplode(F.split("value", "\\r?\\n")).alias("pos", "line"))
