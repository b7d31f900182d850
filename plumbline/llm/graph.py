"""Connected components by alternating large and small stars, joins with hot keys, and saved tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.saved import remove, shared_dir, tables_of, write

__all__ = ["Scratch", "attach", "components", "remove", "running", "shared_dir", "sift", "tables_of", "write"]

#: A key with more than one in ``HEAVY`` of all rows is hot, if it has more than ``MANY``; there are fewer than ``HEAVY`` such keys.
HEAVY, MANY = 1000, 500
#: Bits of a filter for each key, and at most in all: a filter of the most is a million rows of 16 bytes.
BITS, MOST_BITS = 16, 1 << 26


class Scratch:
    """Tables of one job in the shared folder, which cut its lineage."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def save(self, df: DataFrame) -> DataFrame:
        out, path = write(df)
        self.paths.append(path)
        return out

    def clear(self, since: int = 0) -> None:
        """Remove the tables saved from number ``since`` on, but the last one."""
        gone, self.paths[since:] = self.paths[since:-1], self.paths[-1:]
        for path in gone:
            remove(self.spark, path)

    def only(self, *kept: DataFrame) -> None:
        """Remove the saved tables that none of these reads."""
        names = {p.rsplit("/", 1)[-1] for df in kept for p in tables_of(df)}
        gone = [p for p in self.paths if p.rsplit("/", 1)[-1] not in names]
        self.paths = [p for p in self.paths if p not in gone]
        for path in gone:
            remove(self.spark, path)


def attach(rows: DataFrame, facts: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of rows with facts, which hold each key once and its number of rows (``size``).

    There are fewer than ``HEAVY`` hot keys, so their facts are broadcast and their rows
    stay where they are; only the other rows are shuffled.
    """
    total, most = facts.agg(F.sum(size), F.max(size)).first()
    least = max((total or 0) // HEAVY, MANY)
    if (most or 0) <= least:
        return rows.join(facts, key)
    hot = F.broadcast(rows.sparkSession.createDataFrame(facts.where(F.col(size) > least).collect(), facts.schema))
    cool = rows.join(hot.select(key), key, "left_anti").join(facts.where(F.col(size) <= least), key)
    return rows.join(hot, key).unionByName(cool)


def sift(rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """The rows that may have one of the keys, where they are: no key's row is missed, some others stay.

    A bit for each hash of a key, in words of 64; the words are broadcast, ``MOST_BITS``
    in all whatever the number of keys.  A join with the keys follows, and what it
    shuffles is mostly theirs.
    """
    bits = 1 << max(10, min(MOST_BITS, BITS * keys.count()).bit_length() - 1)
    bit = F.pmod(F.xxhash64(*by), F.lit(bits))
    word, mask = F.shiftright(bit, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
    words = keys.select(word.alias("__word"), mask.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    met = rows.withColumn("__word", word).join(F.broadcast(words), "__word")
    return met.where(F.col("__bits").bitwiseAND(mask) != 0).drop("__word", "__bits")


def running(df: DataFrame, by: str, order: list[str], value: str, scratch: Scratch) -> DataFrame:
    """df with ``start``: the sum of ``value`` over the rows before it in its ``by``, in this order.

    From one range sort that is saved: what passes between its partitions is a row for
    each of them and each ``by``, so a ``by`` of any size is spread.  Rows that are
    equal in the order get their places in any order.
    """
    cut = scratch.save(df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("__p", F.spark_partition_id()))
    before = Window.partitionBy(by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    skip = cut.groupBy(by, "__p").agg(F.sum(value).alias("__n")).select(by, "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    inside = Window.partitionBy(by, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("__r", F.sum(value).over(inside)).join(skip, [by, "__p"]).withColumn("start", F.col("__s") + F.col("__r") - F.col(value)).drop("__p", "__s", "__r")


def components(edges: DataFrame, scratch: Scratch, most: int = 40) -> DataFrame:
    """(node, root) for each node of an edge list (a, b); root is the least node.

    Minima are aggregated before they are shuffled and reach the edges of hubs by
    ``attach``, so no task gets a hub.  Every round ends in a saved table, and the
    tables of the round before are removed.
    """
    since = len(scratch.paths)
    e, before = scratch.save(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct()), None
    for _ in range(most):
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("b").alias("size"))
        large = attach(both, least, "a", "size").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.save(large)
        small = large.groupBy("a").agg(F.min("b").alias("m"), F.count("b").alias("size"))
        linked = attach(large, small, "a", "size")
        e = scratch.save(linked.select("a", F.col("m").alias("b")).unionAll(linked.where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))).distinct())
        scratch.clear(since)
        now = e.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            # A settled edge list is stars: each node but the roots stands once as a.
            found = scratch.save(e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
            scratch.clear(since)
            return found
        before = now
    raise RuntimeError("components did not settle")
