"""Places in one order of a whole table, over many partitions."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import sequence


@pytest.mark.parametrize(("rows", "partitions", "adaptive"), [(500_000, 8, True), (500_000, 8, False), (200_000, 40, True), (200_000, 40, False), (7, 200, True)])
def test_places(spark, rows, partitions, adaptive):
    """Every row once, each place once, and places equal ranks; with keys that a third of the rows share."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.enabled", str(adaptive).lower())
    try:
        df = spark.range(rows, numPartitions=7).withColumn("key", F.when(F.col("id") % 3 == 0, 5).otherwise(F.pmod(F.xxhash64("id"), F.lit(rows * 2)))).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
        got = sequence.placed(df, [F.col("key")]).select("id", "key", "pos").toPandas()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(got) == rows and got.id.is_unique
    assert sorted(got.pos) == list(range(rows))
    assert got.sort_values("pos").key.is_monotonic_increasing


def test_places_agree_and_mixed_orders(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, rng.randint(0, 9)]), rng.choice("abc")) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a int, b string")
    one, two = (sorted((r.pos, r.a, r.b) for r in sequence.placed(df.repartition(n), [F.col("a").isNull(), -F.col("a"), F.col("b")]).collect()) for n in (2, 9))
    assert one == two == [(i, *r) for i, r in enumerate(sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1])))]


def test_no_rows(spark):
    assert sequence.placed(spark.range(0), [F.col("id")]).count() == 0


def test_set_diff_groups_once(spark):
    """Repeated rows of either side and nulls; one table of the rows of a task, not three."""
    a = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, None), (3, 1.0)], "s long, v double")
    b = spark.createDataFrame([(1, 2.0), (2, None), (2, None), (4, 1.0), (4, 1.0)], "s long, v double")
    found = sequence.set_diff(a, b)
    assert sorted((r.s, r.side) for r in found.collect()) == [(1, "both"), (2, "both"), (3, "extra"), (4, "missing")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
