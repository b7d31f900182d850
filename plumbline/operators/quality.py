"""Detections against ground truth: multiset differences, reachable sums, and which layer is at fault."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import sequence

TOLERANCE, FINEST = 0.5, 1000


def _units(values: list[float]) -> int:
    """The least power of ten, up to ``FINEST``, that makes all values whole."""
    scale = 1
    while scale < FINEST and any(abs(v * scale - round(v * scale)) > 1e-6 for v in values):
        scale *= 10
    return scale


def shortest_subset(values: list[float], target: float) -> list[float] | None:
    """The shortest subset that sums to the target within half a unit; of equally short ones the nearest.

    Exact for any number of values: the least number of items of every sum up to the
    target, an item at a time, with a bit for each sum that an item made shorter.  Time
    and bits are values x target; values are whole thousandths, and positive.
    """
    if target < 0:
        return None
    scale = _units(values)
    items = [(round(v * scale), v) for v in values if 0 < v < target + TOLERANCE]
    top = min(int(np.ceil((target + TOLERANCE) * scale)) - 1, sum(v for v, _ in items))
    if top < 1:
        return None
    far = len(items) + 1
    least = np.full(top + 1, far, np.int32)
    least[0], made = 0, []
    for v, _ in items:
        better = least[: top + 1 - v] + 1 < least[v:] if v <= top else np.zeros(0, bool)
        made.append(np.packbits(better))
        if better.any():
            at = np.flatnonzero(better)
            least[at + v] = least[at] + 1  # read whole before it is written
    first = max(1, int(np.floor((target - TOLERANCE) * scale)) + 1)
    fits = np.arange(first, top + 1)
    fits = fits[least[fits] < far]
    if not len(fits):
        return None
    s = int(fits[np.lexsort((fits, np.abs(fits - target * scale), least[fits]))[0]])
    picked = []
    for (v, value), bits in zip(reversed(items), reversed(made)):
        if s >= v and bits[(s - v) >> 3] >> (7 - ((s - v) & 7)) & 1:
            picked.append(value)
            s -= v
    return picked[::-1]


def reachable(values: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """Sheets with the shortest subset of their values that gives the target, and the values it leaves out.

    Both are null where no subset does.  What is left out goes by number, not by value:
    of four equal values of which one is taken, three are left.
    """
    fields = {f.name: f.dataType.simpleString() for f in targets.schema.fields}
    lists = values.groupBy(*by).agg(F.sort_array(F.collect_list(F.col("value").cast("double"))).alias("values"))
    rows = targets.join(lists, by, "left").select(*by, F.col("target").cast("double"), "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            subsets, left = [], []
            for target, given in zip(batch.column(len(by)).to_pylist(), batch.column(len(by) + 1).to_pylist()):
                subset = None if target is None else shortest_subset(given or [], target)
                subsets.append(subset)
                left.append(None if subset is None else sorted((Counter(given) - Counter(subset)).elements()))
            own = [batch.column(i) for i in range(len(by))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(subsets, pa.list_(pa.float64())), pa.array(left, pa.list_(pa.float64()))], [*by, "subset", "left_out"])

    return rows.mapInArrow(run, ", ".join([*(f"{c} {fields[c]}" for c in by), "subset array<double>", "left_out array<double>"]))


def two_layers(lines: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Which layer makes a sheet's total wrong: the search for dimensions or their hierarchy.

    ``lines`` (value, parent) are found dimensions with the hierarchy's parent, ``totals``
    (total) the truth.  The search is complete if some found values sum to the truth; the
    hierarchy agrees if the values without a parent do, within one unit.  ``fault`` is null,
    ``search`` (a dimension is missing or wrong) or ``hierarchy`` (all are there, but the
    wrong ones count).  Sheets without lines or without a truth are in the result; without a
    truth nothing is at fault.
    """
    sums = lines.groupBy(*by).agg(F.count("value").alias("n"), F.sum("value").alias("sum_all"), F.sum(F.when(F.col("parent").isNull(), F.col("value"))).alias("counted"))
    rows = sums.join(totals.select(*by, F.col("total").cast("double").alias("total")), by, "full_outer")
    found = reachable(lines.where("value is not null").select(*by, "value"), totals.select(*by, F.col("total").alias("target")), by)
    zero = F.lit(0.0)
    rows = rows.join(found, by, "left").withColumn("difference", F.coalesce("counted", zero) - F.col("total"))
    search = F.col("subset").isNotNull() | (F.col("total") == 0)
    fault = F.when(F.col("total").isNull() | (F.abs("difference") < 1), F.lit(None).cast("string")).when(~search, "search").otherwise("hierarchy")
    return rows.select(*by, F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("sum_all", zero).alias("sum_all"), F.coalesce("counted", zero).alias("counted"), "total", "difference", "subset", "left_out", fault.alias("fault"))


def compare(found: DataFrame, truth: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Values beyond the truth (extra) and not found (missing), with their numbers."""
    a, b = (t.select(*by, F.col(value).cast("double").alias("value")) for t in (found, truth))
    return sequence.multiset_diff(a, b).groupBy(*by, "value", "side").agg(F.count(F.lit(1)).alias("n"))


def check_totals(values: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Sheets with the sum of their values, the stated total and whether they agree."""
    sums = values.groupBy(*by).agg(F.sum("value").alias("sum"), F.count("value").alias("n"))
    return sums.join(totals, by, "full_outer").withColumn("ok", F.coalesce(F.abs(F.col("sum") - F.col("total")) <= TOLERANCE, F.lit(False)))
