"""Joins by place: bands, containment, nearest, intervals, arrowheads.

Every join has the sheet as its equality key (a shuffle or merge join, never a
cross join); the geometry is the residual condition.  A sheet holds tens to
hundreds of primitives, so the residual's pairs stay small whatever the number of
sheets.  ``grid_join`` adds cells to the key for inputs with crowded sheets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as G

BOX = ("x0", "y0", "x1", "y1")


def aside(df: DataFrame) -> DataFrame:
    """All columns with the prefix ``r_``: the right side of a join by place."""
    return df.select(*[F.col(c).alias(f"r_{c}") for c in df.columns])


def right(columns: tuple[str, ...] | list[str] = BOX) -> list[Column]:
    return [F.col(f"r_{c}") for c in columns]


def left(columns: tuple[str, ...] | list[str] = BOX) -> list[Column]:
    return [F.col(c) for c in columns]


def _on(by: list[str], residual: Column) -> Column:
    for c in by:
        residual = residual & (F.col(c) == F.col(f"r_{c}"))
    return residual


def band_semi_join(boxes: DataFrame, others: DataFrame, by: list[str], slack: float = 1.0, anti: bool = False) -> DataFrame:
    """Boxes (rounded to tenths) with another one within the slack on each side."""
    near = F.lit(True)
    for c in BOX:
        near = near & (F.abs(F.bround(F.col(c), 1) - F.col(f"r_{c}")) <= slack)
    return boxes.join(aside(others), _on(by, near), "left_anti" if anti else "left_semi")


def contained_anti_join(boxes: DataFrame, frames: DataFrame, by: list[str], overshoot: Column, margin: Column) -> DataFrame:
    """Boxes that no frame is drawn around."""
    return boxes.join(aside(frames), _on(by, G.wraps(right(), left(), overshoot, margin)), "left_anti")


def holds(frame: list[Column], box: list[Column]) -> Column:
    """The box lies in the frame."""
    return (box[0] >= frame[0]) & (box[1] >= frame[1]) & (box[2] <= frame[2]) & (box[3] <= frame[3])


def first_containing(boxes: DataFrame, frames: DataFrame, by: list[str], box_id: str, frame_id: str, grow: float = 1.0) -> DataFrame:
    """Each box with the first frame, grown a little, that holds it; null if none."""
    pairs = boxes.join(aside(frames), _on(by, holds(G.grow(right(), grow), left())))
    found = pairs.groupBy(*by, box_id).agg(F.min(f"r_{frame_id}").alias(frame_id))
    return boxes.join(found, [*by, box_id], "left")


def points_in_boxes(points: DataFrame, boxes: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of a point (px, py) and a half-open box that holds it."""
    px, py, (x0, y0, x1, y1) = F.col("px"), F.col("py"), right()
    pairs = points.join(aside(boxes), _on(by, (px >= x0) & (px < x1) & (py >= y0) & (py < y1)))
    return _merged(pairs, points, boxes)


def _merged(pairs: DataFrame, a: DataFrame, b: DataFrame, *more: Column) -> DataFrame:
    """The left columns, and the right ones that have other names."""
    return pairs.select(*a.columns, *[F.col(f"r_{c}").alias(c) for c in b.columns if c not in a.columns], *more)


def grid_join(points: DataFrame, boxes: DataFrame, by: list[str], cell: float) -> DataFrame:
    """``points_in_boxes`` with grid cells in the key: each box is dealt to the cells it touches.

    Every point has one cell, so no pair comes twice; for sheets with very many items.
    """
    dealt = boxes.withColumn("__cx", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell)))).withColumn(
        "__cy", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell)))
    )
    placed = points.withColumn("__cx", F.floor(F.col("px") / cell)).withColumn("__cy", F.floor(F.col("py") / cell))
    return points_in_boxes(placed, dealt, [*by, "__cx", "__cy"]).drop("__cx", "__cy")


def tips_at_ends(segments: DataFrame, tips: DataFrame, by: list[str], segment_id: str, gap: Column) -> DataFrame:
    """Segments with what arrow tips (x, y) do at their ends.

    ``at_a`` and ``at_b``: a tip touches that end; ``only_a`` and ``only_b``: a tip
    touches that end and not the other one.
    """
    held = tips.groupBy(*by).agg(F.collect_list(F.struct("x", "y")).alias("__tips"))
    return touched(segments.join(held, by, "left"), "__tips", gap)


def touched(segments: DataFrame, tips: str, gap: Column) -> DataFrame:
    """``tips_at_ends`` of segments that have the tips of their sheet as a list; the list is dropped."""
    columns = [c for c in segments.columns if c != tips]
    touches = lambda t, end: F.hypot(t.x - F.col(f"{end}x"), t.y - F.col(f"{end}y")) <= gap
    near = F.transform(tips, lambda t: F.struct(touches(t, "a").alias("a"), touches(t, "b").alias("b")))
    does = {"at_a": lambda t: t.a, "at_b": lambda t: t.b, "only_a": lambda t: t.a & ~t.b, "only_b": lambda t: t.b & ~t.a}
    ended = segments.select(*columns, F.filter(near, lambda t: t.a | t.b).alias(tips))
    return ended.select(*columns, *[F.coalesce(F.exists(tips, f), F.lit(False)).alias(c) for c, f in does.items()])


def nearest(items: DataFrame, others: DataFrame, by: list[str], item_id: str, distance: Column, most: float, order: str) -> DataFrame:
    """The nearest other row of each item within a distance; ties go by the other's ``order``.

    ``distance`` is an expression over the item's columns and, with the prefix
    ``r_``, the other's.
    """
    pairs = items.join(aside(others), _on(by, distance <= most), "left").withColumn("distance", distance)
    first = Window.partitionBy(*by, item_id).orderBy(F.col("distance").asc_nulls_last(), f"r_{order}")
    kept = pairs.withColumn("__r", F.row_number().over(first)).where("__r = 1")
    return _merged(kept, items, others, F.col("distance"))


def spans_over(big: dict[str, Column], small: dict[str, Column]) -> Column:
    """A small segment runs beside a big one, parallel and within its ends.

    Arguments hold ax, ay, bx, by and length_pt.
    """
    length = F.hypot(big["bx"] - big["ax"], big["by"] - big["ay"])
    ux, uy = F.try_divide(big["bx"] - big["ax"], length), F.try_divide(big["by"] - big["ay"], length)
    along, off = [], []
    for x, y in (("ax", "ay"), ("bx", "by")):
        dx, dy = small[x] - big["ax"], small[y] - big["ay"]
        along.append(dx * ux + dy * uy)
        off.append(dy * ux - dx * uy)
    parallel = F.abs(off[0] - off[1]) <= 0.8
    beside = F.abs((off[0] + off[1]) / 2) >= 0.5
    within = (F.least(*along) >= -1.0) & (F.greatest(*along) <= length + 1.0)
    return (length >= 1e-6) & (small["length_pt"] <= length) & parallel & beside & within


def hierarchy(lines: DataFrame, by: list[str], line_id: str = "idx") -> DataFrame:
    """Lines with ``children`` (ids under an overall dimension) and ``parent``.

    An overall dimension has two or more lines under it; of several overalls the
    one with the largest id is the parent.
    """
    ends = ["ax", "ay", "bx", "by", "length_pt"]
    big = lines.select(*by, F.col(line_id).alias("big"), *[F.col(c).alias(f"b_{c}") for c in ends])
    small = lines.select(*by, F.col(line_id).alias("small"), *[F.col(c).alias(f"s_{c}") for c in ends])
    over = spans_over({c: F.col(f"b_{c}") for c in ends}, {c: F.col(f"s_{c}") for c in ends})
    pairs = big.join(small, by).where((F.col("big") != F.col("small")) & over).select(*by, "big", "small")
    kids = pairs.groupBy(*by, "big").agg(F.sort_array(F.collect_list("small")).alias("children")).where(F.size("children") >= 2)
    parents = kids.select(*by, "big", F.explode("children").alias("small")).groupBy(*by, "small").agg(F.max("big").alias("parent"))
    out = lines.join(kids.withColumnRenamed("big", line_id), [*by, line_id], "left").join(parents.withColumnRenamed("small", line_id), [*by, line_id], "left")
    return out.withColumn("children", F.coalesce("children", F.array().cast(kids.schema["children"].dataType)))


def chain_total(lines: DataFrame, by: list[str], value: str = "value", line_id: str = "idx") -> DataFrame:
    """Sums of a sheet's dimensions: all, without children, and a check of each overall's arithmetic.

    ``lines`` comes from ``hierarchy``.  ``overalls`` lists (id, value, children_sum,
    arithmetic_ok) with a tolerance of one unit.
    """
    listed = lines.select(*by, line_id, F.explode("children").alias("__kid"))
    values = lines.select(*by, F.col(line_id).alias("__kid"), F.col(value).alias("__v"))
    sums = listed.join(values, [*by, "__kid"]).groupBy(*by, line_id).agg(F.sum("__v").alias("children_sum"))
    checked = lines.join(sums, [*by, line_id]).select(*by, F.struct(line_id, F.col(value).alias("value"), "children_sum", (F.abs(F.col(value) - F.col("children_sum")) < 1.0).alias("arithmetic_ok")).alias("o"))
    overalls = checked.groupBy(*by).agg(F.sort_array(F.collect_list("o")).alias("overalls"))
    totals = lines.groupBy(*by).agg(F.sum(value).alias("sum_all"), F.sum(F.when(F.col("parent").isNull(), F.col(value))).alias("sum_without_duplicates"), F.count(line_id).alias("lines"), F.max("length_pt").alias("longest_pt"))
    return totals.join(overalls, by, "left")


def rect_hits_segment(rect: list[Column], ax: Column, ay: Column, bx: Column, by: Column, step: float = 2.0) -> Column:
    """A segment, sampled about every ``step`` points of its L1 length, enters a half-open rectangle."""
    n = F.greatest(F.floor((F.abs(bx - ax) + F.abs(by - ay)) / step).cast("int"), F.lit(1))
    return F.exists(
        F.sequence(F.lit(0), n),
        lambda i: ((ax + (bx - ax) * (i / n)) >= rect[0]) & ((ax + (bx - ax) * (i / n)) < rect[2]) & ((ay + (by - ay) * (i / n)) >= rect[1]) & ((ay + (by - ay) * (i / n)) < rect[3]),
    )
