"""Queries that draw small sheets from the order lines and apply the drawing operators to them.

An order is a sheet, its lines in a full order (k) are its paths, labels, spans or
elements.  Coordinates are products of small columns, so both engines compute equal
doubles.  These sheets exercise the operators; they are no drawings of anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geometry, layout, num, text
from plumbline.operators import cost, drawing, polygons, redaction, sequence, spatial, textmap
from plumbline.plans.bridge import NUMBERED, ORDER
from plumbline.plans.registry import query
from plumbline.session import table

SHEET = drawing.SHEET
X, Y = "l_discount * 1000", "CAST(k * 20 AS DOUBLE)"
M = f"m AS ({NUMBERED})"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with sheet, k, x and y."""
    rows = sequence.numbered(table(spark, sf_dir, "lineitem"), ["l_orderkey"], list(map(F.col, ORDER)), "k").withColumn("k", F.col("k").cast("long"))
    return rows.select("*", F.lit("d").alias("doc_id"), F.col("l_orderkey").alias("page_number"), (F.col("l_discount") * 1000).alias("x"), (F.col("k") * 20).cast("double").alias("y"))


def _limits(rows: DataFrame, scale: Column | None = None) -> DataFrame:
    return rows.select(*SHEET).distinct().select(*SHEET, *drawing.scaled_limits(F.lit(1.0) if scale is None else scale, drawing.Limits()))


_ITEM = "array<struct<kind:string,x0:double,y0:double,x1:double,y1:double>>"


def _paths(rows: DataFrame) -> DataFrame:
    """A path for each line: N a stroke, R a rectangle and a stroke, A a curve."""
    x, y, w = F.col("x"), F.col("y"), F.col("l_quantity")
    item = lambda kind, dx, dy: F.struct(F.lit(kind).alias("kind"), x.alias("x0"), y.alias("y0"), (x + dx).alias("x1"), (y + dy).alias("y1"))
    items = F.when(F.col("l_returnflag") == "N", F.array(item("l", w, F.lit(0.0)))).when(F.col("l_returnflag") == "R", F.array(item("re", w, F.lit(5.0)), item("l", w, F.lit(5.0)))).otherwise(F.array(item("c", w, w)))
    fill = F.when(F.col("l_linestatus") == "F", F.array(F.lit(0.0))).otherwise(F.array().cast("array<double>"))
    return rows.select(*SHEET, F.col("k").alias("path_id"), fill.alias("fill"), F.when(F.col("l_partkey") % 5 > 0, F.col("l_tax")).alias("stroke_width"), items.cast(_ITEM).alias("items"))


@query(f"""
WITH {M}, r AS (SELECT l_orderkey AS page_number, k AS path_id, l_linestatus = 'F' AS filled, CASE WHEN l_partkey % 5 > 0 THEN l_tax ELSE 0.0 END AS stroke_width, l_returnflag AS f, {X} AS x, {Y} AS y, {X} + l_quantity AS x2, {Y} + 5 AS y2 FROM m)
SELECT page_number, path_id, 0 AS ord, filled, stroke_width, x AS ax, y AS ay, x2 AS bx, y + 0.0 AS by FROM r WHERE f = 'N'
UNION ALL SELECT page_number, path_id, 0, filled, stroke_width, x, y, x2, y FROM r WHERE f = 'R' UNION ALL SELECT page_number, path_id, 1, filled, stroke_width, x2, y, x2, y2 FROM r WHERE f = 'R'
UNION ALL SELECT page_number, path_id, 2, filled, stroke_width, x2, y2, x, y2 FROM r WHERE f = 'R' UNION ALL SELECT page_number, path_id, 3, filled, stroke_width, x, y2, x, y FROM r WHERE f = 'R'
UNION ALL SELECT page_number, path_id, 4, filled, stroke_width, x, y, x2, y2 FROM r WHERE f = 'R'
""")
def path_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawing.strokes(_paths(_rows(spark, sf_dir))).select("page_number", "path_id", "ord", "filled", "stroke_width", "ax", "ay", "bx", "by")


@query(f"""
WITH {M}, r AS (SELECT l_orderkey AS page_number, count(*) FILTER (l_returnflag <> 'A') AS paths, min({X}) FILTER (l_returnflag <> 'A') AS x0, min({Y}) FILTER (l_returnflag <> 'A') AS y0, max({X} + l_quantity) FILTER (l_returnflag <> 'A') AS x1,
  max(CASE l_returnflag WHEN 'R' THEN {Y} + 5 ELSE {Y} END) FILTER (l_returnflag <> 'A') AS y1 FROM m GROUP BY 1)
SELECT page_number, x0, y0, x1, y1 FROM r WHERE paths > 0
""")
def stroke_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons.bounds(drawing.strokes(_paths(_rows(spark, sf_dir))), ["page_number"])


def _shapes(rows: DataFrame) -> DataFrame:
    """Strokes of a triangle (N), a square (R) or an open chain (A) for each line."""
    x, y, q = F.col("x"), F.col("y"), F.col("l_quantity")
    p = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    zero = F.lit(0.0)
    corners = F.when(F.col("l_returnflag") == "N", F.array(p(zero, zero), p(q, F.lit(1.0)), p(F.lit(1.0), F.lit(3.0)), p(zero, zero))).when(
        F.col("l_returnflag") == "R", F.array(p(zero, zero), p(q, zero), p(q, q), p(zero, q), p(zero, zero))).otherwise(F.array(p(zero, zero), p(q, zero), p(q, F.lit(2.0)), p(q + 1, F.lit(2.0))))
    sides = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.element_at("c", i).alias("a"), F.element_at("c", i + 1).alias("b")))
    cut = rows.withColumn("c", corners).select(*SHEET, F.col("k").alias("path_id"), F.posexplode(sides).alias("ord", "s"))
    return cut.select(*SHEET, "path_id", "ord", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


@query(f"""
WITH {M}, t AS (SELECT l_orderkey AS page_number, k AS path_id, {X} AS x, {Y} AS y, l_quantity AS q FROM m WHERE l_returnflag = 'N' AND abs(l_quantity * 3 - 1) / 2 <= 30),
c AS (SELECT page_number, path_id, x AS px, y AS py, sqrt(q * q + 1) + sqrt(10) AS d FROM t UNION ALL SELECT page_number, path_id, x + q, y + 1, sqrt(q * q + 1) + sqrt((q - 1) * (q - 1) + 4) FROM t
      UNION ALL SELECT page_number, path_id, x + 1, y + 3, sqrt(10) + sqrt((q - 1) * (q - 1) + 4) FROM t)
SELECT page_number, path_id, px AS x, py AS y FROM (SELECT *, row_number() OVER (PARTITION BY page_number, path_id ORDER BY round(d, 9) DESC, px, py) AS r FROM c) WHERE r = 1
""")
def triangle_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tips of filled triangles; a quantity of 1 or 3 makes no tie of distances."""
    return polygons.triangle_tips(_shapes(_rows(spark, sf_dir)).withColumn("arrow_max_area", F.lit(30.0)), SHEET).select("page_number", "path_id", "x", "y")


@query(f"WITH {M} SELECT l_orderkey AS page_number, k AS path_id FROM m WHERE l_returnflag <> 'A'")
def closed_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons.closed_loops(_shapes(_rows(spark, sf_dir)), [*SHEET, "path_id"]).select("page_number", "path_id")


@query(f"WITH {M} SELECT l_orderkey AS page_number, k AS path_id, CASE l_returnflag WHEN 'N' THEN round((l_quantity * 3 - 1) / 2, 6) WHEN 'R' THEN round(l_quantity * l_quantity, 6) ELSE 0.0 END AS area FROM m")
def polygon_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of triangles and squares by their corners; of two corners 0."""
    rows, q, one = _rows(spark, sf_dir), F.col("l_quantity"), F.lit(1.0)
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    corners = F.when(F.col("l_returnflag") == "N", F.array(p(zero, zero), p(q, one), p(one, F.lit(3.0)))).when(F.col("l_returnflag") == "R", F.array(p(zero, zero), p(q, zero), p(q, q), p(zero, q))).otherwise(F.array(p(zero, zero), p(q, q)))
    return polygons.path_areas(rows.select("page_number", F.col("k").alias("path_id"), corners.alias("c")), "c").select("page_number", "path_id", F.round("area", 6).alias("area"))


#: Strokes along x with arrow tips at some ends: at a where the supplier is even, at b where the part is, one more at both where k is 3.
STROKES = f"""{M}, s AS (SELECT l_orderkey AS page_number, k, {X} AS ax, {Y} AS y, {X} + l_quantity AS bx, l_quantity AS len, l_suppkey % 2 = 0 AS at_a, l_partkey % 2 = 0 AS at_b, l_tax AS w FROM m)"""


def _strokes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    x, y, q = F.col("x"), F.col("y"), F.col("l_quantity")
    lines = rows.select(*SHEET, F.col("k").alias("path_id"), F.lit(0).alias("ord"), F.col("l_tax").alias("stroke_width"), x.alias("ax"), y.alias("ay"), (x + q).alias("bx"), y.alias("by"))
    tips = rows.where("l_suppkey % 2 = 0").select(*SHEET, x.alias("x"), (y + 0.125).alias("y")).unionAll(rows.where("l_partkey % 2 = 0").select(*SHEET, (x + q).alias("x"), (y - 0.125).alias("y")))
    return lines, tips


@query(f"""
WITH {STROKES}
SELECT page_number, k AS path_id, at_a OR at_b AND short AS at_a, at_b OR at_a AND short AS at_b, at_a AND NOT short AS only_a, at_b AND NOT short AS only_b FROM (SELECT *, sqrt(len * len + 0.015625) <= 12 AS short FROM s)
""")
def arrowheads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which arrow tips touch which ends; those of a stroke that is shorter than the gap touch both."""
    lines, tips = _strokes(_rows(spark, sf_dir))
    return spatial.tips_at_ends(lines, tips, SHEET, "path_id", F.lit(12.0)).select("page_number", "path_id", "at_a", "at_b", "only_a", "only_b")


@query(f"""
WITH {STROKES},
a AS (SELECT *, row_number() OVER (PARTITION BY page_number ORDER BY k) AS n FROM s WHERE at_a AND at_b AND len >= 12),
l AS (SELECT *, row_number() OVER (PARTITION BY page_number ORDER BY k) AS n FROM s WHERE at_a <> at_b AND len >= 8)
SELECT page_number, 'span' AS kind, CAST(n AS INT) AS n, ax, bx FROM a UNION ALL SELECT page_number, 'leader', CAST(n AS INT), CASE WHEN at_a THEN ax ELSE bx END, CASE WHEN at_a THEN bx ELSE ax END FROM l
""")
def spans_and_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    spans, leaders = drawing.arrowed(*_strokes(rows), _limits(rows))
    return spans.select("page_number", F.lit("span").alias("kind"), "n", "ax", "bx").unionAll(leaders.select("page_number", F.lit("leader"), "n", "ax", "bx"))


@query(f"""
WITH {STROKES},
a AS (SELECT page_number, CAST(row_number() OVER (PARTITION BY page_number ORDER BY k) AS INT) AS span, (ax + bx) / 2 AS mx FROM s WHERE len >= 30),
l AS (SELECT page_number, CAST(k AS INT) AS n, ax FROM s WHERE len < 30)
SELECT l.page_number, l.n, min(a.span) AS anchor FROM l LEFT JOIN a ON a.page_number = l.page_number AND abs(mx - ax) <= 2.5 GROUP BY 1, 2
""")
def leader_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long strokes as spans and short ones as leaders, all on one level: who points in whose middle."""
    rows = _rows(spark, sf_dir)
    own = rows.select(*SHEET, F.col("k").cast("int").alias("n"), F.col("x").alias("ax"), F.lit(0.0).alias("ay"), (F.col("x") + F.col("l_quantity")).alias("bx"), F.lit(0.0).alias("by"), "l_quantity")
    spans = sequence.numbered(own.where("l_quantity >= 30").withColumnRenamed("n", "k"), SHEET, [F.col("k")], "n")
    return drawing.anchored(own.where("l_quantity < 30"), spans, _limits(rows)).select("page_number", "n", "anchor")


@query(f"""
WITH {STROKES}, c AS (SELECT page_number, round_even(w, 2) AS width, count(*) AS n FROM s WHERE at_a AND at_b AND len >= 12 GROUP BY 1, 2)
SELECT page_number, width, n FROM (SELECT *, row_number() OVER (PARTITION BY page_number ORDER BY n DESC, width) AS r FROM c) WHERE r = 1
""")
def dimension_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    lines, tips = _strokes(rows)
    return drawing.stroke_width(lines.withColumn("filled", F.lit(False)), tips, _limits(rows)).select("page_number", "width", "n")


#: Words of a sheet: two text lines a sheet, quantity as the word (some with signs or letters), and frames.
WORDS = f"""{M}, w AS (SELECT l_orderkey AS page_number, k % 2 AS line_no, k AS word_no, l_partkey % 4 AS kind, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, CAST(l_suppkey % 40 AS DOUBLE) AS x0, CAST((k % 2) * 20 AS DOUBLE) AS y0,
  CAST(l_suppkey % 40 + 6 AS DOUBLE) AS x1, CAST((k % 2) * 20 + 3 + l_suppkey % 3 AS DOUBLE) AS y1, l_returnflag AS f FROM m),
v AS (SELECT *, CASE kind WHEN 1 THEN 'N' || q WHEN 2 THEN '<' || q ELSE q END AS word FROM w),
n AS (SELECT * FROM v WHERE kind <> 1),
j AS (SELECT n.*, CASE WHEN n.y1 - n.y0 < 4 THEN 'too_small'
  WHEN EXISTS (SELECT 1 FROM v o WHERE o.page_number = n.page_number AND o.line_no = n.line_no AND NOT (o.x0 = n.x0 AND o.y0 = n.y0 AND o.x1 = n.x1 AND o.y1 = n.y1)
    AND ((o.x1 < n.x0 AND n.x0 - o.x1 < 8) OR (o.x0 > n.x1 AND o.x0 - n.x1 < 8) OR (o.x0 <= n.x0 AND o.x1 >= n.x1))) THEN 'in_row'
  WHEN EXISTS (SELECT 1 FROM v o WHERE o.page_number = n.page_number AND o.f = 'R' AND o.x0 - 2 + 0.3 < (n.x0 + n.x1) / 2 AND (n.x0 + n.x1) / 2 < o.x1 + 2 - 0.3 AND o.y0 - 2 + 0.3 < (n.y0 + n.y1) / 2 AND (n.y0 + n.y1) / 2 < o.y1 + 2 - 0.3
    AND n.x0 >= o.x0 - 2 - 1.2 AND n.y0 >= o.y0 - 2 - 1.2 AND n.x1 <= o.x1 + 2 + 1.2 AND n.y1 <= o.y1 + 2 + 1.2) THEN 'in_contour' ELSE 'ok' END AS verdict FROM n)"""


def _flagged_words(rows: DataFrame) -> DataFrame:
    """Words with the l_returnflag of their lines."""
    kind, q = F.col("l_partkey") % 4, F.col("l_quantity").cast("bigint").cast("string")
    x, y = (F.col("l_suppkey") % 40).cast("double"), (F.col("k") % 2 * 20).cast("double")
    return rows.select(
        *SHEET, F.lit(1).alias("block_no"), (F.col("k") % 2).cast("int").alias("line_no"), F.col("k").alias("word_no"), F.when(kind == 1, F.concat(F.lit("N"), q)).when(kind == 2, F.concat(F.lit("<"), q)).otherwise(q).alias("word"),
        x.alias("x0"), y.alias("y0"), (x + 6).alias("x1"), (y + 3 + F.col("l_suppkey") % 3).alias("y1"), "l_returnflag",
    )


def _words(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words and, around those of R, frames."""
    words = _flagged_words(rows)
    box = geometry.grow([F.col(c) for c in spatial.BOX], 2.0)
    frames = words.where("l_returnflag = 'R'").select(*SHEET, F.col("word_no").alias("contour_id"), *[b.alias(c) for b, c in zip(box, spatial.BOX)])
    return words.drop("l_returnflag"), frames


@query(f"WITH {WORDS} SELECT page_number, word_no, word AS text, verdict FROM j")
def judged_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    words, frames = _words(rows)
    return drawing.judged_numbers(words, _limits(rows), frames).select("page_number", "word_no", "text", "verdict")


@query(f"""
WITH {WORDS} SELECT page_number, coalesce(string_agg(word, ',' ORDER BY line_no, x0, word_no) FILTER (verdict IN ('in_row', 'in_contour')), '') AS texts,
  count(*) FILTER (verdict = 'too_small') AS too_small, count(*) FILTER (verdict = 'in_row') AS in_row, count(*) FILTER (verdict = 'in_contour') AS in_contour FROM j GROUP BY 1
""")
def rejected_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    words, frames = _words(rows)
    return drawing.rejected(drawing.judged_numbers(words, _limits(rows), frames)).select("page_number", F.array_join("texts", ",").alias("texts"), "too_small", "in_row", "in_contour")


@query(f"""
WITH {WORDS}, b AS (SELECT page_number, word_no, word, x0, y0, x1, y1 FROM v)
SELECT b.page_number, b.word_no, min(o.word_no) AS contour_id FROM b LEFT JOIN v o ON o.f = 'R' AND o.page_number = b.page_number AND b.x0 >= o.x0 - 3 AND b.y0 >= o.y0 - 3 AND b.x1 <= o.x1 + 3 AND b.y1 <= o.y1 + 3 GROUP BY 1, 2
""")
def first_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word with the first frame, grown by a point, that holds it."""
    words, frames = _words(_rows(spark, sf_dir))
    return spatial.first_containing(words, frames, SHEET, "word_no", "contour_id").select("page_number", "word_no", F.col("contour_id").cast("long").alias("contour_id"))


@query(f"""
WITH {WORDS}, c AS (SELECT DISTINCT o.page_number, o.word_no, trunc(o.x0 - 2) AS a, trunc(o.y0 - 2) AS b, trunc(o.x1 + 2) AS c, trunc(o.y1 + 2) AS d FROM v o JOIN v b ON o.f = 'R' AND b.f = 'N' AND o.page_number = b.page_number AND b.x0 >= o.x0 - 3 AND b.y0 >= o.y0 - 3 AND b.x1 <= o.x1 + 3 AND b.y1 <= o.y1 + 3)
SELECT page_number, min(word_no) AS contour_id FROM c GROUP BY page_number, a, b, c, d
""")
def removable_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames around a word of N; those that are equal in whole points once."""
    rows = _rows(spark, sf_dir)
    words, frames = _words(rows)
    boxes = words.join(rows.where("l_returnflag = 'N'").select(*SHEET, F.col("k").alias("word_no")), [*SHEET, "word_no"], "left_semi")
    return redaction.removable_frames(frames, boxes, SHEET).select("page_number", F.col("contour_id").cast("long").alias("contour_id"))


ELEMENTS = f"""{WORDS}, e AS (SELECT *, CASE kind WHEN 0 THEN 'X ' || q WHEN 1 THEN 'DN' || q WHEN 2 THEN '<' || q || '>' ELSE q END AS t FROM v),
r AS (SELECT e.*, EXISTS (SELECT 1 FROM v o WHERE o.f = 'A' AND o.page_number = e.page_number AND abs(o.x0 - e.x0) <= 1 AND abs(o.y0 - e.y0) <= 1 AND abs(o.x1 - e.x1) <= 1 AND abs(o.y1 - e.y1) <= 1) AS accepted FROM e),
g AS (SELECT *, CASE WHEN accepted THEN 'dimension' WHEN kind = 0 THEN 'coordinate' WHEN kind = 1 THEN 'spec' WHEN kind = 2 THEN 'node' ELSE 'other' END AS role FROM r)"""


def _elements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Elements, labels that a detection accepted (words of A) and frames."""
    rows = _rows(spark, sf_dir)
    words, frames = _words(rows)
    kind, q = F.col("l_partkey") % 4, F.col("l_quantity").cast("bigint").cast("string")
    said = rows.select(*SHEET, F.col("k").alias("word_no"), "l_returnflag", F.when(kind == 0, F.concat(F.lit("X "), q)).when(kind == 1, F.concat(F.lit("DN"), q)).when(kind == 2, F.concat(F.lit("<"), q, F.lit(">"))).otherwise(q).alias("text"))
    items = words.join(said, [*SHEET, "word_no"]).select(*SHEET, F.concat(F.lit("N"), F.col("word_no").cast("string")).alias("mark"), "text", *spatial.BOX, "l_returnflag")
    return items.drop("l_returnflag"), items.where("l_returnflag = 'A'").select(*SHEET, *spatial.BOX), frames


@query(f"WITH {ELEMENTS} SELECT page_number, 'N' || word_no AS mark, accepted, role FROM g")
def element_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, labels, _ = _elements(spark, sf_dir)
    return redaction.assign_roles(items, labels, SHEET).select("page_number", "mark", "accepted", "role")


@query(f"""
WITH {ELEMENTS}, f AS (SELECT g.page_number, g.word_no, min(o.word_no) AS c FROM g LEFT JOIN v o ON o.f = 'R' AND o.page_number = g.page_number AND g.x0 >= o.x0 - 3 AND g.y0 >= o.y0 - 3 AND g.x1 <= o.x1 + 3 AND g.y1 <= o.y1 + 3 WHERE g.role <> 'dimension' GROUP BY 1, 2)
SELECT g.page_number, 'N' || g.word_no AS mark, coalesce(least(g.x0, o.x0 - 2), g.x0) - 2.4::DOUBLE AS x0, coalesce(least(g.y0, o.y0 - 2), g.y0) - 2.4::DOUBLE AS y0, coalesce(greatest(g.x1, o.x1 + 2), g.x1) + 2.4::DOUBLE AS x1, coalesce(greatest(g.y1, o.y1 + 2), g.y1) + 2.4::DOUBLE AS y1
FROM f JOIN g ON g.page_number = f.page_number AND g.word_no = f.word_no LEFT JOIN v o ON o.page_number = f.page_number AND o.word_no = f.c
""")
def cut_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, labels, frames = _elements(spark, sf_dir)
    made = redaction.plan(redaction.assign_roles(items, labels, SHEET), frames, SHEET)
    return made.select("page_number", "mark", *spatial.BOX)


GUARDED = f"""{WORDS}, b AS (SELECT page_number, word_no, x0, y0, x1, y1, q FROM v WHERE f <> 'A'),
l AS (SELECT page_number, word_no, x0 + 1 AS x0, y0 - 4 AS y0, x1 + 1 AS x1, y1 - 4 AS y1, x0 - 10 AS ax, y0 + 9 AS ay, x1 + 12 AS bx, y1 + 9 AS by_ FROM v WHERE f = 'A'),
h AS (SELECT b.page_number, b.word_no, p.pad, p.lab, p.lin, coalesce(bool_or(b.x0 - p.lab < l.x1 AND b.x1 + p.lab > l.x0 AND b.y0 - p.lab < l.y1 AND b.y1 + p.lab > l.y0), FALSE) AS label,
  coalesce(bool_or(len(list_filter(range(0, greatest(1, CAST(floor((abs(ax - bx) + abs(ay - by_)) / 2) AS INT)) + 1), lambda i: ax + (bx - ax) * (i::DOUBLE / greatest(1, CAST(floor((abs(ax - bx) + abs(ay - by_)) / 2) AS INT))) >= b.x0 - p.lin
    AND ax + (bx - ax) * (i::DOUBLE / greatest(1, CAST(floor((abs(ax - bx) + abs(ay - by_)) / 2) AS INT))) < b.x1 + p.lin AND ay + (by_ - ay) * (i::DOUBLE / greatest(1, CAST(floor((abs(ax - bx) + abs(ay - by_)) / 2) AS INT))) >= b.y0 - p.lin
    AND ay + (by_ - ay) * (i::DOUBLE / greatest(1, CAST(floor((abs(ax - bx) + abs(ay - by_)) / 2) AS INT))) < b.y1 + p.lin)) > 0), FALSE) AS line
  FROM b CROSS JOIN (VALUES (2.4::DOUBLE, 2.4::DOUBLE, 2.4::DOUBLE), (0.0::DOUBLE, 0.6::DOUBLE, 0.6::DOUBLE)) p(pad, lab, lin) LEFT JOIN l ON l.page_number = b.page_number GROUP BY 1, 2, 3, 4, 5),
z AS (SELECT page_number, word_no, bool_or(label OR line) FILTER (pad > 0) AS wide, bool_or(label) FILTER (pad > 0) AS wide_label, bool_or(label OR line) FILTER (pad = 0) AS bare FROM h GROUP BY 1, 2)"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _flagged_words(_rows(spark, sf_dir))
    boxes = items.where("l_returnflag <> 'A'").select(*SHEET, F.concat(F.lit("N"), F.col("word_no").cast("string")).alias("mark"), F.lit("spec").alias("role"), *spatial.BOX)
    x0, y0, x1, y1 = map(F.col, spatial.BOX)
    lines = items.where("l_returnflag = 'A'").select(*SHEET, (x0 + 1).alias("x0"), (y0 - 4).alias("y0"), (x1 + 1).alias("x1"), (y1 - 4).alias("y1"), (x0 - 10).alias("ax"), (y0 + 9).alias("ay"), (x1 + 12).alias("bx"), (y1 + 9).alias("by"), F.lit(None).cast("struct<x:double,y:double>").alias("leader_end"))
    return redaction.decide(boxes, redaction.guards(lines, SHEET), SHEET)


@query(f"""
WITH {GUARDED} SELECT page_number, 'N' || word_no AS mark, NOT wide OR NOT bare AS applied, CASE WHEN NOT wide THEN 2.4::DOUBLE WHEN NOT bare THEN 0.0::DOUBLE END AS pad, CASE WHEN wide AND bare THEN CASE WHEN wide_label THEN 'подпись размера' ELSE 'размерная линия' END END AS skip_reason FROM z
""")
def cut_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("page_number", "mark", "applied", "pad", "skip_reason")


@query(f"""
WITH {GUARDED} SELECT page_number, NOT (wide AND bare) AS applied, CASE WHEN wide AND bare THEN CASE WHEN wide_label THEN 'подпись размера' ELSE 'размерная линия' END ELSE 'spec' END AS reason, count(*) AS n FROM z GROUP BY 1, 2, 3
""")
def cut_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.counts(_decided(spark, sf_dir), ["page_number"])


@query(f"""
WITH {M}, v AS (SELECT l_orderkey AS page_number, k, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS label, CASE l_returnflag WHEN 'N' THEN 'span' ELSE 'pointer' END AS kind, 2.0::DOUBLE * {X} - 10 AS x0, 2.0::DOUBLE * {Y} - 20 AS y0, 2.0::DOUBLE * ({X} + 12) - 10 AS x1, 2.0::DOUBLE * ({Y} + 8) - 20 AS y1, l_quantity * 7.5::DOUBLE - 180 AS angle FROM m WHERE l_returnflag <> 'A'),
p AS (SELECT *, row_number() OVER (PARTITION BY page_number ORDER BY round_even(y0 * 10, 0), x0, k) AS n, CAST(CAST(round_even(((angle % 180) + 180) % 180 / 30, 0) AS INT) % 6 AS INT) AS axis FROM v)
SELECT page_number, string_agg('P' || n || ' "' || label || '" [' || CAST(round_even(x0, 0) AS BIGINT) || ',' || CAST(round_even(y0, 0) AS BIGINT) || ',' || CAST(round_even(x1, 0) AS BIGINT) || ',' || CAST(round_even(y1, 0) AS BIGINT)
  || '] линия [' || CAST(round_even(x0, 0) AS BIGINT) || ',' || CAST(round_even(y0, 0) AS BIGINT) || ',' || CAST(round_even(x1, 0) AS BIGINT) || ',' || CAST(round_even(y0, 0) AS BIGINT) || '] '
  || CASE kind WHEN 'span' THEN 'отрезок' ELSE 'выноска' END || ' ось ' || axis || ' (' || CAST(round_even(angle, 0) AS BIGINT) || '°)', chr(10) ORDER BY n) AS block FROM p GROUP BY 1
""")
def mark_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension lines to marks in pixels, in reading order, and their prompt block; lines of A have no value."""
    rows = _rows(spark, sf_dir)
    x, y = F.col("x"), F.col("y")
    lines = rows.select(
        *SHEET, F.when(F.col("l_returnflag") != "A", F.col("l_quantity")).alias("value"), F.col("l_quantity").cast("bigint").cast("string").alias("label"), F.when(F.col("l_returnflag") == "N", "span").otherwise("pointer").alias("kind"), (F.col("l_quantity") * 7.5 - 180).alias("angle"),
        F.col("k").alias("idx"), x.alias("x0"), y.alias("y0"), (x + 12).alias("x1"), (y + 8).alias("y1"), x.alias("ax"), y.alias("ay"), (x + 12).alias("bx"), y.alias("by"),
    )
    view = rows.select(*SHEET).distinct().select(*SHEET, F.lit(2.0).alias("zoom"), F.lit(10.0).alias("dx"), F.lit(20.0).alias("dy"))
    return drawing.prompt_block(drawing.marks_in_pixels(lines, view)).select("page_number", "block")


@query(f"""
WITH {M}, s AS (SELECT l_orderkey AS page_number, list_sort(list(l_quantity + 0.5::DOUBLE)) AS z, len(list(l_quantity)) AS n, max(CAST(l_suppkey AS DOUBLE)) AS w FROM m GROUP BY 1),
t AS (SELECT page_number, n >= 5 AS by_text, CASE WHEN n >= 5 THEN z[n // 2 + 1] / 7.43::DOUBLE ELSE least(w * 100 + 50, 500.0::DOUBLE) / 841.89::DOUBLE END AS raw FROM s)
SELECT page_number, round(least(greatest(raw, 0.2), 8.0), 9) AS scale, CASE WHEN by_text THEN 'text' ELSE 'side' END || CASE WHEN raw < 0.2 OR raw > 8 THEN '+clamped' ELSE '' END AS scale_source FROM t
""")
def sheet_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scales by the upper median of five font sizes or more, else by the shorter side; clamped."""
    rows = _rows(spark, sf_dir)
    sheets = rows.groupBy(*SHEET).agg((F.max("l_suppkey").cast("double") * 100 + 50).alias("width_pt")).withColumn("height_pt", F.lit(500.0))
    spans = rows.select(*SHEET, F.col("l_quantity").cast("bigint").cast("string").alias("text"), (F.col("l_quantity") + 0.5).alias("font_size"), F.array().cast("array<struct<c:string,x0:double,y0:double,x1:double,y1:double>>").alias("chars"))
    return drawing.sheet_scale(sheets, spans).select("page_number", F.round("scale", 9).alias("scale"), "scale_source")


@query("""
SELECT p_partkey, round(12.0 * s, 9) AS min_length, round(30.0 * s * s, 9) AS arrow_max_area, 8 AS ring_min_segments, round(0.2 * s, 9) AS arrow_gap FROM (SELECT p_partkey, p_size::DOUBLE / 8 AS s FROM part)
""")
def scaled_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", *drawing.scaled_limits(F.col("p_size").cast("double") / 8, drawing.Limits()))
    return rows.select("p_partkey", F.round("min_length", 9).alias("min_length"), F.round("arrow_max_area", 9).alias("arrow_max_area"), "ring_min_segments", F.round("arrow_gap", 9).alias("arrow_gap"))


CHARS = "array<struct<c:string,x0:double,y0:double,x1:double,y1:double>>"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of characters: name and brand of a part, each character a unit wide; a part's hundred is its sheet."""
    said = F.concat(F.col("p_name"), F.lit("  "), F.col("p_brand"), F.lit(" "))
    at = F.transform(F.sequence(F.lit(1), F.length(said)), lambda i: F.struct(F.substring(said, i, F.lit(1)).alias("c"), i.cast("double").alias("x0"), F.col("p_size").cast("double").alias("y0"), (i + 1).cast("double").alias("x1"), (F.col("p_size") + 2).cast("double").alias("y1")))
    return table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 100).alias("sheet"), "p_partkey", (F.col("p_size") / 4.0).alias("font_size"), at.cast(CHARS).alias("chars"))


TOKENS = """t AS (SELECT p_partkey // 100 AS sheet, p_partkey, p_size, p_name || '  ' || p_brand || ' ' AS s FROM part),
w AS (SELECT sheet, p_partkey, p_size, unnest(regexp_extract_all(s, '[^ ]+')) AS word, unnest(list_transform(range(1, len(regexp_extract_all(s, '[^ ]+')) + 1), lambda i: i)) AS i, s FROM t),
b AS (SELECT *, 1 + length(list_reduce(list_prepend('', list_slice(regexp_extract_all(s, ' *[^ ]+'), 1, i - 1)), lambda a, x: a || x)) + length(regexp_extract(regexp_extract_all(s, ' *[^ ]+')[i], '^ *')) AS x FROM w)"""


@query(f"WITH {TOKENS} SELECT sheet, word AS text, CAST(x AS DOUBLE) AS x0, CAST(x + length(word) AS DOUBLE) AS x1, count(*) AS n FROM b WHERE p_size >= 20 GROUP BY ALL")
def span_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of spans with a font height of 5 or more, with the place of their characters."""
    return sequence.tokens_of_spans(_spans(spark, sf_dir), ["sheet"], 5.0).groupBy("sheet", "text", "x0", "x1").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {TOKENS}, p AS (SELECT DISTINCT sheet, word, 2.0::DOUBLE * x - 1 AS x0, 2.0::DOUBLE * p_size - 3 AS y0 FROM b WHERE p_size / 4.0 * 2 >= 6)
SELECT sheet, word AS text, x0, y0 FROM p
""")
def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text layer in pixels: small fonts dropped, each text and place once."""
    spans = _spans(spark, sf_dir)
    view = spans.select("sheet").distinct().select("sheet", F.lit(2.0).alias("zoom"), F.lit(1.0).alias("dx"), F.lit(3.0).alias("dy"))
    return textmap.text_items(spans, view, ["sheet"], 6.0).select("sheet", "text", "x0", "y0")


@query(f"""
WITH {M}, s AS (SELECT l_orderkey AS page_number, l_suppkey % 2 AS line_no, k AS span_no, CASE WHEN l_partkey % 7 = 0 THEN ' ' ELSE 't' || k END AS t, l_discount * 100 AS x0, l_quantity AS y0, l_discount * 100 + 9.5 AS x1, l_quantity + 4.25 AS y1, l_tax * 100 + 3 AS size FROM m),
l AS (SELECT page_number, line_no, page_number % 4 AS turn, trim(string_agg(t, ' ' ORDER BY x0, span_no)) AS text, round_even(min(x0), 2) AS x0, round_even(min(y0), 2) AS y0, round_even(max(x1), 2) AS x1, round_even(max(y1), 2) AS y1, round_even(max(size), 2) AS size FROM s WHERE trim(t) <> '' GROUP BY 1, 2)
SELECT page_number, line_no, text, x0, y0, x1, y1, size, round_even((x0 + x1) / 2, 2) AS cx, CASE turn WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN -90.0::DOUBLE WHEN 2 THEN 45.0::DOUBLE ELSE 90.0::DOUBLE END AS angle, CAST(row_number() OVER (PARTITION BY page_number ORDER BY round_even(y0 * 10, 0), x0, line_no) AS INT) AS n FROM l WHERE size >= 4
""")
def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of spans in four directions."""
    rows, turn = _rows(spark, sf_dir), F.col("page_number") % 4
    x, y = F.col("l_discount") * 100, F.col("l_quantity")
    spans = rows.select("page_number", F.lit(1).alias("block_no"), (F.col("l_suppkey") % 2).alias("line_no"), F.col("k").alias("span_no"), F.when(F.col("l_partkey") % 7 == 0, " ").otherwise(F.concat(F.lit("t"), F.col("k").cast("string"))).alias("text"), (F.col("l_tax") * 100 + 3).alias("font_size"), F.when(turn == 0, 1.0).when(turn == 2, 0.5).otherwise(0.0).alias("dir_x"), F.when(turn == 0, 0.0).when(turn == 1, 1.0).when(turn == 2, -0.5).otherwise(-1.0).alias("dir_y"), x.alias("x0"), y.alias("y0"), (x + 9.5).alias("x1"), (y + 4.25).alias("y1"))
    return textmap.line_items(spans, ["page_number"], 4.0).select("page_number", "line_no", "text", "x0", "y0", "x1", "y1", "size", "cx", "angle", "n")


@query(f"""
WITH RECURSIVE {M}, s AS (SELECT l_orderkey AS page_number, CAST((l_suppkey % 3) * 10 AS DOUBLE) AS y0, l_discount * 100 AS x0, CAST((l_suppkey % 3) * 10 + 5 AS DOUBLE) AS y1, l_discount * 100 + l_quantity % 4 AS x1, 'w' || (l_partkey % 10) AS t FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY page_number ORDER BY round_even(y0 * 10, 0), x0, y0, x1, y1, t) AS r FROM s),
w AS (SELECT page_number, r, 1 AS e, t, x0, y0, x1, y1 FROM o WHERE r = 1
  UNION ALL SELECT o.page_number, o.r, CASE WHEN j THEN w.e ELSE w.e + 1 END, CASE WHEN j THEN w.t || ' ' || o.t ELSE o.t END, CASE WHEN j THEN least(w.x0, o.x0) ELSE o.x0 END, CASE WHEN j THEN least(w.y0, o.y0) ELSE o.y0 END, CASE WHEN j THEN greatest(w.x1, o.x1) ELSE o.x1 END, CASE WHEN j THEN greatest(w.y1, o.y1) ELSE o.y1 END
  FROM w JOIN o ON o.page_number = w.page_number AND o.r = w.r + 1, LATERAL (SELECT abs(o.y0 - w.y0) <= greatest(1.5, 0.35 * least(o.y1 - o.y0, w.y1 - w.y0)) AND o.x0 - w.x1 >= -0.5 AND o.x0 - w.x1 <= greatest(2.0, 0.6 * (o.y1 - o.y0)) AS j) q)
SELECT page_number, e AS n, arg_max(t, r) AS text, arg_max(x0, r) AS x0, arg_max(y0, r) AS y0, arg_max(x1, r) AS x1, arg_max(y1, r) AS y1 FROM w GROUP BY 1, 2
""")
def joined_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that nearly touch on one line, joined one after the other with their growing box."""
    x, y = F.col("l_discount") * 100, (F.col("l_suppkey") % 3 * 10).cast("double")
    spans = _rows(spark, sf_dir).select("page_number", F.concat(F.lit("w"), (F.col("l_partkey") % 10).cast("string")).alias("text"), x.alias("x0"), y.alias("y0"), (x + F.col("l_quantity") % 4).alias("x1"), (y + 5).alias("y1"))
    return sequence.group_spans(spans, ["page_number"])


@query(f"""
WITH {M} SELECT l_orderkey AS page_number, l_quantity AS key, string_agg(k, ',' ORDER BY k) AS positions FROM m GROUP BY 1, 2
""")
def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("n", F.col("k"))
    return sequence.text_index(rows, ["page_number"], F.col("l_quantity")).select("page_number", "key", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


@query(f"""
WITH {M} SELECT l_orderkey AS page_number, k, ({X} + 2 >= 10 AND {X} + 2 < 60 AND {Y} + 2 >= 20 AND {Y} + 2 < 80) AS kept FROM m
""")
def inside_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _rows(spark, sf_dir).select("page_number", "k", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 4).alias("x1"), (F.col("y") + 4).alias("y1"))
    return sequence.inside_box(items, [F.lit(10.0), F.lit(20.0), F.lit(60.0), F.lit(80.0)]).select("page_number", F.col("k").cast("long").alias("k"), "kept")


@query("""
WITH p AS (SELECT p_partkey, p_size * 10.0::DOUBLE AS w, p_retailprice / 10 AS h, p_size * 1.5::DOUBLE AS a, p_retailprice / 100 AS b FROM part)
SELECT p_partkey, least(220 / 72.0::DOUBLE, 2000.0::DOUBLE / greatest(w, h)) AS zoom, CASE WHEN least(a + 60, w) - greatest(a - 8, 0) < 40 OR least(b + 60, h) - greatest(b - 8, 0) < 40 THEN 0.0 ELSE greatest(a - 8, 0) END AS x0,
  CASE WHEN least(a + 60, w) - greatest(a - 8, 0) < 40 OR least(b + 60, h) - greatest(b - 8, 0) < 40 THEN w ELSE least(a + 60, w) END AS x1, round_even(a / (72.0::DOUBLE / 25.4::DOUBLE), 2) AS mm, round_even(b / 72.0::DOUBLE, 2) AS inches FROM p
""")
def page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zoom of a page, its padded content box, and places in other units."""
    w, h, a, b = F.col("p_size") * 10.0, F.col("p_retailprice") / 10, F.col("p_size") * 1.5, F.col("p_retailprice") / 100
    box = geometry.expand([a, b, a + 52, b + 52], 8.0, w, h, 40.0)
    return table(spark, sf_dir, "part").select("p_partkey", geometry.zoom_for(w, h, 220.0, 2000.0).alias("zoom"), box[0].alias("x0"), box[2].alias("x1"), geometry.to_unit(a, "mm").alias("mm"), geometry.to_unit(b, "in").alias("inches"))


@query(f"""
WITH {M}, a AS (SELECT l_orderkey AS page_number, k, {X} AS x0, l_quantity AS y0, {X} + 5 AS x1, l_quantity + 3 AS y1 FROM m)
SELECT a.page_number, a.k AS a, b.k AS b FROM a JOIN a b ON a.page_number = b.page_number AND a.k < b.k AND NOT (a.x1 < b.x0 - 0.5 OR a.x0 > b.x1 + 0.5 OR a.y1 < b.y0 - 0.5 OR a.y0 > b.y1 + 0.5)
""")
def overlapping_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _rows(spark, sf_dir).select("page_number", "k", F.col("x").alias("x0"), F.col("l_quantity").alias("y0"), (F.col("x") + 5).alias("x1"), (F.col("l_quantity") + 3).alias("y1"))
    a, b = boxes.withColumnRenamed("k", "a"), spatial.aside(boxes)
    pairs = a.join(b, (F.col("page_number") == F.col("r_page_number")) & (F.col("a") < F.col("r_k")) & geometry.boxes_overlap([F.col(c) for c in spatial.BOX], spatial.right(), 0.5))
    return pairs.select("page_number", F.col("a").cast("long").alias("a"), F.col("r_k").cast("long").alias("b"))


@query("""
WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS ax, p_retailprice AS ay, p_size + p_partkey % 4 * 3.0::DOUBLE AS bx, p_retailprice + p_partkey % 4 * 4.0::DOUBLE AS by_ FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 > 1 THEN round(ax + 0.6 * 3, 6) END AS inset_x, CASE WHEN p_partkey % 4 = 0 THEN 1.0::DOUBLE ELSE -0.8::DOUBLE END AS normal_x, CASE WHEN p_partkey % 4 = 0 THEN 0.0::DOUBLE ELSE 0.6::DOUBLE END AS normal_y, round(2 * ax - bx, 6) AS away_x FROM p
""")
def overlay_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insets, normals and mirrored ends of strokes of length 0, 5, 10 and 15."""
    x, y, n = F.col("p_size").cast("double"), F.col("p_retailprice"), F.col("p_partkey") % 4
    bx, by = x + n * 3.0, y + n * 4.0
    normal, mirrored = layout.normal(x, y, bx, by), layout.away(x, y, bx, by)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(layout.inset(x, y, bx, by, 3.0).ax, 6).alias("inset_x"), F.round(normal[0], 6).cast("double").alias("normal_x"), F.round(normal[1], 6).cast("double").alias("normal_y"), F.round(mirrored[0], 6).alias("away_x"))


@query("""
SELECT p_partkey, unnest(list_distinct(CASE WHEN v = floor(v) THEN [printf('%g', v), regexp_replace(format('{:,}', CAST(floor(v) AS BIGINT)), ',', ' ', 'g'), CAST(CAST(floor(v) AS BIGINT) AS VARCHAR)] ELSE [printf('%g', v), printf('%.1f', round_even(v, 1))] END)) AS form
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_retailprice * 25 WHEN 1 THEN CAST(p_size * 1250 AS DOUBLE) ELSE p_size + 0.25::DOUBLE END AS v FROM part)
""")
def written_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    which = F.col("p_partkey") % 3
    v = F.when(which == 0, F.col("p_retailprice") * 25).when(which == 1, (F.col("p_size") * 1250).cast("double")).otherwise(F.col("p_size") + 0.25)
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(num.written_forms(v)).alias("form"))


@query(f"""
WITH {M}, r AS (SELECT l_orderkey AS page_number, k, l_orderkey % 9 + 1 AS first, l_orderkey % 9 + 1 + l_orderkey % 3 AS last, l_orderkey % 4 AS kind FROM m)
SELECT page_number, k FROM r WHERE kind = 0 OR (kind = 1 AND k BETWEEN first AND last) OR (kind = 2 AND k BETWEEN first AND last) OR (kind = 3 AND (k = 1 OR k = first OR k = 2))
""")
def selected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages (lines) that a specification of each order names: all, a range, a reversed range, a list with repeats."""
    first, kind = F.col("l_orderkey") % 9 + 1, F.col("l_orderkey") % 4
    last = first + F.col("l_orderkey") % 3
    a, b = first.cast("string"), last.cast("string")
    spec = F.when(kind == 0, F.lit("all")).when(kind == 1, F.concat(a, F.lit("-"), b)).when(kind == 2, F.concat(b, F.lit(" - "), a)).otherwise(F.concat(F.lit("2,1,"), a, F.lit(",2")))
    rows = _rows(spark, sf_dir).select("page_number", "k", spec.alias("spec"))
    return sequence.pages_of_spec(rows, "spec", "k").select("page_number", F.col("k").cast("long").alias("k"))


@query("""
WITH s AS (SELECT s_suppkey, 'exp_' || CASE WHEN s_suppkey % 4 = 0 THEN 'x' ELSE CAST(s_suppkey % 15 AS VARCHAR) END || chr(97 + CAST(s_suppkey % 3 AS INT)) AS name FROM supplier)
SELECT s_suppkey, name, row_number() OVER (ORDER BY TRY_CAST(regexp_extract(name, '([0-9]+)', 1) AS BIGINT) NULLS LAST, name, s_suppkey) - 1 AS pos FROM s
""")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    name = F.concat(F.lit("exp_"), F.when(key % 4 == 0, "x").otherwise((key % 15).cast("string")), F.char(97 + key % 3))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name"))
    return sequence.placed(rows, [*sequence.natural_order(F.col("name")), key], "pos")


@query("""
WITH d AS (SELECT doc_id, replace(replace(replace(replace(coalesce(text, ''), '°', ' deg'), '—', '-'), '–', '-'), '…', '...') || ' Ø 5 × 3 ≤ 7' AS t FROM documents)
SELECT doc_id, trim(regexp_replace(regexp_replace(replace(replace(replace(t, 'Ø', 'D'), '×', 'x'), '≤', '<='), '[^ -~]', ' ', 'g'), ' +', ' ', 'g')) AS plain FROM d
""")
def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts for fonts that hold only printable ASCII."""
    return table(spark, sf_dir, "documents").select("doc_id", text.plain_ascii(F.concat(F.coalesce("text", F.lit("")), F.lit(" Ø 5 × 3 ≤ 7"))).alias("plain"))


@query(None)
def detected_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole detection: strokes with arrows, labels in their middle; the choice among labels is held against plain code in the tests."""
    doc = F.concat(F.lit("d"), (F.col("l_orderkey") % 12).cast("string"))
    lines = table(spark, sf_dir, "lineitem").select(*ORDER, "l_quantity", "l_discount", doc.alias("doc_id"), F.col("l_orderkey").alias("page_number"))
    lines = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *SHEET)
    rows = sequence.numbered(lines, SHEET, list(map(F.col, ORDER)), "k").select(*SHEET, F.col("k").cast("long").alias("k"), (F.col("l_discount") * 1000).alias("x"), "l_quantity")
    x, y, q = F.col("x"), F.col("k") * 60.0, F.col("l_quantity") + 20
    item = lambda a, b, c, d: F.struct(F.lit("l").alias("kind"), a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    path = lambda n, fill, width, *items: F.struct((F.col("k") * 3 + n).alias("path_id"), fill.cast("array<double>").alias("fill"), width.alias("stroke_width"), F.array(*items).cast(_ITEM).alias("items"))
    head = lambda n, at, way: path(n, F.array(F.lit(0.0)), F.lit(0.0), item(at, y, at + way * 4, y + 1), item(at + way * 4, y + 1, at + way * 4, y - 1), item(at + way * 4, y - 1, at, y))
    paths = rows.select(*SHEET, F.inline(F.array(path(0, F.array(), F.lit(0.48 * 500 / 841.89), item(x, y, x + q, y)), head(1, x, 1), head(2, x + q, -1))))
    words = rows.select(*SHEET, F.col("k").alias("block_no"), F.lit(1).alias("line_no"), F.lit(1).alias("word_no"), F.col("l_quantity").cast("bigint").cast("string").alias("word"), (x + q / 2 - 4).alias("x0"), (y - 7).alias("y0"), (x + q / 2 + 4).alias("x1"), (y - 1).alias("y1"))
    sheets = rows.select(*SHEET).distinct().select(*SHEET, F.lit(600.0).alias("width_pt"), F.lit(500.0).alias("height_pt"))
    spans = rows.limit(0).select(*SHEET, F.lit("").alias("text"), F.lit(1.0).alias("font_size"), F.array().cast(CHARS).alias("chars"))
    found = drawing.detect(sheets, paths, words, spans)["lines"]
    return found.select("page_number", "idx", "kind", "label", "value", "length_pt")


@query(f"""
WITH {M}, v AS (SELECT l_orderkey AS page_number, k AS idx, {X} AS x, {Y} AS y, l_quantity AS q, l_returnflag = 'N' AS led FROM m)
SELECT page_number, idx, 'line' AS part, x AS ax, y AS ay, x + q AS bx, y AS by FROM v UNION ALL SELECT page_number, idx, 'leader', x, y, x - 5, y + q FROM v WHERE led
""")
def spared_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of lines, and of the leaders that some have, which a cut must spare."""
    x, y, q = F.col("x"), F.col("y"), F.col("l_quantity")
    lead = F.when(F.col("l_returnflag") == "N", F.struct((x - 5).alias("x"), (y + q).alias("y")))
    lines = _rows(spark, sf_dir).select("page_number", F.col("k").alias("idx"), x.alias("ax"), y.alias("ay"), (x + q).alias("bx"), y.alias("by"), lead.alias("leader_end"))
    return redaction.kept_geometry(lines, ["page_number"])


@query("""
WITH p AS (SELECT o_custkey AS run, o_orderkey AS page, CASE o_orderkey % 4 WHEN 0 THEN 'late' WHEN 1 THEN 'empty' END AS error FROM orders)
SELECT run, string_agg(page || ' ' || error, ', ' ORDER BY page) AS errors FROM p WHERE error IS NOT NULL GROUP BY 1
""")
def run_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    which = F.col("o_orderkey") % 4
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("page_number"), F.when(which == 0, "late").when(which == 1, "empty").alias("error"))
    told = F.transform("errors", lambda e: F.concat(e.page.cast("string"), F.lit(" "), e.error))
    return cost.page_errors(pages, ["run"]).select("run", F.array_join(told, ", ").alias("errors"))


@query("""
WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity % 12, l_discount, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem),
w AS (SELECT l_orderkey AS page_number, r, l_quantity % 12 AS y FROM m),
f AS (SELECT page_number, r, [y] AS means, [1] AS sizes FROM w WHERE r = 1
  UNION ALL SELECT w.page_number, w.r, CASE WHEN hit IS NULL THEN list_append(means, w.y) ELSE list_transform(means, lambda v, i: CASE WHEN i = hit THEN v + (w.y - v) / (sizes[i] + 1) ELSE v END) END, CASE WHEN hit IS NULL THEN list_append(sizes, 1) ELSE list_transform(sizes, lambda v, i: CASE WHEN i = hit THEN v + 1 ELSE v END) END
  FROM f JOIN w ON w.page_number = f.page_number AND w.r = f.r + 1, LATERAL (SELECT list_min(list_filter(range(1, len(means) + 1), lambda i: abs(means[i] - w.y) <= 2)) AS hit) q)
SELECT page_number, CAST(len(arg_max(means, r)) AS BIGINT) AS lines, list_max(arg_max(sizes, r)) AS longest, round(list_sum(arg_max(means, r)), 6) AS heights FROM f GROUP BY 1
""")
def clustered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to the first line whose running mean is near."""
    rows = table(spark, sf_dir, "lineitem")
    y = F.col("l_quantity") % 12
    words = rows.select(F.col("l_orderkey").alias("page_number"), F.lit("w").alias("word"), F.col("l_discount").alias("x0"), y.alias("y0"), (F.col("l_discount") + 1).alias("x1"), y.alias("y1"))
    found = sequence.cluster_lines(words, ["page_number"], 2.0)
    sizes = F.size(F.split("text", " "))
    return found.groupBy("page_number").agg(F.count(F.lit(1)).alias("lines"), F.max(sizes).alias("longest"), F.round(F.sum("y"), 6).alias("heights"))
