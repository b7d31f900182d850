"""Queries over pages, pictures, cuts and reports made from the order lines and parts."""

from __future__ import annotations

import urllib.parse
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import saved, tables
from plumbline.functions import png
from plumbline.operators import overlay, placing, quality, redaction, selection, spatial, textmap, trim
from plumbline.plans.bridge import FAMILY, NUMBERED, _lines
from plumbline.plans.registry import query
from plumbline.plans.replies import EVENT, _events, _replies
from plumbline.plans.sheets import SHEET, M, _rows
from plumbline.session import table
from plumbline.sources import pages

_CHAR = "array<struct<c:string,x0:double,y0:double,x1:double,y1:double>>"


@query(f"""
WITH {M}, a AS (SELECT l_orderkey AS page_number, k, l_returnflag AS f FROM m),
h AS (SELECT a.page_number, a.k, row_number() OVER (PARTITION BY a.page_number ORDER BY a.k) AS hit FROM a JOIN a b ON b.page_number = a.page_number AND b.k = a.k + 1 WHERE a.k % 3 = 1 AND b.f = 'R')
SELECT page_number, hit, 1 AS part, k AS line_no, 10.0::DOUBLE AS x0, 10.0::DOUBLE * k AS y0, 14.0::DOUBLE AS x1, 10.0::DOUBLE * k + 8 AS y1 FROM h
UNION ALL SELECT page_number, hit, 2, k + 1, 0.0, 10.0::DOUBLE * (k + 1), 4.0, 10.0::DOUBLE * (k + 1) + 8 FROM h
""")
def glyph_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that go over the ends of lines, in any case, with the box of their glyphs on each line."""
    rows = _rows(spark, sf_dir)
    y = (F.col("k") * 10).cast("double")
    said = [F.col("l_returnflag"), F.col("l_linestatus"), (F.col("k") % 3).cast("string")]
    chars = F.array(*(F.struct(c.alias("c"), F.lit(5.0 * i).alias("x0"), y.alias("y0"), F.lit(5.0 * i + 4).alias("x1"), (y + 8).alias("y1")) for i, c in enumerate(said)))
    spans = rows.select("page_number", F.lit(0).alias("block_no"), F.col("k").cast("int").alias("line_no"), F.lit(0).alias("span_no"), chars.cast(_CHAR).alias("chars"))
    return textmap.glyph_hits(spans, ["page_number"], "1 \n r").select("page_number", "hit", "part", "line_no", "x0", "y0", "x1", "y1")


@query(f"""
WITH {M}, o AS (SELECT l_orderkey, l_orderkey % 12 AS doc, row_number() OVER (PARTITION BY l_orderkey % 12 ORDER BY l_orderkey) AS page_number FROM (SELECT DISTINCT l_orderkey FROM m))
SELECT CAST(o.doc AS BIGINT) AS doc, CAST(o.page_number AS INT) AS page_number, CAST(m.k AS INT) AS word_no, m.l_returnflag || m.k AS word, m.l_quantity AS x0 FROM o JOIN m ON m.l_orderkey = o.l_orderkey WHERE o.page_number % 2 = 1
""")
def page_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the odd pages of drawing files, a file for each twelfth order: written as lines of JSON, read by the format ``sheets``."""
    pages.register(spark)
    rows = _rows(spark, sf_dir)
    word = F.struct(F.lit(0).alias("block_no"), F.lit(0).alias("line_no"), F.col("k").alias("word_no"), F.concat("l_returnflag", F.col("k").cast("string")).alias("word"), F.col("l_quantity").alias("x0"), F.lit(1.0).alias("y0"), F.lit(2.0).alias("x1"), F.lit(3.0).alias("y1"))
    drawn = rows.groupBy("l_orderkey").agg(F.lit(100.0).alias("width_pt"), F.lit(50.0).alias("height_pt"), F.array_sort(F.collect_list(F.struct(F.col("k"), word.alias("w")))).alias("ws"))
    line = F.to_json(F.struct("width_pt", "height_pt", F.transform("ws", lambda w: w.w).alias("words")))
    doc = F.format_string("d%02d.jsonl", F.col("l_orderkey") % 12)
    path = f"{saved.shared_dir(spark)}/plumbline-{uuid.uuid4().hex}"
    drawn.select(doc.alias("doc"), "l_orderkey", line.alias("value")).repartition("doc").sortWithinPartitions("doc", "l_orderkey").drop("l_orderkey").write.partitionBy("doc").text(path)
    folder = urllib.parse.urlparse(path).path
    read = spark.read.format("sheets").options(path=folder, suffix=".txt", table="words", pages_in_partition="500").load()
    number = F.regexp_extract("doc_id", "d(\\d+)", 1).cast("long")
    return read.where("page_number % 2 = 1").select(number.alias("doc"), "page_number", "word_no", "word", "x0")


#: Cuts (rows of R that are applied), words and strokes whose places are whole numbers, so that ends meet exactly.
CUT = f"""{M}, g AS (SELECT l_orderkey AS page_number, k, l_returnflag AS f, CAST(round(l_discount * 100) AS BIGINT) * 6.0::DOUBLE AS x, (k % 4) * 5.0::DOUBLE AS y, l_quantity AS q, l_linestatus = 'F' AS wide, l_partkey % 5 > 0 AS applied FROM m),
c AS (SELECT page_number, x - CASE WHEN wide THEN 2 ELSE 0 END AS x0, y - CASE WHEN wide THEN 2 ELSE 0 END AS y0, x + q + CASE WHEN wide THEN 2 ELSE 0 END AS x1, y + 9 + CASE WHEN wide THEN 2 ELSE 0 END AS y1 FROM g WHERE f = 'R' AND applied)"""


def _cut(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = _rows(spark, sf_dir).withColumn("x", F.round(F.col("l_discount") * 100).cast("long") * 6.0).withColumn("y", (F.col("k") % 4) * 5.0)
    x, y, q = F.col("x"), F.col("y"), F.col("l_quantity")
    decided = rows.where("l_returnflag = 'R'").select(*SHEET, x.alias("x0"), y.alias("y0"), (x + q).alias("x1"), (y + 9).alias("y1"), (F.col("l_partkey") % 5 > 0).alias("applied"), F.when(F.col("l_linestatus") == "F", 2.0).otherwise(0.0).alias("pad"))
    item = lambda kind, dx, dy: F.struct(F.lit(kind).alias("kind"), x.alias("x0"), (y + 3).alias("y0"), (x + dx).alias("x1"), (y + 3 + dy).alias("y1"))
    zero = F.lit(0.0)
    items = F.when(F.col("k") % 3 == 0, F.array(item("l", zero, q / 2))).when(F.col("k") % 3 == 1, F.array(item("l", q, zero))).otherwise(F.array(item("l", q, zero), item("l", zero, q / 2)))
    paths = rows.select(*SHEET, F.col("k").alias("path_id"), items.alias("items"))
    words = rows.select(*SHEET, F.col("k").alias("word_no"), x.alias("x0"), y.alias("y0"), (x + 5).alias("x1"), (y + 4).alias("y1"))
    chars = F.transform(F.sequence(F.lit(0), F.least(F.col("k").cast("int"), F.lit(8))), lambda i: F.struct(F.char(i + 97).alias("c"), (x + i * 4).alias("x0"), y.alias("y0"), (x + i * 4 + 3).alias("x1"), (y + 4).alias("y1")))
    spans = rows.select(*SHEET, F.col("k").alias("span_no"), chars.alias("chars"))
    return redaction.apply(paths, words, spans, decided, SHEET)


@query(f"WITH {CUT} SELECT page_number, k AS word_no FROM g WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.page_number = g.page_number AND g.x < c.x1 AND g.x + 5 > c.x0 AND g.y < c.y1 AND g.y + 4 > c.y0)")
def cut_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that no applied cut overlaps."""
    return _cut(spark, sf_dir)["words"].select("page_number", "word_no")


@query(f"""
WITH {CUT}, h AS (SELECT page_number, k, i, chr(97 + CAST(i AS INT)) AS ch, x + i * 4 AS x0, y AS y0 FROM (SELECT *, unnest(range(0, least(k, 8) + 1)) AS i FROM g))
SELECT page_number, k AS span_no, string_agg(ch, '' ORDER BY i) AS text FROM h WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.page_number = h.page_number AND h.x0 < c.x1 AND h.x0 + 3 > c.x0 AND h.y0 < c.y1 AND h.y0 + 4 > c.y0) GROUP BY 1, 2
""")
def cut_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cuts leave of each span's characters."""
    return _cut(spark, sf_dir)["spans"].select("page_number", "span_no", F.array_join(F.transform("chars", lambda c: c.c), "").alias("text"))


@query(f"""
WITH {CUT}, s AS (SELECT page_number, k, FALSE AS up, y + 3 AS off, x AS a, x + q AS b FROM g WHERE k % 3 > 0 UNION ALL SELECT page_number, k, TRUE, x, y + 3, y + 3 + q / 2 FROM g WHERE k % 3 <> 1),
p AS (SELECT s.*, CASE WHEN up THEN c.y0 ELSE c.x0 END AS lo, CASE WHEN up THEN c.y1 ELSE c.x1 END AS hi FROM s JOIN c ON c.page_number = s.page_number AND CASE WHEN up THEN off BETWEEN c.x0 AND c.x1 AND c.y0 <= b AND c.y1 >= a ELSE off BETWEEN c.y0 AND c.y1 AND c.x0 <= b AND c.x1 >= a END),
o AS (SELECT *, greatest(a, coalesce(max(hi) OVER (PARTITION BY page_number, k, up ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a)) AS far FROM p),
v AS (SELECT page_number, k, up FROM o GROUP BY 1, 2, 3, a, b HAVING max(hi) >= b AND NOT bool_or(lo > far AND far < b))
SELECT page_number, k AS path_id FROM g WHERE (SELECT count(*) FROM v WHERE v.page_number = g.page_number AND v.k = g.k) < CASE WHEN k % 3 = 2 THEN 2 ELSE 1 END
""")
def cut_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of which some stroke is not wholly under the union of the cuts."""
    return _cut(spark, sf_dir)["paths"].select("page_number", "path_id")


@query(None)
def placed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of names around the lines of every order, among its words; held against a quadratic placement in the tests."""
    rows = _rows(spark, sf_dir)
    x, y, q, up = F.col("x"), F.col("y"), F.col("l_quantity"), F.col("l_partkey") % 2 == 1
    bx, by = F.when(up, x).otherwise(x + q), F.when(up, y + q).otherwise(y)
    lead = F.when(F.col("l_returnflag") == "N", F.struct((x - 5).alias("x"), (y + q).alias("y")))
    lines = rows.select(*SHEET, F.col("k").alias("idx"), F.concat(F.lit("P"), F.col("k").cast("string")).alias("name"), x.alias("ax"), y.alias("ay"), bx.alias("bx"), by.alias("by"), F.when(up, 90.0).otherwise(0.0).alias("angle"), q.alias("length_pt"), lead.alias("leader_end"))
    words = rows.select(*SHEET, (x + 3).alias("x0"), (y - 7).alias("y0"), (x + 15).alias("x1"), (y - 1).alias("y1"))
    sheets = rows.select(*SHEET).distinct().select(*SHEET, F.lit(200.0).alias("width_pt"), F.lit(160.0).alias("height_pt"))
    return placing.place_names(lines, words, sheets, SHEET, 6.0).select("page_number", "idx", "name", "x0", "y0", "step", "forced")


#: Sums of a sheet's values, item by item, with the number of items.
SUMS = f"""v AS (SELECT l_orderkey AS sheet, k, l_quantity AS q FROM m),
s AS (SELECT DISTINCT sheet, CAST(0 AS BIGINT) AS k, 0.0::DOUBLE AS total, 0 AS n FROM v UNION SELECT s.sheet, v.k, s.total + t.t * v.q, s.n + t.t FROM s JOIN v ON v.sheet = s.sheet AND v.k = s.k + 1 CROSS JOIN (SELECT unnest([0, 1]) AS t) t)"""


@query(f"""
WITH RECURSIVE m AS ({NUMBERED}), {SUMS}, g AS (SELECT sheet, CASE sheet % 3 WHEN 0 THEN max(q) WHEN 1 THEN sum(q) ELSE min(q) + 0.75 END AS target, count(*) AS c FROM v GROUP BY 1)
SELECT g.sheet AS page_number, CAST(min(s.n) AS INT) AS items, CAST(g.c - min(s.n) AS INT) AS left_out FROM g LEFT JOIN s ON s.sheet = g.sheet AND s.n > 0 AND abs(s.total - g.target) < 0.5 GROUP BY g.sheet, g.c
""")
def reachable_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of a sheet, of all of them, make the largest, all together, or none; and how many that leaves."""
    values = _rows(spark, sf_dir).select("page_number", F.col("l_quantity").alias("value"))
    kind = F.col("page_number") % 3
    targets = values.groupBy("page_number").agg(F.max("value").alias("a"), F.sum("value").alias("b"), F.min("value").alias("c")).select("page_number", F.when(kind == 0, F.col("a")).when(kind == 1, F.col("b")).otherwise(F.col("c") + 0.75).alias("target"))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return quality.reachable(values, targets, ["page_number"]).select("page_number", size("subset").alias("items"), size("left_out").alias("left_out"))


@query(f"""
WITH RECURSIVE m AS ({NUMBERED}), w AS (SELECT l_orderkey AS sheet, k, l_quantity AS q FROM m), fam AS (WITH {FAMILY} SELECT s.sheet, s.idx, s.len, r.parent FROM s LEFT JOIN r ON r.sheet = s.sheet AND r.small = s.idx), {SUMS},
g AS (SELECT sheet, count(*) AS n, sum(len) AS sum_all, coalesce(sum(len) FILTER (parent IS NULL), 0) AS counted, max(len) AS longest FROM fam GROUP BY 1),
t AS (SELECT *, CASE sheet % 4 WHEN 0 THEN counted WHEN 1 THEN sum_all WHEN 2 THEN longest ELSE sum_all + 5 END AS total FROM g),
z AS (SELECT t.sheet, CAST(min(s.n) AS INT) AS items FROM t JOIN s ON s.sheet = t.sheet AND s.n > 0 AND abs(s.total - t.total) < 0.5 GROUP BY 1)
SELECT t.sheet, t.n, t.counted, t.total, CASE WHEN abs(t.counted - t.total) < 1 THEN NULL WHEN z.items IS NULL THEN 'search' ELSE 'hierarchy' END AS fault, z.items FROM t LEFT JOIN z ON z.sheet = t.sheet
""")
def two_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the search for dimensions or their hierarchy makes a total wrong; the truth is right, too large, too small or out of reach."""
    lines = spatial.hierarchy(_lines(spark, sf_dir), ["sheet"])
    sums = lines.groupBy("sheet").agg(F.sum("value").alias("a"), F.sum(F.when(F.col("parent").isNull(), F.col("value"))).alias("c"), F.max("value").alias("l"))
    kind = F.col("sheet") % 4
    totals = sums.select("sheet", F.when(kind == 0, F.coalesce("c", F.lit(0.0))).when(kind == 1, F.col("a")).when(kind == 2, F.col("l")).otherwise(F.col("a") + 5).alias("total"))
    found = quality.two_layers(lines, totals, ["sheet"])
    return found.select("sheet", "n", "counted", "total", "fault", F.when(F.col("subset").isNotNull(), F.size("subset")).alias("items"))


#: A blank picture and two boxes that may overlap, from each part's size and key.
BOXED = """b AS (SELECT p_partkey, 20 AS ax0, 10 AS ay0, 20 + p_size AS ax1, 130 AS ay1, 40 + p_partkey % 7 AS bx0, 30 AS by0, 150 AS bx1, 30 + p_size AS by1 FROM part)"""


def _shares(rgb: np.ndarray) -> tuple[int, int]:
    """Pixels of a picture that are red, and blue."""
    of = lambda k, other: int(np.count_nonzero((rgb[..., k] == 255) & (rgb[..., 1] == 0) & (rgb[..., other] == 0)))
    return of(0, 2), of(2, 0)


@query(f"""
WITH {BOXED}, o AS (SELECT *, (ax1 - ax0) * (ay1 - ay0) AS a, (bx1 - bx0) * (by1 - by0) AS b, greatest(0, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0, least(ay1, by1) - greatest(ay0, by0)) AS shared FROM b)
SELECT p_partkey, CAST(a - shared AS BIGINT) AS red, CAST(b AS BIGINT) AS blue, least(ax0, bx0) - 1 AS x0, least(ay0, by0) - 1 AS y0, greatest(ax1, bx1) + 1 AS x1, greatest(ay1, by1) + 1 AS y1 FROM o
""")
def painted_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A red box and a blue one over it on a blank picture of each part: pixels of both, and the cut to what is drawn."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("double")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    blank = png.encode(np.full((160, 200, 3), 255, np.uint8))
    box = lambda *v: F.array(overlay.box_contour(*(x if not isinstance(x, float) else F.lit(x) for x in v)))
    none = F.lit(None).cast("double")
    shape = lambda z, contours, color: parts.select(key, F.lit(z).cast("long").alias("z"), contours.alias("contours"), F.lit(None).cast("string").alias("text"), *(none.alias(c) for c in ("x", "y", "size")), F.array(*map(F.lit, color)).alias("color"), F.lit(1.0).alias("alpha"))
    red = shape(1, box(20.0, 10.0, size + 20, 130.0), (1.0, 0.0, 0.0))
    blue = shape(2, box((key % 7 + 40).cast("double"), 30.0, 150.0, size + 30), (0.0, 0.0, 1.0))
    drawn = overlay.render(parts.select(key, F.lit(blank).alias("data")), red.unionAll(blue), ["p_partkey"])
    return trim.trim_png(drawn, ["p_partkey"], cut=False, more=_shares, added="red long, blue long").select("p_partkey", "red", "blue", "x0", "y0", "x1", "y1")


@query("""
WITH m AS (SELECT p_partkey, 'P' || (p_partkey % 120) AS id, p_size * 3.0::DOUBLE AS x0, 100.0::DOUBLE + p_partkey % 50 AS y0, p_size * 3.0::DOUBLE + 20 + p_size AS x1, 100.0::DOUBLE + p_partkey % 50 + 4 + p_size % 30 AS y1 FROM part),
f AS (SELECT *, x0 - 2 AS fx0, y0 - 2 AS fy0, x1 + 2 AS fx1, y1 + 2 AS fy1, greatest(7.5 * 1.15, (y1 - y0 + 4) * 0.52) AS h FROM m),
b AS (SELECT *, greatest(h * 1.05, len(id) * h * 0.66) AS w FROM f), c AS (SELECT *, fx1 - w * 0.28 AS bx, fy0 - h * 0.34 AS by_, h * 0.5 AS s FROM b)
SELECT p_partkey, round(fx0 - 0.54, 4) AS frame_x0, round(fy1 + 0.54, 4) AS frame_y1, round(fx0 + 0.54, 4) AS hole_x0, round(bx, 4) AS badge_x0, round(by_, 4) AS badge_y0, round(bx + w, 4) AS badge_x1, round(by_ + h, 4) AS badge_y1,
  round((2 * bx + w - s * (len(id) - (1 - 4 / 6.0::DOUBLE))) / 2, 4) AS text_x, round((2 * by_ + h - s) / 2, 4) AS text_y, round(s, 4) AS text_size,
  round(x1 + 30 - 7.2, 4) AS line_end, round(200.0 - 0.9, 4) AS line_edge, CASE WHEN p_partkey % 2 = 0 THEN 8 ELSE 7 END AS shapes FROM c
""")
def overlay_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is drawn of a mark for each part on a picture of 800 x 600: its frame, badge and caption, and its line without the arrows."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("double")
    x0, y0 = size * 3, (key % 50).cast("double") + 100
    x1, y1 = x0 + 20 + size, y0 + 4 + F.col("p_size") % 30
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")  # drawing costs by shapes, however few bytes a part has
    marks = parts.select(
        "p_partkey", F.lit(1).alias("n"), F.concat(F.lit("P"), (key % 120).cast("string")).alias("mark_id"), F.when(key % 2 == 0, "span").otherwise("pointer").alias("kind"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"),
        x0.alias("ax"), F.lit(200.0).alias("ay"), (x1 + 30).alias("bx"), F.lit(200.0).alias("by"), F.lit(800).alias("width"), F.lit(600).alias("height"),
    )
    shapes = overlay.mark_shapes(marks, ["p_partkey"])
    part = lambda i, x: F.max(F.when(F.col("z") == 100 + i, x))
    at = lambda i, ring, k: F.round(part(i, F.col("contours")[ring][k]), 4)
    badge = [at(1, 0, k).alias(n) for k, n in ((0, "badge_x0"), (1, "badge_y0"), (4, "badge_x1"), (5, "badge_y1"))]
    caption = [F.round(part(2, F.col(c)), 4).alias(f"text_{c}") for c in ("x", "y", "size")]
    edge = F.round(part(3, F.array_min(F.transform(F.col("contours")[0], lambda v, i: F.when(i % 2 == 1, v)))), 4).alias("line_edge")
    end = F.round(part(3, F.array_max(F.transform(F.col("contours")[0], lambda v, i: F.when(i % 2 == 0, v)))), 4).alias("line_end")
    return shapes.groupBy("p_partkey").agg(at(0, 0, 0).alias("frame_x0"), at(0, 0, 5).alias("frame_y1"), at(0, 1, 0).alias("hole_x0"), *badge, *caption, end, edge, F.count("z").cast("int").alias("shapes"))


@query(f"""
WITH {EVENT}, r AS (SELECT event_id, w % 4 AS c, CAST(k AS DOUBLE) AS k FROM e),
t AS (SELECT *, CASE c WHEN 0 THEN k + 10 WHEN 1 THEN k + 30 WHEN 2 THEN k ELSE 30.0 END AS computed, CASE c WHEN 2 THEN 5.0 END AS claimed FROM r)
SELECT event_id, coalesce(claimed, CASE WHEN computed <> 0 THEN computed END) AS length_mm,
  CASE c WHEN 0 THEN printf('%g', k) || ' + 10 = ' || printf('%g', k + 10) WHEN 1 THEN printf('%g', k) || ' + 10 + 20 = ' || printf('%g', k + 30) WHEN 2 THEN printf('%g', k) || ' = ' || printf('%g', k) ELSE '20 + 10 = 30' END || ' мм' AS formula,
  CAST(CASE c WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS BIGINT) AS segments,
  CASE WHEN claimed IS NOT NULL AND computed <> 0 AND abs(claimed - computed) > 1 THEN 'расхождение ' || CAST(abs(claimed - computed) AS BIGINT) || ' мм' END AS status,
  CASE c WHEN 0 THEN 'исключено размеров: 1' WHEN 1 THEN 'в ответе есть метки размеров, которых нет на листе: P9' WHEN 2 THEN 'исключено размеров: 2' ELSE 'исключено размеров: 1' END
    || CASE WHEN claimed IS NOT NULL AND computed <> 0 AND abs(claimed - computed) > 1 THEN '; модель указала 5 мм, сумма участков ' || CAST(computed AS BIGINT) || ' мм' ELSE '' END AS notes FROM t
""")
def mark_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows of replies that select marks: some excluded, one that is not there, a total that differs, another order."""
    rows = _events(spark, sf_dir).withColumn("c", F.col("w") % 4)
    replies = ('{"included": ["P1", "P2"], "excluded": [{"index": "P3", "reason": "far"}]}', '{"included": ["P1", "P9"]}', '{"total_length_mm": 5, "included": ["P1"], "excluded": ["P2", "P3"]}', '{"included": ["P3", "P2"], "excluded": ["P1"]}')
    reply = F.when(F.col("c") == 0, replies[0]).when(F.col("c") == 1, replies[1]).when(F.col("c") == 2, replies[2]).otherwise(replies[3])
    marks = rows.select("event_id", F.posexplode(F.array(F.col("k").cast("double"), F.lit(10.0), F.lit(20.0))).alias("i", "value")).select("event_id", F.concat(F.lit("P"), (F.col("i") + 1).cast("string")).alias("mark_id"), "value", (F.col("i") + 1).alias("ord"))
    responses = rows.select("event_id", F.lit(None).cast("string").alias("error"), F.try_parse_json(reply).alias("response"))
    return selection.report(responses, marks, ["event_id"]).select("event_id", "length_mm", "formula", "segments", "status", "notes")


@query(f"""
WITH {M} SELECT l_orderkey AS page_number, l_quantity AS value, CASE l_returnflag WHEN 'N' THEN 'length' WHEN 'R' THEN 'value' ELSE 'total_length' END AS key, count(*) AS n FROM m GROUP BY ALL
""")
def walked_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of nested replies by the table function ``walk_reply`` in SQL; other keys of the replies are left out."""
    tables.register(spark)
    rows = _replies(spark, sf_dir).select(F.lit("d").alias("doc_id"), F.col("page_number").cast("int").alias("page_number"), "response")
    found = spark.sql("SELECT page_number, key, value FROM walk_reply(TABLE({rows})) WHERE key IN ('length', 'value', 'total_length')", rows=rows)
    return found.groupBy(F.col("page_number").cast("long").alias("page_number"), "value", "key").agg(F.count(F.lit(1)).alias("n"))
