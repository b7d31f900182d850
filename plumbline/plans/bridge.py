"""Queries over the driver's tables that exercise the library's operators.

These tables hold no drawings, so each query derives a small projection (marks,
boxes, angles, token counts) and applies an operator to it.  The same derivation
stands in the SQL.  Marks are numbered by a full ordering of lineitem, because
(l_orderkey, l_linenumber) is not unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geometry, json, layout, num, text
from plumbline.operators import cost, quality, selection, sequence, spatial, textmap
from plumbline.plans.registry import query
from plumbline.session import table

ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
NUMBERED = """SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem"""
#: %g of a double in DuckDB.
G = "printf('%g', {})"


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sheet, ord, mark_id, value, flag) of every line item."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *ORDER, "l_quantity", "l_returnflag")
    rows = sequence.numbered(rows, ["l_orderkey"], list(map(F.col, ORDER)), "ord")
    return rows.select(F.col("l_orderkey").alias("sheet"), "ord", F.concat(F.lit("P"), F.col("ord").cast("string")).alias("mark_id"), F.col("l_quantity").alias("value"), F.col("l_returnflag").alias("flag"))


def _refs(marks: DataFrame) -> DataFrame:
    """Replies: N is included, R excluded, A not mentioned; each also asks for an absent mark.

    Every third mark of N is named twice, every third of R is in both lists.
    """
    named = marks.where("flag <> 'A'").select("sheet", F.when(F.col("flag") == "N", "included").otherwise("excluded").alias("list"), F.col("ord").alias("pos"), F.col("mark_id").alias("ref"), F.lit("").alias("reason"))
    again = marks.where("flag <> 'A' and ord % 3 = 0").select("sheet", F.lit("included").alias("list"), (F.col("ord") + 100).alias("pos"), F.col("mark_id").alias("ref"), F.lit("").alias("reason"))
    absent = marks.groupBy("sheet").agg(F.max("ord").alias("n")).select("sheet", F.lit("included").alias("list"), (F.col("n") + 1).alias("pos"), F.concat(F.lit("P"), (F.col("n") + 1).cast("string")).alias("ref"), F.lit("").alias("reason"))
    return named.unionAll(again).unionAll(absent)


#: What a mark's flag and number make of it in these replies.
COUNTS, IN_REPLY = "(l_returnflag <> 'R' OR k % 3 = 0)", "CASE WHEN l_returnflag = 'R' THEN k + 100 ELSE k END"


@query(f"""
WITH m AS ({NUMBERED})
SELECT l_orderkey AS sheet, 'P' || k AS mark_id, l_quantity AS value,
       CASE WHEN l_returnflag = 'A' THEN 'unclassified' WHEN {COUNTS} THEN 'included' ELSE 'excluded' END AS outcome FROM m
UNION ALL SELECT l_orderkey, 'P' || (max(k) + 1), NULL, 'unresolved' FROM m GROUP BY l_orderkey
""")
def label_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = _marks(spark, sf_dir)
    return selection.resolve(_refs(marks), marks.drop("flag"), ["sheet"]).select("sheet", "mark_id", "value", "outcome")


@query(f"""
WITH m AS ({NUMBERED})
SELECT l_orderkey AS sheet, coalesce(sum(l_quantity) FILTER ({COUNTS}), 0.0) AS length_mm,
       round_even(coalesce(sum(l_quantity) FILTER ({COUNTS}), 0.0) / 1000, 3) AS length_m,
       count(*) FILTER ({COUNTS}) AS segments, count(*) FILTER (l_returnflag = 'R') AS excluded
FROM m GROUP BY l_orderkey
""")
def route_length_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = _marks(spark, sf_dir)
    rows = selection.summarize(selection.resolve(_refs(marks), marks.drop("flag"), ["sheet"]), ["sheet"])
    return rows.select("sheet", "length_mm", "length_m", "segments", "excluded")


@query(f"""
WITH m AS ({NUMBERED})
SELECT l_orderkey AS sheet,
       coalesce(string_agg({G.format('l_quantity')}, ' + ' ORDER BY l_returnflag = 'A', {IN_REPLY}, l_quantity) FILTER ({COUNTS}), '')
         || ' = ' || {G.format(f"coalesce(sum(l_quantity) FILTER ({COUNTS}), 0.0)")} || ' мм' AS formula
FROM m GROUP BY l_orderkey
""")
def route_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = _marks(spark, sf_dir)
    return selection.summarize(selection.resolve(_refs(marks), marks.drop("flag"), ["sheet"]), ["sheet"]).select("sheet", "formula")


@query(f"""
WITH m AS ({NUMBERED}) SELECT l_orderkey AS sheet, 'P' || (max(k) + 1) AS mark_id FROM m GROUP BY l_orderkey
""")
def unresolved_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = _marks(spark, sf_dir)
    return selection.resolve(_refs(marks), marks.drop("flag"), ["sheet"]).where("outcome = 'unresolved'").select("sheet", "mark_id")


@query("""
SELECT l_suppkey AS sheet, l_orderkey, l_linenumber, l_partkey,
       'P' || row_number() OVER (PARTITION BY l_suppkey ORDER BY round_even(l_extendedprice / 100 * 10, 0), l_discount, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS mark_id
FROM lineitem
""")
def reading_order_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    order = sequence.reading_order(F.col("l_extendedprice") / 100, F.col("l_discount"), *map(F.col, ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")))
    return sequence.numbered(rows, ["l_suppkey"], order, "mark_id", "P").select(F.col("l_suppkey").alias("sheet"), "l_orderkey", "l_linenumber", "l_partkey", "mark_id")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(round_even((((l_quantity * 7.5 - 180) % 180) + 180) % 180 / 30, 0) AS INT) % 6 AS INT) AS axis FROM lineitem
""")
def axis_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    angle = F.col("l_quantity") * 7.5 - 180
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", geometry.axis_of(angle).alias("axis"))


_LINES = "SELECT l_orderkey AS sheet, k AS idx, l_partkey % 2 = 1 AS up, CAST(l_discount * 1000 AS DOUBLE) AS u, CAST(l_linenumber * 2 AS DOUBLE) AS v, l_quantity AS len FROM m"
#: Lines along x, or along y where up holds, that run beside each other; and their families.
FAMILY = f"""s AS ({_LINES}),
p AS (SELECT a.sheet, a.idx AS big, b.idx AS small FROM s a JOIN s b ON a.sheet = b.sheet AND a.idx <> b.idx AND a.up = b.up
      WHERE a.len >= 1e-6 AND b.len <= a.len AND abs(a.v - b.v) >= 0.5 AND b.u - a.u >= -1 AND b.u + b.len - a.u <= a.len + 1),
c AS (SELECT sheet, big, count(*) AS children FROM p GROUP BY 1, 2 HAVING count(*) >= 2),
r AS (SELECT p.sheet, p.small, max(p.big) AS parent FROM p JOIN c ON p.sheet = c.sheet AND p.big = c.big GROUP BY 1, 2)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order, along x or along y; long enough that none is parallel to one of the other direction."""
    rows = sequence.numbered(table(spark, sf_dir, "lineitem"), ["l_orderkey"], list(map(F.col, ORDER)), "idx")
    u, v, up, size = F.col("l_discount") * 1000, (F.col("l_linenumber") * 2).cast("double"), F.col("l_partkey") % 2 == 1, F.col("l_quantity")
    x, y = F.when(up, v).otherwise(u), F.when(up, u).otherwise(v)
    return rows.select(F.col("l_orderkey").alias("sheet"), "idx", x.alias("ax"), y.alias("ay"), F.when(up, x).otherwise(x + size).alias("bx"), F.when(up, y + size).otherwise(y).alias("by"), size.alias("length_pt"), size.alias("value"))


@query(f"""
WITH m AS ({NUMBERED}), {FAMILY}
SELECT s.sheet, s.idx, coalesce(c.children, 0) AS children, r.parent FROM s
LEFT JOIN c ON s.sheet = c.sheet AND s.idx = c.big LEFT JOIN r ON s.sheet = r.sheet AND s.idx = r.small
""")
def interval_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.hierarchy(_lines(spark, sf_dir), ["sheet"]).select("sheet", F.col("idx").cast("long").alias("idx"), F.size("children").cast("long").alias("children"), F.col("parent").cast("long").alias("parent"))


@query(f"""
WITH m AS ({NUMBERED}), {FAMILY},
o AS (SELECT p.sheet, p.big, sum(b.len) AS kids, any_value(a.len) AS own FROM p JOIN c ON p.sheet = c.sheet AND p.big = c.big JOIN s a ON a.sheet = p.sheet AND a.idx = p.big JOIN s b ON b.sheet = p.sheet AND b.idx = p.small GROUP BY 1, 2),
q AS (SELECT sheet, count(*) AS overalls, count(*) FILTER (abs(own - kids) < 1) AS right_sums, sum(kids) AS children_sum FROM o GROUP BY 1)
SELECT s.sheet, sum(s.len) AS sum_all, sum(s.len) FILTER (r.parent IS NULL) AS sum_without_duplicates, count(*) AS lines, max(s.len) AS longest_pt,
  coalesce(any_value(q.overalls), 0) AS overalls, coalesce(any_value(q.right_sums), 0) AS right_sums, any_value(q.children_sum) AS children_sum
FROM s LEFT JOIN r ON s.sheet = r.sheet AND s.idx = r.small LEFT JOIN q ON q.sheet = s.sheet GROUP BY 1
""")
def chain_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.chain_total(spatial.hierarchy(_lines(spark, sf_dir), ["sheet"]), ["sheet"])
    all_ = F.coalesce("overalls", F.array().cast(found.schema["overalls"].dataType))
    return found.select(
        "sheet", "sum_all", "sum_without_duplicates", "lines", "longest_pt", F.size(all_).cast("long").alias("overalls"), F.size(F.filter(all_, lambda o: o.arithmetic_ok)).cast("long").alias("right_sums"),
        F.when(F.size(all_) > 0, F.aggregate(all_, F.lit(0.0), lambda t, o: t + o.children_sum)).alias("children_sum"),
    )


_BOXES = f"""n AS ({NUMBERED}),
p AS (SELECT l_orderkey AS cell, k AS p_partkey, l_discount * 100 AS x0, l_quantity AS y0, l_discount * 100 + 3.0 AS x1, l_quantity + 2.0 AS y1 FROM n WHERE l_partkey % 2 = 0),
s AS (SELECT l_orderkey AS cell, k AS s_suppkey, l_discount * 100 + 0.5 AS x0, l_quantity - 0.25 AS y0, l_discount * 100 + 3.2 AS x1, l_quantity + 2.5 AS y1 FROM n WHERE l_partkey % 2 = 1)"""


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels (p) and frames (s) of each order (cell), from its lines with even and odd parts."""
    rows = sequence.numbered(table(spark, sf_dir, "lineitem"), ["l_orderkey"], list(map(F.col, ORDER)), "k")
    x, y, cell = F.col("l_discount") * 100, F.col("l_quantity"), F.col("l_orderkey").alias("cell")
    p = rows.where("l_partkey % 2 = 0").select(F.col("k").cast("long").alias("p_partkey"), cell, x.alias("x0"), y.alias("y0"), (x + 3.0).alias("x1"), (y + 2.0).alias("y1"))
    s = rows.where("l_partkey % 2 = 1").select(F.col("k").cast("long").alias("s_suppkey"), cell, (x + 0.5).alias("x0"), (y - 0.25).alias("y0"), (x + 3.2).alias("x1"), (y + 2.5).alias("y1"))
    return p, s


@query(f"""
WITH {_BOXES}
SELECT cell, p_partkey FROM p WHERE EXISTS (SELECT 1 FROM s WHERE s.cell = p.cell AND abs(round_even(p.x0, 1) - s.x0) <= 1 AND abs(round_even(p.y0, 1) - s.y0) <= 1
  AND abs(round_even(p.x1, 1) - s.x1) <= 1 AND abs(round_even(p.y1, 1) - s.y1) <= 1)
""")
def band_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = _boxes(spark, sf_dir)
    return spatial.band_semi_join(p, s, ["cell"]).select("cell", "p_partkey")


@query(f"""
WITH {_BOXES}
SELECT p.cell, p.p_partkey, s.s_suppkey FROM p JOIN s ON s.cell = p.cell
WHERE (p.x0 + p.x1) / 2 >= s.x0 AND (p.x0 + p.x1) / 2 < s.x1 AND (p.y0 + p.y1) / 2 >= s.y0 AND (p.y0 + p.y1) / 2 < s.y1
""")
def point_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = _boxes(spark, sf_dir)
    points = p.select("p_partkey", "cell", ((F.col("x0") + F.col("x1")) / 2).alias("px"), ((F.col("y0") + F.col("y1")) / 2).alias("py"))
    return spatial.points_in_boxes(points, s, ["cell"]).select("cell", "p_partkey", "s_suppkey")


@query(f"""
WITH {_BOXES}, d AS (SELECT p.cell, p_partkey, s_suppkey, greatest(s.x0 - (p.x0 + p.x1) / 2, 0, (p.x0 + p.x1) / 2 - s.x1) AS dx,
  greatest(s.y0 - (p.y0 + p.y1) / 2, 0, (p.y0 + p.y1) / 2 - s.y1) AS dy FROM p JOIN s ON p.cell = s.cell)
SELECT p.cell, p.p_partkey, (SELECT s_suppkey FROM d WHERE d.cell = p.cell AND d.p_partkey = p.p_partkey AND dx * dx + dy * dy <= 25 ORDER BY dx * dx + dy * dy, s_suppkey LIMIT 1) AS s_suppkey FROM p
""")
def nearest_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = _boxes(spark, sf_dir)
    points = p.select("p_partkey", "cell", ((F.col("x0") + F.col("x1")) / 2).alias("px"), ((F.col("y0") + F.col("y1")) / 2).alias("py"))
    away = geometry.dist_point_box(F.col("px"), F.col("py"), *spatial.right())
    return spatial.nearest(points, s, ["cell"], "p_partkey", away, 5.0, "s_suppkey").select("cell", "p_partkey", "s_suppkey")


@query(f"""
WITH {_BOXES}
SELECT cell, p_partkey FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.cell = p.cell
  AND s.x0 + 0.3 < (p.x0 + p.x1) / 2 AND (p.x0 + p.x1) / 2 < s.x1 - 0.3 AND s.y0 + 0.3 < (p.y0 + p.y1) / 2 AND (p.y0 + p.y1) / 2 < s.y1 - 0.3
  AND p.x0 >= s.x0 - 1.2 AND p.y0 >= s.y0 - 1.2 AND p.x1 <= s.x1 + 1.2 AND p.y1 <= s.y1 + 1.2)
""")
def number_in_contour(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = _boxes(spark, sf_dir)
    return spatial.contained_anti_join(p, s, ["cell"], F.lit(1.2), F.lit(0.3)).select("cell", "p_partkey")


@query("""
WITH p AS (SELECT p_partkey, p_size % 5 AS cell, CAST(p_partkey % 997 AS DOUBLE) AS px, p_retailprice % 200 AS py FROM part), s AS (SELECT s_suppkey, s_nationkey % 5 AS cell, CAST(s_suppkey % 997 AS DOUBLE) AS x0, abs(s_acctbal) % 200 AS y0 FROM supplier)
SELECT p_partkey, s_suppkey FROM p JOIN s ON s.cell = p.cell WHERE px >= x0 AND px < x0 + 60 AND py >= y0 AND py < y0 + 15
""")
def crowded_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few sheets with very many items: cells join the key."""
    points = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 5).alias("cell"), (F.col("p_partkey") % 997).cast("double").alias("px"), (F.col("p_retailprice") % 200).alias("py"))
    x, y = (F.col("s_suppkey") % 997).cast("double"), F.abs("s_acctbal") % 200
    boxes = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("cell"), x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 15).alias("y1"))
    return spatial.grid_join(points, boxes, ["cell"], 20.0).select("p_partkey", "s_suppkey")


@query("""
SELECT o_custkey AS sheet, list_sort(list(o_totalprice))[len(list(o_totalprice)) // 2 + 1] AS scale, count(*) AS n FROM orders GROUP BY 1
""")
def upper_median_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sheet")).agg(num.upper_median(F.collect_list("o_totalprice")).alias("scale"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_suppkey AS sheet, width, n FROM (SELECT l_suppkey, l_quantity AS width, count(*) AS n,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_quantity) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1
""")
def mode_with_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sheet"), "l_quantity")
    return sequence.mode(rows, ["sheet"], F.bround("l_quantity", 2), "width")


@query("""
WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS c FROM events)
SELECT event_id, user_id FROM e WHERE c <= 3 OR r IN (0, CAST(floor(c / 3.0) AS BIGINT), CAST(floor(2 * c / 3.0) AS BIGINT))
""")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.systematic_sample(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")], 3).select("event_id", "user_id")


@query("""
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1
""")
def keep_first_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.keep_first(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("""
SELECT user_id, event_type, min(event_id) AS position, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2
""")
def last_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("position"), "value")
    return sequence.last_wins(rows, ["user_id", "event_type"], "position").select("user_id", "event_type", "position", "value")


#: Texts that meet each rule or just miss it; a number of the event follows some.
_TEXTS = (
    "<#>", "X +#", "О#", "к #", "#/#", "См. #", "12_34_ab", "DN # x #", "dn#", "sw-#", "Лист #", "страница", "Тестовое  задание #", "рвбл", "нипе", "С.", "N", "см.", "подключение", "АБ-#/1", "# mm", "Н.О. б", "од ", "ШТУРВАЛ", "#", "abc", "листва", "N#", "<#> x",
)
_B = "([^0-9A-Za-zÀ-ÿЀ-ӿ_]|$)"


@query(rf"""
WITH e AS (SELECT event_id, replace(list_value({', '.join(f"'{x}'" for x in _TEXTS)})[event_id % {len(_TEXTS)} + 1], '#', CAST(event_id % 900 AS VARCHAR)) AS s FROM events
  UNION ALL SELECT -doc_id - 1, text FROM documents),
t AS (SELECT event_id, trim(regexp_replace(s, '[ \t\n\x0B\f\r\x{{85}}\x{{A0}}]+', ' ', 'g')) AS s FROM e)
SELECT event_id, CASE WHEN regexp_matches(s, '^< ?[0-9]+ ?>$') THEN 'node' WHEN regexp_matches(s, '^[XYZxyz] ?[+±-]? ?[0-9]+') THEN 'coordinate' WHEN regexp_matches(s, '^[ОOoККk] ?[0-9]+') THEN 'support'
  WHEN regexp_matches(s, '^[0-9]+ ?/ ?[0-9]+$') THEN 'support' WHEN regexp_matches(s, '^[Сс][Мм]\.? ?[0-9]') THEN 'coordinate' WHEN regexp_matches(s, '^[0-9]{{2,4}}[_-][0-9]{{2,3}}[_-][0-9A-Za-zÀ-ÿЀ-ӿ_]+') THEN 'spec'
  WHEN regexp_matches(s, '^[Dd][Nn] ?[0-9]') THEN 'spec' WHEN regexp_matches(s, '^[SWsw]{{1,2}}[_-]?[0-9]') THEN 'title' WHEN regexp_matches(s, '^(?i:лист){_B}') OR regexp_matches(s, '^(?i:страница){_B}') THEN 'title'
  WHEN regexp_matches(s, '^(?i:тестовое ?задание)') THEN 'other' WHEN regexp_matches(s, '^(?i:рвбл){_B}') THEN 'support' WHEN regexp_matches(s, '^(?i:нипе){_B}') THEN 'other' WHEN regexp_matches(s, '^[Сс]\.?$') OR regexp_matches(s, '^[Nn]$') THEN 'other'
  WHEN regexp_matches(s, '^[Сс][Мм]\.? ?$') THEN 'coordinate' WHEN regexp_matches(s, '^(?i:подключение)') OR regexp_matches(s, '^[A-Za-zА-Яа-я]{{1,3}}-[0-9/]+$') THEN 'other' WHEN regexp_matches(s, '^[0-9]+ ?(?i:mm){_B}') THEN 'spec'
  WHEN regexp_matches(s, '^(Н\.)?[ОOo]\.? ?[А-Яа-яA-Za-z]') THEN 'other' WHEN regexp_matches(s, '^(?i:[однодна]{{1,2}} ?$)') OR regexp_matches(s, '^(?i:штурвал){_B}') THEN 'other' END AS role
FROM t
""")
def role_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.replace(F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("event_id") % len(_TEXTS) + 1).cast("int")), F.lit("#"), (F.col("event_id") % 900).cast("string"))
    events = table(spark, sf_dir, "events").select("event_id", made.alias("s"))
    docs = table(spark, sf_dir, "documents").select((-F.col("doc_id") - 1).alias("event_id"), F.col("text").alias("s"))
    return events.unionAll(docs).select("event_id", text.role_of_text(F.col("s")).alias("role"))


@query("""
SELECT p_partkey, lower(trim(regexp_replace(replace(upper(p_name) || chr(160) || '  ' || p_brand, chr(160), ' '), '\\s+', ' ', 'g'))) AS key FROM part
""")
def norm_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.concat(F.upper("p_name"), F.lit("   "), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", text.norm_key(written).alias("key"))


@query("""SELECT event_id, 'P' || json_extract_string(props, '$.k') AS ref FROM events""")
def json_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.replace(F.col("props"), F.lit('"k"'), F.lit('"index"'))
    return table(spark, sf_dir, "events").select("event_id", json.reference(F.try_parse_json(entry)).alias("ref"))


_CALLS = """c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_linenumber % 4 AS m, l_partkey * 10 AS prompt, l_suppkey * 3 AS completion,
  CAST(l_quantity AS BIGINT) * 2 AS reasoning, l_partkey * CAST(l_linenumber AS BIGINT) AS cache_write, l_partkey * 3 AS cache_read FROM lineitem),
t AS (SELECT c.*, least(reasoning, completion) AS r, least(cache_write, prompt) AS w FROM c),
u AS (SELECT t.*, least(cache_read, greatest(prompt - w, 0)) AS rd FROM t),
x AS (SELECT u.*, greatest(prompt - w - rd, 0) AS plain, completion - r AS visible FROM u)"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda c: F.col(c).cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("line"), F.concat(F.lit("m"), (F.col("l_linenumber") % 4).cast("string")).alias("model"), (q("l_partkey") * 10).alias("prompt"), (q("l_suppkey") * 3).alias("completion"),
        (q("l_quantity") * 2).alias("reasoning"), (q("l_partkey") * q("l_linenumber")).alias("cache_write"), (q("l_partkey") * 3).alias("cache_read"),
    )


def _tariffs(spark: SparkSession, default: bool) -> DataFrame:
    rows = [("m0", 10.0, 50.0, 50.0, 12.5, 1.25), ("m1", 2.0, 8.0, 0.0, 0.0, 1.0)] + [("default", 1.0, 4.0, 3.0, 0.0, 0.0)] * default
    return spark.createDataFrame(rows, "model string, input double, output double, reasoning double, cache_write double, cache_read double")


@query(f"""
WITH {_CALLS}
SELECT 'm' || m AS model, count(*) AS calls, CAST(sum(plain) AS BIGINT) AS plain, CAST(sum(visible) AS BIGINT) AS visible, CAST(sum(r) AS BIGINT) AS reasoning, CAST(sum(w) AS BIGINT) AS cache_write, CAST(sum(rd) AS BIGINT) AS cache_read,
  round(sum(plain) / 1e6 * (CASE m WHEN 0 THEN 10.0 WHEN 1 THEN 2.0 ELSE 0.0 END), 4) AS input_cost, round(sum(r) / 1e6 * (CASE m WHEN 0 THEN 50.0 WHEN 1 THEN 8.0 ELSE 0.0 END), 4) AS reasoning_cost
FROM x GROUP BY m
""")
def llm_cost_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cost.costs(_calls(spark, sf_dir), _tariffs(spark, False))
    sums = {"plain": "plain", "visible": "visible", "billed_reasoning": "reasoning", "billed_write": "cache_write", "billed_read": "cache_read"}
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(n) for c, n in sums.items()], F.round(F.sum("input_cost"), 4).alias("input_cost"), F.round(F.sum("reasoning_cost"), 4).alias("reasoning_cost"))


@query(f"""
WITH {_CALLS}
SELECT 'm' || m AS model, CASE WHEN m < 2 THEN 'model' ELSE 'default' END AS price_source, CASE m WHEN 0 THEN 50.0 WHEN 1 THEN 8.0 ELSE 3.0 END::DOUBLE AS price_reasoning, count(*) AS n
FROM x GROUP BY m
""")
def pricing_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cost.with_pricing(_calls(spark, sf_dir), _tariffs(spark, True))
    return rows.groupBy("model", "price_source", "price_reasoning").agg(F.count(F.lit(1)).alias("n"))


_PARTS = (*text.RETRYABLE, *text.FATAL, *text.NO_SCHEMA, "odd")
_ANY = lambda words: " OR ".join(f"contains(lower(s), '{w}')" for w in words)


@query(f"""
WITH e AS (SELECT event_id, p[event_id % len(p) + 1] || ' - ' || upper(p[event_id * 7 % len(p) + 1]) || CASE WHEN event_id % 3 = 0 THEN '' ELSE ' ' || event_type END AS s FROM (SELECT *, list_value({', '.join(f"'{x}'" for x in _PARTS)}) AS p FROM events))
SELECT event_id, CASE WHEN {_ANY(text.RETRYABLE)} THEN 'retryable' WHEN {_ANY(text.FATAL)} THEN 'fatal' WHEN {_ANY(text.NO_SCHEMA)} THEN 'no_schema' ELSE 'other' END AS class FROM e
""")
def retry_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of two parts each, all fixed parts among them; which part comes first does not matter."""
    part = lambda at: F.element_at(F.array(*map(F.lit, _PARTS)), (at % len(_PARTS) + 1).cast("int"))
    key = F.col("event_id")
    message = F.concat(part(key), F.lit(" - "), F.upper(part(key * 7)), F.when(key % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.col("event_type"))))
    return table(spark, sf_dir, "events").select("event_id", text.error_class(message).alias("class"))


@query("""
WITH a AS (SELECT *, l_quantity % 2 AS v, row_number() OVER (PARTITION BY l_partkey, l_quantity % 2 ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS k FROM lineitem WHERE l_returnflag <> 'A'),
b AS (SELECT l_partkey, l_quantity % 2 AS v, l_extendedprice AS price, row_number() OVER (PARTITION BY l_partkey, l_quantity % 2 ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS k, count(*) OVER (PARTITION BY l_partkey, l_quantity % 2) AS c FROM lineitem WHERE l_returnflag = 'A')
SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, b.price, coalesce(a.k > s.c, FALSE) AS duplicated FROM a
LEFT JOIN (SELECT l_partkey, v, max(c) AS c FROM b GROUP BY 1, 2) s ON s.v = a.v AND s.l_partkey = a.l_partkey LEFT JOIN b ON b.v = a.v AND b.l_partkey = a.l_partkey AND b.k = CASE WHEN a.k > s.c THEN 1 ELSE a.k END
""")
def nth_occurrence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for a value of a part's sheet take its occurrences in turn."""
    rows = table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_quantity") % 2)
    asked = rows.where("l_returnflag <> 'A'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "v")
    pool = rows.where("l_returnflag = 'A'").select("l_partkey", "v", F.col("l_extendedprice").alias("price"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"))
    found = sequence.nth_match(asked, pool, ["l_partkey", "v"], list(map(F.col, ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"))), list(map(F.col, ("price", "o", "n"))))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price", "duplicated")


@query("""
SELECT v, 'extra' AS side FROM (SELECT l_quantity AS v FROM lineitem WHERE l_returnflag = 'N' EXCEPT ALL SELECT l_quantity FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT v, 'missing' FROM (SELECT l_quantity AS v FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_quantity FROM lineitem WHERE l_returnflag = 'N')
""")
def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    side = lambda f: rows.where(F.col("l_returnflag") == f).select(F.col("l_quantity").alias("v"))
    return sequence.multiset_diff(side("N"), side("R"))


@query(f"""SELECT p_partkey, {G.format('p_retailprice')} AS a, {G.format('p_retailprice * 1000')} AS b, {G.format('p_retailprice / 1e8')} AS c FROM part""")
def number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", num.fmt_g(x).alias("a"), num.fmt_g(x * 1000).alias("b"), num.fmt_g(x / 1e8).alias("c"))


@query("""
SELECT o_orderkey, TRY_CAST(replace(replace(ltrim(CASE o_orderkey % 3 WHEN 0 THEN '< ' WHEN 1 THEN '>' ELSE '' END || o_totalprice, '<>'), ',', '.'), ' ', '') AS DOUBLE) AS value,
  regexp_matches(CASE o_orderkey % 3 WHEN 0 THEN '< ' WHEN 1 THEN '>' ELSE '' END || CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR), '^[<>]?\\s*[0-9]+([.,][0-9]+)?$') AS is_label FROM orders
""")
def number_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("o_orderkey") % 3 == 0, "< ").when(F.col("o_orderkey") % 3 == 1, ">").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", num.number_value(F.concat(sign, F.col("o_totalprice").cast("string"))).alias("value"), num.is_number_label(F.concat(sign, F.round("o_totalprice", 0).cast("bigint").cast("string"))).alias("is_label"))


@query("""
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'A-' || o_orderkey WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 50 AS VARCHAR) END AS sheet FROM orders)
SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN TRY_CAST(sheet AS DOUBLE) IS NOT NULL THEN 0 WHEN sheet IS NOT NULL THEN 1 ELSE 2 END, TRY_CAST(sheet AS DOUBLE) NULLS FIRST, o_orderkey) - 1 AS pos FROM t
""")
def sheet_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every report row in sheet order."""
    sheet = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("A-"), F.col("o_orderkey").cast("string"))).when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 50).cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", sheet.alias("sheet"))
    return sequence.placed(rows, sequence.sheet_order(F.col("sheet"), F.col("o_orderkey")), "pos").select("o_orderkey", "pos")


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS px, l_discount * 500 AS py, l_tax * 300 AS ax, 5.0 AS ay, l_quantity + 3 AS bx, 25.0 AS by_ FROM lineitem),
f AS (SELECT *, least(1.0, greatest(0.0, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt((px - ax - t * (bx - ax)) ** 2 + (py - ay - t * (by_ - ay)) ** 2), 6) AS distance, round(t, 6) AS along FROM f
""")
def segment_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    s = [q, F.col("l_discount") * 500, F.col("l_tax") * 300, F.lit(5.0), q + 3, F.lit(25.0)]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(geometry.dist_point_segment(*s), 6).alias("distance"), F.round(geometry.fraction(*s), 6).alias("along"))


@query(f"""
WITH {_CALLS}, y AS (SELECT l_orderkey % 100 AS run, count(*) AS calls, CAST(sum(prompt) AS BIGINT) AS prompt_tokens, CAST(sum(visible) AS BIGINT) AS visible_tokens, count(*) FILTER (l_linenumber % 3 = 0) AS retries,
  sum(plain / 1e6 * (CASE m WHEN 0 THEN 10.0 WHEN 1 THEN 2.0 ELSE 0.0 END) + visible / 1e6 * (CASE m WHEN 0 THEN 50.0 WHEN 1 THEN 8.0 ELSE 0.0 END) + r / 1e6 * (CASE m WHEN 0 THEN 50.0 WHEN 1 THEN 8.0 ELSE 0.0 END)
    + w / 1e6 * (CASE m WHEN 0 THEN 12.5 ELSE 0.0 END) + rd / 1e6 * (CASE m WHEN 0 THEN 1.25 WHEN 1 THEN 1.0 ELSE 0.0 END)) AS cost, bool_and(m < 2) AS pricing_known FROM x GROUP BY 1),
p AS (SELECT o_orderkey % 100 AS run, count(*) AS pages, count(*) FILTER (o_orderkey % 11 = 0) AS pages_failed, sum(floor(o_totalprice)) AS elapsed, count(*) FILTER (o_custkey % 2 = 0) AS pages_trimmed, avg(CAST(o_custkey % 10 AS DOUBLE)) AS area, CAST(sum(o_custkey) AS BIGINT) AS dims FROM orders GROUP BY 1)
SELECT p.run, pages, pages_failed, pages - pages_failed AS pages_ok, round_even(elapsed / pages, 2) AS elapsed_per_page, pages_trimmed, round_even(area, 4) AS area_ratio_mean, dims AS dimensions_total, calls, prompt_tokens, visible_tokens, retries, pricing_known,
  round_even(coalesce(calls, 0) / pages, 2) AS calls_per_page, round(coalesce(cost, 0), 3) AS total_cost FROM p LEFT JOIN y ON y.run = p.run
""")
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of pages (orders) and calls (lines): usage summed, then the statistics of each run."""
    calls = _calls(spark, sf_dir).withColumn("run", F.col("l_orderkey") % 100)
    calls = calls.withColumn("retry_reason", F.when(F.col("line") % 3 == 0, "timeout")).withColumn("failed", F.lit(False)).withColumn("at", F.col("line"))
    totals = cost.usage_totals(cost.costs(calls, _tariffs(spark, False)), ["run"])
    pages = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 100).alias("run"), F.when(F.col("o_orderkey") % 11 == 0, "failed").alias("error"), F.floor("o_totalprice").cast("double").alias("elapsed"), (F.col("o_custkey") % 2 == 0).alias("trimmed"), (F.col("o_custkey") % 10).cast("double").alias("area_ratio"), F.col("o_custkey").alias("dimensions"))
    rows = cost.run_stats(pages, totals, ["run"])
    return rows.select(
        "run", "pages", "pages_failed", "pages_ok", "elapsed_per_page", "pages_trimmed", "area_ratio_mean", "dimensions_total", "calls", "prompt_tokens", "visible_tokens", "retries", "pricing_known",
        "calls_per_page", F.round("total_cost", 3).alias("total_cost"),
    )


@query("""SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'the') AND contains(text, '@')""")
def find_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return textmap.find(textmap.find(docs, "THE"), "@", case_sensitive=True).select("doc_id", "lang")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT doc_id, string_agg(trim(line), chr(10) ORDER BY n) AS text FROM l WHERE trim(line) <> '' GROUP BY 1
""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return textmap.page_text(lines, ["doc_id"])


@query("""
SELECT o_orderkey, o_orderstatus || '_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') AS folder, 'page_' || printf('%02d', o_orderkey % 150) || '.png' AS image FROM orders
""")
def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", layout.run_folder(F.col("o_orderstatus"), F.col("o_orderdate")).alias("folder"), layout.image_name(F.lit("page"), F.col("o_orderkey") % 150).alias("image"))


_PIXELS = "SELECT p_partkey, p_size * 20.0 AS a, p_retailprice / 2 AS b, p_size * 20.0 + p_partkey % 300 - 100 AS c, p_retailprice / 2 - 40 AS d FROM part"


@query(f"""
WITH p AS ({_PIXELS}), q AS (SELECT p_partkey, CAST(greatest(least(a * 0.8, c * 0.8), 0) AS DOUBLE) AS x0, CAST(least(greatest(a * 0.8, c * 0.8), 800.0) AS DOUBLE) AS x1, greatest(least(b * 0.5, d * 0.5), 0) AS y0, least(greatest(b * 0.5, d * 0.5), 500.0) AS y1 FROM p)
SELECT p_partkey, x0, y0, x1, y1 FROM q WHERE x1 - x0 >= 1 AND y1 - y0 >= 1
""")
def model_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, price = F.col("p_size") * 20.0, F.col("p_retailprice") / 2
    box = [size, price, size + F.col("p_partkey") % 300 - 100, price - 40]
    rows = table(spark, sf_dir, "part").select("p_partkey", geometry.model_box(box, F.lit(800.0), F.lit(500.0), "norm1000").alias("b"))
    return rows.where("b is not null").select("p_partkey", "b.*")


@query(f"""
WITH p AS ({_PIXELS}), t AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 5.0 ELSE a END AS x0, b AS y0, CASE p_partkey % 3 WHEN 0 THEN 990.0 ELSE a + 30 END AS x1, b + 12 AS y1, CASE WHEN p_partkey % 2 = 0 THEN 480.0 ELSE 3000.0 END AS h FROM p)
SELECT p_partkey, round(CASE side WHEN 'left' THEN x0 - 15 WHEN 'above' THEN x0 WHEN 'below' THEN x0 WHEN 'right' THEN x1 + 2 ELSE greatest(x1 + 2, 0) END, 6) AS cx0, round(CASE side WHEN 'above' THEN y0 - 16.5 WHEN 'below' THEN y1 + 2 WHEN 'clipped' THEN greatest(y0, 0) ELSE y0 END, 6) AS cy0,
  round(CASE side WHEN 'left' THEN x0 - 2 WHEN 'above' THEN x0 + 13 WHEN 'below' THEN x0 + 13 WHEN 'right' THEN x1 + 15 ELSE least(x1 + 15, 1000) END, 6) AS cx1, round(CASE side WHEN 'above' THEN y0 - 2 WHEN 'below' THEN y1 + 16.5 WHEN 'clipped' THEN least(y0 + 14.5, h) ELSE y0 + 14.5 END, 6) AS cy1
FROM (SELECT *, CASE WHEN x1 + 15 <= 1000 AND y0 >= 0 AND y0 + 14.5 <= h THEN 'right' WHEN x0 - 15 >= 0 AND y0 + 14.5 <= h THEN 'left' WHEN y0 - 16.5 >= 0 AND x0 + 13 <= 1000 AND y0 - 2 <= h THEN 'above' WHEN y1 + 16.5 <= h AND x0 + 13 <= 1000 THEN 'below' ELSE 'clipped' END AS side FROM t)
""")
def chip_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.col("p_partkey") % 3 == 0
    size, price = F.col("p_size") * 20.0, F.col("p_retailprice") / 2
    x0, x1, y1 = F.when(wide, 5.0).otherwise(size), F.when(wide, 990.0).otherwise(size + 30), price + 12
    height = F.when(F.col("p_partkey") % 2 == 0, 480.0).otherwise(3000.0)
    place = layout.chip([x0, price, x1, y1], 10.0, F.lit(1000.0), height)
    return table(spark, sf_dir, "part").select("p_partkey", *(F.round(place[c], 6).alias(f"c{c}") for c in ("x0", "y0", "x1", "y1")))


@query("""
WITH v AS (SELECT l_suppkey AS sheet, sum(l_quantity) AS s, count(l_quantity) AS n FROM lineitem GROUP BY 1), t AS (SELECT s_suppkey AS sheet, CAST(s_suppkey * 100 AS DOUBLE) AS total FROM supplier)
SELECT coalesce(v.sheet, t.sheet) AS sheet, s AS sum, n, total, coalesce(abs(s - total) <= 0.5, FALSE) AS ok FROM v FULL JOIN t ON v.sheet = t.sheet
""")
def truth_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sheet"), F.col("l_quantity").alias("value"))
    totals = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sheet"), (F.col("s_suppkey") * 100).cast("double").alias("total"))
    return quality.check_totals(values, totals, ["sheet"])


@query("""
SELECT l_suppkey AS sheet, l_quantity AS value, side, count(*) AS n FROM (
  SELECT *, 'extra' AS side FROM (SELECT l_suppkey, l_quantity FROM lineitem WHERE l_linestatus = 'O' EXCEPT ALL SELECT l_suppkey, l_quantity FROM lineitem WHERE l_linestatus = 'F')
  UNION ALL SELECT *, 'missing' FROM (SELECT l_suppkey, l_quantity FROM lineitem WHERE l_linestatus = 'F' EXCEPT ALL SELECT l_suppkey, l_quantity FROM lineitem WHERE l_linestatus = 'O'))
GROUP BY 1, 2, 3
""")
def truth_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    side = lambda f: rows.where(F.col("l_linestatus") == f).select(F.col("l_suppkey").alias("sheet"), F.col("l_quantity").alias("value"))
    return quality.compare(side("O"), side("F"), ["sheet"])


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) WHEN 1 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) + 0.5 WHEN 4 THEN 7.0 END AS length FROM events
""")
def reply_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first length field that a segment has: a number, text with a comma, what is no number, none, or one after a null."""
    k, which = F.get_json_object("props", "$.k"), F.col("event_id") % 5
    reply = (
        F.when(which == 0, F.concat(F.lit('{"value": '), k, F.lit("}"))).when(which == 1, F.concat(F.lit('{"length": "'), k, F.lit(',5"}')))
        .when(which == 2, F.concat(F.lit('{"length": "n/a", "value": '), k, F.lit("}"))).when(which == 3, F.lit('{"label": "x"}')).otherwise(F.lit('{"length_mm": null, "length": 7, "value": 9}'))
    )
    return table(spark, sf_dir, "events").select("event_id", json.as_length(json.first_present(F.try_parse_json(reply), selection.LENGTHS)).alias("length"))


@query("""
SELECT p_partkey, CAST(ceil(sqrt((p_size * 8.0) ** 2 + (p_retailprice / 10) ** 2) / 50) AS BIGINT) AS ring, abs(sin(radians(degrees(atan2(p_retailprice / 10, p_size * 8.0))))) > 0.5 AS rotated FROM part
""")
def line_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, zero = F.col("p_size") * 8.0, F.col("p_retailprice") / 10, F.lit(0.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.ceil(geometry.dist(zero, zero, x, y) / 50).alias("ring"), geometry.is_rotated(geometry.angle(zero, zero, x, y)).alias("rotated"))
