"""Queries over replies made from the events and order lines: JSON, reports, regions, text, sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import json, layout, num, text
from plumbline.operators import annotate, cost, selection, sequence, spatial, textmap
from plumbline.plans.bridge import NUMBERED, ORDER
from plumbline.plans.registry import query
from plumbline.session import table
from plumbline.sources import exports, labels, schemas

EVENT = "e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 8 AS w FROM events)"
M = f"m AS ({NUMBERED})"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their number k and a kind w of reply."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), (F.col("event_id") % 8).alias("w"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence.numbered(table(spark, sf_dir, "lineitem"), ["l_orderkey"], list(map(F.col, ORDER)), "k")
    return rows.withColumn("k", F.col("k").cast("long")).withColumn("page_number", F.col("l_orderkey"))


def _case(options: list[Column]) -> Column:
    found = F.when(F.col("w") == 0, options[0])
    for i, x in enumerate(options[1:], 1):
        found = found.when(F.col("w") == i, x)
    return found


def _k(template: str) -> Column:
    return F.replace(F.lit(template), F.lit("#"), F.col("k").cast("string"))


@query(f"""
WITH {EVENT}
SELECT event_id, CASE w WHEN 0 THEN k WHEN 1 THEN k WHEN 2 THEN k WHEN 3 THEN k WHEN 6 THEN k END AS value FROM e
""")
def extracted_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON alone, in a fence, after words, in a named fence; a broken fence hides what follows, a broken text is nothing."""
    reply = _case([
        _k('{"v": #}'), _k('so:\n```\n{"v": #}\n```\nthat is all'), _k('The answer is {"v": #}, I think'), _k('```json\n {"v": #} ```'), _k('```json\n{"v": #\n``` {"v": #}'), _k('no json #'), _k(' \n{"v": #, "x": [1, {"y": null}]} '), _k('{"v": #'),
    ])
    return _events(spark, sf_dir).select("event_id", json.field(json.extract_json(reply), "v", "bigint").alias("value"))


@query(f"""
WITH {EVENT} SELECT event_id, CASE w WHEN 0 THEN 'truncated' WHEN 1 THEN 'empty' WHEN 2 THEN 'empty' WHEN 3 THEN 'not_json' WHEN 5 THEN 'schema' WHEN 6 THEN 'schema' WHEN 7 THEN 'truncated' END AS failure, CASE w WHEN 5 THEN '$: not object' WHEN 6 THEN '$.v: not number|$.y: unexpected' END AS problems FROM e
""")
def reply_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a reply can't be used, and where it departs from its schema."""
    reply = _case([_k('{"v": #}'), F.lit(""), F.lit(" \n"), _k("no #"), _k('{"v": #}'), F.lit("[]"), F.lit('{"v": "x", "y": 1}'), F.lit("")])
    rows = _events(spark, sf_dir).select("event_id", reply.alias("response"), F.when(F.col("w").isin(0, 7), "length").otherwise("stop").alias("finish"))
    rows = schemas.checked(rows, {"type": "object", "properties": {"v": {"type": "number"}}, "required": ["v"], "additionalProperties": False})
    failure = text.reply_class(F.col("response"), F.col("finish"), json.extract_json(F.col("response")), F.col("problems"))
    return rows.select("event_id", failure.alias("failure"), F.when(F.size("problems") > 0, F.array_join(F.sort_array("problems"), "|")).alias("problems"))


@query(f"""
WITH {EVENT} SELECT event_id, CASE w WHEN 0 THEN 'P' || k WHEN 1 THEN 'P' || k WHEN 2 THEN 'P' || k WHEN 3 THEN 'm' || k WHEN 5 THEN 'P' || k WHEN 6 THEN 'x' END AS ref, CASE w WHEN 1 THEN 'far' WHEN 2 THEN 'n' || k WHEN 0 THEN 'P' || k WHEN 4 THEN '' WHEN 6 THEN 'x' ELSE '' END AS reason FROM e
""")
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mark and the reason of entries of many shapes."""
    entry = _case([_k('"P#"'), _k('{"index": "P#", "reason": " far "}'), _k('{"index": "", "mark": "P#", "why": "n#"}'), _k('{"id": "m#", "reason": ""}'), F.lit("{}"), _k('{"label": null, "size": #}'), F.lit('" x "'), F.lit("null")])
    rows = _events(spark, sf_dir).select("event_id", F.try_parse_json(entry).alias("v"))
    return rows.select("event_id", json.reference(F.col("v")).alias("ref"), json.reason(F.col("v")).alias("reason"))


REPORTED = f"""{EVENT}
SELECT event_id, CASE w WHEN 0 THEN 'S' || k ELSE CAST(event_id AS VARCHAR) END AS sheet,
  CAST(CASE w WHEN 0 THEN 100.0 + k WHEN 1 THEN 0.5 + k WHEN 2 THEN 50.0 + k WHEN 3 THEN 900.0 WHEN 6 THEN 7.0 WHEN 7 THEN 2.0 * k END AS DOUBLE) AS length_mm,
  CASE w WHEN 0 THEN '100 + ' || k || ' = ' || (100 + k) || ' мм' WHEN 1 THEN printf('%g', k + 0.5) || ' = ' || printf('%g', k + 0.5) || ' мм' WHEN 2 THEN k || ' + 50 = ' || (50 + k) || ' мм' WHEN 3 THEN k || ' = ' || k || ' мм' WHEN 6 THEN '7 = 7 мм' WHEN 7 THEN 'own' END AS formula,
  CAST(CASE w WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 1 WHEN 6 THEN 2 WHEN 7 THEN 5 END AS BIGINT) AS segments,
  CASE w WHEN 0 THEN 'ok' WHEN 3 THEN CASE WHEN k > 0 THEN 'расхождение ' || (900 - k) || ' мм' END WHEN 4 THEN 'ошибка' END AS status,
  CASE w WHEN 1 THEN 'участок 2: длина не определена' WHEN 2 THEN 'a; b; B (?): far' WHEN 3 THEN CASE WHEN k > 0 THEN 'модель указала 900 мм, сумма участков ' || k || ' мм' ELSE '' END WHEN 4 THEN '429' WHEN 6 THEN 'участок 1: длина не определена' ELSE '' END AS notes FROM e"""


@query(f"WITH {REPORTED}")
def reply_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows of replies with segments, holes, branches, a wrong total, an error, nothing, a bad first length, own fields."""
    rows = _events(spark, sf_dir)
    reply = _case([
        _k('{"sheet": "S#", "status": "ok", "segments": [{"length_mm": 100}, {"value": "#"}]}'), _k('{"segments": [{"length": "#,5"}, {"label": "x"}]}'),
        _k('{"branches": [{"parent_length": #, "child_segments": [1]}, {"parent_length": null}, {"parent_total": 50, "branch_id": "B", "notes": " far "}], "notes": ["a", "", "b"]}'),
        _k('{"total_length_mm": 900, "segments": [{"length": #}]}'), F.lit(None).cast("string"), F.lit("{}"), F.lit('{"segments": [{"length": "n/a", "value": 5}, {"length": 7}]}'), F.concat(F.lit('{"length": '), (F.col("k") * 2).cast("string"), F.lit(', "formula": "own", "segments_count": 5, "page_number": 3}')),
    ])
    rows = rows.select("event_id", F.when(F.col("w") == 4, "429").alias("error"), F.try_parse_json(reply).alias("response"))
    none = rows.limit(0).select("event_id", F.lit("P1").alias("mark_id"), F.lit(1.0).alias("value"), F.lit(1).alias("ord"))
    return selection.report(rows, none, ["event_id"]).select("event_id", "sheet", "length_mm", "formula", "segments", "status", "notes")


CANDIDATES = f"""{M}, c AS (SELECT l_orderkey AS page_number, k, CASE l_returnflag WHEN 'N' THEN 'child' WHEN 'R' THEN 'excluded' ELSE 'parent' END AS role, l_quantity AS value, l_returnflag AS f FROM m),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_number ORDER BY k) - 1 AS INT) AS pos FROM c)"""


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reply for each order: an entry for each line, its key and container by its flag, with keys that are no lengths."""
    q = F.col("l_quantity").cast("string")
    entry = F.when(F.col("l_returnflag") == "N", F.concat(F.lit('{"kept": {"length": '), q, F.lit(', "index": 4, "x0": 1, "flag": true}}'))).when(
        F.col("l_returnflag") == "R", F.concat(F.lit('{"excluded": [{"value": '), q, F.lit(', "count": 2}], "verification": {"sum": 99}}'))).otherwise(F.concat(F.lit('{"total_length": '), q, F.lit(', "zero_length": 0, "list": [5]}')))
    rows = _rows(spark, sf_dir).select("page_number", "k", entry.alias("e"))
    return rows.groupBy("page_number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "e"))), lambda x: x.e), ",").alias("j")).select("page_number", F.concat(F.lit('{"things": ['), F.col("j"), F.lit("]}")).alias("response"))


@query(f"WITH {CANDIDATES} SELECT page_number, value, role, row_number() OVER (PARTITION BY page_number ORDER BY pos) AS n FROM p")
def reply_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of nested replies in order, with their role."""
    found = annotate.candidates(annotate.walk(_replies(spark, sf_dir), ["page_number"]))
    return sequence.numbered(found, ["page_number"], [F.col("pos")], "n").select("page_number", "value", "role", F.col("n").cast("long").alias("n"))


#: Labels on the sheet: every second line's value, at its number.
FOUND = f"""{CANDIDATES}, i AS (SELECT page_number, value, k, row_number() OVER (PARTITION BY page_number, value ORDER BY k) AS o, count(*) OVER (PARTITION BY page_number, value) AS c FROM p WHERE k % 2 = 0),
a AS (SELECT *, row_number() OVER (PARTITION BY page_number, value ORDER BY pos) AS o FROM p),
r AS (SELECT a.page_number, a.pos, a.value, a.role, coalesce(a.o > s.c, FALSE) AS duplicated, i.k IS NULL AS missing, CAST(i.k * 10 AS DOUBLE) AS x FROM a LEFT JOIN (SELECT page_number, value, max(c) AS c FROM i GROUP BY 1, 2) s ON s.page_number = a.page_number AND s.value = a.value
      LEFT JOIN i ON i.page_number = a.page_number AND i.value = a.value AND i.o = CASE WHEN a.o > s.c THEN 1 ELSE a.o END)"""


def _regions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _rows(spark, sf_dir)
    found = sequence.numbered(annotate.candidates(annotate.walk(_replies(spark, sf_dir), ["page_number"])).withColumnRenamed("pos", "at"), ["page_number"], [F.col("at")], "pos").withColumn("pos", F.col("pos") - 1)
    x = (F.col("k") * 10).cast("double")
    items = rows.where("k % 2 = 0").select("page_number", F.col("k").alias("n"), F.col("l_quantity").cast("bigint").cast("string").alias("text"), x.alias("x0"), F.lit(5.0).alias("y0"), (x + 8).alias("x1"), F.lit(9.0).alias("y1"))
    return annotate.text_regions(found, items, ["page_number"]), items


@query(f"WITH {FOUND} SELECT page_number, pos, value, role, duplicated, missing, x - 2 AS x0 FROM r")
def text_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate at its own occurrence on the sheet."""
    return _regions(spark, sf_dir)[0].select("page_number", "pos", "value", "role", "duplicated", "missing", "x0")


@query(f"""
WITH {FOUND}, s AS (SELECT page_number, count(*) AS total, count(*) FILTER (NOT missing) AS found, count(*) FILTER (missing) AS missing, count(*) FILTER (duplicated AND NOT missing) AS duplicated, count(*) FILTER (NOT missing AND role = 'excluded') AS excluded, coalesce(string_agg(printf('%g', value), ',' ORDER BY pos) FILTER (missing), '') AS missing_values FROM r GROUP BY 1)
SELECT page_number, total, found, missing, duplicated, excluded, missing_values, 'Лист ' || page_number || ' · размечено ' || found || ' из ' || total || CASE WHEN excluded > 0 THEN ' · исключено из расчёта: ' || excluded ELSE '' END || CASE WHEN duplicated > 0 THEN ' · повторов на листе не хватило: ' || duplicated ELSE '' END || CASE WHEN missing > 0 THEN ' · нет на листе: ' || missing ELSE '' END AS title FROM s
""")
def region_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = annotate.stats(_regions(spark, sf_dir)[0], ["page_number"]).withColumn("has_text", F.lit(True))
    rows = annotate.sheet_title(counted)
    return rows.select("page_number", "total", "found", "missing", "duplicated", "excluded", F.array_join("missing_values", ",").alias("missing_values"), "title")


@query(f"""
WITH {FOUND}, d AS (SELECT page_number, x, min(pos) AS pos, arg_max(role, pos) AS kind FROM r WHERE NOT missing GROUP BY 1, 2) SELECT page_number, pos, kind, 'pdf_text' AS origin, x - 2 AS x0 FROM d
UNION ALL SELECT page_number, 4, CASE page_number % 2 WHEN 0 THEN 'included' ELSE 'default' END, 'model', 10.0 + page_number % 7 FROM (SELECT page_number FROM c GROUP BY 1 HAVING max(k) = 1)
""")
def merged_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of one label drawn once, with the last role in the first place; the model's own boxes only where a sheet has no text."""
    found, items = _regions(spark, sf_dir)
    page = F.col("page_number")
    box = F.concat(F.lit('{"segs": [{"status": "'), F.when(page % 2 == 0, "included").otherwise("other"), F.lit('", "bbox": ['), (page % 7 + 10).cast("string"), F.lit(", 5, 60, 20]}]}"))
    replies = _rows(spark, sf_dir).select("page_number").distinct().select("page_number", box.alias("response"))
    sizes = replies.select("page_number", F.lit(90).alias("width"), F.lit(50).alias("height"))
    own = annotate.model_regions(annotate.walk(replies, ["page_number"]), sizes, ["page_number"])
    return annotate.regions(found, own, items, ["page_number"]).select("page_number", "pos", "kind", "origin", "x0")


@query(f"""
WITH {EVENT}, b AS (SELECT event_id, CASE w WHEN 0 THEN 10.0::DOUBLE WHEN 1 THEN 20.0::DOUBLE WHEN 2 THEN CAST(k AS DOUBLE) END AS x0, CASE w WHEN 0 THEN k + 20.0::DOUBLE WHEN 1 THEN 25.0::DOUBLE WHEN 2 THEN 120.0::DOUBLE END AS x1, CASE w WHEN 0 THEN 'included' WHEN 1 THEN 'excluded' WHEN 2 THEN 'default' END AS kind FROM e WHERE w < 3)
SELECT event_id, kind, x0, least(x1, 90.0) AS x1 FROM b WHERE least(x1, 90.0) - x0 >= 1
""")
def model_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's own boxes in three spellings, clipped to 90 x 50 pixels; of equal boxes the most telling."""
    wide = F.replace(F.lit('{"segs": [{"x0": 10, "y0": 4, "x1": "@", "y1": 9}, {"status": "included", "x0": 10, "y0": 4, "x1": @, "y1": 9}]}'), F.lit("@"), (F.col("k") + 20).cast("string"))
    reply = _case([wide, F.lit('{"excluded_items": [{"bbox": [25, 8, "20", 2]}]}'), _k('{"a": {"rect": {"left": #, "top": 1, "right": 120, "bottom": 30}}}'), *[F.lit("{}")] * 5])
    rows = _events(spark, sf_dir).select("event_id", reply.alias("response"))
    sizes = rows.select("event_id", F.lit(90).alias("width"), F.lit(50).alias("height"))
    return annotate.model_regions(annotate.walk(rows, ["event_id"]), sizes, ["event_id"]).select("event_id", "kind", "x0", "x1")


@query("""
WITH t AS (SELECT event_id, list_value('included', 'Main pipe', 'parent node', 'EXCLUDED', 'odd', '', 'warning!', 'failed')[event_id % 8 + 1] AS role, list_value('segments', 'branches', 'notes')[event_id % 3 + 1] AS ctx FROM events)
SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'green' WHEN 1 THEN 'green' WHEN 2 THEN 'blue' WHEN 3 THEN 'grey' WHEN 6 THEN 'orange' WHEN 7 THEN 'red' ELSE CASE event_id % 3 WHEN 1 THEN 'blue' WHEN 2 THEN 'violet' ELSE 'black' END END AS color FROM t
""")
def role_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % n + 1).cast("int"))
    role = pick(("included", "Main pipe", "parent node", "EXCLUDED", "odd", "", "warning!", "failed"), 8)
    return table(spark, sf_dir, "events").select("event_id", annotate.color_of(role, pick(("segments", "branches", "notes"), 3)).alias("color"))


@query(f"""
WITH {M}, l AS (SELECT l_orderkey AS page_number, k AS pos, l_partkey % 5 AS w, CAST(l_quantity AS BIGINT) AS q, l_suppkey AS s FROM m),
v AS (SELECT page_number, pos, q AS value FROM l WHERE w IN (0, 1) UNION ALL SELECT page_number, pos, s FROM l WHERE w = 1),
t AS (SELECT page_number, arg_max(q, pos) AS total FROM l WHERE w = 2 GROUP BY 1), x AS (SELECT page_number, count(*) AS errors FROM l WHERE w = 3 GROUP BY 1), y AS (SELECT page_number, count(*) AS n, CAST(sum(value) AS BIGINT) AS sum FROM v GROUP BY 1)
SELECT p.page_number, y.n, y.sum, t.total, x.errors FROM (SELECT DISTINCT page_number FROM l) p LEFT JOIN y ON y.page_number = p.page_number LEFT JOIN t ON t.page_number = p.page_number LEFT JOIN x ON x.page_number = p.page_number
""")
def truth_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of label files: a value, values joined by +, a total, an error, a blank."""
    rows, q, s = _rows(spark, sf_dir), F.col("l_quantity").cast("bigint").cast("string"), F.col("l_suppkey").cast("string")
    w = F.col("l_partkey") % 5
    line = F.when(w == 0, F.concat(F.lit(" "), q)).when(w == 1, F.concat(q, F.lit("+"), s)).when(w == 2, F.concat(F.lit("итого - "), q)).when(w == 3, F.concat(q, F.lit("x"))).otherwise("  ")
    lines = rows.select("page_number", F.col("k").alias("pos"), line.alias("line"))
    values, totals, errors = labels.parse(lines)
    sums = values.groupBy("page_number").agg(F.count("value").alias("n"), F.sum("value").alias("sum"))
    wrong = errors.groupBy("page_number").agg(F.count(F.lit(1)).alias("errors"))
    return rows.select("page_number").distinct().join(sums, "page_number", "left").join(totals, "page_number", "left").join(wrong, "page_number", "left")


@query(f"""
WITH {M}, a AS (SELECT DISTINCT l_orderkey AS page_number, l_quantity AS value FROM m WHERE l_returnflag = 'N'), b AS (SELECT DISTINCT l_orderkey AS page_number, l_quantity AS value FROM m WHERE l_returnflag = 'R')
SELECT *, 'extra' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'missing' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'both' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
""")
def set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of two lists of a sheet: only in one, only in the other, in both."""
    rows = _rows(spark, sf_dir)
    side = lambda f: rows.where(F.col("l_returnflag") == f).select("page_number", F.col("l_quantity").alias("value"))
    return sequence.set_diff(side("N"), side("R"))


@query(f"WITH {M} SELECT l_orderkey AS page_number, string_agg(DISTINCT printf('%g', l_quantity), ',' ORDER BY printf('%g', l_quantity)) AS scales, count(DISTINCT l_quantity) AS n FROM m GROUP BY 1")
def distinct_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.distinct_values(_rows(spark, sf_dir), ["page_number"], num.fmt_g(F.col("l_quantity"))).select("page_number", F.array_join("values", ",").alias("scales"), "n")


@query(f"""
WITH {EVENT} SELECT event_id, CASE WHEN w < 4 THEN 'A ' || k || ' and ' || k || ' end' ELSE 'head # none' || chr(10) || chr(10) || CAST(k AS VARCHAR) END AS filled, CASE WHEN w < 4 THEN 'A {{{{TEXT}}}} and {{{{TEXT}}}} end' ELSE 'head # none' END AS stripped,
  substring(repeat('ab', CAST(k AS INT)), 1, 11) AS clipped, least(power(2.0, w), 30.0) AS wait, CASE WHEN w % 2 = 0 THEN w = 0 ELSE TRUE END AS enabled, 'exp-' || k AS model FROM e
""")
def prompt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens filled or appended, sections stripped, texts cut, waits, switches, model names."""
    template = F.when(F.col("w") < 4, F.lit("A {{TEXT}} and {{TEXT}} end")).otherwise(F.lit("head # none"))
    sections = F.when(F.col("w") < 4, F.lit("A {{TEXT}} and {{TEXT}} end")).otherwise(F.lit("head # none\n\n## Dimensions of it\nmore\nand more"))
    k = F.col("k").cast("string")
    return _events(spark, sf_dir).select(
        "event_id", text.substitute(template, "TEXT", k).alias("filled"), text.strip_section(sections, "Dimensions").alias("stripped"), text.clip(F.repeat(F.lit("ab"), F.col("k").cast("int")), 11).alias("clipped"), text.backoff(F.col("w")).alias("wait"),
        layout.switched_on(F.when(F.col("w") % 2 == 0, F.col("w") == 0), True).alias("enabled"), layout.model_key(F.concat(F.lit(" EXP-"), k, F.lit(" "))).alias("model"),
    )


@query(f"""
WITH {M}, i AS (SELECT l_orderkey AS page_number, k, l_returnflag || k AS t, l_discount * 100 AS x0, l_quantity AS y0 FROM m WHERE l_partkey % 3 > 0)
SELECT o.l_orderkey AS page_number, '# Text layer of the sheet' || chr(10) || chr(10) || CASE WHEN count(i.k) = 0 THEN 'The text layer is empty: this is a scan.' ELSE 'Picture: 640x480 px.' || chr(10) || chr(10) || string_agg('"' || t || '" [' || CAST(round_even(x0, 0) AS BIGINT) || ',' || CAST(round_even(y0, 0) AS BIGINT) || ',' || CAST(round_even(x0 + 9, 0) AS BIGINT) || ',' || CAST(round_even(y0 + 4, 0) AS BIGINT) || ']', chr(10) ORDER BY i.k) END AS block
FROM (SELECT DISTINCT l_orderkey FROM m) o LEFT JOIN i ON i.page_number = o.l_orderkey GROUP BY 1
""")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt blocks of the text layer, with another text where a sheet has none."""
    rows, x, y = _rows(spark, sf_dir), F.col("l_discount") * 100, F.col("l_quantity")
    items = rows.where("l_partkey % 3 > 0").select("page_number", F.col("k").alias("n"), F.concat("l_returnflag", F.col("k").cast("string")).alias("text"), x.alias("x0"), y.alias("y0"), (x + 9).alias("x1"), (y + 4).alias("y1"))
    sheets = rows.select("page_number").distinct().select("page_number", F.lit(640).alias("width"), F.lit(480).alias("height"))
    return textmap.prompt_block(items, sheets, ["page_number"])


@query("""
SELECT doc_id, list_sum(list_transform(range(1, len(text) - 1), lambda i: CASE WHEN substring(lower(text), i, 3) = 'the' THEN 1 ELSE 0 END))::BIGINT AS hits FROM documents WHERE contains(lower(text), 'the')
""")
def needle_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a needle in whole texts, each a row with its box; counted by text."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(0.0).alias("x0"), F.length("text").cast("double").alias("x1"))
    return textmap.occurrences(lines, "THE").groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))


@query("""
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE list_aggregate(list_transform(string_split(text, chr(10)), lambda t: trim(t)), 'string_agg', chr(10)) END AS trimmed, regexp_matches(trim(text), '^[0-9.,]+$') AS is_number, len(text) AS n FROM documents
""")
def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block mode of page texts: every line trimmed, blank ones kept; and texts that are numbers."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    blocks = textmap.page_blocks(lines, ["doc_id"])
    return docs.join(blocks.withColumnRenamed("text", "trimmed"), "doc_id", "left").select("doc_id", "trimmed", textmap.is_numeric(F.trim("text")).alias("is_number"), F.length("text").cast("long").alias("n"))


@query("""
SELECT p_partkey, 640 AS width, 300 + CAST(p_size AS INT) AS height, CASE WHEN p_size % 2 = 0 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS area_ratio, 24 AS size_bytes, 'data:image/png;base64,' || to_base64(unhex('89504E470D0A1A0A0000000D4948445200000280' || printf('%08X', CASE WHEN p_partkey % 3 = 0 THEN 7 ELSE 300 + p_size END))) AS data_url FROM part
""")
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of a picture from its bytes, its cropped box and its overlay; the model sees the overlay of every third."""
    head = lambda height: F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D4948445200000280"), F.lpad(F.hex(height), 8, "0")))
    data, drawn = head(F.col("p_size") + 300), F.when(F.col("p_partkey") % 3 == 0, head(F.lit(7)))
    rows = table(spark, sf_dir, "part").select("p_partkey", data.alias("data"), drawn.alias("overlay"), F.when(F.col("p_size") % 2 > 0, F.array(*(F.lit(v) for v in (0, 0, 50, 50)))).alias("crop"), F.lit(100).alias("full_width"), F.lit(100).alias("full_height"))
    return layout.picture_facts(rows).select("p_partkey", "width", "height", "area_ratio", F.col("size_bytes").cast("int").alias("size_bytes"), "data_url")


@query("""
SELECT 'm' || s_suppkey AS model, s_suppkey % 3 > 0 OR s_suppkey % 5 = 0 AS enabled FROM supplier
""")
def priced_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any tariff of a model has a price; every model has two tariffs."""
    key = F.col("s_suppkey")
    models = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("m"), key.cast("string")).alias("model"))
    first = models.select("model", (key % 3).cast("double").alias("input"), *[F.lit(0.0).alias(p) for p in cost.PRICES[1:]])
    second = models.select("model", F.lit(0.0), *[F.lit(0.0) for _ in cost.PRICES[2:]], F.when(key % 5 == 0, 1.5).otherwise(0.0))
    return cost.pricing_enabled(first.unionAll(second), ["model"])


@query(f"""
WITH {M} SELECT l_orderkey AS page_number, CASE WHEN l_orderkey % 2 = 0 THEN 'Own words.' ELSE 'Проанализируй этот лист изометрического чертежа трубопровода и верни результат строго по схеме.' END || chr(10) || chr(10) || 'Лист № ' || l_orderkey || '. Размер изображения: ' || CAST(max(k) * 10 AS BIGINT) || 'x' || CAST(max(l_suppkey) AS BIGINT) || ' px.' AS instruction,
  '[{{"type":"text","text":"t"}},{{"type":"image_url","image_url":{{"url":"u' || l_orderkey || '"}}}}]' AS content FROM m GROUP BY 1
""")
def sheet_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes with the picture of a sheet, and the parts of a message."""
    sizes = _rows(spark, sf_dir).groupBy("page_number").agg((F.max("k") * 10).alias("width"), F.max("l_suppkey").alias("height"))
    page = F.col("page_number")
    own = F.when(page % 2 == 0, F.lit("Own words.")).otherwise("")
    return sizes.select("page_number", text.instruction(own, page, F.col("width"), F.col("height")).alias("instruction"), text.user_content(F.lit("t"), F.array(F.concat(F.lit("u"), page.cast("string")))).alias("content"))


@query(f"""
WITH {M}, p AS (SELECT l_orderkey AS run, k, '<"page_number":' || k || ',"error":' || CASE WHEN l_returnflag = 'R' THEN '"late"' ELSE 'null' END || ',"response":' || CASE WHEN l_returnflag = 'R' THEN 'null' ELSE '"' || l_suppkey || '"' END || '>' AS page FROM m)
SELECT o_orderkey AS run, replace(replace('<"experiment":"' || o_orderstatus || '","pages_total":' || o_custkey || ', "pages": [' || coalesce(string_agg(page, ', ' ORDER BY k), '') || ']>', '<', chr(123)), '>', chr(125)) AS document FROM orders LEFT JOIN p ON p.run = o_orderkey GROUP BY o_orderkey, o_orderstatus, o_custkey
""")
def run_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs (orders) as nested JSON with their pages (lines) in order; some have none."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("experiment"), F.col("o_custkey").alias("pages_total"))
    late = F.col("l_returnflag") == "R"
    reply = F.col("l_suppkey").cast("string")
    pages = _rows(spark, sf_dir).select(F.col("l_orderkey").alias("run"), F.col("k").alias("page_number"), F.when(late, "late").alias("error"), F.when(~late, reply).alias("response"))
    return exports.run_documents(runs, pages, ["run"])


@query(f"""
WITH {M}, s AS (SELECT l_orderkey AS sheet, k AS idx, CAST(l_discount * 1000 AS BIGINT) AS u, l_linenumber * 2 AS v, CAST(l_quantity AS BIGINT) AS len, l_quantity FROM m),
p AS (SELECT a.sheet, a.idx AS big, b.idx AS small FROM s a JOIN s b ON a.sheet = b.sheet AND a.idx <> b.idx WHERE b.len <= a.len AND abs(a.v - b.v) >= 1 AND b.u - a.u >= -1 AND b.u + b.len - a.u <= a.len + 1),
c AS (SELECT sheet, big, '"P' || string_agg(small, '","P' ORDER BY small) || '"' AS kids FROM p GROUP BY 1, 2 HAVING count(*) >= 2), r AS (SELECT p.sheet, p.small, max(p.big) AS parent FROM p JOIN c ON p.sheet = c.sheet AND p.big = c.big GROUP BY 1, 2),
j AS (SELECT s.sheet, string_agg('<"id":"P' || s.idx || '","kind":"span","label":"' || s.len || '","value":' || s.len || ',"parent":' || coalesce('"P' || r.parent || '"', 'null') || ',"children":[' || coalesce(c.kids, '') || ']>', ', ' ORDER BY s.idx) AS h FROM s LEFT JOIN c ON c.sheet = s.sheet AND c.big = s.idx LEFT JOIN r ON r.sheet = s.sheet AND r.small = s.idx GROUP BY 1),
n AS (SELECT sheet, string_agg('<"text":"' || len || '","bbox":[' || u || '.0,' || v || '.0,' || (u + 5) || '.5,' || (v + 2) || '.0]>', ', ' ORDER BY v, u, CAST(len AS VARCHAR)) AS a, string_agg('<"text":"' || len || '","bbox":[' || u || '.0,' || v || '.0,' || (u + 5) || '.5,' || (v + 2) || '.0]>', ', ' ORDER BY v, u, CAST(len AS VARCHAR)) FILTER (idx % 3 = 0) AS o FROM s GROUP BY 1)
SELECT j.sheet, replace(replace('<"hierarchy": [' || h || '], "numbers": [' || n.a || '], "orphans": [' || coalesce(n.o, '') || '], "stats": <"scale":' || j.sheet % 7 || '>>', '<', chr(123)), '>', chr(125)) AS document FROM j JOIN n ON n.sheet = j.sheet
""")
def detection_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets as nested JSON: lines with their family, numbers, every third without a line, and statistics."""
    rows, q = _rows(spark, sf_dir), F.col("l_quantity")
    x, y, size = F.rint(F.col("l_discount") * 1000), (F.col("l_linenumber") * 2).cast("double"), q.cast("bigint")
    lines = rows.select(F.col("l_orderkey").alias("sheet"), F.col("k").alias("idx"), F.lit("span").alias("kind"), size.cast("string").alias("label"), size.alias("value"), x.alias("ax"), y.alias("ay"), (x + q).alias("bx"), y.alias("by"), q.alias("length_pt"))
    numbers = lines.select("sheet", F.col("label").alias("text"), F.col("ax").alias("x0"), F.col("ay").alias("y0"), (F.col("ax") + 5.5).alias("x1"), (F.col("ay") + 2).alias("y1"), "idx")
    stats = lines.select("sheet").distinct().select("sheet", (F.col("sheet") % 7).alias("scale"))
    return exports.detection_documents(spatial.hierarchy(lines, ["sheet"]), numbers.drop("idx"), numbers.where("idx % 3 = 0").drop("idx"), stats, ["sheet"])
