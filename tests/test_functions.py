"""Column functions against Python."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import json, num, text


def column(spark, values, kind, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(make(F.col("v")).alias("o"), "i").orderBy("i").collect()]


def test_fmt_g(spark):
    values = [0.0, 1.0, 5563.0, 0.25, 1234567.0, 999999.5, 999999.4, 1e-5, 1e-4, -3.14159265, 1e20, 123456.7, 24100.0, 100000.0, 0.1 + 0.2, 1e-300, 2.5e15]
    assert column(spark, values, "double", num.fmt_g) == [f"{v:g}" for v in values]
    assert column(spark, [None, float("nan"), float("inf")], "double", num.fmt_g) == [None, "nan", "inf"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-10**9, 10**9).map(lambda n: n / 64), min_size=20, max_size=60))
def test_fmt_g_any(spark, values):
    assert column(spark, values, "double", num.fmt_g) == [f"{v:g}" for v in values]


def test_numbers(spark):
    labels = ["<9", "> 12,5", "320", "1.5", "a1", "1.", "", "٣"]
    assert column(spark, labels, "string", num.is_number_label) == [True, True, True, True, False, False, False, True]
    assert column(spark, labels[:4], "string", num.number_value) == [9.0, 12.5, 320.0, 1.5]
    assert column(spark, [24100.0, 0.25, 7.5], "double", num.written_forms) == [["24100", "24 100"], ["0.25", "0.2"], ["7.5"]]
    assert column(spark, [[1.0, 2.0, 3.0, 4.0], [5.0], []], "array<double>", num.upper_median) == [3.0, 5.0, None]


def test_text(spark):
    roles = {"X  48300": "coordinate", "Z+ 9695": "coordinate", "<9>": "node", "О3": "support", "DN50X50": "spec", "Лист 2": "title", "ЛИСТ 4": "title", "159": None, "12/3": "support", "СМ. 5": "coordinate", "50 mm PE": "spec", "N": "other"}
    assert column(spark, list(roles), "string", text.role_of_text) == list(roles.values())
    assert column(spark, ["A  b\tC "], "string", text.norm_key) == ["a b c"]
    assert column(spark, ["Ø5 × 3° Ж", "≤2…"], "string", text.plain_ascii) == ["D5 x 3 deg", "<=2..."]
    errors = {"429 Concurrent request limit reached for this API key": "retryable", "Service Unavailable": "retryable", "read timed out": "retryable", "Invalid API key": "fatal", "insufficient credit": "fatal", "model not found": "fatal", "json_schema unsupported": "no_schema", "?": "other"}
    assert column(spark, list(errors), "string", text.error_class) == list(errors.values())
    assert column(spark, ["a {{T}} b {{T}}", "none"], "string", lambda c: text.substitute(c, "T", F.lit("x"))) == ["a x b x", "none\n\nx"]
    assert column(spark, ["keep\n\n## Sizes\nbody"], "string", lambda c: text.strip_section(c, "Sizes")) == ["keep"]
    assert column(spark, [0.0, 3.0, 9.0], "double", text.backoff) == [1.0, 8.0, 30.0]


def test_reply_class(spark):
    df = spark.createDataFrame([("{}", "stop"), ("", "stop"), ("x", "stop"), ("{", "length")], "r string, f string")
    got = [r[0] for r in df.select(text.reply_class(F.col("r"), F.col("f"), json.parse(F.col("r")))).collect()]
    assert got == [None, "empty", "not_json", "truncated"]


def test_extract_json(spark):
    replies = ['{"a": 1}', 'so: {"a": 1} done', '```json\n{"a": 1}\n```', "```\n{bad\n``` {\"a\": 1}", "[1, 2] tail", "no"]
    got = column(spark, replies, "string", lambda c: F.to_json(json.extract_json(c)))
    assert got == ['{"a":1}', '{"a":1}', '{"a":1}', None, "[1,2]", None]


def test_references(spark):
    entries = ['"P1"', '{"index": "P2"}', '{"mark": 7}', '{"id": 7.0}', '" "', "7", '{"x": 1}', "null", '{"index": true, "label": " P3 "}']
    assert column(spark, entries, "string", lambda c: json.reference(json.parse(c))) == ["P1", "P2", "P7", "P7", None, None, None, None, "P3"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.floats(-50, 50)] * 6), min_size=5, max_size=20))
def test_point_segment(spark, rows):
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i int, px double, py double, ax double, ay double, bx double, by double")
    c = [F.col(x) for x in ("px", "py", "ax", "ay", "bx", "by")]
    for r in df.select("*", G.dist_point_segment(*c).alias("d"), G.fraction(*c).alias("t")).collect():
        steps = [(r.ax + (r.bx - r.ax) * k / 2000, r.ay + (r.by - r.ay) * k / 2000) for k in range(2001)]
        assert abs(min(math.hypot(r.px - x, r.py - y) for x, y in steps) - r.d) < 0.08
        assert 0 <= r.t <= 1


def test_axes_and_boxes(spark):
    assert column(spark, [0.0, 29.9, -29.8, 150.0, 179.0, 45.0, -180.0, 15.0], "double", G.axis_of) == [0, 1, 5, 5, 0, 2, 0, 0]
    df = spark.createDataFrame([(1.0, 2.0, 4.0, 3.0)], "a double, b double, c double, d double")
    box = [F.col(x) for x in "abcd"]
    r = df.select(F.array(*G.affine_box(box, F.lit(2.0), F.lit(1.0), F.lit(3.0))), F.array(*G.grow_small(box, 2.0)), G.to_unit(F.lit(72.0), "mm"), G.model_box(box, F.lit(3.0), F.lit(9.0)), G.zoom_for(F.lit(720.0), F.lit(1440.0), 144, 1000)).first()
    assert r[0] == [1.0, 1.0, 7.0, 3.0] and r[1] == [-1.0, 0.0, 7.0, 8.0] and r[2] == 25.4
    assert tuple(r[3]) == (1.0, 2.0, 3.0, 3.0) and r[4] == pytest.approx(1000 / 1440)
    square = [{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 0.0}, {"x": 2.0, "y": 2.0}, {"x": 0.0, "y": 2.0}]
    areas = spark.createDataFrame([(square,), (square[:2],)], "p array<struct<x:double,y:double>>").select(G.shoelace(F.col("p"))).collect()
    assert [a[0] for a in areas] == [4.0, 0.0]
