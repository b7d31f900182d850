"""Label resolution, report rows, costs and statistics on literal cases."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import cost, quality, selection
from plumbline.sources import labels, sinks

#: Ground truth of the ten sheets; fixed values.
TRUTH = {
    1: "320 200 900 2160 600 1383", 2: "730 1406 174 1900 150 10200 5644 1350 293 224", 3: "210 13 178 168 146 200 228 224 198 264 1250 950 2364",
    4: "250 214 159 214 155 504 378 159 81 81 171 159 154 380 159", 5: "285 651 850 450 2400 34 3505", 6: "285 651 850 2950 2400 34 3505", 7: "60 1950 34 650 840 522 250",
    8: "23525 1000 24100", 9: "195 123 244 123 175", 10: "154 244 341 220 188 134 2450 341 244 149 220 135 134 200",
}
SUMS = {1: 5563, 2: 22071, 3: 6393, 4: 3218, 5: 8175, 6: 10675, 7: 4306, 8: 48625, 9: 860, 10: 5154}


def resolved(spark, marks, response):
    m = spark.createDataFrame([(1, k, float(v), i) for i, (k, v) in enumerate(marks.items(), 1)], "page int, mark_id string, value double, ord int")
    r = spark.createDataFrame([(1, response)], "page int, response string").select("page", F.try_parse_json("response").alias("response"))
    return selection.resolve(selection.references(r, ["page"]), m, ["page"])


@pytest.mark.parametrize(
    "marks, response, total, unclassified, unresolved",
    [
        ({"P1": 154, "P2": 220, "P3": 2450}, '{"included": ["P1", "P2"]}', 2824, ["P3"], []),
        ({"P1": 154, "P2": 220, "P3": 2450}, '{"included": ["P1", "P2"], "excluded": [{"index": "P3"}]}', 374, [], []),
        ({"P1": 154, "P2": 220, "P3": 2450}, '{"included": ["P1"], "excluded": [{"mark": "P2"}]}', 2604, ["P3"], []),
        ({"P1": 100, "P2": 200}, '{"included": ["P1", "P1", "P99"]}', 300, ["P2"], ["P99"]),
        ({"P1": 1, "P2": 2}, '{"included": ["P1", "P99"], "excluded": ["P404"]}', 3, ["P2"], ["P404", "P99"]),
        ({"P1": 1}, '{"included": ["P1"], "excluded": ["P1"]}', 1, [], []),
    ],
)
def test_resolve(spark, marks, response, total, unclassified, unresolved):
    rows = resolved(spark, marks, response).collect()
    assert sorted(r.mark_id for r in rows if r.outcome == "unclassified") == unclassified
    assert sorted(r.mark_id for r in rows if r.outcome == "unresolved") == unresolved
    (s,) = selection.summarize(resolved(spark, marks, response), ["page"]).collect()
    assert s.length_mm == total and s.unresolved == unresolved


def test_mark_in_both_lists_is_listed_as_excluded(spark):
    (s,) = selection.summarize(resolved(spark, {"P1": 1}, '{"included": ["P1"], "excluded": ["P1"]}'), ["page"]).collect()
    assert (s.segments, s.excluded) == (1, 1)


@pytest.mark.parametrize("response", ['{"length": 100}', None, "not json"])
def test_not_about_marks(spark, response):
    assert resolved(spark, {"P1": 1}, response).count() == 0


def report(spark, rows, marks=()):
    r = spark.createDataFrame(rows, "page int, response string, error string").withColumn("response", F.try_parse_json("response"))
    m = spark.createDataFrame(list(marks), "page int, mark_id string, value double, ord int")
    return {x.page: x for x in selection.report(r, m, ["page"]).collect()}


def test_report_of_golden_sheets(spark):
    marks = [(p, f"P{i}", float(v), i) for p, vs in TRUTH.items() for i, v in enumerate(vs.split(), 1)]
    rows = [(p, '{"included": [], "notes": "ok"}', None) for p in TRUTH]
    got = report(spark, rows, marks)
    assert {p: r.length_mm for p, r in got.items()} == SUMS
    assert got[9].formula == "195 + 123 + 244 + 123 + 175 = 860 мм" and got[9].segments == 5 and got[9].length_m == 0.86
    assert got[1].length_m == 5.563 and got[1].notes == "ok"


def test_report_of_other_shapes(spark):
    rows = [
        (1, '{"segments": [{"length_mm": 100}, {"value": "20,5"}, {"label": "x"}], "line": "L1"}', None),
        (2, '{"branches": [{"parent_length": 300, "child_segments": [100, 200]}, {"parent_length": null}, {"parent_total": 50}]}', None),
        (3, '{"total_length_mm": 900, "segments": [{"length": 200}, {"length": 320}]}', None),
        (4, None, "429"),
        (5, '{"length": 0}', None),
        (6, '{"segments": [{"length": "n/a", "value": 5}, {"length": 7}], "notes": ["a", " ", "b"], "sheet": "12A"}', None),
        (7, '{"branches": [{"branch_id": "B1", "axis": "x", "parent_length": 10, "notes": " long "}, {"parent_length": 5, "notes": "n"}], "notes": "own"}', None),
        (8, '{"total_length_mm": "900,5", "page_number": 77, "segments": [{"length": 200}]}', None),
    ]
    got = report(spark, rows)
    assert got[1].length_mm == 120.5 and got[1].segments == 3 and got[1].notes == "участок 3: длина не определена" and got[1].line == "L1"
    assert got[2].length_mm == 350 and got[2].formula == "300 + 50 = 350 мм" and got[2].segments == 3 and got[2].length_m == 0.35
    assert got[3].status == "расхождение 380 мм" and got[3].notes == "модель указала 900 мм, сумма участков 520 мм" and got[3].formula == "200 + 320 = 520 мм" and got[3].length_mm == 900
    assert got[4].status == "ошибка" and got[4].notes == "429" and got[4].length_mm is None and got[4].sheet == "4"
    assert got[6].length_mm == 7 and got[6].notes == "a; b; участок 1: длина не определена" and got[6].sheet == "12A" and got[6].formula == "7 = 7 мм"
    assert got[7].notes == "own; B1 (x): long; ? (?): n" and got[7].formula == "10 + 5 = 15 мм"
    assert got[8].sheet == "8" and got[8].status == "расхождение 700 мм" and got[8].notes.startswith("модель указала 900.5 мм") and got[8].length_m == 0.9
    assert not got[5].length_mm


def tariff(spark, rows):
    return spark.createDataFrame(rows, "model string, input double, output double, reasoning double, cache_write double, cache_read double")


def costed(spark, call, prices):
    calls = spark.createDataFrame([call], "model string, prompt long, completion long, reasoning long, cache_write long, cache_read long")
    return cost.costs(calls, tariff(spark, prices)).first()


def test_costs(spark):
    luna = [("luna", 10.0, 50.0, 50.0, 12.5, 1.25)]
    r = costed(spark, ("luna", 2358, 27, 20, 2355, 0), luna)
    assert r.plain == 3 and r.cache_write_cost == pytest.approx(2355e-6 * 12.5)
    r = costed(spark, ("luna", 2358, 27, 20, 0, 2355), luna)
    assert r.plain == 3 and r.cache_read_cost == pytest.approx(2355e-6 * 1.25) and r.cache_write_cost == 0
    r = costed(spark, ("luna", 10**6, 1000, 400, 0, 0), luna)
    assert r.output_cost == pytest.approx(600 * 50e-6) and r.reasoning_cost == pytest.approx(400 * 50e-6)
    r = costed(spark, ("luna", 100, 100, 500, 100, 100), luna)
    assert min(r.input_cost, r.output_cost, r.reasoning_cost, r.cache_write_cost, r.cache_read_cost) >= 0 and r.billed_read == 0
    r = costed(spark, ("other", 100, 100, 0, 0, 0), luna)
    assert r.price_source == "unknown" and r.input_cost == 0
    r = costed(spark, ("other", 10**6, 0, 0, 0, 0), [*luna, ("default", 1.0, 4.0, 0.0, 0.0, 0.0)])
    assert r.price_source == "default" and r.input_cost == 1 and r.price_reasoning == 4
    r = costed(spark, ("luna", None, None, None, None, None), luna)
    assert r.input_cost == 0


def test_run_totals(spark):
    calls = spark.createDataFrame([("m", 30, 31765, 30618, 0, 0), ("x", 1, 1, 0, 0, 0)], "model string, prompt long, completion long, reasoning long, cache_write long, cache_read long")
    t = cost.usage_totals(cost.costs(calls, tariff(spark, [("m", 10.0, 50.0, 50.0, 12.5, 0.0)])))
    r = t.first()
    assert (r.reasoning_cost, r.output_cost, r.input_cost) == (pytest.approx(1.5309), pytest.approx(0.05735), pytest.approx(0.0003))
    assert not r.pricing_known and r.calls == 2
    pages = spark.createDataFrame([("r", 1, None, 4.0, True, 0.25, 3), ("r", 2, "e", 6.0, False, 1.0, 0), ("s", 1, None, 1.0, False, None, None)], "run string, page_number int, error string, elapsed double, trimmed boolean, area_ratio double, dimensions long")
    by = {r.run: r for r in cost.run_stats(pages, t.withColumn("run", F.lit("r")), ["run"]).collect()}
    s = by["r"]
    assert (s.pages, s.pages_ok, s.pages_failed, s.elapsed_per_page, s.calls_per_page, s.pages_trimmed, s.area_ratio_mean, s.dimensions_total) == (2, 1, 1, 5.0, 1.0, 1, 0.625, 3)
    assert (by["s"].calls_per_page, by["s"].area_ratio_mean, by["s"].total_cost) == (0.0, 1.0, 0.0)
    assert [(r.run, [tuple(e) for e in r.errors]) for r in cost.page_errors(pages, ["run"]).collect()] == [("r", [(2, "e")])]


def test_retries(spark):
    calls = spark.createDataFrame([("m", 1, None, False, 1), ("m", 1, "timeout", False, 3), ("m", 1, "not json", True, 2)], "model string, prompt long, retry_reason string, failed boolean, at int")
    for c in ("completion", "reasoning", "cache_write", "cache_read"):
        calls = calls.withColumn(c, F.lit(0))
    r = cost.usage_totals(cost.costs(calls, tariff(spark, [("m", 1.0, 1.0, 0.0, 0.0, 0.0), ("m", 1.0, 1.0, 0.0, 0.0, 0.0)]))).first()
    assert (r.calls, r.retries, r.failures, r.retry_reasons, r.pricing_known) == (3, 2, 1, ["not json", "timeout"], True)
    empty = cost.usage_totals(cost.costs(calls.limit(0), tariff(spark, []))).first()
    assert (empty.calls, empty.prompt_tokens, empty.pricing_known, empty.retry_reasons) == (0, 0, True, [])
    assert [cost.pricing_enabled(tariff(spark, rows)).first().enabled for rows in ([], [("a", 0.0, 0.0, None, 0.0, 0.0)], [("a", 0.0, 1.0, None, 0.0, 0.0)])] == [False, False, True]


def test_label_files(spark, tmp_path):
    for p, vs in TRUTH.items():
        body = "+".join(vs.split()) if p == 3 else "\n".join(vs.split())
        (tmp_path / f"list_{p:02}.txt").write_text(f"{body}\nитого - {SUMS[p]}\n", encoding="utf-8")
    (tmp_path / "list_11.txt").write_text("12\nabc\n", encoding="utf-8")
    values, totals, errors = labels.parse(labels.read(spark, str(tmp_path)))
    assert [(e.page_number, e.line) for e in errors.collect()] == [(11, "abc")]
    checked = {r.page_number: r for r in quality.check_totals(values, totals, ["page_number"]).collect()}
    assert all(checked[p].ok and checked[p].n == len(TRUTH[p].split()) for p in TRUTH) and not checked[11].ok


def test_compare_and_reachable(spark):
    found = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 7.0)], "page int, value double")
    truth = spark.createDataFrame([(1, 5.0), (1, 8.0)], "page int, value double")
    assert sorted(quality.compare(found, truth, ["page"]).collect()) == [(1, 5.0, "extra", 1), (1, 7.0, "extra", 1), (1, 8.0, "missing", 1)]
    targets = spark.createDataFrame([(1, 12.0), (2, 3.0)], "page int, target double")
    got = {r.page: r.subset for r in quality.reachable(found, targets, ["page"]).collect()}
    assert sorted(got[1]) == [5.0, 7.0] and got[2] is None
    assert quality.shortest_subset([6000, 6000, 6000, 4100, 24100], 24100) == [24100]
    assert quality.shortest_subset([1.0] * 25, 3) == [1.0, 1.0, 1.0] and quality.shortest_subset([], 1) is None


def test_csv(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a;b", None), (2, "ж", 1.5)], "sheet int, notes string, length double")
    assert sinks.csv_text(rows.orderBy("sheet"), ["sheet", "notes", "length"]) == '﻿sheet;notes;length\n1;"a;b";\n2;ж;1.5\n'.encode()
    sinks.write_csv(rows, str(tmp_path / "out"), ["sheet", "notes"])
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "out")).count() == 2
    assert sinks.write_xlsx(rows, rows, str(tmp_path / "x.xlsx")) in (None, str(tmp_path / "x.xlsx"))
    with pytest.raises(ValueError):
        sinks.csv_text(rows, ["sheet"], most=1)


def test_calls_stay_where_they_are(spark):
    """Tariffs go to the calls: a shuffle by model would gather all calls of one model in a task."""
    calls = spark.range(5).selectExpr("'m' as model", "id as prompt", "id as completion", "id as reasoning", "id as cache_write", "id as cache_read")
    plan = cost.with_pricing(calls, tariff(spark, [("m", 1.0, 1.0, 0.0, 0.0, 0.0)]))._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_marks_are_dealt_to_all_parts(spark):
    """Small packed parts are not put together to a few: what a task sorts and holds is many times as large."""
    rows = spark.range(400).select((F.col("id") % 200).alias("sheet"), F.concat(F.lit("P"), F.col("id").cast("string")).alias("ref"), "id")
    marks = rows.select("sheet", F.col("ref").alias("mark_id"), F.lit(1.0).alias("value"), F.col("id").alias("ord"))
    refs = rows.where("id < 200").select("sheet", F.lit("included").alias("list"), F.lit(0).alias("pos"), "ref", F.lit(None).cast("string").alias("reason"))
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        found = selection.resolve(refs, marks, ["sheet"])
        assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 12
        assert sorted((r.outcome, r["count"]) for r in found.groupBy("outcome").count().collect()) == [("included", 200), ("unclassified", 200)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
