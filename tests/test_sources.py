"""Schemas, experiments, adapters and streaming."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources import adapters, experiments, schemas, sinks
from plumbline.streaming import sheets

MARKS = {
    "type": "object", "required": ["included"], "additionalProperties": False,
    "properties": {"included": {"type": "array", "items": {"type": "string"}}, "notes": {"type": ["string", "null"]}, "n": {"anyOf": [{"type": "integer"}, {"type": "number"}]}, "tree": {"$ref": "#/$defs/node"}, "kind": {"enum": ["a", "b"]}, "any": {}},
    "$defs": {"node": {"type": "object", "properties": {"kids": {"type": "array", "items": {"$ref": "#/$defs/node"}}, "x": {"oneOf": [{"type": "string"}, {"type": "number"}]}}}},
}


def test_spark_types():
    t = schemas.spark_type(MARKS)
    kinds = {f.name: f.dataType for f in t.fields}
    assert kinds["included"] == T.ArrayType(T.StringType()) and kinds["notes"] == T.StringType() and kinds["n"] == T.DoubleType() and kinds["kind"] == T.StringType()
    assert kinds["tree"]["kids"].dataType == T.ArrayType(T.VariantType()) and kinds["tree"]["x"].dataType == kinds["any"] == T.VariantType()
    for bad in ({"type": "array"}, {"$ref": "x.json"}, {"$ref": "#/$defs/none"}, {"type": "date"}, {"anyOf": []}, {"enum": [1, 1]}):
        with pytest.raises(schemas.SchemaError):
            schemas.spark_type(bad)
    assert schemas.unwrap({"schema": MARKS}) is MARKS
    strict = schemas.strict(MARKS)
    assert strict["required"] == list(MARKS["properties"]) and strict["$defs"]["node"]["additionalProperties"] is False


def test_problems():
    assert schemas.problems({"included": ["P1"], "notes": None, "kind": "a"}, MARKS) == []
    found = schemas.problems({"included": [1], "extra": 1, "kind": "c", "n": "x"}, MARKS)
    assert {f.split(":")[0] for f in found} == {"$.included[0]", "$.extra", "$.kind", "$.n"}
    assert schemas.problems({}, MARKS) == ["$.included: missing"]
    assert schemas.problems({"included": [], "tree": {"kids": [{"x": True}]}}, MARKS) == ["$.tree.kids[0].x: fits none of the alternatives"]


def test_reply_columns(spark):
    df = spark.createDataFrame([('{"included": ["P1"], "n": 2}',)], "r string")
    r = df.select(F.from_json("r", schemas.spark_type(MARKS)).alias("r")).first().r
    assert r.included == ["P1"] and r.n == 2.0


def test_experiments(tmp_path):
    for n in (10, 2):
        d = tmp_path / f"exp_{n:02}"
        d.mkdir()
        (d / "system.md").write_text("# Task\nRead.\n\n## Sizes\n{{DIMENSIONS}}")
        (d / "response.json").write_text(json.dumps({"schema": MARKS}))
    (tmp_path / "exp_10" / "meta.json").write_text('{"model": "m", "pdf_text": false}')
    broken = tmp_path / "exp_03"
    broken.mkdir()
    (broken / "system.md").write_text("x")
    got = experiments.catalogue(str(tmp_path))
    assert [g[0] for g in got] == ["exp_02", "exp_03", "exp_10"] and got[1][1] is None and "schema" in got[1][2]
    e = got[2][1]
    assert e.model == "m" and not e.use_text
    assert experiments.render(e, "T", "P1") == "# Task\nRead.\n\n## Sizes\nP1"
    assert experiments.render(e, "T", None) == "# Task\nRead."
    assert experiments.render(got[0][1], "T", "P1").endswith("P1\n\nT") or "T" in experiments.render(got[0][1], "T", "P1")


def test_calls(spark):
    def client():
        seen = {}

        def ask(prompt):
            page = prompt.split()[0]
            seen[page] = seen.get(page, 0) + 1
            if page == "1" and seen[page] == 1:
                raise RuntimeError("429: Concurrent request limit reached for this API key")
            if page == "2":
                raise RuntimeError("invalid api key")
            if page == "3" and "could not be used" not in prompt:
                return "oops"
            return "{}"

        return ask

    prompts = spark.createDataFrame([("d", p, f"{p} go") for p in (1, 2, 3, 4)], "doc_id string, page_number int, prompt string")
    got = {r.page_number: r for r in adapters.call_models(prompts, client, lambda r: None if r == "{}" else "not JSON", pause=0.01).collect()}
    assert {p: (r.response, r.attempts) for p, r in got.items()} == {1: ("{}", 2), 2: (None, 1), 3: ("{}", 2), 4: ("{}", 1)}
    assert got[2].error == "invalid api key"


def test_decode(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF one")
    (tmp_path / "b.txt").write_bytes(b"no")
    rows = adapters.decode(adapters.pdf_files(spark, str(tmp_path)), lambda b: [("sheets", json.dumps({"n": len(b)}))]).collect()
    assert [(r.table, r.row) for r in rows] == [("sheets", '{"n": 8}')]


def test_stream(spark, tmp_path):
    source, out = tmp_path / "in", []
    source.mkdir()
    (source / "1.json").write_text("\n".join(json.dumps({"run_id": "r", "doc_id": "d", "page_number": p, "response": '{"included": ["P1"]}', "error": None, "elapsed": 1.0}) for p in (1, 2)))
    marks = spark.createDataFrame([("d", p, f"P{i}", float(i * p), i) for p in (1, 2) for i in (1, 2)], "doc_id string, page_number int, mark_id string, value double, ord int")
    q = sheets.report_each(sheets.replies(spark, str(source)), marks, lambda df, n: out.extend(df.collect()), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert sorted((r.page_number, r.length_mm, r.formula) for r in out) == [(1, 3.0, "1 + 2 = 3 мм"), (2, 6.0, "2 + 4 = 6 мм")]


def test_xlsx_drops_no_row(spark, monkeypatch):
    import sys
    from unittest.mock import MagicMock

    library = MagicMock()
    monkeypatch.setitem(sys.modules, "openpyxl", library)
    few, many = spark.range(2), spark.range(100_001)
    assert sinks.write_xlsx(few, few, "report.xlsx") == "report.xlsx"
    library.Workbook().save.assert_called_once_with("report.xlsx")
    for rows, stats in ((many, few), (few, many)):
        with pytest.raises(ValueError, match="use write_csv"):
            sinks.write_xlsx(rows, stats, "report.xlsx")
    library.Workbook().save.assert_called_once()
