"""Settings, exports, commands and the edges of sources."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import commands, settings
from plumbline.operators import drawing, spatial, textmap, trim
from plumbline.sources import adapters, exports, schemas


def test_options():
    o = settings.Options.read({"PLUMBLINE_PARALLEL": " 8", "PLUMBLINE_TRIM": "no", "PLUMBLINE_DPI": "", "PLUMBLINE_MODEL": "m", "OTHER": "x"})
    assert (o.parallel, o.trim, o.dpi, o.model) == (8, False, 220.0, "m")
    for name, bad in (("PARALLEL", "x"), ("TRIM", "maybe"), ("DPI", "1,5")):
        with pytest.raises(settings.SettingError):
            settings.Options.read({"PLUMBLINE_" + name: bad})
    assert [settings.switch(*x) for x in ((None, False, True), (None, False, False), (True, True, True), (False, False, True), (True, False, False))] == [True, False, False, False, True]


def test_tariffs(spark):
    rows = settings.tariffs(spark, '{"a": {"input": 1, "output": null}, "default": {"reasoning": "2.5"}}').orderBy("model").collect()
    assert [tuple(r) for r in rows] == [("a", 1.0, 0.0, 0.0, 0.0, 0.0), ("default", 0.0, 0.0, 2.5, 0.0, 0.0)]
    assert settings.tariffs(spark, " ").count() == settings.tariffs(spark, None).count() == 0
    for bad in ("[", "[]", '{"a": 1}', '{"a": {"input": "x"}}'):
        with pytest.raises(settings.SettingError):
            settings.tariffs(spark, bad)


def test_run_documents(spark):
    runs = spark.createDataFrame([("r", "exp", 2.5), ("s", "e\"x", None)], "run string, experiment string, seconds double")
    pages = spark.createDataFrame([("r", 2, None, "bad"), ("r", 1, '{"a": 1}', None)], "run string, page_number int, response string, error string")
    got = {r.run: json.loads(r.document) for r in exports.run_documents(runs, pages, ["run"]).collect()}
    assert got == {"r": {"experiment": "exp", "seconds": 2.5, "pages": [{"page_number": 1, "response": '{"a": 1}', "error": None}, {"page_number": 2, "response": None, "error": "bad"}]}, "s": {"experiment": 'e"x', "seconds": None, "pages": []}}


def test_detection_documents(spark):
    lines = spark.createDataFrame([(1, k, "span", str(v), float(v), x, float(y), x + v, float(y), float(v)) for k, v, x, y in ((1, 30, 0.0, 0), (2, 10, 0.0, 5), (3, 20, 10.0, 5))], "p int, idx int, kind string, label string, value double, ax double, ay double, bx double, by double, length_pt double")
    numbers = spark.createDataFrame([(1, "30", 1.0, 2.0, 3.0, 4.005)], "p int, text string, x0 double, y0 double, x1 double, y1 double")
    stats = spark.createDataFrame([(1, 0.5), (2, 1.0)], "p int, scale double")
    got = {r.p: json.loads(r.document) for r in exports.detection_documents(spatial.hierarchy(lines, ["p"]), numbers, numbers.limit(0), stats, ["p"]).collect()}
    assert [(x["id"], x["parent"], x["children"]) for x in got[1]["hierarchy"]] == [("P1", None, ["P2", "P3"]), ("P2", "P1", []), ("P3", "P1", [])]
    assert got[1]["numbers"][0]["text"] == "30" and got[1]["orphans"] == [] and got[2] == {"hierarchy": [], "numbers": [], "orphans": [], "stats": {"scale": 1.0}}


def test_decode_errors_and_pages(spark):
    files = spark.createDataFrame([("a.pdf", b"3"), ("b.pdf", b"0"), ("c.pdf", b"locked")], "path string, content binary")

    def decoder(content):
        for n in range(1, int(content) + 1):
            yield "sheets", json.dumps({"page_number": n, "width_pt": 10.0, "height_pt": 20.0})

    rows = adapters.decode(files, decoder, "2-3")
    assert sorted((r.doc_id, r.page_number) for r in adapters.decoded_table(rows, "sheets", schemas.SHEETS).collect()) == [("a.pdf", 2), ("a.pdf", 3)]
    errors = {r.doc_id: json.loads(r.row)["error"] for r in rows.where(F.col("table") == "error").collect()}
    assert errors["b.pdf"] == "ValueError: the document has no pages" and errors["c.pdf"].startswith("ValueError: invalid literal")
    wrong = adapters.decode(files.limit(1), decoder, "9").collect()
    assert wrong[0].table == "error" and "no such pages: [9]" in wrong[0].row


def test_trim_counts_and_skips(spark):
    page = np.full((200, 200, 3), 255, np.uint8)
    page[50, 60, 0] = 0  # one dark channel: two of them are asked for
    assert trim.content_box(page, trim.Trim(min_ink=2))[1]["empty"]
    page[50, 60] = 0  # three dark values in the row, one dark pixel in the column
    assert not trim.content_box(page, trim.Trim(min_ink=2))[1]["empty"]
    rows = [("small", 200, 200, page.tobytes()), ("big", 200, 200, np.where(np.indices((200, 200, 3))[0] % 190 > 20, 0, 255).astype(np.uint8).tobytes())]
    got = {r.case: r for r in trim.trim(spark.createDataFrame(rows, "case string, width int, height int, pixels binary"), ["case"]).collect()}
    assert got["small"].skipped and got["small"].area_ratio == 1.0 and not got["big"].skipped


def test_names_and_text_modes(spark):
    assert schemas.unique_names(["route part", "Route part", "route part", "", "9x"]) == ["Route_part", "Route_part2", "Route_part3", "Model_", "Model_9x"]
    words = spark.createDataFrame([(1, w, x, y, x + 5, y + h) for w, x, y, h in (("b", 10.0, 0.5, 4.0), ("a", 0.0, 0.0, 4.0), ("c", 0.0, 20.0, 4.0), ("tiny", 30.0, 0.0, 1.0))], "p int, word string, x0 double, y0 double, x1 double, y1 double")
    assert [r.text for r in textmap.sorted_words(words, ["p"], 3.0, 2.0).collect()] == ["a b\nc"]
    items = spark.createDataFrame([("1,5",), ("12",), ("a1",)], "text string")
    assert sorted(r.text for r in textmap.numbers(items).collect()) == ["1,5", "12"]


def test_commands(spark, tmp_path):
    folder, said = str(tmp_path / "t"), []
    line = [("l", 100.0, 200.0, 200.0, 200.0)]
    head = lambda x, d: [("l", x, 200.0, x + d, 201.0), ("l", x + d, 201.0, x + d, 199.0), ("l", x + d, 199.0, x, 200.0)]
    spark.createDataFrame([("d", n, 841.89, 841.89) for n in (1, 2)], schemas.SHEETS).write.parquet(f"{folder}/sheets.parquet")
    spark.createDataFrame([("d", 1, 1, [], 0.48, line), ("d", 1, 2, [0.0], 0.0, head(100.0, 4.0)), ("d", 1, 3, [0.0], 0.0, head(200.0, -4.0))], schemas.PATHS).write.parquet(f"{folder}/paths.parquet")
    spark.createDataFrame([("d", 1, 1, 1, 1, "320", 145.0, 190.0, 155.0, 198.0)], schemas.WORDS).write.parquet(f"{folder}/words.parquet")
    spark.createDataFrame([("d", 1, 1, 1, 1, 8.0, 1.0, 0.0, [(c, 145.0 + i, 190.0, 146.0 + i, 198.0) for i, c in enumerate("320")])], schemas.SPANS).write.parquet(f"{folder}/spans.parquet")
    spark.createDataFrame([("r", "d", 1, '{"included": ["P1"]}', None, 1.0), ("r", "d", 2, None, "429", 1.0)], schemas.RESPONSES).write.parquet(f"{folder}/responses.parquet")
    run = lambda *a: (said.clear(), commands.main(list(a), said.append, spark))[1]
    assert run("extract", folder) == 0 and said[-1] == "2 sheets" and said[0].endswith("1 labels")
    assert run("dims", folder, "--pages", "1") == 0 and 'P1 "320"' in said[0] and len(said) == 1
    assert run("text", folder, "--numbers-only") == 0 and '"320"' in said[0] and "scan" in said[1]
    assert run("report", folder, "--pages", "1") == 0 and said[0].startswith("1; ; 320.0; 0.32; 320 = 320 мм; 1")
    out = str(tmp_path / "r.csv")
    assert run("report", folder, "--out", out) == 1
    with open(out, encoding="utf-8-sig") as f:
        assert [x.split(";")[0] for x in f.read().splitlines()] == ["sheet", "1", "2"]
    assert run("analyze", folder, "--regions") == 0 and "error: 429" in said[1]
    assert run("dims", str(tmp_path / "none")) == 2 and run("schema", str(tmp_path)) == 2
    e = tmp_path / "research" / "exp_1"
    e.mkdir(parents=True)
    (e / "system.md").write_text("Do it", encoding="utf-8")
    (e / "response.json").write_text('{"type": "object", "properties": {"a": {"type": "string"}}}', encoding="utf-8")
    (tmp_path / "research" / "exp_2").mkdir()
    (tmp_path / "research" / "exp_2" / "system.md").write_text("x", encoding="utf-8")
    assert run("experiments", str(tmp_path / "research")) == 0 and "fields a" in said[0] and "error" in said[1]
    assert run("prompt", str(e)) == 0 and said == ["Do it"]
    assert run("schema", str(e)) == 0 and json.loads(said[0])["required"] == ["a"]
    with pytest.raises(SystemExit):
        commands.main(["nothing"])
    assert drawing.SHEET == commands.SHEET


def client(model, effort):
    """A model that selects P1 at once, or answers badly first, by its name."""
    bad = [] if model == "good" else ["no JSON", '{"included": "P1"}']

    def ask(prompt):
        assert "P1" in prompt or "scan" in prompt
        return bad.pop(0) if bad else '{"included": ["P1"]}' if model != "never" else "{}"

    return ask


def test_run_command(spark, tmp_path):
    test_commands(spark, tmp_path)  # makes the tables
    e = tmp_path / "research" / "exp_7"
    e.mkdir()
    (e / "system.md").write_text("Select.\n\n{{DIMENSIONS}}", encoding="utf-8")
    (e / "response.json").write_text('{"type": "object", "properties": {"included": {"type": "array", "items": {"type": "string"}}}}', encoding="utf-8")
    (e / "meta.json").write_text('{"model": "never", "reasoning_effort": "low"}', encoding="utf-8")
    said, runs = [], tmp_path / "runs"
    code = commands.main(["run", str(tmp_path / "t"), str(e), "--client", "tests.test_surface:client", "--out", str(runs), "--model", "good", "--pages", "1"], said.append, spark)
    where = next(runs.iterdir())
    stats = json.loads((where / "stats.json").read_text())
    assert code == 0 and where.name.startswith("exp_7_") and (stats["model"], stats["effort"], stats["pages"], stats["pages_failed"], stats["calls"]) == ("good", "low", 1, 0, 1)
    assert (where / "report.csv").read_text("utf-8-sig").splitlines()[1].startswith("1;;320.0;0.32;320 = 320 мм;1")
    prompt = spark.read.parquet(str(where / "prompts")).first().prompt
    assert prompt.startswith("Select.") and 'P1 "320"' in prompt and "Лист № 1" in prompt and "{{" not in prompt
    runs = tmp_path / "again"
    assert commands.main(["run", str(tmp_path / "t"), str(e), "--client", "tests.test_surface:client", "--out", str(runs), "--model", "slow", "--pages", "1"], said.append, spark) == 0
    assert json.loads((next(runs.iterdir()) / "stats.json").read_text())["calls"] == 3  # two bad replies, then a good one
    runs = tmp_path / "failed"
    assert commands.main(["run", str(tmp_path / "t"), str(e), "--client", "tests.test_surface:client", "--out", str(runs), "--pages", "1"], said.append, spark) == 1
    replies = spark.read.parquet(str(next(runs.iterdir()) / "responses.parquet")).first()
    assert replies.response is None and "included: missing" in replies.error


def test_checked_replies(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, "{}"), (3, '{"a": "x", "b": 2}'), (4, "no"), (5, None)], "k int, response string")
    got = {r.k: r.problems for r in schemas.checked(df, {"type": "object", "properties": {"a": {"type": "integer"}}, "required": ["a"], "additionalProperties": False}).collect()}
    assert got[1] == [] and got[2] == ["$.a: missing"] and sorted(got[3]) == ["$.a: not integer", "$.b: unexpected"] and got[4] is None and got[5] is None
