"""The page source: partitions, selection, pushed filters, errors; decoder calls are counted in files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from plumbline.sources import pages



class Counting(pages.LineDrawing):
    """Leaves a file for each page that is asked for, beside its document."""

    def page(self, number):
        folder = os.path.join(os.path.dirname(self.where), ".calls")
        os.makedirs(folder, exist_ok=True)
        open(os.path.join(folder, f"{os.path.basename(self.where)}-{number}-{os.getpid()}-{os.urandom(4).hex()}"), "w").close()
        return super().page(number)

    def __init__(self, path):
        super().__init__(path)
        self.where = path


def line(doc, n):
    word = {"block_no": 0, "line_no": 0, "word_no": 0, "word": f"{doc}{n}", "x0": 1.0, "y0": 2.0, "x1": 3.0, "y1": 4.0}
    path = {"path_id": 1, "fill": None, "stroke_width": 0.5, "items": [{"kind": "l", "x0": 0.0, "y0": 0.0, "x1": 5.0, "y1": float(n)}]}
    span = {"block_no": 0, "line_no": 0, "span_no": 0, "font_size": 8.0, "dir_x": 1.0, "dir_y": 0.0, "chars": [{"c": "7", "x0": 1.0, "y0": 1.0, "x1": 2.0, "y1": 2.0}]}
    return json.dumps({"width_pt": 100.0 + n, "height_pt": 50.0, "words": [word, word], "paths": [path], "spans": [span]})


@pytest.fixture()
def folder(tmp_path):
    for doc, n in (("a", 5), ("b", 2)):
        (tmp_path / f"{doc}.jsonl").write_text("\n".join(line(doc, i + 1) for i in range(n)) + "\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.jsonl").write_text(line("c", 1))
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "locked.jsonl").write_text('{"locked": true}\n')
    (tmp_path / "torn.jsonl").write_text(line("t", 1) + "\n{broken\n")
    (tmp_path / "folder.jsonl").mkdir()
    (tmp_path / "note.txt").write_text("no document")
    return tmp_path


@pytest.fixture(scope="module")
def source(spark):
    pages.register(spark)
    return lambda folder, **options: spark.read.format("sheets").options(path=str(folder), decoder="tests.test_pages:Counting", **options).load()


def calls(folder):
    found = sorted("-".join(n.split("-")[:2]) for f, _, names in os.walk(folder) if f.endswith(".calls") for n in names)
    for f, _, names in os.walk(folder):
        for n in names:
            if f.endswith(".calls"):
                os.unlink(os.path.join(f, n))
    return found


def test_tables_and_partitions(source, folder):
    sheets = source(folder)
    assert sheets.rdd.getNumPartitions() == 5 + 2 + 1 + 2  # a page each; torn has two lines
    got = {(r.doc_id, r.page_number): r.width_pt for r in sheets.collect()}
    assert got == {("a.jsonl", i): 100.0 + i for i in range(1, 6)} | {("b.jsonl", i): 100.0 + i for i in (1, 2)} | {("sub/c.jsonl", 1): 101.0, ("torn.jsonl", 1): 101.0}
    assert source(folder, table="words").count() == 18 and source(folder, table="paths").select(F.explode("items")).count() == 9
    assert {r.c for r in source(folder, table="spans").select(F.explode("chars.c").alias("c")).collect()} == {"7"}
    assert source(folder, pages_in_partition="3").rdd.getNumPartitions() == 2 + 1 + 1 + 1
    with pytest.raises(Exception, match="no such table"):
        source(folder, table="pictures")


def test_selection_decodes_only_its_pages(source, folder):
    calls(folder)
    df = source(folder / "a.jsonl", table="words", pages="4-3,1")
    assert df.rdd.getNumPartitions() == 3 and {r.page_number for r in df.collect()} == {1, 3, 4}
    assert calls(folder) == ["a.jsonl-1", "a.jsonl-3", "a.jsonl-4"]


def test_filters_reach_the_reader(source, folder):
    calls(folder)
    df = source(folder, table="sheets")
    for where, wanted in (("page_number = 2", ["a.jsonl-2", "b.jsonl-2", "torn.jsonl-2"]), ("doc_id = 'a.jsonl' and page_number >= 4", ["a.jsonl-4", "a.jsonl-5"]), ("page_number in (1, 5) and doc_id < 'b'", ["a.jsonl-1", "a.jsonl-5"]), ("page_number > 9", [])):
        rows = df.where(where).collect()
        assert calls(folder) == wanted and all(r.doc_id.split("/")[-1] + f"-{r.page_number}" in wanted for r in rows)
    assert df.where("width_pt > 104").count() == 1  # not pushed, still right


def test_errors_are_rows(source, folder):
    got = {(r.doc_id, r.page_number): r.kind for r in source(folder, table="errors").collect()}
    assert got == {("empty.jsonl", None): "empty", ("locked.jsonl", None): "locked", ("folder.jsonl", None): "folder", ("torn.jsonl", 2): "damaged"}
    assert {r.kind for r in source(folder / "none.jsonl", table="errors").collect()} == {"missing"}
    assert source(folder / "none.jsonl").count() == 0
    wrong = source(folder / "b.jsonl", table="errors", pages="1-4").collect()
    assert [(r.kind, "[3, 4]" in r.error) for r in wrong] == [("selection", True)]


def test_partitions_read_only_their_lines(tmp_path, monkeypatch):
    """A partition begins at its first page; it neither counts the document's pages nor reads the lines before."""
    (tmp_path / "d.jsonl").write_text("\n\n".join(line("d", i + 1) for i in range(40)) + "\n")
    reader = pages.PageReader({"path": str(tmp_path), "table": "words", "pages_in_partition": "10"}, pages.StructType.fromDDL("doc_id string, page_number int, word string"))
    parts = reader.partitions()
    assert [(p.numbers[0], len(p.numbers)) for p in parts] == [(1, 10), (11, 10), (21, 10), (31, 10)]
    monkeypatch.setattr(pages.LineDrawing, "page_count", property(lambda self: pytest.fail("counted again")))
    for p in parts:
        batches = list(reader.read(p))
        assert len(batches) == 1 and batches[0].column("page_number").to_pylist() == [n for n in p.numbers for _ in range(2)]
        assert set(batches[0].column("word").to_pylist()) == {f"d{n}" for n in p.numbers}
