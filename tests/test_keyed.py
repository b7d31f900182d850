"""Sheets whose reply and marks arrive apart: streamed rows equal the batch report in any order."""

import datetime
import json
import os
import random

import pytest

from plumbline.operators import selection
from plumbline.streaming import keyed

START = datetime.datetime(2024, 1, 1)


def events(seed, sheets=6):
    """Complete sheets, one without its last mark, one without a reply; some events twice."""
    rng, out = random.Random(seed), []
    for page in range(sheets):
        n = rng.randint(1, 5)
        marks = [(f"P{i}", float(rng.randint(1, 900)), i) for i in range(1, n + 1)]
        reply = json.dumps({"included": [m[0] for m in marks[: max(1, n - 1)]], "excluded": [m[0] for m in marks[n - 1 :]] if n > 1 else []})
        own = [{"kind": "mark", "mark_id": m, "value": v, "ord": o, "of": n + (page == 4)} for m, v, o in marks]
        own += [{"kind": "reply", "response": reply}] if page != 5 else []
        own += own[: rng.randint(0, 2)]
        out += [{"doc_id": "d", "page_number": page, **e} for e in own]
    rng.shuffle(out)
    return [{**e, "at": (START + datetime.timedelta(seconds=i)).isoformat()} for i, e in enumerate(out)]


def ran(spark, folder, batches, wait="1 hour"):
    """Rows of the stream over files of events, a micro-batch each."""
    got, source = [], folder / "in"
    source.mkdir()
    for n, batch in enumerate(batches):
        (source / f"{n}.json").write_text("\n".join(map(json.dumps, batch)))
        os.utime(source / f"{n}.json", (1_700_000_000 + n,) * 2)  # in this order
    stream = spark.readStream.schema(keyed.EVENTS).option("maxFilesPerTrigger", 1).json(str(source))
    q = keyed.report_each(stream, lambda df, number: got.extend(df.collect()), str(folder / "checkpoint"), wait=wait, late="1 minute")
    q.awaitTermination(240)
    assert q.exception() is None and not q.isActive
    return got


@pytest.fixture()
def few(spark):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", kept)


@pytest.mark.parametrize("seed", [1])
def test_any_order_equals_the_batch(spark, tmp_path, few, seed):
    rows = events(seed)
    later = [{"doc_id": "z", "page_number": 0, "kind": "reply", "response": "{}", "at": (START + datetime.timedelta(hours=h)).isoformat()} for h in (3, 6)]
    got = ran(spark, tmp_path, [rows[: len(rows) // 2], rows[len(rows) // 2 :], later[:1], later[1:]])
    made = spark.createDataFrame([(e["doc_id"], e["page_number"], e.get("response"), None, e["kind"]) for e in rows if e["kind"] == "reply"], "doc_id string, page_number int, response string, error string, kind string").dropDuplicates()
    marks = spark.createDataFrame([(e["doc_id"], e["page_number"], e["mark_id"], e["value"], e["ord"]) for e in rows if e["kind"] == "mark"], "doc_id string, page_number int, mark_id string, value double, ord int").dropDuplicates()
    batch = selection.report(made.selectExpr("doc_id", "page_number", "error", "try_parse_json(response) AS response"), marks, keyed.BY).collect()
    want = {r.page_number: r.asDict(recursive=True) for r in batch}
    mine = [r.asDict(recursive=True) for r in got if r.doc_id == "d"]
    complete = {r["page_number"]: r for r in mine if r["complete"]}
    assert sorted(complete) == [0, 1, 2, 3] and len(mine) == 6  # each sheet once
    for page, r in complete.items():
        assert {k: v for k, v in r.items() if k != "complete"} == want[page]
    over = {r["page_number"]: r for r in mine if not r["complete"]}
    assert sorted(over) == [4, 5] and {k: v for k, v in over[4].items() if k != "complete"} == want[4]


def test_state_goes_with_the_timer(spark, tmp_path, few):
    """After the timer a sheet is forgotten: its key starts anew."""
    at = lambda m: (START + datetime.timedelta(minutes=m)).isoformat()
    one = {"doc_id": "d", "page_number": 1, "kind": "mark", "mark_id": "P1", "value": 3.0, "ord": 1, "of": 1}
    reply = {"doc_id": "d", "page_number": 1, "kind": "reply", "response": '{"included": ["P1"]}'}
    other = {"doc_id": "x", "page_number": 1, "kind": "mark", "mark_id": "P1", "value": 3.0, "ord": 1, "of": 9}
    got = ran(spark, tmp_path, [[{**one, "at": at(0)}, {**reply, "at": at(1)}], [{**one, "at": at(2)}], [{**other, "at": at(100)}], [{**other, "at": at(103)}], [{**one, "at": at(104)}, {**reply, "at": at(105)}]], wait="10 minutes")
    assert [(r.doc_id, r.complete) for r in got] == [("d", True), ("d", True)]
