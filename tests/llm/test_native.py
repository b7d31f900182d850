"""Native operators: chat formatting and fingerprints."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat, fingerprint

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations():
    rng = random.Random(4)
    rows = []

    def add(conv, turns):
        rows.extend((conv, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(turns))

    base = [f"turn {i} {rng.random()}" for i in range(700)]
    add(1, base[:3])
    add(2, base[:5])
    add(3, base[:5])  # equal to 2
    add(4, base[:4] + ["other"])
    add(5, base)  # extends 1, 2 and 3, in three blocks
    add(6, base[:300])
    add(7, base[1:4])  # no prefix
    add(8, ["hello"])
    add(9, ["hello"])
    add(10, ["hello", "you"])
    rows += [(11, 5, None, None), (11, None, "user", "late"), (11, 5, "user", "b"), (11, 5, "user", "a"), (11, 5, "user", "a"), (None, 0, "user", "x")]
    rows += [(50, None, "user", f"t{i}") for i in range(600)] + [(51, 7, "user", "the same turn")] * 700 + [(52, 7, "user", "the same turn")] * 300  # more than a block of null, equal or repeated turns
    rows += [(53, -3, "user", "below"), (53, None, "user", "first"), (54, 0, "user", "x" * 3_000_000)]
    for conv in range(100, 140):
        add(conv, [rng.choice(["x", "y"]) for _ in range(rng.randint(1, 6))])
    return rows


def test_render_against_duckdb(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("p", F.lit(1)).withColumn("conv", F.lit("x"))
    got = sorted((r.conv_id, r.part, r.n_turns, r.n_copies, r.rendered) for r in chat.render(df).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert got == sorted(con.execute(chat.ORACLE_SQL).fetchall())
    kept = {r[0] for r in got}
    assert {4, 5, 7, 10, 11, 50, 51} <= kept and not kept & {1, 2, 3, 6, 8, 9, 52}
    assert chat.render(df.limit(0)).count() == 0


def shingle_set(text, n=5):
    words = [w for w in __import__("re").split(r"[ \t\n\x0b\f\r]+", text) if w]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def edited(texts):
    """(id, text, next, edited) in id order."""
    out = []
    for i, (k, t) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        cut = len(t) // 4
        out.append((k, t, after, t[: len(t) - cut] + after[:cut]))
    return out


def test_edits(docs, texts):
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = {r.doc_id: r for r in fingerprint.edits(unique).collect()}
    ordered = [(r.doc_id, r.text or "") for r in unique.select("doc_id", "text").orderBy("doc_id").collect()]
    assert len(rows) == len(ordered)
    errors = []
    for k, t, after, e in edited(ordered):
        r = rows[k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        a, b, c = map(shingle_set, (t, e, after))
        exact = len(a | b) <= fingerprint.K
        (errors.append if not exact else lambda x: pytest.fail(str(k)) if x > 1e-9 else None)(abs(r.near_edited - jaccard(a, b)))
        if len(a | c) <= fingerprint.K:
            assert r.near_next == pytest.approx(jaccard(a, c))
            assert r.held_next == pytest.approx(len(a & c) / len(a) if a else 0)
    assert sum(errors) / len(errors) < 0.04 and max(errors) < 0.2


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_next_with_gaps_ties_and_nulls(spark, monkeypatch, partitions):
    rows = [(i * i, f"t{i}") for i in range(60)] + [(5, f"a{i}") for i in range(40)] + [(None, f"n{i}") for i in range(40)] + [(5, "a0"), (5, "a0"), (3600, None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    try:
        found = fingerprint.with_next(df)
        got = [(r.id, r.text, r.next_text) for r in found.collect()]
        cuts = fingerprint.cuts_of(df.selectExpr("doc_id AS id", "xxhash64(coalesce(text, '')) AS h", "coalesce(text, '') AS text"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert partitions == "1" or len({c for c in cuts if c[0] is None}) > 1 and len({c for c in cuts if c[0] == 5}) > 1  # one id fills several ranges
    hashes = {r.text: r.h for r in df.selectExpr("coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").collect()}
    want = sorted([(k, t or "") for k, t in rows], key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted([(k, t, after[1]) for (k, t), after in zip(want, [*want[1:], want[0]])], key=key)
    assert fingerprint.with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [(r.text, r.next_text) for r in fingerprint.with_next(spark.createDataFrame([(1, "only")], "doc_id long, text string")).collect()] == [("only", "only")]


def test_written_fingerprints_read_back(spark):
    texts = ["", "one", " ".join(f"w{i}" for i in range(900))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(fingerprint.sketch(F.col("t")).alias("a"))
    assert all(r.a == r.b for r in rows.select("a", fingerprint.from_text(fingerprint.as_text(F.col("a"))).alias("b")).collect())


def test_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    r = fingerprint.edits(spark.createDataFrame([(1, long), (2, "y" * 2_000_000)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[0].n_chars == len(long) and abs(r[0].n_shingles / 299_996 - 1) < 0.25 and 0.6 < r[0].near_edited < 0.9


def test_sketches_merge(spark):
    words = [f"w{i}" for i in range(900)]
    a, b = " ".join(words[:600]), " ".join(words[300:])
    s = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprint.sketch(F.col("a")).alias("a"), fingerprint.sketch(F.col("b")).alias("b"))
    r = s.select(
        fingerprint.resemblance(F.col("a"), F.col("b")).alias("j"), fingerprint.containment(F.col("a"), F.col("b")).alias("c"),
        fingerprint.distinct_shingles(F.col("a")).alias("n"), fingerprint.distinct_shingles(fingerprint.merge(F.col("a"), F.col("b"))).alias("u"),
    ).first()
    assert abs(r.j - 296 / 896) < 0.13 and abs(r.c - 296 / 596) < 0.18
    assert abs(r.n - 596) < 150 and abs(r.u - 896) < 230


def test_native_plans(docs, spark):
    for df in (fingerprint.edits(docs), chat.render(spark.createDataFrame(conversations(), SCHEMA))):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def exchanged(spark, run):
    """Largest data size of an exchange that run() makes, in bytes."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    most = 0.0
    for k in range(before, store.executionsCount()):
        execution = store.executionsList(k, 1).apply(0).executionId()
        values = store.executionMetrics(execution)
        nodes = store.planGraph(execution).allNodes()
        for i in range(nodes.size()):
            node = nodes.apply(i)
            for j in range(node.metrics().size()):
                metric = node.metrics().apply(j)
                if node.name() == "Exchange" and metric.name() == "data size" and values.contains(metric.accumulatorId()):
                    number, unit = re.search(r"([\d.]+) ([KMGT]?i?B)", values.apply(metric.accumulatorId())).groups()
                    most = max(most, float(number) * {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30}[unit])
    return most


def test_only_kept_texts_are_shuffled(spark):
    """Growing snapshots: what an exchange moves is in proportion to the kept texts, not to all that was logged."""
    rows, kept = [], 0
    rng = random.Random(6)
    for c in range(40):
        turns = ["".join(rng.choices("abcdefghij ", k=1500)) for _ in range(30)]
        kept += sum(map(len, turns))
        rows += [(c * 100 + n, i, "user", t) for n in range(1, 31) for i, t in enumerate(turns[:n])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).persist()
    logged = sum(len(r[3]) for r in rows)
    assert df.count() and logged > 15 * kept
    assert exchanged(spark, lambda: chat.render(df).collect()) < 1.5 * kept + 200_000
    df.unpersist()
