"""The Jaccard join against all pairs."""

import random
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import forest, graph, oracles, vec


def shingle_set(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute(rows, threshold=0.8):
    """(class, links, copies, linked texts) of each (id, set of shingles); an id with two sets is two documents."""
    docs = sorted({(k, shingle_set(t or "")) for k, t in rows}, key=lambda d: (d[0], sorted(d[1])))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [set() for _ in docs]
    for i, (_, x) in enumerate(docs):
        for j in range(i + 1, len(docs)):
            y = docs[j][1]
            if x == y or len(x & y) >= threshold * len(x | y) > 0:
                links[i].add(j)
                links[j].add(i)
                ra, rb = find(i), find(j)
                root[max(ra, rb)] = min(ra, rb)
    made = [(docs[find(i)][0], len(links[i]), sum(docs[j][1] == x for j in links[i]), len({docs[j][1] for j in links[i]} - {x})) for i, (_, x) in enumerate(docs)]
    return dict(zip(docs, made))


def near_copies(n=260, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(8, 160))]
        for _ in range(n // 12):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    common = " ".join(word() for _ in range(12))
    rows += [common + " " + " ".join(word() for _ in range(60)) for _ in range(80)]
    rows += ["", None, "a", "a", "a b", "\n", "a  b"]
    rng.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


def links(df):
    return forest.join(df).drop("text_hash", "class_hash")


def check(spark, rows, lost=0):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, id string, node int").repartition(5)
    got = sorted((tuple(r)[:5] for r in links(df).collect()), key=lambda r: (r[0] or 0, *map(str, r[1:])))
    want = brute([r for r in rows if r[0] is not None])
    want = sorted(((k, *want[k, shingle_set(t or "")]) for k, t in rows if k is not None), key=lambda r: (r[0], *map(str, r[1:])))
    want += [(None, None, 0, 0, 0)] * (len(rows) - len(want))
    got = [r for r in got if r[0] is not None] + [r for r in got if r[0] is None]
    assert len(got) == len(rows)
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    assert len(wrong) <= lost, wrong[:5]


@pytest.mark.parametrize("blocks", [None, (16, 16, 1 << 20), (2048, 2048, 300)])
def test_join_is_exact(spark, monkeypatch, blocks):
    if blocks:
        for name, size in zip(("BLOCK", "EXACT_BLOCK", "EXACT_SHINGLES"), blocks):
            monkeypatch.setattr(forest, name, size)
    check(spark, near_copies())  # a pair is lost with probability 1 - forest.RECALL at most, so these few are all found


def test_hot_keys_and_repeated_ids(spark, monkeypatch):
    """One text with a third of all rows, one id with many texts, repeated rows, a hub; all or no keys are hot."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    long = [word() for _ in range(60)]
    rows = near_copies(60, seed=9)
    rows += [(1000 + i, " ".join(long)) for i in range(60)] + [(5, " ".join(long)), (5, "another text of its own with some words"), (6, " ".join([*long, "more"])), (6, " ".join([*long, "more"]))]
    rows += [(7, " ".join(word() for _ in range(20))) for _ in range(30)] + [(8, "the same row")] * 30
    rows += [(None, "no id"), (None, " ".join(long))]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array([k for k, _ in rows], "Int64"), "text": [t for _, t in rows]}))
    want = sorted(con.execute(oracles.jaccard_join()).fetchall(), key=str)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, links(df).collect()), key=str) == want
    for heavy, many in ((1000, 500), (1000, 0), (20, 5)):
        monkeypatch.setattr(graph, "HEAVY", heavy)
        monkeypatch.setattr(graph, "MANY", many)
        check(spark, rows)


def test_very_long_text(spark):
    long = " ".join(f"w{i % 70_001}x" for i in range(400_000))
    rows = spark.createDataFrame([(1, long), (2, long + " end"), (3, "y" * 2_000_000)], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in forest.join(rows).collect()) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_join_of_odd_documents(docs, spark):
    rows = forest.join(docs).collect()
    assert len(rows) == docs.count()
    assert all((r.class_id is None) == (r.doc_id is None) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[10_021].class_id == by[10_022].class_id == 10_021
    assert forest.join(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links, r.n_copies) for r in forest.join(nulls).collect()) == [(0, 0, 0, 0), (1, 1, 0, 0), (1, 1, 0, 0)]


def test_measured_depth_meets_recall(spark):
    """Sampled pairs at the threshold, counted apart from the operator, meet at the depth that it chooses."""
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 80))) for i in range(700)], "id long, text string")
    for t in (0.5, 0.8, 0.95):
        d = forest.measured_depth(rows, t)
        met = 0
        for _ in range(1500):
            a = rng.integers(0, 2**63, 90, dtype=np.int64).astype(np.uint64)
            k = int(90 * (1 - t) / (1 + t))
            b = np.concatenate([a[k:], rng.integers(0, 2**63, k, dtype=np.int64).astype(np.uint64)])
            x, y = forest.signatures(np.concatenate([a, b]), np.array([0, 90, 180]))
            met += any((x[s : s + d] == y[s : s + d]).all() for s in range(0, len(x), forest.DEPTH))
        assert d == 1 or met >= (forest.RECALL - 0.005) * 1500
    assert forest.measured_depth(rows, 0.5) <= forest.measured_depth(rows, 0.8) <= forest.measured_depth(rows, 0.95)
    assert forest.measured_depth(rows.limit(0), 0.8) == 1


def test_overlaps():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, n)).astype(np.uint64) for n in (1, 5, 0, 30, 30)]
    got = forest.overlaps(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    assert all(got[i, j] == len(set(a.tolist()) & set(b.tolist())) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(30)]
    scratch = graph.Scratch(spark)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert len(scratch.paths) == 1
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    assert got == {x: find(x) for x in root}


def test_large_nodes_take_linear_time(spark, monkeypatch):
    """Different near copies of one text: candidates leave the blocks in proportion to them, and all are found."""
    import time

    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 80)]
    seconds = {}
    for m in (5_000, 20_000):
        texts = []
        for i in range(m):
            words = list(base)
            words[int(rng.integers(0, 80))] = f"x{i}"
            texts.append(" ".join(words))
        made, offs = [], [0]
        for t in texts:
            v = np.frombuffer(t.encode(), np.uint8)
            made.append(v)
            offs.append(offs[-1] + len(v))
        values, at = vec.shingles(vec.tokenise(np.concatenate(made), np.array(offs)))
        sig = forest.signatures(values, at)
        df = spark.createDataFrame([(i, bytes(s.tobytes())) for i, s in enumerate(sig)], "node long, sig binary")
        nodes = forest.more_labels(df)
        sizes = nodes.groupBy("g").agg(F.count("node").alias("size"), F.min("node").alias("hub")).where("size > 1").withColumn("nb", F.ceil(F.col("size") / forest.BLOCK).cast("int"))
        members = nodes.join(sizes, "g").join(df, "node")
        dealt = forest._with_least(members)
        assert dealt.count() < 1.1 * nodes.count()  # no member is sent to all blocks but the least
        began = time.time()
        near = dealt.select("g", "i", "node", "tree", "sig").mapInArrow(forest.candidates(0.8, 4), "a long, b long").distinct()
        found = graph.components(near, graph.Scratch(spark)).toPandas()
        seconds[m] = time.time() - began
        assert len(found) > 0.999 * m and found.root.nunique() == 1
    assert seconds[20_000] < 8 * max(seconds[5_000], 2), seconds  # 16 times the pairs


def test_keep(spark):
    """One row of each class by id and text, where an id has several texts or a copy of another id's."""
    a, b, c, d = ("one two three four five six", "seven eight nine ten eleven twelve", "red green blue black white grey", "north south east west up down")
    rows = [(3, a), (5, a), (5, b), (6, c), (6, d), (None, a), (None, a), (7, d), (5, b)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, class_id int").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in forest.keep(df).collect()), key=str)
    assert got == sorted([(3, a), (5, b), (6, c), (6, d), (None, a), (None, a)], key=str)
    assert forest.keep(df).columns == df.columns and forest.keep(df.limit(0)).count() == 0


def test_texts_of_others_stay(spark, tmp_path):
    """Only texts of candidates are shuffled."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(300))) for i in range(400)] + [(1000 + i, " ".join(f"v{k}" for k in range(300)) + f" {i}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keys = spark.createDataFrame([(i,) for i in range(1000, 1003)], "doc_id long")
    kept = graph.sift(df, keys, ["doc_id"]).select("doc_id").collect()
    assert {r.doc_id for r in kept} >= {1000, 1001, 1002} and len(kept) < 10
    assert graph.sift(df, keys.limit(0), ["doc_id"]).count() == 0
    plan = graph.sift(df, keys, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def edited_pairs(n=60, seed=11):
    """Pairs of texts of 120 words, a part of whose words at the end differs: similarity just above 0.8."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for _ in range(n):
        base = [word() for _ in range(120)]
        rows += [" ".join(base), " ".join(base[:108] + [word() for _ in range(12)])]
    return [(i + 1, t) for i, t in enumerate(rows)]


def test_what_the_forest_loses_is_found(spark, monkeypatch):
    """With whole labels one in ten of these pairs meets in no tree; all the same no link is lost."""
    rows = edited_pairs()
    want = brute(rows)
    assert sum(links for _, links, _, _ in want.values()) == len(rows)
    monkeypatch.setattr(forest, "measured_depth", lambda *a, **k: forest.DEPTH)
    got = forest.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies, r.n_linked_texts) for r in got.collect()} == {k: v for (k, _), v in want.items()}


def test_what_the_blocks_lose_is_found(spark, monkeypatch):
    """Candidates that come from blocks of two and find no cluster: the links do not depend on them."""
    rows = [(i, t) for i, t in near_copies(120, 5) if t and len(t.split()) > 5]
    want = brute(rows)
    monkeypatch.setattr(forest, "BLOCK", 2)
    monkeypatch.setattr(forest, "least_agreement", lambda threshold: 1.0)
    got = forest.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies, r.n_linked_texts) for r in got.collect()} == {k: v for (k, _), v in want.items()}


def test_prefixes_of_linked_sets_meet():
    """Any two sets of at least the threshold share a first shingle, whatever shingles are common."""
    rng = np.random.default_rng(3)
    for t in (0.5, 0.8, 0.95):
        for n in (1, 2, 5, 9, 40, 131):
            for _ in range(20):
                pool = np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.int64).astype(np.uint64))
                common = np.sort(rng.choice(pool, len(pool) // 3, replace=False)), rng.integers(3, 9, len(pool) // 3)
                a = np.sort(pool[:n])
                lost = rng.integers(0, n // 3 + 1)
                b = np.sort(np.concatenate([rng.permutation(a)[lost:], pool[n : n + rng.integers(0, n // 3 + 1)]]))
                both = len(np.intersect1d(a, b))
                if both and both >= t * (len(a) + len(b) - both):
                    assert np.intersect1d(forest.prefix(a, t, common), forest.prefix(b, t, common)).size


def test_first_shingles_leave_python_in_small_batches(monkeypatch):
    """A batch of documents with many first shingles, one very long among them, is no batch of all of these."""
    monkeypatch.setattr(forest, "PIECE", 50)
    sizes = [3, 0, 20, 20, 20, 170, 0, 1, 49, 50, 51]
    tokens = [np.arange(s, dtype=np.int64) + 1000 * i for i, s in enumerate(sizes)]
    cols = [np.arange(len(sizes)) + k for k in (0, 100, 200)]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array([t.tobytes() for t in tokens], pa.binary())], ["node", "n", "root", "prefix"])
    made = list(forest.spread(iter([batch, batch.slice(4, 3), batch.slice(0, 0)])))
    assert max(b.num_rows for b in made) == 50
    want = [(int(t), *(int(c[i]) for c in cols)) for i in [*range(len(sizes)), 4, 5, 6] for t in tokens[i]]
    assert [tuple(r.values()) for b in made for r in b.to_pylist()] == want


def test_lean_drops_a_kept_model():
    """A worker that goes on to another operator does not keep the model before; results pass as they are."""
    vec.worker_slot("model", lambda: 1)
    assert list(vec.lean(iter, model=True)([1, 2])) == [1, 2] and "model" in vec._SLOT
    assert list(vec.lean(iter)([1, 2])) == [1, 2] and not vec._SLOT
