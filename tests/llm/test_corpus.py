"""Mixing, spelling variants and source divergence against plain code."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.llm import divergence, graph, mixing, queries, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """Rows (doc_id, text, lang, source) as documents, with other columns whose names clash."""
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    for c in ("row", "src", "size", "start", "k", "s", "word", "n", "term", "p", "id", "h", "key"):
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(3)


def plain_targets(sizes):
    """The contract's rule with fractions: share, stop at three times, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), dict.fromkeys(order, Fraction(0)), list(order)
    excess = Fraction(total)
    while excess and open_:
        part = excess / sum(weight[s] for s in open_)
        for s in open_:
            target[s] += part * weight[s]
        excess = Fraction(0)
        for s in list(open_):
            if target[s] > 3 * sizes[s]:
                excess += target[s] - 3 * sizes[s]
                target[s] = Fraction(3 * sizes[s])
                open_.remove(s)
    return target


def mixed_rows(seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 60))), "en", "hot") for i in range(300)]
    rows += [(1000 + i, "a b c d", "en", s) for i, s in enumerate(["b", "b", None, "", "ä", "z", "z", "hot"])]
    rows += [(2000, None, None, "void"), (2001, " \t\n", "en", "void"), (None, "null id here", "en", "b"), (None, "null id here", "en", "b"), (5, "same id, other text", "en", "hot"), (5, None, "en", "a")]
    rows += [(3000, "v " * 300_000, "en", "long"), (3001, "x" * 1_000_000, "en", None)]
    return rows


@pytest.mark.parametrize("block", [7, 1024])
def test_mix(spark, block):
    rows = mixed_rows(1)
    df = frame(spark, rows)
    documents, pieces = mixing.mix(df, block=block)
    docs = documents.toPandas()
    cut = pieces.toPandas()
    size = Counter()
    for _, text, _, source in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    target = plain_targets(size)
    assert len(docs) == len(rows) and docs.row.is_unique
    for r in docs.itertuples():
        s = None if pd.isna(r.source) else r.source
        assert r.source_size == size[s] and abs(r.target - float(target[s])) < 1e-6 * max(1, target[s])
    # Slots are whole blocks without gaps; a source's last one may be short.
    for (_, k), g in cut.groupby(["s", "k"]):
        g = g.sort_values("offset")
        assert g.slot.nunique() == 1 and g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= block
    ranks = cut.groupby("s").agg(n=("k", "nunique"), last=("k", "max"), words=("length", "sum"))
    assert (ranks.n == ranks["last"] + 1).all()
    assert all(g.drop_duplicates("k").sort_values("slot").k.is_monotonic_increasing for _, g in cut.groupby("s"))
    assert cut.groupby("slot").s.nunique().max() == 1
    # Words: the target to a word, no document more than three times, epochs whole.
    got = cut.groupby("row").length.sum()
    docs["taken"] = docs.row.map(got).fillna(0)
    for s, g in docs.groupby("source", dropna=False):
        s = None if pd.isna(s) else s
        assert abs(g.taken.sum() - float(target[s])) <= 0.5 + 1e-6
    assert (docs.taken <= 3 * docs["size"]).all()
    for _, g in cut.groupby(["row", "epoch"]):
        g = g.sort_values("start")
        assert g.start.tolist() == [0, *g.length.cumsum()[:-1]]


def test_mix_is_even_and_stable(spark):
    rows = [(i, "w " * 100, "en", "abc"[i % 3]) for i in range(300)]
    documents, pieces = mixing.mix(frame(spark, rows), block=50)
    slots = pieces.select("slot", "s").distinct().toPandas().sort_values("slot").s.tolist()
    for n in range(50, len(slots), 50):  # every beginning of the mix is near the weights
        for s, w in enumerate((5, 2, 1)):
            assert abs(slots[:n].count(s) - n * slots.count(s) / len(slots)) < 8, (n, s, w)
    first, again = (sorted(mixing.taken(*mixing.mix(frame(spark, rows).repartition(n))).toPandas().itertuples(index=False, name=None)) for n in (1, 5))
    assert first == again


def test_mix_against_its_sql(spark):
    rows = mixed_rows(2)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    told = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2], r[3], round(r[4], 6), r[5])
    want = con.execute(f"SELECT doc_id, source, size, source_size, target, taken FROM ({mixing.ORACLE_SQL})").fetchall()
    got = mixing.taken(*mixing.mix(frame(spark, rows))).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(told, got)) == sorted(map(told, want))


def test_running(spark):
    """Sums over the rows before, with a group that fills all partitions of the sort."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randint(0, 9)}", i, rng.randint(0, 5)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(6)
    got = {(r.g, r.i): r.start for r in graph.running(df, "g", ["i"], "v", graph.Scratch(spark)).collect()}
    want, sums = {}, Counter()
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        want[g, i] = sums[g]
        sums[g] += v
    assert got == want


def plain_words(rows):
    n = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            n[low] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_variants(rows):
    n = plain_words(rows)
    near = defaultdict(list)
    for a in n:
        for b in n:
            if one_edit(a, b):
                near[a].append(b)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 2 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w) or "", root(w), n[w], len(near[w]), n[form[w]] if w in form else -1) for w in n)


def variant_rows(seed, letters):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(60)]
    pool = []
    for w in base:
        for _ in range(12):
            v = list(w)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                i = rng.randrange(len(v) + 1)
                rng.choice([lambda: v.insert(i, rng.choice(letters)), lambda: v and v.pop(min(i, len(v) - 1)), lambda: v and v.__setitem__(min(i, len(v) - 1), rng.choice(letters))])()
            pool.append("".join(v))
    weights = [1 / (1 + i % 12) ** 2 for i in range(len(pool))]
    return [(i, " ".join(rng.choices(pool, weights, k=60)), "en", "s") for i in range(150)]


@pytest.mark.parametrize(("seed", "letters"), [(1, "ab"), (2, "abcdefgh"), (3, "aAbBéÉßÿ×÷"), (4, "aab")])
def test_variants(spark, seed, letters, monkeypatch):
    if seed % 2 == 0:
        monkeypatch.setattr(spelling, "HOT", 7)  # keys dealt in blocks
    rows = variant_rows(seed, letters) + [(None, "Straße straße STRASSE x1y banana-banana", None, None)] * 4 + [(9, None, "en", "s"), (9, "", "en", "s"), (10, "Ärger ärger ärger ärger ÄRGER", "de", "s")]
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in spelling.variants(frame(spark, rows)).collect())
    want = plain_variants(rows)
    assert got == want and len(want) > 40 and sum(1 for x in want if x[1]) > 10


def test_variant_chains(spark):
    """Roots several forms away, and many words of one root."""
    rng, chain = random.Random(5), ["qwertyuiop"]
    for i in range(9):
        chain.append(chain[-1][:i] + "zxcvbnmlkj"[i] + chain[-1][i + 1 :])
    rows = [(i, " ".join([w] * (3 * 2**i)), "en", "s") for i, w in enumerate(chain)]
    rows += [(100 + i, " ".join([chain[-1][:k] + c + chain[-1][k + 1 :]] * 3), "en", "s") for i, (k, c) in enumerate((rng.randrange(10), rng.choice("éèêà")) for _ in range(30))]
    got = {r.word: r for r in spelling.variants(frame(spark, rows)).collect()}
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in got.values()) == plain_variants(rows)
    assert len({r.root for r in got.values()}) < 4


def test_every_near_pair_meets():
    """The three rarest bigrams of near words share a key, whatever the order of the bigrams."""
    rng = random.Random(6)
    for _ in range(4000):
        letters = rng.choice(["ab", "abc", "abcdefghij"])
        a = "".join(rng.choice(letters) for _ in range(rng.randint(5, 12)))
        i, c = rng.randrange(len(a)), rng.choice(letters)
        b = rng.choice([a[:i] + c + a[i + 1 :], a[:i] + c + a[i:], a + c])
        if a == b:
            continue
        number = defaultdict(lambda: rng.randint(0, 3))
        for w in (a, b):
            for p in range(len(w) - 1):
                number[w[p : p + 2]]
        ka, kb = ({k for k, s in spelling.keys_of(w, number) if s != side} for w, side in ((a, 2), (b, 1)))
        assert ka & kb, (a, b)


def test_long_texts(spark, monkeypatch):
    """Texts beyond a run, cut between words; one word longer than a run."""
    text = "Straße éclair " * 150_000 + "x" * 1_500_000 + " " + "tail " * 10
    assert spelling.words(text.encode()) == Counter(re.findall("[a-zß-ÿ]{5,}", text.lower()))
    monkeypatch.setattr(divergence, "RUN", 1000)
    parts = list(divergence.runs(text.encode()))
    assert b"".join(parts) == text.encode().translate(divergence._CLEAN) and Counter(w for p in parts for w in p.split()) == Counter(text.lower().encode().split())


def plain_audit(rows, least):
    terms = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    df, groups = Counter(), defaultdict(Counter)
    for _, text, lang, source in rows:
        found = terms(text)
        df.update({(lang or "", t) for t in found})
        groups[lang or "", source or ""].update(found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in df.items() if x == lang and n >= least]
        own = {s: {t: c[t] for t in kept} for (x, s), c in groups.items() if x == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p = {s: share(c) for s, c in own.items()}
        q = share({t: sum(c[t] for c in own.values()) for t in kept})
        for s in own:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            over = [(q[t] - p[s][t], t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(over)[:50])):
                out += [(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def audit_rows():
    rng = random.Random(8)
    word = [f"{'wxyzé漢'[i % 6]}{'abcdefghij'[i // 6 % 10]}{'KLMNOP'[i // 60 % 6]}" for i in range(360)]
    rows = []
    for i in range(400):
        lang, source = rng.choice(["en", "en", "en", "de", None]), rng.choice(["hot", "hot", "a", "b", None, "é", "z"])
        own = word[: 360 if lang == "en" else 120]
        rows.append((i, rng.choice([" ", "-", "\n", "\x7f", "1", "_"]).join(rng.choices(own, [1 / (1 + j + len(source or "")) for j in range(len(own))], k=rng.randint(0, 80))), lang, source))
    rows += [(500, None, "en", "only null"), (501, "", "fr", "a"), (502, "rare words", "fr", "b"), (503, "x" * 50, "fr", "c"), (500, rows[0][1], *rows[0][2:]), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("shard", [divergence.SHARD, 40])
def test_audit(spark, shard, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD", shard)  # small ones: several passes
    rows = audit_rows()
    for least in (30, 3):
        got = sorted(tuple(r) for r in divergence.audit(frame(spark, rows), least=least).select("lang", "source", "part", "item", "value", "rank").collect())
        assert got == plain_audit(rows, least)
    assert any(r[2] == "term" and r[5] == 50 for r in got)


def test_padded_terms_share_their_delimiter():
    built, terms, kept = divergence.automaton([("en", "a"), ("en", "ab"), ("de", "é")])
    found = Counter(terms[i].as_py() for _, i in built.iter(" ".encode().decode("latin-1") + " a a ab aab é é ".encode().decode("latin-1")))
    assert found == {"a": 2, "ab": 1, "é": 2} and kept["de"].tolist() == [False, False, True]


def test_empty_tables(spark, none):
    assert mixing.taken(*mixing.mix(none)).count() == spelling.variants(none).count() == divergence.audit(none).count() == 0


def test_native(spark, sf_dir):
    plan = queries.op11_source_mixing(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapInArrow", plan)
