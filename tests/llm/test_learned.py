"""Language identification and toxicity: held-out results and defined cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import langid, queries, toxicity


@pytest.fixture(scope="module")
def langs(docs):
    return langid.fit(docs, usable=~langid.held_out("doc_id"))


def test_language_held_out(docs, langs, none):
    rows = langid.predict(docs, langs).withColumn("held_out", langid.held_out("doc_id")).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang and sum(c.isalpha() for c in r.text or "") > 20]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    for r in rows:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert langid.predict(docs, langs).count() == docs.count()
    assert langid.predict(none, langs).count() == 0


def test_mixed_text_has_spans(langs, docs):
    by = {lang: next(r.text for r in docs.where(F.col("lang") == lang).where("n_chars > 400").collect()) for lang in ("en", "de")}
    text = " ".join(by["en"].split()[:60] + by["de"].split()[:40])
    (lang, score, spans), *_ = langs.predict([text])
    assert lang == "en" and spans == 2 and 0.4 < score < 0.9


def test_spans_of_mixed_text(spark, docs, langs):
    by = {lang: next(r.text for r in docs.where(F.col("lang") == lang).where("n_chars > 400").collect()) for lang in ("en", "de")}
    en, de = (" \n".join(by[k].split()[:50]) for k in ("en", "de"))
    texts = [f" 𝄞 {en}\t{de} 12 ", en, "", None, " 12ab/x1 3 ", f"{de} {en} {de}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in langid.predict(rows, langs).collect()}
    (a, b, first), (c, d, second) = found[0]
    assert (a, first, d, second) == (1, "en", len(texts[0]) - 1, "de") and c == b + 1 and abs(b - len(en) - 3) <= 20
    assert found[1] == [(0, len(en), "en")] and found[2] == found[3] == []
    assert [s[:2] for s in found[4]] == [(1, 8)]
    assert [s[2] for s in found[5]] == ["de", "en", "de"]
    assert [(x[0], x[2]) for x in langs.predict([t or "" for t in texts])] == [(x[0], len(x[2])) for x in langs.label([t or "" for t in texts])]


@pytest.mark.parametrize("span", [1, 2, 3, 256])
def test_viterbi_is_the_best_path(span):
    rng = np.random.default_rng(1)
    scores = rng.normal(0, 2, (40, 3)).astype(np.float32)
    size = np.array([5, 0, 7, 1, 6])
    row = rng.integers(0, 40, size.sum())
    path, changes = langid.viterbi(scores, row, size, 1.5, span)

    def value(words, labels):
        return sum(scores[w, k] for w, k in zip(words, labels)) - 1.5 * sum(a != b for a, b in zip(labels, labels[1:]))

    at = 0
    for n, c in zip(size, changes):
        words, got = row[at : at + n], path[at : at + n].tolist()
        if n:
            best = max(value(words, [int(x) for x in np.base_repr(k, 3).zfill(n)]) for k in range(3**n))
            assert value(words, got) == pytest.approx(best, abs=1e-4)
        assert c == sum(a != b for a, b in zip(got, got[1:]))
        at += n


def test_viterbi_memory_is_bounded(monkeypatch):
    """With many labels spans grow instead of tables; the path stays the same."""
    rng = np.random.default_rng(7)
    scores = rng.normal(0, 2, (50, 40)).astype(np.float32)
    size = np.array([900, 3, 0, 2000])
    row = rng.integers(0, 50, size.sum())
    wide = langid.viterbi(scores, row, size, 3.0)
    monkeypatch.setattr(langid, "SPAN_CELLS", 16_000)
    narrow = langid.viterbi(scores, row, size, 3.0)

    def value(path):
        doc = np.repeat(np.arange(4), size)
        return sum(scores[row, path]) - 3.0 * ((path[1:] != path[:-1]) & (doc[1:] == doc[:-1])).sum()

    assert value(wide[0]) == pytest.approx(value(narrow[0]), rel=1e-5)


def test_sentences_without_spaces_count():
    assert langid.letters("我们在2024年去了北京") == "我们在年去了北京"
    assert langid.letters("user7") == langid.letters("a@b.c") == "" and langid.letters("日本/usr/bin") == "日本"


def test_null_id_and_very_long_text(spark, docs, langs):
    long = " ".join(next(r.text for r in docs.where("lang = 'en'").where("n_chars > 400").collect()).split()[:40] * 20_000)
    rows = spark.createDataFrame([(None, "x"), (1, long)], "doc_id long, text string")
    found = {r.doc_id: r for r in langid.predict(rows, langs).withColumn("held_out", langid.held_out("doc_id")).collect()}
    assert found[None].held_out is False and found[1].lang_pred == "en" and len(found[1].spans) == 1
    scored = {r.doc_id: r for r in toxicity.score(rows, toxicity.Model(["idiot"], np.array([9.0]), -5.0)).withColumn("held_out", toxicity.held_out("doc_id")).collect()}
    assert scored[None].held_out is False and scored[1].predicted == 0


def test_scripts_narrow(spark):
    rows = [(i, t, lang) for i in range(60) for t, lang in ((f"слово текст пример {i}", "ru"), (f"word text example {i}", "en"))]
    df = spark.createDataFrame([(k, t, lang) for k, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    m = langid.fit(df)
    assert [p[0] for p in m.predict(["неизвестно", "unknown", "123", ""])] == ["ru", "en", "und", "und"]


def test_unlearned_languages_go(spark, docs, langs):
    rng = np.random.default_rng(5)
    noise = " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(3, 10))) for _ in range(60))
    good = next(r.text for r in docs.where("lang = 'en'").where("n_chars > 400").collect())
    real = "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood."
    russian, chinese = "Все люди рождаются свободными и равными в своем достоинстве и правах", "人人生而自由 在尊严和权利上一律平等"
    texts = [russian, chinese, noise, f"{russian} {russian} words of text", good, real, f"{good} {chinese}"]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.lang for r in langid.keep(df, langs, least=0.2).collect()}
    assert kept == {4: "en", 5: "en", 6: "en"}
    assert [r.score for r in langid.predict(df, langs).orderBy("doc_id").collect()[:4]] == [0.0] * 4


def test_no_labels(docs):
    m = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predict(docs, m).collect()} == {"und"}
    empty = toxicity.fit(docs, docs.select("doc_id", F.lit(0).alias("toxic")))
    assert {r.predicted for r in toxicity.score(docs, empty).collect()} == {0}


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in queries.op9_toxicity(spark, d).collect()}
    assert len(rows) == docs.count()
    words = {"idiot", "scum", "moron", "worthless", "pathetic", "clown", "disgusting", "loser", "stupid", "trash"}
    stems = {"réeux~", "achlich~", "bomente~"}  # toxic words of the other languages begin like this
    found = {r.doc_id: toxicity.words(r.text) for r in docs.collect()}
    toxic = [k for k, x in found.items() if len(words & x) >= 2]
    clean = [k for k, x in found.items() if not (words | stems) & x]
    assert np.mean([rows[k].predicted for k in toxic]) > 0.9
    assert np.mean([rows[k].predicted for k in clean]) < 0.02
    held = [(rows[r.doc_id].score, r.toxic) for r in labels.collect() if rows[r.doc_id].held_out]
    good, bad = [s for s, t in held if not t], [s for s, t in held if t]
    assert all(0 <= s <= 1 for s, _ in held) and len(bad) >= 5
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.8 and np.mean([b >= 0.5 for b in bad]) > 0.6 and np.mean([g >= 0.5 for g in good]) < 0.06


def test_toxicity_cases(docs, none):
    labels = docs.select("doc_id", F.when(F.col("text").contains("idiot"), 1).otherwise(0).alias("toxic"))
    m = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, m).collect()
    assert len(rows) == docs.count() and all(r.predicted == int(r.score >= 0.5) for r in rows)
    same = [r.score for r in rows if r.doc_id in (10_021, 10_022)]
    assert same[0] == same[1]
    assert toxicity.score(none, m).count() == 0


def test_slope_is_that_of_the_risk():
    """Parts of the risk by their definition, and the gradient by differences, on both sides of zero."""
    rng = np.random.default_rng(9)
    x_p, x_u = (rng.random((n, 6)) for n in (40, 90))
    loss = lambda z: np.log1p(np.exp(-z)).mean()
    sides = set()
    for prior in (0.1, 0.5, 0.9):
        for _ in range(20):
            theta = rng.normal(0, 3, 7)

            def parts(t):
                g_p, g_u = x_p @ t[:-1] + t[-1], x_u @ t[:-1] + t[-1]
                return prior * loss(g_p), loss(-g_u) - prior * loss(-g_p)

            positive, negative, grad = toxicity.risk_slope(theta, x_p, x_u, prior)
            assert (positive, negative) == pytest.approx(parts(theta), abs=1e-4)
            whole = (lambda t: sum(parts(t))) if negative >= 0 else (lambda t: -parts(t)[1])
            steps = np.eye(7) * 1e-5
            assert grad == pytest.approx([(whole(theta + d) - whole(theta - d)) / 2e-5 for d in steps], abs=1e-4)
            sides.add(negative >= 0)
    assert sides == {True, False}


def test_risk_stays_non_negative():
    rng = np.random.default_rng(3)
    p = (rng.random((200, 30)) < np.r_[np.full(5, 0.6), np.full(25, 0.1)]).astype(np.float32)
    u = (rng.random((800, 30)) < 0.1).astype(np.float32)
    u[:80] = (rng.random((80, 30)) < np.r_[np.full(5, 0.6), np.full(25, 0.1)]).astype(np.float32)
    w, b = toxicity.train(p, u, 0.1, 1)
    g = lambda x: 1 / (1 + np.exp(-(x @ w + b)))
    assert g(p).mean() > 0.6 and g(u[80:]).mean() < 0.1
