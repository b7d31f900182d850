"""The corpus pipeline against what its operators say."""

import numpy as np
import public_tokenizers

import corpus_pipeline as C
from plumbline.llm import forest, graph, langid, pii, queries, toxicity
from tests.llm.test_forest import brute, near_copies


def test_stages(spark, docs, sf_dir):
    plain = docs.select(*C.COLUMNS)
    kept = docs
    for name, stage in C.STAGES[:-1]:
        before = {r.doc_id: r for r in kept.collect()}
        kept = spark.createDataFrame(stage(spark, kept, sf_dir).collect(), plain.schema)
        after = {r.doc_id: r for r in kept.collect()}
        assert after.keys() <= before.keys()
        gone = before.keys() - after.keys()
        now = spark.createDataFrame(list(before.values()), docs.schema if name == "language" else plain.schema)
        if name == "language":
            m = langid.fit(now, usable=~langid.held_out("doc_id"))
            assert gone == {r.doc_id for r in langid.predict(now, m).collect() if r.lang_pred == "und" or r.score < C.SURE}
            assert all(r.lang for r in after.values()) and 5 <= len(gone) < 25
        elif name == "near_duplicates":
            found = {r.doc_id: r.class_id for r in forest.join(now).collect()}
            assert gone == {k for k, c in found.items() if k is not None and k != c} and gone
        elif name == "personal_data":
            assert not gone and any(r.text != before[k].text for k, r in after.items())
            for k, r in after.items():
                assert r.text == pii.redact(before[k].text, pii.find(before[k].text)) and r.n_chars == len(r.text)
        elif name == "toxicity":
            assert len(gone) < len(before) / 2
    pieces = C.STAGES[-1][1](spark, kept, sf_dir).toPandas()
    assert set(pieces.doc_id) == {r.doc_id for r in kept.collect()}


def test_near_duplicates_by_brute_force(spark, sf_dir):
    """One document of each group stays, by all pairs of shingle sets and not by the operator."""
    texts = near_copies(130, seed=4)
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts] + [(texts[0][0], texts[0][1], "en", "s", 1), (None, "null id", "en", "s", 7), (None, "null id", "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.doc_id for r in dict(C.STAGES)["near_duplicates"](spark, docs, sf_dir).collect()]
    classes = brute(texts)
    assert sorted(k for k in kept if k is not None) == sorted({c for c, *_ in classes.values()}) and kept.count(None) == 2


def test_near_duplicates_with_one_id_and_several_texts(spark, sf_dir):
    """Rows that share an id and differ are documents of their own; none is lost, copies of other ids go."""
    a, b, c, d = ("one two three four five six", "seven eight nine ten eleven twelve", "red green blue black white grey", "north south east west up down")
    rows = [(3, a), (5, a), (5, b), (6, c), (6, d), (None, b), (None, b), (6, d)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r.doc_id, r.text) for r in dict(C.STAGES)["near_duplicates"](spark, docs, sf_dir).collect()), key=str)
    assert kept == sorted([(3, a), (5, b), (6, c), (6, d), (None, b), (None, b)], key=str)


def test_last_stages_by_plain_code(spark, sf_dir):
    """Personal data by plain patterns, tokens by the library: what is left is in the pieces, once."""
    from tokenizers import Tokenizer

    said = ["call +1 (389) 555-5010 now", "a.b@c.de wrote to x@y.org", "from 10.1.2.3 to 999.1.1.1", "card 4111 1111 1111 1111 of it", "nothing here", None, "IBAN GB82 WEST 1234 5698 7654 32 paid", "end <|endoftext|> mark"]
    gone = ["call [PHONE] now", "[EMAIL] wrote to [EMAIL]", "from [IP] to 999.1.1.1", "card [CARD] of it", "nothing here", None, "IBAN [IBAN] paid", "end <|endoftext|> mark"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(said)], "doc_id long, text string, lang string, source string, n_chars long")
    clean = dict(C.STAGES)["personal_data"](spark, docs, sf_dir)
    assert [(r.text, r.n_chars) for r in clean.orderBy("doc_id").collect()] == [(t, None if t is None else len(t)) for t in gone]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = dict(C.STAGES)["packing"](spark, clean, sf_dir).toPandas()
    for key, g in pieces.sort_values("start").groupby("doc_id"):
        assert np.frombuffer(b"".join(g.ids), "<u4").tolist() == [*t.encode(gone[int(key)] or "", add_special_tokens=False).ids, 1]
    assert set(pieces.doc_id) == set(range(len(said)))


def test_clean_documents_stay(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in C.toxic(spark, docs, d).collect()}
    assert gone == {r.doc_id for r in queries.op9_toxicity(spark, d).collect() if r.predicted}
    marked = {r.doc_id for r in docs.collect() if {"idiot", "moron", "scum", "trash", "clown"} & toxicity.words(r.text)}
    assert len(gone - marked) < 0.06 * docs.count()
    assert C.language(spark, docs, d).count() >= 0.99 * docs.count()


def test_run(spark, sf_dir):
    made = C.run(spark, sf_dir)
    assert len(graph.tables_of(made)) == 1  # no table of an earlier stage is left in the plan
    pieces = made.toPandas()
    assert len(pieces) and pieces.groupby("sequence_id").length.sum().max() <= 2048


def test_empty_tables(spark, none, sf_dir):
    docs = none
    for _, stage in C.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
