"""Encoding, decoding and packing against the public libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import bpe, packing

PATH = P.path("byte_bpe_multi_50k.tiktoken")
FILES = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def ids(b):
    return np.frombuffer(b, "<u4").tolist()


def test_round_trip(docs, texts, none, library):
    rows = bpe.round_trip(docs, PATH, P.PATTERN).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.round_trip(none, PATH, P.PATTERN).count() == 0


def test_encode_then_decode(docs, texts):
    rows = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert len(rows) == docs.count() and all(bytes(r.decoded) == texts[r.doc_id].encode() for r in rows)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200) | st.text("ab \n\t's!é1  \x1c\x85", max_size=150))
def test_any_text(text):
    import tiktoken

    b = bpe.loaded(PATH, P.PATTERN)
    lib = test_any_text.__dict__.setdefault("lib", tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.ranks, special_tokens={}))
    got = b.encode([text])[0]
    assert ids(got) == lib.encode_ordinary(text)
    assert b.decode(np.frombuffer(got, "<u4")) == text.encode()


def test_row_trees_equal_one_tree():
    b = bpe.loaded(PATH, P.PATTERN)
    words = [bytes(np.random.default_rng(i).integers(97, 101, i % 63 + 2, dtype=np.uint8)) for i in range(300)]
    for w in words:
        width = max(2, 1 << (len(w) - 1).bit_length())
        assert b._merge_rows([w], width)[0] == b._merge_long(w)


def test_long_token(library):
    text = "abcdefgh" * 4000
    assert ids(bpe.loaded(PATH, P.PATTERN).encode([text])[0]) == library.encode_ordinary(text)


def test_packing(spark, docs, texts, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    marked = spark.createDataFrame([(20_000, "hello <|endoftext|> world"), (20_001, "<|endoftext|><|endoftext|>\n x"), (20_002, "a  b<|endoftext|> ")], "doc_id long, text string")
    docs = docs.unionByName(marked, allowMissingColumns=True)
    texts = texts | {r.doc_id: r.text for r in marked.collect()}
    pieces = packing.pack(docs, *FILES).toPandas()
    ended = pieces[pieces.doc_id == 20_000].sort_values("start")
    assert ids(b"".join(ended.ids)) == [31373, 220, 50256, 995, 1]
    copies = {r.doc_id: r.n for r in docs.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    for key, g in pieces.groupby("doc_id"):
        want = np.array([*t.encode(texts[key], add_special_tokens=False).ids, 1], "<u4")
        assert (g.doc_tokens == len(want)).all() and g.length.sum() == len(want) * copies[key]
        for r in g.itertuples():
            assert zlib.crc32(want[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        if copies[key] == 1:
            g = g.sort_values("start")
            assert g.start.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    assert set(pieces.doc_id) == set(texts)
    padding = 0
    for _, g in pieces.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
        n = int(g.length.sum())
        assert n <= 2048
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding <= 2048 * docs.rdd.getNumPartitions()
    assert packing.pack(none, *FILES).count() == 0


def test_packing_returns_ids(docs, texts):
    import tiktoken

    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(FILES[1]), special_tokens={})
    copies = docs.groupBy("doc_id").count().where("count = 1").select("doc_id")
    pieces = packing.pack(docs.join(copies, "doc_id", "left_semi"), *FILES).toPandas()
    assert (pieces.ids.map(len) == 4 * pieces.length).all() and (pieces.ids.map(zlib.crc32) == pieces.ids_crc32).all()
    for key, g in pieces.sort_values("start").groupby("doc_id"):
        assert ids(b"".join(g.ids)) == [*t.encode_ordinary(texts[key]), 1]
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert len(b"".join(g.ids)) <= 4 * g.tier.iloc[0]


def test_any_ids():
    """Texts of odd white space, letters and end marks, against the library with its default settings."""
    from tokenizers import Tokenizer

    t, ours = Tokenizer.from_file(FILES[0]), packing.Ids(*FILES)
    rng = np.random.default_rng(6)
    parts = [*"ab é  \n\t\x1c\x85'sS1.漢", "<|endoftext|>", "　", " 's", "don't ", "<|endof", " w" * 3, "x" * 200]
    for _ in range(3000):
        text = "".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 40)))
        assert ids(ours.encode(text)) == t.encode(text, add_special_tokens=False).ids


def test_step_groups_are_even():
    p = packing.Pools(2048, 64, 0, 1 << 22, 1 << 14)
    rng = np.random.default_rng(2)
    for k, n in enumerate(rng.integers(1, 5000, 400).tolist()):
        p.add(k, np.arange(n, dtype="<u4").tobytes())
    p.pack(True)
    load, tier = {}, {}
    for *_, sequence, _, size, group in p.rows:
        tier[sequence] = (group, size)
    for group, size in tier.values():
        load[group] = load.get(group, 0) + size
    assert len(load) > 10 and max(load.values()) - min(load.values()) <= 2048


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 6000), max_size=60), st.integers(2000, 20_000))
def test_pools(sizes, pool):
    p = packing.Pools(2048, 64, 0, pool, 1 << 14)
    for k, n in enumerate(sizes):
        p.add(k, np.arange(n, dtype="<u4").tobytes())
    p.pack(True)
    seen = {}
    for key, start, length, *_ in p.rows:
        seen.setdefault(key, []).append((start, length))
    for k, n in enumerate(sizes):
        at = 0
        for start, length in sorted(seen[k]):
            assert start == at
            at += length
        assert at == n
    tokens = {}
    for _, _, length, _, _, sequence, *_ in p.rows:
        tokens[sequence] = tokens.get(sequence, 0) + length
    assert sum(n & (n - 1) != 0 for n in tokens.values()) <= 1
