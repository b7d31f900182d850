"""Byte-level BPE encoding and decoding with a segment tree per pre-token.

Each pre-token is a row of byte positions.  A segment tree over the positions
holds the key ``rank * width + position`` of the pair that starts there, so the
root is the lowest rank and, among equals, the leftmost.  A merge changes three
leaves (the pair, its right part, its left neighbour) and their ancestors.

Pre-tokens of up to 64 bytes are merged many at a time, one tree per matrix row;
longer ones use one tree each, in O(n log n).  Results of words are kept in
bounded caches.

Defined cases: null and empty texts encode to no ids.  Texts of any length are
encoded whole.  Each row is encoded on its own, repeated ones too.  Other columns
are ignored, whatever their names; an empty table has no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from plumbline.llm import vec

INF = 1 << 50
_UNSAFE = re.compile(r" (?:\s|\Z)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairRanks:
    """Open-addressing table from a pair of ids to the rank of its merge."""

    BITS = 21

    def __init__(self, ranks: dict[bytes, int]):
        left, right, value = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a = ranks.get(token[:k])
                if a is not None:
                    b = ranks.get(token[k:])
                    if b is not None:
                        left.append(a)
                        right.append(b)
                        value.append(rank)
        keys = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        self.keys = np.full(1 << self.BITS, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << self.BITS, INF, np.int64)
        self.scalar = dict(zip(keys.tolist(), value))
        pending, slot, value = keys, self._slot(keys), np.array(value, np.int64)
        while len(pending):
            free = self.keys[slot] == np.iinfo(np.uint64).max
            self.keys[slot[free]] = pending[free]
            won = self.keys[slot] == pending
            self.values[slot[won]] = value[won]
            pending, value, slot = pending[~won], value[~won], (slot[~won] + 1) & ((1 << self.BITS) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, INF where the pair never merges."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        slot = self._slot(keys)
        out = np.full(len(keys), INF, np.int64)
        at = np.arange(len(keys))
        while len(at):
            got = self.keys[slot]
            hit = got == keys
            out[at[hit]] = self.values[slot[hit]]
            go = ~hit & (got != np.iinfo(np.uint64).max)
            at, keys, slot = at[go], keys[go], (slot[go] + 1) & ((1 << self.BITS) - 1)
        return out


class ByteBPE:
    """Encoder and decoder for one rank file and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 400_000):
        self.ranks, self.cache = ranks, cache
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.pairs = PairRanks(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.names = [str(i) for i in range(len(self.tokens))]
        self.by_piece: dict[str, bytes] = {}
        self.by_word: dict[str, bytes] = {}

    # -- merging ----------------------------------------------------------

    def _merge_rows(self, words: list[bytes], width: int) -> list[bytes]:
        n, bits, none = len(words), width.bit_length() - 1, np.int64(2**31 - 1)
        size = np.array([len(w) for w in words])
        col = np.arange(width)
        inside = col < size[:, None]
        sym = np.full((n, width + 1), none, np.int64)
        sym[:, :width][inside] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(np.append(col + 1, width), (n, 1))
        after[:, :width][~(col + 1 < size[:, None])] = width
        before = np.tile(np.append(col - 1, width), (n, 1))
        before[:, 0] = width
        tree = np.full((n, 2 * width), INF, np.int64)
        has = col[:-1] + 1 < size[:, None]
        rank = self.pairs.find(sym[:, : width - 1][has], sym[:, 1:width][has])
        tree[:, width:-1][has] = np.where(rank < INF, (rank << bits) + np.broadcast_to(col[:-1], has.shape)[has], INF)
        lo = width >> 1
        while lo:
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
            lo >>= 1
        flat, symf, afterf, beforef = tree.ravel(), sym.ravel(), after.ravel(), before.ravel()
        rows = np.arange(n)
        while True:
            root = flat[rows * (2 * width) + 1]
            live = root < INF
            rows, root = rows[live], root[live]
            if not len(rows):
                break
            base, top = rows * (width + 1), rows * (2 * width)
            p, new = root & (width - 1), root >> bits
            q = afterf[base + p]
            r = afterf[base + q]
            left = beforef[base + p]
            symf[base + p], symf[base + q] = new, none
            afterf[base + p] = r
            beforef[base + r] = p
            rank = self.pairs.find(np.concatenate([new, symf[base + left]]), np.concatenate([symf[base + r], new]))
            k = len(rows)
            own, prev = rank[:k], rank[k:]
            at = np.concatenate([q, p, np.where(left < width, left, q)])
            top3 = np.concatenate([top, top, top])
            flat[top3 + width + at] = np.concatenate([np.full(k, INF), np.where(own < INF, (own << bits) + p, INF), np.where((prev < INF) & (left < width), (prev << bits) + left, INF)])
            at = (at + width) >> 1
            for _ in range(bits):
                x = top3 + 2 * at
                flat[top3 + at] = np.minimum(flat[x], flat[x + 1])
                at >>= 1
        keep = sym[:, :width] != none
        ids = sym[:, :width][keep].astype("<u4").tobytes()
        ends = (np.cumsum(keep.sum(1)) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def _merge_long(self, word: bytes) -> bytes:
        n = len(word)
        width = 1 << (n - 1).bit_length()
        bits, find = width.bit_length() - 1, self.pairs.scalar.get
        sym = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [INF] * (2 * width)
        for i in range(n - 1):
            rank = find(sym[i] << 32 | sym[i + 1])
            if rank is not None:
                tree[width + i] = (rank << bits) + i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, key: int) -> None:
            i += width
            tree[i] = key
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                least = a if a < b else b
                if tree[i] == least:
                    return
                tree[i] = least

        while tree[1] < INF:
            p, new = tree[1] & (width - 1), tree[1] >> bits
            q = after[p]
            r, left = after[q], before[p]
            sym[p], sym[q] = new, -1
            after[p] = r
            put(q, INF)
            rank = None
            if r < n:
                before[r] = p
                rank = find(new << 32 | sym[r])
            put(p, INF if rank is None else (rank << bits) + p)
            if left >= 0:
                rank = find(sym[left] << 32 | new)
                put(left, INF if rank is None else (rank << bits) + left)
        return np.array([s for s in sym if s >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each pre-token, as little-endian unsigned 32-bit bytes."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        raw = [p.encode("utf-8") for p in pieces]
        for i, word in enumerate(raw):
            rank = self.ranks.get(word)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(word) > 64:
                out[i] = self._merge_long(word)
            elif word:
                by_width.setdefault(max(2, 1 << (len(word) - 1).bit_length()), []).append(i)
        for width, at in by_width.items():
            for a in range(0, len(at), 16384):
                some = at[a : a + 16384]
                for i, ids in zip(some, self._merge_rows([raw[i] for i in some], width)):
                    out[i] = ids
        return out

    # -- texts ------------------------------------------------------------

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit bytes.

        A space that a visible character follows always starts a pre-token, so
        texts are cut there and the cuts looked up whole; texts where another
        white-space character or the end follows a space take the pattern.
        """
        if len(self.by_word) > self.cache:
            self.by_word = {}
        if len(self.by_piece) > self.cache:
            self.by_piece = {}
        cut: list[tuple[list[str], list[str]]] = []
        words: set[str] = set()
        new: set[str] = set()
        for t in texts:
            if _UNSAFE.search(t):
                cut.append((self.pattern.findall(t), []))
            else:
                head, *rest = t.split(" ")
                words.update(rest)
                cut.append((self.pattern.findall(head), rest))
            new.update(cut[-1][0])
        words.difference_update(self.by_word)
        parts = {w: [" " + w] if w.isascii() and w.isalpha() else self.pattern.findall(" " + w) for w in words}
        for x in parts.values():
            new.update(x)
        new.difference_update(self.by_piece)
        fresh = list(new)
        piece = self.by_piece
        piece.update(zip(fresh, self.encode_pieces(fresh)))
        self.by_word.update((w, piece[x[0]] if len(x) == 1 else b"".join([piece[y] for y in x])) for w, x in parts.items())
        word = self.by_word
        return [b"".join([*[piece[x] for x in head], *map(word.__getitem__, rest)]) for head, rest in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def loaded(path: str, pattern: str) -> ByteBPE:
    """One encoder for each Python worker."""
    return vec.worker_slot(("bpe", path, pattern), lambda: ByteBPE(read_ranks(path), pattern))


def text_slices(batch: pa.RecordBatch, text: str, limit: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of runs of rows that hold about ``limit`` characters."""
    rows, size, first = [], 0, 0
    for i, t in enumerate(batch.column(batch.schema.get_field_index(text))):
        rows.append(t.as_py() or "")
        size += len(rows[-1])
        if size >= limit or len(rows) >= 4000:
            yield first, rows
            rows, size, first = [], 0, i + 1
    if rows:
        yield first, rows


def _map(df: DataFrame, path: str, pattern: str, text: str, schema: str, row: Callable, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            for first, texts in text_slices(batch, text):
                made = [row(bpe, np.frombuffer(x, "<u4")) for x in bpe.encode(texts)]
                ids = batch.column(0).slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x) for x in zip(*made))], names)

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<long>), one for each input row; null text has no ids."""
    kind = df.schema[id_col].dataType.simpleString()
    return _map(df.select(id_col, text_col), path, pattern, text_col, f"`{id_col}` {kind}, ids array<long>", lambda bpe, ids: (ids.astype(np.int64),), [id_col, "ids"])


def decode(df: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, decoded binary): the bytes that the ids stand for; null ids are none."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            out = [b"".join(map(bpe.tokens.__getitem__, x.as_py() or ())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [id_col, "decoded"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")


def round_trip(df: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode again, and keep digests of both: (id, n_tokens, ids_sha256, decoded_sha256)."""
    kind = df.schema[id_col].dataType.simpleString()

    def row(bpe: ByteBPE, ids: np.ndarray):
        listed = ids.tolist()
        named = ",".join(map(bpe.names.__getitem__, listed))
        return len(listed), hashlib.sha256(named.encode("ascii")).hexdigest(), hashlib.sha256(b"".join(map(bpe.tokens.__getitem__, listed))).hexdigest()

    return _map(df.select(id_col, text_col), path, pattern, text_col, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", row, [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
