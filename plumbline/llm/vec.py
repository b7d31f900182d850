"""Vectorised text primitives over Arrow string buffers.

Words are maximal runs of bytes outside space, tab, newline, vertical tab,
form feed and carriage return.  All hashes are 64-bit polynomials modulo 2**64
followed by a bijective mixer, so equal words always get equal hashes and two
different words collide with probability about 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SLOT: dict[Hashable, Any] = {}


def worker_slot(key: Hashable, make: Callable[[], Any]) -> Any:
    """What this Python worker keeps between tasks: one model with its caches.

    Workers serve many operators in turn; keeping only the last one's model bounds
    their memory by the largest, not by the sum.
    """
    if key not in _SLOT:
        _SLOT.clear()
        _SLOT[key] = make()
    return _SLOT[key]


def lean(run: Callable[[Iterator], Iterator], model: bool = False) -> Callable[[Iterator], Iterator]:
    """``run`` over Arrow batches, for workers that serve many operators: what it freed goes back to the system.

    Allocators keep freed memory, about half of a worker's, which idle workers would hold
    while others need it.  A kept model goes first, unless ``run`` uses one (``model``).
    """

    def tidy(batches: Iterator) -> Iterator:
        if not model:
            _SLOT.clear()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim is not None:
                trim(0)

    return tidy


SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POW = np.ones(1, dtype=np.uint64)
_INV = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of the base and of its inverse, modulo 2**64."""
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        for name, b in (("_POW", _BASE), ("_INV", inverse)):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            globals()[name] = np.multiply.accumulate(x)
    return _POW[:n], _INV[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def spans(offs: np.ndarray, limit: int):
    """Row ranges (i, j) of about ``limit`` units each, never less than one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


@dataclass
class Words:
    """Words of a run of documents."""

    data: np.ndarray
    offs: np.ndarray  # document -> byte
    starts: np.ndarray  # word -> byte
    ends: np.ndarray
    hashes: np.ndarray  # word -> hash
    first: np.ndarray  # document -> word, one more than documents
    prefix: np.ndarray  # byte -> polynomial prefix sum

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def hash_range(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inv = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def tokenise(data: np.ndarray, offs: np.ndarray) -> Words:
    n = len(data)
    pw, _ = powers(n + 1)
    word = ~SPACE[data]
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = word
    before[offs] = False
    after = np.zeros(n + 1, dtype=bool)
    after[:n] = word
    after[offs] = False
    starts = np.flatnonzero(word & ~before[:n])
    ends = np.flatnonzero(word & ~after[1:]) + 1
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * pw[:n], out=prefix[1:])
    return Words(data, offs, starts, ends, hash_range(prefix, starts, ends), np.searchsorted(starts, offs), prefix)


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word and hash of each n-word window that lies in one document."""
    k = len(w.hashes)
    if k < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pw, inv = powers(k + 1)
    c = np.zeros(k + 1, dtype=np.uint64)
    np.cumsum(w.hashes * pw[:k], out=c[1:])
    last = np.repeat(w.first[1:], np.diff(w.first))
    start = np.flatnonzero(np.arange(n, k + n) <= last)
    return start, mix((c[start + n] - c[start]) * inv[start] + np.uint64(n))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of keys that occur twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), dtype=bool)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(s) + 1, dtype=bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order] = same[1:] | same[:-1]
    return out


def later(keys: np.ndarray) -> np.ndarray:
    """Mask of keys equal to an earlier one."""
    if len(keys) < 2:
        return np.zeros(len(keys), dtype=bool)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:]] = s[1:] == s[:-1]
    return out


def doc_keys(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that are equal only within one document."""
    return mix(hashes ^ mix(doc.astype(np.uint64) + np.uint64(1)))


def shingles(w: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes per document: (values, document offsets).

    A document of 1 to n-1 words has one shingle, all its words.  A document
    without words has none.
    """
    docs = len(w.first) - 1
    start, h = windows(w, n)
    doc = w.doc[start] if len(start) else np.zeros(0, np.int64)
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        k = len(w.hashes)
        pw, inv = powers(k + 1)
        c = np.zeros(k + 1, dtype=np.uint64)
        np.cumsum(w.hashes * pw[:k], out=c[1:])
        a, b = w.first[short], w.first[short + 1]
        h = np.concatenate([h, mix((c[b] - c[a]) * inv[a] + (b - a).astype(np.uint64))])
        doc = np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(docs + 1))
