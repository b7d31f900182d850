"""Secret scans: base patterns, then zstandard novelty primed with dictionaries.

The base patterns (assign, access, hex) always count.  Besides them, tokens that
look like keys are candidates if a sensitive word stands before them.  In
NAME=value the value is the candidate and the name is part of what stands before
it; an equals sign belongs to a candidate only as padding at its end.  The
novelty of a candidate is what it adds to the compressed size of its
surroundings, with a compressor primed by a dictionary of identifiers and by the
surrounding text: identifiers, words and copies of nearby strings add little,
random strings nearly their entropy.  Candidates that hardly compress are
reported as ``novel``.

A candidate without digits whose parts (split at capitals and punctuation) have four
letters or more on average is a name, a path or words, and not measured: new words and
random letters add the same 5 to 8 bits a character.  Random letters of both cases have
parts of two or three; capitals alone are measured unless punctuation parts them.

Offsets are code points, the end exclusive.  Null and empty texts have no spans.
Texts of any length are scanned whole.  An empty table has no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from plumbline.llm.bpe import text_slices

#: Fixed order of kinds; the first three are the base.
KINDS = ("assign", "access", "hex", "novel")
BASE = 3
#: Words that make the place before a candidate sensitive.
SENSITIVE = ("key", "token", "secret", "passw", "credential", "auth", "bearer", "private", "signature", "apikey", "session", "cookie")
#: Ordinary identifiers and phrases of code that prime the compressor.
IDENTIFIERS = (
    "import from class def return self function const let var public private protected static void string int float double "
    "bool true false null none undefined new delete this super extends implements interface package module require export "
    "default async await yield lambda try except catch finally raise throw if else elif for while do switch case break continue "
    "username password passwd secret token api_key apikey access_key secret_key client_id client_secret authorization bearer "
    "basic session cookie config settings environment variable localhost example test testing placeholder changeme your_key_here "
    "http https www com org net index html json xml yaml csv select insert update delete from where values table database "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef"
)
#: Context characters before and after a candidate, and the least bits a character must add.
AROUND, LEAST_BITS = 256, 3.0

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_HINT = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}")
_PART = re.compile(r"[A-Za-z0-9+/_.-]+(?:=+(?![A-Za-z0-9+/_=.-]))?")
#: A name made of words, which a value follows.
_NAME = re.compile(r"[A-Za-z]+[0-9]*(?:[_.-]+(?:[A-Za-z]+[0-9]*|[0-9]+))*=?\Z")
_VALUE = re.compile(r"""(?:=|(?<==))["']?[A-Za-z0-9+/_.-]""")
_SENSITIVE = re.compile("|".join(SENSITIVE), re.I | re.A)
_WORD, WORD_LETTERS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+"), 4


def is_name(candidate: str) -> bool:
    """Words, joined in any of the ways of code."""
    if any(c.isdigit() or c in "+=" for c in candidate):
        return False
    parts = _WORD.findall(candidate)
    return (len(parts) > 1 or not candidate.isupper()) and sum(map(len, parts)) >= WORD_LETTERS * len(parts) > 0


class Novelty:
    """Marginal compressed size of a string next to its surroundings."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        raw = identifiers.encode()
        self.dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.dictionary.precompute_compress(level=9)
        self.press = zstandard.ZstdCompressor(level=9, dict_data=self.dictionary, write_content_size=False, write_checksum=False)

    def bits(self, before: str, candidate: str, after: str) -> float:
        """Bits that each character of the candidate adds to its context."""
        around = (before + "\n" + after + "\n").encode("utf-8", "replace")
        more = len(self.press.compress(around + candidate.encode("ascii"))) - len(self.press.compress(around))
        return 8 * more / len(candidate)


def find(text: str, novelty: Novelty, least_bits: float = LEAST_BITS) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) by start, then kind."""
    found: list[tuple[int, int, int]] = []
    if _HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    begins = sorted(a for a, _, _ in found)
    ends = sorted(b for _, _, b in found)
    last = end = -1
    for run in _CANDIDATE.finditer(text):
        outer = bool(_SENSITIVE.search(text[max(0, run.start() - 64) : run.start()]))
        if end != run.start() - 1 or text[end] not in "\"'":  # else a quoted value, whose name was the last part
            last = run.start()
        end = run.end()
        for m in _PART.finditer(text, *run.span()):
            a, b = m.span()
            near, last = min(last, max(0, a - 64)), a  # a name of any length counts whole
            if b - a < 16 or bisect_left(begins, b) > bisect_right(ends, a):  # a base span overlaps it
                continue
            if _NAME.match(m.group()) and _VALUE.match(text, b):
                continue
            if not (outer or _SENSITIVE.search(text[near:a])) or is_name(m.group()):
                continue
            if novelty.bits(text[max(0, a - AROUND) : a], m.group(), text[b : b + AROUND]) >= least_bits:
                found.append((a, 3, b))
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def detect(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", identifiers: str = IDENTIFIERS, least_bits: float = LEAST_BITS) -> DataFrame:
    """One row for each input row: counts by kind, base_sha256 and spans.

    Other columns of the input are ignored; repeated rows are scanned one by one.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = [f"n_{k}" for k in KINDS]

    def joined(spans: list[tuple[str, int, int]]) -> str:
        return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers)
        for batch in batches:
            for first, texts in text_slices(batch, text_col):
                found = [find(t, novelty, least_bits) for t in texts]
                counts = [pa.array([sum(s[0] == k for s in spans) for spans in found], pa.int64()) for k in KINDS]
                digest = [hashlib.sha256(joined([s for s in spans if s[0] in KINDS[:BASE]]).encode()).hexdigest() for spans in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *counts, pa.array(digest), pa.array(list(map(joined, found)))], [id_col, *names, "base_sha256", "spans"])

    schema = ", ".join([f"`{id_col}` {kind}", *(f"{n} long" for n in names), "base_sha256 string", "spans string"])
    return df.select(id_col, text_col).mapInArrow(run, schema)
