"""Personal data: patterns propose, checksums confirm, context words score.

Kinds: the base kinds email, ip, card (Luhn) and phone, then iban (modulo 97)
and ssn (range rules and a context word near it).  Every span has a score from
its kind, its checksum and the words within ``NEAR`` characters of it.

Offsets are code points, the end exclusive.  Null and empty texts have no spans.
Each row is searched on its own, repeated ones too; other columns are ignored
(``clean`` returns them), whatever their names; an empty table has no rows.
Spans of different kinds may overlap; spans of one kind never do.

Patterns whose naive search is quadratic are anchored instead: an e-mail address
at its @ sign, an IBAN at its country and check digits, other numbers inside
maximal runs of the characters they can hold.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm import vec
from plumbline.llm.bpe import text_slices

#: Fixed order of kinds; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = 4
#: Words that raise a score when they stand near a span.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "@", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
PRIOR = {"email": 0.85, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
#: Characters on each side that are searched for context words, and the least score of a span that the method adds.
NEAR, LEAST = 48, 0.5

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_REGION = re.compile(r"[0-9+][0-9+.() -]*")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_IBAN_HEAD = re.compile(r"[A-Z]{2}(?<![^\W_][A-Z]{2})[0-9]{2}")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?|@")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = sum(_DOUBLED[int(c)] if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def mod97(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def find(text: str) -> list[tuple[str, int, int, float]]:
    """Spans (kind, start, end, score) by start, then kind."""
    found: list[tuple[int, int, int, bool]] = []
    if "@" in text:
        found += [(a, 0, b, False) for a, b in _emails(text)]
    for region in _REGION.finditer(text):
        a, b = region.span()
        if b - a < 4:
            continue
        part = region.group()
        if "." in part:
            for m in _IP.finditer(text, a, b):
                if all(len(x.lstrip("0")) <= 3 and int(x[-9:]) <= 255 for x in m.group().split(".")):
                    found.append((m.start(), 1, m.end(), False))
        for m in _CARD.finditer(text, a, b):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end(), True))
        if "+" in part:
            for m in _PHONE.finditer(text, a, b):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append((m.start(), 3, m.end(), False))
        if "-" in part:
            for m in _SSN.finditer(text, a, b):
                x, y, z = m.groups()
                if x not in ("000", "666") and x < "900" and y != "00" and z != "0000":
                    found.append((m.start(), 5, m.end(), False))
    for head in _IBAN_HEAD.finditer(text):
        m = _IBAN.match(text, head.start())
        code = m.group() if m else ""
        while code and not mod97(code):  # a capital word may follow the code
            code = code.rpartition(" ")[0]
        if code:
            found.append((head.start(), 4, head.start() + len(code), True))
    out, done = [], -1
    for start, k, end, checked in sorted(found):
        near = {x.lower() for x in _WORD.findall(text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR])}
        score = PRIOR[KINDS[k]] + 0.1 * checked + 0.3 * (not near.isdisjoint(CONTEXT[KINDS[k]]))
        if k < BASE or score >= LEAST and start >= done:
            out.append((KINDS[k], start, end, min(1.0, score)))
            if k == 4:
                done = max(done, end)
    return out


def joined(spans: list[tuple]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b, *_ in spans])


def redact(text: str, spans: list[tuple]) -> str:
    """The text with each run of overlapping spans replaced by its first kind."""
    out, at = [], 0
    for kind, a, b, *_ in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def detect(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: counts by kind, base_sha256, spans, least score.

    Other columns of the input are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = [f"n_{k}" for k in KINDS]
    schema = ", ".join([f"`{id_col}` {kind}", *(f"{n} long" for n in names), "base_sha256 string", "spans string", "least_score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch, text_col):
                found = [find(t) for t in texts]
                counts = [pa.array([sum(s[0] == k for s in spans) for spans in found], pa.int64()) for k in KINDS]
                digest = [hashlib.sha256(joined([s for s in spans if s[0] in KINDS[:BASE]]).encode()).hexdigest() for spans in found]
                least = pa.array([min((s[3] for s in x), default=None) for x in found], pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *counts, pa.array(digest), pa.array(list(map(joined, found))), least], [id_col, *names, "base_sha256", "spans", "least_score"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def clean(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """All rows and columns, with the spans of each text replaced by their kinds; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for first, texts in text_slices(batch, text_col):
                rows = batch.slice(first, len(texts))
                valid = rows.column(at).is_valid().to_pylist()
                made = pa.array([redact(t, find(t)) if v else None for t, v in zip(texts, valid)], rows.column(at).type)
                yield rows.set_column(at, text_col, made)

    return df.mapInArrow(vec.lean(run), df.schema)
