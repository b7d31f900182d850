"""Schema-on-read over JSON replies, with VARIANT columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Synonyms of the lists and fields in replies, by priority.
INCLUDED = ("included", "taken", "kept", "in_total", "counted")
EXCLUDED = ("excluded", "dropped", "nested", "not_counted", "skipped")
REFERENCE = ("index", "mark", "id", "label", "dimension", "size")
REASON = ("reason", "why", "note", "comment", "notes")


def parse(text: Column) -> Column:
    return F.try_parse_json(text)


def extract_json(text: Column) -> Column:
    """The JSON in a reply: all of it, a fenced block, or the outermost braces or brackets."""
    fence = F.regexp_extract(text, "(?s)```(?:json)?\\s*(.*?)```", 1)
    braces = F.regexp_extract(text, "(?s)(\\{.*\\})", 1)
    brackets = F.regexp_extract(text, "(?s)(\\[.*\\])", 1)
    whole = parse(F.trim(text))
    rest = F.coalesce(parse(F.nullif(braces, F.lit(""))), parse(F.nullif(brackets, F.lit(""))))
    # A fenced block that can't be parsed is an error; nothing else is tried.
    return F.coalesce(whole, F.when(fence != "", parse(F.trim(fence))).otherwise(rest))


def field(v: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def kind_of(v: Column) -> Column:
    """Leading word of a variant's type: STRING, BIGINT, OBJECT, ARRAY, ..."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def is_numeric(v: Column) -> Column:
    return kind_of(v).isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "DECIMAL")


def first_list(v: Column, keys: Iterable[str]) -> Column:
    """The first synonym that is a list, as array<variant>."""
    return F.coalesce(*[F.when(kind_of(field(v, k, "variant")) == "ARRAY", field(v, k, "array<variant>")) for k in keys])


def first_text(v: Column, keys: Iterable[str]) -> Column:
    """The first synonym that is neither null nor empty, as text."""
    return F.coalesce(*[F.when(~kind_of(field(v, k, "variant")).isin("VOID"), F.nullif(field(v, k, "string"), F.lit(""))) for k in keys])


def first_number(v: Column, keys: Iterable[str], strict: bool = False) -> Column:
    """The first synonym that is a number (or, unless strict, text that reads as one)."""
    found = []
    for k in keys:
        x = field(v, k, "variant")
        number = F.when(is_numeric(x), field(v, k, "double"))
        if not strict:
            number = F.coalesce(number, F.when(kind_of(x) == "STRING", F.trim(F.replace(field(v, k, "string"), F.lit(","), F.lit("."))).try_cast("double")))
        found.append(number)
    return F.coalesce(*found)


def first_filled(v: Column, keys: Iterable[str]) -> Column:
    """The first synonym that is neither null, "", [] nor {}, as a variant."""
    found = []
    for k in keys:
        x = field(v, k, "variant")
        kind = kind_of(x)
        empty = (kind == "VOID") | ((kind == "STRING") & (field(v, k, "string") == "")) | F.to_json(x).isin("[]", "{}")
        found.append(F.when(x.isNotNull() & ~empty, x))
    return F.coalesce(*found)


def as_length(x: Column) -> Column:
    """A variant as a number: numbers, and text that reads as one; null otherwise."""
    kind = kind_of(x)
    written = F.trim(F.replace(F.try_variant_get(x, "$", "string"), F.lit(","), F.lit("."))).try_cast("double")
    return F.when(is_numeric(x), F.try_variant_get(x, "$", "double")).when(kind == "STRING", written)


def first_present(v: Column, keys: Iterable[str]) -> Column:
    """The first synonym that is not null, whatever it holds, as a variant."""
    return F.coalesce(*[F.when(kind_of(field(v, k, "variant")) != "VOID", field(v, k, "variant")) for k in keys])


def notes_text(x: Column) -> Column:
    """Notes as text: a list joined by "; ", an object as "key: value" pairs."""
    kind = kind_of(x)
    parts = F.filter(F.transform(F.try_variant_get(x, "$", "array<variant>"), lambda e: F.trim(F.try_variant_get(e, "$", "string"))), lambda t: t != "")
    pairs = F.transform(F.map_entries(F.try_variant_get(x, "$", "map<string,string>")), lambda e: F.concat(e.key, F.lit(": "), e.value))
    return F.when(kind == "ARRAY", F.array_join(parts, "; ")).when(kind == "OBJECT", F.array_join(pairs, "; ")).otherwise(F.try_variant_get(x, "$", "string"))


def reference(v: Column) -> Column:
    """The mark that an entry names: text, or the first named field; a number k is P<k>."""
    own = F.when(kind_of(v) == "STRING", F.nullif(F.trim(F.try_variant_get(v, "$", "string")), F.lit("")))
    named = []
    for k in REFERENCE:
        x = field(v, k, "variant")
        named.append(F.when(kind_of(x) == "STRING", F.nullif(F.trim(field(v, k, "string")), F.lit(""))))
        named.append(F.when(is_numeric(x), F.concat(F.lit("P"), field(v, k, "double").cast("bigint").cast("string"))))
    return F.coalesce(own, F.when(kind_of(v) == "OBJECT", F.coalesce(*named)))


def reason(v: Column) -> Column:
    text = F.coalesce(*[F.nullif(F.trim(field(v, k, "string")), F.lit("")) for k in REASON], F.lit(""))
    return F.when(kind_of(v) == "OBJECT", text).otherwise(F.coalesce(F.trim(F.try_variant_get(v, "$", "string")), F.lit("")))
