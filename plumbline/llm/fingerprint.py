"""Document fingerprints: mergeable bottom-k sketches of shingle hashes.

Native only: every step is a DataFrame expression.  A sketch is the sorted array
of the k smallest 64-bit hashes of a document's five-word shingles (all words of
a shorter text make one shingle; a text without words has an empty sketch).
Sketches of parts merge into the sketch of the whole, and two sketches estimate
resemblance, containment and distinct counts.  While a sketch holds fewer than k
hashes it is the whole set and all estimates are exact.

Defined cases: null text is empty; two texts without words are alike.  Ids are
integers; a null id comes before all others, and rows with one id follow each
other by the hash of their text.  Texts of any length are hashed whole.  Other
columns are ignored, whatever their names; an empty table has no rows.
"""

from __future__ import annotations

import json
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, WORDS = 128, 5
#: Characters of text in a range of neighbours, most ranges (above it ranges grow), and sampled rows for each range.
RANGE_CHARS, RANGES, SAMPLED = 32_000_000, 1 << 16, 20
_SPACES = "[ \\t\\n\\x0B\\f\\r]+"


def shingle_hashes(text: Column, n: int = WORDS) -> Column:
    """Hashes of the n-word shingles of a text, in order, with repeats."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), _SPACES), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.transform(
        F.array(hashes),
        lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, n)))
        ),
    )[0]


def sketch(text: Column, k: int = K, n: int = WORDS) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, n))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two parts' shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; two empty sketches are alike, one is not."""
    both = F.size(F.array_intersect(F.array_intersect(merge(a, b, k), a), b))
    union = F.least(F.size(F.array_union(a, b)), F.lit(k))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / union.cast("double"))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 0 where a has none."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """Sixteen hexadecimal digits of each hash, in order."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def from_text(t: Column) -> Column:
    """The sketch that ``as_text`` wrote, to merge and compare again."""
    digits = lambda i: F.substring(t, i * 16 + 1, F.lit(16))
    return F.when(F.length(t) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), (F.length(t) / 16).cast("int") - 1), lambda i: F.conv(digits(i), 16, -10).cast("bigint")))


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(id, sketch, n_shingles) of each row."""
    out = df.select(id_col, sketch(F.col(text_col), k).alias("sketch"))
    return out.withColumn("n_shingles", distinct_shingles(F.col("sketch"), k))


def cuts_of(docs: DataFrame) -> list[tuple[int | None, int]]:
    """Rows (id, h) at which ranges begin, from a bounded sample of the rows of docs (id, h, text).

    As many ranges as the texts need at ``RANGE_CHARS`` each, ``RANGES`` at most, and
    enough for every task.  The driver gets one row for each range.
    """
    rows = docs.count()
    tasks = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    want = min(1.0, SAMPLED * RANGES / max(rows, 1))
    bound = F.lit(int(want * (1 << 30)))
    sample = docs.where(F.pmod(F.xxhash64("id", F.lit(31)), F.lit(1 << 30)) < bound) if want < 1 else docs
    first = sample.select("id", "h", F.length("text").alias("n"))
    held, chars = first.agg(F.count("h"), F.sum(F.col("n").cast("long"))).first()
    if not held:
        return []
    n = min(RANGES, held, max(tasks, int((chars or 0) / held * rows / RANGE_CHARS) + 1))
    # Each n-th row of the sample in order: by range partitions, so no task sorts the whole sample.
    parts = first.select("id", "h").repartitionByRange(max(1, min(64, n)), "id", "h").sortWithinPartitions("id", "h")
    parts = parts.select("id", "h", F.monotonically_increasing_id().alias("at"))
    step = max(1, held // n)
    picked = parts.where(F.pmod(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)), F.lit(step)) == step - 1)
    return sorted({(r[0], r[1]) for r in picked.select("id", "h").collect()}, key=lambda c: (c[0] is not None, c[0] or 0, c[1]))


def with_next(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(id, text, sketch, next_text, next_sketch): each row with that of the next id; after the last comes the first.

    Ids are cut into ranges at rows of the table, so the first row of every range but
    the first is known: it is also sent to the range before it, as a row that only
    ends it.  One shuffle of texts and sketches is enough, no task holds more than a
    range, and one id or null may fill many ranges.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    least = docs.agg(F.min(F.struct("id", "h"))).first()[0]
    if least is None:
        return docs.select("id", "text", sketch(F.col("text"), k).alias("sketch"), F.col("text").alias("next_text"), sketch(F.col("text"), k).alias("next_sketch"))
    cuts = [c for c in cuts_of(docs) if c != tuple(least)]
    at = F.struct("id", "h")
    chunk = max(1, isqrt(len(cuts)))
    chunks = [cuts[i : i + chunk] for i in range(0, len(cuts), chunk)]
    if chunks:
        # One literal of all cuts; a row compares with the first of each chunk, then with those of its chunk.
        bounds = F.from_json(F.lit(json.dumps([[{"id": i, "h": h} for i, h in c] for c in chunks])), "array<array<struct<id:bigint,h:bigint>>>")
        coarse = F.size(F.filter(bounds, lambda c: c[0] <= at))
        fine = F.element_at(bounds, F.greatest(coarse, F.lit(1)))
        g = F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * chunk + F.size(F.filter(fine, lambda c: c <= at)))
        begins = F.exists(fine, lambda c: c == at)
    else:
        g, begins = F.lit(0), F.lit(False)
    begins = begins | (at == F.struct(F.lit(least[0]).cast("bigint").alias("id"), F.lit(least[1]).cast("bigint").alias("h")))
    rows = docs.select("id", "h", "text", sketch(F.col("text"), k).alias("sketch"), g.cast("int").alias("g"), begins.alias("begins"))
    own = F.struct(F.col("g").alias("g"), F.lit(False).alias("ghost"), F.lit(0).alias("turn"))
    ghost = F.struct(F.when(F.col("g") == 0, len(cuts)).otherwise(F.col("g") - 1).alias("g"), F.lit(True).alias("ghost"), F.lit(1).alias("turn"))
    dealt = rows.select("id", "h", "text", "sketch", F.explode(F.when(F.col("begins"), F.array(own, ghost)).otherwise(F.array(own))).alias("at")).select("id", "h", "text", "sketch", "at.*")
    order = "PARTITION BY g ORDER BY turn, id NULLS FIRST, h"
    return dealt.selectExpr("id", "text", "sketch", "ghost", f"lead(text) OVER ({order}) AS next_text", f"lead(sketch) OVER ({order}) AS next_sketch").where("NOT ghost").drop("ghost")


def edits(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Each text against its edited form and the next text, by sketches.

    The edited text replaces the last floor(n/4) of n code points by the first as
    many (or all) of the next text.  Columns: id, n_chars, edited_sha256, sketch,
    edited_sketch, near_edited, near_next, held_edited and held_next (share of the
    text's shingles that the other one has), n_shingles.
    """
    pairs = with_next(df, id_col=id_col, text_col=text_col, k=k)
    cut = "cast(floor(length(text) / 4) as int)"
    pairs = pairs.selectExpr("id", "cast(length(text) as bigint) AS n_chars", "sketch AS a", "next_sketch AS b", f"concat(substring(text, 1, length(text) - {cut}), substring(next_text, 1, {cut})) AS edited")
    made = pairs.select("id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "a", "b", sketch(F.col("edited"), k).alias("e"))
    a, b, e = map(F.col, "abe")
    return made.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", a.alias("sketch"), e.alias("edited_sketch"), resemblance(a, e, k).alias("near_edited"), resemblance(a, b, k).alias("near_next"),
        containment(a, e, k).alias("held_edited"), containment(a, b, k).alias("held_next"), distinct_shingles(a, k).alias("n_shingles"),
    )
