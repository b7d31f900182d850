"""Spelling variants: words at an edit distance of one, found by rare positional bigrams.

1. Tasks count the words of whole texts, many documents at a time (``counts``).  Some
   runs lose a character by a checksum of the document's id and the run.
2. Bigrams are ordered by their number in the vocabulary, then by text and position.
   The alphabet has 90 characters, so there are 8,100 bigrams at most: their numbers go
   to every task.  A word keeps its ``RAREST`` = 3 rarest with their positions.
3. One edit spoils at most two bigrams of either word; the others are matched in both, in
   the same order, none or one position apart.  The first matched one thus is among the
   three rarest of both, so two near words share one of them at the same position or,
   in the longer word, one position later.  An edit leaves one half of the word as it is,
   so words meet on (lengths, bigram, position, half): a key for each way (``keys``).
4. Words that meet are verified by their edit distance inside the join, so that only
   near pairs leave it.  Keys of more than ``HOT`` words are dealt in blocks.
5. Each word's near words give its form; roots follow the forms by doubled steps.

A variant chain ends: the number of each form is at least twice that of the word.

Defined cases: a null text has no words; a null id is an empty one.  Rows that share an
id and repeated rows count each.  Texts are read in runs of ``RUN`` characters that end
between words.  Other columns are ignored, whatever their names; an empty table has no
words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import graph

SHORTEST, LEAST, SPOILT, RAREST, TIMES = 5, 3, 97, 3, 2
RUN, FLUSH, HOT = 1 << 20, 200_000, 2000

_WORD, _GAP = re.compile(f"[a-zÀ-ÿ]{{{SHORTEST},}}"), re.compile("[^a-zÀ-ÿ]")


def words(text: bytes) -> Counter:
    """Runs of at least ``SHORTEST`` letters with only A-Z lowered, and their numbers."""
    found: Counter = Counter()
    text, at = text.lower().decode(), 0  # bytes lower A-Z only
    while at < len(text):
        end = m.start() if len(text) - at > RUN and (m := _GAP.search(text, at + RUN)) else len(text)
        found.update(_WORD.findall(text, at, end))
        at = end
    return found


def written(doc: str, run: str) -> str:
    """The run as counted: without one character if ``SPOILT`` divides its checksum in this document."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % SPOILT:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def counts(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                for w, n in words(text.as_py()).items():
                    if len(w := written(doc, w)) >= SHORTEST:
                        found[w] += n
                if len(found) > FLUSH:
                    yield told()
        if found:
            yield told()

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(empty(id_col).alias("id"), empty(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bigram_numbers(vocabulary: DataFrame) -> dict[str, int]:
    """Occurrences of each bigram in the words; there are at most 90 x 90."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    return {r[0]: r[1] for r in vocabulary.select(F.explode(grams).alias("g")).groupBy("g").count().collect()}


def keys_of(word: str, number: dict[str, int]) -> list[tuple[str, int]]:
    """Keys at which near words meet, with the side: 0 for equal lengths, 1 for the shorter word, 2 for the longer one."""
    rarest = sorted((number[word[p : p + 2]], word[p : p + 2], p) for p in range(len(word) - 1))[:RAREST]
    n = len(word)
    h, k = n // 2, (n - 1) // 2
    out = []
    for _, g, p in rarest:
        out += [(f"= {n} {g} {p} < {word[:h]}", 0), (f"= {n} {g} {p} > {word[h:]}", 0)]
        out += [(f"+ {n} {g} {q} {half}", 1) for q in (p, p + 1) for half in (f"< {word[:h]}", f"> {word[h:]}")]
        out += [(f"+ {n - 1} {g} {p} < {word[:k]}", 2), (f"+ {n - 1} {g} {p} > {word[k + 1 :]}", 2)]
    return out


def keys(vocabulary: DataFrame, number: dict[str, int]) -> DataFrame:
    """(k, side, word, n): each word at its keys, as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(k, side, w, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, side in keys_of(w, number)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.string(), pa.int32(), pa.string(), pa.int64()))], ["k", "side", "word", "n"])

    return vocabulary.select("word", "n").mapInArrow(run, "k string, side int, word string, n long").withColumn("k", F.xxhash64("k"))


def near(vocabulary: DataFrame, scratch: graph.Scratch) -> DataFrame:
    """(a, na, b, nb): pairs of words that differ by one edit, each once, with their numbers."""
    met = scratch.save(keys(vocabulary, bigram_numbers(vocabulary)))
    hot = met.groupBy("k").agg(F.count("word").alias("c")).where(F.col("c") > HOT).select("k", F.ceil(F.col("c") / HOT).cast("int").alias("blocks"))
    met = met.join(hot, "k", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    a = met.where("side < 2").select("k", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("block"), F.col("word").alias("a"), F.col("n").alias("na"))
    b = met.where("side <> 1").select("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("word").alias("b"), F.col("n").alias("nb"))
    once = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    return a.join(b, (a.k == b.k) & (a.block == b.block) & once & (F.levenshtein("a", "b", 1) == 1)).select("a", "na", "b", "nb").distinct()


def roots(forms: DataFrame, scratch: graph.Scratch) -> DataFrame:
    """(word, root) of (word, root): each root followed to the last, twice as far in each round."""
    since = len(scratch.paths)
    now = scratch.save(forms)
    while True:
        ends = now.groupBy("root").agg(F.count("word").alias("size")).join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        ends = scratch.save(ends)
        if not ends.where("next is not null").limit(1).count():
            break
        now = scratch.save(graph.attach(now, ends, "root", "size").select("word", F.coalesce("next", "root").alias("root")))
        scratch.clear(since)
    return now


def variants(df: DataFrame, *, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word with at least this many occurrences."""
    scratch = graph.Scratch(df.sparkSession)
    vocabulary = scratch.save(counts(df, id_col=id_col, text_col=text_col).where(F.col("n") >= least))
    pairs = near(vocabulary, scratch)
    there, back = (F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"n{y}").alias("m")) for x, y in ("ab", "ba"))
    each = pairs.select(F.explode(F.array(there, back)).alias("x")).select("x.*")
    best = each.groupBy("word").agg(F.count("near").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    known = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.m")).alias("m"))
    large = F.col("m") >= F.col("n") * times
    known = scratch.save(known.select("word", F.when(large, F.col("near")).alias("form"), "n", "n_near", F.when(large, F.col("m")).alias("form_n")))
    scratch.clear()
    ends = roots(known.where("form is not null").select("word", F.col("form").alias("root")), scratch)
    out = scratch.save(known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
    scratch.clear()
    return out
