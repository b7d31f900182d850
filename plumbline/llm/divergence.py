"""Source divergence audit: how far the words of one source lie from those of the others of its language.

1. First pass: the exact number of documents of each (language, term).  A language
   keeps the terms of at least ``LEAST`` documents.
2. Second pass: an Aho-Corasick automaton of the kept terms, each with a delimiter on
   both sides, runs over every text, whose delimiters are made one character; overlapping
   matches are all found, so two terms share the delimiter between them.  It recounts
   the occurrences of each kept term in each (language, source) group.
3. The counts are sparse postings.  A group's p of a term it lacks is one constant, so
   only terms that a source has take part: for two sources,
   sum |p - q| = the terms of the one against the other's constant, and the reverse,
   and the shared terms' difference to both, and the constants for the rest.  Postings
   with equal counts go as one.

Terms are UTF-8 in tasks: one table maps A-Z to lower case and all delimiters to a
space.  Tasks add up counts of many documents before they emit them, ``FLUSH`` at a
time; long texts are cut at delimiters in runs of ``RUN`` bytes.  The vocabulary is not
bounded, so it is dealt by a hash to shards of ``SHARD`` terms or ``SHARD_BYTES`` bytes
(expected); one shard at a time is broadcast, and the second pass runs once for each.

Arithmetic is exact: decimals and integers.

Defined cases: null text, language and source are empty strings.  Every row is a
document, repeated rows too.  A group whose documents have no terms has only zero
counts.  A language that keeps no term gives pairs of value 0 and no terms.  Other
columns are ignored, whatever their names; an empty table has no rows.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import graph

LEAST, TOP, SMOOTH, SCALE = 30, 50, 5, 1_000_000_000
FLUSH, RUN, SHARD, SHARD_BYTES = 200_000, 1 << 20, 400_000, 1 << 24

#: Every byte below 0x80 that is no letter becomes a space, A-Z lower case.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def runs(text: bytes, size: int = RUN) -> Iterator[bytes]:
    """The cleaned text in runs that end between terms; a term longer than a run stays whole."""
    data, at = text.translate(_CLEAN), 0
    while at < len(data):
        end = len(data) if len(data) - at <= size else data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def _counted(groups: list[tuple[str, ...]], sizes: list[int], terms: list[pa.Array], numbers: list[np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (group, term, number) of groups with so many terms each."""
    if sum(sizes):
        keys = [pa.array(list(c)).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))) for c in zip(*groups)]
        yield pa.RecordBatch.from_arrays([*keys, pa.concat_arrays(terms), pa.array(np.concatenate(numbers))], schema=schema)


def document_counts(df: DataFrame) -> DataFrame:
    """(lang, term, n): documents of a language with the term, of rows (lang, source, text)."""
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)

        def told() -> Iterator[pa.RecordBatch]:
            made = list(found.items())
            found.clear()
            yield from _counted([(g,) for g, _ in made], [len(c) for _, c in made], [pa.array(c.keys(), pa.binary()).cast(pa.string()) for _, c in made], [np.fromiter(c.values(), np.int64, len(c)) for _, c in made], schema)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                own: set[bytes] = set()
                for part in runs(text.as_py()):
                    own.update(part.split())
                found[lang].update(own)
                if sum(map(len, found.values())) > FLUSH:
                    yield from told()
        yield from told()

    return df.select("lang", "text").mapInArrow(run, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


#: The automaton of the last shard that this worker has used.
_BUILT: dict[str, tuple] = {}


def automaton(terms: list[tuple[str, str]]) -> tuple[ahocorasick.Automaton, pa.Array, dict[str, np.ndarray]]:
    """An automaton over padded terms with their numbers, the terms, and whether each language keeps each, of (lang, term).

    Terms are UTF-8 bytes read as Latin-1, so that a text needs no decoding.
    """
    number: dict[str, int] = {}
    for _, term in terms:
        number.setdefault(term, len(number))
    kept = {lang: np.zeros(len(number), bool) for lang, _ in terms}
    for lang, term in terms:
        kept[lang][number[term]] = True
    built = ahocorasick.Automaton()
    for term, i in number.items():
        built.add_word(f" {term.encode().decode('latin-1')} ", i)
    built.make_automaton()
    return built, pa.array(number, pa.string()), kept


def counter(shard, token: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Occurrences (lang, source, term, n) of a broadcast shard's terms in rows (lang, source, text)."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _BUILT:
            _BUILT.clear()
            _BUILT[token] = automaton(shard.value)
        built, terms, kept = _BUILT[token]
        found: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def told() -> Iterator[pa.RecordBatch]:
            sizes, words, numbers, groups = [], [], [], list(found)
            for lang, source in groups:  # a match may be a term that only other languages keep
                c = found[lang, source]
                at, n = np.fromiter(c.keys(), np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c))
                own = kept[lang][at]
                sizes.append(int(own.sum()))
                words.append(terms.take(pa.array(at[own])))
                numbers.append(n[own])
            found.clear()
            yield from _counted(groups, sizes, words, numbers, schema)

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                if lang in kept:
                    own = found[lang, source]
                    for part in runs(text.as_py()):
                        own.update(map(itemgetter(1), built.iter(f" {part.decode('latin-1')} ")))
            if sum(map(len, found.values())) > FLUSH:
                yield from told()
        yield from told()

    return run


def occurrences(df: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, n) for each kept (lang, term) that a group of df has, counted by automata of bounded shards."""
    spark = df.sparkSession
    n, size = kept.agg(F.count("term"), F.sum(F.octet_length("term") + 8)).first()
    shards = max(1, -(-n // SHARD), -(-(size or 0) // SHARD_BYTES))
    out = None
    for i in range(shards):
        part = kept.where(F.pmod(F.xxhash64("term"), F.lit(shards)) == i).select("lang", "term")
        shard = spark.sparkContext.broadcast([(r[0], r[1]) for r in part.toLocalIterator()])
        made = df.select("lang", "source", "text").mapInArrow(counter(shard, uuid.uuid4().hex), "lang string, source string, term string, n long")
        made = made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
        out = made if out is None else out.unionByName(made)
    return out


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * v)), exact."""
    whole = (n.cast("decimal(19,0)") + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", whole, (total + v * SMOOTH).cast("decimal(19,0)")) + 1


def audit(df: DataFrame, *, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources, and the terms most in excess."""
    scratch = graph.Scratch(df.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = df.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("text"))
    kept = scratch.save(document_counts(docs).where(F.col("n") >= least).select("lang", "term"))
    posts = scratch.save(occurrences(docs, kept))

    # Groups with their totals and the p of a term that they lack; a language is its groups' sum.
    sizes = kept.groupBy("lang").agg(F.count("term").alias("v"))
    totals = docs.select("lang", "source").distinct().join(posts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(sizes, "lang", "left")
    zero = F.lit(0).cast("long")
    totals = totals.select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("v", zero).alias("v"))
    totals = totals.withColumn("all", F.sum("total").over(Window.partitionBy("lang")))
    totals = scratch.save(totals.withColumn("lacks", F.when(F.col("v") > 0, share(zero, F.col("total"), F.col("v")))))
    known = scratch.save(posts.join(totals, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v"))))

    whole = known.groupBy("lang", "term").agg(F.sum("n").alias("m"), F.first("all").alias("all"), F.first("v").alias("v"))
    whole = whole.select("lang", "term", share(F.col("m"), F.col("all"), F.col("v")).alias("q"))
    excess = known.join(whole, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = excess.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    # Each group's terms against the constant of every other source, then what the shared terms change.
    held = known.groupBy("lang", "source").agg(F.count("term").alias("held"))
    facts = totals.join(held, ["lang", "source"], "left").select("lang", "source", "v", "lacks", F.coalesce("held", zero).alias("held"))
    other = facts.select("lang", F.col("source").alias("item"), F.col("lacks").alias("lacks2"), F.col("held").alias("held2"))
    pairs = scratch.save(facts.join(other, "lang").where("source <> item"))
    same = known.groupBy("lang", "source", "p").agg(F.count("term").alias("c"))
    alone = same.join(pairs, ["lang", "source"]).groupBy("lang", "source", "item").agg(F.sum(F.col("c") * F.abs(F.col("p") - F.col("lacks2"))).alias("alone"))
    a = known.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("lacks").alias("la"))
    b = known.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("lacks").alias("lb"))
    change = F.abs(F.col("pa") - F.col("pb")) - F.abs(F.col("pa") - F.col("lb")) - F.abs(F.col("pb") - F.col("la"))
    both = a.join(b, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(change).alias("change"), F.count("term").alias("shared"))
    both = both.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "change", "shared").select("lang", "x.*", "change", "shared")
    pairs = pairs.join(alone, ["lang", "source", "item"], "left")
    back = alone.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), F.col("alone").alias("alone2"))
    pairs = pairs.join(back, ["lang", "source", "item"], "left").join(both, ["lang", "source", "item"], "left")
    some = lambda c: F.coalesce(F.col(c), zero)
    rest = F.col("v") - F.col("held") - F.col("held2") + some("shared")
    value = F.when(F.col("v") == 0, zero).otherwise(some("alone") + some("alone2") + some("change") + rest * F.abs(F.col("lacks") - F.col("lacks2")))
    pairs = pairs.select("lang", "source", "item", value.alias("value")).withColumn("rank", F.row_number().over(order))
    out = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    out = scratch.save(out.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank"))
    scratch.clear()
    return out


#: DuckDB: every group against every kept term, zero counts included.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), o AS (SELECT row, lang, source, unnest(t) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT x.*, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY x.lang, source) + 5 * v.v) AS p FROM x JOIN v ON v.lang = x.lang),
q AS (SELECT y.lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY y.lang) + 5 * v.v) AS q FROM (SELECT lang, term, sum(n) AS n FROM x GROUP BY ALL) y JOIN v ON v.lang = y.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(f.value, 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.item = h.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, p - q FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u
QUALIFY part = 'pair' OR rank <= 50
"""
