"""Mixing sources to target weights: a low-discrepancy schedule of equal-token blocks.

Native only: every step is a DataFrame expression.

1. Sources in code-point order (null last) weigh ``WEIGHTS``, repeating, and share all
   words by weight.  A source whose share is above ``CAP`` times its size stops there;
   the excess is shared again until none is above (``targets``).
2. The documents of a source, shuffled by a hash of their id, are a stream of words
   that repeats (epochs) as far as the source's target; it is cut in blocks of
   ``BLOCK`` words, whatever the documents' ends.
3. Point i of the van der Corput sequence in 2^m steps is the reverse of i's m bits.
   The points are cut by the sources' cumulative numbers of blocks, so the slots i of a
   source are spread evenly over the mix, and their number is exact: a source meets its
   target to a word.  Slots are ranked within their source (``schedule``).
4. The k-th slot of a source takes the k-th block of its stream: pieces of documents
   and slots are joined on (source, k), keys that are all of one block (``mix``).

Order comes from range sorts (``graph.running``); a source that holds a third of all
rows is spread over the sort's partitions, and its slots are ranked in stretches of
2^16 slots.  Only numbers are shuffled, never texts.  What the driver gets is four sums
a round of resharing.

Defined cases: a null text has no words, its document is in the result with 0 taken.
A null source is a source.  Rows that share an id, and repeated rows, are documents of
their own; a null id sorts as an empty one.  Sources without words take nothing.  A
text of any length is cut like any other.  Other columns are ignored, whatever their
names; an empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import graph

WEIGHTS, CAP, BLOCK, SEED = (5, 2, 1), 3, 1024, "mix"
#: Slots that one row of a source unfolds at a time, and (as a power of two) those that are ranked together.
UNFOLD, STRETCH = 4096, 16


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, scratch: graph.Scratch, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(src, rows, size, s, w, target, words) of sources (src, rows, size): number, weight, target and whole words of it.

    Rounds end when no further source is above its cap; each only adds capped ones.
    """
    ranked = graph.running(sizes.select("src", "rows", "size", F.lit(0).alias("all"), F.lit(1).alias("one")), "all", ["src"], "one", scratch)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("start") % len(weights) + 1).cast("int"))
    ranked = scratch.save(ranked.select("src", "rows", "size", F.col("start").alias("s"), w.cast("long").alias("w")))
    full = F.col("size") * cap
    total, weight = ranked.agg(F.sum("size"), F.sum("w")).first()
    rest, left, before = total or 0, weight or 1, -1
    while True:
        above = full.cast("decimal(28,0)") * F.lit(left).cast("decimal(10,0)") < F.lit(rest).cast("decimal(28,0)") * F.col("w").cast("decimal(10,0)")
        taken, lost, n = ranked.where(above).agg(F.sum(full), F.sum("w"), F.count("w")).first()
        if n == before or not n:
            break
        rest, left, before = total - taken, weight - lost, n
    target = F.when(above, full.cast("double")).otherwise(F.lit(float(rest)) * F.col("w") / F.lit(float(left)))
    made = ranked.withColumn("target", target)
    return scratch.save(made.withColumn("words", F.least(F.floor(F.col("target") + 0.5), full).cast("long")))


def schedule(sources: DataFrame, scratch: graph.Scratch, block: int = BLOCK) -> DataFrame:
    """(s, slot, k) of sources (s, words): slot numbers in the mix, and their rank (from 0) within the source."""
    blocks = sources.where("words > 0").select("s", F.ceil(F.col("words") / block).cast("long").alias("n"), F.lit(0).alias("all"))
    cut = graph.running(blocks, "all", ["s"], "n", scratch)
    last = cut.agg(F.sum("n")).first()[0] or 0
    bits = max(1, (last - 1).bit_length())
    rows = cut.select("s", "n", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / UNFOLD))).alias("u")).repartition("s", "u")
    points = rows.select("s", F.explode(F.sequence(F.col("start") + F.col("u") * UNFOLD, F.col("start") + F.least(F.col("n"), (F.col("u") + 1) * UNFOLD) - 1)).alias("point"))
    slots = points.select("s", F.conv(F.reverse(F.lpad(F.bin("point"), bits, "0")), 2, 10).cast("long").alias("slot")).withColumn("t", F.shiftright("slot", STRETCH))
    skip = F.coalesce(F.sum("c").over(Window.partitionBy("s").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = slots.groupBy("s", "t").agg(F.count("slot").alias("c")).select("s", "t", skip.alias("skip"))
    ranked = slots.withColumn("r", F.row_number().over(Window.partitionBy("s", "t").orderBy("slot")) - 1)
    return ranked.join(counts, ["s", "t"]).select("s", "slot", (F.col("skip") + F.col("r")).alias("k"))


def mix(
    df: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> tuple[DataFrame, DataFrame]:
    """The documents and the pieces of the mix.

    Documents: (row, id, source, size, source_size, target).  Pieces: (slot, source number
    s, rank k, offset in the block, row, id, epoch, start and length in words); by slot and
    offset they are the mix in order.
    """
    scratch = graph.Scratch(df.sparkSession)
    src = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    docs = df.select(F.col(id_col).alias("id"), src.alias("src"), words(F.col(text_col)).alias("size"), key.alias("key"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    placed = graph.running(docs, "src", ["key", "size", "h"], "size", scratch)
    sources = targets(placed.groupBy("src").agg(F.count("size").alias("rows"), F.sum("size").alias("size")), scratch, weights, cap)
    facts = sources.select("src", "rows", F.col("size").alias("source_size"), "s", "target", "words")
    known = scratch.save(graph.attach(placed.select("id", "src", "size", "start"), facts, "src", "rows").withColumn("row", F.monotonically_increasing_id()))
    scratch.only(known, sources)

    used = known.where("size > 0 and words > 0")
    epochs = used.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / F.col("source_size")))))
    spans = epochs.withColumn("a", F.col("epoch") * F.col("source_size") + F.col("start")).withColumn("b", F.least(F.col("a") + F.col("size"), F.col("words"))).where("a < b")
    cut = spans.withColumn("k", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))))
    first, after = F.greatest(F.col("a"), F.col("k") * block), F.least(F.col("b"), (F.col("k") + 1) * block)
    pieces = cut.select("s", "k", (first - F.col("k") * block).alias("offset"), "row", "id", "epoch", (first - F.col("a")).alias("start"), (after - first).alias("length"))
    slots = schedule(sources.select("s", "words"), scratch, block)
    source = F.when(F.col("src") != "1", F.substring("src", 2, 1 << 30))
    return known.select("row", F.col("id").alias(id_col), source.alias("source"), "size", "source_size", "target"), slots.join(pieces, ["s", "k"]).withColumnRenamed("id", id_col)


def taken(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """Documents with the words that the mix takes of each (``taken``), repeats counted."""
    sums = pieces.groupBy("row").agg(F.sum("length").alias("taken"))
    return documents.join(sums, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long"))).drop("row")


#: DuckDB: words taken from whole epochs and the beginning of the last one, without blocks and slots.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0) AS BIGINT) AS size FROM documents
), f AS (
  SELECT source, sum(size)::HUGEINT AS n, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::HUGEINT AS w FROM d GROUP BY source
), o AS (
  SELECT *, (sum(n) OVER ()) - coalesce(sum(3 * n) OVER before, 0) AS rest, (sum(w) OVER ()) - coalesce(sum(w) OVER before, 0) AS part
  FROM f WINDOW before AS (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT arg_min(rest, n / w) AS rest, arg_min(part, n / w) AS part FROM o WHERE rest * w <= 3 * n * part
), t AS (
  SELECT source, n, CASE WHEN 3 * n * part < l.rest * w THEN (3 * n)::DOUBLE ELSE l.rest::DOUBLE * w / part::DOUBLE END AS target
  FROM (SELECT source, n, w FROM f), l
), x AS (
  SELECT d.doc_id, d.source, d.size, t.n::BIGINT AS source_size, t.target, least(floor(t.target + 0.5)::BIGINT, 3 * t.n::BIGINT) AS words,
         (sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE words // source_size * size + greatest(0, least(size, words % source_size - start)) END AS taken
FROM x
"""
