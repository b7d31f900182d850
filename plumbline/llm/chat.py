"""Chat formatting: collapse cumulative snapshots, then render.

Native only: every step is a DataFrame expression.  Loggers often store a
conversation again after every exchange.  A conversation is dropped if it is a
proper prefix of another one, or equal to one with a smaller id.

Each turn gets its position in its conversation and a rolling hash of the prefix
that it ends: a running sum, in four 31-bit lanes, of hashes of (position, role,
text).  The hash of a whole conversation is looked up among the proper prefixes
of all, after both sides were reduced to distinct keys, by an anti-join.

Positions come from one range sort of the turns' keys (without their texts): a
conversation of any size, whatever its turn numbers, is spread over the sort's
partitions, and what passes between them is one row for each partition and
conversation.  Rendered text comes back in parts of ``BLOCK`` positions.

Defined cases: rows without a conv_id belong to no conversation and are left out.
A null turn sorts first; null role and text are empty.  Turns with equal numbers
go by the MD5 of role and text; repeated rows are repeated turns.  A text of any
length is one turn of one part.  Other columns are ignored, whatever their names;
an empty table has no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import graph

BLOCK = 256
_LANES = ("a", "b", "c", "d")
_FIRST = -(1 << 63)


def _lanes(*values: Column) -> list[Column]:
    one, two = F.xxhash64(*values), F.xxhash64(F.lit(77), *values)
    mask = F.lit((1 << 31) - 1).cast("long")
    return [x.alias(n) for n, x in zip(_LANES, (one.bitwiseAND(mask), F.shiftrightunsigned(one, 31).bitwiseAND(mask), two.bitwiseAND(mask), F.shiftrightunsigned(two, 31).bitwiseAND(mask)))]


def turns(df: DataFrame) -> DataFrame:
    """(conv, turn, m, role, text) with nulls defined; m is the MD5 of role and text, in bytes."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(_FIRST).cast("long"))
    return df.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").alias("conv"), turn.alias("turn"), F.unhex(F.md5(F.concat(role, F.lit("\x1f"), text).cast("binary"))).alias("m"), role.alias("role"), text.alias("text"))


def positions(df: DataFrame, scratch: graph.Scratch) -> DataFrame:
    """(conv, turn, m, c, pid, p, n): c equal turns from position p on, of n; pid is the sort's partition."""
    keys = turns(df).groupBy("conv", "turn", "m").agg(F.count("m").alias("c"))
    keys = keys.repartitionByRange("conv", "turn", "m").sortWithinPartitions("conv", "turn", "m")
    keys = scratch.save(keys.select("*", F.spark_partition_id().alias("pid")))
    whole = Window.partitionBy("conv")
    counts = keys.groupBy("conv", "pid").agg(F.sum("c").alias("rows"))
    before = F.coalesce(F.sum("rows").over(whole.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("conv", "pid", before.alias("skip"), F.sum("rows").over(whole).alias("n"))
    inside = Window.partitionBy("conv", "pid").orderBy("turn", "m").rowsBetween(Window.unboundedPreceding, 0)
    run = keys.withColumn("run", F.sum("c").over(inside)).join(counts, ["conv", "pid"])
    placed = scratch.save(run.select("conv", "turn", "m", "c", "pid", (F.col("skip") + F.col("run") - F.col("c") + 1).alias("p"), "n"))
    scratch.clear(len(scratch.paths) - 2)
    return placed


def _each(placed: DataFrame) -> DataFrame:
    """A row for each position; p is that position."""
    return placed.withColumn("p", F.explode(F.sequence("p", F.col("p") + F.col("c") - 1)))


def prefixes(placed: DataFrame) -> DataFrame:
    """(conv, p, n, k1, k2): each position, its conversation's length and its prefix hash."""
    rows = _each(placed).select("conv", "pid", "p", "n", *_lanes(F.col("p"), F.xxhash64("m"), F.xxhash64(F.lit(5), "m")))
    run = Window.partitionBy("conv", "pid").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    so_far = Window.partitionBy("conv").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv", "pid").agg(*(F.sum(x).alias(x) for x in _LANES))
    sums = sums.select("conv", "pid", *(F.coalesce(F.sum(x).over(so_far), F.lit(0)).alias(f"{x}0") for x in _LANES))
    rolled = rows.select("conv", "pid", "p", "n", *(F.sum(x).over(run).alias(x) for x in _LANES)).join(sums, ["conv", "pid"])
    totals = [F.col(x) + F.col(f"{x}0") for x in _LANES]
    return rolled.select("conv", "p", "n", F.xxhash64("p", totals[0], totals[1]).alias("k1"), F.xxhash64("p", totals[2], totals[3]).alias("k2"))


def maximal(placed: DataFrame) -> DataFrame:
    """(conv, n, n_copies): conversations that no other one extends or repeats."""
    seen = prefixes(placed)
    ends = seen.where("p = n").groupBy("p", "k1", "k2").agg(F.min("conv").alias("conv"), F.count("conv").alias("n_copies"))
    inner = seen.where("p < n").select("p", "k1", "k2").distinct()
    return ends.join(inner, ["p", "k1", "k2"], "left_anti").select("conv", F.col("p").alias("n"), "n_copies")


def segment(role: Column, text: Column) -> Column:
    """One rendered turn."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def render(df: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, n_copies, rendered) of the maximal conversations.

    ``part`` numbers the blocks of positions of a conversation, ``n_turns`` the turns
    in the part, ``n_copies`` the equal conversations.  Texts are shuffled only here:
    turns of other conversations are sifted out where they are, all but those that share
    a bit of the filter with a kept one (``graph.sift``), and repeated rows are one before
    the shuffle to the places of kept turns.
    """
    scratch = graph.Scratch(df.sparkSession)
    placed = positions(df, scratch)
    wanted = scratch.save(maximal(placed))
    kept = graph.attach(placed.drop("n"), wanted, "conv", "n").select("conv", "turn", "m", "c", "p", "n_copies")
    mine = graph.sift(df.select("conv_id", "turn", "role", "text"), wanted.select(F.col("conv").alias("conv_id")), ["conv_id"])
    texts = turns(mine).groupBy("conv", "turn", "m").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    rows = _each(kept.join(texts, ["conv", "turn", "m"]))
    parts = rows.groupBy("conv", F.floor((F.col("p") - 1) / BLOCK).alias("part")).agg(F.max("n_copies").alias("n_copies"), F.count("p").alias("n_turns"), F.sort_array(F.collect_list(F.struct("p", "role", "text"))).alias("t"))
    return parts.select(F.col("conv").alias("conv_id"), "part", "n_turns", "n_copies", F.array_join(F.transform("t", lambda t: segment(t.role, t.text)), "").alias("rendered"))


#: DuckDB: prefixes as whole texts instead of hashes.
ORACLE_SQL = """
WITH r AS (
  SELECT conv_id AS conv, coalesce(turn, CAST('-9223372036854775808' AS BIGINT)) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn, md5(role || chr(31) || text)) AS p, count(*) OVER (PARTITION BY conv) AS n FROM r
), x AS (
  SELECT conv, role, text, p, n,
         string_agg(role || chr(31) || text, chr(30)) OVER (PARTITION BY conv ORDER BY p ROWS UNBOUNDED PRECEDING) AS prefix
  FROM t
), ends AS (
  SELECT p, prefix, min(conv) AS conv, count(*) AS n_copies FROM x WHERE p = n GROUP BY p, prefix
), kept AS (
  SELECT conv, n_copies FROM ends e WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.p < x.n AND x.p = e.p AND x.prefix = e.prefix)
)
SELECT x.conv AS conv_id, (x.p - 1) // 256 AS part, count(*) AS n_turns, max(k.n_copies) AS n_copies,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY p) AS rendered
FROM x JOIN kept k ON x.conv = k.conv GROUP BY 1, 2
"""
