"""Order-dependent row operators: ordinals, first-wins, samples, islands, n-th matches."""

from __future__ import annotations

import re
from collections import namedtuple
from collections.abc import Callable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline import saved
from plumbline.functions import geometry


def reading_order(y: Column, x: Column, *ties: Column) -> list[Column]:
    """Top to bottom in tenths, then left to right; ties keep their given order."""
    return [F.rint(y * 10), x, *ties]


def values_of(column: pa.Array) -> list:
    """A column as Python values; numbers by way of numpy, which takes a tenth of the time."""
    if column.null_count == len(column):
        return [None] * len(column)
    if not (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        return column.to_pylist()
    if not column.null_count:
        return column.to_numpy().tolist()
    held = column.is_valid().to_numpy(zero_copy_only=False).tolist()
    return [v if h else None for v, h in zip(column.fill_null(0).to_numpy().tolist(), held)]


def each_group(df: DataFrame, by: list[str], order: list[str], make: Callable[[list], list[tuple]], schema: str) -> DataFrame:
    """``make`` applied to the sorted rows of each group; what it gives follows the group's keys.

    Groups stream through sorted partitions, many in one Arrow batch, so a task holds
    a batch and one group.  For choices that depend on earlier ones of the same group.

    Rows are dealt by a struct of the keys.  By the keys as they are Spark leaves the
    shuffle out where joins or a union have them already, and may then read partitions
    of those in parts, as nothing that it knows of needs whole groups.
    """
    return each_row(df.repartition(F.struct(*by)).sortWithinPartitions(*by, *order), by, make, schema)


def each_row(df: DataFrame, by: list[str], make: Callable[[list], list[tuple]], schema: str) -> DataFrame:
    """``make`` applied to each run of rows with equal keys: to each row where a group is one row."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out_schema = StructType.fromDDL(", ".join([*(f"`{c}` {fields[c]}" for c in by), schema]))
    arrow, names = to_arrow_schema(out_schema), df.columns
    at = slice(names.index(by[0]), names.index(by[0]) + len(by))
    keys = [names.index(c) for c in by]
    key_of = itemgetter(at) if names[at] == by else lambda r: tuple(r[k] for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, held, last = namedtuple("Row", names, rename=True), [], None

        def done(made: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)

        for batch in batches:
            made: list[tuple] = []
            for r in map(row._make, zip(*map(values_of, batch.columns))):
                key = key_of(r)
                if held and key != last:
                    made += [(*last, *x) for x in make(held)]
                    held = []
                last = key
                held.append(r)
            if made:
                yield done(made)
        made = [(*last, *x) for x in make(held)] if held else []
        if made:
            yield done(made)

    return df.mapInArrow(run, out_schema)


def listed(df: DataFrame, by: list[str], order: list[str], columns: list[str], name: str) -> DataFrame:
    """One row for each group with a list of its rows; rows that a window has sorted so far are neither hashed nor sorted again."""
    rows = Window.partitionBy(*by).orderBy(*order)
    whole = F.collect_list(F.struct(*columns)).over(rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.select(*by, whole.alias(name), F.row_number().over(rows).alias("__n")).where("__n = 1").drop("__n")


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "n", prefix: str | None = None) -> DataFrame:
    """Row numbers from 1 in each group, optionally as labels such as P7."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, F.concat(F.lit(prefix), n.cast("string")) if prefix else n)


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def last_wins(df: DataFrame, key: list[str], position: str) -> DataFrame:
    """The last row of each key, in the place of the first one."""
    columns = [c for c in df.columns if c not in key and c != position]
    out = df.groupBy(*key).agg(F.max_by(F.struct(*columns), position).alias("__last"), F.min(position).alias(position))
    return out.select(*key, position, "__last.*")


def systematic_sample(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """At most ``most`` evenly spaced rows of each group: rows floor(i * n / most)."""
    rows = Window.partitionBy(*by)
    df = df.withColumn("__n", F.row_number().over(rows.orderBy(*order)) - 1).withColumn("__c", F.count(F.lit(1)).over(rows))
    # Row r is taken if some i has floor(i * c / most) = r, that is ceil(r * most / c) * c / most < r + 1.
    i = F.ceil(F.col("__n") * most / F.col("__c").cast("double"))
    taken = (F.col("__c") <= most) | ((i < most) & (F.floor(i * F.col("__c") / F.lit(float(most))) == F.col("__n")))
    return df.where(taken).drop("__n", "__c")


def nth_match(left: DataFrame, right: DataFrame, by: list[str], left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """The k-th request for a key takes its k-th occurrence.

    Requests beyond the last occurrence take the first one and are marked
    ``duplicated``; those without any have a null ``occurrence``.  ``right`` may
    bring more columns than the key.
    """
    asked = numbered(left, by, left_order, "__k")
    pool = numbered(right, by, right_order, "occurrence")
    size = pool.groupBy(*by).agg(F.max("occurrence").alias("__size"))
    asked = asked.join(size, by, "left").withColumn("duplicated", F.coalesce(F.col("__k") > F.col("__size"), F.lit(False)))
    asked = asked.withColumn("occurrence", F.when(F.col("duplicated"), 1).otherwise(F.col("__k")))
    found = asked.join(pool, [*by, "occurrence"], "left")
    return found.withColumn("occurrence", F.when(F.col("__size").isNotNull(), F.col("occurrence"))).drop("__k", "__size")


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a beyond their number in b (``side`` extra) and of b beyond a (missing)."""
    return a.exceptAll(b).withColumn("side", F.lit("extra")).unionAll(b.exceptAll(a).withColumn("side", F.lit("missing")))


def set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows with ``side``: only in a (extra), only in b (missing), in both."""
    told = a.withColumn("__a", F.lit(1)).withColumn("__b", F.lit(0)).unionAll(b.withColumn("__a", F.lit(0)).withColumn("__b", F.lit(1)))
    sides = told.groupBy(*a.columns).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    side = F.when(F.col("__a") > F.col("__b"), "extra").when(F.col("__a") < F.col("__b"), "missing").otherwise("both")
    return sides.select(*a.columns, side.alias("side"))


def distinct_values(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """The distinct values of each group, sorted, and their number."""
    rows = df.select(*by, value.alias("__v")).distinct().groupBy(*by)
    return rows.agg(F.sort_array(F.collect_list("__v")).alias("values"), F.count("__v").alias("n"))


def mode(df: DataFrame, by: list[str], value: Column, name: str = "mode") -> DataFrame:
    """The most frequent value of each group, the least of equally frequent ones."""
    counts = df.groupBy(*by, value.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), name)
    return counts.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def placed(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Rows with their place (from 0) in one order of the whole table.

    A range sort deals the rows and is saved once with each row's partition and its number
    there, so sizes and rows come from the same cut; a partition starts after all before
    it.  No task sees the table, and what is joined is a row for each partition.  Rows
    that are equal in the order go by a hash of all their columns, so that one frequent
    value is spread over partitions, and reruns agree.
    """
    hashed = [f.name for f in df.schema.fields if not re.search("map|variant", f.dataType.simpleString())]
    keys = [o.alias(f"__o{i}") for i, o in enumerate([*order, F.xxhash64(*(F.col(f"`{c}`") for c in hashed))])]
    names = [f"__o{i}" for i in range(len(keys))]
    cut = df.select("*", *keys).repartitionByRange(*names).sortWithinPartitions(*names).drop(*names)
    cut, _ = saved.write(cut.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()))
    sizes = cut.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    starts = sizes.select("__p", before.alias("__s"))
    return cut.join(F.broadcast(starts), "__p").withColumn(name, F.col("__s") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__m", "__s")


def page_range(spec: str, pages: int, keep_repeats: bool = False) -> list[int]:
    """Pages named by ``1-3,7``; a reversed range is swapped, ``all`` or nothing is every page.

    Pages beyond the document are an error.  Repeats and order are kept on demand.
    """
    if spec.strip().lower() in ("", "all"):
        return list(range(1, pages + 1))
    found: list[int] = []
    for part in spec.split(","):
        first, dash, last = part.strip().partition("-")
        a, b = int(first), int(last if dash else first)
        found += range(min(a, b), max(a, b) + 1)
    wrong = sorted({p for p in found if not 1 <= p <= pages})
    if wrong:
        raise ValueError(f"no such pages: {wrong}; the document has {pages}")
    return found if keep_repeats else sorted(set(found))


def pages_of_spec(df: DataFrame, spec: str, page: str) -> DataFrame:
    """Rows whose page their own specification names: ``1-3,7``, ranges in either order, ``all`` or nothing.

    Repeats in a specification name a page once.
    """
    parts = F.transform(F.split(F.trim(F.lower(F.col(spec))), "\\s*,\\s*"), lambda p: F.transform(F.split(p, "\\s*-\\s*"), lambda n: n.try_cast("long")))
    ends = F.transform(parts, lambda p: F.struct(F.array_min(p).alias("a"), F.array_max(p).alias("b")))
    whole = F.coalesce(F.trim(F.lower(F.col(spec))).isin("", "all"), F.lit(True))
    return df.where(whole | F.exists(ends, lambda e: F.col(page).between(e.a, e.b)))


def select_pages(df: DataFrame, pages: list[int], column: str = "page_number") -> DataFrame:
    """Rows of the pages; a plain filter, so scans of partitioned tables are pruned."""
    return df.where(F.col(column).isin(pages))


def sheet_order(sheet: Column, page: Column) -> list[Column]:
    """Numeric sheets first, by number, then others by page."""
    number = F.replace(sheet, F.lit(","), F.lit(".")).try_cast("double")
    return [F.when(number.isNotNull(), 0).when(sheet.isNotNull(), 1).otherwise(2), number, page]


def natural_order(name: Column) -> list[Column]:
    """By the number in a name, then the name."""
    number = F.regexp_extract(name, "(\\d+)", 1).try_cast("bigint")
    return [number.isNull(), number, name]


def joined_spans(rows: list) -> list[tuple]:
    """``group_spans`` of the rows of one sheet: the elements (``JOINED``) in order."""
    out: list[list] = []
    for s in sorted(rows, key=lambda r: (round(r.y0 * 10), r.x0, r.y0, r.x1, r.y1, r.text)):
        if out:
            e = out[-1]
            height = s.y1 - s.y0
            level, gap = abs(s.y0 - e[2]) <= max(1.5, 0.35 * min(height, e[4] - e[2])), s.x0 - e[3]
            if level and -0.5 <= gap <= max(2.0, 0.6 * height):
                out[-1] = [f"{e[0]} {s.text}", min(e[1], s.x0), min(e[2], s.y0), max(e[3], s.x1), max(e[4], s.y1)]
                continue
        out.append([s.text, s.x0, s.y0, s.x1, s.y1])
    return [(n, *e) for n, e in enumerate(out, 1)]


def group_spans(spans: DataFrame, by: list[str]) -> DataFrame:
    """Text spans (text, x0, y0, x1, y1) that nearly touch on one line, joined.

    The state of a running element (its growing box) decides about the next span,
    so sheets are folded one by one: an array of spans in reading order goes
    through ``aggregate``.  A sheet is a few hundred spans.
    """
    box = ["x0", "y0", "x1", "y1"]
    order = F.struct(F.rint(F.col("y0") * 10).alias("k"), F.col("x0").alias("kx"), *box, "text")
    rows = spans.groupBy(*by).agg(F.array_sort(F.collect_list(order)).alias("s"))
    element = "array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>"

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        height = s.y1 - s.y0
        level = F.abs(s.y0 - last.y0) <= F.greatest(F.lit(1.5), F.lit(0.35) * F.least(height, last.y1 - last.y0))
        gap = s.x0 - last.x1
        touch = level & (gap >= -0.5) & (gap <= F.greatest(F.lit(2.0), F.lit(0.6) * height))
        one = F.struct(s.text.alias("text"), *(s[c].alias(c) for c in box))
        grown = F.struct(
            F.concat_ws(" ", last.text, s.text).alias("text"), F.least(last.x0, s.x0).alias("x0"), F.least(last.y0, s.y0).alias("y0"),
            F.greatest(last.x1, s.x1).alias("x1"), F.greatest(last.y1, s.y1).alias("y1"),
        )
        join = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))
        return F.when((F.size(done) > 0) & F.coalesce(touch, F.lit(False)), join).otherwise(F.concat(done, F.array(one)))

    start = F.array().cast(element)
    folded = rows.select(*by, F.aggregate(F.col("s"), start, lambda a, s: step(F.when(F.size(a) > 0, a).otherwise(start), s)).alias("e"))
    return folded.select(*by, F.posexplode("e").alias("i", "e")).select(*by, (F.col("i") + 1).alias("n"), "e.*")


#: What ``cluster_lines`` and ``group_spans`` give of a sheet.
LINES, JOINED = "line int, text string, y double", "n int, text string, x0 double, y0 double, x1 double, y1 double"


def lines_of(rows: list, tolerance: float) -> list[tuple]:
    """The lines (``LINES``) of one sheet's sorted words."""
    lines: list[list] = []
    for w in rows:
        y = (w.y0 + w.y1) / 2
        for line in lines:
            if abs(line[0] - y) <= tolerance:
                line[1].append((w.x0, w.word))
                line[0] += (y - line[0]) / len(line[1])
                break
        else:
            lines.append([y, [(w.x0, w.word)]])
    lines.sort(key=lambda x: x[0])
    return [(n, " ".join(t for _, t in sorted(x[1])), x[0]) for n, x in enumerate(lines, 1)]


def cluster_lines(words: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """Words (word, x0, y0, x1, y1) as lines: each joins the first line whose mean height is near.

    A line's height is the running mean of its words, so the order matters.
    """
    return each_group(words.select(*by, "word", "x0", "y0", "x1", "y1"), by, ["y0", "x0", "x1", "word"], lambda rows: lines_of(rows, tolerance), LINES)


def tokens_of_spans(spans: DataFrame, by: list[str], least_height: float = 0.0) -> DataFrame:
    """Characters of spans cut at white space into tokens with their boxes.

    ``spans`` has chars array<struct<c, x0, y0, x1, y1>> and font_size; tokens keep
    the span's ordinal and their own.  Fonts under the least height are dropped.
    """
    kept = spans.where(F.col("font_size") >= least_height) if least_height > 0 else spans
    chars = kept.withColumn("__s", F.monotonically_increasing_id()).select(*by, "__s", "font_size", F.posexplode("chars").alias("i", "ch"))
    blank = F.trim(F.translate(F.col("ch.c"), "\t\n\r ", "    ")) == ""
    runs = Window.partitionBy("__s").orderBy("i")
    chars = chars.withColumn("blank", blank).withColumn("token", F.sum(F.col("blank").cast("int")).over(runs))
    words = chars.where(~F.col("blank")).groupBy(*by, "__s", "token").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("ch.c").alias("c")))), lambda x: x.c), "").alias("text"), F.first("font_size").alias("font_size"),
        F.min("ch.x0").alias("x0"), F.min("ch.y0").alias("y0"), F.max("ch.x1").alias("x1"), F.max("ch.y1").alias("y1"),
    )
    return words.withColumn("span", F.dense_rank().over(Window.partitionBy(*by).orderBy("__s"))).drop("__s")


def text_index(items: DataFrame, by: list[str], key: Column) -> DataFrame:
    """Key to ordered positions of its occurrences."""
    return items.groupBy(*by, key.alias("key")).agg(F.sort_array(F.collect_list("n")).alias("positions"))


def inside_box(items: DataFrame, frame: list[Column]) -> DataFrame:
    """Items flagged by whether their centre lies in the half-open frame."""
    return items.withColumn("kept", geometry.center_inside([F.col(c) for c in ("x0", "y0", "x1", "y1")], frame))

