"""The text layer of sheets: items in pixels, lines, searches, dumps, prompt blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators import sequence

BOX = ("x0", "y0", "x1", "y1")


def in_units(box: list, unit: str, page_height=None, dpi: float = 72.0, bottom_left: bool = False) -> list:
    """A box in pt, px, in or mm, two decimals; the y axis up on demand."""
    x0, y0, x1, y1 = box
    if bottom_left:
        y0, y1 = page_height - y1, page_height - y0
    return [G.to_unit(v, unit, F.lit(dpi / 72.0)) for v in (x0, y0, x1, y1)]


def text_items(spans: DataFrame, view: DataFrame, by: list[str], least_px: float = 0.0, most: int | None = None) -> DataFrame:
    """Tokens of spans in pixels of the picture, each text and place once, in reading order.

    ``view`` has zoom, dx and dy; fonts below ``least_px`` pixels are dropped; of more
    than ``most`` items evenly spaced ones are taken.  Column n numbers the items.
    """
    z = [F.col("zoom"), F.col("dx"), F.col("dy")]
    tokens = sequence.tokens_of_spans(spans, by).join(view, by)
    if least_px > 0:
        tokens = tokens.where(F.col("font_size") * F.col("zoom") >= least_px)
    boxes = G.affine_box([F.col(c) for c in BOX], *z)
    rows = tokens.select(*by, "text", (F.col("font_size") * F.col("zoom")).alias("size"), "span", "token", *[b.alias(c) for b, c in zip(boxes, BOX)])
    rows = rows.withColumn("place", F.struct(*[F.bround(c, 1) for c in BOX]))
    rows = sequence.keep_first(rows, [*by, "text", "place"], [F.col("span"), F.col("token")]).drop("place")
    order = sequence.reading_order(F.col("y0"), F.col("x0"), F.col("span"), F.col("token"))
    if most is not None:
        rows = sequence.systematic_sample(rows, by, order, most)
    return sequence.numbered(rows, by, order, "n").drop("span", "token")


def line_items(spans: DataFrame, by: list[str], least_size: float = 0.0) -> DataFrame:
    """Text lines with box, centre, largest font size and angle (counter-clockwise, y up).

    ``spans`` has block_no, line_no, text, font_size, dir_x, dir_y and the box; blank
    spans are skipped.
    """
    kept = spans.where(F.trim("text") != "")
    parts = F.array_sort(F.collect_list(F.struct("x0", F.col("span_no").alias("k"), "text")))
    lines = kept.groupBy(*by, "block_no", "line_no").agg(
        F.trim(F.array_join(F.transform(parts, lambda p: p.text), " ")).alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.bround(F.max("font_size"), 2).alias("size"), F.first("dir_x").alias("dx"), F.first("dir_y").alias("dy"),
    )
    lines = lines.where(F.col("size") >= least_size)
    rows = lines.select(*by, "block_no", "line_no", "text", *[F.bround(c, 2).alias(c) for c in BOX], "size", F.bround(F.degrees(F.atan2(-F.col("dy"), F.col("dx"))), 1).alias("angle"))
    rows = rows.withColumn("cx", F.bround((F.col("x0") + F.col("x1")) / 2, 2)).withColumn("cy", F.bround((F.col("y0") + F.col("y1")) / 2, 2))
    return sequence.numbered(rows, by, sequence.reading_order(F.col("y0"), F.col("x0"), F.col("block_no"), F.col("line_no")), "n")


def find(lines: DataFrame, needle: str, case_sensitive: bool = False) -> DataFrame:
    """Lines that hold the needle."""
    hay = F.col("text") if case_sensitive else F.lower("text")
    return lines.where(F.contains(hay, F.lit(needle if case_sensitive else needle.lower())))


def occurrences(lines: DataFrame, needle: str) -> DataFrame:
    """Each occurrence of the needle in a line (any case), with a box in proportion to its characters.

    The text is cut at the needle, and the cuts' lengths are summed up, so a long line
    costs what its length is.
    """
    size = len(needle)
    cuts = F.split(F.lower("text"), "\\Q" + needle.lower() + "\\E", -1)
    starts = F.aggregate(
        F.slice(cuts, 1, F.size(cuts) - 1), F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found")),
        lambda s, cut: F.struct((s.at + F.length(cut) + size).alias("at"), F.concat(s.found, F.array(s.at + F.length(cut))).alias("found")), lambda s: s.found,
    )
    hits = find(lines, needle).withColumn("at", F.explode(starts))
    step = (F.col("x1") - F.col("x0")) / F.length("text")
    left = F.col("x0") + (F.col("at") - 1) * step
    return hits.withColumn("x1", left + size * step).withColumn("x0", left)


def glyphs(spans: DataFrame, by: list[str]) -> DataFrame:
    """Characters of pages as they are searched: (by, k, c, block_no, line_no, box), numbered by k from 1.

    Small letters, and one blank for any run of white space; a line's end is white space
    too, without a box.  A character whose small form is longer stays as it is.
    """
    at = ["block_no", "line_no", "span_no", "i"]
    chars = spans.select(*by, *at[:3], F.posexplode("chars").alias("i", "ch")).select(*by, *at, "ch.*")
    nowhere = F.lit(None).cast("double")
    ends = spans.select(*by, "block_no", "line_no").distinct().select(*by, "block_no", "line_no", F.lit(-1).alias("span_no"), F.lit(-1).alias("i"), F.lit(" ").alias("c"), *[nowhere.alias(b) for b in BOX])
    rows = chars.select(*by, *at, "c", *BOX).unionByName(ends)
    blank = F.coalesce(F.col("c").rlike("^(?U)\\s*$"), F.lit(True))
    page = Window.partitionBy(*by).orderBy(*at)
    rows = rows.withColumn("__b", blank)
    rows = rows.withColumn("__p", F.lag("__b", 1, True).over(page)).where(~F.col("__b") | ~F.col("__p"))
    small = F.when(F.col("__b"), " ").when(F.length(F.lower("c")) == F.length("c"), F.lower("c")).otherwise(F.col("c"))
    return rows.select(*by, F.row_number().over(page).alias("k"), small.alias("c"), "block_no", "line_no", *BOX)


def glyph_hits(spans: DataFrame, by: list[str], needle: str) -> DataFrame:
    """Each occurrence of the needle on a page with the exact boxes of its glyphs: (by, hit, part, block_no, line_no, box).

    Any case and any white space match; a hit may go over the ends of lines and then has
    a part with a box for each.  Hits are numbered from 1 and don't overlap.  ``spans``
    has block_no, line_no, span_no and chars; a page is a few thousand characters.
    """
    wanted = " ".join(needle.split()).lower()
    if not wanted:
        raise ValueError("nothing to search for")
    found = glyphs(spans, by)
    one = F.substring("c", 1, 1)  # a glyph of several characters (a ligature) is found by its first
    text = found.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", one.alias("c")))), lambda x: x.c), "").alias("__t"))
    cuts = F.split("__t", "\\Q" + wanted.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    starts = F.aggregate(
        F.slice(cuts, 1, F.size(cuts) - 1), F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found")),
        lambda s, cut: F.struct((s.at + F.length(cut) + len(wanted)).alias("at"), F.concat(s.found, F.array(s.at + F.length(cut))).alias("found")), lambda s: s.found,
    )
    hits = text.where(F.contains("__t", F.lit(wanted))).select(*by, F.posexplode(starts).alias("hit", "__s"))
    each = hits.select(*by, (F.col("hit") + 1).alias("hit"), F.explode(F.sequence("__s", F.col("__s") + len(wanted) - 1)).alias("k"))
    lines = each.join(found, [*by, "k"]).where("x0 is not null and c <> ' '").groupBy(*by, "hit", "block_no", "line_no")
    boxes = lines.agg(F.min("k").alias("__k"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return sequence.numbered(boxes, [*by, "hit"], [F.col("__k")], "part").drop("__k")


def page_text(lines: DataFrame, by: list[str]) -> DataFrame:
    """One text for each page, a line for each line item in order; blank ones are left out."""
    rows = lines.where(F.trim("text") != "").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("n", "text"))).alias("t"))
    return rows.select(*by, F.array_join(F.transform("t", lambda t: F.trim(t.text)), "\n").alias("text"))


def page_blocks(lines: DataFrame, by: list[str]) -> DataFrame:
    """One text for each page with all its lines, trimmed, blank ones kept: the block mode."""
    rows = lines.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("n", "text"))).alias("t"))
    return rows.select(*by, F.array_join(F.transform("t", lambda t: F.trim(t.text)), "\n").alias("text"))


def sorted_words(words: DataFrame, by: list[str], tolerance: float = 3.0, least_height: float = 0.0) -> DataFrame:
    """One text for each page by the place of its words, whatever their order: the sorted mode.

    Words lower than ``least_height`` are left out.
    """
    high = words.where(F.col("y1") - F.col("y0") >= least_height)
    lines = sequence.cluster_lines(high, by, tolerance)
    return page_blocks(lines.select(*by, F.col("line").alias("n"), "text"), by)


def is_numeric(text: Column) -> Column:
    """Labels of digits, points and commas alone."""
    return text.rlike("(?U)^[\\d.,]+$")


def numbers(items: DataFrame) -> DataFrame:
    """Items whose text is such a label."""
    return items.where(is_numeric(F.col("text")))


def prompt_block(items: DataFrame, sheets: DataFrame, by: list[str], title: str = "Text layer of the sheet") -> DataFrame:
    """A block for each sheet: title, picture size, a line for each item; another text where there is none.

    ``sheets`` has width and height of the picture.
    """
    box = F.concat(F.lit("["), F.concat_ws(",", *[F.bround(c, 0).cast("long").cast("string") for c in BOX]), F.lit("]"))
    row = F.struct("n", F.concat(F.lit('"'), F.col("text"), F.lit('" '), box).alias("t"))
    listed = items.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("r"))
    out = sheets.join(listed, by, "left")
    head = F.concat(F.lit(f"# {title}\n\n"))
    full = F.concat(head, F.lit("Picture: "), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), F.lit(" px.\n\n"), F.array_join(F.transform("r", lambda r: r.t), "\n"))
    return out.select(*by, F.when(F.col("r").isNull(), F.concat(head, F.lit("The text layer is empty: this is a scan."))).otherwise(full).alias("block"))
