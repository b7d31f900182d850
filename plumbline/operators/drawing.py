"""Dimensions of a sheet from its drawn primitives.

Stages are DataFrames keyed by sheet: scale, limits, strokes, contours, numbers,
arrow tips, spans, leaders.  Only the last, the one-to-one attachment of numbers,
depends on the order of its own choices and takes a sheet's rows as one group.
Paths and words move once, to their sheet, before they are cut into strokes; strokes
meet their tips there, in numpy (``arrows``).  Joins have the sheet as their whole key and find short
lists (numbers, strokes, frames).

Inputs (see README): sheets, paths, words and spans, with ``doc_id`` and
``page_number`` as the sheet's key and ordinals that keep the drawing order.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.functions import geometry as G
from plumbline.functions import num
from plumbline.operators import arrows, polygons, sequence, spatial

SHEET = ["doc_id", "page_number"]
#: The limits below hold for a sheet with this size of numbers, or this shorter side.
REF_TEXT_SIZE, REF_SIDE, LEAST_SIZES = 7.43, 841.89, 5
DEFAULT_WIDTH = 0.48


@dataclass(frozen=True)
class Limits:
    """Lengths in points of the reference sheet; areas in square points; fixed values."""

    width_tol: float = 0.05
    min_length: float = 12.0
    arrow_gap: float = 0.2
    label_gap: float = 16.0
    leader_min_length: float = 8.0
    leader_label_gap: float = 12.0
    leader_anchor_gap: float = 2.5
    arrow_max_area: float = 30.0
    min_label_height: float = 4.0
    line_gap: float = 8.0
    frame_overshoot: float = 1.2
    frame_margin: float = 0.3
    frame_min_side: float = 5.0
    frame_max_side: float = 60.0
    ring_min_segments: int = 8
    ring_min_fill: float = 0.55


#: Not lengths: a power of the scale other than one.
POWERS = {"arrow_max_area": 2, "ring_min_segments": 0, "ring_min_fill": 0}


def sheet_scale(sheets: DataFrame, spans: DataFrame, auto: bool = True, least: float = 0.2, most: float = 8.0) -> DataFrame:
    """Sheets with ``scale`` and ``scale_source``: text, side or fixed, and + clamped.

    The upper median of the font sizes of numbers decides if there are five or more.
    """
    text = F.coalesce(F.col("text"), F.array_join(F.transform("chars", lambda c: c.c), "")) if "text" in spans.columns else F.array_join(F.transform("chars", lambda c: c.c), "")
    sizes = spans.where(num.is_number_label(text) & (F.col("font_size") > 0)).groupBy(*SHEET).agg(F.collect_list(F.bround("font_size", 3)).alias("sizes"))
    out = sheets.join(sizes, SHEET, "left")
    by_text = F.coalesce(F.size("sizes") >= LEAST_SIZES, F.lit(False)) if auto else F.lit(False)
    raw = F.when(by_text, num.upper_median(F.col("sizes")) / REF_TEXT_SIZE).otherwise(F.least("width_pt", "height_pt") / REF_SIDE if auto else F.lit(1.0))
    source = F.when(by_text, F.lit("text")).otherwise(F.lit("side" if auto else "fixed"))
    clamped = (raw < least) | (raw > most)
    source = F.when(clamped, F.concat(source, F.lit("+clamped"))).otherwise(source)
    return out.select(*sheets.columns, F.greatest(F.least(raw, F.lit(most)), F.lit(least)).alias("scale"), source.alias("scale_source"))


def scaled_limits(scale: Column, limits: Limits) -> list[Column]:
    """Columns of all limits at a sheet's scale."""
    out = []
    for name, value in asdict(limits).items():
        power = POWERS.get(name, 1)
        out.append((F.lit(value) * F.pow(scale, F.lit(power)) if power else F.lit(value)).alias(name))
    return out


def strokes(paths: DataFrame) -> DataFrame:
    """Straight strokes of paths: lines as they are, rectangles as four sides, no curves.

    Columns: the sheet, path_id, ord, filled, stroke_width, ax, ay, bx, by.
    """
    rows = paths.select(*SHEET, "path_id", is_filled().alias("filled"), F.coalesce("stroke_width", F.lit(0.0)).alias("stroke_width"), F.posexplode(strokes_of("items")).alias("ord", "s"))
    return rows.select(*SHEET, "path_id", "ord", "filled", "stroke_width", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def is_filled() -> Column:
    return F.coalesce(F.size("fill") > 0, F.lit(False))


def strokes_of(items: str) -> Column:
    """The strokes (ends a and b) of a path's items, as an array."""
    corner = lambda i, a, b: F.struct(i[a].alias("x"), i[b].alias("y"))
    ends = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
    sides = lambda i: F.array(*[F.struct(corner(i, *ends[k]).alias("a"), corner(i, *ends[(k + 1) % 4]).alias("b")) for k in range(4)])
    line = lambda i: F.array(F.struct(corner(i, "x0", "y0").alias("a"), corner(i, "x1", "y1").alias("b")))
    none = lambda i: F.slice(line(i), 1, 0)
    return F.flatten(F.transform(items, lambda i: F.when(i.kind == "l", line(i)).when(i.kind == "re", sides(i)).otherwise(none(i))))


def judged_numbers(words: DataFrame, limits: DataFrame, contours: DataFrame) -> DataFrame:
    """Numeric words with ``verdict``: too_small, in_row, in_contour or ok, in this order.

    In a row: another word of the same line within the gap on either side, or over it.
    """
    box = list(spatial.BOX)
    row = [*SHEET, "block_no", "line_no"]
    beside = F.when(F.col("block_no").isNotNull() & F.col("line_no").isNotNull(), F.collect_list(F.struct(*box)).over(Window.partitionBy(*row)))
    rows = words.select(*row, "word_no", "word", *box, beside.alias("__beside")).join(limits.select(*SHEET, "min_label_height", "line_gap", "frame_overshoot", "frame_margin"), SHEET)
    numbers = rows.where(num.is_number_label(F.col("word")))

    def near(o: Column) -> Column:
        same = (o.x0 == F.col("x0")) & (o.y0 == F.col("y0")) & (o.x1 == F.col("x1")) & (o.y1 == F.col("y1"))
        return (((o.x1 < F.col("x0")) & (F.col("x0") - o.x1 < F.col("line_gap"))) | ((o.x0 > F.col("x1")) & (o.x0 - F.col("x1") < F.col("line_gap"))) | ((o.x0 <= F.col("x0")) & (o.x1 >= F.col("x1")))) & ~same

    frames = contours.groupBy(*SHEET).agg(F.collect_list(F.struct(*box)).alias("__frames"))
    judged = numbers.withColumn("crowded", F.exists("__beside", near)).drop("__beside").join(frames, SHEET, "left")
    held = F.exists("__frames", lambda f: G.wraps([f[c] for c in box], [F.col(c) for c in box], F.col("frame_overshoot"), F.col("frame_margin")))
    verdict = F.when(F.col("y1") - F.col("y0") < F.col("min_label_height"), "too_small").when(F.col("crowded"), "in_row").when(held, "in_contour").otherwise("ok")
    return judged.select(*row, "word_no", F.col("word").alias("text"), *box, verdict.alias("verdict"))


def stroke_width(segments: DataFrame, tips: DataFrame, limits: DataFrame) -> DataFrame:
    """The commonest width of strokes with arrows at both ends; the thinnest of equals."""
    long = segments.where(~F.col("filled")).join(limits.select(*SHEET, "min_length", "arrow_gap"), SHEET).where(G.dist(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) >= F.col("min_length"))
    long = long.withColumn("seg", F.concat_ws(":", "path_id", "ord"))
    spans = spatial.tips_at_ends(long, tips, SHEET, "seg", F.col("arrow_gap")).where("at_a and at_b and only_a and only_b")
    return sequence.mode(spans, SHEET, F.bround("stroke_width", 2), "width")


#: What ``attach`` gives of a sheet.
PAIRS = "kind string, number int, line int, leader int"


def deal(numbers: list, spans: list, leaders: list, label_gap: float, leader_label_gap: float) -> list[tuple]:
    """(kind, number, span, leader) as places in the lists of one sheet, which are in the order of n; see ``attach``."""
    hyp = lambda x, y: (x * x + y * y) ** 0.5

    def to_box(x: float, y: float, m) -> float:
        return hyp(max(m.x0 - x, 0.0, x - m.x1), max(m.y0 - y, 0.0, y - m.y1))

    def to_span(px: float, py: float, s, dx: float, dy: float, square: float) -> tuple[float, float]:
        """Distance of a label's centre, and its score: far from the middle costs."""
        t = 0.0 if square < 1e-9 else min(1.0, max(0.0, ((px - s.ax) * dx + (py - s.ay) * dy) / square))
        d = hyp(px - s.ax - t * dx, py - s.ay - t * dy)
        return d, d + 0.35 * abs(t - 0.5) * square**0.5

    def best(scored) -> int | None:
        """Index of the least score; the first of equals."""
        found = min(scored, default=None)
        return None if found is None else found[1]

    free, idle, out = dict.fromkeys(range(len(numbers))), dict.fromkeys(range(len(leaders))), []
    loose = [j for j, x in enumerate(leaders) if x.anchor is None]
    if loose:
        for i, m in enumerate(numbers):
            near = ((to_box(leaders[j].bx, leaders[j].by, m), j) for j in loose if j in idle)
            j = best(x for x in near if x[0] <= leader_label_gap)
            if j is not None:
                del free[i], idle[j]
                out.append(("pointer", i, None, j))
    centres = [((m.x0 + m.x1) / 2, (m.y0 + m.y1) / 2) for m in numbers]
    for k, s in enumerate(spans):
        dx, dy = s.bx - s.ax, s.by - s.ay
        square, far = dx * dx + dy * dy, label_gap * 1.001 + 0.001
        left, right, top, low = min(s.ax, s.bx) - far, max(s.ax, s.bx) + far, min(s.ay, s.by) - far, max(s.ay, s.by) + far
        near = [(i, x, y) for i in free for x, y in (centres[i],) if top <= y <= low and left <= x <= right]  # all others are farther away
        scored = ((to_span(x, y, s, dx, dy, square), i) for i, x, y in near)
        i = best((score, i) for (d, score), i in scored if d <= label_gap)
        if i is not None:
            del free[i]
            out.append(("span", i, k, None))
            continue
        for j in [j for j in idle if leaders[j].anchor == s.n]:
            near = ((to_box(leaders[j].bx, leaders[j].by, numbers[i]), i) for i in free)
            i = best(x for x in near if x[0] <= leader_label_gap)
            if i is not None:
                del free[i], idle[j]
                out.append(("span", i, k, j))
                break
    return out


def dealt_numbers(rows: list) -> list[tuple]:
    """The pairs (``PAIRS``) of one sheet's items, in the order of n; see ``attach``."""
    numbers, spans, leaders = ([r for r in rows if r.kind == k] for k in ("number", "span", "leader"))
    named = lambda of, i: None if i is None else of[i].n
    return [(kind, numbers[i].n, named(spans, k), named(leaders, j)) for kind, i, k, j in deal(numbers, spans, leaders, rows[0].label_gap, rows[0].leader_label_gap)]


def attach(items: DataFrame) -> DataFrame:
    """Numbers dealt one-to-one to leaders and spans; a row for each pair.

    ``items`` has kind (number, span, leader), n (order), text, box x0..y1, ends
    ax..by (leader: tip to tail), anchor (order of the span that a leader points to)
    and the three gaps.  Numbers take free leaders first, then spans take the
    best number near them, at last the one at the end of their anchored leader.
    """
    return sequence.each_group(items, SHEET, ["n", "kind"], dealt_numbers, PAIRS)


#: What ``dealt_lines`` gives of a sheet.
DEALT = f"{PAIRS}, text string, x0 double, y0 double, x1 double, y1 double, ax double, ay double, bx double, by double, length_pt double, stroke_width double, tail_x double, tail_y double"


_NUMBER, _STROKE = namedtuple("_NUMBER", "n x0 y0 x1 y1"), namedtuple("_STROKE", "n ax ay bx by anchor")


def _fields(listed: pa.ListArray) -> tuple[list[int], dict[str, pa.Array]]:
    """Where the lists of a column begin and end, and the fields of all their structs."""
    return listed.offsets.to_pylist(), dict(zip((f.name for f in listed.values.type), listed.values.flatten()))


def dealt_lines(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The pairs of sheets (a row each: the key, its gaps, lists of numbers and strokes, leaders first) with what they join (``DEALT``): the number, its span (a pointer's leader), the leader's tail."""
    (at_number, number), (at_stroke, stroke) = _fields(batch.column("numbers")), _fields(batch.column("strokes"))
    numbers = list(map(_NUMBER._make, zip(*(sequence.values_of(number[c]) for c in _NUMBER._fields))))
    strokes_ = list(map(_STROKE._make, zip(*(sequence.values_of(stroke[c]) for c in _STROKE._fields))))
    leads = np.concatenate([[0], np.cumsum(pc.equal(stroke["kind"], "leader").to_numpy(zero_copy_only=False))]).tolist()
    gaps = zip(*(batch.column(c).to_pylist() for c in ("label_gap", "leader_label_gap")))
    found = []
    for r, (label_gap, leader_label_gap) in enumerate(gaps):
        a, first, end = at_number[r], at_stroke[r], at_stroke[r + 1]
        mid = first + leads[end] - leads[first]
        for kind, i, k, j in deal(numbers[a : at_number[r + 1]], strokes_[mid:end], strokes_[first:mid], label_gap, leader_label_gap):
            found.append((r, kind, a + i, None if k is None else mid + k, None if j is None else first + j))
    row, kind, i, k, j = (pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 5, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())))
    end = pc.coalesce(k, j)
    made = {c: batch.column(c).take(row) for c in SHEET} | {"kind": kind, "number": number["n"].take(i), "line": stroke["n"].take(k), "leader": stroke["n"].take(j)}
    made |= {c: number[c].take(i) for c in ("text", *spatial.BOX)} | {c: stroke[c].take(end) for c in ("ax", "ay", "bx", "by", "length_pt", "stroke_width")}
    made |= {"tail_x": stroke["bx"].take(j), "tail_y": stroke["by"].take(j)}
    return pa.RecordBatch.from_arrays([made[f.name].cast(f.type) for f in schema], schema=schema)


def _dealt(sheets: DataFrame) -> DataFrame:
    """``dealt_lines`` of sheets."""
    types = {f.name: f.dataType.simpleString() for f in sheets.schema.fields}
    schema = StructType.fromDDL(", ".join([*(f"`{c}` {types[c]}" for c in SHEET), DEALT]))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (dealt_lines(b, arrow) for b in batches if b.num_rows)

    return sheets.mapInArrow(run, schema)


def pointed(segments: DataFrame) -> DataFrame:
    """Strokes with an arrow of their own at both ends (kind span) or at exactly one end (leader).

    ``segments`` have length_pt, the limits min_length, leader_min_length and arrow_gap
    and the tips of their sheet as a list; n numbers each kind in drawing order.
    """
    ended = spatial.touched(segments, "tips", F.col("arrow_gap"))
    span, leader = F.expr("length_pt >= min_length and at_a and at_b and only_a and only_b"), F.expr("length_pt >= leader_min_length and at_a <> at_b")
    drawn = Window.partitionBy(*SHEET, "kind").orderBy("path_id", "ord")
    return ended.withColumn("kind", F.when(span, "span").when(leader, "leader")).where("kind is not null").withColumn("n", F.row_number().over(drawn))


def _turned() -> list[Column]:
    """Ends of ``pointed`` strokes: a leader goes from its tip (a) to its tail (b)."""
    back = (F.col("kind") == "leader") & ~F.col("at_a")
    return [F.when(back, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))]


def _length() -> Column:
    return G.dist(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))


def arrowed(segments: DataFrame, tips: DataFrame, limits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, leaders): strokes with an arrow of their own at both ends, and at exactly one end.

    Both are numbered (n) in drawing order; a leader goes from its tip (a) to its tail (b).
    """
    long = segments.withColumn("length_pt", _length()).join(limits.select(*SHEET, "min_length", "leader_min_length", "arrow_gap"), SHEET)
    found = pointed(long.join(tips.groupBy(*SHEET).agg(F.collect_list(F.struct("x", "y")).alias("tips")), SHEET, "left"))
    return found.where("kind = 'span'").drop("kind"), found.where("kind = 'leader'").select(*SHEET, "n", "stroke_width", "length_pt", *_turned())


def _middle() -> Column:
    return F.struct(F.col("n").alias("span"), ((F.col("ax") + F.col("bx")) / 2).alias("mx"), ((F.col("ay") + F.col("by")) / 2).alias("my"))


def _anchor(middles: str) -> Column:
    """The first span in whose middle a leader points."""
    near = F.filter(middles, lambda m: F.hypot(m.mx - F.col("ax"), m.my - F.col("ay")) <= F.col("leader_anchor_gap"))
    return F.array_min(F.transform(near, lambda m: m.span)).alias("anchor")


def anchored(leaders: DataFrame, spans: DataFrame, limits: DataFrame) -> DataFrame:
    """Leaders with ``anchor``: the first span in whose middle they point; null if none."""
    middles = spans.groupBy(*SHEET).agg(F.collect_list(_middle()).alias("__m"))
    rows = leaders.join(middles, SHEET, "left").join(limits.select(*SHEET, "leader_anchor_gap"), SHEET, "left")
    return rows.select(*leaders.columns, _anchor("__m"))


def detect(sheets: DataFrame, paths: DataFrame, words: DataFrame, spans: DataFrame, limits: Limits = Limits(), width: float | None = DEFAULT_WIDTH, auto_scale: bool = True) -> dict[str, DataFrame]:
    """All tables of a detection: lines, numbers, orphans, contours, limits and stats.

    ``width`` is the stroke width of dimension lines on the reference sheet; None
    measures it on each sheet.
    """
    scale = sheet_scale(sheets, spans, auto_scale)
    lim = scale.select(*SHEET, "scale", "scale_source", *scaled_limits(F.col("scale"), limits))
    # In so many parts as the session has: small tables as they are when packed, lists and sorts take many times that.
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths, words = paths.repartition(parts, *SHEET), words.repartition(parts, *SHEET)
    tipped = polygons.path_tips(paths.where(is_filled()), SHEET, strokes_of("items")).groupBy(*SHEET).agg(F.collect_list(F.struct("path_id", "area", "x", "y")).alias("tips"))
    tipped = lim.select(*SHEET, "arrow_max_area").join(tipped, SHEET, "left").select(*SHEET, F.filter("tips", lambda t: t.area <= F.col("arrow_max_area")).alias("tips"))
    tips = tipped.select(*SHEET, F.inline("tips"))
    open_ = paths.where(~is_filled())
    if width is None:
        measured = stroke_width(strokes(paths), tips, lim)
        lim = lim.join(measured.select(*SHEET, "width"), SHEET, "left").withColumn("width", F.coalesce("width", F.lit(DEFAULT_WIDTH)))
    else:
        lim = lim.withColumn("width", F.lit(width) * F.col("scale"))
    many = F.expr("size(items) > 2 or exists(items, i -> i.kind = 're')")
    closed = strokes(open_.where(many).where(F.size(strokes_of("items")) > 2))  # fewer strokes are no frame
    contours = polygons.contours(closed.join(lim.select(*SHEET, "frame_min_side", "frame_max_side", "ring_min_segments", "ring_min_fill"), SHEET), SHEET)
    numbers = judged_numbers(words, lim, contours)
    line_order = Window.partitionBy(*SHEET).orderBy("block_no", "line_no", "x0", "word_no")
    marks = numbers.where("verdict = 'ok'").withColumn("n", F.row_number().over(line_order))

    drawn = arrows.arrowed(paths, lim, SHEET, is_filled())
    strokes_ = drawn.select(*SHEET, F.inline("strokes"))
    spans_, leaders = strokes_.where("kind = 'span'"), strokes_.where("kind = 'leader'")

    box, values = list(spatial.BOX), ["ax", "ay", "bx", "by", _length().alias("length_pt"), "stroke_width"]
    held = sequence.listed(marks, SHEET, ["block_no", "line_no", "x0", "word_no"], ["n", "text", *box], "numbers")
    pairs = _dealt(lim.select(*SHEET, "label_gap", "leader_label_gap").join(held, SHEET).join(drawn, SHEET))

    out = pairs.select(
        *SHEET, "kind", F.col("text").alias("label"), num.number_value(F.col("text")).alias("value"), *box, *values,
        F.when((F.col("kind") == "span") & F.col("leader").isNotNull(), F.struct(F.col("tail_x").alias("x"), F.col("tail_y").alias("y"))).alias("leader_end"), "number",
    )
    out = out.withColumn("angle", G.angle(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    my, mx = (F.col("ay") + F.col("by")) / 2, (F.col("ax") + F.col("bx")) / 2
    lines = sequence.numbered(out, SHEET, sequence.reading_order(my, mx, F.col("kind"), F.col("number")), "idx")
    orphans = marks.join(pairs.select(*SHEET, F.col("number").alias("n")), [*SHEET, "n"], "left_anti")
    stats = lim.select(*SHEET, "scale", "scale_source", "width")
    counts = {
        "arrows": tips, "contours": contours, "spans": spans_, "leaders": leaders, "leaders_anchored": leaders.where("anchor is not null"),
        "numeric_words": numbers, "numbers": marks, "lines": out,
    }
    for name, t in counts.items():
        stats = stats.join(t.groupBy(*SHEET).agg(F.count(F.lit(1)).alias(name)), SHEET, "left").fillna(0, [name])
    return {"lines": lines, "numbers": numbers, "orphans": orphans, "contours": contours, "limits": lim, "stats": stats}


def rejected(numbers: DataFrame) -> DataFrame:
    """Texts of numbers turned down for their row or frame, in order, and counts of all reasons."""
    order = F.struct("block_no", "line_no", "x0", "word_no", "text")
    told = F.col("verdict").isin("in_row", "in_contour")
    return numbers.groupBy(*SHEET).agg(
        F.transform(F.sort_array(F.collect_list(F.when(told, order))), lambda x: x.text).alias("texts"),
        *[F.count_if(F.col("verdict") == v).alias(v) for v in ("too_small", "in_row", "in_contour")],
    )


def marks_in_pixels(lines: DataFrame, view: DataFrame) -> DataFrame:
    """Marks P1.. in display order with pixel boxes; lines without a value are left out.

    ``view`` has zoom, dx and dy for each sheet.
    """
    v = lines.where("value is not null").join(view, SHEET)
    z = [F.col("zoom"), F.col("dx"), F.col("dy")]
    label = G.affine_box([F.col(c) for c in spatial.BOX], *z)
    line = G.affine_box([F.least("ax", "bx"), F.least("ay", "by"), F.greatest("ax", "bx"), F.greatest("ay", "by")], *z)
    out = v.select(*SHEET, "value", "label", "kind", "angle", G.axis_of(F.col("angle")).alias("axis"), "idx", *[x.alias(c) for x, c in zip(label, spatial.BOX)], F.struct(*[x.alias(c) for x, c in zip(line, spatial.BOX)]).alias("line_box"))
    return sequence.numbered(out, SHEET, sequence.reading_order(F.col("y0"), F.col("x0"), F.col("idx")), "mark_id", "P").drop("idx")


#: Words of a mark's line in the prompt.
KIND_WORDS, LINE_WORD, AXIS_WORD = {"span": "отрезок", "pointer": "выноска"}, "линия", "ось"


def _whole(box: list[Column]) -> Column:
    """A box in whole pixels, in brackets."""
    return F.concat(F.lit("["), F.concat_ws(",", *[F.bround(c, 0).cast("long").cast("string") for c in box]), F.lit("]"))


def prompt_block(marks: DataFrame) -> DataFrame:
    """One text block for each sheet, a line for each mark in order: its label, box and line box, kind, axis and degrees."""
    n = F.regexp_extract("mark_id", "(\\d+)", 1).cast("int")
    words = F.create_map(*(F.lit(x) for pair in KIND_WORDS.items() for x in pair))
    degrees = F.concat(F.lit("("), F.bround("angle", 0).cast("long").cast("string"), F.lit("°)"))
    line = F.concat_ws(
        " ", "mark_id", F.concat(F.lit('"'), F.col("label"), F.lit('"')), _whole([F.col(c) for c in spatial.BOX]), F.lit(LINE_WORD), _whole([F.col(f"line_box.{c}") for c in spatial.BOX]),
        F.coalesce(F.try_element_at(words, F.col("kind")), F.col("kind")), F.lit(AXIS_WORD), F.col("axis").cast("string"), degrees,
    )
    rows = marks.select(*SHEET, F.struct(n.alias("n"), line.alias("t")).alias("r")).groupBy(*SHEET).agg(F.sort_array(F.collect_list("r")).alias("r"))
    return rows.select(*SHEET, F.array_join(F.transform("r", lambda r: r.t), "\n").alias("block"))
