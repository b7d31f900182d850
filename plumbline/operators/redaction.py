"""Which texts and frames of a sheet go, decided without touching a page.

What the detection accepted is a dimension; all other text goes, and a rule only
says why.  A box is padded; if the padded box would touch a dimension it is tried
bare, now with a small margin, and skipped if that touches one too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import text
from plumbline.operators import sequence, spatial

#: Points around a box in the plan and at the cut, and the least distances from a dimension of a padded and of a bare box; fixed values.
FRAME_PAD, TOUCH, BARE_TOUCH = 2.4, 0.0, 0.6
BOX = list(spatial.BOX)
#: Share of a stroke that rounding may leave between two parts.
REACH = 1e-9
#: Why a box is left alone.
LABEL_HIT, LINE_HIT = "подпись размера", "размерная линия"


def elements(spans: DataFrame, by: list[str], only_with_digits: bool = True) -> DataFrame:
    """Joined spans as elements N1.. in reading order."""
    joined = sequence.group_spans(spans, by)
    chosen = joined.where(F.col("text").rlike("(?U)\\d")) if only_with_digits else joined
    return sequence.numbered(chosen, by, [F.col("n")], "mark", "N").drop("n")


def assign_roles(items: DataFrame, labels: DataFrame, by: list[str], slack: float = 1.0) -> DataFrame:
    """Elements with accepted, role and reason; ``labels`` are boxes of accepted dimensions."""
    accepted = spatial.band_semi_join(items, labels, by, slack).select(*by, "mark").withColumn("accepted", F.lit(True))
    out = items.join(accepted.distinct(), [*by, "mark"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    role = F.when(F.col("accepted"), "dimension").otherwise(F.coalesce(text.role_of_text(F.col("text")), F.lit("other")))
    reason = F.when(F.col("accepted"), "a dimension line was found for it").otherwise(F.coalesce(text.role_reason(F.col("text")), F.lit("no dimension line was found for it")))
    return out.withColumn("role", role).withColumn("reason", reason)


def plan(items: DataFrame, contours: DataFrame, by: list[str]) -> DataFrame:
    """Boxes of the elements to cut: grown to the frame that holds them, then padded."""
    cut = items.where(text.is_cut(F.col("role")))
    frames = contours.select(*by, "contour_id", *BOX)
    framed = spatial.first_containing(cut, frames, by, "mark", "contour_id")
    f = frames.select(*by, "contour_id", *[F.col(c).alias(f"f_{c}") for c in BOX])
    framed = framed.join(f, [*by, "contour_id"], "left")
    grown = [F.least("x0", "f_x0"), F.least("y0", "f_y0"), F.greatest("x1", "f_x1"), F.greatest("y1", "f_y1")]
    padded = G.grow([F.coalesce(g, F.col(c)) for g, c in zip(grown, BOX)], FRAME_PAD)
    return framed.select(*by, "mark", "text", "role", *[x.alias(c) for x, c in zip(padded, BOX)])


def removable_frames(contours: DataFrame, boxes: DataFrame, by: list[str]) -> DataFrame:
    """Frames around a box of the plan; equal ones (in whole points) once."""
    frames = contours.select(*by, "contour_id", *BOX)
    inside = spatial.holds(G.grow(spatial.left(), 1.0), spatial.right())
    for c in by:
        inside = inside & (F.col(c) == F.col(f"r_{c}"))
    kept = frames.join(spatial.aside(boxes.select(*by, *BOX)), inside, "left_semi")
    return sequence.keep_first(kept, [*by, *[F.col(c).cast("int") for c in BOX]], [F.col("contour_id")])


def guards(lines: DataFrame, by: list[str]) -> DataFrame:
    """What no cut may touch: label boxes and strokes of dimensions, leaders included."""
    ends = ("ax", "ay", "bx", "by")
    kept = lambda what, box, at: F.struct(F.lit(what).alias("what"), *[c.cast("double").alias(n) for n, c in zip([*BOX, *ends], [*box, *at])])
    none, (ax, ay, bx, by_) = [F.lit(None)] * 4, map(F.col, ends)
    lead = F.when(F.col("leader_end").isNotNull(), kept("line", none, [ax, ay, F.col("leader_end.x"), F.col("leader_end.y")]))
    # One pass over the lines, so that a task holds one copy of what makes them.
    found = F.array_compact(F.array(kept("label", map(F.col, BOX), none), kept("line", none, [ax, ay, bx, by_]), lead))
    return lines.select(*by, F.explode(found).alias("__g")).select(*by, "__g.*")


def decide(boxes: DataFrame, guard: DataFrame, by: list[str], pad: float = FRAME_PAD, touch: float = TOUCH, bare_touch: float = BARE_TOUCH) -> DataFrame:
    """Boxes with ``applied``, the padding used and the reason of a skip (label or line)."""
    g = guard.select(*by, "what", *[F.col(c).alias(f"g_{c}") for c in BOX], "ax", "ay", "bx", "by")
    pairs = boxes.join(g, by, "left")
    other = [F.col(f"g_{c}") for c in BOX]

    def hits(margin: float):
        mine = G.grow([F.col(c) for c in BOX], margin)
        label = (F.col("what") == "label") & (mine[0] < other[2]) & (mine[2] > other[0]) & (mine[1] < other[3]) & (mine[3] > other[1])
        line = (F.col("what") == "line") & spatial.rect_hits_segment(mine, F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
        return F.coalesce(label, F.lit(False)), F.coalesce(line, F.lit(False))

    (wide_label, wide_line), (bare_label, bare_line) = hits(pad + touch), hits(bare_touch)
    found = pairs.groupBy(*by, "mark").agg(F.bool_or(wide_label).alias("wl"), F.bool_or(wide_line).alias("wn"), F.bool_or(bare_label | bare_line).alias("bare"))
    out = boxes.join(found, [*by, "mark"])
    free = ~F.col("wl") & ~F.col("wn")
    return out.select(
        *boxes.columns, (free | ~F.col("bare")).alias("applied"), F.when(free, pad).when(~F.col("bare"), 0.0).alias("pad"),
        F.when(~free & F.col("bare"), F.when(F.col("wl"), LABEL_HIT).otherwise(LINE_HIT)).alias("skip_reason"),
    )


def counts(decided: DataFrame, by: list[str], reason: str = "role") -> DataFrame:
    """Applied boxes by reason and skipped ones by what they would have touched, each with its number."""
    told = F.when(F.col("applied"), F.col(reason)).otherwise(F.col("skip_reason"))
    return decided.groupBy(*by, "applied", told.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def kept_geometry(lines: DataFrame, by: list[str]) -> DataFrame:
    """Ends of the dimension lines that a plan must spare, leaders last."""
    own = lines.select(*by, "idx", F.lit("line").alias("part"), "ax", "ay", "bx", "by")
    lead = lines.where("leader_end is not null").select(*by, "idx", F.lit("leader"), "ax", "ay", "leader_end.x", "leader_end.y")
    return own.unionAll(lead)


def applied_boxes(decided: DataFrame, by: list[str]) -> DataFrame:
    """The applied boxes of ``decide``, each grown by the padding that it was applied with."""
    grown = G.grow([F.col(c) for c in BOX], F.col("pad"))
    return decided.where("applied").select(*by, *[x.alias(c) for x, c in zip(grown, BOX)])


def _over(by: list[str], box: list[str], prefix: str = "") -> Column:
    """A box overlaps a cut of its sheet (columns with r_) by more than a line."""
    x0, y0, x1, y1 = (F.col(f"{prefix}{c}") for c in box)
    on = (x0 < F.col("r_x1")) & (x1 > F.col("r_x0")) & (y0 < F.col("r_y1")) & (y1 > F.col("r_y0"))
    for c in by:
        on = on & (F.col(c) == F.col(f"r_{c}"))
    return on


def cut_words(words: DataFrame, cuts: DataFrame, by: list[str]) -> DataFrame:
    """Words (with a box) that no cut overlaps."""
    return words.join(spatial.aside(cuts.select(*by, *BOX)), _over(by, BOX), "left_anti")


def cut_spans(spans: DataFrame, cuts: DataFrame, by: list[str]) -> DataFrame:
    """Spans (chars) without the characters that a cut overlaps; a span left without any goes."""
    listed = cuts.select(*by, F.struct(*BOX).alias("c")).groupBy(*by).agg(F.collect_list("c").alias("__cuts"))
    clear = F.filter("chars", lambda ch: ~F.exists("__cuts", lambda c: (ch.x0 < c.x1) & (ch.x1 > c.x0) & (ch.y0 < c.y1) & (ch.y1 > c.y0)))
    out = spans.join(listed, by, "left")
    kept = out.withColumn("chars", F.when(F.col("__cuts").isNull(), F.col("chars")).otherwise(clear)).drop("__cuts")
    return kept.where(F.size("chars") > 0).select(*spans.columns)


def inside_span(ax: Column, ay: Column, bx: Column, by: Column, box: list[Column]) -> Column:
    """The part [a, b] of a segment, from 0 to 1, that lies in a closed box; null where none does.

    Each side of the box bounds the part; a segment parallel to a pair of sides is
    bounded by the other pair only, if it lies between.
    """
    low, high, clear = [F.lit(0.0)], [F.lit(1.0)], F.lit(True)
    for at, to, first, last in ((ax, bx, box[0], box[2]), (ay, by, box[1], box[3])):
        step = to - at
        s, e = F.try_divide(first - at, step), F.try_divide(last - at, step)
        low.append(F.when(step != 0, F.least(s, e)).otherwise(0.0))
        high.append(F.when(step != 0, F.greatest(s, e)).otherwise(1.0))
        clear = clear & ((step != 0) | ((at >= first) & (at <= last)))
    a, b = F.greatest(*low), F.least(*high)
    return F.when(clear & (a <= b), F.struct(a.alias("a"), b.alias("b")))


def strokes_of(paths: DataFrame, by: list[str]) -> DataFrame:
    """(sheet, path_id, seg, ax, ay, bx, by) of paths (items): a rectangle has its four sides, other items are segments."""
    side = lambda *v: F.struct(*[x.alias(c) for x, c in zip(v, ("ax", "ay", "bx", "by"))])
    four = lambda i: F.array(side(i.x0, i.y0, i.x1, i.y0), side(i.x1, i.y0, i.x1, i.y1), side(i.x1, i.y1, i.x0, i.y1), side(i.x0, i.y1, i.x0, i.y0))
    sides = F.flatten(F.transform("items", lambda i: F.when(i.kind == "re", four(i)).otherwise(F.array(side(i.x0, i.y0, i.x1, i.y1)))))
    return paths.select(*by, "path_id", F.posexplode(sides).alias("seg", "s")).select(*by, "path_id", "seg", "s.*")


def covered_strokes(strokes: DataFrame, cuts: DataFrame, by: list[str]) -> DataFrame:
    """Strokes that the union of a sheet's cuts covers from end to end.

    A stroke's parts inside each cut are sorted by their beginnings and followed as far as
    they reach without a gap.
    """
    ends = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    box = [F.least("ax", "bx"), F.least("ay", "by"), F.greatest("ax", "bx"), F.greatest("ay", "by")]
    near = strokes.select("*", *[x.alias(f"__{c}") for x, c in zip(box, BOX)])
    touch = (F.col("__x0") <= F.col("r_x1")) & (F.col("__x1") >= F.col("r_x0")) & (F.col("__y0") <= F.col("r_y1")) & (F.col("__y1") >= F.col("r_y0"))
    for c in by:
        touch = touch & (F.col(c) == F.col(f"r_{c}"))
    met = near.join(spatial.aside(cuts.select(*by, *BOX)), touch).withColumn("__p", inside_span(*ends, [F.col(f"r_{c}") for c in BOX])).where("__p is not null")
    parts = met.groupBy(*by, "path_id", "seg").agg(F.array_sort(F.collect_list("__p")).alias("p"))
    reach = F.aggregate("p", F.lit(0.0), lambda far, p: F.when(p.a <= far + REACH, F.greatest(far, p.b)).otherwise(far))
    return parts.where(reach >= 1.0 - REACH).select(*by, "path_id", "seg")


def cut_paths(paths: DataFrame, cuts: DataFrame, by: list[str]) -> DataFrame:
    """Paths of which some stroke is not wholly under the cuts: line art that passes a cut stays whole."""
    strokes = strokes_of(paths, by)
    covered = covered_strokes(strokes, cuts, by).groupBy(*by, "path_id").agg(F.count("seg").alias("__n"))
    size = F.aggregate("items", F.lit(0), lambda n, i: n + F.when(i.kind == "re", 4).otherwise(1))
    gone = paths.select(*by, "path_id", size.alias("__size")).join(covered, [*by, "path_id"]).where("__n = __size")
    return paths.join(gone.select(*by, "path_id"), [*by, "path_id"], "left_anti").select(*paths.columns)


def apply(paths: DataFrame, words: DataFrame, spans: DataFrame, decided: DataFrame, by: list[str]) -> dict[str, DataFrame]:
    """The tables of sheets after their cuts (``decide``): text under a cut goes, line art only if wholly covered.

    All cuts of a sheet act at once, as a union.  Sheets without a cut stay as they are.
    """
    cuts = applied_boxes(decided, by)
    return {"paths": cut_paths(paths, cuts, by), "words": cut_words(words, cuts, by), "spans": cut_spans(spans, cuts, by)}
