"""Marks and annotations drawn on pictures of sheets.

What is drawn is a table of shapes, made of columns: (sheet, z, contours, text, x, y,
size, color, alpha).  A shape is filled contours, flat lists of x and y, or a text.
``render`` brings the shapes of a sheet to its picture, decodes it, fills them in the
order of z and encodes the result, batches of sheets at a time.
"""

from __future__ import annotations

import marshal
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import layout, png, raster
from plumbline.operators import sequence

#: Colours, and sizes as shares of a picture's smaller side with the least of each.
SPAN, POINTER, FRAME, WHITE = (0.85, 0.1, 0.55), (0.05, 0.5, 0.9), (0.0, 0.6, 0.25), (1.0, 1.0, 1.0)
STROKE, MARK, ARROW, PAD, DARKER = (0.0030, 1.4), (0.0080, 7.5), (0.012, 3.5), (0.0022, 2.0), 0.48
#: An arrow's half width, an end's frame, and the colours and words of an annotated sheet.
HALF, EDGE = 0.42, 1.15
NAMED = {"orange": (0.90, 0.52, 0.05), "red": (0.82, 0.12, 0.12), "green": (0.00, 0.58, 0.20), "blue": (0.05, 0.42, 0.85), "violet": (0.42, 0.28, 0.68), "grey": (0.65, 0.65, 0.68), "black": (0.15, 0.15, 0.15)}
LEGEND = (("parent", "blue", "обобщённая длина (родитель)"), ("child", "green", "дочерний участок"), ("excluded", "grey", "исключено из расчёта моделью (вложенные)"), ("model", "orange", "рамка по bbox модели"))
LEGEND_BACK, LEGEND_EDGE, TEXT_LEAST, TEXT_MOST, TEXT_SHARE = (1.0, 1.0, 1.0), (0.35, 0.35, 0.35), 13.0, 32.0, 170.0

SHAPE = "z bigint, contours array<array<double>>, text string, x double, y double, size double, color array<double>, alpha double"


def _color(c: tuple[float, float, float]) -> Column:
    return F.array(*map(F.lit, c))


def _sized(share: tuple[float, float], unit: Column) -> Column:
    return F.greatest(F.lit(share[1]), unit * share[0])


def box_contour(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box as a contour, its corners in any order."""
    a, b, c, d = F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1)
    return F.array(a, b, c, b, c, d, a, d)


def outline(box: list[Column], width: Column) -> Column:
    """A box's frame, half of its width on each side; a box without a hole is filled."""
    x0, y0, x1, y1 = F.least(box[0], box[2]), F.least(box[1], box[3]), F.greatest(box[0], box[2]), F.greatest(box[1], box[3])
    h = width / 2
    outer, inner = box_contour(x0 - h, y0 - h, x1 + h, y1 + h), box_contour(x0 + h, y0 + h, x1 - h, y1 - h)
    return F.when((x1 - x0 > width) & (y1 - y0 > width), F.array(outer, inner)).otherwise(F.array(outer))


def thick(ax: Column, ay: Column, bx: Column, by: Column, width: Column) -> Column:
    """A segment of a width as a contour."""
    nx, ny = layout.normal(ax, ay, bx, by)
    h = width / 2
    return F.array(ax + nx * h, ay + ny * h, bx + nx * h, by + ny * h, bx - nx * h, by - ny * h, ax - nx * h, ay - ny * h)


def arrow(tip: list[Column], outward: list[Column], size: Column) -> Column:
    """An arrowhead whose tip looks away from a point, as a contour."""
    length = F.greatest(F.hypot(outward[0] - tip[0], outward[1] - tip[1]), F.lit(1e-6))
    ux, uy = (outward[0] - tip[0]) / length, (outward[1] - tip[1]) / length
    bx, by = tip[0] - ux * size, tip[1] - uy * size
    return F.array(tip[0], tip[1], bx - uy * size * HALF, by + ux * size * HALF, bx + uy * size * HALF, by - ux * size * HALF)


def _fill(contours: Column, color: Column, alpha: Column | float = 1.0) -> Column:
    none = F.lit(None).cast("double")
    return F.struct(contours.alias("contours"), F.lit(None).cast("string").alias("text"), none.alias("x"), none.alias("y"), none.alias("size"), color.alias("color"), (alpha if isinstance(alpha, Column) else F.lit(alpha)).alias("alpha"))


def _words(text: Column, x: Column, y: Column, size: Column, color: Column) -> Column:
    return F.struct(F.lit(None).cast("array<array<double>>").alias("contours"), text.alias("text"), x.cast("double").alias("x"), y.cast("double").alias("y"), size.cast("double").alias("size"), color.alias("color"), F.lit(1.0).alias("alpha"))


def _text_width(text: Column, size: Column) -> Column:
    """``raster.text_width`` of a column."""
    return F.when(F.length(text) > 0, size * (F.length(text) * raster.STEP - (raster.STEP - raster.WIDE))).otherwise(0.0)


def _centred(text: Column, box: list[Column], size: Column, color: Column) -> Column:
    """A text in the middle of a box."""
    return _words(text, (box[0] + box[2] - _text_width(text, size)) / 2, (box[1] + box[3] - size) / 2, size, color)


def _steps(rows: DataFrame, *steps: dict[str, Column]) -> DataFrame:
    """Rows with named values, each step made of those before it, so that none is written out again where it is used."""
    for step in steps:
        rows = rows.withColumns(step)
    return rows


def _shapes(rows: DataFrame, by: list[str], order: Column, made: list[Column]) -> DataFrame:
    """Shapes of rows, in the order of the rows; null ones are left out.

    Shapes are columns of their own before they are listed: expressions inside a generator
    are not compiled and share no parts.
    """
    names = [f"__s{i}" for i in range(len(made))]
    rows = rows.select(*by, order.alias("__o"), *(m.alias(n) for m, n in zip(made, names)))
    listed = F.filter(F.array(*names), lambda s: s.isNotNull())
    return rows.select(*by, "__o", F.posexplode(listed).alias("__i", "__s")).select(*by, (F.col("__o") * 100 + F.col("__i")).cast("long").alias("z"), "__s.*")


def mark_shapes(marks: DataFrame, by: list[str], full: bool = True) -> DataFrame:
    """Shapes of marks (number n, mark_id, kind, box, line ends ax, ay, bx, by, and the picture's width and height).

    A mark is a frame around its label with a badge.  In full its line is drawn too, less
    the arrows at its ends, and frames around the ends that the drawing has.
    """
    c = lambda *names: [F.col(f"__{n}") for n in names]
    (unit,), (x0, y0, x1, y1), (stroke, size, head, pad, thin) = c("unit"), c("x0", "y0", "x1", "y1"), c("stroke", "size", "head", "pad", "thin")
    frame, badge = c("f0", "f1", "f2", "f3"), c("b0", "b1", "b2", "b3")
    rows = _steps(
        marks,
        {"__unit": F.least("width", "height").cast("double"), **{f"__{n}": F.col(n).cast("double") for n in ("x0", "y0", "x1", "y1")}},
        {"__stroke": _sized(STROKE, unit), "__size": _sized(MARK, unit), "__head": _sized(ARROW, unit), "__pad": _sized(PAD, unit)},
        {"__thin": F.greatest(F.lit(1.0), stroke * 0.6), "__f0": x0 - pad, "__f1": y0 - pad, "__f2": x1 + pad, "__f3": y1 + pad},
        {f"__b{i}": b for i, b in enumerate(layout.badge(frame, F.col("mark_id"), size))},
    )
    made = [_fill(outline(frame, thin), _color(FRAME)), _fill(F.array(box_contour(*badge)), _color(FRAME)), _centred(F.col("mark_id"), badge, (badge[3] - badge[1]) * 0.5, _color(WHITE))]
    if full:
        point, span = F.col("__point"), F.col("kind") == "span"
        ends, (mx, my, nx, ny, side) = c("ax", "ay", "bx", "by"), c("mx", "my", "nx", "ny", "side")
        ax, ay, bx, by_ = ends
        normal = layout.normal(ax, ay, bx, by_)
        # Ends less the arrows, the mirrored ends, and the corners of the frames around both ends.
        inner, (ox, oy, px, py), (dark, color) = c("sx", "sy", "ex", "ey"), c("ox", "oy", "px", "py"), c("dark", "color")
        corners = [c(*(f"{e}{k}" for k in range(4))) for e in "qr"]
        out_a, out_b = layout.away(mx, my, ax, ay), layout.away(mx, my, bx, by_)
        rows = _steps(
            rows,
            {"__point": F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) < 1.0},
            {"__ax": F.when(point, x0).otherwise(F.col("ax")), "__ay": F.when(point, (y0 + y1) / 2).otherwise(F.col("ay")), "__bx": F.when(point, x1).otherwise(F.col("bx")), "__by": F.when(point, (y0 + y1) / 2).otherwise(F.col("by"))},
            {"__cut": layout.inset(*ends, head), "__mx": (ax + bx) / 2, "__my": (ay + by_) / 2, "__nx": normal[0], "__ny": normal[1], "__side": head * EDGE, "__color": F.when(span, _color(SPAN)).otherwise(_color(POINTER))},
            {"__dark": F.transform(color, lambda v: v * DARKER), "__ox": out_a[0], "__oy": out_a[1], "__px": out_b[0], "__py": out_b[1], **{f"__{n}": F.coalesce(F.col("__cut")[e], v) for n, e, v in zip(("sx", "sy", "ex", "ey"), ("ax", "ay", "bx", "by"), ends)}, **{f"__{e}{k}": v for e, x, y in (("q", ax, ay), ("r", bx, by_)) for k, v in enumerate((x + nx * side, y + ny * side, x - nx * side, y - ny * side))}},
        )
        made += [
            _fill(F.array(thick(*inner, stroke)), color),
            _fill(F.array(arrow(inner[:2], [ox, oy], head)), dark), F.when(span, _fill(F.array(arrow(inner[2:], [px, py], head)), dark)),
            *(_fill(outline(box, thin), dark) for box in corners),
        ]
    return _shapes(rows, by, F.col("n"), made)


def region_shapes(regions: DataFrame, by: list[str]) -> DataFrame:
    """Shapes of annotated regions (number n, label, color, box, and the picture's width and height): a frame and a chip beside it."""
    c = lambda *names: [F.col(f"__{n}") for n in names]
    (width, height), (size, color, at), box, chip = c("w", "h"), c("size", "color", "at"), c("x0", "y0", "x1", "y1"), c("c0", "c1", "c2", "c3")
    named = F.create_map(*(x for k, v in NAMED.items() for x in (F.lit(k), _color(v))))
    rows = _steps(
        regions,
        {"__w": F.col("width").cast("double"), "__h": F.col("height").cast("double")},
        {"__size": text_size(width), "__x0": F.greatest(F.col("x0").cast("double"), F.lit(0.0)), "__y0": F.greatest(F.col("y0").cast("double"), F.lit(0.0)), "__x1": F.least(F.col("x1").cast("double"), width), "__y1": F.least(F.col("y1").cast("double"), height)},
        {"__color": F.coalesce(F.element_at(named, F.col("color")), _color(NAMED["black"])), "__at": layout.chip(box, size, width, height)},
        {f"__c{i}": at[k] for i, k in enumerate(("x0", "y0", "x1", "y1"))},
    )
    caption = F.coalesce(F.col("label"), F.col("n").cast("string"))
    seen, shown = (box[0] < box[2]) & (box[1] < box[3]), (chip[0] < chip[2]) & (chip[1] < chip[3])
    made = [F.when(seen, _fill(outline(box, F.greatest(F.lit(1.5), size * 0.16)), color)), F.when(seen & shown, _fill(F.array(box_contour(*chip)), color)), F.when(seen & shown, _centred(caption, chip, size * 0.6, _color(WHITE)))]
    return _shapes(rows, by, F.col("n"), made)


def text_size(width: Column) -> Column:
    """Height of an annotation's letters, by the picture's width."""
    return F.greatest(F.lit(TEXT_LEAST), F.least(F.lit(TEXT_MOST), width / TEXT_SHARE))


def legend_shapes(counted: DataFrame, by: list[str]) -> DataFrame:
    """Shapes of a legend in the lower right corner of sheets (title, parent, child, excluded, model, width, height).

    The title comes first, then a swatch and a line for each kind that the sheet has.
    Where the corner is too small the legend starts at the upper left one.
    """
    width, height = F.col("width").cast("double"), F.col("height").cast("double")
    size = text_size(width) * 1.45
    pad, row, letter = size * 0.45, size * 1.55, size * 0.6
    lines = F.filter(
        F.array(
            F.when(F.length("title") > 0, F.struct(_color(LEGEND_EDGE).alias("color"), F.col("title").alias("text"))),
            *(F.when(F.col(k) > 0, F.struct(_color(NAMED[c]).alias("color"), F.concat(F.col(k).cast("string"), F.lit(f" — {t}")).alias("text"))) for k, c, t in LEGEND),
        ),
        lambda x: x.isNotNull(),
    )
    rows = counted.withColumn("__l", lines).where(F.size("__l") > 0)
    widest = F.array_max(F.transform("__l", lambda x: _text_width(x.text, letter)))
    w, h = widest + 2 * pad + size * 2.0, row * F.size("__l") + 2 * pad
    fits = (width - pad - w >= 0) & (height - pad - h >= 0)
    rows = rows.withColumn("__x", F.when(fits, width - pad - w).otherwise(0.0)).withColumn("__y", F.when(fits, height - pad - h).otherwise(0.0))
    x, y = F.col("__x"), F.col("__y")
    box = [x, y, F.least(x + w, width), F.least(y + h, height)]
    back = _shapes(rows, by, F.lit(0), [_fill(F.array(box_contour(*box)), _color(LEGEND_BACK)), _fill(outline(box, F.lit(0.9)), _color(LEGEND_EDGE))])
    each = rows.select("*", F.posexplode("__l").alias("__i", "__e"))
    top = y + pad + F.col("__i") * row
    swatch = [x + pad, top + size * 0.2, x + pad + size * 1.2, top + size * 0.95]
    told = _shapes(each, by, F.col("__i") + 1, [_fill(F.array(box_contour(*swatch)), F.col("__e.color")), _words(F.col("__e.text"), swatch[2] + size * 0.5, top + size * 0.3, letter, _color((0.0, 0.0, 0.0)))])
    return back.unionByName(told)


def stacked(*layers: DataFrame) -> DataFrame:
    """Shapes of several layers, later ones on top."""
    out = None
    for i, layer in enumerate(layers):
        layer = layer.withColumn("z", F.col("z") + (i << 40))
        out = layer if out is None else out.unionByName(layer)
    return out


def render(pictures: DataFrame, shapes: DataFrame, by: list[str], data: str = "data") -> DataFrame:
    """(sheet, data, error): pictures as RGB PNGs with their shapes; without shapes a picture stays as it is.

    A picture that can't be decoded gives an error and no data.  A task holds one
    decoded picture at a time, and hands encoded ones on by the megabyte.  Pictures are dealt to as many tasks as a shuffle has, however few
    bytes they are: drawing costs by pixels.
    """
    tasks = int(pictures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = {f.name: f.dataType.simpleString() for f in pictures.schema.fields}
    listed = shapes.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("z", "contours", "text", "x", "y", "size", "color", "alpha"))).alias("__shapes"))
    rows = pictures.select(*by, F.col(data).alias("__data")).repartition(tasks, *by).join(listed, by, "left")

    def drawn(raw: bytes, listed: list[dict]) -> bytes:
        if last.get("raw") != raw:  # sheets of one blank picture follow each other
            last.update(raw=raw, canvas=raster.canvas_of(png.decode(raw)))
        canvas = last["canvas"].copy()
        for s in listed:
            contours = s["contours"] if s["text"] is None else raster.text_contours(s["text"], s["x"], s["y"], s["size"])
            raster.paint(canvas, contours, s["color"], s["alpha"])
        return png.encode(canvas)

    last: dict = {}
    known = png.Known()  # equal pictures with equal shapes are drawn once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, first, held, size = batch.select(range(len(by))), 0, [], 0

            def done(end: int) -> pa.RecordBatch:
                made, errors = zip(*held)
                return pa.RecordBatch.from_arrays([*keys.slice(first, end - first).columns, pa.array(made, pa.binary()), pa.array(errors, pa.string())], [*by, data, "error"])

            for i, (raw, listed) in enumerate(zip(batch.column(len(by)), batch.column(len(by) + 1))):
                raw, listed = raw.as_py(), listed.as_py()
                made, error = raw, None
                if raw is not None and listed:
                    try:
                        key = (raw, marshal.dumps(listed, 2))
                        made = known.get(key)
                        if made is None:
                            made = known[key] = drawn(raw, listed)
                    except png.PngError as e:
                        made, error = None, str(e)
                held.append((made, error))
                size += len(made or b"")
                if size > png.HELD:
                    yield done(i + 1)
                    first, held, size = i + 1, [], 0
            if held:
                yield done(batch.num_rows)

    return rows.mapInArrow(run, ", ".join([*(f"{c} {fields[c]}" for c in by), f"{data} binary, error string"]))


def overlay(pictures: DataFrame, marks: DataFrame, by: list[str], full: bool = True) -> DataFrame:
    """Pictures (data) with their marks; see ``mark_shapes`` for what a mark needs besides the picture's size."""
    sizes = pictures.select(*by, layout.png_size(F.col("data")).alias("__s")).select(*by, "__s.width", "__s.height")
    return render(pictures, mark_shapes(marks.join(sizes, by), by, full), by)


def annotate(pictures: DataFrame, regions: DataFrame, titles: DataFrame, by: list[str]) -> DataFrame:
    """Pictures with regions (pos, label, kind, origin, color, box) numbered by pos, and a legend under the title of ``titles``."""
    sizes = pictures.select(*by, layout.png_size(F.col("data")).alias("__s")).select(*by, "__s.width", "__s.height")
    numbered = sequence.numbered(regions, by, [F.col("pos")], "n").join(sizes, by)
    model = F.col("origin") == "model"
    counted = regions.groupBy(*by).agg(F.count_if(model).alias("model"), *(F.count_if(~model & (F.col("kind") == k)).alias(k) for k in ("parent", "child", "excluded")))
    zero = [F.coalesce(k, F.lit(0)).alias(k) for k in ("parent", "child", "excluded", "model")]
    legends = sizes.join(titles.select(*by, "title"), by, "left").join(counted, by, "left").select(*by, "width", "height", F.coalesce("title", F.lit("")).alias("title"), *zero)
    return render(pictures, stacked(region_shapes(numbered, by), legend_shapes(legends, by)), by)
