"""Geometry of marks that a renderer would draw: arrows, badges, chips, names of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares of a badge's size and of a chip's.
BADGE = {"by_mark": 1.15, "by_frame": 0.52, "square": 1.05, "letter": 0.66, "over_x": 0.28, "over_y": 0.34}
CHIP = {"pad": 0.3, "width": 0.7, "height": 1.45, "gap": 2.0}


def inset(ax: Column, ay: Column, bx: Column, by: Column, trim: float) -> Column:
    """The segment without ``trim`` at each end; null where nothing is left."""
    length = F.hypot(bx - ax, by - ay)
    ux, uy = F.try_divide(bx - ax, length) * trim, F.try_divide(by - ay, length) * trim
    return F.when(length > 2 * trim, F.struct((ax + ux).alias("ax"), (ay + uy).alias("ay"), (bx - ux).alias("bx"), (by - uy).alias("by")))


def away(mx: Column, my: Column, ex: Column, ey: Column) -> list[Column]:
    """The mirror image of an end in the middle."""
    return [2 * mx - ex, 2 * my - ey]


def normal(ax: Column, ay: Column, bx: Column, by: Column) -> list[Column]:
    """Unit normal of a segment; (1, 0) of a point."""
    length = F.hypot(bx - ax, by - ay)
    return [F.when(length < 1e-6, 1.0).otherwise(F.try_divide(ay - by, length)), F.when(length < 1e-6, 0.0).otherwise(F.try_divide(bx - ax, length))]


def badge(frame: list[Column], text: Column, mark_size: float) -> list[Column]:
    """Box of a mark's badge over the upper right corner of a frame."""
    height = F.greatest(F.lit(mark_size * BADGE["by_mark"]), (frame[3] - frame[1]) * BADGE["by_frame"])
    width = F.greatest(height * BADGE["square"], F.length(text) * height * BADGE["letter"])
    x, y = frame[2] - width * BADGE["over_x"], frame[1] - height * BADGE["over_y"]
    return [x, y, x + width, y + height]


def fits(box: list[Column], width: Column, height: Column) -> Column:
    return (box[0] >= 0) & (box[1] >= 0) & (box[2] <= width) & (box[3] <= height)


def chip(anchor: list[Column], size: float, width: Column, height: Column) -> Column:
    """Place of a numbered chip: right, left, above or below, the first that fits, else clipped on the right."""
    w, h, gap = size * CHIP["width"] + 2 * size * CHIP["pad"], size * CHIP["height"], CHIP["gap"]
    x0, y0, x1, y1 = anchor
    tries = [[x1 + gap, y0], [x0 - gap - w, y0], [x0, y0 - gap - h], [x0, y1 + gap]]
    boxes = [[x, y, x + w, y + h] for x, y in tries]
    name = lambda b: F.struct(*[v.alias(c) for v, c in zip(b, ("x0", "y0", "x1", "y1"))])
    zero = F.lit(0.0)
    clipped = [F.greatest(boxes[0][0], zero), F.greatest(boxes[0][1], zero), F.least(boxes[0][2], width), F.least(boxes[0][3], height)]
    return F.coalesce(*[F.when(fits(b, width, height), name(b)) for b in boxes], name(clipped))


def png_size(data: Column) -> Column:
    """Width and height in the header of a PNG; null of anything else."""
    number = lambda at: F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("int")
    is_png = F.hex(F.substring(data, 1, 8)) == "89504E470D0A1A0A"
    return F.when(is_png & (F.octet_length(data) >= 24), F.struct(number(17).alias("width"), number(21).alias("height")))


def picture_facts(pictures: DataFrame) -> DataFrame:
    """Pictures (data, overlay, crop, full_width, full_height) with what follows from them.

    ``crop`` is null where nothing was trimmed; the model sees the overlay if there is one.
    """
    seen = F.coalesce("overlay", "data")
    size = png_size(F.col("data"))
    c = F.col("crop")
    area = F.try_divide(((c[2] - c[0]) * (c[3] - c[1])).cast("double"), F.col("full_width") * F.col("full_height"))
    return pictures.select(
        "*", size.width.alias("width"), size.height.alias("height"), F.octet_length("data").alias("size_bytes"), F.coalesce(area, F.lit(1.0)).alias("area_ratio"),
        seen.alias("model_image"), F.concat(F.lit("data:image/png;base64,"), F.base64(seen)).alias("data_url"),
    )


def run_folder(experiment: Column, at: Column) -> Column:
    """Folder of a run: its experiment and the start in UTC (the session's time zone)."""
    return F.concat(experiment, F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"))


def image_name(prefix: Column, page: Column) -> Column:
    """Two digits of the page at least, all of a longer number."""
    digits = page.cast("string")
    return F.concat(prefix, F.lit("_"), F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits), F.lit(".png"))


def model_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def switched_on(own: Column, default: bool) -> Column:
    """A feature switch: the request's, else the configured one."""
    return F.coalesce(own, F.lit(default))
