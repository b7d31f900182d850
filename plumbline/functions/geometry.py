"""Plane geometry as Column expressions.  Points are pairs of Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points per unit of length.
UNITS = {"pt": 1.0, "in": 72.0, "mm": 72.0 / 25.4}
AXIS_STEP = 30.0


def dist(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(bx - ax, by - ay)


def fraction(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where the point projects on the segment, 0 to 1; 0 on a degenerate one."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    along = F.try_divide((px - ax) * dx + (py - ay) * dy, square)
    return F.when(square < 1e-9, 0.0).otherwise(F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0)))


def dist_point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = fraction(px, py, ax, ay, bx, by)
    return F.hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def dist_point_box(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """0 inside the box."""
    zero = F.lit(0.0)
    return F.hypot(F.greatest(x0 - px, zero, px - x1), F.greatest(y0 - py, zero, py - y1))


def angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees, -180 to 180."""
    return F.degrees(F.atan2(by - ay, bx - ax))


def is_rotated(degrees: Column) -> Column:
    return F.abs(F.sin(F.radians(degrees))) > 0.5


def axis_of(degrees: Column) -> Column:
    """Nearest of six axes of the isometric grid; half-way cases go to the even one."""
    return F.rint(F.pmod(degrees, F.lit(180.0)) / AXIS_STEP).cast("int") % 6


def boxes_overlap(a: list[Column], b: list[Column], tolerance: float = 0.0) -> Column:
    return ~((a[2] < b[0] - tolerance) | (a[0] > b[2] + tolerance) | (a[3] < b[1] - tolerance) | (a[1] > b[3] + tolerance))


def center_inside(box: list[Column], frame: list[Column]) -> Column:
    """The centre of the box lies in the half-open frame."""
    cx, cy = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    return (cx >= frame[0]) & (cx < frame[2]) & (cy >= frame[1]) & (cy < frame[3])


def wraps(frame: list[Column], box: list[Column], overshoot: Column, margin: Column) -> Column:
    """A frame is drawn around a label: its centre well inside, its box nearly."""
    cx, cy = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    centre = (frame[0] + margin < cx) & (cx < frame[2] - margin) & (frame[1] + margin < cy) & (cy < frame[3] - margin)
    return centre & (box[0] >= frame[0] - overshoot) & (box[1] >= frame[1] - overshoot) & (box[2] <= frame[2] + overshoot) & (box[3] <= frame[3] + overshoot)


def grow(box: list[Column], pad: float) -> list[Column]:
    return [box[0] - pad, box[1] - pad, box[2] + pad, box[3] + pad]


def grow_small(box: list[Column], pad: float) -> list[Column]:
    """Grown on all sides, and to four pads at least on the right and below."""
    more = [F.greatest(F.lit(0.0), 2 * pad - (box[i + 2] - box[i])) for i in (0, 1)]
    return [box[0] - pad, box[1] - pad, box[2] + pad + more[0], box[3] + pad + more[1]]


def affine_box(box: list[Column], zoom: Column, dx: Column, dy: Column) -> list[Column]:
    """Points to pixels of a cropped picture; corners ordered."""
    xs, ys = [zoom * box[i] - dx for i in (0, 2)], [zoom * box[i] - dy for i in (1, 3)]
    return [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)]


def to_unit(points: Column, unit: str, zoom: Column | None = None) -> Column:
    """Points in pt, px, in or mm, two decimals."""
    return F.bround(points * zoom if unit == "px" else points / UNITS[unit], 2)


def model_box(box: list[Column], width: Column, height: Column, space: str = "px") -> Column:
    """A box given in pixels or thousandths as clipped pixels; null under one pixel."""
    sx, sy = (F.lit(1.0), F.lit(1.0)) if space == "px" else (width / 1000.0, height / 1000.0)
    zero = F.lit(0.0)
    x = [F.least(F.greatest(f(box[0] * sx, box[2] * sx), zero), width) for f in (F.least, F.greatest)]
    y = [F.least(F.greatest(f(box[1] * sy, box[3] * sy), zero), height) for f in (F.least, F.greatest)]
    return F.when((x[1] - x[0] >= 1) & (y[1] - y[0] >= 1), F.struct(x[0].alias("x0"), y[0].alias("y0"), x[1].alias("x1"), y[1].alias("y1")))


def zoom_for(width: Column, height: Column, dpi: float, longest: float) -> Column:
    """Zoom of a page: the resolution, unless the longer side gets too long."""
    return F.least(F.lit(dpi / 72.0), F.lit(longest) / F.greatest(width, height))


def expand(box: list[Column], pad: float, width: Column, height: Column, least: float) -> list[Column]:
    """A content box padded and clamped; the whole page if it is too small."""
    zero = F.lit(0.0)
    b = [F.greatest(box[0] - pad, zero), F.greatest(box[1] - pad, zero), F.least(box[2] + pad, width), F.least(box[3] + pad, height)]
    small = (b[2] - b[0] < least) | (b[3] - b[1] < least)
    return [F.when(small, whole).otherwise(x) for x, whole in zip(b, (zero, zero, width, height))]


def shoelace(points: Column) -> Column:
    """Area of a closed polygon given as array<struct<x, y>>."""
    n = F.size(points)
    after = F.concat(F.slice(points, 2, F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1))
    twice = F.aggregate(F.zip_with(points, after, lambda p, q: p.x * q.y - q.x * p.y), F.lit(0.0), lambda a, x: a + x)
    return F.when(n < 3, 0.0).otherwise(F.abs(twice) / 2)
