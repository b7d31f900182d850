"""Names of lines placed around them, where nothing else is.

Each name takes the first free place of seven distances and eight directions around the
middle of its line, longest lines first; where none is free, the least bad one.  What
stands on a sheet (texts, lines, leaders, names placed before) lies in a grid of cells
once it is more than a few, so a place is tried against its neighbours only, and a sheet
takes memory in proportion to what it holds.  A choice depends on those before it, so a sheet is one run; sheets
stream through sorted partitions.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import sequence

#: Distances as multiples of the letters' height, points around a name, the least height of a text in the way, and what is bad about a place.
RADII, CLEARANCE, LEAST_TEXT, LEAST_STROKE = (1.2, 2.0, 3.0, 4.5, 6.5, 9.0, 13.0), 1.6, 2.0, 0.5
ON_TEXT, OFF_SHEET, ON_LINE, REACH, REACH_MORE = 40.0, 400.0, 15.0, 0.35, 1.0
#: Of so many boxes or strokes all are looked at; more lie in cells.
FEW = 32

Box = tuple[float, float, float, float]


@lru_cache(4096)
def directions(angle: float) -> list[tuple[float, float]]:
    """Beside a line of this angle first, then along it, then between."""
    ux, uy = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    nx, ny = uy, -ux
    half = math.sqrt(0.5)
    corners = [((sx * nx + sy * ux) * half, (sx * ny + sy * uy) * half) for sx, sy in ((1, 1), (1, -1), (-1, 1), (-1, -1))]
    return [(nx, ny), (-nx, -ny), (ux, uy), (-ux, -uy), *corners]


def distance(x: float, y: float, ax: float, ay: float, bx: float, by: float) -> float:
    """From a point to a segment."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = 0.0 if size < 1e-9 else max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / size))
    return math.hypot(x - ax - t * dx, y - ay - t * dy)


def reach(box: Box) -> float:
    """How near a line may come to the middle of a name."""
    return max(box[2] - box[0], box[3] - box[1]) * REACH + REACH_MORE


class Sheet:
    """What stands on a sheet, by cells of a grid."""

    def __init__(self, edge: Box, cell: float):
        self.edge, self.cell = edge, cell
        self.boxes: list[Box] = []
        self.strokes: list[Box] = []
        self.spreads: list[Box] = []  # the boxes of strokes
        self.box_cells: dict[tuple[int, int], list[int]] = defaultdict(list)
        self.stroke_cells: dict[tuple[int, int], list[int]] = defaultdict(list)

    def _columns(self, low: float, high: float) -> range:
        return range(math.floor(low / self.cell), math.floor(high / self.cell) + 1)

    def add_box(self, box: Box) -> None:
        self.boxes.append(box)
        n = len(self.boxes)
        for k in range(0 if n == FEW + 1 else n - 1, n if n > FEW else 0):
            x0, y0, x1, y1 = self.boxes[k]
            for i in self._columns(x0, x1):
                for j in self._columns(y0, y1):
                    self.box_cells[i, j].append(k)

    def add_stroke(self, ax: float, ay: float, bx: float, by: float) -> None:
        if math.hypot(bx - ax, by - ay) <= LEAST_STROKE:
            return
        self.strokes.append((ax, ay, bx, by))
        self.spreads.append((min(ax, bx), min(ay, by), max(ax, bx), max(ay, by)))
        n = len(self.strokes)
        for k in range(0 if n == FEW + 1 else n - 1, n if n > FEW else 0):
            self._cross(k)

    def _cross(self, k: int) -> None:
        """In each column of cells, the cells between where the stroke enters and where it leaves."""
        ax, ay, bx, by = self.strokes[k]
        for i in self._columns(min(ax, bx), max(ax, bx)):
            ys = [ay, by]
            if ax != bx:
                ends = sorted((max(min(ax, bx), i * self.cell), min(max(ax, bx), (i + 1) * self.cell)))
                ys = [ay + (x - ax) / (bx - ax) * (by - ay) for x in ends]
            for j in self._columns(min(ys) - 1e-6, max(ys) + 1e-6):
                self.stroke_cells[i, j].append(k)

    def _near(self, cells: dict, box: Box) -> set[int]:
        return {k for i in self._columns(box[0], box[2]) for j in self._columns(box[1], box[3]) for k in cells.get((i, j), ())}

    def badness(self, box: Box) -> float:
        """0 of a free place; else what it costs."""
        x0, y0, x1, y1 = box[0] - CLEARANCE, box[1] - CLEARANCE, box[2] + CLEARANCE, box[3] + CLEARANCE
        bad = 0.0
        for a, b, c, d in self.boxes if len(self.boxes) <= FEW else [self.boxes[k] for k in self._near(self.box_cells, (x0, y0, x1, y1))]:
            if x1 > a and x0 < c and y1 > b and y0 < d:
                bad += ON_TEXT
        if box[0] < self.edge[0] or box[1] < self.edge[1] or box[2] > self.edge[2] or box[3] > self.edge[3]:
            bad += OFF_SHEET
        x, y, r = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2, reach(box)
        x0, y0, x1, y1 = x - r - 1e-6, y - r - 1e-6, x + r + 1e-6, y + r + 1e-6
        for k in range(len(self.strokes)) if len(self.strokes) <= FEW else self._near(self.stroke_cells, (x - r, y - r, x + r, y + r)):
            a, b, c, d = self.spreads[k]
            if x1 >= a and x0 <= c and y1 >= b and y0 <= d and distance(x, y, *self.strokes[k]) <= r:
                bad += ON_LINE
        return bad

    def place(self, x: float, y: float, angle: float, width: float, size: float) -> tuple[Box, float, bool]:
        """(box, distance step, forced) of a name around a point; its lower left corner is moved from it."""
        least: tuple[float, Box] | None = None
        for step in RADII:
            for dx, dy in directions(angle):
                left, low = x + dx * size * step, y + dy * size * step
                box = (left, low - size, left + width, low)
                bad = self.badness(box)
                if not bad:
                    self.add_box(box)
                    return box, step, False
                if least is None or bad < least[0]:
                    least = (bad, box)
        self.add_box(least[1])
        return least[1], RADII[-1], True


def place_names(lines: DataFrame, words: DataFrame, sheets: DataFrame, by: list[str], size: float, width: Column | None = None) -> DataFrame:
    """(by, idx, name, box, step, forced): a place for the name of every line.

    ``lines`` has idx, name, ends, angle, length_pt and leader_end (x, y, or null),
    ``words`` a box, ``sheets`` width_pt and height_pt.  ``width`` is that of a name;
    without it six tenths of ``size`` for each letter.  Lines of a sheet that ``sheets``
    lacks have no edge to keep.
    """
    wide = F.length("name") * (0.6 * size) if width is None else width
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    lead = F.when(F.col("leader_end").isNotNull(), F.col("leader_end.x")), F.when(F.col("leader_end").isNotNull(), F.col("leader_end.y"))
    cells = [*by, "kind", "rank", "idx", "name", "x0", "y0", "x1", "y1", "angle", "wide", "lx", "ly"]
    rows = sheets.select(*by, F.lit(0), F.lit(0.0), F.lit(0).cast("long"), text, F.lit(0.0), F.lit(0.0), "width_pt", "height_pt", none, none, none, none).toDF(*cells)
    high = words.where(F.col("y1") - F.col("y0") >= LEAST_TEXT)
    rows = rows.unionAll(high.select(*by, F.lit(1), F.lit(0.0), F.lit(0).cast("long"), text, "x0", "y0", "x1", "y1", none, none, none, none).toDF(*cells))
    own = lines.select(*by, F.lit(2), -F.col("length_pt"), F.col("idx").cast("long"), "name", "ax", "ay", "bx", "by", "angle", wide.cast("double"), *lead).toDF(*cells)

    def one(held: list) -> list[tuple]:
        edge = next(((r.x0, r.y0, r.x1, r.y1) for r in held if r.kind == 0), (-math.inf, -math.inf, math.inf, math.inf))
        sheet, named = Sheet(edge, 4 * size), [r for r in held if r.kind == 2]
        for r in held:
            if r.kind == 1:
                sheet.add_box((min(r.x0, r.x1), min(r.y0, r.y1), max(r.x0, r.x1), max(r.y0, r.y1)))
        for r in named:
            sheet.add_stroke(r.x0, r.y0, r.x1, r.y1)
            if r.lx is not None:
                sheet.add_stroke((r.x0 + r.x1) / 2, (r.y0 + r.y1) / 2, r.lx, r.ly)
        made = [(r, sheet.place((r.x0 + r.x1) / 2, (r.y0 + r.y1) / 2, r.angle, r.wide, size)) for r in named]
        return [(r.idx, r.name, *box, step, forced) for r, (box, step, forced) in sorted(made, key=lambda x: x[0].idx)]

    return sequence.each_group(rows.unionAll(own), by, ["kind", "rank", "idx"], one, "idx long, name string, x0 double, y0 double, x1 double, y1 double, step double, forced boolean")
