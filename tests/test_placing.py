"""Names placed by the grid against a quadratic placement that looks at everything."""

import math
import random

import pyarrow as pa
import pytest

from plumbline.operators import placing, sequence
from plumbline.sources import schemas

LINES = "doc_id string, page_number int, idx int, name string, ax double, ay double, bx double, by double, angle double, length_pt double, leader_end struct<x:double,y:double>"


def sheet(rng, page, crowd):
    words = [("d", page, 0, 0, i, "w", x := rng.uniform(0, 180), y := rng.uniform(0, 120), x + rng.uniform(2, 40), y + rng.choice([1.0, 5.0, 9.0])) for i in range(crowd)]
    lines = []
    for i in range(rng.randint(1, 14)):
        ax, ay = rng.uniform(0, 180), rng.uniform(0, 120)
        a, size = rng.choice([0.0, 30.0, 90.0, rng.uniform(-180, 180)]), rng.choice([0.2, 15.0, 60.0])
        lead = None if rng.random() < 0.6 else (rng.uniform(0, 180), rng.uniform(0, 120))
        lines.append(("d", page, i, f"P{i}", ax, ay, ax + size * math.cos(math.radians(a)), ay + size * math.sin(math.radians(a)), a, size + i / 100, lead))
    return words, lines


def plain(words, lines, width, height, size):
    boxes = [w[6:10] for w in words if w[9] - w[7] >= 2.0]
    strokes = []
    for r in lines:
        for s in [r[4:8]] + ([((r[4] + r[6]) / 2, (r[5] + r[7]) / 2, *r[10])] if r[10] else []):
            if math.hypot(s[2] - s[0], s[3] - s[1]) > 0.5:
                strokes.append(s)

    def gap(x, y, ax, ay, bx, by):
        dx, dy = bx - ax, by - ay
        t = ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)
        t = min(1.0, max(0.0, t))
        return math.hypot(x - ax - t * dx, y - ay - t * dy)

    out = {}
    for r in sorted(lines, key=lambda r: (-r[9], r[2])):
        wide, mx, my = len(r[3]) * 0.6 * size, (r[4] + r[6]) / 2, (r[5] + r[7]) / 2
        tried = []
        for k, step in enumerate((1.2, 2.0, 3.0, 4.5, 6.5, 9.0, 13.0)):
            for j, (dx, dy) in enumerate(placing.directions(r[8])):
                x, y = mx + dx * size * step, my + dy * size * step
                box = (x, y - size, x + wide, y)
                cost = sum(40.0 for b in boxes if box[2] + 1.6 > b[0] and box[0] - 1.6 < b[2] and box[3] + 1.6 > b[1] and box[1] - 1.6 < b[3])
                cost += 400.0 * (box[0] < 0 or box[1] < 0 or box[2] > width or box[3] > height)
                near = max(box[2] - box[0], box[3] - box[1]) * 0.35 + 1.0
                cost += sum(15.0 for s in strokes if gap((box[0] + box[2]) / 2, (box[1] + box[3]) / 2, *s) <= near)
                tried.append((cost, k, j, box, step))
        free = [t for t in tried if t[0] == 0]
        best = free[0] if free else min(tried, key=lambda t: t[:3])
        boxes.append(best[3])
        out[r[2]] = (r[3], best[3], best[4] if free else 13.0, not free)
    return out


@pytest.mark.parametrize(("seed", "crowd"), [(1, 5), (2, 60), (3, 250)])
def test_place_names(spark, seed, crowd):
    rng, size, forced = random.Random(seed), 6.0, 0
    made = {page: sheet(rng, page, crowd) for page in range(8)}
    words = spark.createDataFrame([w for ws, _ in made.values() for w in ws], schemas.WORDS)
    lines = spark.createDataFrame([x for _, xs in made.values() for x in xs], LINES)
    sheets = spark.createDataFrame([("d", page, 200.0, 140.0) for page in [*made, 99]], schemas.SHEETS)
    got = {}
    for r in placing.place_names(lines, words, sheets, ["doc_id", "page_number"], size).collect():
        got.setdefault(r.page_number, {})[r.idx] = (r.name, (r.x0, r.y0, r.x1, r.y1), r.step, r.forced)
    for page, (ws, xs) in made.items():
        want = plain(ws, xs, 200.0, 140.0, size)
        assert got[page].keys() == want.keys()
        for k, (name, box, step, off) in want.items():
            assert got[page][k][0] == name and got[page][k][2:] == (step, off) and got[page][k][1] == pytest.approx(box)
            forced += off
    assert (forced > 5) == (crowd == 250) and set(got) == set(made)


def test_crowded_sheet_stays_local():
    """Each place looks at its neighbours only: cells hold what lies in them."""
    s = placing.Sheet((0.0, 0.0, 1e4, 1e4), 24.0)
    for i in range(100):
        for j in range(100):
            s.add_box((i * 100.0, j * 100.0, i * 100.0 + 20, j * 100.0 + 5))
    s.add_stroke(0.0, 0.0, 1e4, 1e4)
    assert sum(map(len, s.box_cells.values())) < 4 * 10_000 and sum(map(len, s.stroke_cells.values())) <= 3 * 1e4 / 24 + 3
    assert len(s._near(s.box_cells, (500.0, 500.0, 530.0, 510.0))) <= 4


def test_few_are_looked_at_without_cells(monkeypatch):
    """A small sheet makes no cells, a larger one has all in them, and both place names alike."""

    def places(few, crowd):
        monkeypatch.setattr(placing, "FEW", few)
        words, lines = sheet(random.Random(crowd), 1, crowd)
        s = placing.Sheet((0.0, 0.0, 200.0, 140.0), 24.0)
        for w in words:
            s.add_box(w[6:10])
        for r in lines:
            s.add_stroke(*r[4:8])
        return s, [s.place((r[4] + r[6]) / 2, (r[5] + r[7]) / 2, r[8], 7.2, 6.0) for r in lines]

    for crowd in (1, 9, 20, 40, 120):
        assert places(32, crowd)[1] == places(0, crowd)[1] == places(10, crowd)[1]
    s = places(32, 9)[0]
    assert not s.box_cells and not s.stroke_cells
    s = places(32, 40)[0]
    assert {k for c in s.box_cells.values() for k in c} == set(range(len(s.boxes)))


def test_values_of_columns():
    """As to_pylist, nulls and NaN apart."""
    for values, kind in (([1, None, 3], pa.int64()), ([1.5, None, math.inf], pa.float64()), ([None, None], pa.float64()), ([2, 1], pa.int32()), (["a", None], pa.string()), ([True, None], pa.bool_()), ([], pa.float64())):
        got = sequence.values_of(pa.array(values, kind))
        assert got == values and [type(v) for v in got] == [type(v) for v in values]
    got = sequence.values_of(pa.array([None, math.nan], pa.float64()))
    assert got[0] is None and math.isnan(got[1])
