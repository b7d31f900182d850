"""PNG, filled shapes, overlays and annotations against plain code, pixel by pixel."""

import math
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.functions import png, raster
from plumbline.operators import overlay, trim


def plain_unfilter(kinds, rest):
    """The format's own recursion, a byte at a time."""
    height, width, size = rest.shape
    out = np.zeros((height, width, size), int)
    for y in range(height):
        for x in range(width):
            for k in range(size):
                a = out[y, x - 1, k] if x else 0
                b = out[y - 1, x, k] if y else 0
                c = out[y - 1, x - 1, k] if x and y else 0
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out[y, x, k] = (int(rest[y, x, k]) + (0, a, b, (a + b) // 2, near)[kinds[y]]) % 256
    return out


@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 5, 3), (5, 9, 4), (13, 4, 2), (1, 30, 3), (30, 1, 1)])
def test_unfilter(shape):
    rng = np.random.default_rng(1)
    for kinds in [np.full(shape[0], k) for k in range(5)] + [rng.integers(0, 5, shape[0]) for _ in range(6)]:
        rest = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (png.unfilter(kinds.astype(np.uint8), rest) == plain_unfilter(kinds, rest)).all()


def test_round_trip():
    rng = np.random.default_rng(2)
    for channels in (1, 2, 3, 4):
        for size in ((1, 1), (40, 23), (3, 300)):
            pixels = (np.cumsum(rng.integers(0, 5, (*size, channels)), axis=1) % 256).astype(np.uint8)
            for kinds in (None, 0, 1, 2, 3, 4, rng.integers(0, 5, size[0])):
                assert (png.decode(png.encode(pixels, kinds)) == pixels).all()


def made(width, height, depth, kind, raw, interlace=0, extra=()):
    chunk = lambda n, c: struct.pack(">I", len(c)) + n + c + struct.pack(">I", zlib.crc32(n + c))
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, interlace)) + b"".join(chunk(*x) for x in extra) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_other_kinds():
    assert png.decode(made(10, 1, 1, 0, b"\x00\xa5\x40")).ravel().tolist() == [255, 0, 255, 0, 0, 255, 0, 255, 0, 255]
    assert png.decode(made(3, 1, 4, 0, b"\x00\x0f\x70")).ravel().tolist() == [0, 255, 119]
    assert png.decode(made(2, 1, 16, 0, b"\x00\x12\xff\x34\x00")).ravel().tolist() == [0x12, 0x34]
    palette = (b"PLTE", bytes([1, 2, 3, 4, 5, 6, 7, 8, 9]))
    assert png.decode(made(4, 1, 2, 3, b"\x00\x18", extra=[palette])).tolist() == [[[1, 2, 3], [4, 5, 6], [7, 8, 9], [1, 2, 3]]]
    assert png.decode(made(2, 1, 8, 3, b"\x00\x00\x02", extra=[palette, (b"tRNS", b"\x00")])).tolist() == [[[1, 2, 3, 0], [7, 8, 9, 255]]]
    rng = np.random.default_rng(3)
    for w, h in ((1, 1), (9, 11), (3, 2), (16, 8)):  # interlaced: each pass a picture
        pixels = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        raw = b""
        for x, y, dx, dy in png.PASSES:
            part = pixels[y::dy, x::dx]
            if part.size:
                kinds = rng.integers(0, 5, len(part))
                rows = [bytes([k]) + png.filtered(part, k)[i].tobytes() for i, k in enumerate(kinds)]
                raw += b"".join(rows)
        assert (png.decode(made(w, h, 8, 2, raw, 1)) == pixels).all()


def test_damage():
    good = png.encode(np.zeros((4, 4, 3), np.uint8))
    bad = [b"", b"JPEG", good[:20], good[:-4], good[:40] + b"\xff" + good[41:], made(2, 2, 8, 0, b"\x00"), made(0, 2, 8, 0, b""), made(2, 2, 3, 0, b"\x00"), made(1, 1, 8, 3, b"\x00\x05"), made(1, 1, 8, 0, b"\x09\x05")]
    for data in bad:
        with pytest.raises(png.PngError):
            png.decode(data)


def plain_share(contours, x, y):
    """Samples of a pixel that an odd number of edges lies left of."""
    n = 0
    for i in range(raster.SUB):
        for j in range(raster.SUB):
            px, py, inside = x + (j + 0.5) / raster.SUB, y + (i + 0.5) / raster.SUB, False
            for ring in contours:
                for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
                    if min(ay, by) <= py < max(ay, by) and ax + (py - ay) * ((bx - ax) / (by - ay)) <= px:
                        inside = not inside
            n += inside
    return n / raster.SUB**2


def plain_paint(canvas, contours, color, alpha):
    out = canvas.copy()
    for y in range(canvas.shape[0]):
        for x in range(canvas.shape[1]):
            share = plain_share(contours, x, y) * alpha
            out[y, x] = np.floor(canvas[y, x] + (np.array(color) * 255 - canvas[y, x]) * share + 0.5)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_paint(seed, monkeypatch):
    monkeypatch.setattr(raster, "STRIP", (64, 5)[seed % 2])
    rng = random.Random(seed)
    canvas = np.random.default_rng(seed).integers(0, 256, (23, 31, 3), dtype=np.uint8)
    want = canvas.copy()
    for _ in range(4):
        shape = [[(rng.uniform(-9, 40), rng.uniform(-9, 32)) for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(1, 2))]
        if rng.random() < 0.4:
            shape = [[(rng.randint(0, 31), rng.randint(0, 23)) for _ in range(4)]]  # corners on pixels
        color, alpha = tuple(rng.random() for _ in range(3)), rng.choice([1.0, 0.4])
        want = plain_paint(want, shape, color, alpha)
        raster.paint(canvas, [np.array(r) for r in shape], color, alpha)
    assert (canvas == want).all()


def test_glyphs_stay_in_their_box():
    for letter in raster.GLYPHS:
        points = np.concatenate([np.zeros((1, 2)), *raster.text_contours(letter, 0, 0, 6.0)])
        assert points.min() >= -0.65 and points[:, 0].max() <= 4.65 and points[:, 1].max() <= 6.65
    drawn = {a: b"".join(c.tobytes() for c in raster.text_contours(a, 0, 0, 6.0)) for a in raster.GLYPHS}
    assert len(set(drawn.values())) >= len(drawn) - 2  # O and 0, З and 3
    assert raster.text_contours("p7", 0, 0, 6.0)[0].tolist() == raster.text_contours("P7", 0, 0, 6.0)[0].tolist()


def blank(width, height):
    return png.encode(np.full((height, width, 3), 255, np.uint8))


MARKS = "sheet int, n int, mark_id string, kind string, x0 double, y0 double, x1 double, y1 double, ax double, ay double, bx double, by double"


def test_overlay(spark):
    pictures = spark.createDataFrame([(1, blank(90, 70)), (2, blank(40, 40)), (3, b"no picture"), (4, None)], "sheet int, data binary")
    marks = spark.createDataFrame([(1, 1, "P1", "span", 10.0, 10.0, 30.0, 18.0, 10.0, 40.0, 80.0, 55.0), (1, 2, "P12", "leader", 50.0, 20.0, 64.0, 28.0, 5.0, 60.0, 5.2, 60.0), (3, 1, "P1", "span", 1.0, 1.0, 5.0, 5.0, 0.0, 0.0, 9.0, 9.0), (9, 1, "P1", "span", 1.0, 1.0, 5.0, 5.0, 0.0, 0.0, 9.0, 9.0)], MARKS)
    shapes = overlay.mark_shapes(marks.withColumn("width", F.lit(90)).withColumn("height", F.lit(70)), ["sheet"]).where("sheet = 1").orderBy("z").collect()
    want = np.full((70, 90, 3), 255, np.uint8)
    for s in shapes:
        contours = s.contours if s.text is None else raster.text_contours(s.text, s.x, s.y, s.size)
        want = plain_paint(want, [np.reshape(c, (-1, 2)).tolist() for c in contours], s.color, s.alpha)
    got = {r.sheet: r for r in overlay.overlay(pictures, marks, ["sheet"]).collect()}
    assert set(got) == {1, 2, 3, 4} and (png.decode(bytes(got[1].data)) == want).all()
    assert bytes(got[2].data) == blank(40, 40) and got[3].error == "no PNG signature" and got[3].data is None and got[4].data is None
    # A frame of the fixed colour around the label, and the line only in full.
    lean = png.decode(bytes({r.sheet: r for r in overlay.overlay(pictures, marks, ["sheet"], full=False).collect()}[1].data))
    assert want[8, 20].tolist() == [128, 204, 159] and (lean[8, 20] == want[8, 20]).all()  # half of the frame's line
    assert (lean[47, 45] == 255).all() and want[47, 45, 1] < 150


def test_undecodable_picture(spark):
    broken = blank(9, 9)[:-20]
    pictures = spark.createDataFrame([(1, broken)], "sheet int, data binary")
    marks = spark.createDataFrame([(1, 1, "P1", "span", 1.0, 1.0, 5.0, 5.0, 0.0, 0.0, 9.0, 9.0)], MARKS)
    r = overlay.overlay(pictures, marks, ["sheet"]).collect()[0]
    assert r.data is None and r.error == "the picture ends early"


def test_annotate(spark):
    pictures = spark.createDataFrame([(1, blank(1500, 400)), (2, blank(30, 20))], "sheet int, data binary")
    rows = [(1, 3, "P2", "child", "pdf_text", "blue", 300.0, 100.0, 360.0, 130.0), (1, 1, None, "parent", "pdf_text", "green", 100.0, 100.0, 160.0, 130.0), (1, 7, "P9", "child", "model", "violet", 500.0, 100.0, 560.0, 130.0), (1, 8, "off", "child", "pdf_text", "red", 5000.0, 1.0, 5001.0, 2.0)]
    regions = spark.createDataFrame(rows, "sheet int, pos int, label string, kind string, origin string, color string, x0 double, y0 double, x1 double, y1 double")
    titles = spark.createDataFrame([(1, "Лист 1 · размечено 3 из 4"), (2, "")], "sheet int, title string")
    got = {r.sheet: r for r in overlay.annotate(pictures, regions, titles, ["sheet"]).collect()}
    pixels = png.decode(bytes(got[1].data))
    tone = lambda name: np.floor(np.array(overlay.NAMED[name]) * 255 + 0.5)
    for x, name in ((100, "green"), (300, "blue"), (500, "violet")):
        assert (pixels[115, x] == tone(name)).all() and (pixels[115, x + 30] == 255).all()  # a frame, nothing inside
        assert (pixels[101, x + 63] == tone(name)).all()  # its chip on the right
    edge = (pixels == np.floor(np.array(overlay.LEGEND_EDGE) * 255 + 0.5)).all(2)
    y, x = np.nonzero(edge)
    assert edge.sum() > 100 and y.min() > 200 and x.min() > 500 and x.max() < 1500  # the title's swatch, in the corner
    assert (pixels[200:, 500:] == tone("green")).all(2).sum() > 100 and (pixels[200:, 500:] == tone("orange")).all(2).sum() > 100
    assert bytes(got[2].data) == blank(30, 20)
    counted = regions.groupBy("sheet").agg(F.lit("T").alias("title"), F.lit(0).alias("parent"), F.lit(2).alias("child"), F.lit(0).alias("excluded"), F.lit(1).alias("model"), F.lit(1500).alias("width"), F.lit(400).alias("height"))
    told = [r.text for r in overlay.legend_shapes(counted, ["sheet"]).orderBy("z").collect() if r.text]
    assert told == ["T", "2 — дочерний участок", "1 — рамка по bbox модели"]


def test_trim_reads_pngs(spark):
    pixels = np.full((300, 400, 3), 255, np.uint8)
    pixels[100:250, 120:300] = 0
    df = spark.createDataFrame([(1, png.encode(pixels)), (2, b"x"), (3, None), (4, blank(200, 200))], "k int, data binary")
    got = {r.k: r for r in trim.trim_png(df, ["k"]).collect()}
    plain = trim.trim(spark.createDataFrame([(1, 400, 300, pixels.tobytes())], "k int, width int, height int, pixels binary"), ["k"]).collect()[0]
    assert (got[1].x0, got[1].y0, got[1].x1, got[1].y1) == (plain.x0, plain.y0, plain.x1, plain.y1) and not got[1].skipped
    cut = png.decode(bytes(got[1].trimmed))
    assert (cut == pixels[got[1].y0 : got[1].y1, got[1].x0 : got[1].x1]).all()
    assert got[2].error == "no PNG signature" and got[2].trimmed is None and got[3].error is None and got[3].trimmed is None
    assert got[4].skipped and got[4].empty and bytes(got[4].trimmed) == blank(200, 200)


def test_segment_outline():
    for ax, ay, bx, by in ((0, 0, 10, 0), (1, 1, 4, 5), (2, 2, 2, 2)):
        ring = raster.segment(ax, ay, bx, by, 2.0)
        area = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, np.roll(ring, -1, axis=0)))) / 2
        assert math.isclose(area, 2.0 * math.hypot(bx - ax, by - ay), abs_tol=1e-9)


def test_mark_shapes_plan_is_small(spark):
    """Values of a mark are named once: written out in each other they made a plan of 390,000 characters that no code was compiled for."""
    marks = spark.range(3).select("id", F.lit(1).alias("n"), F.lit("P1").alias("mark_id"), F.lit("span").alias("kind"), *((F.col("id") * 7.0 + i).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1", "ax", "ay", "bx", "by"))), F.lit(90).alias("width"), F.lit(70).alias("height"))
    plan = overlay.mark_shapes(marks, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 40_000
    generated = next(line for line in plan.splitlines() if "Generate" in line)
    assert len(generated) < 1_000


def test_rows_undone_one_by_one():
    """A few rows of Paeth in a large picture do not send all of it along diagonals."""
    rng = np.random.default_rng(7)
    for kinds in ([4, 2, 2, 1, 0, 3], [2, 2, 4, 4, 1, 2], [3, 0, 2, 2, 2, 4]):
        rest = rng.integers(0, 256, (6, 9, 3), dtype=np.uint8)
        assert (png._by_rows(np.array(kinds, np.uint8), rest) == plain_unfilter(kinds, rest)).all()


def test_equal_rows_are_filtered_once(monkeypatch):
    pixels = np.full((200, 30, 3), 255, np.uint8)
    pixels[50:150, 5:20] = (255, 0, 0)
    seen = []
    plain = png.filtered
    monkeypatch.setattr(png, "filtered", lambda p, *a: seen.append(len(p)) or plain(p, *a))
    assert (png.decode(png.encode(pixels)) == pixels).all()
    assert max(seen) < 10


def test_boxes_are_filled_as_other_shapes(monkeypatch):
    """Boxes with level sides give the pixels that crossings of their edges give."""
    rng = np.random.default_rng(11)
    for _ in range(60):
        x0, y0 = rng.uniform(-8, 40, 2).round(int(rng.integers(0, 3)))
        x1, y1 = (x0, y0) + rng.uniform(0, 30, 2).round(int(rng.integers(0, 3)))
        ring = np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])[:: rng.choice((1, -1))]
        old = rng.integers(0, 256, (33, 37, 3), dtype=np.uint8)
        color, alpha = rng.uniform(0, 1, 3), float(rng.choice((1.0, 0.4)))
        fast, slow = old.copy(), old.copy()
        raster.paint(fast, [ring], color, alpha)
        with monkeypatch.context() as m:
            m.setattr(raster, "upright", lambda r: None)
            raster.paint(slow, [ring], color, alpha)
        assert (fast == slow).all()


def test_rows_of_paeth_under_equal_pixels():
    """Stretches under equal pixels are sums, and give what the bytes give one by one."""
    rng = np.random.default_rng(5)
    for _ in range(40):
        above = np.repeat(rng.integers(0, 256, (3, 3), dtype=np.uint8), 40, axis=0)
        rest = rng.integers(0, 256, above.shape, dtype=np.uint8)
        assert (png._row(4, rest, above) == plain_unfilter([0, 4], np.stack([above, rest]))[1]).all()
        rest[rng.random(120) < 0.9] = 0
        rows = np.stack([above, rest, rest, rest])
        assert (png._by_rows(np.array([0, 4, 2, 2], np.uint8), rows) == plain_unfilter([0, 4, 2, 2], rows)).all()


def test_pictures_leave_render_many_at_once(spark):
    """Small pictures go on in common batches, equal ones are drawn once, and one decode gives all that is asked of a picture."""
    from plumbline.plans import pages

    shape = "z bigint, contours array<array<double>>, text string, x double, y double, size double, color array<double>, alpha double"
    box = lambda x: [[x, 10.0, x + 110, 10.0, x + 110, 120.0, x, 120.0]]
    pictures = spark.createDataFrame([(i, blank(200, 160)) for i in range(40)] + [(40, b"x"), (41, None), (42, blank(200, 160))], "k int, data binary").coalesce(1)
    shapes = spark.createDataFrame([(i, 1, box(20.0 + i % 3), None, None, None, None, [1.0, 0.0, 0.0], 1.0) for i in range(42)], f"k int, {shape}")
    drawn = overlay.render(pictures, shapes, ["k"])
    got = {r.k: r for r in trim.trim_png(drawn, ["k"], cut=False, more=pages._shares, added="red long, blue long").collect()}
    assert sorted(got) == list(range(43)) and all((got[i].red, got[i].blue, got[i].x0, got[i].x1) == (110 * 110, 0, 19 + i % 3, 131 + i % 3) for i in range(40))
    assert got[40].red is None and got[41].red is None and (got[42].red, got[42].empty) == (0, True)

    def sizes(batches):
        yield from (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)

    n = sum(r.n > 1 for r in drawn.mapInArrow(sizes, "n long").collect())
    assert n >= 1


def test_known_pictures_are_bounded(monkeypatch):
    monkeypatch.setattr(png, "HELD", 10_000)
    known = png.Known()
    for i in range(100):
        known[(bytes(900), i)] = {"trimmed": bytes(100)}
        assert known.size <= 10_000 and len(known) <= 10
    known[(bytes(20_000),)] = b""
    assert (bytes(20_000),) not in known and (bytes(900), 99) in known
