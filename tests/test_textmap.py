"""The text layer and the geometry of drawn marks."""

import struct

import pytest
from pyspark.sql import functions as F

from plumbline.functions import layout
from plumbline.operators import textmap

SPANS = "p int, block_no int, line_no int, span_no int, text string, font_size double, dir_x double, dir_y double, x0 double, y0 double, x1 double, y1 double"


def test_lines(spark):
    rows = [(1, 0, 0, 0, "Лист", 8.0, 1.0, 0.0, 20.0, 5.0, 40.0, 13.0), (1, 0, 0, 1, "2", 9.0, 1.0, 0.0, 44.0, 5.0, 48.0, 14.0), (1, 0, 1, 0, " ", 8.0, 1.0, 0.0, 0.0, 0.0, 1.0, 1.0), (1, 1, 0, 0, "up", 4.0, 0.0, -1.0, 5.0, 2.0, 9.0, 30.0)]
    df = spark.createDataFrame(rows, SPANS)
    lines = textmap.line_items(df, ["p"])
    got = [(r.n, r.text, r.x1, r.size, r.angle, r.cx) for r in lines.orderBy("n").collect()]
    assert got == [(1, "up", 9.0, 4.0, 90.0, 7.0), (2, "Лист 2", 48.0, 9.0, 0.0, 34.0)]
    assert textmap.line_items(df, ["p"], 5.0).count() == 1
    assert [r.text for r in textmap.find(lines, "лист").collect()] == ["Лист 2"] and textmap.find(lines, "лист", True).count() == 0
    assert textmap.page_text(lines, ["p"]).first().text == "up\nЛист 2"
    hits = textmap.occurrences(spark.createDataFrame([("abcab", 0.0, 10.0)], "text string, x0 double, x1 double"), "AB").orderBy("at").collect()
    assert [(h.at, h.x0, h.x1) for h in hits] == [(1, 0.0, 4.0), (4, 6.0, 10.0)]


def test_items(spark):
    chars = lambda text, x: [(c, x + i, 1.0, x + i + 1.0, 3.0) for i, c in enumerate(text)]
    df = spark.createDataFrame([(1, 8.0, chars("a bc", 0.0)), (1, 8.0, chars("a", 0.0)), (1, 1.0, chars("tiny", 50.0))], "p int, font_size double, chars array<struct<c:string,x0:double,y0:double,x1:double,y1:double>>")
    view = spark.createDataFrame([(1, 2.0, 0.0, 1.0)], "p int, zoom double, dx double, dy double")
    items = textmap.text_items(df.coalesce(1), view, ["p"], least_px=4.0)
    assert [(r.n, r.text, r.x0, r.y1) for r in items.orderBy("n").collect()] == [(1, "a", 0.0, 5.0), (2, "bc", 4.0, 5.0)]
    assert textmap.text_items(df.coalesce(1), view, ["p"], most=2).count() == 2
    sheets = spark.createDataFrame([(1, 100, 50), (2, 100, 50)], "p int, width int, height int")
    blocks = {r.p: r.block for r in textmap.prompt_block(items, sheets, ["p"]).collect()}
    assert blocks[1].endswith('100x50 px.\n\n"a" [0,1,2,5]\n"bc" [4,1,8,5]') and "scan" in blocks[2]
    units = df.limit(1).select(F.array(*textmap.in_units([F.lit(x) for x in (0.0, 72.0, 36.0, 144.0)], "in", F.lit(200.0), bottom_left=True))).first()[0]
    assert units == [0.0, 0.78, 0.5, 1.78]


def test_layout(spark):
    one = spark.range(1)
    lit = lambda *xs: [F.lit(float(x)) for x in xs]
    r = one.select(
        layout.inset(*lit(0, 0, 10, 0), 2.0).alias("a"), layout.inset(*lit(0, 0, 3, 0), 2.0).alias("b"), F.array(*layout.normal(*lit(0, 0, 0, 5))).alias("n"), F.array(*layout.away(*lit(5, 5, 0, 0))).alias("w"),
        F.array(*layout.badge(lit(0, 10, 20, 20), F.lit("P12"), 6.0)).alias("badge"), layout.chip(lit(10, 10, 30, 20), 10.0, F.lit(100.0), F.lit(100.0)).alias("right"), layout.chip(lit(80, 10, 99, 20), 10.0, F.lit(100.0), F.lit(100.0)).alias("left"),
        layout.chip(lit(0, 0, 9, 9), 10.0, F.lit(12.0), F.lit(12.0)).alias("clipped"), layout.png_size(F.lit(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480))).alias("png"), layout.png_size(F.lit(b"GIF")).alias("gif"),
        layout.image_name(F.lit("page"), F.lit(7)).alias("name"), layout.switched_on(F.lit(None).cast("boolean"), True).alias("on"),
    ).first()
    assert tuple(r.a) == (2.0, 0.0, 8.0, 0.0) and r.b is None and r.n == [-1.0, 0.0] and r.w == [10.0, 10.0]
    assert r.badge == pytest.approx([20 - 0.28 * 13.662, 10 - 0.34 * 6.9, 20 + 0.72 * 13.662, 10 + 0.66 * 6.9])
    assert r.right.x0 == 32 and r.left.x1 == 78 and (r.clipped.x0, r.clipped.x1) == (11.0, 12.0)
    assert tuple(r.png) == (640, 480) and r.gif is None and r.name == "page_07.png" and r.on


def test_glyph_hits(spark):
    """Boxes of hits against a search over the characters, one by one."""
    import random

    rng, rows = random.Random(4), []
    for page in range(20):
        for line in range(rng.randint(1, 4)):
            x = 0.0
            for span in range(rng.randint(1, 3)):
                chars = []
                for _ in range(rng.randint(1, 7)):
                    c = rng.choice("aAbB \t ")
                    wide = rng.choice([2.0, 3.5])
                    chars.append((c, x, line * 10.0 - rng.random(), x + wide, line * 10.0 + 8))
                    x += wide
                rows.append(("d", page, line // 2, line, span, 8.0, 1.0, 0.0, chars))
    from plumbline.sources import schemas

    spans = spark.createDataFrame(rows, schemas.SPANS)
    for needle in ("ab", "A a", " b  A ", "aa", "b", "a a b"):
        wanted = " ".join(needle.split()).lower()
        want = {}
        for page in range(20):
            listed, before = [], None
            for r in sorted((r for r in rows if r[1] == page), key=lambda r: r[2:5]):
                if before != r[2:4]:
                    listed.append((" ", r[2:4], None))
                    before = r[2:4]
                listed += [(c[0].lower() if c[0].strip() else " ", r[2:4], c[1:]) for c in r[8]]
            seen = [x for i, x in enumerate(listed) if x[0] != " " or not i or listed[i - 1][0] != " "]
            text, at, hit = "".join(x[0] for x in seen), 0, 0
            while (at := text.find(wanted, at)) >= 0:
                hit += 1
                part = 0
                for place in dict.fromkeys(x[1] for x in seen[at : at + len(wanted)] if x[0] != " "):
                    boxes = [x[2] for x in seen[at : at + len(wanted)] if x[1] == place and x[0] != " "]
                    part += 1
                    want[page, hit, part] = (*place, min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes))
                at += len(wanted)
        got = {(r.page_number, r.hit, r.part): (r.block_no, r.line_no, r.x0, r.y0, r.x1, r.y1) for r in textmap.glyph_hits(spans, ["doc_id", "page_number"], needle).collect()}
        assert got == want and want, needle
