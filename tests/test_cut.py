"""The cut of a sheet's primitives against points sampled along strokes and plain boxes."""

import random

from plumbline.operators import redaction
from plumbline.sources import schemas

BY = ["doc_id", "page_number"]


def sheets(seed, n=12):
    rng = random.Random(seed)
    boxes, paths, words, spans = [], [], [], []
    number = lambda top: rng.choice([rng.randint(0, top), round(rng.uniform(0, top), 1)]) * 1.0
    for page in range(n):
        key = ("d", page)
        for i in range(rng.randint(0, 9)):
            x, y = number(40), number(40)
            boxes.append((*key, f"N{i}", "x", "r", x, y, x + number(25), y + number(25), rng.random() < 0.8, rng.choice([0.0, 2.0]), None))
        for i in range(25):
            items = []
            for _ in range(rng.randint(1, 3)):
                x0, y0 = number(50), number(50)
                x1, y1 = rng.choice([(x0 + number(20), y0), (x0, y0 + number(20)), (x0 + number(20) - 10, y0 + number(20) - 10), (x0, y0)])
                items.append((rng.choice(["l", "l", "re"]), x0, y0, x1, y1))
            paths.append((*key, i, None, 1.0, items))
            x, y = number(50), number(50)
            words.append((*key, 0, 0, i, f"w{i}", x, y, x + number(9) + 0.1, y + number(9) + 0.1))
            spans.append((*key, 0, 0, i, 8.0, 1.0, 0.0, [(chr(97 + k), x + 3 * k, y, x + 3 * k + 2.5, y + 4) for k in range(rng.randint(1, 6))]))
    return boxes, paths, words, spans


def frames(spark, seed):
    boxes, paths, words, spans = sheets(seed)
    decided = spark.createDataFrame(boxes, "doc_id string, page_number int, mark string, text string, role string, x0 double, y0 double, x1 double, y1 double, applied boolean, pad double, skip_reason string")
    tables = [spark.createDataFrame(rows, schema) for rows, schema in ((paths, schemas.PATHS), (words, schemas.WORDS), (spans, schemas.SPANS))]
    return (boxes, paths, words, spans), tables, decided


def cuts_of(boxes, page):
    return [(x0 - p, y0 - p, x1 + p, y1 + p) for _, n, _, _, _, x0, y0, x1, y1, on, p, _ in boxes if on and n == page]


def overlaps(a, b):
    return a[0] < b[2] and a[2] > b[0] and a[1] < b[3] and a[3] > b[1]


def under(cuts, ax, ay, bx, by):
    """All of many points of a stroke lie in some cut; the ends of every cut's part are among them."""
    at = {i / 400 for i in range(401)}
    for x0, y0, x1, y1 in cuts:
        for a, b, lo, hi in ((ax, bx, x0, x1), (ay, by, y0, y1)):
            if a != b:
                for t in ((lo - a) / (b - a), (hi - a) / (b - a)):
                    at |= {min(1.0, max(0.0, t + d)) for d in (-1e-6, 1e-6)}
    points = [(ax + (bx - ax) * t, ay + (by - ay) * t) for t in at]
    return all(any(x0 - 1e-9 <= x <= x1 + 1e-9 and y0 - 1e-9 <= y <= y1 + 1e-9 for x0, y0, x1, y1 in cuts) for x, y in points)


def strokes(items):
    for kind, x0, y0, x1, y1 in items:
        yield from [(x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)] if kind == "re" else [(x0, y0, x1, y1)]


def test_apply(spark):
    gone = 0
    for seed in (1, 2, 3):
        (boxes, paths, words, spans), tables, decided = frames(spark, seed)
        out = redaction.apply(*tables, decided, BY)
        kept = {(r.page_number, r.path_id) for r in out["paths"].collect()}
        want = {(p[1], p[2]) for p in paths if not all(under(cuts_of(boxes, p[1]), *s) for s in strokes(p[5]))}
        assert kept == want
        gone += len(paths) - len(want)
        assert {(r.page_number, r.word_no) for r in out["words"].collect()} == {(w[1], w[4]) for w in words if not any(overlaps(w[6:], c) for c in cuts_of(boxes, w[1]))}
        left = {(s[1], s[4]): "".join(c[0] for c in s[8] if not any(overlaps(c[1:], x) for x in cuts_of(boxes, s[1]))) for s in spans}
        assert {(r.page_number, r.span_no): "".join(c.c for c in r.chars) for r in out["spans"].collect()} == {k: v for k, v in left.items() if v}
        assert out["paths"].schema == tables[0].schema and out["spans"].columns == tables[2].columns
    assert gone > 30


def test_union_covers_what_no_box_does(spark):
    boxes = [("d", 1, f"N{i}", "", "", x, 0.0, x + 10.0, 10.0, True, 0.0, None) for i, x in enumerate((0.0, 10.0, 20.5))]
    decided = spark.createDataFrame(boxes, "doc_id string, page_number int, mark string, text string, role string, x0 double, y0 double, x1 double, y1 double, applied boolean, pad double, skip_reason string")
    lines = [[("l", 1.0, 5.0, 19.0, 5.0)], [("l", 1.0, 5.0, 25.0, 5.0)], [("l", 1.0, 1.0, 19.0, 9.0)], [("l", 1.0, 5.0, 2.0, 5.0), ("l", 1.0, 5.0, 1.0, 11.0)], [("re", 1.0, 1.0, 19.0, 9.0)], [("re", 1.0, 1.0, 19.0, 11.0)], []]
    paths = spark.createDataFrame([("d", 1, i, None, 1.0, p) for i, p in enumerate(lines)], schemas.PATHS)
    assert sorted(r.path_id for r in redaction.cut_paths(paths, redaction.applied_boxes(decided, BY), BY).collect()) == [1, 3, 5, 6]


def test_guards_pass_over_the_lines_once(spark):
    """Labels, strokes and leaders come from one pass, so what makes the lines is not in a task three times."""
    row = ("d", 1, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0)
    kind = "doc_id string, page_number int, x0 double, y0 double, x1 double, y1 double, ax double, ay double, bx double, by double, leader_end struct<x:double,y:double>"
    lines = spark.createDataFrame([(*row, (8.0, 9.0)), (*row, None)], kind)
    got = redaction.guards(lines, ["doc_id", "page_number"])
    label, stroke, lead = (("label", 0.0, 1.0, 2.0, 3.0, *[None] * 4), ("line", *[None] * 4, 4.0, 5.0, 6.0, 7.0), ("line", *[None] * 4, 4.0, 5.0, 8.0, 9.0))
    assert sorted(map(repr, (tuple(r)[2:] for r in got.collect()))) == sorted(map(repr, [label, label, stroke, stroke, lead]))
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
