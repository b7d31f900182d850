"""Table functions in SQL against the DataFrame functions, and the table of a stream against a batch."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline import tables
from plumbline.operators import annotate, drawing, sequence

BY = ["doc_id", "page_number"]


@pytest.fixture(scope="module")
def sql(spark):
    tables.register(spark)

    def run(query, **views):
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return spark.sql(query)

    return run


def same(a, b):
    key = lambda r: str(tuple(r))
    cols = a.columns
    assert sorted(a.collect(), key=key) == sorted(b.select(*cols).collect(), key=key)
    return a.count()


def test_walk(spark, sql):
    replies = ['{"segments": [{"length": 5, "mark": " P1 "}, {"sub": {"value": 7.5, "bbox": [4, 3, 2, 1]}}], "list": [1, 2]}', "{broken", None, "[]", '{"a": {"b": {"length": 1}}}']
    df = spark.createDataFrame([("d", i, r) for i, r in enumerate(replies)], "doc_id string, page_number int, response string")
    n = same(sql("SELECT * FROM walk_reply(TABLE(SELECT * FROM replies_t))", replies_t=df), annotate.walk(df, BY))
    assert n == 10


def test_cluster_lines(spark, sql):
    rng = random.Random(1)
    rows = [("d", p, f"w{i}", x := rng.uniform(0, 90), y := rng.uniform(0, 40), x + 5, y + rng.choice([2, 6])) for p in range(12) for i in range(30)]
    words = spark.createDataFrame(rows, "doc_id string, page_number int, word string, x0 double, y0 double, x1 double, y1 double")
    assert same(sql("SELECT * FROM cluster_lines(TABLE(words_t) PARTITION BY (doc_id, page_number) ORDER BY (y0, x0, x1, word), 3.0)", words_t=words), sequence.cluster_lines(words, BY, 3.0)) > 50


def test_group_spans(spark, sql):
    rng = random.Random(2)
    rows = [("d", p, rng.choice("abc"), x := rng.randint(0, 60) * 0.5, y := rng.randint(0, 8) * 1.25, x + rng.choice([2.0, 9.0]), y + rng.choice([1.0, 4.0])) for p in range(40) for _ in range(25)]
    spans = spark.createDataFrame(rows, "doc_id string, page_number int, text string, x0 double, y0 double, x1 double, y1 double")
    assert same(sql("SELECT * FROM group_spans(TABLE(spans_t) PARTITION BY (doc_id, page_number) ORDER BY (y0, x0))", spans_t=spans), sequence.group_spans(spans, BY)) > 100


def items(seed, sheets=25):
    """Crowded sheets: numbers, spans and leaders close together, so that they compete."""
    rng = random.Random(seed)
    rows = []
    for page in range(sheets):
        spans = [(rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(rng.randint(0, 7))]
        gaps = (rng.uniform(2, 25), rng.uniform(2, 25))
        none = (None,) * 4
        for n in range(1, rng.randint(1, 10)):
            x, y = rng.uniform(0, 60), rng.uniform(0, 60)
            rows.append(("d", page, "number", n, str(n), x, y, x + 6, y + 3, *none, None, *gaps))
        rows += [("d", page, "span", n, None, *none, *s, None, *gaps) for n, s in enumerate(spans, 1)]
        for n in range(1, rng.randint(1, 7)):
            anchor = rng.choice([None, rng.randint(1, len(spans))]) if spans else None
            rows.append(("d", page, "leader", n, None, *none, *(rng.uniform(0, 60) for _ in range(4)), anchor, *gaps))
    return rows


ITEMS = "doc_id string, page_number int, kind string, n int, text string, x0 double, y0 double, x1 double, y1 double, ax double, ay double, bx double, by double, anchor int, label_gap double, leader_label_gap double"


def plain_pairs(rows):
    """Three passes over plain lists; every pass looks at all that is left and takes the first best."""
    numbers, spans, leaders = (sorted((r for r in rows if r[2] == k), key=lambda r: r[3]) for k in ("number", "span", "leader"))
    label_gap, leader_gap = rows[0][14], rows[0][15]

    def box_gap(x, y, m):
        dx = m[5] - x if x < m[5] else x - m[7] if x > m[7] else 0.0
        dy = m[6] - y if y < m[6] else y - m[8] if y > m[8] else 0.0
        return (dx * dx + dy * dy) ** 0.5

    def span_gap(m, s):
        px, py = (m[5] + m[7]) / 2, (m[6] + m[8]) / 2
        ax, ay, bx, by = s[9:13]
        size = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0.0, min(1.0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / size)) if size >= 1e-9 else 0.0
        d = ((px - ax - t * (bx - ax)) ** 2 + (py - ay - t * (by - ay)) ** 2) ** 0.5
        return d, d + 0.35 * abs(t - 0.5) * size**0.5

    used_number, used_leader, out = set(), set(), []
    for m in numbers:
        best = None
        for q in leaders:
            if q[13] is None and q[3] not in used_leader:
                g = box_gap(q[11], q[12], m)
                if g <= leader_gap and (best is None or g < best[0]):
                    best = (g, q)
        if best:
            used_number.add(m[3])
            used_leader.add(best[1][3])
            out.append((*rows[0][:2], "pointer", m[3], None, best[1][3]))
    for s in spans:
        best = None
        for m in numbers:
            if m[3] not in used_number:
                d, score = span_gap(m, s)
                if d <= label_gap and (best is None or score < best[0]):
                    best = (score, m)
        if best:
            used_number.add(best[1][3])
            out.append((*rows[0][:2], "span", best[1][3], s[3], None))
            continue
        for q in leaders:
            if q[13] != s[3] or q[3] in used_leader:
                continue
            best = None
            for m in numbers:
                if m[3] not in used_number:
                    g = box_gap(q[11], q[12], m)
                    if g <= leader_gap and (best is None or g < best[0]):
                        best = (g, m)
            if best:
                used_number.add(best[1][3])
                used_leader.add(q[3])
                out.append((*rows[0][:2], "span", best[1][3], s[3], q[3]))
                break
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_attach_by_plain_code(spark, sql, seed):
    rows = items(seed)
    df = spark.createDataFrame(rows, ITEMS)
    key = lambda r: str(tuple(r))
    want = sorted((p for page in {r[1] for r in rows} for p in plain_pairs([r for r in rows if r[1] == page])), key=key)
    got = sorted((tuple(r) for r in drawing.attach(df).collect()), key=key)
    assert got == want and {p[2] for p in want} == {"span", "pointer"} and any(p[2] == "span" and p[5] for p in want)
    assert same(sql("SELECT * FROM attach(TABLE(items_t) PARTITION BY (doc_id, page_number) ORDER BY (n, kind))", items_t=df), drawing.attach(df)) == len(want)


def test_registered_once_more(spark):
    tables.register(spark)
    assert spark.sql("SELECT * FROM walk_reply(TABLE(SELECT 'd' AS doc_id, 1 AS page_number, '{\"length\": 3}' AS response))").select(F.col("value")).first()[0] == 3.0
