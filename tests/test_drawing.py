"""Detection on synthetic sheets with known answers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import annotate, drawing, polygons, redaction, sequence, spatial, trim
from plumbline.sources import schemas

W, GAP = 0.48, 0.2


class Sheet:
    """Builds the primitives of one sheet at a scale."""

    def __init__(self, page: int, scale: float = 1.0):
        self.page, self.k, self.paths, self.words, self.spans = page, scale, [], [], []

    def path(self, items, fill=None, width=W):
        k = self.k
        self.paths.append(("d", self.page, len(self.paths), fill, width * k, [(kind, *(k * c for c in xy)) for kind, *xy in items]))

    def arrow(self, x, y, dx, dy, size=4.0):
        n = math.hypot(dx, dy)
        ux, uy = dx / n * size, dy / n * size
        a, b, c = (x, y), (x - ux - uy / 4, y - uy + ux / 4), (x - ux + uy / 4, y - uy - ux / 4)
        self.path([("l", *a, *b), ("l", *b, *c), ("l", *c, *a)], fill=[0.0])

    def word(self, text, x, y, line=None, size=7.43, height=8.4):
        w, n = 4.0 * len(text), len(self.words)
        k = self.k
        self.words.append(("d", self.page, 0, n if line is None else line, n, text, k * x, k * y, k * (x + w), k * (y + height)))
        chars = [(c, k * (x + 4 * i), k * y, k * (x + 4 * i + 4), k * (y + height)) for i, c in enumerate(text)]
        self.spans.append(("d", self.page, 0, n, n, size * k, 1.0, 0.0, chars))

    def span(self, ax, ay, bx, by):
        self.path([("l", ax, ay, bx, by)])
        self.arrow(ax, ay, ax - bx, ay - by)
        self.arrow(bx, by, bx - ax, by - ay)


def draw(page, scale=1.0):
    s = Sheet(page, scale)
    s.span(100, 100, 220, 100)
    s.word("1250", 150, 88)
    s.path([("l", 300, 300, 340, 340)])  # a pointer: one arrow, a number at its free end
    s.arrow(300, 300, -1, -1)
    s.word("13", 342, 342)
    s.span(100, 400, 130, 400)  # its label is led away
    s.path([("l", 115, 400, 160, 440)])
    s.arrow(115, 400, -45, -40)
    s.word("224", 161, 441)
    s.path([("re", 500, 100, 520, 120)])
    s.word("9", 508, 105)
    ring = [(600 + 15 * math.cos(t * math.pi / 12), 115 + 15 * math.sin(t * math.pi / 12)) for t in range(24)]
    s.path([("l", *ring[i], *ring[i + 1]) for i in range(0, 23, 2)])  # dashed
    s.word("7", 598, 111)
    s.word("X", 50, 600, line=900)
    s.word("267000", 57, 600, line=900)
    s.word("55", 700, 600, height=3.0, size=2.0)
    s.span(100, 500, 300, 500)  # an overall and its chain
    s.word("400", 190, 488)
    s.span(100, 530, 200, 530)
    s.word("150", 140, 518)
    s.span(200, 530, 300, 530)
    s.word("250", 240, 518)
    s.word("77", 800, 800)  # near nothing
    s.path([("l", 900, 900, 950, 900)], width=1.5)
    return s


def tables(spark, drawn):
    every = lambda part: [r for s in drawn for r in getattr(s, part)]
    sheets = spark.createDataFrame([("d", s.page, 1190.55 * s.k, 841.89 * s.k) for s in drawn], schemas.SHEETS)
    spans = spark.createDataFrame(every("spans"), schemas.SPANS)
    return sheets, spark.createDataFrame(every("paths"), schemas.PATHS), spark.createDataFrame(every("words"), schemas.WORDS), spans


@pytest.fixture(scope="module")
def found(spark):
    drawn = [draw(1), draw(2, 3.0), draw(3, 0.25), Sheet(4)]
    sheets, paths, words, spans = tables(spark, drawn)
    got = drawing.detect(sheets, paths.repartition(5), words, spans)
    return {k: t.cache() for k, t in got.items()}


@pytest.mark.parametrize("page", [1, 2, 3])
def test_lines(found, page):
    rows = found["lines"].where(F.col("page_number") == page).orderBy("idx").collect()
    assert [(r.label, r.kind) for r in rows] == [("1250", "span"), ("13", "pointer"), ("224", "span"), ("400", "span"), ("150", "span"), ("250", "span")]
    assert [r.label for r in rows if r.leader_end] == ["224"] and [r.value for r in rows] == [1250, 13, 224, 400, 150, 250]
    assert [r.idx for r in rows] == [1, 2, 3, 4, 5, 6]
    orphans = found["orphans"].where(F.col("page_number") == page).collect()
    assert [r.text for r in orphans] == ["77"]
    r = drawing.rejected(found["numbers"]).where(F.col("page_number") == page).first()
    assert sorted(r.texts) == ["267000", "7", "9"] and (r.too_small, r.in_row, r.in_contour) == (1, 1, 2)


def test_stats_and_scan(found):
    rows = {r.page_number: r for r in found["stats"].collect()}
    assert [round(rows[p].scale, 3) for p in (1, 2, 3)] == [1, 3, 0.25] and rows[1].scale_source == "text" and rows[4].scale_source == "side"
    assert (rows[1].arrows, rows[1].contours, rows[1].spans, rows[1].leaders, rows[1].leaders_anchored, rows[1].lines) == (12, 2, 5, 2, 1, 6)
    assert rows[4].lines == rows[4].numeric_words == 0


def test_measured_width(spark):
    sheets, paths, words, spans = tables(spark, [draw(1, 2.0)])
    got = drawing.detect(sheets, paths, words, spans, width=None)
    assert got["lines"].count() == 6 and got["limits"].first().width == pytest.approx(0.96)


def test_hierarchy_and_marks(spark, found):
    lines = found["lines"].where("page_number = 1")
    rows = {r.label: r for r in spatial.hierarchy(lines, drawing.SHEET).collect()}
    # Whatever runs parallel within its ends is under the overall, near or far.
    assert rows["400"].children == [1, 3, 5, 6] and rows["150"].parent == rows["250"].parent == 4 and rows["1250"].children == [3, 5] and rows["13"].children == []
    t = spatial.chain_total(spatial.hierarchy(lines, drawing.SHEET), drawing.SHEET).first()
    assert (t.sum_all, t.sum_without_duplicates) == (2287, 413) and (4, 400.0, 1874.0, False) in [tuple(o) for o in t.overalls]
    chain = spatial.hierarchy(lines.where("idx > 3"), drawing.SHEET)
    assert [tuple(o) for o in spatial.chain_total(chain, drawing.SHEET).first().overalls] == [(4, 400.0, 400.0, True)]
    view = spark.createDataFrame([("d", 1, 2.0, 10.0, 20.0)], "doc_id string, page_number int, zoom double, dx double, dy double")
    marks = drawing.marks_in_pixels(lines, view)
    got = [(r.mark_id, r.label, r.x0, r.axis) for r in marks.orderBy("y0").collect()]
    assert got[0] == ("P1", "1250", 290.0, 0) and [g[0] for g in got] == [f"P{i}" for i in range(1, 7)]
    assert drawing.prompt_block(marks).first().block.split("\n")[0] == 'P1 "1250" [290,156,322,173] линия [190,180,430,180] отрезок ось 0 (0°)'


def test_redaction(spark, found):
    sheets, paths, words, spans = tables(spark, [draw(1)])
    text = F.array_join(F.transform("chars", lambda c: c.c), "")
    box = [F.array_min(F.transform("chars", lambda c: c[k])) if k in ("x0", "y0") else F.array_max(F.transform("chars", lambda c: c[k])) for k in spatial.BOX]
    flat = spans.select(*drawing.SHEET, text.alias("text"), *[b.alias(c) for b, c in zip(box, spatial.BOX)])
    items = redaction.elements(flat, drawing.SHEET)
    assert "X 267000" in {r.text for r in items.collect()}
    lines = found["lines"].where("page_number = 1")
    roles = redaction.assign_roles(items, lines.select(*drawing.SHEET, *spatial.BOX), drawing.SHEET)
    got = {r.text: r.role for r in roles.collect()}
    assert got["1250"] == got["13"] == "dimension" and got["X 267000"] == "coordinate" and got["9"] == "other"
    contours = found["contours"].where("page_number = 1")
    plan = redaction.plan(roles, contours, drawing.SHEET)
    nine = plan.where("text = '9'").first()
    assert (nine.x0, nine.y1) == (500 - 2.4, 120 + 2.4)
    assert redaction.removable_frames(contours, plan.withColumn("x0", F.col("x0") + 3).withColumn("y0", F.col("y0") + 3).withColumn("x1", F.col("x1") - 3).withColumn("y1", F.col("y1") - 3), drawing.SHEET).count() == 2
    places = {"N1": (150.0, 99.0, 160.0, 101.0), "N2": (700.0, 700.0, 710.0, 710.0), "N3": (205.0, 101.0, 215.0, 106.0), "N4": (155.0, 84.0, 160.0, 87.0), "N5": (150.0, 92.0, 160.0, 97.0)}
    boxes = spark.createDataFrame([("d", 1, k, *v) for k, v in places.items()], "doc_id string, page_number int, mark string, x0 double, y0 double, x1 double, y1 double")
    done = {r.mark: (r.applied, r.pad, r.skip_reason) for r in redaction.decide(boxes, redaction.guards(lines, drawing.SHEET), drawing.SHEET).collect()}
    assert done == {"N1": (False, None, redaction.LINE_HIT), "N5": (False, None, redaction.LABEL_HIT), "N2": (True, 2.4, None), "N3": (True, 0.0, None), "N4": (True, 0.0, None)}


def test_shapes():
    square = [((0, 0), (1, 0)), ((1, 0), (1, 1)), ((1, 1), (0, 1)), ((0, 1), (0, 0))]
    tail = [((5, 5), (6, 6)), ((6, 6), (7, 5))]
    assert sorted(map(len, polygons.components(square + tail))) == [2, 4]
    assert polygons.is_loop(square) and not polygons.is_loop(tail) and not polygons.is_loop(square + [((0, 0), (-1, 0))])
    rng = random.Random(1)
    for _ in range(30):
        points = [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(rng.randint(3, 25))]
        corners = polygons.hull(points)
        assert {(min(p[0] for p in points)), (max(p[0] for p in points))} <= {p[0] for p in corners}
        a = polygons.area(corners)
        for p in points:  # no point is outside: the area does not grow
            assert polygons.area(polygons.hull([*corners, p])) == pytest.approx(a)
    assert polygons.area([(0, 0), (2, 0), (2, 2), (0, 2)]) == 4


def test_closed_loops(spark):
    rows = [(1, *a, *b) for a, b in [((0.0, 0.0), (1.0, 0.0)), ((1.0, 0.0), (0.0, 1.0)), ((0.0, 1.0), (0.0, 0.0))]] + [(2, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "p int, ax double, ay double, bx double, by double")
    assert [r.p for r in polygons.closed_loops(df, ["p"]).collect()] == [1]
    assert polygons.bounds(df, ["p"]).where("p = 1").first()[1:] == (0.0, 0.0, 1.0, 1.0)


def raster(case):
    page = np.full((1200, 1600), 255, np.uint8)
    level = {"grey": 240, "noisy": 240}.get(case, 255)
    page[:] = level
    if case == "noisy":
        page[:] = np.kron(np.random.default_rng(1).integers(level - 2, level + 3, (60, 80)), np.ones((20, 20))).astype(np.uint8)
    if case != "blank":
        x0, y0, x1, y1 = (780, 580, 820, 620) if case == "small" else (400, 300, 1200, 900)
        for sl in ((slice(y0, y1), slice(x0, x0 + 2)), (slice(y0, y1), slice(x1 - 2, x1)), (slice(y0, y0 + 2), slice(x0, x1)), (slice(y1 - 2, y1), slice(x0, x1))):
            page[sl] = 0
    if case == "speck":
        page[600:602, 120:122] = 0
    if case == "faint":
        page[100:1100, 100] = 250
    return page


@pytest.mark.parametrize(
    "case, options, want, tolerance",
    [
        ("blank", {}, (0, 0, 1600, 1200), 0), ("white", {}, (400, 300, 1200, 900), 8), ("grey", {}, (400, 300, 1200, 900), 8), ("noisy", {"noise": 8}, (400, 300, 1200, 900), 8),
        ("speck", {"min_ink": 1}, (100, 300, 1200, 900), 24), ("speck", {"min_ink": 8}, (400, 300, 1200, 900), 8), ("faint", {}, (400, 300, 1200, 900), 8), ("small", {}, (0, 0, 1600, 1200), 0),
    ],
)
def test_trim(case, options, want, tolerance):
    t = trim.Trim(**options)
    page = raster(case)
    box, found = trim.content_box(page, t)
    assert all(abs(a - b) <= tolerance for a, b in zip(trim.expand(box, t, 1600, 1200), want)) and found["empty"] == (case == "blank")


def test_trim_rows(spark):
    rows = [(c, 1600, 1200, bytearray(raster(c).tobytes())) for c in ("blank", "white")]
    got = {r.case: r for r in trim.trim(spark.createDataFrame(rows, "case string, width int, height int, pixels binary"), ["case"]).collect()}
    assert got["blank"].empty and got["blank"].area_ratio == 1 and abs(got["white"].x0 - 400) <= 8 and got["white"].area_ratio < 0.3


def test_annotation(spark):
    reply = '{"branches": [{"parent_length": 24100, "child_segments": [6000, 6000, 6000.0], "bbox": [10, 20, 30, 40], "index": 4}], "excluded": [{"value": 12.5, "mark": "P8"}], "verification": {"sum": 99}, "zero_len": 0}'
    walked = annotate.walk(spark.createDataFrame([(1, reply), (2, "bad"), (3, None)], "page int, response string"), ["page"])
    c = annotate.candidates(walked)
    assert [(r.value, r.role, r.mark) for r in c.orderBy("pos").collect()] == [(24100.0, "parent", None), (6000.0, "child", None), (6000.0, "child", None), (6000.0, "child", None), (12.5, "excluded", "P8")]
    items = spark.createDataFrame([(1, n, t, 10.0 * n, 5.0, 10.0 * n + 8, 9.0) for n, t in enumerate(["6000", "24 100", "6000", "x"], 1)], "page int, n int, text string, x0 double, y0 double, x1 double, y1 double")
    regions = annotate.text_regions(c, items, ["page"])
    rows = regions.orderBy("pos").collect()
    assert [(r.label, r.duplicated, r.missing) for r in rows] == [("24 100", False, False), ("6000", False, False), ("6000", False, False), ("6000", True, False), ("P8", False, True)]
    assert rows[0].x0 == 18.0 and rows[0].y0 == 3.0
    s = annotate.stats(regions, ["page"]).first()
    assert (s.total, s.found, s.missing, s.duplicated, s.parent, s.child, s.excluded, s.missing_values) == (5, 4, 1, 1, 1, 3, 0, ["12.5"])
    titled = annotate.sheet_title(annotate.stats(regions, ["page"]).withColumn("has_text", F.lit(False)), "page").first()
    assert titled.title == "Лист 1 · размечено 4 из 5 · повторов на листе не хватило: 1 · нет на листе: 1 · текстовый слой PDF пуст — размечено по bbox модели"
    assert annotate.dedupe(regions, ["page"]).count() == 3
    boxes = annotate.model_regions(walked, spark.createDataFrame([(1, 25, 100)], "page int, width int, height int"), ["page"]).collect()
    assert [(b.kind, b.x0, b.x1) for b in boxes] == [("branch", 10.0, 25.0)]
    model = annotate.model_regions(walked, spark.createDataFrame([(1, 25, 100)], "page int, width int, height int"), ["page"])
    assert {r.origin for r in annotate.regions(regions, model, items, ["page"]).collect()} == {"pdf_text"}
    assert [r.origin for r in annotate.regions(regions.limit(0), model, items.limit(0), ["page"]).collect()] == ["model"]
    deep = {"k": [{"a": [{"b": 1}], "c": {"d": {}}}, 5, {"e": 2}]}
    assert [(sorted(n), c) for n, c in annotate.nodes(deep)] == [(["k"], ""), (["a", "c"], "k"), (["b"], "a"), (["d"], "c"), ([], "d"), (["e"], "k")]


def test_sequences(spark):
    by = ["p"]
    df = spark.createDataFrame([(1, i) for i in range(10)] + [(2, i) for i in range(2)], "p int, i int")
    got = sequence.systematic_sample(df, by, [F.col("i")], 4).orderBy("p", "i").collect()
    assert [r.i for r in got] == [int(k * 10 / 4) for k in range(4)] + [0, 1]
    spans = spark.createDataFrame([(1, t, x, y, x + 8, y + 8.0) for t, x, y in [("B", 100.0, 0.02), ("X", 0.0, 0.0), ("78500", 9.0, 0.01), ("Y", 50.0, 0.0), ("Z", 9.0, 30.0)]], "p int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r.text for r in sequence.group_spans(spans, by).orderBy("n").collect()] == ["X 78500", "Y", "B", "Z"]
    words = spans.withColumnRenamed("text", "word")
    assert [r.text for r in sequence.cluster_lines(words, by, 3.0).orderBy("line").collect()] == ["X 78500 Y B", "Z"]
    chars = spark.createDataFrame([(1, 8.0, [(c, float(i), 0.0, i + 1.0, 2.0) for i, c in enumerate(" ab c")])], "p int, font_size double, chars array<struct<c:string,x0:double,y0:double,x1:double,y1:double>>")
    assert [(r.text, r.x0, r.x1) for r in sequence.tokens_of_spans(chars, by).orderBy("x0").collect()] == [("ab", 1.0, 3.0), ("c", 4.0, 5.0)]
    assert sequence.page_range("3-1, 7", 9) == [1, 2, 3, 7] and sequence.page_range("all", 2) == [1, 2] and sequence.page_range("2,1,2", 3, True) == [2, 1, 2]
    with pytest.raises(ValueError):
        sequence.page_range("4", 3)


def test_grid_join_is_the_plain_join(spark):
    rng = random.Random(3)
    points = spark.createDataFrame([(1, i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(120)], "p int, i int, px double, py double")
    boxes = spark.createDataFrame([(1, j, x, y, x + rng.uniform(0, 30), y + rng.uniform(0, 30)) for j in range(40) for x, y in [(rng.uniform(-50, 50), rng.uniform(-50, 50))]], "p int, j int, x0 double, y0 double, x1 double, y1 double")
    pairs = lambda t: sorted((r.i, r.j) for r in t.select("i", "j").collect())
    assert pairs(spatial.grid_join(points, boxes, ["p"], 13.0)) == pairs(spatial.points_in_boxes(points, boxes, ["p"])) != []


def test_regions_walk_replies_once(spark):
    """The replies go through Python once, not once for the forms and again for the rows."""
    walked = annotate.walk(spark.createDataFrame([(1, '{"length": 5}')], "page int, response string"), ["page"])
    items = spark.createDataFrame([(1, 1, "5", 1.0, 5.0, 9.0, 9.0)], "page int, n int, text string, x0 double, y0 double, x1 double, y1 double")
    regions = annotate.text_regions(annotate.candidates(walked), items, ["page"])
    assert regions._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert [(r.value, r.missing) for r in regions.collect()] == [(5.0, False)]


def test_detection_moves_rows_to_their_sheet_once(spark, sf_dir):
    """Strokes, tips, numbers and frames stay where their paths and words went."""
    from plumbline.plans import sheets

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sheets.detected_dimensions(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < plan.count("Exchange hashpartitioning") <= 20


def test_groups_of_a_union_are_whole(spark):
    """Parts of a union that joins have dealt by the same keys: each group comes whole, be the parts read as they may."""
    ids = spark.range(3000).select(F.lit("d").alias("doc_id"), (F.col("id") % 500).alias("page_number"), F.col("id").alias("v"))
    some = ids.groupBy("doc_id", "page_number").agg(F.max("v").alias("v"))
    rows = ids.repartition("doc_id", "page_number").unionAll(some).unionAll(ids.join(some.select("doc_id", "page_number"), ["doc_id", "page_number"]))
    got = sequence.each_group(rows, ["doc_id", "page_number"], ["v"], lambda held: [(len(held),)], "n int")
    assert "struct" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.page_number, r.n) for r in got.collect()) == [(i, 13) for i in range(500)]


def test_arrows_of_many_sheets_at_once(spark, monkeypatch):
    """Strokes with arrows by numpy over blocks of sheets are those of the joins; sheets are cut by batches anywhere."""
    from plumbline.operators import arrows

    rng = random.Random(8)
    item = "array<struct<kind:string,x0:double,y0:double,x1:double,y1:double>>"
    paths = []
    for page in range(12):
        spots = [(rng.choice((0.0, 20.0, 40.0)), rng.choice((0.0, 15.0, 30.0))) for _ in range(5)]
        for k in range(rng.choice((1, 9, 30))):
            (x, y), (u, v) = rng.choice(spots), rng.choice(spots)
            width, kind = rng.choice((0.5, 0.5, 0.9, None)), rng.choice(("l", "l", "re", "c"))
            head = [("l", x, y, x + 4, y + 1), ("l", x + 4, y + 1, x + 4, y - 1), ("l", x + 4, y - 1, x, y)]
            if rng.random() < 0.4:
                paths.append(("d", page, k, [0.0], 0.0, head if rng.random() < 0.8 else head[:2]))
            else:
                paths.append(("d", page, k, rng.choice((None, [])), width, rng.choice(([(kind, x, y, u, v)], [(kind, x, y, u, v), ("l", u, v, (x + u) / 2, (y + v) / 2)], [], None, [("l", x, y, None, v)]))))
    for k, (x, y) in enumerate([(0.0, 0.0), (40.0, 0.0), (20.0, 0.0)]):
        paths.append(("d", 12, k, [0.0], 0.0, [("l", x, y, x + 4, y + 1), ("l", x + 4, y + 1, x + 4, y - 1), ("l", x + 4, y - 1, x, y)]))
    paths += [("d", 12, 5, [], 0.5, [("l", 20.0, 15.0, 20.0, 0.0), ("l", 0.0, 0.0, 40.0, 0.0)])]
    df = spark.createDataFrame(paths, f"doc_id string, page_number int, path_id long, fill array<double>, stroke_width double, items {item}")
    values = {"width": 0.5, "width_tol": 0.05, "min_length": 12.0, "leader_min_length": 8.0, "arrow_gap": 0.2, "leader_anchor_gap": 2.5, "arrow_max_area": 30.0}
    limits = df.where("page_number <> 3").select("doc_id", "page_number").distinct().select("*", *(F.lit(v).alias(c) for c, v in values.items()))
    tips = polygons.path_tips(df.where(drawing.is_filled()), drawing.SHEET, drawing.strokes_of("items")).where("area <= 30")
    thin = drawing.strokes(df.where(~drawing.is_filled())).where("abs(stroke_width - 0.5) <= 0.05")
    spans, leaders = drawing.arrowed(thin, tips, limits)
    leaders = drawing.anchored(leaders, spans, limits)
    want = sorted([("span", r.page_number, r.path_id, r.ord, r.n, r.ax, r.ay, r.bx, r.by, None) for r in spans.collect()] + [("leader", r.page_number, None, None, r.n, r.ax, r.ay, r.bx, r.by, r.anchor) for r in leaders.collect()], key=str)
    assert {w[0] for w in want} == {"span", "leader"} and any(w[9] for w in want)
    for batch, pairs, join in (("10000", 1 << 19, "-1"), ("3", 2, "-1"), ("5", 7, "10MB")):
        monkeypatch.setattr(arrows, "PAIRS", pairs)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", join)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            rows = arrows.arrowed(df.repartition(3), limits, drawing.SHEET, drawing.is_filled()).select("*", F.inline("strokes")).drop("strokes").collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        got = sorted([(r.kind, r.page_number, *((r.path_id, r.ord) if r.kind == "span" else (None, None)), r.n, r.ax, r.ay, r.bx, r.by, r.anchor) for r in rows], key=str)
        assert got == want


def test_parts_of_pairs_are_all_pairs(monkeypatch):
    import numpy as np

    from plumbline.operators import arrows

    rng = np.random.default_rng(2)
    for most in (1, 4, 1000):
        monkeypatch.setattr(arrows, "PAIRS", most)
        count, first = rng.integers(0, 6, 30), rng.integers(0, 50, 30)
        got = [(int(a), int(b)) for i, j in arrows._pairs(first, count) for a, b in zip(i, j)]
        assert got == [(i, int(first[i]) + k) for i in range(30) for k in range(count[i])]
        assert all(len(i) <= max(most, 5) for i, _ in arrows._pairs(first, count))
