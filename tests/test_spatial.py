import math
import random

import pytest
from pyspark.sql import functions as F

from lintel.operators import spatial as S

BOX = "project_id string, page_id string, {} int, x0 double, y0 double, x1 double, y1 double, has_curve boolean, is_dashed boolean"


def boxes(spark, n, seed, name, span=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.uniform(-50, span), rng.uniform(-50, span)
        rows.append(("P", str(i % 2), i, x, y, x + rng.uniform(0, 40), y + rng.uniform(0, 40), i % 2 == 0, i % 5 == 0))
    return rows, spark.createDataFrame(rows, BOX.format(name))


def test_bbox_join_equals_brute_force(spark):
    a, da = boxes(spark, 60, 1, "a_id")
    b, db = boxes(spark, 60, 2, "b_id")
    got = sorted((r["a_id"], r["b_id"]) for r in S.bbox_join(da, db, pad=30, cell=50.0).collect())
    want = sorted(
        (p[2], q[2]) for p in a for q in b
        if p[1] == q[1] and p[3] - 30 < q[5] and q[3] < p[5] + 30 and p[4] - 30 < q[6] and q[4] < p[6] + 30
    )
    assert got == want and len(want) > 20


def points(spark, n, seed, span=60):
    rng = random.Random(seed)
    rows = [("P", "1", "D", i, float(rng.randint(0, span)), float(rng.randint(0, span)), -rng.randint(0, 4)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "project_id string, page_id string, mark string, row_id int, cx double, cy double, neg_arcs int")


def test_greedy_dedup_equals_brute_force(spark):
    rows, df = points(spark, 300, 5)
    kept = []
    for r in sorted(rows, key=lambda r: (r[6], r[3])):
        if not any(abs(k[4] - r[4]) < 8 and abs(k[5] - r[5]) < 8 for k in kept):
            kept.append(r)
    got = sorted(r["row_id"] for r in S.spatial_dedup(df, exact=True).collect())
    assert got == sorted(r[3] for r in kept)
    assert S.spatial_dedup(df.where("false"), exact=True).count() == 0


def test_leaf_groups_and_modes(spark):
    marks = spark.createDataFrame([("P", "1", i, "M", 100.0 * i, 0.0) for i in range(1, 6)], "project_id string, page_id string, mark_id int, mark string, cx double, cy double")

    def path(x, y, curve=True, dash=False, size=20.0):
        return ("P", "1", 0, x - size / 2, y - size / 2, x + size / 2, y + size / 2, curve, dash)

    rows = [
        path(120.0, 0.0), path(200.0, 45.0), path(200.0, -45.0), path(300.0, 30.0, False, True), path(400.0, 0.0, size=10.0),
        path(460.0, 20.0, False, True, 100.0),
    ]
    paths = spark.createDataFrame(rows, BOX.format("path_id"))
    got = {r["mark_id"]: r["opening_mode"] for r in S.mode_from_paths(marks, paths).collect()}
    assert got == {1: "SGL", 2: "PR", 3: "DA", 4: "SGL", 5: "SGL"}
    facts = spark.createDataFrame([("P", "M", "CO")], "project_id string, mark string, fact_mode string")
    assert {r["opening_mode"] for r in S.mode_from_paths(marks, paths, facts).collect()} == {"CO"}


def test_nearest_1d_ties_and_hot_key(spark):
    rng = random.Random(9)
    anchors = [("P", "1", a, float(rng.randint(0, 400))) for a in range(40)]
    pts = [("P", "1", i, float(rng.randint(-20, 420))) for i in range(300)]
    da = spark.createDataFrame(anchors, "project_id string, page_id string, anchor_id int, pos double")
    dp = spark.createDataFrame(pts, "project_id string, page_id string, id int, pos double")
    got = {r["id"]: r["anchor_id"] for r in S.nearest_1d(dp, da, most=16).collect()}
    for _, _, i, pos in pts:
        assert got[i] == min(anchors, key=lambda a: (abs(a[3] - pos), a[3], a[2]))[2]


def test_segment_zones(spark):
    segs = spark.createDataFrame([("P", "1", 0.0, 0.0, 1000.0, 1000.0)], "project_id string, page_id string, x0 double, y0 double, x1 double, y1 double")
    pts = spark.createDataFrame([("P", "1", 1, 500.0, 510.0), ("P", "1", 2, 500.0, 600.0), ("P", "1", 3, 0.0, 900.0), ("P", "2", 4, 0.0, 0.0)], "project_id string, page_id string, point_id int, cx double, cy double")
    got = {r["point_id"]: (None if r["dist"] is None else round(r["dist"], 3), r["zone"]) for r in S.nearest_segment(pts, segs).collect()}
    assert got == {1: (7.071, "perimeter"), 2: (70.711, "borderline"), 3: (636.396, "inside"), 4: (None, "borderline")}


def test_labels_and_circles(spark):
    words = spark.createDataFrame([("P", "1", 0, "101"), ("P", "1", 0, "Lobby,"), ("P", "1", 1, "D5")], "project_id string, page_id string, block int, text string")
    assert [r["text"] for r in S.drop_labelled_blocks(words).collect()] == ["D5"]
    df = spark.createDataFrame([("P", "1", "A", True), ("P", "1", "A", False), ("P", "1", "B", False)], "project_id string, page_id string, mark string, in_circle boolean")
    assert sorted((r["mark"], r["in_circle"]) for r in S.prefer_if_any(df).collect()) == [("A", True), ("B", False)]


def _apart(p, s):
    dx, dy = s[2] - s[0], s[3] - s[1]
    n = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((p[0] - s[0]) * dx + (p[1] - s[1]) * dy) / n)) if n else 0.0
    return math.hypot(p[0] - s[0] - t * dx, p[1] - s[1] - t * dy)


def test_nearest_segment_far_and_near_on_a_crowded_page(spark):
    rng = random.Random(5)
    segs = [("P", "1", x, y, x + rng.uniform(-200, 200), y + rng.choice([0.0, rng.uniform(-900, 900)])) for x, y in ((rng.gauss(0, 4000), rng.gauss(0, 4000)) for _ in range(300))]
    segs += [("P", "2", 0.0, 0.0, 10.0, 0.0), ("P", "3", 1e12, 1e12, 1e12, 1e12)] + [("P", "3", float(-i), 0.0, float(-i), 5.0) for i in range(40)]
    pts = [("P", rng.choice("1112"), i, rng.choice([rng.gauss(0, 3000), rng.uniform(-60000, 60000)]), rng.gauss(0, 9000)) for i in range(250)]
    pts += [("P", "3", 900, 9e11, 9e11), ("P", "3", 901, -20.2, 2.0), ("P", "4", 902, 0.0, 0.0)]
    df = spark.createDataFrame(segs, "project_id string, page_id string, x0 double, y0 double, x1 double, y1 double")
    dp = spark.createDataFrame(pts, "project_id string, page_id string, point_id int, cx double, cy double")
    got = {r["point_id"]: r["dist"] for r in S.nearest_segment(dp, df).collect()}
    for _, page, i, x, y in pts:
        want = min((_apart((x, y), s[2:]) for s in segs if s[1] == page), default=None)
        assert got[i] == pytest.approx(want, rel=1e-9) if want is not None else got[i] is None


def test_walls_of_a_crowded_page_meet_few_segments(spark):
    rng = random.Random(6)
    box = "project_id string, page_id string, x0 double, y0 double, x1 double, y1 double"
    line = lambda: (lambda x, y: (x, y, x + rng.uniform(-30, 30), y + rng.uniform(-30, 30)))(rng.uniform(0, 20000), rng.uniform(0, 20000))
    walls, segs = [("P", "1", *line()) for _ in range(10000)], [("P", "1", *line()) for _ in range(2000)]
    w = spark.createDataFrame(walls, box).select("project_id", "page_id", *[F.col(c).alias(f"w{c}") for c in S.BOX])
    s = spark.createDataFrame(segs, box).select("project_id", "page_id", *[F.col(c).alias(f"s{c}") for c in S.BOX])
    key = ["project_id", "page_id"]
    off = {tuple(r)[2:6]: r["_off"] for r in S.wall_offsets(w, s, 40.0, key).collect()}
    assert len(off) == 10000

    def cross(a, b):
        side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        return side(a[:2], a[2:], b[:2]) * side(a[:2], a[2:], b[2:]) < 0 and side(b[:2], b[2:], a[:2]) * side(b[:2], b[2:], a[2:]) < 0

    for wall in rng.sample(walls, 60):
        a = wall[2:]
        want = min(0.0 if cross(a, b[2:]) else min(_apart(a[:2], b[2:]), _apart(a[2:], b[2:]), _apart(b[2:4], a), _apart(b[4:], a)) for b in segs)
        assert off[a] == pytest.approx(want, abs=1e-9)
    # what a wall is compared with: the segments of one cell of a level that reaches twice its distance and half its length
    reached = 40 * S.WIDER**3
    assert 2 * max(off.values()) + 30 < reached
    held = S._pyramid(s, 40.0, key).where("_level <= 3").groupBy("_level", "_cell").count().agg(F.max("count")).first()[0]
    assert held < 200


def test_leaf_groups_join_through_any_chain(spark):
    rng = random.Random(8)
    rows = [("P", "1", m, rng.uniform(0, 200), rng.uniform(0, 200)) for m in range(40) for _ in range(rng.randint(1, 14))]
    df = spark.createDataFrame(rows, "project_id string, page_id string, mark_id int, cx double, cy double")
    got = {r["mark_id"]: r["leaf_groups"] for r in S.leaf_groups(df).collect()}
    for m in range(40):
        pts, n = [r[3:] for r in rows if r[2] == m], 0
        while pts:
            n, front = n + 1, [pts.pop()]
            while front:
                p = front.pop()
                near = [q for q in pts if math.dist(p, q) < 45]
                pts = [q for q in pts if math.dist(p, q) >= 45]
                front += near
        assert got[m] == n
