"""How steps are dealt to tasks: what must not pass through the driver, or gather in the task that reads a small file."""

import random

import pytest
from pyspark.sql import functions as F

from lintel.operators import cells as C
from lintel.operators import scan
from lintel.operators import spatial as S
from lintel.sources import io as IO
from tests import fixtures as CASES

PATH = "project_id string, page_id string, b_id int, x0 double, y0 double, x1 double, y1 double, has_curve boolean, is_dashed boolean"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def drawn(spark, tmp_path):
    made = spark.createDataFrame([("P", "1", i, 3.0 * i, 2.0 * i, 3.0 * i + 10, 2.0 * i + 20, i % 2 == 0, i % 3 == 0) for i in range(20)], PATH)
    made.write.parquet(f"{tmp_path}/paths")
    paths = spark.read.parquet(f"{tmp_path}/paths")
    marks = S.path_centres(paths).select("project_id", "page_id", F.col("b_id").alias("mark_id"), "cx", "cy")
    return marks, paths


def test_no_side_of_a_geometry_join_passes_through_the_driver(drawn):
    marks, paths = drawn
    boxes = S.bbox_join(paths.withColumnRenamed("b_id", "a_id"), paths)
    pairs = S.radius_join(marks, marks, 50.0)
    modes = S.mode_from_paths(marks, paths)
    for made in (boxes, pairs, S.leaf_groups(S.arcs_near(marks, paths)), modes, S.path_count(marks, paths), S.in_tag_circle(marks, paths)):
        assert "Broadcast" not in plan(made)
        assert made.count() > 0


def test_cells_reach_their_row_before_they_are_aggregated(spark):
    cells = CASES.cells(spark, [("D1", {"material": "WD", "location": "Lobby"}), ("D2", {"material": "HM"})])
    grid = IO.cells_to_rows(cells, "row_no", "col_no", "value", range(3), ("project_id", "table_id"))
    for made in (C.resolve_mark(cells), C.resolve_location(cells), C.row_opening_mode(cells), C.row_features(cells), C.role_columns(cells), grid):
        text = plan(made)
        assert "REPARTITION" in text and text.count("Exchange") == 1
        assert made.count() == 2


def test_dedup_sends_a_point_to_few_squares(spark):
    rng = random.Random(9)
    rows = [("P", rng.choice("12"), "A", i, rng.choice([rng.uniform(-150, 150), float(rng.randint(-20, 20))]), rng.uniform(-150, 150), rng.randint(-4, 0)) for i in range(600)]
    rows += [("P", "1", "A", 1000, None, 5.0, 0), ("P", None, "A", 1001, 5.0, 5.0, 0)]
    df = spark.createDataFrame(rows, "project_id string, page_id string, mark string, row_id int, cx double, cy double, neg_arcs int")
    got = sorted(r["row_id"] for r in S.spatial_dedup(df).collect())
    told = [r for r in rows if r[1] is not None and r[4] is not None]
    near = lambda a, b: a[1] == b[1] and abs(a[4] - b[4]) < 8 and abs(a[5] - b[5]) < 8
    assert got == [a[3] for a in told if not any(near(a, b) and (b[6], b[3]) < (a[6], a[3]) for b in told)]
    spread = spark.range(1).select(F.struct(F.lit(3).alias("cx"), F.lit(-8).alias("cy")).alias("c"))
    assert spread.select(F.size(S._squares(F.col("c"), 1))).first()[0] == 2  # inside but for one side
    assert plan(S.spatial_dedup(df)).count("Generate") == 1


def test_words_are_not_sorted_to_leave_out_labelled_blocks(spark):
    words = spark.createDataFrame([("P", "1", 0, "101"), ("P", "1", 0, "Lobby,"), ("P", "1", 1, "D5"), ("P", None, 2, "D6")], "project_id string, page_id string, block int, text string")
    made = S.drop_labelled_blocks(words)
    assert "Sort" not in plan(made)
    assert sorted(r["text"] for r in made.collect()) == ["D5", "D6"]


def test_fine_keys_are_counted_in_buckets(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 400 or None, float(i)) for i in range(4000)] + [(7, float(i)) for i in range(300)], "k int, x double")
    assert scan._held_by_full_buckets(rows, ["k"], 1000) is None
    assert {r["k"] for r in scan._held_by_full_buckets(rows, ["k"], 100).select("k").distinct().collect()} == {7}
    want = {(k, x): n for k in [None, *range(1, 400)] for n, x in enumerate(sorted([float(i) for i in range(4000) if (i % 400 or None) == k] + [float(i) for i in range(300) if k == 7]), 1)}
    for buckets, named in ((1 << 16, 1000), (3, 1000), (1 << 16, 0)):  # keys that share a bucket, more full buckets than are named
        monkeypatch.setattr(scan, "BUCKETS", buckets)
        monkeypatch.setattr(scan, "NAMED", named)
        assert [r["_on_k"] for r in scan.splitters(rows, ["k"], "x", 100).collect()] == [7]
        got = scan.ordered_scan(rows.dropDuplicates(), ["k"], ["x"], "x", 100, n=("row_number", None)).collect()
        assert all(r["n"] <= want[(r["k"], r["x"])] for r in got) and len(got) == len({(r["k"], r["x"]) for r in got})


def test_a_place_stays_one_row_beside_the_few_segments_of_its_page(spark):
    box = "project_id string, page_id string, sx0 double, sy0 double, sx1 double, sy1 double"
    segs = spark.createDataFrame([("P", "1", 0.0, 0.0, 10.0, 0.0), ("P", "1", 0.0, 20.0, 10.0, 20.0), ("P", "2", 5.0, 5.0, 5.0, 5.0), ("P", "2", None, 5.0, 5.0, 5.0)], box)
    spots = spark.createDataFrame([("P", "1", 5.0, 4.0), ("P", "1", 13.0, 16.0), ("P", "2", 5.0, 9.0), ("P", "3", 0.0, 0.0)], "project_id string, page_id string, cx double, cy double")
    found = S._far_nearest(spots, segs, 85.0, ["project_id", "page_id"])
    assert sorted((r["page_id"], r["cx"], r["dist"]) for r in found.collect()) == [("1", 5.0, 4.0), ("1", 13.0, 5.0), ("2", 5.0, 4.0)]
    grouped = [g for g in plan(found).splitlines() if "Aggregate(key" in g and "collect" not in g and "cx#" in g.split("functions=")[0] and "_level" not in g]
    assert len(grouped) == 2  # the places beyond few segments, half and whole, and no others
