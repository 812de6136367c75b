"""Rows of two tables, totals without a building, and distances beyond the bands."""

import math

from lintel.operators import matrix as M
from lintel.operators import spatial as S
from lintel.operators.reconcile import reconcile
from lintel.sources import io as IO
from tests.fixtures import CELL, cells, detections


def test_equal_row_numbers_in_two_tables(spark):
    doors = cells(spark, [("D1", {"door material": "WD"}), ("D2", {"door material": "HM"})], table="doors")
    windows = cells(spark, [("W1", {"window type": "A"})], kind="window", table="windows")
    out = reconcile({"cells": doors.union(windows), "detections": detections(spark, [("D1", 1, "SGL", "INT", "DRY")]), "ocr": spark.createDataFrame([("P", "D1")], "project_id string, mark string")})
    assert sorted(r["mark"] for r in out["doors"].collect()) == ["D1", "D2"]
    assert [r["mark"] for r in out["windows"].collect()] == ["W1"]


def test_registry_files_of_one_project(spark, tmp_path):
    (tmp_path / "tower--doors.json").write_text('[{"Mark": "D1"}]')
    (tmp_path / "tower--windows.json").write_text('[{"Mark": "W1", "_schedule_type": "window"}]')
    got = sorted((r["project_id"], r["table_id"], r["row_no"], r["value"], r["schedule_type"]) for r in IO.read_registry(spark, str(tmp_path), "door").collect())
    assert got == [("tower", "doors", 0, "D1", "door"), ("tower", "windows", 0, "W1", "window")]


def test_audit_pass_flags_the_door(spark):
    c = cells(spark, [("D1", {"door material": "WD"}), ("D2", {"door material": "WD"})])
    d = detections(spark, [("D1", 1, "SGL", "INT", "DRY"), ("D2", 1, "SGL", "INT", "DRY")])
    audit = spark.createDataFrame([("P", "D-1")], "project_id string, mark string")
    got = {r["mark"]: (r["needs_review"], r["status"]) for r in reconcile({"cells": c, "detections": d, "ocr": d.select("project_id", "mark"), "audit": audit})["doors"].collect()}
    assert got == {"D1": (False, "VERIFIED"), "D2": (True, "VERIFY")}


def test_units_without_a_building_are_counted(spark):
    df = spark.createDataFrame([("B1", "A", "1", 2), (None, "A", "1", 5)], "building string, unit_type string, floor string, count int")
    got = {(r["building"], r["unit_type"], r["floor"], r["level"]): r["n_units"] for r in M.unit_count(df).collect()}
    assert got[(None, "A", "1", 0)] == 5 and got[(None, None, None, 3)] == 5 and got[(None, None, None, 7)] == 7
    assert got[("B1", None, None, 3)] == 2


def test_distance_to_a_far_boundary_and_host_wall(spark):
    key = "project_id string, page_id string, "
    pts = spark.createDataFrame([("P", "s", 1, 500.0, 400.0), ("P", "s", 2, 10.0, 50.0), ("P", "none", 3, 0.0, 0.0)], key + "point_id int, cx double, cy double")
    segs = spark.createDataFrame([("P", "s", 0.0, 0.0, 0.0, 1000.0), ("P", "s", 0.0, 0.0, 1000.0, 0.0)], key + "x0 double, y0 double, x1 double, y1 double")
    dist = S.nearest_segment(pts, segs)
    got = {r["point_id"]: (r["dist"], r["zone"]) for r in dist.collect()}
    assert got == {1: (400.0, "inside"), 2: (10.0, "perimeter"), 3: (None, "borderline")}
    walls = spark.createDataFrame([("P", "s", 450.0, 300.0, 450.0, 500.0), ("P", "s", 480.0, 350.0, 480.0, 420.0), ("P", "s", -5.0, 40.0, 30.0, 40.0)], key + "x0 double, y0 double, x1 double, y1 double")
    host = {r["point_id"]: r["host_dist"] for r in S.host_distance(pts, walls, segs, dist).collect()}
    assert host == {1: 300.0, 2: 0.0, 3: None} and math.isfinite(host[1])
