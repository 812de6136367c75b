import re

from pyspark.sql import functions as F

from lintel.operators import reconcile as R
from lintel.operators.dedup import bifurcate
from lintel.operators.reconcile import reconcile
from lintel.operators.takeoff import takeoff_run
from tests.fixtures import MODE_CASES, cells, detections


def run(spark, rows, dets, kind="door", **extra):
    c, d = cells(spark, rows, kind=kind), detections(spark, dets)
    return reconcile({"cells": c, "detections": d, "ocr": d.select("project_id", "mark"), **extra})


def test_opening_modes(spark):
    out = run(spark, [(m, f) for m, f, _, _ in MODE_CASES], [(m, 1, mode, "INT", "INT") for m, _, mode, _ in MODE_CASES])
    got = {r["mark"]: r for r in out["doors"].collect()}
    assert len(got) == len(MODE_CASES)
    for mark, _, _, expected in MODE_CASES:
        mode = got[mark]["reconciled_mode"]
        assert (mode != "DA") if expected is None else (mode == expected), (mark, mode)
    conflicts = {r["mark"] for r in out["queue"].where("type = 'opening_mode_conflict'").collect()}
    assert "100A" in conflicts and "300-03" not in conflicts
    assert got["100A"]["needs_review"] and got["100A"]["status"] == "CONFLICT"


def test_queue_kinds(spark):
    c = cells(spark, [("D1", {"door material": "WD"}), ("D2", {"door material": "ALUMINUM"})])
    d = detections(spark, [("D1", 1, "SGL", "INT", "DRY"), ("X9", 1, "SGL", "INT", "DRY")])
    ocr = spark.createDataFrame([("P", "d1")], "project_id string, mark string")
    excl = spark.createDataFrame([("P", "Aluminium doors"), ("P", "Wood trim")], "project_id string, exclusion string")
    out = reconcile({"cells": c, "detections": d, "ocr": ocr, "exclusions": excl})
    kinds = sorted((r["type"], r["mark"]) for r in out["queue"].collect())
    assert kinds == [
        ("aluminium_exclusion_flag", "D2"), ("mark_not_located", "D2"), ("missing_from_plan", "D2"),
        ("ocr_cv_mismatch", "X9"), ("orphan_plan_mark", "X9"),
    ]
    log = [r["id"] for r in out["log"].orderBy("id").collect()]
    assert log == [f"A-{i:03d}" for i in range(1, 6)]
    gates = {r["gate"]: r["status"] for r in out["gates"].collect()}
    assert gates["gate1_schedule_reconciliation"] == "REVIEW_REQUIRED"
    assert gates["gate3_unit_door_matrix"] == "NOT_APPLICABLE"
    d2 = out["doors"].where("mark = 'D2'").first()
    assert d2["qty"] == 0 and d2["is_borderline"] and d2["review_reason"] == "mark_not_located_on_drawing"


def test_wall_bifurcation_and_floors(spark):
    dets = [("X1", 2, "SGL", "INT", "DRY"), ("X1", 1, "SGL", "INT", "cmu"), ("X1", 1, "SGL", "INT", "CONCRETE"), ("X1", 3, "SGL", "INT", "UNKNOWN")]
    out = run(spark, [("X1", {"door material": "WD"})], dets)
    doors = {r["mark"]: r for r in out["doors"].collect()}
    assert {m: r["wall_variant"] for m, r in doors.items()} == {"X1.1": "CMU", "X1.2": "CONCRETE", "X1.3": "DRY"}
    assert all(r["original_tag"] == "X1" and r["takeoff_notes"] == "Door Bifurcated on basis of wall type" for r in doors.values())
    assert doors["X1.1"]["FLOOR / LEVEL"] == "Level 1, Level 2, Level 3"
    log = out["log"].orderBy("id").collect()
    assert [r["item"] for r in log] == ["X1.1", "X1.2", "X1.3"] and log[0]["action"] == "CALCULATED"


def test_buckets(spark):
    rows = [
        ("D1", {"comments": "OPERABLE WALL"}), ("D2", {"door material": "WD", "comments": "near GARAGE"}),
        ("D3", {"door material": "WD", "comments": "transom above"}), ("D4", {"door material": "WD", "int/ext": "EXT"}),
        ("D5", {"door material": "WD", "comments": "x"}), ("D6", {"door material": "GL"}), ("D7", {"door material": "HM", "frame": "FRM-00AL(CW)"}),
    ]
    out = run(spark, rows, [(m, 1, "UNKNOWN", "INT", "DRY") for m, _ in rows])
    got = {r["mark"]: r["bucket"] for r in out["doors"].collect()}
    assert got == {"D1": "Not in Scope", "D2": "Soft Exterior", "D3": "Window", "D4": "Exterior", "D5": "Interior", "D6": "Not in Scope", "D7": "Exterior"}


def test_windows_keep_their_bucket(spark):
    out = run(spark, [("W1", {"glazing": "x"})], [("W1", 1, "SGL", "INT", "DRY")], kind="window")
    w = out["windows"].first()
    assert (w["bucket"], w["reconciled_mode"], w["reconciled_int_ext"]) == ("Window", "STOREFRONT", "Window")
    assert out["doors"].count() == 0


def test_spec_sentence_makes_storefront(spark):
    text = "General notes.\nDoors 101A, 102B are storefront by others. Door 103 is wood"
    spec = spark.createDataFrame([("P", text)], "project_id string, text string")
    rows = [(m, {"door material": "HM"}) for m in ("101A", "102B", "103")]
    out = run(spark, rows, [(m, 1, "SGL", "INT", "DRY") for m, _ in rows], spec_text=spec)
    got = {r["mark"]: r["bucket"] for r in out["doors"].collect()}
    assert got == {"101A": "Not in Scope", "102B": "Not in Scope", "103": "Interior"}


def test_unit_matrix(spark):
    mix = spark.createDataFrame([("P", "S1", 12)], "project_id string, unit_type string, count int")
    given = spark.createDataFrame([("P", "S1", "C1", 2)], "project_id string, unit_type string, tag string, per_unit int")
    out = run(spark, [("A1", {"door material": "WD"}), ("C1", {"door material": "WD"})], [("A1", 1, "SGL", "INT", "DRY"), ("C1", 1, "SGL", "INT", "DRY")], unit_mix=mix, unit_door_input=given)
    got = {r["tag"]: (r["extended"], r["basis"]) for r in out["matrix"].collect()}
    assert got == {"A1": (12, "INFERRED"), "C1": (24, "CALCULATED")}
    assert {r["gate"]: r["status"] for r in out["gates"].collect()}["gate5_spot_checks"] == "PASSED"


def test_empty_and_order_independent(spark):
    empty = run(spark, [("D1", {"a": "b"})], [("D1", 1, "SGL", "INT", "DRY")])
    tables = {k: v.where("false") for k, v in empty.tables.items()}
    out = reconcile(tables)
    assert all(out[n].count() == 0 for n in out)

    rows = [(m, f) for m, f, _, _ in MODE_CASES]
    dets = [(m, i % 3 + 1, mode, "INT", ("DRY", "CMU")[i % 2]) for m, _, mode, _ in MODE_CASES for i in range(4)]
    a = run(spark, rows, dets)
    b = reconcile({k: v.repartition(7, F.rand(1)) for k, v in a.tables.items()})
    for name in a:
        key = lambda df: sorted(str(r) for r in df.select(sorted(df.columns)).collect())
        assert key(a[name]) == key(b[name]), name


def test_no_mark_lost(spark):
    rows = [(f"D{i}", {"door material": "WD"}) for i in range(40)]
    dets = [(f"D{i % 30}", i % 4 + 1, "SGL", "INT", ("DRY", "CMU", "CONCRETE")[i % 3]) for i in range(200)]
    doors = run(spark, rows, dets)["doors"]
    back = {r["m"] for r in doors.select(F.coalesce("original_tag", "mark").alias("m")).collect()}
    assert back == {m for m, _ in rows}


def test_the_log_builds_rows_and_facts_once(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(R, "checkpoint", lambda df: stored.append(df.columns) or df.checkpoint())
    rows = [("D1", {"door material": "WD"}), ("D2", {"door material": "HM"})]
    dets = [("D1", 1, "SGL", "INT", "DRY"), ("D1", 1, "SGL", "INT", "CMU"), ("X9", 1, "SGL", "INT", "DRY"), ("", 1, "SGL", "INT", "DRY")]
    out = run(spark, rows, dets)
    plan = out["log"]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # its lines are stored, not built again to be numbered
    assert len(stored) == 4 and ["project_id", "mark", "qty", "plan_mode", "plan_wall", "plan_reason", "plan_floors"] in stored
    got = [(r["item"], r["action"]) for r in out["log"].orderBy("id").collect()]
    assert got == [("D1.1", "CALCULATED"), ("D1.2", "CALCULATED"), ("D2", "VERIFY"), ("D2", "VERIFY"), ("X9", "VERIFY")]


def test_takeoff_stores_its_doors_for_all_that_is_written(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(R, "checkpoint", lambda df: stored.append(df.columns) or df.checkpoint())
    c = cells(spark, [("D1", {"door material": "WD"})])
    d = detections(spark, [("D1", 1, "SGL", "INT", "DRY"), ("D1", 2, "SGL", "INT", "CMU")])
    taken = takeoff_run({"cells": c, "detections": d, "ocr": d.select("project_id", "mark")})
    out = taken.outputs()
    assert sum("is_bifurcated" in cols for cols in stored) == 1
    assert sorted(r["NUMBER"] for r in out["door_schedule"].collect()) == ["D1.1", "D1.2"]
    assert out["assumption_log"].count() == 2


def test_wall_types_are_made_distinct_before_they_are_listed(spark):
    d = detections(spark, [("D1", 1, "SGL", "INT", w) for w in ("dry", "CMU ", "DRY", "UNKNOWN", "", None)] + [("D2", 1, "SGL", "INT", "DRY")])
    rows = spark.createDataFrame([("P", "D1"), ("P", "D2"), ("P", "D3")], "project_id string, mark string")
    made = bifurcate(rows, d)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and re.search(r"(?<!Object)HashAggregate\(keys=\[[^\]]*_v#", plan)
    assert sorted((r["mark"], r["wall_variant"]) for r in made.collect()) == [("D1.1", "CMU"), ("D1.2", "DRY"), ("D2", None), ("D3", None)]
