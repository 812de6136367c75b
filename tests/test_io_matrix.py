import zipfile

import pytest
from pyspark.sql import functions as F

from lintel.operators import changes as H
from lintel.operators import dedup as D
from lintel.operators import matrix as M
from lintel.operators import qa
from lintel.sources import io as IO


def test_registry_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"Mark": "D1", "Width": "3\'"}, {"Mark": "D2", "_schedule_type": "window"}]')
    (tmp_path / "b.json").write_text('{"instance_schedule": [], "data": [{"Mark": "D3"}]}')
    got = sorted((r["project_id"], r["row_no"], r["col_no"], r["header"], r["value"], r["schedule_type"]) for r in IO.read_registry(spark, str(tmp_path), "door").collect())
    assert got == [
        ("a", 0, 0, "Mark", "D1", "door"), ("a", 0, 1, "Width", "3'", "door"), ("a", 1, 0, "Mark", "D2", "window"), ("b", 0, 0, "Mark", "D3", "door"),
    ]


def test_loose_json(spark):
    texts = ['x ```json\n{"a": 1}\n``` y', 'pre {"a": 2} post', '{"a": 3}', "none", None, '{"a": ']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r["a"] for r in df.select(IO.parse_loose_json("t", "a INT")["a"].alias("a")).collect()] == [1, 2, 3, None, None, None]
    ok, bad = IO.quarantine(df, "t")
    assert {r["i"] for r in ok.collect()} == {0, 1, 2} and {r["i"] for r in bad.collect()} == {3, 4, 5}


def test_spec_corpus(spark, tmp_path):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p>{''.join(f'<w:r><w:t>{t}</w:t></w:r>' for t in runs)}</w:p>" for runs in (["Door ", "101A"], [" "], ["Exclude"]))
    with zipfile.ZipFile(tmp_path / "s.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    (tmp_path / "t.txt").write_bytes(b"one\ntw\xffo")
    got = sorted((r["path"].rsplit("/", 1)[1], r["para_no"], r["text"]) for r in IO.read_spec_corpus(spark, f"{tmp_path}/*").collect())
    assert got == [("s.docx", 0, "Door 101A"), ("s.docx", 1, "Exclude"), ("t.txt", 0, "one"), ("t.txt", 1, "two")]


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("P", "D1", 2)], "project_id string, mark string, qty int")
    paths = IO.write_takeoff({"door_schedule": df, "assumption_log": df}, str(tmp_path / "out"))
    assert spark.read.parquet(paths[0]).select(df.columns).collect() == df.collect()
    got = IO.read_takeoff(spark, str(tmp_path / "out"))
    assert set(got) == {"door_schedule", "assumption_log"} and got["door_schedule"].select(df.columns).collect() == df.collect()
    words = spark.createDataFrame([("P", "1", 0.0, 0.0, 1.0, 1.0, "a", 0, 0, 0)], IO.PAGE_WORD)
    words.write.json(str(tmp_path / "w.json"))
    assert IO.read_page_words(spark, str(tmp_path / "w.json")).collect() == words.collect()


def test_a_takeoff_is_written_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "out")
    frame = lambda *rows: spark.createDataFrame(rows, "project_id string, mark string, qty int")
    assert IO.read_takeoff(spark, path) == {}
    IO.write_takeoff({"door_schedule": frame(("007", "D1", 1)), "unit_door": frame(("P", "D2", 2))}, path)
    broken = frame(("P", "D3", 3)).withColumn("qty", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        IO.write_takeoff({"door_schedule": frame(("P", "D9", 9)), "unit_door": broken}, path)
    with pytest.raises(ValueError):
        IO.write_takeoff({"doors": broken}, path)
    seen = IO.read_takeoff(spark, path)
    assert [tuple(r) for r in seen["unit_door"].select("project_id", "mark", "qty").collect()] == [("P", "D2", 2)]
    IO.write_takeoff({"door_schedule": frame(("P", "D4", 4), ("Q", "D5", 5))}, path, "csv")
    seen = IO.read_takeoff(spark, path)
    assert set(seen) == {"door_schedule"} and sorted(r["mark"] for r in seen["door_schedule"].collect()) == ["D4", "D5"]


def test_page_readers(spark, tmp_path):
    paths = spark.createDataFrame([("P", "1", i, 0.0, 0.0, 1.0, float(i), i % 2 == 0, False, 0.5, None) for i in range(5)], IO.PAGE_PATH)
    paths.write.parquet(str(tmp_path / "paths"))
    assert sorted(map(tuple, IO.read_page_paths(spark, str(tmp_path / "paths")).collect()), key=str) == sorted(map(tuple, paths.collect()), key=str)
    det = spark.createDataFrame([("P", 1, "D1", 2, "Level 2", 0, 3, 1.5, 2.5, (0.0, 0.0, 1.0, 1.0), "Hall", "Interior", "SGL", "INT", "DRY", 4.0, False)], IO.DETECTION)
    det.write.json(str(tmp_path / "det.jsonl"))
    assert IO.read_detections(spark, str(tmp_path / "det.jsonl")).collect() == det.collect()


def test_upsert(spark):
    a = spark.createDataFrame([(1, "a", 1), (2, "b", 9)], "id int, v string, seq int")
    b = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, seq int")
    assert sorted((r["id"], r["v"]) for r in IO.upsert_latest(a, b, "id", "seq").collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_extended_doors_example(spark):
    units = spark.createDataFrame([("P", "Studio-S1", 12)], "project_id string, unit_type string, count int")
    per = spark.createDataFrame([("P", "Studio-S1", "A1", 1), ("P", "Studio-S1", "C1", 2)], "project_id string, unit_type string, tag string, per_unit int")
    got = {(r["unit_type"], r["tag"]): r["extended"] for r in M.extended_doors(units, per).collect()}
    assert got == {("Studio-S1", "A1"): 12, ("Studio-S1", "C1"): 24, ("Studio-S1", None): 36, (None, "A1"): 12, (None, "C1"): 24, (None, None): 36}


def test_layout_multipliers(spark):
    sheets = spark.createDataFrame(
        [("P", "A", "TYPE 2", "U6", "UNIT_TYPE_REPEATED", 1, 1), ("P", "A", "", "D", "TYPICAL_REPEATED", 3, 2), ("P", "A", "", "D", "SINGLE_FLOOR", 1, 5)],
        "project_id string, building string, unit_type string, type string, layout string, n_floors int, count int",
    )
    occ = spark.createDataFrame([("P", "A", "TYPE 2", n) for n in (0, 4, 6, 4)], "project_id string, building string, unit_type string, occurrences int")
    assert {r["type"]: r["total"] for r in M.expand_layout(sheets, matrix=occ).collect()} == {"U6": 14, "D": 11}
    assert {r["type"]: r["total"] for r in M.expand_layout(sheets).collect()} == {"U6": 1, "D": 11}


def test_subtotals_add_up(spark):
    df = spark.range(200).select(
        F.expr("'B' || id % 2").alias("building"), F.expr("'L' || id % 5").alias("floor"), F.expr("'S' || id % 4").alias("section"),
        F.expr("'D' || id % 17").alias("mark"), F.col("id").alias("qty"),
    )
    out = M.section_totals(df)
    sums = {r["level"]: r["s"] for r in out.groupBy("level").agg(F.sum("qty").alias("s")).collect()}
    assert set(sums.values()) == {199 * 100} and len(sums) == 5


def test_changes(spark):
    base = spark.createDataFrame([("P", 1, "w", "3"), ("P", 1, "h", "7"), ("P", 2, "w", "4")], "project_id string, row_id int, field string, value string")
    log = spark.createDataFrame(
        [("P", 1, "w", "5", 0, "set"), ("P", 1, "h", None, 1, "delete"), ("P", 2, None, None, 2, "delete"), ("P", 3, "w", "9", 3, "append"), ("P", 2, "w", "8", 4, "set")],
        "project_id string, row_id int, field string, value string, seq int, action string",
    )
    assert sorted((r["row_id"], r["field"], r["value"]) for r in H.apply_changes(base, log).collect()) == [(1, "w", "5"), (2, "w", "8"), (3, "w", "9")]


def test_bifurcate_by_location(spark):
    rows = spark.createDataFrame([("P", "A1"), ("P", "B1")], "project_id string, mark string")
    det = spark.createDataFrame([("P", "A1", "Interior"), ("P", "A1", "Exterior"), ("P", "B1", "Exterior")], "project_id string, mark string, int_ext string")
    assert sorted(r["mark"] for r in D.bifurcate_by(rows, det).collect()) == ["A1", "A1.L", "B1"]


def test_self_check(spark):
    det = spark.createDataFrame([("P", "1", "A"), ("P", "2", "B"), ("P", "3", "B")], "project_id string, det_id string, mark string")
    r = qa.self_check(det, det.where("det_id <> '3'")).first()
    assert (r["n_expected"], r["n_actual"], r["missing_marks"], r["passed"]) == (3, 2, "B", False)
