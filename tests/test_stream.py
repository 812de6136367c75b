import random
from datetime import datetime, timedelta

from lintel.operators import qa
from lintel.streaming import stream as ST

T0 = datetime(2024, 1, 1)
EVENT = "user_id bigint, event_id bigint, ts timestamp"


def events(spark, rows):
    return spark.createDataFrame([(u, i, T0 + timedelta(seconds=s)) for i, (u, s) in enumerate(rows)], EVENT)


def brute(rows, limit, seconds):
    out, log = {}, {}
    for i, (u, s) in sorted(enumerate(rows), key=lambda e: (e[1][0], e[1][1], e[0])):
        kept = [t for t in log.get(u, []) if s - t < seconds]
        out[i] = len(kept) < limit
        log[u] = kept + [s] if out[i] else kept
    return out


def test_limiter_example(spark):
    got = {r["event_id"]: r["admitted"] for r in ST.admit_batch(events(spark, [(1, 0), (1, 10), (1, 20), (1, 61)]), limit=2, seconds=60).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True}


def test_limiter_batch_equals_brute_force(spark):
    rng = random.Random(11)
    rows = [(1 if rng.random() < 0.5 else rng.randint(2, 5), rng.choice([rng.randint(0, 20000), rng.randint(0, 400)])) for _ in range(900)]
    for limit, seconds in ((3, 60), (1, 30), (10, 200)):
        got = {r["event_id"]: r["admitted"] for r in ST.admit_batch(events(spark, rows), limit=limit, seconds=seconds).collect()}
        assert got == brute(rows, limit, seconds)


def run_stream(spark, query, name, mode):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ST.ROCKSDB)
    h = q.start()
    h.awaitTermination(120)
    assert h.exception() is None
    return spark.table(name)


def test_limiter_stream(spark, tmp_path):
    rows = [(u, s) for s in range(0, 300, 7) for u in (1, 2)]
    df = events(spark, rows)
    for n, part in enumerate((df.where("event_id < 40"), df.where("event_id >= 40"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["event_id"]: r["admitted"] for r in run_stream(spark, ST.admit(src, limit=4, seconds=60), "admitted_rows", "append").collect()}
    assert got == brute(rows, 4, 60)


def test_progress_stream(spark, tmp_path):
    rows = [("a", T0, "schedule_parser_node", None), ("a", T0 + timedelta(1), "excel_writer_node", None), ("b", T0, "human_node", "paused_qa"), ("c", T0, "x", "failed")]
    df = spark.createDataFrame(rows, "session_id string, ts timestamp, node string, status string")
    df.write.parquet(str(tmp_path / "p"))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "p"))
    got = {r["session_id"]: (r["step"], r["progress"], r["status"], r["ended"]) for r in run_stream(spark, ST.track_progress(src), "progress_rows", "update").collect()}
    assert got == {"a": ("completed", 100, "completed", True), "b": ("human_node", 0, "paused_qa", False), "c": ("x", 0, "failed", True)}


def test_review_loop(spark, tmp_path):
    queue = spark.createDataFrame([(f"i{n}", "P", "orphan_plan_mark") for n in range(3)], "item_id string, project_id string, type string")
    queue.write.parquet(str(tmp_path / "q/items"))
    dec = spark.createDataFrame([("i0", "keep", 1), ("i0", "drop", 2), ("i2", "keep", 1)], "item_id string, decision string, seq bigint")
    dec.write.parquet(str(tmp_path / "d"))
    src = spark.readStream.schema(dec.schema).parquet(str(tmp_path / "d"))
    assert ST.open_queue(spark, str(tmp_path / "q")).count() == 3
    h = ST.review_loop(src, str(tmp_path / "q"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    h.awaitTermination(120)
    left = ST.open_queue(spark, str(tmp_path / "q"))
    assert [r["item_id"] for r in left.collect()] == ["i1"]
    assert {r["item_id"]: r["decision"] for r in ST.review_step(queue, dec)[1].collect()} == {"i0": "drop", "i2": "keep"}
    projects = spark.createDataFrame([("P",), ("Z",)], "project_id string")
    assert {r["project_id"]: r["gate_open"] for r in qa.gate_open(projects, left).collect()} == {"P": False, "Z": True}
