"""Run progress, admission control and the review loop as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from lintel import vocab as V
from lintel.operators.scan import islands, ordered_scan
from lintel.sources.io import latest, upsert_latest

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def progress_columns(df: DataFrame, node="node", status="status") -> DataFrame:
    """Adds step, percent and the status a node implies."""
    steps = F.create_map(*[F.lit(x) for n, (s, _) in V.PROGRESS_STEPS.items() for x in (n, s)])
    percent = F.create_map(*[F.lit(x) for n, (_, p) in V.PROGRESS_STEPS.items() for x in (n, p)])
    pct = F.coalesce(F.element_at(percent, F.col(node)), F.lit(0))
    return df.withColumns(
        {
            "step": F.coalesce(F.element_at(steps, F.col(node)), F.col(node)),
            "progress": pct,
            "run_status": F.when(pct == 100, "completed").otherwise(F.coalesce(F.col(status), F.lit("processing"))),
        }
    )


def track_progress(stream: DataFrame, session="session_id", ts="ts", seq=None) -> DataFrame:
    """Latest step per session; ``ended`` once completed or failed, not while paused.

    On a stream, in update mode, the state of a session is one row, and it goes when the session
    ends: an event that arrives after that opens a new one. Needs the RocksDB state store.
    """
    rows = progress_columns(stream)
    if stream.isStreaming:
        return _progress_stream(rows, session, ts, seq)
    order = F.struct(*[F.col(c) for c in ([ts, seq] if seq else [ts])])
    latest = rows.groupBy(session).agg(
        F.max_by(F.struct("step", "progress", "run_status"), order).alias("l"), F.max(ts).alias("last_ts")
    )
    return latest.select(
        session, "l.step", "l.progress", F.col("l.run_status").alias("status"), "last_ts",
        F.col("l.run_status").isin("completed", "failed").alias("ended"),
    )


class _Progress(StatefulProcessor):
    """Keeps the latest event of a session until it ends."""

    def __init__(self, session: str):
        self.session = session

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "micros bigint, seq bigint, step string, progress int, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = tuple(self.last.get()) if self.last.exists() else None
        for pdf in rows:
            row = pdf.sort_values(["micros", "seq"]).iloc[-1]
            new = (int(row["micros"]), int(row["seq"]), row["step"], int(row["progress"]), row["run_status"])
            best = new if best is None or new[:2] >= best[:2] else best
        ended = best[4] in ("completed", "failed")
        if ended:
            self.last.clear()
        else:
            self.last.update(best)
        yield pd.DataFrame([[key[0], best[2], best[3], best[4], best[0], ended]], columns=[self.session, "step", "progress", "status", "micros", "ended"])

    def close(self) -> None:
        pass


def _progress_stream(rows: DataFrame, session: str, ts: str, seq: str | None) -> DataFrame:
    number = F.col(seq).cast("bigint") if seq else F.lit(0).cast("bigint")
    slim = rows.select(session, _micros(ts).alias("micros"), number.alias("seq"), "step", F.col("progress").cast("int").alias("progress"), "run_status")
    kind = slim.schema[session].dataType.simpleString()
    out = slim.groupBy(session).transformWithStateInPandas(
        statefulProcessor=_Progress(session), outputMode="Update", timeMode="None",
        outputStructType=f"`{session}` {kind}, step string, progress int, status string, micros bigint, ended boolean",
    )
    return out.select(session, "step", "progress", "status", F.timestamp_micros("micros").alias("last_ts"), "ended")


def _admit_times(times, accepted: list[int], limit: int, window: int):
    """Sliding log over ordered micros: accept while fewer than ``limit`` accepted ones are younger than the window."""
    out = []
    for t in times:
        while accepted and t - accepted[0] >= window:
            accepted.pop(0)
        ok = len(accepted) < limit
        if ok:
            accepted.append(t)
        out.append(ok)
    return out


class _Limiter(StatefulProcessor):
    """Keeps at most ``limit`` accepted times per key."""

    def __init__(self, key: str, limit: int, seconds: int):
        self.key, self.limit, self.window = key, limit, int(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("times", ArrayType(LongType()))])
        self.log = handle.getValueState("log", schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        accepted = list(self.log.get()[0]) if self.log.exists() else []
        for pdf in rows:
            pdf = pdf.sort_values(["micros", "seq_no"])
            pdf = pdf.assign(admitted=_admit_times(pdf["micros"].tolist(), accepted, self.limit, self.window))
            yield pdf[[self.key, "seq_no", "micros", "admitted"]]
        self.log.update((accepted,))

    def close(self) -> None:
        pass


def _micros(ts):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def admit(stream: DataFrame, key="user_id", ts="ts", limit=V.RATE_LIMIT, seconds=V.RATE_WINDOW_SECONDS, seq="event_id") -> DataFrame:
    """Sliding-log limiter on a stream: rejected events do not count.

    State per key is the last ``limit`` accepted times. Needs the RocksDB state store. Events
    are taken in the order they arrive, by time inside each delivered batch of rows.
    """
    rows = stream.select(F.col(key), F.col(seq).cast("bigint").alias("seq_no"), _micros(ts).alias("micros"))
    schema = StructType(
        [
            rows.schema[key],
            StructField("seq_no", LongType()),
            StructField("micros", LongType()),
            StructField("admitted", BooleanType()),
        ]
    )
    out = rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Limiter(key, limit, seconds), outputStructType=schema, outputMode="Append", timeMode="None"
    )
    return out.select(key, F.col("seq_no").alias(seq), F.timestamp_micros("micros").alias(ts), "admitted")


def admit_batch(df: DataFrame, key="user_id", ts="ts", limit=V.RATE_LIMIT, seconds=V.RATE_WINDOW_SECONDS, seq="event_id") -> DataFrame:
    """The limiter over stored events: exact, and parallel inside a key.

    An event whose trailing window holds at most ``limit`` events is admitted whatever came
    before. Only stretches of overload have to be walked: events that exceed the limit, joined
    while less than a window apart, plus the window before them. Each stretch is streamed
    through a task in time order with ``limit`` times as its only state.
    """
    window = int(seconds * 1_000_000)
    rows = trailing_count(df, key, ts, seconds, seq).withColumnRenamed(seq, "_seq")
    hot = rows.where(F.col("n_recent") > limit).select(key, "_us", "_seq")
    gap = F.col("_us") - F.col("_p") >= window
    hot = islands(hot, [key], ["_us", "_seq"], "_us", "_p", "_us", gap, out="_run")
    line = rows.join(hot.select(key, "_us", "_seq", "_run"), [key, "_us", "_seq"], "left").withColumns(
        {
            "_h": F.when(F.col("_run").isNotNull(), F.struct(F.col("_us").alias("us"), F.col("_run").alias("run"))),
        }
    )
    ahead = ordered_scan(line, [key], ["_us", "_seq"], "_us", _next=("next", "_h"))
    stretch = F.when(F.col("_next.us") - F.col("_us") < window, F.col("_next.run"))
    placed = ahead.select(key, "_seq", "_us", stretch.alias("_run"))
    free = placed.where("_run is null").select(key, "_seq", "_us", F.lit(True).alias("admitted"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, accepted = None, []
        for pdf in batches:
            flags = []
            for k, run, t in zip(pdf[key], pdf["_run"], pdf["_us"]):
                if (k, run) != group:
                    group, accepted = (k, run), []
                flags.extend(_admit_times((t,), accepted, limit, window))
            yield pdf[[key, "_seq", "_us"]].assign(admitted=flags)

    kind = df.schema[key].dataType.simpleString()
    busy = placed.where("_run is not null").repartition(key, "_run").sortWithinPartitions(key, "_run", "_us", "_seq")
    walked = busy.mapInPandas(walk, f"`{key}` {kind}, _seq bigint, _us bigint, admitted boolean")
    out = free.unionByName(walked)
    return out.select(key, F.col("_seq").alias(seq), F.timestamp_micros("_us").alias(ts), "admitted")


def trailing_count(df: DataFrame, key="user_id", ts="ts", seconds=V.RATE_WINDOW_SECONDS, seq="event_id") -> DataFrame:
    """Events of the key in the trailing window, the row included: an upper bound of the limiter's log.

    The window is cut into time slices; a row looks only at its own and the previous slice, so
    a busy key spreads over as many tasks as it has slices.
    """
    window = int(seconds * 1_000_000)
    rows = df.select(F.col(key), F.col(seq).alias("_seq"), _micros(ts).alias("_us"))
    slice_ = F.floor(F.col("_us") / F.lit(window)).cast("bigint")
    spread = rows.withColumn("_slice", F.explode(F.array(slice_, slice_ + 1))).withColumn("_own", F.col("_slice") == slice_)
    w = Window.partitionBy(key, "_slice").orderBy("_us").rangeBetween(-(window - 1), 0)
    return (
        spread.withColumn("n_recent", F.count(F.lit(1)).over(w))
        .where("_own")
        .select(key, F.col("_seq").alias(seq), "_us", "n_recent")
    )


def review_step(queue: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(open, resolved): items without a decision stay; the last decision per item resolves it."""
    last = decisions.groupBy("item_id").agg(F.max_by(F.struct("decision", "seq"), "seq").alias("d"))
    last = last.select("item_id", "d.decision", "d.seq")
    return queue.join(last, "item_id", "left_anti"), queue.join(last, "item_id")


def review_loop(decisions: DataFrame, queue_path: str, checkpoint_path: str):
    """Stream of decisions against a stored queue. Each micro-batch stores its last decision per item
    in a folder of its own below ``queue_path``; the open queue is the anti join, so a replayed batch,
    which writes the same folder again, changes nothing."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        latest(batch, ["item_id"], ["seq"]).select("item_id", "decision", "seq").write.mode("overwrite").parquet(
            f"{queue_path}/decisions/batch_id={batch_id}"
        )

    return decisions.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint_path)


def open_queue(spark, queue_path: str) -> DataFrame:
    """Items still waiting: stored queue minus every stored decision; all of them before the first one."""
    queue = spark.read.parquet(f"{queue_path}/items")
    try:
        decisions = spark.read.parquet(f"{queue_path}/decisions").drop("batch_id")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return queue
    return review_step(queue, decisions)[0]


__all__ = [
    "track_progress", "admit", "admit_batch", "trailing_count", "review_loop", "review_step", "open_queue", "upsert_latest",
]
