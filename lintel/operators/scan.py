"""Ordered scans that never put a whole large key into one task.

A plain window sends every row of a key to a single task, which is right for keys of a bounded
size. Keys beyond ``most`` rows are cut at positions taken from their own rows (quantiles of the
leading order column, so dense and sparse stretches hold alike many), scanned piece by piece, and one
summary row a piece carries across. Where no key is that large the scan is one plain window.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a key that one task scans, and pieces that a larger one is cut into.
MOST, PIECES = 1 << 20, 256
#: Buckets in which rows are counted before keys are, and how many of them are named in a filter.
BUCKETS, NAMED = 1 << 16, 1000
#: Items of lists that an Arrow function takes at a time.
ITEMS = 1 << 18
#: Ask the rows for large keys.
ASK = object()


def _same(key, prefix):
    return [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in key]


def _held_by_full_buckets(df: DataFrame, key, most: int) -> DataFrame | None:
    """Rows whose key falls into a bucket of more than ``most`` rows, without which no key is large; None if there is none.

    Counting every key would send a row for each of them, nearly the whole table where keys are fine.
    """
    bucket = F.pmod(F.xxhash64(*key), F.lit(BUCKETS))
    counted = df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    full = [r["_bucket"] for r in counted.limit(NAMED + 1).collect()]
    if len(full) > NAMED:
        return df
    return df.where(bucket.isin(full)) if full else None


def splitters(df: DataFrame, key, lead, most=MOST) -> DataFrame | None:
    """``_on_<key>`` and ``_cuts``, the positions that cut it, of the keys with more than ``most`` rows; None if there is none.

    Counts rows, which runs a job, unless ``most`` is None: no key is large. Rows that share one
    position are never parted.
    """
    if most is None:
        return None
    key = list(key)
    held = _held_by_full_buckets(df, key, most)
    if held is None:
        return None
    hot = held.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    if not hot.limit(1).collect():
        return None
    named = hot.select(*[F.col(k).alias(f"_on_{k}") for k in key])
    steps = [i / PIECES for i in range(1, PIECES)]
    at = F.array_sort(F.array_distinct(F.percentile_approx(lead, steps, 20 * PIECES)))
    cuts = held.join(named, _same(key, "_on_"), "left_semi").groupBy(*key).agg(at.alias("_cuts"))
    # written once: another run of the quantiles might cut elsewhere
    return checkpoint(cuts.withColumnsRenamed({k: f"_on_{k}" for k in key}))


def _plain(kind: str, value: Column, key, order) -> Column:
    line = Window.partitionBy(*key).orderBy(*order)
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if kind == "row_number":
        return F.row_number().over(line)
    if kind == "sum":
        return F.coalesce(F.sum(value).over(upto), F.lit(0))
    if kind == "max":
        return F.max(value).over(upto)
    if kind == "max_before":
        return F.max(value).over(line.rowsBetween(Window.unboundedPreceding, -1))
    if kind == "last":
        return F.last(value, ignorenulls=True).over(upto)
    if kind == "next":  # the same from the other end: a frame that runs to the end would start anew at each row
        turned = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
        return F.last(value, ignorenulls=True).over(turned.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if kind == "lag":
        return F.lag(value).over(line)
    raise ValueError(kind)


def _summary(kind: str, value: Column, at: Column) -> Column:
    """Aggregate that stands for one piece."""
    if kind == "row_number":
        return F.count(F.lit(1))
    if kind == "sum":
        return F.coalesce(F.sum(value), F.lit(0))
    if kind in ("max", "max_before"):
        return F.max(value)
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), at))
    if kind == "next":
        return F.min_by(value, F.when(value.isNotNull(), at))
    return F.max_by(F.struct(value.alias("v")), at)


def _across(kind: str, c: Column, key) -> Column:
    """What the pieces before one carry into it; those after it for ``next``."""
    line = Window.partitionBy(*key).orderBy("_bin")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    if kind in ("row_number", "sum"):
        return F.sum(c).over(before)
    if kind in ("max", "max_before"):
        return F.max(c).over(before)
    if kind == "next":
        return F.last(c, ignorenulls=True).over(Window.partitionBy(*key).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1))
    return F.last(c, ignorenulls=kind == "last").over(before)


def _both(kind: str, here: Column, past: Column) -> Column:
    if kind in ("row_number", "sum"):
        return here + F.coalesce(past, F.lit(0))
    if kind in ("max", "max_before"):
        return F.greatest(here, past)
    if kind == "lag":
        return F.coalesce(here, past)["v"]
    return F.coalesce(here, past)


def ordered_scan(df: DataFrame, key, order, lead, most=MOST, cuts=ASK, **specs) -> DataFrame:
    """Running values per ``key`` in ascending ``order``, whose leading column is the number ``lead``.

    Each keyword is ``out=(kind, column)`` with kind one of ``row_number``, ``sum``, ``max``,
    ``max_before`` (of the rows before), ``last`` (last non-null so far), ``next`` (first non-null from here on)
    and ``lag`` (previous row's value). ``cuts`` are :func:`splitters` known already, None for none.
    """
    key, order = list(key), list(order)
    value = {out: v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(1) for out, (_, v) in specs.items()}
    if cuts is ASK:
        cuts = splitters(df, key, lead, most)
    if cuts is None:
        return df.select("*", *[_plain(kind, value[out], key, order).alias(out) for out, (kind, _) in specs.items()])

    place = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(lead))))
    binned = df.join(cuts, _same(key, "_on_"), "left").withColumns({"_bin": F.coalesce(place, F.lit(0)), "_large": F.col("_cuts").isNotNull()})
    binned = binned.select(*df.columns, "_bin", "_large")
    at = F.struct(*order)
    inside = {f"_i_{out}": _plain(kind, F.struct(value[out].alias("v")) if kind == "lag" else value[out], [*key, "_bin"], order) for out, (kind, _) in specs.items()}
    rows = binned.withColumns(inside)
    pieces = rows.where("_large").groupBy(*key, "_bin").agg(*[_summary(kind, value[out], at).alias(f"_c_{out}") for out, (kind, _) in specs.items()])
    carried = pieces.select(
        *[F.col(c).alias(f"_on_{c}") for c in [*key, "_bin"]], *[_across(kind, F.col(f"_c_{out}"), key).alias(f"_o_{out}") for out, (kind, _) in specs.items()]
    )
    joined = rows.join(carried, _same([*key, "_bin"], "_on_"), "left")
    return joined.select(*df.columns, *[_both(kind, F.col(f"_i_{out}"), F.col(f"_o_{out}")).alias(out) for out, (kind, _) in specs.items()])


def islands(df: DataFrame, key, order, lead, prev, value, is_break, most=MOST, cuts=ASK, out="island") -> DataFrame:
    """Number runs of rows per key, from 1: a row opens a new run when ``is_break`` holds.

    ``is_break`` may read the order columns and ``prev``, the previous row's ``value``.
    """
    key, order = list(key), list(order)
    if cuts is ASK:
        cuts = splitters(df, key, lead, most)
    rows = ordered_scan(df, key, order, lead, cuts=cuts, _lag=("lag", F.struct(F.col(value).alias("v"))))
    rows = rows.withColumn(prev, F.col("_lag.v"))
    opens = F.when(F.col("_lag").isNull(), 1).otherwise(F.coalesce(is_break, F.lit(True)).cast("int"))
    rows = rows.withColumn("_opens", opens).drop(prev, "_lag")
    return ordered_scan(rows, key, order, lead, cuts=cuts, **{out: ("sum", "_opens")}).drop("_opens")


def folded(df: DataFrame, key, rows="_rows") -> DataFrame:
    """One row a key with the list ``rows`` of its rows, for keys of a bounded size. A key's values travel once a list."""
    key = list(key)
    return df.groupBy(*key).agg(F.collect_list(F.struct(*[c for c in df.columns if c not in key])).alias(rows))


def of_lists(work, kind: str, items: int = ITEMS):
    """Arrow function of lists that handles a few rows of a batch at a time: about so many ``items`` of the first list, or one row."""

    def run(*lists):
        ends = np.cumsum(np.diff(lists[0].offsets.to_numpy())) // items
        cuts = [0, *(np.flatnonzero(ends[1:] != ends[:-1]) + 1).tolist(), len(ends)]
        return pa.concat_arrays([work(*[c.slice(i, j - i) for c in lists]) for i, j in zip(cuts, cuts[1:])])

    return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR)


def _stop_numbers(last: bool, nearest: bool):
    """Arrow function of lists of places and of stops, which reach from ``at`` to ``to``: the number of each place's stop, -1 for none."""

    def look(places, at, to):
        mine, theirs = (np.diff(c.offsets.to_numpy()) for c in (places, at))
        places, at, to = (c.flatten() for c in (places, at, to))
        pick, m = np.full(len(places), -1), len(at)
        if m:
            some, x, to = at.is_valid().to_numpy(zero_copy_only=False), places.fill_null(0).to_numpy(), to.fill_null(0).to_numpy()
            at = at.fill_null(0).to_numpy()
            order = np.lexsort((at, some, np.repeat(np.arange(len(theirs)), theirs)))  # nulls come first, nan last
            at, to, some, begin = at[order], to[order], some[order], np.cumsum(theirs) - theirs
            begin, size = np.repeat(begin, mine), np.repeat(theirs, mine)
            end, hi, odd = begin + size, begin, not some.all() or np.isnan(x).any() or np.isnan(at).any()
            for _ in range(int(theirs.max()).bit_length()):  # each place halves its page's stops
                half = size >> 1
                mid = hi + half
                c = np.minimum(mid, m - 1)
                before = at[c] < x if last else at[c] <= x
                if odd:
                    before |= ~some[c] | (np.isnan(x) & ~np.isnan(at[c]) if last else np.isnan(x))
                before &= size > 0
                hi, size = np.where(before, mid + 1, hi), np.where(before, size - half - 1, half)
            pick = np.where(hi > begin, hi - 1, -1)
            if nearest:
                c = np.minimum(hi, m - 1)
                nearer = ~((np.maximum(0.0, x - to[pick]) <= at[c] - x) | np.isnan(at[c] - x))
                pick = np.where((hi < end) & ((pick < 0) | nearer), hi, pick)
            known = places.is_valid().to_numpy(zero_copy_only=False)
            pick = np.where(known & (pick >= 0), order[pick] - begin, -1)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(mine))), pa.int32()), pa.array(pick, pa.int32()))

    return of_lists(look, "array<int>")


def beside_stops(lists: DataFrame, stops: DataFrame, places: Column, key, last: bool, nearest: bool) -> DataFrame:
    """The lists with ``_of``, the number of the stop of each of the ``places``, and ``_stops``, the stops of their key. A number may be -1, for none.

    A place's stop is the last up to there or, with ``nearest``, the nearer of that and the first from there on, the former if they are alike.
    Stops have columns ``at`` and ``to``. ``last``: stops come after places that they share. The stops join their key's list, and places are
    looked up in Arrow batches of lists; Spark would sort whole rows, and those twice to look both ways.
    """
    key = list(key)
    mine = folded(stops.withColumns({c: F.col(c).cast("double") for c in ("at", "to")}), key, "_stops")
    both = lists.join(mine.hint("shuffle_hash"), key, "left").withColumn("_stops", F.coalesce("_stops", F.array().cast(mine.schema["_stops"].dataType)))
    stop = F.col("_stops")
    return both.withColumn("_of", _stop_numbers(last, nearest)(places.cast("array<double>"), stop["at"], stop["to"]))


def fields(lists: DataFrame, r, rows="_rows") -> list[Column]:
    """The columns of a row ``r`` of the lists."""
    return [r[c].alias(c) for c in lists.schema[rows].dataType.elementType.names]


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; on a local master, where none is set, one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="run-"))
    return context.getCheckpointDir()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for a table that Spark writes."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to a folder of their own by columns, which takes a fraction of the space of a checkpoint."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def checkpoint(df: DataFrame) -> DataFrame:
    """Spark's reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
