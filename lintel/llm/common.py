"""Helpers shared by the corpus operators: Arrow text buffers, hashing, lineage cuts, components."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: blank and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: ASCII lower-casing of bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The same white space inside a Java or Python regular expression.
SPACE_RE = "[\\x20\\x09-\\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named c0, c1, ... and the new name of each, so that no helper column can clash with the input's."""
    place = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*place.values()), place


def back(place: dict[str, str], columns: list[str] | None = None) -> list[Column]:
    """The columns of aside() under their own names."""
    return [F.col(place[c]).alias(c) for c in columns or place]


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the session names; on a local master, where none is set, in one of its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="run-"))
    return df.checkpoint()


# ---------------------------------------------------------------- text buffers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the n + 1 offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if offs is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(batches, column: str, most: int = 1 << 20):
    """Cuts Arrow batches into runs of rows of about ``most`` bytes of one text column; a longer row stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.diff(text_bytes(col)[1])
        part = np.concatenate(([0], np.cumsum(sizes)[:-1])) // most
        at = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *at], [*at, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each row, and n + 1 offsets of rows into them. Words never cross rows."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    ink = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    before = np.concatenate(([False], ink[:-1]))
    after = np.concatenate((ink[1:], [False]))
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


# ---------------------------------------------------------------- hashing

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20250101).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 21)
        _POWERS["up"] = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, _BASE, np.uint64))))
        _POWERS["down"] = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, _BACK, np.uint64))))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit words."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, equal for equal spans wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k hashes; the caller drops runs that cross rows."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return out


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the least node reachable.

    Large-star and small-star rounds: each keeps the components and pulls nodes to the least
    neighbour, so chains shorten by a factor in each round, until nothing changes. A node with very many
    neighbours is an aggregated minimum joined back, never a collected list.
    """
    flip = lambda e: e.select(F.col("b").alias("a"), F.col("a").alias("b"))

    def star(both: DataFrame) -> DataFrame:
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        return both.join(least, "a").select("a", "b", F.least("a", "m").alias("m"))

    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        large = star(edges.union(flip(edges))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small = star(large)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        edges = cut(small.where("a <> b").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
