"""Global shuffle into shards: a two-pass external shuffle.

Pass one scatters rows into memory-sized buckets by a seeded hash, pass two puts each bucket into
Fisher-Yates order (Spark's ``shuffle`` on the bucket's array) and deals the rows of all buckets
out in turn. Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import cut

#: Rows of one bucket, and bytes of their texts, on average at most; a bucket is one array in a task.
BUCKET_ROWS, BUCKET_BYTES = 4096, 1 << 24


def _buckets(rows: DataFrame, bucket_rows: int, bucket_bytes: int) -> int:
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)).cast("long") for c, kind in rows.dtypes if kind in ("string", "binary")]
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(texts, F.lit(0).cast("long"))), F.lit(0))).first()
    return max(1, -(-n // bucket_rows), -(-size // bucket_bytes))


def shuffle_shards(rows: DataFrame, shards: int, seed: int = 7, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... without gaps in each shard).

    Shards differ by one row at most. Rows are told apart by their place in the input, so repeated
    rows and a doc_id or text that a third of the rows share scatter like any other; nulls are
    plain values. An empty table gives an empty table. Columns named shard or slot are replaced.
    The place of a row is fixed for a fixed input (files read in the same splits).
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    buckets = _buckets(rows.select(*kept), bucket_rows, bucket_bytes)
    at = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    scattered = rows.select(F.struct(at.alias("at"), F.struct(*kept).alias("row")).alias("item")).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "item.at"), F.lit(buckets)))
    order = lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)
    # sent to their buckets first: rows gathered where they are read would hold a file's texts in one task
    filled = cut(scattered.repartition("bucket").groupBy("bucket").agg(F.array_sort(F.collect_list("item"), order).alias("items")))
    sizes = filled.select("bucket", F.size("items").cast("long").alias("n"))
    first = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("first"))
    # one row a bucket: copied to the buckets, so that their texts are not moved again
    dealt = filled.join(F.broadcast(first), "bucket").select("first", F.posexplode(F.shuffle("items", seed)).alias("pos", "item"))
    place = F.col("first") + F.col("pos")
    return dealt.select("item.row.*", F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"))


def write_shards(rows: DataFrame, path: str, shards: int, seed: int = 7, pieces: int = 16) -> None:
    """Writes the shuffled rows as Parquet, a folder for each shard, its rows in slot order inside each of ``pieces`` ranges."""
    placed = shuffle_shards(rows, shards, seed)
    tall = placed.repartitionByRange(max(shards, pieces), "shard", "slot").sortWithinPartitions("shard", "slot")
    tall.write.mode("errorifexists").partitionBy("shard").parquet(path)
