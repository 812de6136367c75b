"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import SPACE_RE, aside, back, cut

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Parts of a source, by the leading digits of the order hash, whose sums are taken before rows are put in order.
PARTS = 4096


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RE + "+"), "")


def _key(doc_id: Column, seed: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> source, source_size, target. Works on one row per source.

    Sources by code point, null last, take the weights in turn. target = min(max_epochs * size,
    level * weight) with the level at which the targets share all of the sizes: a source above its
    cap is clamped and the excess goes to the others by weight until none is above.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    src = sizes.select("source", "source_size", w.cast("double").alias("w"), F.sum("source_size").over(every).cast("double").alias("total"))
    src = src.withColumn("cap", (F.col("source_size") * max_epochs).cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    done = F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1))
    open_ = F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    src = src.withColumn("level", (F.col("total") - F.coalesce(done, F.lit(0.0))) / open_)
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every)
    return src.withColumn("at", level).select("source", "source_size", F.least("cap", F.col("at") * F.col("w")).alias("target"))


def mix(docs: DataFrame, seed: int = 11, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, parts: int = PARTS) -> DataFrame:
    """The rows of docs (doc_id, text, source, ...) with size, source_size, target and taken.

    size counts words (null or empty text: 0). Every row of a source is taken floor(target / size of
    the source) times; rows in the order of a seeded hash of doc_id are taken once more until the
    rest is used up, the last of them in part, so a source's taken words are its target, rounded.
    Rows of equal doc_id, source and size share a partial repetition evenly (rounded down). A null
    source is a source; a source without words has target 0. Empty tables stay empty. Columns of
    these four names are replaced; others keep their names and values, whatever they are called.
    """
    own = ("size", "source_size", "target", "taken")
    docs, place = aside(docs.select(*[c for c in docs.columns if c not in own]))
    sized = docs.select("*", F.col(place["doc_id"]).alias("doc_id"), F.col(place["source"]).alias("source"), F.size(word_list(F.col(place["text"]))).cast("long").alias("size"))
    narrow = cut(sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies")))
    goal = cut(targets(narrow.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, max_epochs))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("rest", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    # where, in the order of the hash, the rest of a source ends
    line = narrow.where("size > 0").withColumn("key", _key(F.col("doc_id"), seed)).withColumn("part", F.floor(F.col("key") / (2**32 // parts)))
    line = line.withColumn("words", F.col("size") * F.col("copies")).withColumn("known", F.col("source").isNotNull()).withColumn("source", F.coalesce("source", F.lit("")))
    g = goal.withColumn("known", F.col("source").isNotNull()).withColumn("source", F.coalesce("source", F.lit("")))
    sums = line.groupBy("known", "source", "part").agg(F.sum("words").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("known", "source").orderBy("part"))
    sums = sums.select("known", "source", "part", (upto - F.col("words")).alias("before"), upto.alias("after"))
    edge = sums.join(g.where("rest > 0"), ["known", "source"]).where("before < rest AND after >= rest").select("known", "source", "part", "before", "rest")
    inside = F.sum("words").over(Window.partitionBy("known", "source", "part").orderBy("key", "doc_id", "size"))
    last = line.join(edge, ["known", "source", "part"]).withColumn("after", F.col("before") + inside)
    last = last.where("after >= rest AND after - words < rest").select("known", "source", F.col("key").alias("l_key"), F.col("doc_id").alias("l_doc"), F.col("size").alias("l_size"), F.floor((F.col("rest") - F.col("after") + F.col("words")) / F.col("copies")).cast("long").alias("l_part"))
    goal = g.join(last, ["known", "source"], "left").withColumn("source", F.when(F.col("known"), F.col("source"))).drop("known").withColumnRenamed("source", "g_source")
    goal = cut(goal)  # one row per source
    out = sized.join(goal, F.col("source").eqNullSafe(F.col("g_source"))).withColumn("l_here", _key(F.col("doc_id"), seed))
    none = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    cutoff = F.struct("l_key", F.coalesce("l_doc", F.lit(-(2**63))).alias("d"), F.col("l_size").alias("s"))
    here = F.struct(F.col("l_here").alias("l_key"), none.alias("d"), F.col("size").alias("s"))
    extra = F.when(F.col("l_key").isNull(), 0).when(here < cutoff, F.col("size")).when(here == cutoff, F.col("l_part")).otherwise(0)
    taken = F.when(F.col("size") > 0, F.col("whole") * F.col("size") + extra).otherwise(F.lit(0)).cast("long")
    return out.select(*back(place), "size", "source_size", "target", taken.alias("taken"))


def repeat_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as often as it is taken; the last repetition holds the leading words still due, joined by a blank."""
    rows, place = aside(mixed.where("taken > 0"))
    size, taken, text = (F.col(place[c]) for c in ("size", "taken", "text"))
    times = F.when(size > 0, F.ceil(taken / size)).otherwise(0).cast("int")
    rows = rows.withColumn("turn", F.explode(F.sequence(F.lit(1), times)))
    left = (taken - (F.col("turn") - 1) * size).cast("int")
    rows = rows.withColumn(place["text"], F.when(left >= size, text).otherwise(F.array_join(F.slice(word_list(text), F.lit(1), left), " ")))
    if "n_chars" in columns:
        rows = rows.withColumn(place["n_chars"], F.length(place["text"]).cast("long"))
    return rows.select(*back(place, columns))
