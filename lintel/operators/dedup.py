"""First-row, ranking, bifurcation and numbering operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel import vocab as V
from lintel.functions import text as T
from lintel.operators.scan import MOST, ordered_scan


def _list(x):
    return [x] if isinstance(x, str) else list(x)


def dedup_first(df: DataFrame, mark="mark", key=("project_id",), order=("row_no",)) -> DataFrame:
    """First row per cleaned mark, all rows without a mark; the printed mark is kept beside it."""
    key, order = _list(key), _list(order)
    raw = T.mark_key(T.text_of(mark))
    clean = T.clean_mark(raw)
    rows = df.withColumns({"_original_mark": F.when(clean != raw, raw), mark: clean})
    named = rows.where(F.col(mark) != "")
    rest = [c for c in rows.columns if c not in (*key, mark)]
    first = (
        named.groupBy(*key, mark)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
        .select(*key, mark, *[F.col(f"_r.{c}").alias(c) for c in rest])
        .select(*rows.columns)
    )
    return first.unionByName(rows.where(F.col(mark) == ""))


def _variants(det, key, mark, value, blanks):
    v = F.upper(T.strip(T.text_of(value)))
    seen = det.select(*key, mark, v.alias("_v")).where(~F.col("_v").isin(list(blanks))).distinct()
    # a list of distinct rows: a set would make Spark drop the distinct and sort every detection
    return seen.groupBy(*key, mark).agg(F.array_sort(F.collect_list("_v")).alias("_vs"))


def bifurcate(rows: DataFrame, det: DataFrame, mark="mark", wall="wall_type", key=("project_id",), blanks=("", "UNKNOWN")) -> DataFrame:
    """Rows seen in several wall types become ``mark.1`` ... in order of wall type."""
    key = _list(key)
    split = _variants(det, key, mark, wall, blanks).where(F.size("_vs") > 1)
    out = rows.join(split, [*key, mark], "left")
    out = out.select(*out.columns, F.posexplode_outer("_vs").alias("_i", "_w"))
    cut = F.col("_w").isNotNull()
    cols = {
        "original_tag": F.when(cut, F.col(mark)),
        mark: F.when(cut, F.concat(F.col(mark), F.lit("."), (F.col("_i") + 1).cast("string"))).otherwise(F.col(mark)),
        "wall_variant": F.col("_w"),
        "is_bifurcated": cut,
        "bifurcation_note": F.when(cut, F.lit(V.NOTE_WALL)),
    }
    return out.withColumns(cols).drop("_vs", "_i", "_w")


def bifurcate_by(rows: DataFrame, det: DataFrame, mark="mark", cond="int_ext", suffix=".L", key=("project_id",), standard="INTERIOR", note=V.NOTE_LOCATION) -> DataFrame:
    """Rows seen under both the standard and another condition get a second ``mark<suffix>`` row."""
    key = _list(key)
    v = F.upper(T.text_of(cond))
    both = det.groupBy(*key, mark).agg(
        F.bool_or(v == standard.upper()).alias("_std"), F.bool_or(v != standard.upper()).alias("_alt")
    )
    out = rows.join(both, [*key, mark], "left")
    twice = F.coalesce(F.col("_std") & F.col("_alt"), F.lit(False))
    out = out.withColumn("_alts", F.when(twice, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    out = out.withColumn("_alt_row", F.explode("_alts"))
    alt = F.col("_alt_row")
    return out.withColumns(
        {
            "original_tag": F.when(alt, F.col(mark)),
            mark: F.when(alt, F.concat(F.col(mark), F.lit(suffix))).otherwise(F.col(mark)),
            "is_bifurcated": alt,
            "bifurcation_note": F.when(alt, F.lit(note)),
        }
    ).drop("_std", "_alt", "_alts", "_alt_row")


def sequence_ids(df: DataFrame, key=("project_id",), order=("seq",), fmt="A-%03d", most=MOST, out="id") -> DataFrame:
    """Sequential ids per key over an explicit order whose first column is numeric."""
    order = _list(order)
    n = ordered_scan(df, _list(key), order, order[0], most, _n=("row_number", None))
    return n.withColumn(out, F.format_string(fmt, F.col("_n"))).drop("_n")


def occurrence_index(df: DataFrame, key=("project_id", "page_id", "mark"), order=("y", "x"), most=MOST, out="occurrence") -> DataFrame:
    order = _list(order)
    return ordered_scan(df, _list(key), order, order[0], most, **{out: ("row_number", None)})


def best_evidence(df: DataFrame, level="level", value="value", key=("project_id", "item")) -> DataFrame:
    """Value of the strongest source; different values at that level are a conflict.

    Named levels rank as in EVIDENCE_LEVELS, unknown ones last; a number is its own rank. A value
    that rests on the weakest known level or on an unknown one is INFERRED. Two partial aggregations instead of a ranking window, so a hot item never gathers in one task.
    """
    key = _list(key)
    place = F.array_position(F.array(*map(F.lit, V.EVIDENCE_LEVELS)), F.col(level).cast("string")).cast("int")
    last = len(V.EVIDENCE_LEVELS)
    rank = F.when(place > 0, place).otherwise(last + 1) if dict(df.dtypes)[level] == "string" else F.col(level)
    per_level = df.groupBy(*key, level).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).withColumn("_r", F.struct(rank.alias("k"), level))
    best = per_level.groupBy(*key).agg(F.min_by(F.struct(F.col(level).alias("l"), "_lo", "_hi", F.col("_r.k").alias("r")), "_r").alias("b"))
    conflict = F.col("b._lo") != F.col("b._hi")
    return best.select(
        *key, F.col("b.l").alias(level), F.when(conflict, F.lit(None)).otherwise(F.col("b._lo")).alias(value),
        F.when(conflict, "CONFLICT").when(F.col("b.r") >= last, "INFERRED").otherwise("VERIFIED").alias("status"),
    )


def most_recent(df: DataFrame, key=("user_id",), ts="ts", n=10, tie=()) -> DataFrame:
    """The ``n`` latest rows per key. Spark keeps only n rows per key and partition before it shuffles."""
    w = Window.partitionBy(*_list(key)).orderBy(F.col(ts).desc(), *[F.col(t).desc() for t in _list(tie)])
    return df.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def ordered_distinct(df: DataFrame, item="floor_name", key=("project_id", "mark"), order=("floor_no",), sep=", ", out="floors") -> DataFrame:
    """Distinct items per key, first-seen order, joined."""
    key = _list(key)
    first = df.where(F.coalesce(F.col(item), F.lit("")) != "").groupBy(*key, item).agg(F.min(F.struct(*_list(order))).alias("_o"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_o", item))), lambda e: e[item])
    return first.groupBy(*key).agg(F.array_join(listed, sep).alias(out))


def occurrences(df: DataFrame, mark="mark", key=("project_id",)) -> DataFrame:
    """Detections per mark."""
    return df.groupBy(*_list(key), mark).agg(F.count(F.lit(1)).alias("qty"))


def distinct_values(df: DataFrame, col, key=("project_id", "mark"), sep=",") -> DataFrame:
    key = _list(key)
    seen = df.select(*key, col).where(F.col(col).isNotNull()).distinct()
    return seen.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(col)), sep).alias(col))


def union_marks(a: DataFrame, b: DataFrame, on="mark") -> DataFrame:
    return a.select(*_list(on)).union(b.select(*_list(on))).distinct()


def common_marks(a: DataFrame, b: DataFrame, on="mark") -> DataFrame:
    return a.select(*_list(on)).intersect(b.select(*_list(on)))
