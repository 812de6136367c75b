"""Agreement between extraction passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel import vocab as V
from lintel.functions import text as T


def _votes(passes: DataFrame, mark: str, key) -> DataFrame:
    """One row per (key, mark) with a flag per pass; duplicates fold on the map side."""
    m = T.mark_key(F.col(mark).cast("string"))
    return passes.groupBy(*key, m.alias("mark")).agg(
        *[F.bool_or(F.col("pass_no") == n).cast("int").alias(f"p{n}") for n in (1, 2, 3)]
    )


def jaccard_consensus(passes: DataFrame, mark="mark", key=("project_id", "page_id"), min=V.CONSENSUS_RATIO) -> DataFrame:
    """Two-pass agreement per page, then the marks that stand, by agreement or 2-of-3 vote.

    Works on per-mark flags and counts instead of per-page sets, so a page of any size stays
    distributed. Columns: key, mark, match_ratio, method.
    """
    key = list(key)
    votes = _votes(passes, mark, key)
    ratio = votes.groupBy(*key).agg(
        (F.sum(F.col("p1") * F.col("p2")) / F.nullif(F.sum(F.greatest("p1", "p2")), F.lit(0))).alias("match_ratio")
    )
    agreed = F.col("match_ratio") >= min
    return (
        votes.join(ratio, key)
        .where("match_ratio is not null")
        .where(
            (agreed & (F.col("p1") + F.col("p2") == 2)) | (~agreed & (F.col("p1") + F.col("p2") + F.col("p3") >= 2))
        )
        .select(*key, "mark", "match_ratio", F.when(agreed, "agreement").otherwise("2-of-3").alias("method"))
    )


def page_agreement(passes: DataFrame, mark="mark", key=("project_id", "page_id")) -> DataFrame:
    """Sizes of the common and joint mark sets of passes 1 and 2, with their ratio, per page."""
    key = list(key)
    return (
        _votes(passes, mark, key)
        .groupBy(*key)
        .agg(F.sum(F.col("p1") * F.col("p2")).alias("n_common"), F.sum(F.greatest("p1", "p2")).alias("n_joint"))
        .withColumn("match_ratio", F.col("n_common") / F.nullif(F.col("n_joint"), F.lit(0)))
    )


def vote(passes: DataFrame, mark="mark", key=("project_id", "page_id"), need=2) -> DataFrame:
    key = list(key)
    return (
        _votes(passes, mark, key)
        .withColumn("votes", F.col("p1") + F.col("p2") + F.col("p3"))
        .where(F.col("votes") >= need)
        .select(*key, "mark", "votes")
    )


def string_consensus(df: DataFrame, p1="pass_1", p2="pass_2", p3="pass_3", min=V.CONSENSUS_RATIO, method="blocks") -> DataFrame:
    """Tag text agreed by two of three readings, else blank and for review; ``method`` as of similarity()."""
    a, b, c = F.col(p1), F.col(p2), F.col(p3)
    scored = df.withColumns(
        {"_12": T.similarity(a, b, method), "_13": T.similarity(a, c, method), "_23": T.similarity(b, c, method)}
    )
    pick = (
        F.when(F.col("_12") >= min, F.when(F.length(a) > 0, a).otherwise(b))
        .when(F.col("_13") >= min, a)
        .when(F.col("_23") >= min, b)
    )
    return scored.withColumns(
        {"resolved": F.coalesce(pick, F.lit("")), "needs_review": pick.isNull()}
    ).drop("_12", "_13", "_23")
