"""Quality rules whose cutoffs are chosen under risk control.

Five rules reject a document when a statistic exceeds a cutoff. Cutoffs stand on a fixed grid, and labelled documents
must show, by an exact binomial test, that good documents are rejected less often than allowed. With enough labelled
good documents in a stratum every rule gets a cutoff of its own, tested against a fifth of the allowed share and corrected for
rules times strata. Where there are too few for any such cutoff to pass, the stratum takes one level of strictness for all
rules, tested together against the whole share and corrected for strata. The number of labels alone decides which.
Cutoffs and levels are tested in a fixed order, from the mildest on, until one fails, which needs no correction.
Without evidence no rule rejects anything. Native: DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import SPACE_RE, aside, back, cut

#: Allowed share of good documents that all rules together may reject in a stratum, and the error of the whole procedure.
RISK, ERROR = 0.02, 0.05
#: Rules and their cutoffs by level, strictest first.
GRID = {
    "symbol_share": [0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.18, 0.25, 0.35, 0.5],
    "upper_share": [0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8],
    "dup_line_share": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8],
    "repeat_share": [0.01, 0.02, 0.03, 0.05, 0.07, 0.09, 0.11, 0.13, 0.15, 0.18],
    "mean_word": [7.0, 7.5, 8.0, 8.5, 9.0, 10.0, 11.0, 12.0, 14.0, 18.0],
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, lang and the statistics of every whole text; null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", "lang", text.alias("text"))
    d = d.select("doc_id", "lang", "text", F.array_remove(F.split("text", SPACE_RE + "+"), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    share = lambda pattern: F.length(F.regexp_replace("text", pattern, "")).cast("long")
    d = d.select(
        "doc_id", "lang", F.xxhash64("text").alias("text_key"), F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        share("[^#*$%&|<>]+").alias("n_symbols"), share("[^A-Z]+").alias("n_upper"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    five = F.transform(F.sequence(F.lit(0), F.size("h") - 5), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(5)]))
    keep = [c for c in d.columns if c != "h"]
    d = d.select(*keep, F.when(F.size("h") >= 5, five).otherwise(F.array().cast("array<bigint>")).alias("five"))
    again = F.size(F.array_distinct("five")) < F.size("five")
    d = d.select(*keep, F.when(again, F.array_sort(F.transform("five", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"))
    same = lambda j, k: F.coalesce(F.get("s", j)["h"] == F.get("s", j + k)["h"], F.lit(False))
    twice = F.filter(F.transform(F.sequence(F.lit(0), F.size("s") - 1), lambda j: F.when(same(j, -1) | same(j, 1), F.get("s", j)["i"])), lambda p: p.isNotNull())
    d = d.select(*keep, F.when(F.col("s").isNotNull(), F.array_sort(twice)).alias("p"))
    start = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("p", start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(5), p - a["last"])).alias("n")), lambda a: a["n"])
    d = d.select(*keep, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    d = d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return d.select(
        "doc_id", "lang", "text_key", *BASE, "base_failed", ratio("n_symbols", "word_chars").alias("symbol_share"), ratio("n_upper", "word_chars").alias("upper_share"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_share"), ratio("n_repeat_words", "n_words").alias("repeat_share"), ratio("word_chars", "n_words").alias("mean_word"),
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial variable, for k < n * p: the exact sum, from its largest term downwards."""
    steps = F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    log_top = F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.log((n - i + 1) / i)) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    ratio = F.lit((1 - p) / p)
    down = F.aggregate(
        F.reverse(steps), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, i: F.struct((a["t"] * ratio * i / (n - i + 1)).alias("t"), (a["s"] + a["t"] * ratio * i / (n - i + 1)).alias("s")), lambda a: a["s"],
    )
    return F.exp(log_top) * down


#: Levels of strictness; 0 is the strictest.
LEVELS = min(map(len, GRID.values()))


def exceeded(rule: str) -> Column:
    """How many levels of a rule reject a row: those from 0 up to, but not with, this number."""
    return sum(((F.col(rule) > c).cast("int") for c in GRID[rule][:LEVELS]), F.lit(0))


def cutoffs(feats: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """stratum, rule, cutoff: the strictest certified cutoff, one row where there is one.

    feats: features(); labels: doc_id, quality (1: good; null or repeated labels: the least counts).
    A cutoff is certified when P(Bin(n, risk / rules) <= rejected good documents) is at most
    error / (rules * strata). A stricter cutoff never rejects less, so the strictest that passes is
    where testing in order, mildest first, would stop.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    rows = feats.where("NOT base_failed").join(good, "doc_id").withColumn("stratum", F.coalesce("lang", F.lit("")))
    held = F.array(*[F.struct(F.lit(r).alias("rule"), sum(((F.col(r) > c).cast("int") for c in grid), F.lit(0)).alias("over")) for r, grid in GRID.items()])
    counts = rows.select("stratum", F.explode(held).alias("x")).groupBy("stratum", "x.rule", "x.over").agg(F.count("*").alias("n"))
    tests = counts.groupBy("stratum", "rule").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("over", "n"))).alias("by"))
    tests = tests.select("*", F.count("*").over(Window.partitionBy()).alias("pairs"))  # rules times strata
    grid = F.create_map(*[x for r, g in GRID.items() for x in (F.lit(r), F.array(*map(F.lit, g)))])
    tests = tests.select("stratum", "rule", "n", "by", "pairs", F.posexplode(F.element_at(grid, F.col("rule"))).alias("at", "cutoff"))
    # over > at: the value exceeds the cutoff of that place
    lost = F.aggregate(F.map_entries("by"), F.lit(0).cast("long"), lambda a, e: a + F.when(e["key"] > F.col("at"), e["value"]).otherwise(0))
    tests = tests.withColumn("lost", lost).where(F.col("lost") < F.col("n") * (risk / len(GRID)))
    sure = tests.where(binomial_tail(F.col("lost"), F.col("n"), risk / len(GRID)) <= error / F.col("pairs"))
    return sure.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def levels(feats: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """stratum, level: the strictest certified level, one row where there is one, of strata too small for cutoffs().

    feats: features(); labels: doc_id, quality (1: good; null or repeated labels: the least counts).
    A level is certified when P(Bin(n, risk) <= rejected good documents) is at most error / strata. A stricter level
    never rejects less, so the strictest that passes is where testing in order, mildest first, stops.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    rows = feats.where("NOT base_failed").join(good, "doc_id").select(F.coalesce("lang", F.lit("")).alias("stratum"), F.greatest(*[exceeded(r) for r in GRID]).alias("over"))
    tests = rows.groupBy("stratum", "over").agg(F.count("*").alias("n")).groupBy("stratum").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("over", "n"))).alias("by"))
    tests = tests.select("*", F.count("*").over(Window.partitionBy()).alias("strata"))  # one row per stratum
    tests = tests.select("*", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
    lost = F.aggregate(F.map_entries("by"), F.lit(0).cast("long"), lambda a, e: a + F.when(e["key"] > F.col("level"), e["value"]).otherwise(0))
    enough = F.log(F.lit(error) / (len(GRID) * F.col("strata"))) / math.log(1 - risk / len(GRID))  # labels from which a cutoff that loses none passes
    tests = tests.withColumn("lost", lost).where((F.col("n") < enough) & (F.col("lost") < F.col("n") * risk))
    return tests.where(binomial_tail(F.col("lost"), F.col("n"), risk) <= error / F.col("strata")).groupBy("stratum").agg(F.min("level").alias("level"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """doc_id, text_key, the base statistics, base_failed, kept and rules (names of the rules broken), one row per row of docs.

    kept is false where base_failed (fewer than 10 words, so also null and empty texts, or more than
    20 % of words in repeated five-word windows) or a rule at its stratum's certified cutoff or level rejects. Without labels
    none is certified. A null lang is a stratum of its own. Repeated rows get equal verdicts.
    """
    feats = cut(features(docs))
    own = cutoffs(feats, labels, risk, error).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    chosen = own.join(levels(feats, labels, risk, error), "stratum", "full")
    d = feats.withColumn("stratum", F.coalesce("lang", F.lit(""))).join(chosen, "stratum", "left")
    over = lambda r: F.when(F.col("cuts").isNotNull(), F.col(r) > F.element_at("cuts", F.lit(r))).otherwise(exceeded(r) > F.col("level"))
    d = d.withColumn("rules", F.filter(F.array(*[F.when(over(r), F.lit(r)) for r in GRID]), lambda x: x.isNotNull()))
    return d.select("doc_id", "text_key", *BASE, "base_failed", (~F.col("base_failed") & (F.size("rules") == 0)).alias("kept"), "rules")


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The rows of docs that judge() keeps, with their columns, whatever they are called."""
    bad = judge(docs, labels, risk, error).where("NOT kept").select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    rows, place = aside(docs)
    key = F.xxhash64(F.coalesce(place["text"], F.lit("")))
    return rows.join(bad, F.col(place["doc_id"]).eqNullSafe(F.col("bad_id")) & (key == F.col("bad_key")), "left_anti").select(*back(place))
