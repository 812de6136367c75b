"""Reconciling joins: presence, attachment, expansion, fuzzy and text matches.

No join is hinted. Small sides are broadcast by Spark from their measured size; large ones
shuffle on their keys, where adaptive execution can split a hot key because every join that
keeps unmatched rows is written as an inner join plus an anti join on distinct keys.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel import vocab as V
from lintel.functions import text as T


def _list(x):
    return [x] if isinstance(x, str) else list(x)


def orphans(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    on = _list(on)
    return left.select(*on).distinct().join(right.select(*on).distinct(), on, "left_anti")


def presence(dfs: dict[str, DataFrame], on) -> DataFrame:
    """One row per key with ``in_<track>`` flags; a single shuffle with map-side combine."""
    on = _list(on)
    names = list(dfs)
    tagged = [
        df.select(*on, *[F.lit(n == name).alias(f"in_{n}") for n in names]) for name, df in dfs.items()
    ]
    union = reduce(lambda a, b: a.unionByName(b), tagged)
    return union.groupBy(*on).agg(*[F.bool_or(f"in_{n}").alias(f"in_{n}") for n in names])


def exclusion_audit(schedule: DataFrame, exclusions: DataFrame, material="first_material", key=("project_id",)) -> DataFrame:
    """Each aluminium exclusion with each aluminium or glass row of the same project."""
    key = _list(key)
    texts = exclusions.where(T.any_of(F.lower("exclusion"), V.ALUMINIUM_EXCLUSION)).select(*key, "exclusion")
    rows = schedule.where(T.any_of(F.upper(T.text_of(material)), V.ALUMINIUM_MATERIAL)).select(*key, "mark")
    return rows.join(texts, key).select(
        *key,
        F.lit("aluminium_exclusion_flag").alias("type"),
        F.upper("mark").alias("mark"),
        F.concat(
            F.lit("Specification Exclusion Audit: '"), "exclusion",
            F.lit("'. Verify if this opening should be removed from scope."),
        ).alias("context"),
    )


def _attach(left, right, on, order, pick):
    on, order = _list(on), _list(order)
    cols = [c for c in right.columns if c not in on]
    best = right.groupBy(*on).agg(pick(F.struct(*cols), F.struct(*order)).alias("_best"))
    return left.join(best, on, "left").select(
        *left.columns, *[F.col(f"_best.{c}").alias(c) for c in cols], F.col("_best").isNotNull().alias("located")
    )


def attach_first(left: DataFrame, right: DataFrame, on, order) -> DataFrame:
    """Left rows with the first right row per key. Aggregates before it joins."""
    return _attach(left, right, on, order, F.min_by)


def attach_last(left: DataFrame, right: DataFrame, on, order) -> DataFrame:
    return _attach(left, right, on, order, F.max_by)


def expand_instances(schedule: DataFrame, det: DataFrame, marks=("mark", "original_mark"), key=("project_id",)) -> DataFrame:
    """Each schedule row with all its detections (qty 1), or once with qty 0 when none exists."""
    key = _list(key)
    names = F.array_distinct(F.filter(F.array(*[T.mark_key(T.text_of(m)) for m in marks]), lambda m: m != ""))
    rows = schedule.withColumn("_marks", names)
    det_cols = [c for c in det.columns if c not in key and c != "mark"]
    plan = det.withColumnRenamed("mark", "_mark")
    # Names of one row are distinct, so a detection can meet a row only once.
    hits = rows.withColumn("_mark", F.explode("_marks")).join(plan, [*key, "_mark"])
    found = hits.select(*schedule.columns, *det_cols, F.lit(1).alias("qty"))
    known = plan.select(*key, "_mark").distinct()
    seen = rows.select(*key, "_marks").distinct().withColumn("_mark", F.explode("_marks"))
    seen = seen.join(known, [*key, "_mark"], "left_semi").select(*key, "_marks").distinct()
    lost = rows.join(seen, [*key, "_marks"], "left_anti").select(*schedule.columns, F.lit(0).alias("qty"))
    return found.unionByName(lost, allowMissingColumns=True)


def lookup_with_fallback(det: DataFrame, rows: DataFrame, mark="mark", original="original_tag", key=("project_id",), value="value", order="row_no") -> DataFrame:
    """Value of the row with this mark, else of the first row split from it (``mark.1`` ...)."""
    key = _list(key)
    name = F.col(mark)
    stem = F.when(name.contains("."), F.substring_index(name, ".", 1))
    picks = F.array(
        F.struct(F.lit(0).alias("p"), name.alias("m")),
        F.struct(F.lit(1).alias("p"), F.col(original).alias("m")),
        F.struct(F.lit(1).alias("p"), stem.alias("m")),
    )
    keyed = rows.select(*key, F.col(value).alias("_v"), F.col(order).alias("_o"), F.explode(picks).alias("k"))
    best = (
        keyed.where("k.m is not null and k.m <> ''")
        .groupBy(*key, F.col("k.m").alias(mark))
        .agg(F.min_by("_v", F.struct("k.p", "_o")).alias(value))
    )
    return det.join(best, [*key, mark], "left")


# Whole-string swaps tried after the exact reading, in order.
OCR_SWAPS = [("0O", "C"), ("C", "0"), ("O", "0"), ("8", "B"), ("B", "8")]


def confusion_join(words: DataFrame, marks: DataFrame, on="text", variants=None, key=("project_id",), word_id=("word_id",)) -> DataFrame:
    """Words read as a mark, exactly or after a character swap; the first reading that fits wins."""
    key, word_id = _list(key), _list(word_id)
    variants = OCR_SWAPS if variants is None else variants
    keyed = words.select(*key, *word_id, T.word_key(on).alias("_raw"))
    # The same text is read once however often it is printed.
    texts = keyed.select(*key, "_raw").distinct()
    raw = F.col("_raw")
    readings = [raw, *[F.translate(raw, old, new * len(old)) for old, new in variants]]
    tries = [F.struct(F.lit(i).alias("priority"), reading.alias("mark")) for i, reading in enumerate(readings)]
    spread = texts.select(*key, "_raw", F.explode(F.array(*tries)).alias("t")).select(*key, "_raw", "t.priority", "t.mark")
    spread = spread.where((F.col("priority") == 0) | (F.col("mark") != raw))
    known = marks.select(*key, T.mark_key("mark").alias("mark")).distinct()
    # The priority tells the reading, so the numbers alone are aggregated: Spark would sort rows for texts.
    best = spread.join(known.hint("shuffle_hash"), [*key, "mark"]).groupBy(*key, "_raw").agg(F.min("priority").alias("priority"))
    best = best.withColumn("mark", F.element_at(F.array(*readings), F.col("priority") + 1))
    # One row per word id, also where several printed words share one. Rows move before they are sorted, and sort by a number.
    found = keyed.join(best.hint("shuffle_hash"), [*key, "_raw"]).select(*key, *word_id, "mark", "priority").repartition(*key, *word_id)
    return (
        found.groupBy(F.xxhash64(*word_id).alias("_id"), *key, *word_id)
        .agg(F.min_by("mark", "priority").alias("mark"), F.min("priority").alias("priority"))
        .drop("_id")
    )


#: Letters of the pieces that containment is looked up by.
GRAM = 3


def _grams(text: str, size) -> Column:
    """The different pieces of ``size`` letters of a text."""
    places = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.array_distinct(F.transform(places, lambda i: F.substr(F.col(text), i, F.lit(size) if isinstance(size, int) else size)))


def containing_candidates(inner: DataFrame, outer: DataFrame, key, within="_in", around="_out") -> DataFrame:
    """(key, within, the hash of around) of the texts that share the least common piece of an inner text.

    Inner texts (not empty) are filed under the one of their pieces that fewest outer texts hold; an outer text probes with all
    of its own, of GRAM letters and, for inner texts shorter than that, of one and two. An inner text with
    a piece that no outer text holds is filed nowhere. Long texts travel as their hash.
    """
    name = F.xxhash64(around).alias("_o")
    sizes = F.filter(F.array(*[F.when(F.length(around) >= n, _grams(around, n)) for n in range(1, GRAM + 1)]), lambda g: g.isNotNull())
    probes = outer.select(*key, name, F.explode(F.flatten(sizes)).alias("_g"))
    common = probes.groupBy(*key, "_g").agg(F.count(F.lit(1)).alias("_n"))
    pieces = inner.select(*key, within, _grams(within, F.least(F.length(within), F.lit(GRAM))).alias("_gs"))
    pieces = pieces.select(*key, within, F.size("_gs").alias("_all"), F.explode("_gs").alias("_g"))
    filed = pieces.join(common, [*key, "_g"]).groupBy(*key, within, "_all").agg(F.count(F.lit(1)).alias("_held"), F.min_by("_g", F.struct("_n", "_g")).alias("_g"))
    return filed.where("_held = _all").select(*key, within, "_g").join(probes, [*key, "_g"]).select(*key, within, "_o")


def containing(inner: DataFrame, outer: DataFrame, key, within="_in", around="_out") -> DataFrame:
    """(key, within, around) of every inner text that stands in an outer one."""
    pairs = containing_candidates(inner, outer, key, within, around)
    found = pairs.join(outer.select(*key, around, F.xxhash64(around).alias("_o")), [*key, "_o"])
    return found.where(F.col(around).contains(F.col(within))).select(*key, within, around)


def contains_join(texts: DataFrame, marks: DataFrame, key=("project_id",), text="text", text_id="text_id") -> DataFrame:
    """Best mark per text: equal, inside the text, or around it; then the longest.

    Both directions look up the rarest piece of the inner text (see :func:`containing_candidates`).
    """
    key = _list(key)
    t = texts.select(*key, text_id, F.col(text).alias("_t")).where("_t <> ''")
    distinct_texts = t.select(*key, "_t").distinct()
    m = marks.select(*key, F.col("mark")).where("mark <> ''").distinct()
    inside = containing(m, distinct_texts, key, "mark", "_t")
    around = containing(distinct_texts, m, key, "_t", "mark").where("_t <> mark")
    best = (
        inside.unionByName(around)
        .groupBy(*key, "_t")
        .agg(
            F.min_by(
                "mark",
                F.struct((F.col("mark") != F.col("_t")).cast("int"), -F.length("mark"), F.col("mark")),
            ).alias("mark")
        )
    )
    return t.join(best, [*key, "_t"]).select(*key, text_id, F.col("_t").alias(text), "mark")


def mark_in_text(docs: DataFrame, marks: DataFrame, keywords=V.STOREFRONT_SENTENCE, key=("project_id",), text="text") -> DataFrame:
    """Marks standing as a word in a sentence that also has a keyword."""
    key = _list(key)
    sentence = (
        docs.select(*key, F.explode(F.split(F.col(text), r"[.\n]")).alias("_s"))
        .select(*key, F.upper(T.strip("_s")).alias("_s"))
        .where(T.any_of("_s", keywords))
    )
    words = T.words_of(F.replace(F.col("_s"), F.lit(","), F.lit(" ")), V.SENTENCE_PUNCT)
    tokens = sentence.select(*key, F.explode(words).alias("mark")).where("mark <> ''").distinct()
    return marks.select(*key, "mark").distinct().join(tokens, [*key, "mark"], "left_semi")


def audit(rows: DataFrame, audit_marks: DataFrame, page=("project_id", "page_id")) -> DataFrame:
    """Flags rows a second extraction pass did not confirm, where that pass returned anything."""
    page = _list(page)
    seen = audit_marks.select(*page, T.mark_alnum(T.text_of("mark")).alias("_k")).where("_k <> ''").distinct()
    pages = seen.select(*page).distinct().withColumn("_ran", F.lit(True))
    return (
        rows.withColumn("_k", T.mark_alnum(T.text_of("mark")))
        .join(seen.withColumn("_seen", F.lit(True)), [*page, "_k"], "left")
        .join(pages, page, "left")
        .withColumn("needs_review", F.col("_ran").isNotNull() & F.col("_seen").isNull())
        .drop("_k", "_seen", "_ran")
    )


#: Edits up to which texts meet on what deletions leave of them.
DELETIONS = 2


def _deletions(text, most: int):
    """What is left of a text after up to ``most`` deletions."""
    less = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1)))
    out = level = F.array(text)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(F.filter(level, lambda t: F.length(t) > 0), less)))
        out = F.concat(out, level)
    return F.array_distinct(out)


def _close_candidates(parts: DataFrame, words: DataFrame, key, short=True) -> DataFrame:
    """(key, part, _w) of all pairs no more edits apart than both allow (``_k``), and some others.

    Up to two edits: texts that far apart leave a common text after as many deletions in each. More, where a part has more than
    GRAM k pieces of GRAM letters: k edits leave one whole, shifted by k places at most, and the rarest one left whole
    is among the GRAM k + 1 rarest of both texts. Short parts with many edits allowed, which nearly everything
    resembles: of k + 1 consecutive stretches, of GRAM letters at most, one stays whole, shifted by k places at most;
    ``short`` says whether such parts can be there.
    """
    part, word = (df.select(*key, F.col(c).alias("_t"), "_k") for df, c in ((parts, "part"), (words, "_w")))
    few, pieced = F.col("_k") <= DELETIONS, F.length("_t") - GRAM + 1 > GRAM * F.col("_k")
    left_over = F.when(F.col("_k") <= 0, F.array("_t")).when(F.col("_k") == 1, _deletions(F.col("_t"), 1)).otherwise(_deletions(F.col("_t"), DELETIONS))
    a, b = (df.select(*key, F.col("_t").alias(c), F.explode(left_over).alias("_g")) for df, c in ((part.where(few), "part"), (word, "_w")))
    near = a.join(b, [*key, "_g"]).select(*key, "part", "_w")

    def pieces(df):
        places = F.sequence(F.lit(1), F.length("_t") - GRAM + 1)
        each = F.explode(F.transform(places, lambda i: F.struct(F.substr(F.col("_t"), i, F.lit(GRAM)).alias("g"), i.alias("at"))))
        return df.where(F.length("_t") >= GRAM).select(*key, "_t", "_k", each.alias("p"))

    rarity = pieces(word).groupBy(*key, F.col("p.g").alias("_g")).agg(F.count_distinct("_t").alias("_n"))

    def rarest(df, name):
        ranked = pieces(df).withColumn("_g", F.col("p.g")).join(rarity, [*key, "_g"], "left")
        order = F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_g").alias("g"), F.col("p.at").alias("at"))
        kept = ranked.groupBy(*key, "_t", "_k").agg(F.slice(F.array_sort(F.collect_list(order)), F.lit(1), GRAM * F.col("_k") + 1).alias("ps"))
        return kept.select(*key, F.col("_t").alias(name), F.col("_k").alias(f"_k{name}"), F.explode("ps").alias("p")).select(*key, name, f"_k{name}", F.col("p.g").alias("_g"), F.col("p.at").alias(f"_at{name}"))

    a, b = rarest(part.where(~few & pieced), "part"), rarest(word, "_w")
    far = a.join(b, [*key, "_g"]).where(F.abs(F.col("_atpart") - F.col("_at_w")) <= F.least("_kpart", "_k_w")).select(*key, "part", "_w")

    n, k = F.length("_t"), F.col("_k")

    def stretch(i):
        lo, hi = F.floor(i * n / (k + 1)).cast("int"), F.floor((i + 1) * n / (k + 1)).cast("int")
        return F.struct(lo.alias("at"), F.substring(F.col("_t"), lo + 1, hi - lo).alias("g"))

    cut = part.where(~few & ~pieced).select(*key, "_t", "_k", F.explode(F.transform(F.sequence(F.lit(0), k), stretch)).alias("p"))
    cut = cut.select(*key, F.col("_t").alias("part"), F.col("p.g").alias("_g"), F.explode(F.expr("sequence(p.at - _k, p.at + _k)")).alias("_at"))
    places = F.sequence(F.lit(1), F.length("_t"))
    held = word.select(*key, F.col("_t").alias("_w"), F.posexplode(F.transform(places, lambda i: F.array(*[F.substr(F.col("_t"), i, F.lit(n)) for n in range(1, GRAM + 1)]))).alias("_at", "_gs"))
    held = held.select(*key, "_w", "_at", F.explode(F.array_distinct("_gs")).alias("_g"))
    loose = cut.join(held, [*key, "_g", "_at"]).select(*key, "part", "_w")
    return (near.unionByName(far).unionByName(loose) if short else near.unionByName(far)).distinct()


def fuzzy_best(left: DataFrame, right: DataFrame, min_ratio=0.8, key=("project_id",), name="name", name_id="name_id", word="text", word_id="word_id") -> DataFrame:
    """Best word for each name part of three letters or more, by edit distance above ``min_ratio``.

    Pairs meet on what deletions leave of them, or on their rarest pieces (see :func:`_close_candidates`), and are scored once.
    """
    key = _list(key)
    parts = (
        left.select(*key, name_id, F.posexplode(F.split(F.upper(T.strip(name)), r"\s+")).alias("part_no", "part"))
        .where(F.length("part") >= 3)
    )
    words = right.select(*key, F.upper(T.strip(word)).alias("_w"), word_id).where("_w <> ''")
    best_id = words.groupBy(*key, "_w").agg(F.min(word_id).alias(word_id))

    # ratio > r means distance < (1 - r) * longest, and longest is below n / r.
    def edits(c):
        return F.floor((F.lit(1.0) - F.lit(min_ratio)) * F.ceil(F.length(c) / F.lit(min_ratio)) + F.lit(1e-9)).cast("int")

    uniq_part = parts.select(*key, "part").distinct().withColumn("_k", edits("part"))
    allowed = [(n, math.floor((1 - min_ratio) * math.ceil(n / min_ratio) + 1e-9)) for n in range(3, 2000)]
    short = any(k > DELETIONS and n - GRAM + 1 <= GRAM * k for n, k in allowed)
    pairs = _close_candidates(uniq_part, best_id.select(*key, "_w").withColumn("_k", edits("_w")), key, short)
    ratio = F.lit(1.0) - F.levenshtein("part", "_w") / F.greatest(F.length("part"), F.length("_w"))
    best = (
        pairs.withColumn("ratio", ratio)
        .where(F.col("ratio") > min_ratio)
        .groupBy(*key, "part")
        .agg(F.min_by(F.struct("_w", "ratio"), F.struct(-F.col("ratio"), F.col("_w"))).alias("b"))
        .select(*key, "part", F.col("b._w").alias(word), "b.ratio")
    )
    hit = best.join(best_id.withColumnRenamed("_w", word), [*key, word])
    return parts.join(hit, [*key, "part"]).select(*key, name_id, "part_no", "part", word, word_id, "ratio")


def merge_boxes(hits: DataFrame, key, pad=0.01) -> DataFrame:
    """Union of boxes per key, padded and clamped to the page."""
    return hits.groupBy(*_list(key)).agg(
        F.greatest(F.lit(0.0), F.min("x0") - pad).alias("x0"),
        F.greatest(F.lit(0.0), F.min("y0") - pad).alias("y0"),
        F.least(F.lit(1.0), F.max("x1") + pad).alias("x1"),
        F.least(F.lit(1.0), F.max("y1") + pad).alias("y1"),
    )


def floor_name_for(det: DataFrame, floors: DataFrame, key=("project_id",)) -> DataFrame:
    """Floor name by drawing url, else by position, else ``Level n``."""
    key = _list(key)
    urls = floors.where("url is not null").select(*key, F.col("url").alias("drawing_url"), F.col("name").alias("_by_url"))
    urls = urls.groupBy(*key, "drawing_url").agg(F.min("_by_url").alias("_by_url"))
    index = floors.groupBy(*key, F.col("floor_no")).agg(F.min("name").alias("_by_no"))
    return (
        det.join(urls, [*key, "drawing_url"], "left")
        .join(index, [*key, "floor_no"], "left")
        .withColumn(
            "floor_name",
            F.coalesce("_by_url", "_by_no", F.concat(F.lit("Level "), F.col("floor_no").cast("string"))),
        )
        .drop("_by_url", "_by_no")
    )


def reconcile_totals(stated: DataFrame, extracted: DataFrame, on, value="total") -> DataFrame:
    """Stated against extracted totals with delta; ``match`` is NULL where nothing was stated."""
    on = _list(on)
    s = stated.groupBy(*on).agg(F.sum(value).alias("stated_total"))
    e = extracted.groupBy(*on).agg(F.sum(value).alias("extracted_total"))
    got = F.coalesce(F.col("extracted_total"), F.lit(0))
    return s.join(e, on, "full_outer").select(
        *on,
        "stated_total",
        got.alias("extracted_total"),
        (got - F.col("stated_total")).alias("delta"),
        (got == F.col("stated_total")).alias("match"),
    )


def coverage(a: DataFrame, b: DataFrame, on, names=("schedule", "plan")) -> DataFrame:
    return presence({names[0]: a, names[1]: b}, on)


def three_way(dfs: dict[str, DataFrame], on, value="n") -> DataFrame:
    """Keys whose value differs between the sources (a source without the key counts as 0)."""
    on = _list(on)
    names = list(dfs)
    union = reduce(
        lambda a, b: a.unionByName(b),
        [df.select(*on, *[(F.col(value) if n == name else F.lit(0)).cast("bigint").alias(n) for n in names]) for name, df in dfs.items()],
    )
    wide = union.groupBy(*on).agg(*[F.sum(n).alias(n) for n in names])
    return wide.where(reduce(lambda a, b: a | b, [F.col(names[0]) != F.col(n) for n in names[1:]])).withColumn(
        "status", F.lit("VERIFY")
    )


def reconcile_qty(plan: DataFrame, schedule: DataFrame, on) -> DataFrame:
    """Plan quantity against schedule quantity per tag."""
    on = _list(on)
    p = plan.select(*on, F.col("qty").alias("plan_qty"), F.lit(0).cast("bigint").alias("schedule_qty"))
    s = schedule.select(*on, F.lit(0).cast("bigint").alias("plan_qty"), F.col("qty").alias("schedule_qty"))
    both = p.unionByName(s).groupBy(*on).agg(
        F.sum("plan_qty").alias("plan_qty"), F.sum("schedule_qty").alias("schedule_qty")
    )
    return both.withColumn(
        "status", F.when(F.col("plan_qty") == F.col("schedule_qty"), "VERIFIED").otherwise("VERIFY")
    )


def usable_sheets(df: DataFrame, category="drawing_category") -> DataFrame:
    return df.where(F.col(category) != "NOT_APPLICABLE")
