"""Column -> Column normalisation of marks, headers, dimensions and rule texts.

Everything is a native expression, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel import vocab as V
from lintel.functions.blocks import ratio

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def strip(c) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def text_of(c) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def any_of(c, phrases) -> Column:
    """True when any phrase occurs as a substring."""
    return col(c).rlike("|".join(re.escape(p) for p in phrases))


def is_blank(c, blanks=V.BLANK_CELL) -> Column:
    return F.upper(strip(text_of(c))).isin(list(blanks))


def words_of(c, punct=V.WORD_PUNCT) -> Column:
    """White-space words with punctuation trimmed from both ends."""
    cls = re.escape(punct)
    return F.transform(F.split(text_of(c), r"\s+"), lambda w: F.regexp_replace(w, f"^[{cls}]+|[{cls}]+$", ""))


def clean_mark(c, noise=V.WATERMARKS) -> Column:
    """Remove stamp words; if nothing is left keep the trimmed original."""
    raw = strip(c)
    bare = F.regexp_replace(raw, r"(?i)\b(?:" + "|".join(noise) + r")\b", "")
    return F.coalesce(F.nullif(strip(F.regexp_replace(bare, r"\s+", " ")), F.lit("")), raw)


def mark_key(c) -> Column:
    return F.upper(strip(c))


def word_key(c) -> Column:
    """Mark key of a plan word: punctuation trimmed, then upper case."""
    c, cls = col(c), re.escape(V.WORD_PUNCT)
    # The pattern's end also stands before a last line break; texts without one are trimmed, which is many times faster.
    broken = reduce(or_, [c.contains(b) for b in "\n\r\u0085\u2028\u2029"])
    return F.upper(F.when(broken, F.regexp_replace(c, f"^[{cls}]+|[{cls}]+$", "")).otherwise(F.btrim(c, F.lit(V.WORD_PUNCT))))


def mark_alnum(c) -> Column:
    return F.regexp_replace(F.upper(col(c)), "[^A-Z0-9]", "")


def opening_mode_code(c) -> Column:
    pairs = [(s, code) for code, names in V.MODE_SYNONYMS.items() for s in names]
    table = F.create_map(*[F.lit(x) for p in pairs for x in p])
    return F.coalesce(F.element_at(table, mark_key(c)), F.lit("SGL"))


def floor_name(c) -> Column:
    bare = strip(c)
    low = F.lower(bare)
    return F.when(low.isin(V.STILT_ALIASES) | low.startswith("stilt"), F.lit("Ground Floor")).otherwise(bare)


def imperial_to_m(c) -> Column:
    """Feet-and-inches text to metres, four decimals; unreadable text is 0."""
    c = text_of(c)
    feet_re, inch_re = r"(\d+(?:\.\d+)?)\s*'", r'(\d+)?\s*(?:(\d+)/(\d+))?\s*"'
    rest = F.regexp_replace(c, feet_re, "")

    def num(group):
        return F.regexp_extract(rest, inch_re, group).try_cast("double")

    inches = F.coalesce(num(1), F.lit(0.0)) + F.coalesce(num(2) / F.nullif(num(3), F.lit(0.0)), F.lit(0.0))
    feet = F.coalesce(F.regexp_extract(c, feet_re, 1).try_cast("double"), F.lit(0.0))
    return F.round(feet * F.lit(V.FOOT_M) + inches * F.lit(V.INCH_M), 4)


def width_inches(c) -> Column:
    """Door width in inches; slash-separated leaves are added up, unreadable text is 0."""

    def part(raw):
        p = strip(raw)
        bare = strip(F.regexp_replace(p, '"', ""))
        plain = F.when(bare.rlike(NUMBER), bare.try_cast("double"))
        feet_inch = r"^(\d+)'?\s*-\s*(\d+)\"?$"
        return (
            F.when(
                p.rlike(feet_inch),
                F.regexp_extract(p, feet_inch, 1).try_cast("double") * 12
                + F.regexp_extract(p, feet_inch, 2).try_cast("double"),
            )
            .when(p.rlike(r"^\d+'$"), F.regexp_extract(p, r"^(\d+)'$", 1).try_cast("double") * 12)
            .when(plain <= 10, plain * 12)
            .otherwise(F.coalesce(plain, F.lit(0.0)))
        )

    parts = F.transform(F.split(F.upper(text_of(c)), "/"), part)
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def domain_check(c, allowed, default="UNKNOWN") -> Column:
    return F.when(col(c).isin(list(allowed)), col(c)).otherwise(F.lit(default))


def render_bool(c) -> Column:
    return F.initcap(col(c).cast("string"))


def repair_detail_shift(df: DataFrame) -> DataFrame:
    """Move detail references that drifted into a finish column back to head, jamb and sill."""
    for finish in ("FINISH", "FRAME FINISH"):
        if finish not in df.columns:
            continue
        drift = strip(text_of(F.col(f"`{finish}`"))).rlike(r"^[A-Z0-9]+/[A-Z]\d+")
        head, jamb = F.col("`DETAIL HEAD`"), F.col("`DETAIL JAMB`")
        old_sill = F.col("`DETAIL SILL`") if "DETAIL SILL" in df.columns else F.lit(None).cast("string")
        df = df.withColumns(
            {
                "DETAIL SILL": F.when(drift, text_of(jamb)).otherwise(old_sill),
                "DETAIL JAMB": F.when(drift, text_of(head)).otherwise(jamb),
                "DETAIL HEAD": F.when(drift, strip(F.col(f"`{finish}`"))).otherwise(head),
                finish: F.when(drift, F.lit("")).otherwise(F.col(f"`{finish}`")),
            }
        )
    return df


def bucket_color(c, colors=None) -> Column:
    table = F.create_map(*[F.lit(x) for p in (colors or V.BUCKET_COLORS).items() for x in p])
    return F.coalesce(F.element_at(table, col(c)), F.element_at(table, F.lit("Interior")))


def annotation_color(mode, int_ext, rating, excluded) -> Column:
    mode, side, rating = mark_key(text_of(mode)), mark_key(text_of(int_ext)), mark_key(text_of(rating))
    bucket = (
        F.when(
            (side == "NOT IN SCOPE") | F.coalesce(col(excluded), F.lit(False)) | (mode == "STOREFRONT")
            | any_of(rating, ["STOREFRONT", "BARRIER"]),
            "Not in Scope",
        )
        .when((side == "SOFT EXTERIOR") | any_of(rating, V.ANNOTATION_SOFT), "Soft Exterior")
        .when(side.isin("WINDOW", "SIDELITE", "BORROWED LITE") | any_of(rating, V.ANNOTATION_WINDOW), "Window")
        .when(side.contains("EXT") | any_of(rating, ["EXTERIOR", "PARTITION"]), "Exterior")
        .otherwise("Interior")
    )
    return bucket_color(bucket)


def spec_notes(excl, defaults, feats) -> Column:
    """One line from exclusions (array), defaults (map) and special features (array)."""
    filled = F.map_filter(col(defaults), lambda k, v: F.coalesce(v, F.lit("")) != "")
    pairs = F.transform(F.map_entries(filled), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))

    def labelled(label, arr, sep):
        return F.when(F.size(arr) > 0, F.concat(F.lit(label), F.array_join(arr, sep)))

    return F.concat_ws(
        " | ",
        labelled("Exclusions: ", col(excl), ", "),
        labelled("Defaults: ", pairs, ", "),
        labelled("Spec Rules: ", col(feats), "; "),
    )


def aluminium_or_glass(material) -> Column:
    m = F.upper(text_of(material))
    return any_of(m, V.NOTE_MATERIAL) | F.arrays_overlap(
        F.split(m, r"\s+"), F.array(*[F.lit(w) for w in V.NOTE_MATERIAL_WORDS])
    )


def estimator_notes(material, notes) -> Column:
    hit = aluminium_or_glass(material)
    excluded = hit & F.upper(text_of(notes)).contains("EXCLUDE")
    return F.concat_ws(
        " | ", F.when(hit, F.lit(V.NOTE_ALUMINIUM)), F.when(excluded, F.lit(V.NOTE_ALUMINIUM_EXCLUDED))
    )


def floor_from_mark(c) -> Column:
    return F.regexp_extract(col(c), "([0-9])", 1)


def mark_taxonomy(c, prefixes) -> Column:
    """Building, floor and unit-type flag read from a mark; ``prefixes`` maps letter -> building."""
    m = mark_key(c)
    table = F.create_map(*[F.lit(x) for p in prefixes.items() for x in p])
    building = F.coalesce(F.element_at(table, F.nullif(F.regexp_extract(m, "^([A-Z])", 1), F.lit(""))), F.lit("unclear"))
    floor = F.coalesce(F.nullif(F.regexp_extract(m, r"^([0-9])[0-9]{2}", 1), F.lit("")), F.lit("unclear"))
    return F.struct(building.alias("building"), floor.alias("floor"), m.rlike(r"^U[0-9]").alias("is_unit_type"))


def imperial_flag(c) -> Column:
    return text_of(c).rlike(r"[0-9]\s*['\"]")


def metric_flag(c) -> Column:
    return F.lower(text_of(c)).rlike(r"[0-9]\s*mm\b")


def unit_system(cells: DataFrame, key=("project_id",), title=None) -> DataFrame:
    """Imperial when any feet/inch notation occurs, metric when only mm; a stated title wins."""
    seen = cells.groupBy(*key).agg(
        F.bool_or(imperial_flag("value")).alias("_imp"), F.bool_or(metric_flag("value")).alias("_met")
    )
    inferred = F.when(F.col("_imp"), "imperial").when(F.col("_met"), "metric").otherwise("unclear")
    if title is None:
        return seen.select(*key, inferred.alias("unit_system"))
    return seen.join(title, list(key), "left").select(
        *key, F.coalesce(F.col("stated_unit"), inferred).alias("unit_system")
    )


def mechanism(c) -> Column:
    t = F.lower(text_of(c))
    return (
        F.when(t.rlike("pocket|barn"), "sliding")
        .when(t.rlike("overhead|coiling|roll-up"), "overhead")
        .when(t.contains("bi-fold"), "bi-fold")
        .otherwise("swing")
    )


# Instruction patterns: parameter, pattern, unit families with their metre factor and decimals.
COMMANDS = [
    ("outer_wall.thickness_m", r"(?:wall\s+thickness|outer\s+wall)\s+(?:to|is)\s+([\d\.]+)\s*(inch|inches|mm|m)?",
     {"inch": (0.0254, 3), "mm": (0.001, 3)}),
    ("floor_height_m", r"floor\s+height\s+(?:to|is)\s+([\d\.]+)\s*(m|ft|feet|foot)?",
     {"ft": (0.3048, 2), "feet": (0.3048, 2), "foot": (0.3048, 2)}),
    ("foundation_depth_m", r"(?:footing|foundation)\s+depth\s+(?:to|is)\s+([\d\.]+)\s*(m|ft|feet)?",
     {"ft": (0.3048, 2), "feet": (0.3048, 2)}),
    ("num_floors", r"(?:number\s+of\s+floors|num\s+floors|floors\s+count)\s+(?:to|is)\s+(\d+)", {}),
]


def command_extract(df: DataFrame, text_col: str) -> DataFrame:
    """Adds parameter, raw_value, unit and value; the first pattern that matches wins."""
    t = F.lower(F.col(text_col))
    name = raw = unit = value = None
    for parameter, pattern, families in COMMANDS:
        hit = t.rlike(pattern)
        number = F.regexp_extract(t, pattern, 1)
        word = F.regexp_extract(t, pattern, 2) if families else F.lit("")
        metres = number.try_cast("double")
        for stem, (factor, digits) in reversed(families.items()):
            scaled = F.round(number.try_cast("double") * F.lit(factor), digits)
            metres = F.when(word.contains(stem), scaled).otherwise(metres)
        shown = F.when(word == "", F.lit("m" if families else "")).otherwise(word)
        if name is None:
            name, raw, unit, value = (F.when(hit, x) for x in (F.lit(parameter), number, shown, metres))
        else:
            name, raw = name.when(hit, F.lit(parameter)), raw.when(hit, number)
            unit, value = unit.when(hit, shown), value.when(hit, metres)
    return df.withColumns({"parameter": name, "raw_value": raw, "unit": unit, "value": value})


def interior_override(int_ext, location) -> Column:
    inside = (col(int_ext) == "Exterior") & any_of(F.upper(text_of(location)), V.INTERIOR_WORDS)
    return F.when(inside, "Interior").otherwise(col(int_ext))


def is_mark_text(c) -> Column:
    c = text_of(c)
    tokens = F.split(F.regexp_replace(F.lower(c), r"^[.,]+|[.,]+$", ""), r"\s+")
    header = F.exists(tokens, lambda w: w.isin(V.HEADER_WORDS))
    shape = c.rlike("[0-9]") | ((F.length(c) <= 4) & c.rlike("[A-Z]") & (c == F.upper(c)))
    return shape & ~header & ~c.rlike("['\"]")


def sf_material(c) -> Column:
    m = mark_key(text_of(c))
    tokens = F.split(m, "[^A-Z0-9]+")
    hit = F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in V.STOREFRONT_TOKENS]))
    return ~m.isin(V.BLANK_STOREFRONT) & (hit | any_of(m, ["AL/GL", "GL/AL"]))


def similarity(a, b, method="blocks") -> Column:
    """0..1 likeness: the published ratio by matching ``blocks``, or by ``edit`` distance over the longer text."""
    a, b = mark_key(a), mark_key(b)
    if method == "blocks":
        return ratio(a, b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest)


def overlay_maps(base, over) -> Column:
    """Keys of ``over`` that are filled in replace those of ``base``."""
    return F.map_zip_with(col(base), col(over), lambda k, x, y: F.coalesce(F.nullif(y, F.lit("")), x))


def field_fallback(primary: DataFrame, *others: DataFrame, on) -> DataFrame:
    """First filled value per column: primary, then each other frame, joined on ``on``."""
    on = [on] if isinstance(on, str) else list(on)
    fields = [c for c in primary.columns if c not in on]
    names = fields + [c for o in others for c in o.columns if c not in on and c not in fields]
    names = list(dict.fromkeys(names))
    joined, sources = primary.select(*on, *[F.col(c).alias(f"_0_{c}") for c in fields]), {c: [] for c in names}
    for c in fields:
        sources[c].append(f"_0_{c}")
    for i, o in enumerate(others, 1):
        cols = [c for c in o.columns if c not in on]
        joined = joined.join(o.select(*on, *[F.col(c).alias(f"_{i}_{c}") for c in cols]), on, "full_outer")
        for c in cols:
            sources[c].append(f"_{i}_{c}")
    return joined.select(
        *on, *[F.coalesce(*[F.nullif(F.col(s).cast("string"), F.lit("")) for s in sources[c]]).alias(c) for c in names]
    )


def in_margin(x, y, w, h, frac=0.10) -> Column:
    """True inside the central part of the page."""
    return col(x).between(col(w) * frac, col(w) * (1 - frac)) & col(y).between(col(h) * frac, col(h) * (1 - frac))


def drop_unmarked(df: DataFrame, mark="mark", blacklist=V.HEADER_LIKE_MARKS) -> DataFrame:
    key = F.lower(strip(text_of(mark)))
    return df.where((key != "") & ~key.isin(list(blacklist)))
