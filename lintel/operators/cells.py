"""Schedule rows with arbitrary headers, kept as long cells (one row per printed cell).

A cell is ``(project_id, table_id, row_no, col_no, header, value, schedule_type)``; a project
may hold several tables, and rows of equal number in two tables are different rows. Everything a rule
needs from a row comes out of one conditional aggregation over its cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel import vocab as V
from lintel.functions import text as T

ROW = ("project_id", "table_id", "row_no")


def to_cells(df: DataFrame, key, columns, schedule_type=None) -> DataFrame:
    """Wide rows -> cells. ``columns`` maps column name -> header (text or Column); NULL cells are left out."""
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("col_no"),
                (h if isinstance(h, Column) else F.lit(h)).alias("header"),
                F.col(f"`{c}`").cast("string").alias("value"),
            )
            for i, (c, h) in enumerate(columns.items())
        ]
    )
    kind = schedule_type if isinstance(schedule_type, Column) else F.lit(schedule_type or "")
    return (
        df.select(*key, kind.alias("schedule_type"), F.explode(entries).alias("e"))
        .where(F.col("e.value").isNotNull())
        .select(*key, "e.col_no", "e.header", "e.value", "schedule_type")
    )


def with_keys(cells: DataFrame) -> DataFrame:
    """Adds the normalised header ``_h`` and value ``_v`` that the conditional aggregates read."""
    return cells.withColumns({"_h": F.lower(T.strip("header")), "_v": T.strip("value")})


def by_row(cells: DataFrame, key=ROW) -> DataFrame:
    """Cells sent to their row, with the keys that its conditional aggregates read.

    Half-made rows of text are sorted by Spark, so aggregating where the cells are made would sort all cells of an
    input file in the one task that reads it; sent first, they are dealt over all tasks.
    """
    return with_keys(cells.repartition(*key))


def _first_match(cells, key, order, exact, fuzzy, out, upper=True):
    """First filled value among exact headers, else among fuzzy ones, in column order."""
    cells, h, value = by_row(cells, key), F.col("_h"), F.col("_v")
    value = F.upper(value) if upper else value
    rank = F.when(h.isin(exact), 0).when(fuzzy(h), 1)
    ranked = F.when(rank.isNotNull() & (value != ""), F.struct(rank.alias("p"), *[F.col(o) for o in order]))
    return cells.groupBy(*key).agg(F.coalesce(F.min_by(value, ranked), F.lit("")).alias(out))


def resolve_mark(cells: DataFrame, key=ROW, order=("col_no",)) -> DataFrame:
    return _first_match(
        cells, key, order, V.MARK_HEADERS,
        lambda h: (h.contains("mark") | h.contains("type")) & ~h.isin(V.NOT_MARK_HEADERS), "mark",
    )


def resolve_location(cells: DataFrame, key=ROW, order=("col_no",)) -> DataFrame:
    return _first_match(
        cells, key, order, V.LOCATION_HEADERS,
        lambda h: (h.contains("location") | h.contains("room")) & ~h.isin(V.NOT_LOCATION_HEADERS), "location", upper=False,
    )


def canonical_header(cells: DataFrame, synonyms=None) -> DataFrame:
    """Adds ``canonical``: the canonical name of a known spelling, else the header in capitals."""
    synonyms = synonyms or V.HEADER_SYNONYMS
    low = F.lower("header")

    def lookup(table):
        return F.element_at(F.create_map(*[F.lit(x) for k, names in table.items() for n in names for x in (n, k)]), low)

    window = {V.WINDOW_HEADER_FOR.get(k, k): names for k, names in synonyms.items()}
    known = F.when(F.col("schedule_type") == "window", lookup(window)).otherwise(lookup(synonyms))
    return cells.withColumn("canonical", F.coalesce(known, F.upper("header")))


def _contains_any(c, words) -> Column:
    return T.any_of(c, words)


def _panel(h, n, other) -> Column:
    words = {1: ("panel 1", "width 1", "first"), 2: ("panel 2", "width 2", "second")}[n]
    return _contains_any(h, words) | h.endswith(f"_{n}") | (h.rlike(rf"\b{n}\b") & ~h.rlike(rf"\b{other}\b"))


def _slash_pair(v) -> Column:
    """``3'-0"/3'-0"``: at least two parts, each with a digit."""
    parts = F.split(v, "/")
    return v.contains("/") & F.forall(parts, lambda p: p.rlike("[0-9]"))


def mode_aggs() -> list[Column]:
    """Conditional aggregates behind :func:`row_opening_mode`."""
    h, raw = F.col("_h"), F.col("_v")
    up = F.upper(raw)
    low = F.lower(raw)
    packed = F.replace(low, F.lit(" "), F.lit(""))
    leaf = F.when(up.isin(V.LEAF_PAIR), "PR").when(up.isin(V.LEAF_SINGLE), "SGL")
    leaf_hit = _contains_any(h, V.LEAF_HEADERS) & leaf.isNotNull()
    width = _contains_any(h, V.WIDTH_HEADERS)
    doubled = _slash_pair(low) | _contains_any(packed, ["x2", "2@", "@2"]) | (low.contains("(") & low.contains("2"))
    sized = _contains_any(h, ["width", "panel", "size"]) & (raw != "")
    first = _panel(h, 1, 2)
    return [
        F.min_by(leaf, F.when(leaf_hit, F.col("col_no"))).alias("_leaf"),
        F.bool_or(width & doubled).alias("_doubled"),
        F.bool_or(sized & first).alias("_p1"),
        F.bool_or(sized & ~first & _panel(h, 2, 1)).alias("_p2"),
    ]


def mode_from_aggs() -> Column:
    return F.coalesce(
        F.col("_leaf"), F.when(F.col("_doubled") | (F.col("_p1") & F.col("_p2")), F.lit("PR")), F.lit("SGL")
    )


def row_opening_mode(cells: DataFrame, key=ROW, order=("col_no",)) -> DataFrame:
    """Leaf-count column, then doubled dimensions, then two filled panels, else single."""
    return by_row(cells, key).groupBy(*key).agg(*mode_aggs()).select(*key, mode_from_aggs().alias("opening_mode"))


def feature_aggs() -> list[Column]:
    """Conditional aggregates behind :func:`row_features`."""
    h, v = F.col("_h"), F.upper("_v")
    filled = ~v.isin(V.BLANK_CELL)
    new = ~v.isin(V.EXISTING)
    panel2 = _contains_any(h, ["panel 2", "width 2", "panel type 2", "second"]) | h.endswith("_2") | (
        h.rlike(r"\b2\b") & ~h.rlike(r"\b1\b")
    )
    width = _contains_any(h, V.WIDTH_HEADERS)
    spoken = _contains_any(h, V.COMMENT_HEADERS + ["type"])
    pair_words = T.any_of(v, V.PAIR_PHRASES) | F.array_contains(T.words_of(v), "PR")
    pair = (
        (_contains_any(h, V.LEAF_HEADERS) & v.isin(V.LEAF_PAIR))
        | (width & _slash_pair(v))
        | (spoken & pair_words)
    )
    door_width = F.when(filled & width & ~h.contains("frame"), F.col("col_no"))
    curtain = v.contains("(CW)") | F.array_contains(F.split(v, "-"), "CW") | F.array_contains(F.split(v, r"\."), "CW")
    material = h.contains("material")
    return [
        F.bool_or(filled & panel2 & new).alias("panel_2"),
        F.bool_or(filled & pair).alias("pair_leaves"),
        F.coalesce(F.max_by(v, door_width), F.lit("")).alias("door_width"),
        F.bool_or(filled & _contains_any(h, V.HARDWARE_HEADERS)).alias("has_hardware"),
        F.bool_or(filled & (material | h.contains("mat'l")) & new).alias("has_material"),
        F.bool_or(filled & _contains_any(h, V.SIDE_HEADERS) & v.contains("EXT")).alias("explicit_exterior"),
        F.bool_or(spoken & v.contains("SINGLE")).alias("explicit_single"),
        F.bool_or(curtain).alias("curtain_wall"),
        F.coalesce(F.min_by(F.upper("value"), F.when(material, F.col("col_no"))), F.lit("")).alias("first_material"),
    ]


def has_panel_2() -> Column:
    wide = T.width_inches("door_width") >= V.WIDE_DOOR_INCHES
    return ~F.col("explicit_single") & (F.col("panel_2") | F.col("pair_leaves") | wide)


def row_features(cells: DataFrame, key=ROW) -> DataFrame:
    return by_row(cells, key).groupBy(*key).agg(*feature_aggs()).withColumn("has_panel_2", has_panel_2())


def role_aggs() -> list[Column]:
    """Material, type and comment roles of a row; the last matching column wins."""
    h, v = F.col("_h"), F.upper("_v")
    mat = _contains_any(h, ["material", "mat'l", "matl"])
    door = (
        _contains_any(h, ["door material", "door mat'l", "door matl", "dr mat"])
        | (_contains_any(h, ["panel 1", "door panel", "panel type"]) & ~h.contains("frame"))
        | (mat & ~h.contains("frame") & ~h.contains("window"))
    )
    frame = _contains_any(h, ["frame material", "frame mat'l", "frame matl", "fr mat"]) | (mat & h.contains("frame"))
    window = mat & (h.contains("window") | h.contains("glazing"))
    dtype = _contains_any(h, ["door type", "dr type", "door design", "door elevation"]) | (
        h.contains("type") & ~h.contains("frame") & ~h.contains("window")
    )
    ftype = _contains_any(h, ["frame type", "fr type", "frame profile", "frame elevation"]) | (
        h.contains("type") & h.contains("frame")
    )
    note = _contains_any(h, V.COMMENT_HEADERS)
    material_role = F.when(door, "door_material").when(frame, "frame_material").when(window, "window_material")
    other_role = F.when(dtype, "door_type").when(ftype, "frame_type").when(note, "comments")

    def last(role_col, role):
        return F.coalesce(F.max_by(v, F.when(role_col == role, F.col("col_no"))), F.lit("")).alias(role)

    return [last(material_role, r) for r in ("door_material", "frame_material", "window_material")] + [
        last(other_role, r) for r in ("door_type", "frame_type", "comments")
    ]


def role_columns(cells: DataFrame, key=ROW) -> DataFrame:
    return by_row(cells, key).groupBy(*key).agg(*role_aggs())


def drop_banners(cells: DataFrame, key=ROW) -> DataFrame:
    """Leave out rows with a single filled cell (section banners)."""
    filled = cells.where(T.strip("value") != "").groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return cells.join(filled.where("_n = 1").select(*key), list(key), "left_anti")


def drop_blank_columns(cells: DataFrame, prefix="COLUMN_", key=("project_id", "table_id")) -> DataFrame:
    """Leave out placeholder columns that are blank in every row of their table."""
    key = [k for k in key if k in cells.columns]
    blank = (
        cells.where(F.col("header").startswith(prefix))
        .groupBy(*key, "header")
        .agg(F.max(F.length("value")).alias("_len"))
        .where("coalesce(_len, 0) = 0")
    )
    return cells.join(blank.select(*key, "header"), [*key, "header"], "left_anti").select(*cells.columns)


def union_rows(*dfs: DataFrame) -> DataFrame:
    """Union of differently shaped rows; columns in first-seen order."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
