"""Totals, unit counts and unit-door matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel import vocab as V


def _list(x):
    return [x] if isinstance(x, str) else list(x)


def section_totals(df: DataFrame, dims=("building", "floor", "section", "mark"), qty="qty") -> DataFrame:
    """Subtotals over a rollup; ``level`` is Spark's grouping id (0 for the finest rows)."""
    return df.rollup(*_list(dims)).agg(F.sum(qty).alias("qty"), F.grouping_id().cast("bigint").alias("level"))


def unit_count(df: DataFrame, unit_type="unit_type", floor="floor", qty="count", building="building") -> DataFrame:
    """Units per type and floor with row, column and building totals; ADA types stay apart.

    Subtotals are told by ``level``, so units without a building are a building of their own.
    """
    fine = df.groupBy(building, unit_type, floor).agg(F.sum(qty).alias("_n"))
    sets = [[building, unit_type, floor], [building, unit_type], [building, floor], [building], []]
    return fine.groupingSets(sets, building, unit_type, floor).agg(
        F.sum("_n").alias("n_units"), F.grouping_id().cast("bigint").alias("level")
    )


def extended_doors(units: DataFrame, per_unit: DataFrame, on=("project_id", "unit_type"), qty="count", doors="per_unit") -> DataFrame:
    """units x doors per unit: (project, unit_type, tag) with row, tag and grand totals."""
    on = _list(on)
    units = units.groupBy(*on).agg(F.sum(qty).alias("qty_units"))
    per_unit = per_unit.groupBy(*on, "tag").agg(F.sum(doors).alias("input"))
    scope, unit = on[:-1], on[-1]
    ext = units.join(per_unit, on).withColumn("extended", F.col("qty_units") * F.col("input"))
    sets = [[*scope, unit, "tag"], [*scope, unit], [*scope, "tag"], list(scope)]
    cols = [F.col(c) for c in (*scope, unit, "tag")]
    return ext.groupingSets(sets, *cols).agg(
        F.sum("extended").alias("extended"), F.grouping_id().cast("bigint").alias("level")
    )


def project_matrix(unit_mix: DataFrame, doors: DataFrame, per_unit: DataFrame | None) -> DataFrame:
    """Unit-door matrix in long form; one door per unit where no input is given, marked INFERRED."""
    units = unit_mix.groupBy("project_id", "unit_type").agg(F.sum("count").alias("qty_units"))
    tags = doors.select("project_id", F.col("mark").alias("tag")).distinct()
    grid = units.join(tags, "project_id")
    if per_unit is not None:
        given = per_unit.groupBy("project_id", "unit_type", "tag").agg(F.sum("per_unit").alias("_in"))
        grid = grid.join(given, ["project_id", "unit_type", "tag"], "left")
    else:
        grid = grid.withColumn("_in", F.lit(None).cast("bigint"))
    return grid.withColumns(
        {
            "input": F.coalesce("_in", F.lit(1)),
            "extended": F.col("qty_units") * F.coalesce("_in", F.lit(1)),
            "basis": F.when(F.col("_in").isNull(), "INFERRED").otherwise("CALCULATED"),
        }
    ).drop("_in")


def expand_layout(df: DataFrame, layout="layout", floors="n_floors", matrix: DataFrame | None = None, key=("project_id", "building", "unit_type")) -> DataFrame:
    """Openings per sheet times what the sheet's layout stands for, by building and type.

    ``matrix`` gives ``occurrences`` per ``key`` for unit-type sheets; without it a sheet counts once.
    """
    key = _list(key)
    if matrix is not None:
        occ = matrix.groupBy(*key).agg(F.sum("occurrences").alias("_occ"))
        df = df.join(occ, key, "left")
    else:
        df = df.withColumn("_occ", F.lit(None).cast("bigint"))
    times = (
        F.when(F.col(layout) == "TYPICAL_REPEATED", F.col(floors))
        .when(F.col(layout) == "UNIT_TYPE_REPEATED", F.coalesce("_occ", F.lit(1)))
        .otherwise(F.lit(1))
    )
    return df.groupBy("project_id", "building", "type").agg(F.sum(F.col("count") * times).alias("total"))


def unit_door_pivot(long: DataFrame, tags, row="unit_type", key=("project_id",)) -> DataFrame:
    """Input and Extended column per tag, in tag order, with the row total; repeated inputs of a tag add up."""
    wide = long.groupBy(*_list(key), row).pivot("tag", list(tags)).agg(
        F.sum("input").alias("Input"), F.sum("extended").alias("Extended")
    )
    cells = [(f"{t}_{k}", F.coalesce(F.col(f"`{t}_{k}`"), F.lit(0))) for t in tags for k in ("Input", "Extended")]
    total = sum((F.coalesce(F.col(f"`{t}_Extended`"), F.lit(0)) for t in tags), F.lit(0))
    return wide.select(*_list(key), row, *[c.alias(n) for n, c in cells], total.alias("row_total"))


def unit_count_pivot(long: DataFrame, floors, row="unit_type", floor="floor", qty="count", key=("building",)) -> DataFrame:
    wide = long.groupBy(*_list(key), row).pivot(floor, list(floors)).agg(F.sum(qty))
    cells = [F.coalesce(F.col(f"`{f}`"), F.lit(0)) for f in floors]
    return wide.select(*_list(key), row, *[c.alias(f) for c, f in zip(cells, floors)], sum(cells, F.lit(0)).alias("total"))


# The output sheet: column -> source columns tried in order, and the default.
SHEET = {
    "Qty": (["qty"], "0"), "NUMBER": (["mark"], ""), "LOCATION": (["LOCATION"], ""),
    "Opening Mode": (["reconciled_mode"], "Single"), "Int/Ext": (["bucket"], "Interior"),
    "Wall Type": (["wall_variant", "WALL TYPE"], "DRY"), "Takeoff Notes": (["takeoff_notes"], ""),
    "WIDTH": (["WIDTH"], ""), "HEIGHT": (["HEIGHT"], ""), "THICKNESS": (["THICKNESS"], ""),
    "DOOR TYPE": (["DOOR TYPE", "WINDOW TYPE"], ""), "DOOR MATERIAL": (["DOOR MATERIAL", "WINDOW MATERIAL"], ""),
    "DOOR FINISH": (["DOOR FINISH", "FINISH"], ""), "FRAME TYPE": (["FRAME TYPE"], ""),
    "FRAME MATERIAL": (["FRAME MATERIAL"], ""), "FRAME FINISH": (["FRAME FINISH"], ""),
    "HEAD": (["DETAIL HEAD"], ""), "JAMB": (["DETAIL JAMB"], ""), "SILL": (["DETAIL SILL"], ""),
    "FIRE RATING": (["FIRE RATING"], ""), "HARDWARE SET": (["HARDWARE GROUP NO"], ""),
    "KEY CARD READER": (["KEY CARD READER"], "No"), "COMMENTS": (["PRINTED COMMENTS", "COMMENTS"], ""),
}


def door_schedule_23(df: DataFrame, key=("project_id",)) -> DataFrame:
    """The 23-column door schedule, every cell as text."""

    def cell(sources, default):
        have = [F.nullif(F.col(f"`{s}`").cast("string"), F.lit("")) for s in sources if s in df.columns]
        return F.coalesce(*have, F.lit(default))

    return df.select(*_list(key), *[cell(*SHEET[c]).alias(c) for c in V.DOOR_SCHEDULE_COLUMNS])


def totals_by(df: DataFrame, dims, qty="qty") -> DataFrame:
    return df.groupBy(*_list(dims)).agg(F.sum(qty).alias("total"))


def section_counts(df: DataFrame, key=("project_id",)) -> DataFrame:
    return df.groupBy(*_list(key), "section").agg(F.count(F.lit(1)).alias("n_rows"))
