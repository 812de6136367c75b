"""Quality gates, self-checks and summaries. Each is one aggregation over its table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.functions import text as T


def _list(x):
    return [x] if isinstance(x, str) else list(x)


def _gate(name, df: DataFrame, bad, applicable=None) -> DataFrame:
    """One row per project: how many rows fail ``bad``."""
    n_bad = F.sum(F.when(bad, 1).otherwise(0))
    n_use = F.sum(F.when(F.lit(True) if applicable is None else applicable, 1).otherwise(0))
    return df.groupBy("project_id").agg(n_bad.alias("n_issues"), n_use.alias("_n")).select(
        "project_id",
        F.lit(name).alias("gate"),
        "n_issues",
        F.when(F.col("_n") == 0, "NOT_APPLICABLE").when(F.col("n_issues") == 0, "PASSED").otherwise("REVIEW_REQUIRED").alias("status"),
    )


def qa_gates(tables: dict[str, DataFrame]) -> DataFrame:
    """Gate table per project; gates without input are NOT_APPLICABLE.

    Uses rows, doors, queue and, if present, unit_counts (project_id, building, floor, unit_type,
    plan, matrix, mix), matrix, expected_doors (project_id, tag, expected), unit_mix, unit_door_input
    and detections. A gate compares what was made with figures it was not made from: totals with
    stated quantities, products with the unit mix and inputs, variants and overhead doors with the
    detections, cased openings with their materials.
    """
    rows, doors, queue = tables["rows"], tables["doors"], tables["queue"]
    projects = rows.select("project_id").distinct()

    def filled(gate: DataFrame | None, name, empty="NOT_APPLICABLE"):
        base = projects.withColumn("gate", F.lit(name))
        if gate is None:
            return base.select("project_id", "gate", F.lit(0).cast("bigint").alias("n_issues"), F.lit(empty).alias("status"))
        return base.join(gate.drop("gate"), "project_id", "left").select(
            "project_id", "gate", F.coalesce("n_issues", F.lit(0)).cast("bigint").alias("n_issues"),
            F.coalesce("status", F.lit(empty)).alias("status"),
        )

    gates = [filled(_gate("1", queue, F.lit(True)), "gate1_schedule_reconciliation", "PASSED")]
    units = tables.get("unit_counts")
    gates.append(
        filled(
            None if units is None else _gate("2", units, (F.col("plan") != F.col("matrix")) | (F.col("plan") != F.col("mix"))),
            "gate2_unit_count_reconciliation",
        )
    )
    matrix, expected = tables.get("matrix"), tables.get("expected_doors")
    gate3 = None
    if matrix is not None and expected is not None:
        made = matrix.groupBy("project_id", "tag").agg(F.sum("extended").alias("extended"))
        stated = expected.groupBy("project_id", "tag").agg(F.sum("expected").alias("expected"))
        per_tag = stated.join(made, ["project_id", "tag"], "left")
        gate3 = _gate("3", per_tag, F.coalesce("extended", F.lit(0)) != F.col("expected"))
    gates.append(filled(gate3, "gate3_unit_door_matrix"))
    gates.append(filled(None, "gate4_formula_validation"))
    mix, given, spot = tables.get("unit_mix"), tables.get("unit_door_input"), None
    if matrix is not None and mix is not None and given is not None:
        units = mix.groupBy("project_id", "unit_type").agg(F.sum("count").alias("_units"))
        per_unit = given.groupBy("project_id", "unit_type", "tag").agg(F.sum("per_unit").alias("_doors"))
        again = units.join(per_unit, ["project_id", "unit_type"]).join(matrix.select("project_id", "unit_type", "tag", "extended"), ["project_id", "unit_type", "tag"], "left")
        spot = _gate("5", again, F.coalesce("extended", F.lit(0)) != F.col("_units") * F.col("_doors"))
    gates.append(filled(spot, "gate5_spot_checks"))
    gates.append(filled(_gate("7", doors, F.col("excluded") & (T.text_of("takeoff_notes") == "")), "gate7_scope_review", "PASSED"))
    det = tables.get("detections")
    gate8, stray = None, None
    if det is not None:
        seen = det.select("project_id", T.mark_key(T.text_of("mark")).alias("_tag"), F.upper(T.strip(T.text_of("wall_type"))).alias("_w"))
        walls = seen.where(~F.col("_w").isin("", "UNKNOWN")).distinct().groupBy("project_id", "_tag").agg(F.count(F.lit(1)).alias("_walls")).where("_walls > 1")
        tag = F.coalesce("original_tag", "mark").alias("_tag")
        variant = F.when(F.col("is_bifurcated"), F.col("mark"))
        split = doors.groupBy("project_id", tag).agg(F.countDistinct(variant).alias("_n"), F.max((F.col("is_bifurcated") & (T.text_of("takeoff_notes") == "")).cast("int")).alias("_blank"))
        gate8 = _gate("8", walls.join(split, ["project_id", "_tag"]), (F.col("_n") != F.col("_walls")) | (F.col("_blank") > 0))
        recorded = doors.where("section = 'OVERHEAD'").select("project_id", tag)
        stray = seen.where(F.col("_tag").startswith("OH")).select("project_id", "_tag").distinct().join(recorded, ["project_id", "_tag"], "left_anti")
    gates.append(filled(gate8, "gate8_bifurcation_completeness"))
    gate9 = doors.select("project_id", (F.col("is_cased") & (F.col("section") != "CASED")).alias("_bad"))
    if stray is not None:
        gate9 = gate9.unionByName(stray.select("project_id", F.lit(True).alias("_bad")))
    gates.append(filled(_gate("9", gate9, F.col("_bad")), "gate9_cased_overhead", "PASSED"))
    return reduce(lambda a, b: a.unionByName(b), gates)


def missing_marks(expected: DataFrame, actual: DataFrame, id="det_id", mark="mark", key=("project_id",)) -> DataFrame:
    """Marks with detections that have no highlight, a row each: (key, mark, n_missing)."""
    key = _list(key)
    lost = expected.select(*key, id, mark).join(actual.select(*key, id).distinct(), [*key, id], "left_anti")
    return lost.groupBy(*key, mark).agg(F.count(F.lit(1)).alias("n_missing"))


def self_check(expected: DataFrame, actual: DataFrame, id="det_id", mark="mark", key=("project_id",)) -> DataFrame:
    """Detections against highlights per project, with the marks left without one in one text; as rows: missing_marks()."""
    key = _list(key)
    both = expected.select(*key, id, mark).join(
        actual.select(*key, id).distinct().withColumn("_hit", F.lit(True)), [*key, id], "left"
    )
    per_mark = both.groupBy(*key, mark).agg(
        F.count(F.lit(1)).alias("n"), F.count("_hit").alias("hit")
    )
    lost = F.when(F.col("hit") < F.col("n"), F.col(mark))
    return per_mark.groupBy(*key).agg(
        F.sum("n").alias("n_expected"),
        F.sum("hit").alias("n_actual"),
        F.array_join(F.array_sort(F.collect_list(lost)), ",").alias("missing_marks"),
        (F.sum("n") == F.sum("hit")).alias("passed"),
    )


def session_summary(df: DataFrame, floors="floors", columns="columns") -> DataFrame:
    """Floors, rooms and columns of nested intake rows; a column without a count is one."""
    rest = [c for c in df.columns if c not in (floors, columns)]
    return df.select(
        *rest,
        F.coalesce(F.size(floors), F.lit(0)).alias("num_floors"),
        F.coalesce(F.aggregate(floors, F.lit(0), lambda a, f: a + F.greatest(F.coalesce(F.size(f["rooms"]), F.lit(0)), F.lit(0))), F.lit(0)).alias("total_rooms"),
        F.coalesce(F.aggregate(columns, F.lit(0), lambda a, c: a + F.coalesce(c["count"], F.lit(1))), F.lit(0)).alias("columns_count"),
    )


def column_profile(df: DataFrame, floor=15) -> DataFrame:
    """Longest text per column and the sheet width derived from it."""
    longest = df.agg(*[F.coalesce(F.max(F.length(F.col(f"`{c}`").cast("string"))), F.lit(0)).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("max_len")) for c in df.columns])
    return longest.select(F.explode(pairs).alias("p")).select(
        "p.column_name", "p.max_len", F.greatest(F.col("p.max_len") + 4, F.lit(floor)).alias("sheet_width")
    )


def completeness(expected: DataFrame, extracted: DataFrame, key=("project_id", "category")) -> DataFrame:
    """Categories the source mentions must have extracted rows."""
    key = _list(key)
    got = extracted.groupBy(*key).agg(F.count(F.lit(1)).alias("extracted_count"))
    return expected.select(*key).distinct().join(got, key, "left").select(
        *key,
        F.coalesce("extracted_count", F.lit(0)).alias("extracted_count"),
        F.when(F.coalesce("extracted_count", F.lit(0)) > 0, "pass").otherwise("fail").alias("status"),
    )


def default_usage(df: DataFrame, key=("project_id",), item="type") -> DataFrame:
    """Items sized by a default, with their count."""
    key = _list(key)
    return df.where(F.col("source") == "default").groupBy(*key, item).agg(F.count(F.lit(1)).alias("n_defaults"))


def takeoff_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Doors by section, exclusions, bifurcation and items to verify, one row per project; with a unit
    mix also buildings, floors and units, with windows their number and types, with a queue its items."""
    doors = tables["doors"]

    def n_if(cond):
        return F.sum(F.when(cond, F.col("qty")).otherwise(0))

    out = doors.groupBy("project_id").agg(
        n_if(F.col("section") == "UNIQUE").alias("unique_doors"),
        n_if(F.col("section") == "REPEATING").alias("repeating_doors"),
        n_if(F.col("section") == "OVERHEAD").alias("overhead_doors"),
        n_if(F.col("section") == "CASED").alias("cased_openings"),
        F.sum("qty").alias("all_doors"),
        n_if(F.col("excluded")).alias("not_in_scope"),
        F.sum(F.col("status").isin("VERIFY", "CONFLICT", "NOT FOUND").cast("int")).alias("to_verify"),
    )
    if tables.get("variants") is not None:
        v = tables["variants"].groupBy("project_id").agg(
            F.countDistinct("original_tag").alias("bifurcated_tags"), F.count(F.lit(1)).alias("variants")
        )
        out = out.join(v, "project_id", "left").na.fill(0, ["bifurcated_tags", "variants"])
    more = {
        "unit_mix": [F.countDistinct("building").alias("buildings"), F.countDistinct("floor").alias("floors"), F.countDistinct("unit_type").alias("unit_types"), F.sum("count").alias("units")],
        "windows": [F.sum("qty").alias("windows"), F.countDistinct("mark").alias("window_types")],
        "queue": [F.count(F.lit(1)).alias("discrepancies")],
    }
    for name, aggs in more.items():
        if tables.get(name) is not None:
            part = tables[name].groupBy("project_id").agg(*aggs)
            out = out.join(part, "project_id", "left").na.fill(0, [c for c in part.columns if c != "project_id"])
    return out


def queue_counts(queue: DataFrame, key=("project_id",)) -> DataFrame:
    """Open items per type; :func:`gate_open` tells which projects may resume."""
    return queue.groupBy(*_list(key), "type").agg(F.count(F.lit(1)).alias("n_items"))


def gate_open(projects: DataFrame, queue: DataFrame, key=("project_id",)) -> DataFrame:
    """Projects with an empty queue may resume."""
    key = _list(key)
    n = queue.groupBy(*key).agg(F.count(F.lit(1)).alias("n_items"))
    return projects.select(*key).distinct().join(n, key, "left").select(
        *key, F.coalesce("n_items", F.lit(0)).alias("n_items"), F.col("n_items").isNull().alias("gate_open")
    )

