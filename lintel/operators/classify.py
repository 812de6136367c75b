"""Decision tables over schedule rows joined with their first plan detection.

Rows carry the columns of :func:`lintel.operators.cells.role_columns` and ``row_features`` plus
``mark``, ``schedule_type``, ``schedule_mode`` and, once joined, the plan columns ``plan_mode``,
``plan_wall`` and ``located``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel import vocab as V
from lintel.functions import text as T

MATERIAL_TEXTS = ("door_material", "frame_material", "window_material")


def section(df: DataFrame, mark="mark", location="location", notes="notes") -> DataFrame:
    m, loc, note = T.mark_key(T.text_of(mark)), F.lower(T.text_of(location)), F.lower(T.text_of(notes))
    return df.withColumn(
        "section",
        F.when(m.startswith("OH") | T.any_of(loc, V.OVERHEAD_LOCATION_WORDS) | note.contains("overhead"), "OVERHEAD")
        .when(m.startswith("CO") | loc.contains("cased") | T.any_of(note, ["cased opening", "frame only"]), "CASED")
        .when(m.startswith("W") | loc.contains("window") | note.contains("window"), "WINDOW")
        .when(T.any_of(loc, V.COMMON_AREA_WORDS), "UNIQUE")
        .otherwise("REPEATING"),
    )


def route_type(df: DataFrame) -> DataFrame:
    """Door or window: the schedule's own type, else by mark prefix."""
    m = T.mark_key(T.text_of("mark"))
    return df.withColumn(
        "opening_kind",
        F.when(F.col("schedule_type").isin("door", "window"), F.col("schedule_type"))
        .when(m.startswith("W") | m.startswith("V"), "window")
        .otherwise("door"),
    )


def is_window():
    m = F.upper(T.text_of("mark"))
    return (T.text_of("schedule_type") == "window") | m.startswith("W") | m.startswith("V")


def is_cased(df: DataFrame) -> DataFrame:
    by_blank = F.col("door_material").isin(V.BLANK_CASED_MATERIAL) & F.col("door_type").isin(V.BLANK_CASED_TYPE)
    return df.withColumn("is_cased", by_blank | F.col("door_type").isin(V.CASED_TYPES))


def is_storefront(df: DataFrame, spec_hits: DataFrame | None = None, key=("project_id", "mark")) -> DataFrame:
    """Needs ``is_cased`` and ``has_hardware``; ``spec_hits`` lists marks a specification sentence names."""
    text = F.concat_ws(" ", *MATERIAL_TEXTS, "door_type", "comments", "frame_type")
    cased_hw = F.col("is_cased") & F.col("has_hardware") & F.col("frame_material").isin(V.BLANK_FRAME)
    spec = F.lit(False)
    if spec_hits is not None:
        df = df.join(spec_hits.select(*key).distinct().withColumn("_spec", F.lit(True)), list(key), "left")
        spec = F.coalesce(F.col("_spec"), F.lit(False))
    materials = T.sf_material("door_material") | T.sf_material("frame_material") | T.sf_material("window_material")
    hit = spec | T.any_of(text, V.STOREFRONT_PHRASES) | cased_hw | materials
    return df.withColumn("is_storefront", hit).drop("_spec")


def is_double_acting(df: DataFrame) -> DataFrame:
    words = F.array(*[F.lit(w) for w in V.DOUBLE_ACTING_WORDS])

    def hit(c):
        return T.any_of(c, V.DOUBLE_ACTING_PHRASES) | F.arrays_overlap(T.words_of(c), words)

    return df.withColumn("is_double_acting", hit("door_type") | hit("comments"))


def resolved_mode(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "resolved_mode",
        F.when(F.col("is_storefront") | is_window(), "STOREFRONT")
        .when(F.col("is_cased"), "CO")
        .when(F.col("is_double_acting"), "DA")
        .when(F.col("has_panel_2"), "PR")
        .otherwise(F.coalesce(F.col("schedule_mode"), F.lit("SGL"))),
    )


def with_arbitration(df: DataFrame) -> DataFrame:
    """Adds the plan's cleaned mode, the conflict flag and the final mode (the schedule wins)."""
    plan, sched = F.coalesce(F.col("plan_mode"), F.lit("UNKNOWN")), F.col("resolved_mode")
    impossible = plan.isin("CO", "REV") & (F.col("has_hardware") | F.col("has_material"))
    cleaned = (
        F.when(impossible, F.when(F.col("has_panel_2"), "PR").otherwise("SGL"))
        .when((plan == "PR") & ~F.col("has_panel_2") & (sched == "SGL"), "SGL")
        .otherwise(plan)
    )
    df = df.withColumn("plan_mode_cleaned", cleaned)
    cleaned = F.col("plan_mode_cleaned")
    agrees = (sched == cleaned) | ((sched == "PR") & cleaned.isin("DE", "DA"))
    conflict = F.col("located") & (sched != "STOREFRONT") & (plan != "UNKNOWN") & ~agrees
    return df.withColumns({"mode_conflict": conflict, "final_mode": sched})


def arbitrate_mode(df: DataFrame):
    """(rows, queue): rows with the final mode and the conflicts as review items."""
    rows = with_arbitration(df)
    stated = F.nullif(T.text_of("plan_reason"), F.lit("")) if "plan_reason" in df.columns else F.lit(None)
    reason = F.coalesce(stated, F.lit(V.NO_REASON))
    queue = rows.where("mode_conflict").select(
        "project_id",
        F.lit("opening_mode_conflict").alias("type"),
        "mark",
        F.concat(
            F.lit("Opening Mode Conflict: Schedule suggests '"), "resolved_mode",
            F.lit("' but floor plan crop reads as '"), "plan_mode_cleaned", F.lit("'. (Reasoning: "), reason, F.lit(")"),
        ).alias("context"),
    )
    return rows, queue


def int_ext(df: DataFrame) -> DataFrame:
    outside = F.col("explicit_exterior") | F.col("curtain_wall") | F.coalesce(
        F.col("plan_wall").isin("EXT", "EXTERIOR"), F.lit(False)
    )
    return df.withColumn("side", F.when(outside, "Exterior").otherwise("Interior"))


def not_located(df: DataFrame):
    """(rows, queue): rows without a detection are flagged and queued."""
    missing = ~F.col("located")
    rows = df.withColumns(
        {
            "is_borderline": missing,
            "review_reason": F.when(missing, F.lit("mark_not_located_on_drawing")),
        }
    )
    queue = rows.where(missing).select(
        "project_id",
        F.lit("mark_not_located").alias("type"),
        "mark",
        F.concat(
            F.lit("Mark Not Located: Mark '"), "mark",
            F.lit("' from schedule registry was not located on floor plan drawing. Flagged for human review."),
        ).alias("context"),
    )
    return rows, queue


def bucket5(df: DataFrame, all_text="all_text") -> DataFrame:
    """Five-way bucket with the takeoff note and exclusion flag that go with it."""
    text = F.lower(T.text_of(all_text))
    multifold, sidelite = T.any_of(text, V.MULTIFOLD_WORDS), T.any_of(text, V.SIDELITE_WORDS)
    store, window, cased = F.col("is_storefront"), is_window(), F.col("is_cased")
    given = F.nullif(T.text_of("given_note"), F.lit("")) if "given_note" in df.columns else F.lit(None).cast("string")
    store_note = F.concat(
        F.lit("Door Excluded. Door material "),
        F.coalesce(F.nullif(F.col("door_material"), F.lit("")), F.lit("HM")),
        F.lit(" but on elevation it is storefront."),
    )
    return df.withColumns(
        {
            "is_sidelite": sidelite,
            "excluded": multifold | store,
            "bucket": F.when(multifold | store, "Not in Scope")
            .when(window | sidelite, "Window")
            .when(cased, F.col("side"))
            .when(T.any_of(text, V.SOFT_EXTERIOR_WORDS), "Soft Exterior")
            .when(F.col("explicit_exterior"), "Exterior")
            .otherwise(F.col("side")),
            "note": F.when(multifold, F.lit(V.NOTE_MULTIFOLD))
            .when(store, store_note)
            .when(window, given)
            .when(sidelite, F.coalesce(given, F.lit(V.NOTE_SIDELITE)))
            .when(cased, F.coalesce(given, F.lit(V.NOTE_CASED)))
            .otherwise(given),
        }
    )


def ad_override(df: DataFrame) -> DataFrame:
    """Aluminium-door systems and storefronts leave the scope; windows keep their own bucket."""
    system = (
        F.col("comments").contains("AD SYSTEM") | F.col("door_type").contains("AD SYSTEM")
        | (F.col("resolved_mode") == "STOREFRONT") | F.col("is_storefront")
    )
    plain = ~is_window() & ~F.col("is_sidelite")
    scoped_out = F.when(is_window() & ~F.col("is_storefront") & ~F.col("excluded"), F.col("bucket")).otherwise(
        F.lit("Not in Scope")
    )
    return df.withColumns(
        {
            "is_ad_system": system,
            "reconciled_mode": F.when(system, F.lit("STOREFRONT")).when(plain, F.col("final_mode")),
            "reconciled_int_ext": F.when(system, scoped_out).otherwise(F.col("bucket")),
        }
    )


def status(df: DataFrame) -> DataFrame:
    """Standard status; rows that are not found carry quantity 0."""
    return df.withColumn(
        "status",
        F.when(F.col("excluded"), "EXCLUDED")
        .when(F.col("bucket") == "Not in Scope", "NOT IN SCOPE")
        .when(~F.col("located"), "NOT FOUND")
        .when(F.col("mode_conflict"), "CONFLICT")
        .when(F.coalesce(F.col("needs_review"), F.lit(False)), "VERIFY")
        .otherwise("VERIFIED"),
    )


def takeoff_notes(df: DataFrame) -> DataFrame:
    """Joins the notes of every decision; ``note_missing`` marks decisions without a note."""
    parts = [F.col("note"), F.when(~F.col("located"), F.lit(V.NOTE_NOT_FOUND))]
    notes = F.concat_ws(" ", *parts)
    decided = F.col("excluded") | ~F.col("located") | F.col("is_cased")
    return df.withColumns({"takeoff_notes": notes, "note_missing": decided & (notes == "")})


def scope(df: DataFrame) -> DataFrame:
    """Hollow metal, wood and fibreglass are in scope; excluded rows stay listed."""
    material = F.upper(T.text_of("door_material"))
    listed = T.any_of(material, ["HM", "WD", "WOOD", "HOLLOW METAL", "FIBERGLASS", "FIBREGLASS", "SCWD"])
    return df.withColumn(
        "in_scope", ~F.col("is_storefront") & ~T.sf_material("door_material") & (listed | F.col("is_cased"))
    )
