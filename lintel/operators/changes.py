"""Registry edits: appended tables, schema maps, change logs, copies of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel import vocab as V
from lintel.functions import text as T


def _list(x):
    return [x] if isinstance(x, str) else list(x)


def append_registry(reg: DataFrame, new: DataFrame, type: str) -> DataFrame:
    """Registry plus a new table's rows stamped with their schedule type."""
    return reg.unionByName(new.withColumn("schedule_type", F.lit(type)), allowMissingColumns=True)


def apply_schema_map(df: DataFrame, renames=None, drops=(), order=(), adds=None) -> DataFrame:
    """Rename, drop, add and reorder columns; then fill ``mark`` from a mark-like column."""
    out = df.withColumnsRenamed(renames or {}).drop(*drops)
    out = out.withColumns({c: F.lit(v) for c, v in (adds or {}).items() if c not in out.columns}) if adds else out
    like = [c for c in out.columns if c != "mark" and c.strip().lower() in V.MARK_HEADERS and c.strip().lower() != "type"]
    if like:
        source = F.coalesce(*[F.nullif(T.strip(T.text_of(F.col(f"`{c}`"))), F.lit("")) for c in like])
        own = F.nullif(T.text_of("mark"), F.lit("")) if "mark" in out.columns else F.lit(None).cast("string")
        out = out.withColumn("mark", F.coalesce(source, own))
    lead = [c for c in order if c in out.columns]
    return out.select(*[F.col(f"`{c}`") for c in lead + [c for c in out.columns if c not in lead]])


def public_columns(df: DataFrame) -> DataFrame:
    """Leave out ``_`` columns and the ones the sheet computes itself."""
    return df.select(
        *[F.col(f"`{c}`") for c in df.columns if not c.startswith("_") and c.lower().strip() not in V.HIDDEN_COLUMNS]
    )


def replicate_rows(df: DataFrame, source: str, targets: DataFrame, key=("project_id",), floor="floor") -> DataFrame:
    """Copy one floor's rows to the project's target floors, replacing what those held."""
    key = _list(key)
    floors = targets.select(*key, F.col(floor)).distinct().where(F.col(floor) != source)
    rest = [c for c in df.columns if c not in (*key, floor)]
    kept = df.join(floors, [*key, floor], "left_anti").select(*df.columns)
    copies = df.where(F.col(floor) == source).select(*key, *rest).join(floors, key).select(*df.columns)
    return kept.unionByName(copies)


def apply_changes(df: DataFrame, changes: DataFrame, key=("project_id", "row_id"), seq="seq") -> DataFrame:
    """Replay a log of set, append and delete on long rows ``(key, field, value)``.

    The last entry per field wins; a delete removes what the row held before it. The log is folded
    first; rows it does not name pass two anti joins and are not regrouped.
    """
    key = _list(key)
    log = changes.select(*key, "field", "value", F.col(seq).cast("bigint").alias("_s"), "action")
    gone = log.where("action = 'delete' and field is null").groupBy(*key).agg(F.max("_s").alias("_row_gone"))
    last = log.where("field is not null").groupBy(*key, "field").agg(F.max_by(F.struct("action", "value", "_s"), "_s").alias("l"))
    alive = last.join(gone, key, "left").where(
        (F.col("l.action") != "delete") & (F.col("_row_gone").isNull() | (F.col("l._s") > F.col("_row_gone")))
    )
    kept = df.select(*key, "field", "value").join(last.select(*key, "field"), [*key, "field"], "left_anti").join(gone.select(*key), key, "left_anti")
    return kept.unionByName(alive.select(*key, "field", F.col("l.value").alias("value")))
