"""The takeoff run from raw tables: repeated marks, three passes, units, and all four outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintel.operators.scan import scratch_folder
from lintel.operators.takeoff import takeoff_run
from lintel.plans import q_joins as QJ
from lintel.plans import q_tables as QB
from lintel.plans import q_text as QT
from lintel.plans.views import catalog
from lintel.sources import io as IO

q = catalog.add


def run(t):
    """Every part, line item, event and document; every third row is printed once more in a table of repeats."""
    tables = QB.tracks(t)
    again = t.v_cells.where("row_no % 3 = 0").withColumns({"table_id": F.concat(F.lit("Z"), "table_id"), "value": F.when(F.col("col_no") == 0, F.concat("value", F.lit(" copy"))).otherwise(F.col("value"))})
    det = t.v_det.withColumn("thickness", F.expr("CASE WHEN quantity > 48 THEN 'LARGER' ELSE 'STANDARD' END"))
    units = det.select("project_id", "building", F.col("floor_name").alias("floor"), F.expr("'U' || page_no").alias("unit_type"), F.lit(1).alias("count"))
    given = det.select("project_id", F.expr("'U' || page_no").alias("unit_type"), F.col("mark").alias("tag"), F.expr("floor_no % 3").alias("per_unit"))
    return takeoff_run({**tables, "cells": tables["cells"].unionByName(again), "detections": det, "passes": t.v_passes, "unit_mix": units, "unit_door_input": given})


VOTED = "SELECT project_id, mark, 1 FROM (SELECT project_id, page_id, mark FROM v_passes GROUP BY ALL HAVING count(DISTINCT pass_no) >= 2)"
QUEUE = QB.QUEUE_SQL.replace("SELECT project_id, mark, 1 FROM v_passes", VOTED)
ALL_DOORS = f"""wl AS (SELECT project_id, mark AS original, bool_or(int_ext = 'Interior') AND bool_or(int_ext <> 'Interior') AS loc, bool_or(quantity <= 48) AND bool_or(quantity > 48) AS thick FROM v_det GROUP BY ALL),
  ad AS (SELECT project_id, table_id, table_row, mark, original, qty, status, section, is_bifurcated, takeoff_notes, wall_variant, floors FROM doors
   UNION ALL SELECT project_id, table_id, table_row, mark || sfx, mark, qty, CASE WHEN status = 'VERIFIED' THEN 'CALCULATED' ELSE status END, section, TRUE, trim(concat_ws(' ', n, CASE WHEN NOT located THEN 'Not Found' END)), NULL, floors
    FROM rec JOIN (SELECT project_id, original, x.s AS sfx, x.n AS n FROM (SELECT project_id, original, unnest(list_filter([{{'s': CASE WHEN loc THEN '.L' END, 'n': '{QT.V.NOTE_LOCATION}'}}, {{'s': CASE WHEN thick THEN '.4' END, 'n': '{QT.V.NOTE_THICKNESS}'}}], lambda x: x.s IS NOT NULL)) AS x FROM wl)) w
    ON w.project_id = rec.project_id AND w.original = rec.mark WHERE opening_kind = 'door')"""
ALL_DOORS = ALL_DOORS.replace("SELECT project_id, table_id, table_row, mark || sfx", "SELECT rec.project_id, table_id, table_row, mark || sfx")


@q(
    "takeoff_doors",
    f"""WITH {QB.RECONCILED}, {ALL_DOORS} SELECT project_id, table_id, table_row AS row_no, mark, CAST(qty AS BIGINT) AS qty, section, status, is_bifurcated, takeoff_notes FROM ad""",
    *QB.TRACK_VIEWS,
)
def _(t):
    return run(t).doors.select("project_id", "table_id", "row_no", "mark", "qty", "section", "status", "is_bifurcated", "takeoff_notes")


@q(
    "takeoff_units",
    """SELECT building, unit_type, floor, n_units, level FROM (SELECT building, 'U' || CAST(page_no AS STRING) AS unit_type, floor_name AS floor, CAST(count(*) AS BIGINT) AS n_units,
   CAST(grouping(building, 'U' || CAST(page_no AS STRING), floor_name) AS BIGINT) AS level FROM v_det GROUP BY CUBE (building, 'U' || CAST(page_no AS STRING), floor_name)) WHERE level < 4 OR level = 7""",
    "v_det",
)
def _(t):
    return run(t).unit_count


@q(
    "takeoff_matrix",
    f"""WITH {QB.RECONCILED}, {ALL_DOORS},
  un AS (SELECT project_id, 'U' || CAST(page_no AS STRING) AS unit_type, count(*) AS units FROM v_det GROUP BY ALL),
  gi AS (SELECT project_id, 'U' || CAST(page_no AS STRING) AS unit_type, mark AS tag, sum(floor_no % 3) AS per FROM v_det GROUP BY ALL)
  SELECT project_id, unit_type, tag, CAST(units AS BIGINT) AS qty_units, CAST(coalesce(per, 1) AS BIGINT) AS input, CAST(units * coalesce(per, 1) AS BIGINT) AS extended, CASE WHEN per IS NULL THEN 'INFERRED' ELSE 'CALCULATED' END AS basis
  FROM un JOIN (SELECT DISTINCT project_id, mark AS tag FROM ad) USING (project_id) LEFT JOIN gi USING (project_id, unit_type, tag)""",
    *QB.TRACK_VIEWS,
)
def _(t):
    return run(t).unit_door.select("project_id", "unit_type", "tag", "qty_units", "input", "extended", "basis")


@q(
    "takeoff_log",
    f"""WITH {QB.RECONCILED}, {QUEUE}, {ALL_DOORS}, lg AS (
   SELECT project_id, 0 AS part, table_row AS r, table_id AS t, coalesce(floors, '') AS floor, mark AS item, 'Bifurcated mark ''' || original || ''' on basis of wall type ''' || wall_variant || '''' AS issue,
    'Floor Plan / Partition Schedule' AS source, 'CALCULATED' AS action FROM ad WHERE is_bifurcated AND wall_variant IS NOT NULL
   UNION ALL SELECT project_id, 0, table_row, table_id, coalesce(floors, ''), mark, 'Bifurcated mark ''' || original || ''' on basis of ' || CASE WHEN mark LIKE '%.L' THEN 'location' ELSE 'wall thickness' END,
    'Floor Plan / Partition Schedule', 'CALCULATED' FROM ad WHERE is_bifurcated AND wall_variant IS NULL
   UNION ALL SELECT project_id, 1, 0, type, 'Multiple', mark, context, 'Floor Plan / Schedule', 'VERIFY' FROM qu),
  nb AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY part, r, t, item, issue) AS n FROM lg)
  SELECT project_id, 'A-' || lpad(CAST(n AS STRING), CAST(greatest(3, length(CAST(n AS STRING))) AS INT), '0') AS id, '' AS building, floor, item, issue, source, action FROM nb""",
    *QB.TRACK_VIEWS,
)
def _(t):
    return run(t).assumption_log


@q("takeoff_written", catalog.sql_body["takeoff_log"], *QB.TRACK_VIEWS)
def _(t):
    """All four tables written as one result; the log read back from it."""
    folder = scratch_folder(t.spark, "takeoff")
    IO.write_takeoff(run(t).outputs(), folder)
    written = IO.read_takeoff(t.spark, folder)
    return written["assumption_log"].select("project_id", "id", "building", "floor", "item", "issue", "source", "action")
