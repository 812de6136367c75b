"""A takeoff from raw tables to the four output tables.

Cells are cleaned and de-duplicated by mark, plan marks are voted between passes, and schedule and
plan are reconciled; doors are then split by wall type, wall thickness and location, multiplied into
the unit matrix, and written out. Rows, detection facts and classified rows are stored once.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel import vocab as V
from lintel.functions import text as T
from lintel.operators import consensus as N
from lintel.operators import matrix as M
from lintel.operators.classify import takeoff_notes
from lintel.operators.dedup import bifurcate_by, dedup_first
from lintel.operators.reconcile import Takeoff
from lintel.operators.scan import checkpoint


class TakeoffRun(Takeoff):
    """Outputs of a run; each frame is built when it is first asked for.

    Inputs as for a reconciliation, with ``passes`` (project_id, page_id, pass_no, mark) in place of
    ``ocr``. Detections may carry ``thickness``. A mark that comes up again, in this or another
    table of its project, is the same opening: its first row by table and row number stays.
    """

    def __init__(self, tables: dict[str, DataFrame]):
        tables = dict(tables)
        if tables.get("passes") is not None:
            tables["ocr"] = N.vote(tables["passes"]).select("project_id", "mark").distinct()
        super().__init__(tables)
        self.kept |= {"rows", "classified"}

    @cached_property
    def rows(self):
        return checkpoint(dedup_first(super().rows, order=("table_id", "row_no")).where("mark <> ''").drop("_original_mark"))

    @cached_property
    def classified(self):
        return checkpoint(super().classified)

    @cached_property
    def doors(self):
        """Rows by wall type, then one row more for each mark seen in several thicknesses or locations."""
        det = self.tables["detections"].withColumn("mark", T.mark_key(T.text_of("mark")))
        walls = super().doors
        base = self.classified.where("opening_kind = 'door'")
        more = [("int_ext", ".L", "INTERIOR", V.NOTE_LOCATION), ("thickness", ".4", "STANDARD", V.NOTE_THICKNESS)]
        out = walls
        for cond, suffix, standard, note in more:
            if cond in det.columns:
                split = bifurcate_by(base, det, cond=cond, suffix=suffix, standard=standard, note=note).where("is_bifurcated")
                split = split.withColumn("note", F.col("bifurcation_note")).drop("bifurcation_note")
                split = split.withColumn("status", F.when(F.col("status") == "VERIFIED", "CALCULATED").otherwise(F.col("status")))
                out = out.unionByName(takeoff_notes(split), allowMissingColumns=True)
        return out

    @cached_property
    def door_schedule(self):
        return M.door_schedule_23(self.doors, ("project_id", "table_id", "row_no"))

    @cached_property
    def unit_count(self):
        return M.unit_count(self.tables["unit_mix"])

    @cached_property
    def unit_door(self):
        return self.matrix

    @cached_property
    def assumption_log(self):
        return self.log

    def outputs(self) -> dict[str, DataFrame]:
        """The four tables that ``write_takeoff`` takes; those of units only with a unit mix."""
        self.keep("facts", "doors")
        names = ["door_schedule", "assumption_log"] + (["unit_count", "unit_door"] if self.tables.get("unit_mix") is not None else [])
        return {n: getattr(self, n) for n in names}


def takeoff_run(tables: dict[str, DataFrame]) -> TakeoffRun:
    return TakeoffRun(tables)
