"""Full reconciliation of schedule, plan and specification tracks, for many projects at once.

One aggregation turns cells into rows, one turns detections into per-mark facts, one join
brings them together; everything after is a projection. Outputs are lazy frames; what the log reads
twice, and its lines, are stored once.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel import vocab as V
from lintel.functions import text as T
from lintel.operators import cells as C
from lintel.operators import classify as K
from lintel.operators import joins as J
from lintel.operators import matrix as M
from lintel.operators import qa
from lintel.operators.dedup import bifurcate, sequence_ids
from lintel.operators.scan import checkpoint
from lintel.operators.tables import ordered_join

MARK = ("project_id", "mark")
DET_ORDER = ("floor_no", "page_no", "w_cy", "w_cx", "det_id")
FIELDS = [
    "LOCATION", "FLOOR / LEVEL", "WALL TYPE", "WIDTH", "HEIGHT", "THICKNESS", "DOOR TYPE", "DOOR MATERIAL",
    "DOOR FINISH", "FRAME TYPE", "FRAME MATERIAL", "FRAME FINISH", "FINISH", "DETAIL HEAD", "DETAIL JAMB",
    "DETAIL SILL", "FIRE RATING", "HARDWARE GROUP NO", "KEY CARD READER", "COMMENTS", "TAKEOFF NOTES",
    "WINDOW TYPE", "WINDOW MATERIAL",
]

PRINTED = {"COMMENTS": "PRINTED COMMENTS"}  # apart from the upper-case comments role


def schedule_rows(cells: DataFrame, key=C.ROW) -> DataFrame:
    """One row per schedule row: mark, features, roles, schedule mode and canonical fields.

    A row has a few dozen cells and some sixty aggregates, so cells are sent to their row first: they are
    smaller than half-made rows, and headers and values are read in as many tasks as there are partitions.
    """
    typed = C.canonical_header(C.by_row(cells, key))
    h, v = F.col("_h"), F.col("_v")
    rank = F.when(h.isin(V.MARK_HEADERS), 0).when(
        (h.contains("mark") | h.contains("type")) & ~h.isin(V.NOT_MARK_HEADERS), 1
    )
    filled_rank = F.when(rank.isNotNull() & (v != ""), F.struct(rank, F.col("col_no")))
    fields = [
        F.max_by("value", F.when(F.col("canonical") == f, F.col("col_no"))).alias(PRINTED.get(f, f)) for f in FIELDS
    ]
    roles = [a.alias(f"_role_{r}") for a, r in zip(C.role_aggs(), ROLES)]
    rows = typed.groupBy(*key).agg(
        F.coalesce(F.min_by(F.upper(v), filled_rank), F.lit("")).alias("mark"),
        F.max("schedule_type").alias("schedule_type"),
        *C.feature_aggs(),
        *roles,
        *C.mode_aggs(),
        *fields,
        ordered_join("value", ["col_no"]).alias("row_text"),
    )
    rows = rows.withColumns({"has_panel_2": C.has_panel_2(), "schedule_mode": C.mode_from_aggs()})
    rows = rows.drop("_leaf", "_doubled", "_p1", "_p2").where("mark <> ''")
    return rows.withColumnsRenamed({f"_role_{r}": r for r in ROLES})


ROLES = ("door_material", "frame_material", "window_material", "door_type", "frame_type", "comments")


def detection_facts(det: DataFrame, order=DET_ORDER) -> DataFrame:
    """Per mark: first detection, quantity and floors in first-seen order."""
    d = det.withColumn("mark", T.mark_key(T.text_of("mark"))).where("mark <> ''")
    o = F.struct(*order)
    reason = F.col("vlm_reasoning") if "vlm_reasoning" in det.columns else F.lit(None).cast("string")
    per_floor = d.groupBy(*MARK, "floor_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(o).alias("o"),
        F.min_by(
            F.struct(F.col("vlm_opening_mode").alias("plan_mode"), F.col("vlm_wall_type").alias("plan_wall"), reason.alias("plan_reason")), o
        ).alias("f"),
    )
    named = F.filter(F.array_sort(F.collect_list(F.struct("o", "floor_name"))), lambda e: F.coalesce(e["floor_name"], F.lit("")) != "")
    return per_floor.groupBy(*MARK).agg(
        F.sum("n").alias("qty"),
        F.min_by("f", "o").alias("f"),
        F.array_join(F.transform(named, lambda e: e["floor_name"]), ", ").alias("plan_floors"),
    ).select(*MARK, "qty", "f.plan_mode", "f.plan_wall", "f.plan_reason", "plan_floors")


def classify_rows(rows: DataFrame, facts: DataFrame, spec_hits: DataFrame | None = None) -> DataFrame:
    """Schedule rows with plan facts and every decision column."""
    given = F.coalesce(F.col("needs_review"), F.lit(False)) if "needs_review" in rows.columns else F.lit(False)
    df = rows.join(facts.withColumn("located", F.lit(True)), list(MARK), "left")
    df = df.withColumns(
        {"located": F.coalesce("located", F.lit(False)), "qty": F.coalesce("qty", F.lit(0)),
         "given_note": F.col("`TAKEOFF NOTES`")}
    )
    df = K.is_double_acting(K.is_storefront(K.is_cased(df), spec_hits))
    df = K.int_ext(K.with_arbitration(K.resolved_mode(df)))
    df = df.withColumn("all_text", F.concat_ws(" ", "row_text", "mark", "plan_wall", "plan_mode"))
    df = K.ad_override(K.bucket5(df))
    df = df.withColumns(
        {
            "needs_review": F.col("mode_conflict") | ~F.col("located") | given,
            "is_borderline": ~F.col("located"),
            "review_reason": F.when(~F.col("located"), F.lit("mark_not_located_on_drawing")),
        }
    )
    df = K.status(K.route_type(df))
    df = K.section(df.withColumn("_notes", T.text_of("comments")), "mark", "LOCATION", "_notes").drop("_notes")
    return T.repair_detail_shift(df).drop("all_text")


def review_queue(rows: DataFrame, classified: DataFrame, det: DataFrame, ocr: DataFrame, exclusions: DataFrame | None) -> DataFrame:
    """All review items with a stable id."""
    def keyed(df):
        return df.select("project_id", T.mark_key(T.text_of("mark")).alias("mark")).where("mark <> ''")

    tracks = J.presence({"schedule": keyed(rows), "ocr": keyed(ocr), "cv": keyed(det)}, MARK)
    planned = F.col("in_ocr") | F.col("in_cv")
    kinds = F.filter(
        F.array(
            F.when(planned & ~F.col("in_schedule"), F.struct(
                F.lit("orphan_plan_mark").alias("type"),
                F.lit("Found in floor plan but missing from the uploaded schedule.").alias("context"))),
            F.when(F.col("in_schedule") & ~planned, F.struct(
                F.lit("missing_from_plan").alias("type"),
                F.lit("Exists in schedule but could not be located on the floor plan by OCR or CV.").alias("context"))),
            F.when(F.col("in_cv") & ~F.col("in_ocr"), F.struct(
                F.lit("ocr_cv_mismatch").alias("type"),
                F.lit("Detected by CV but missed by OCR Consensus.").alias("context"))),
        ),
        lambda k: k.isNotNull(),
    )
    items = [tracks.select("project_id", "mark", F.explode(kinds).alias("k")).select("project_id", "k.type", "mark", "k.context")]
    if exclusions is not None:
        items.append(J.exclusion_audit(rows, exclusions))
    items.append(K.arbitrate_mode(classified)[1])
    items.append(K.not_located(classified)[1])
    queue = reduce(lambda a, b: a.unionByName(b), items)
    return queue.withColumn("item_id", F.sha2(F.concat_ws("|", "project_id", "type", "mark", "context"), 256))


def assumption_log(doors: DataFrame, queue: DataFrame) -> DataFrame:
    """Bifurcations in schedule order, then review items by type and mark, numbered per project.

    The leading number follows that order (row numbers by the thousand; place of the type, then the
    first two letters of the mark), so a project is numbered in many short stretches.
    """
    wall = F.concat(F.lit("wall type '"), "wall_variant", F.lit("'"))
    basis = F.coalesce(wall, F.when(F.col("mark").endswith(".L"), "location").otherwise("wall thickness"))
    building = F.col("building") if "building" in doors.columns else F.lit("")
    split = doors.where("is_bifurcated").select(
        "project_id", F.floor(F.col("row_no") / 1024).cast("bigint").alias("_lead"), F.col("row_no").cast("bigint").alias("_row"), F.col("table_id").alias("_table"),
        building.alias("building"), F.col("FLOOR / LEVEL").alias("floor"),
        F.col("mark").alias("item"),
        F.concat(F.lit("Bifurcated mark '"), "original_tag", F.lit("' on basis of "), basis).alias("issue"),
        F.lit("Floor Plan / Partition Schedule").alias("source"), F.lit("CALCULATED").alias("action"),
    )
    kind = F.array_position(F.array(*map(F.lit, V.QUEUE_TYPES)), F.col("type"))
    kind = F.when(kind > 0, kind).otherwise(len(V.QUEUE_TYPES) + 1)
    letters = [F.least(F.ascii(F.substring("mark", i, 1)), F.lit(255)) for i in (1, 2)]
    review = queue.select(
        "project_id", (F.lit(2**40) + kind * 65536 + letters[0] * 256 + letters[1]).cast("bigint").alias("_lead"), F.lit(0).cast("bigint").alias("_row"), F.col("type").alias("_table"),
        F.lit("").alias("building"), F.lit("Multiple").alias("floor"),
        F.col("mark").alias("item"), F.col("context").alias("issue"),
        F.lit("Floor Plan / Schedule").alias("source"), F.lit("VERIFY").alias("action"),
    )
    both = checkpoint(split.unionByName(review))  # numbering asks for large projects first, which would build all of it twice
    numbered = sequence_ids(both, ("project_id",), ("_lead", "_row", "_table", "item", "issue"))
    return numbered.select("project_id", "id", "building", "floor", "item", "issue", "source", "action")


class Takeoff(Mapping):
    """Lazy outputs of a reconciliation; each frame is built when it is first asked for.

    Inputs: cells, detections, ocr and, optionally, audit (project_id, mark of a second pass over the
    schedule), exclusions, spec_text, floors, unit_mix, unit_door_input, unit_counts, expected_doors. Outputs: doors, windows, queue, log, gates and,
    with a unit mix, the unit-door matrix.
    """

    NAMES = ("doors", "windows", "queue", "log", "gates", "matrix")

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables, self.kept = tables, set()

    def keep(self, *names: str):
        """Store frames that several outputs read, which would be built anew for each."""
        for name in names:
            if name not in self.kept:
                self.__dict__[name] = checkpoint(getattr(self, name))
                self.kept.add(name)

    def __getitem__(self, name):
        if name not in self:
            raise KeyError(name)
        return getattr(self, name)

    def __contains__(self, name):
        return name in self.NAMES and (name != "matrix" or self.tables.get("unit_mix") is not None)

    def __iter__(self):
        return (n for n in self.NAMES if n in self)

    def __len__(self):
        return sum(1 for _ in self)

    @cached_property
    def rows(self):
        rows, audit = schedule_rows(self.tables["cells"]), self.tables.get("audit")
        return rows if audit is None else J.audit(rows, audit, ("project_id",))

    @cached_property
    def facts(self):
        return detection_facts(self.tables["detections"])

    @cached_property
    def classified(self):
        spec, floors = self.tables.get("spec_text"), self.tables.get("floors")
        hits = None if spec is None else J.mark_in_text(spec, self.rows)
        df = classify_rows(self.rows, self.facts, hits)
        own = [F.nullif(F.col(c), F.lit("")) for c in ("FLOOR / LEVEL", "plan_floors")]
        if floors is not None:
            first = floors.groupBy("project_id").agg(F.min_by("name", "floor_no").alias("_floor"))
            df = df.join(first, "project_id", "left")
            own += [F.col("_floor"), F.lit("Level 1")]
        return df.withColumn("FLOOR / LEVEL", F.coalesce(*own, F.lit(""))).drop("_floor")

    @cached_property
    def doors(self):
        det = self.tables["detections"].withColumn("mark", T.mark_key(T.text_of("mark")))
        doors = bifurcate(self.classified.where("opening_kind = 'door'"), det)
        doors = doors.withColumn("note", F.coalesce("bifurcation_note", "note")).drop("bifurcation_note")
        derived = F.col("is_bifurcated") & (F.col("status") == "VERIFIED")
        doors = doors.withColumn("status", F.when(derived, "CALCULATED").otherwise(F.col("status")))
        return K.takeoff_notes(doors)

    @cached_property
    def windows(self):
        return K.takeoff_notes(self.classified.where("opening_kind = 'window'"))

    @cached_property
    def queue(self):
        t = self.tables
        seen = self.facts if "facts" in self.kept else t["detections"]  # the same marks
        return review_queue(self.rows, self.classified, seen, t["ocr"], t.get("exclusions"))

    @cached_property
    def log(self):
        """Doors and queue read the same rows."""
        self.keep("facts", "rows", "classified")
        return assumption_log(self.doors, self.queue)

    @cached_property
    def matrix(self):
        return M.project_matrix(self.tables["unit_mix"], self.doors, self.tables.get("unit_door_input"))

    @cached_property
    def gates(self):
        made = {"rows": self.rows, "doors": self.doors, "queue": self.queue}
        if "matrix" in self:
            made["matrix"] = self.matrix
        return qa.qa_gates({**self.tables, **made})


def reconcile(tables: dict[str, DataFrame]) -> Takeoff:
    return Takeoff(tables)
