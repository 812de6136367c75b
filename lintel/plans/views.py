"""Takeoff-shaped views over the driver tables.

``v_sched``, ``v_det`` and ``v_events`` are one SQL text for both engines. ``v_cells`` and
``v_words`` need engine syntax, so the Spark side builds them with library operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.operators.cells import to_cells

PREFIX = "CASE WHEN {k} % 11 = 0 THEN 'OH' WHEN {k} % 13 = 0 THEN 'CO' WHEN {k} % 7 = 0 THEN 'W' ELSE 'D' END"

V_SCHED = """
SELECT 'P' || CAST(p_partkey % 8 AS STRING) AS project_id,
  p_partkey AS row_no,
  'T' || CAST(CAST(floor(p_partkey / 8) AS BIGINT) % 2 AS STRING) AS table_id, CAST(floor(p_partkey / 16) AS BIGINT) AS table_row,
  """ + PREFIX.format(k="p_partkey") + """ || CAST(p_partkey AS STRING) AS mark,
  """ + PREFIX.format(k="p_partkey") + """ || CAST(p_partkey AS STRING)
    || CASE p_partkey % 6 WHEN 0 THEN ' copy' WHEN 1 THEN '  DRAFT' WHEN 2 THEN ' Void 2' ELSE '' END AS printed_mark,
  CASE WHEN p_partkey % 19 = 0 THEN '' WHEN p_partkey % 7 = 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0
    THEN 'window' ELSE 'door' END AS schedule_type,
  CASE p_type WHEN 'PROMO' THEN 'CO' WHEN 'ECONOMY' THEN 'F AB' WHEN 'LARGE' THEN 'PAIR' WHEN 'SMALL' THEN 'SINGLE FLUSH'
    WHEN 'MEDIUM' THEN 'WOOD' ELSE '-' END AS door_type,
  CASE CAST(substring(p_brand, 7) AS INT) % 6 WHEN 0 THEN 'HM' WHEN 1 THEN 'WD' WHEN 2 THEN 'AL' WHEN 3 THEN 'N/A'
    WHEN 4 THEN '' ELSE 'AL/GL' END AS door_material,
  CASE (CAST(substring(p_brand, 7) AS INT) + p_size) % 5 WHEN 0 THEN 'HM' WHEN 1 THEN 'WD' WHEN 2 THEN '' WHEN 3 THEN 'GLASS'
    ELSE '-' END AS frame_material,
  CASE p_size % 5 WHEN 0 THEN '3''-' || CAST(p_size % 12 AS STRING) || '"' WHEN 1 THEN CAST(p_size AS STRING)
    WHEN 2 THEN '3''-0"/2''-' || CAST(p_size % 12 AS STRING) || '"' WHEN 3 THEN '3''' ELSE 'VIF' END AS width,
  p_name || CASE p_partkey % 10 WHEN 0 THEN ' DBL ACT' WHEN 1 THEN ' STOREFRONT UNIT' WHEN 2 THEN ' PREP DOOR'
    WHEN 3 THEN ' NEAR GARAGE' WHEN 4 THEN ' SINGLE' WHEN 5 THEN ' SIDELITE' WHEN 6 THEN ' OPERABLE WALL'
    WHEN 7 THEN ' AUTOMATIC, CR' WHEN 8 THEN ' (PR) DOORS' ELSE '' END AS comments,
  CASE p_partkey % 9 WHEN 0 THEN 'Lobby' WHEN 1 THEN 'Bedroom' WHEN 2 THEN 'Stair A' WHEN 3 THEN 'Corridor 2'
    WHEN 4 THEN 'Roll-up bay' WHEN 5 THEN 'Kitchen' WHEN 6 THEN 'Mech room' WHEN 7 THEN 'Window wall' ELSE '' END AS location,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'SET ' || CAST(p_partkey % 12 AS STRING) END AS hardware,
  CASE p_partkey % 6 WHEN 0 THEN 'EXT' WHEN 1 THEN 'INT' ELSE '' END AS side,
  CASE p_partkey % 5 WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE '' END AS leaves,
  CASE WHEN p_size % 5 = 0 THEN 'A' || CAST(p_size AS STRING) || '/A' || CAST(p_partkey % 100 AS STRING)
    ELSE 'PT-' || CAST(p_size AS STRING) END AS finish,
  'H' || CAST(p_size AS STRING) AS head,
  'J' || CAST(p_partkey % 50 AS STRING) AS jamb,
  CASE p_partkey % 4 WHEN 0 THEN '20 MIN' WHEN 1 THEN 'SMOKE BARRIER' WHEN 2 THEN 'PARTITION P4' ELSE '' END AS fire_rating
FROM {part}
"""

V_DET = """
SELECT 'P' || CAST(l_partkey % 8 AS STRING) AS project_id,
  CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-'
    || CAST(l_suppkey AS STRING) AS det_id,
  CASE WHEN l_partkey % 11 = 0 THEN 'OH' WHEN l_partkey % 26 = 0 THEN 'C0' WHEN l_partkey % 13 = 0 THEN 'CO'
    WHEN l_partkey % 7 = 0 THEN 'W' ELSE 'D' END || CAST(l_partkey AS STRING) AS mark,
  l_partkey AS part_no,
  CAST(l_linenumber AS INT) AS floor_no,
  CASE WHEN l_linenumber = 1 THEN 'Stilt Floor' ELSE 'Level ' || CAST(l_linenumber AS STRING) END AS floor_name,
  'B' || CAST(l_suppkey % 3 AS STRING) AS building,
  'S' || CAST(l_suppkey AS STRING) AS page_id,
  CAST(l_orderkey % 4 AS INT) AS page_no,
  CASE WHEN l_partkey % 3 = 0 THEN 'DRY' WHEN l_partkey % 3 = 1 THEN CASE WHEN l_returnflag = 'A' THEN 'DRY' ELSE 'CMU' END
    WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'UNKNOWN'
    WHEN l_returnflag = 'A' THEN 'DRY' WHEN l_returnflag = 'R' THEN 'CMU' ELSE 'CONCRETE' END AS wall_type,
  CASE WHEN l_partkey % 5 = 0 AND l_linestatus = 'O' THEN 'EXT' WHEN l_linenumber = 7 THEN 'UNKNOWN' ELSE 'INT' END AS vlm_wall_type,
  CASE WHEN l_partkey % 5 = 0 AND l_linestatus = 'O' THEN 'Exterior' ELSE 'Interior' END AS int_ext,
  CASE (l_linenumber + l_partkey) % 7 WHEN 1 THEN 'SGL' WHEN 2 THEN 'PR' WHEN 3 THEN 'CO' WHEN 4 THEN 'DA' WHEN 5 THEN 'DE'
    WHEN 6 THEN 'REV' ELSE 'UNKNOWN' END AS vlm_opening_mode,
  CASE WHEN l_partkey % 3 = 0 THEN 'swing of ' || CAST(l_linenumber AS STRING) || ' arcs' WHEN l_partkey % 3 = 1 THEN '' END AS vlm_reasoning,
  CAST((l_orderkey * 7 + l_linenumber * 31) % 1000 AS DOUBLE) AS w_cx,
  CAST((l_orderkey * 13 + l_partkey) % 800 AS DOUBLE) AS w_cy,
  CASE WHEN l_suppkey % 9 = 0 THEN 'STAIR ' || CAST(l_suppkey AS STRING) WHEN l_suppkey % 9 = 1 THEN 'Patio'
    WHEN l_suppkey % 9 = 2 THEN '' ELSE 'Unit ' || CAST(l_suppkey AS STRING) END AS location,
  l_quantity AS quantity, l_orderkey AS order_no, l_suppkey AS supp_no
FROM {lineitem}
"""

# Three extraction passes: page = user, pass by event type, mark = the number in the JSON.
V_PASSES = """
SELECT 'P' || CAST(user_id % 8 AS STRING) AS project_id, 'U' || CAST(user_id AS STRING) AS page_id,
  CASE WHEN event_type IN ('click', 'error') THEN 1 WHEN event_type IN ('view', 'signup') THEN 2 ELSE 3 END AS pass_no,
  'D' || replace(replace(props, '{{"k": ', ''), '}}', '') AS mark, event_id
FROM {events}
"""

VIEWS = {"v_sched": V_SCHED, "v_det": V_DET, "v_passes": V_PASSES}
DET_ORDER = ("floor_no", "page_no", "w_cy", "w_cx", "det_id")

# column -> header spellings by part number mod 4; a project has two tables whose row numbers collide
CELLS = {
    "mark": ["Mark", "DOOR NO", "type", "Door Mark"],
    "location": ["Location", "ROOM NAME", "room", "LOCATION"],
    "door_type": ["Door Type", "DOOR TYPE", "door_type", "Dr Type"],
    "door_material": ["Material", "Door Mat'l", "DOOR MATERIAL", "door_material"],
    "frame_material": ["Frame Material", "MATERIAL 1", "frame mat'l", "Frame Material"],
    "width": ["Width", "SIZE", "Opening Size", "WIDTH"],
    "comments": ["Comments", "REMARKS", "Description", "COMMENTS"],
    "hardware": ["Hardware Set", "HW SET", "hardware group no", "Group No"],
    "side": ["INT/EXT", "Int_Ext", "int / ext", "Interior/Exterior"],
    "leaves": ["No. of Leaves", "LEAVES", "Panels", "Leaf Qty"],
    "finish": ["Finish", "FINISH", "Finish", "FINISH"],
    "head": ["Head", "DETAIL HEAD", "detail_head", "Head"],
    "jamb": ["Jamb", "DETAIL JAMB", "detail_jamb", "Jamb"],
}


def _quoted(s):
    return "'" + s.replace("'", "''") + "'"


def _cells_sql():
    parts = []
    for i, (c, heads) in enumerate(CELLS.items()):
        case = " ".join(f"WHEN {n} THEN {_quoted(h)}" for n, h in enumerate(heads))
        parts.append(
            f"SELECT project_id, table_id, table_row AS row_no, {i} AS col_no, CASE row_no % 4 {case} END AS header, "
            f"CAST({c} AS STRING) AS value, schedule_type FROM v_sched"
        )
    return " UNION ALL ".join(parts)


# Words of documents: block = document, line and word by position, 40 units per word slot.
V_LINES_DUCK = """
SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line_text,
  CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS line FROM documents
"""
V_WORDS_DUCK = """
SELECT 'P' || CAST(doc_id % 8 AS STRING) AS project_id, 'G' || CAST(doc_id % 64 AS STRING) AS page_id, doc_id AS block, line, word, text,
  CAST(word * 40 AS DOUBLE) AS x0, CAST(word * 40 + 40 - length(text) % 5 AS DOUBLE) AS x1,
  CAST(line * 10 AS DOUBLE) AS y0, CAST(line * 10 + 8 AS DOUBLE) AS y1
FROM (SELECT doc_id, line, unnest(string_split(line_text, ' ')) AS text,
  CAST(generate_subscripts(string_split(line_text, ' '), 1) - 1 AS INT) AS word FROM v_lines)
WHERE text <> ''
"""

DUCK = {
    **{n: s.format(part="part", lineitem="lineitem", events="events") for n, s in VIEWS.items()},
    "v_cells": _cells_sql(),
    "v_lines": V_LINES_DUCK,
    "v_words": V_WORDS_DUCK,
}
NEEDS = {"v_cells": ["v_sched"], "v_words": ["v_lines"]}


def oracle(body: str, *views: str) -> str:
    """SQL text with the named views as CTEs in front."""
    order = []
    for v in views:
        for n in [*NEEDS.get(v, []), v]:
            if n not in order:
                order.append(n)
    body = body.strip()
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({DUCK[n].strip()})" for n in order)
    rest = body[5:] if body[:5].upper() == "WITH " else None
    if rest and rest.startswith("RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{rest[10:]}"
    return f"WITH {ctes},\n{rest}" if rest else f"WITH {ctes}\n{body}"


class Tables:
    """Driver tables and derived views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        sql = VIEWS[name]
        used = {t: getattr(self, t) for t in ("part", "lineitem", "events") if "{" + t + "}" in sql}
        return self.spark.sql(sql, **used)

    @property
    def v_sched(self):
        return self.view("v_sched")

    @property
    def v_det(self):
        return self.view("v_det")

    @property
    def v_passes(self):
        return self.view("v_passes")

    @property
    def v_cells(self):
        def header(heads):
            return F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("_part") % 4 + 1).cast("int"))

        return to_cells(
            self.v_sched.withColumnsRenamed({"row_no": "_part", "table_row": "row_no"}),
            ("project_id", "table_id", "row_no"), {c: header(h) for c, h in CELLS.items()}, F.col("schedule_type"),
        )

    @property
    def v_lines(self):
        return self.documents.select(
            "doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line", "line_text")
        )

    @property
    def v_words(self):
        w = self.v_lines.select("doc_id", "line", F.posexplode(F.split("line_text", " ")).alias("word", "text"))
        return w.where("text <> ''").select(
            F.expr("'P' || doc_id % 8").alias("project_id"),
            F.expr("'G' || doc_id % 64").alias("page_id"),
            F.col("doc_id").alias("block"), "line", "word", "text",
            F.expr("cast(word * 40 as double)").alias("x0"),
            F.expr("cast(word * 40 + 40 - length(text) % 5 as double)").alias("x1"),
            F.expr("cast(line * 10 as double)").alias("y0"),
            F.expr("cast(line * 10 + 8 as double)").alias("y1"),
        )


class Catalog:
    """Queries by name with their expected-result SQL."""

    def __init__(self):
        self.queries, self.sql, self.sql_body = {}, {}, {}

    def add(self, name: str, sql: str | None = None, *views: str):
        def register(fn):
            self.queries[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
            if sql is not None:
                self.sql_body[name] = sql.strip()
                self.sql[name] = oracle(sql, *views)
            return fn

        return register


catalog = Catalog()
