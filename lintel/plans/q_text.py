"""Queries over scalar normalisation, cells and rule columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintel import vocab as V
from lintel.functions import text as T
from lintel.operators import cells as C
from lintel.operators import changes as H
from lintel.operators import classify as K
from lintel.plans.views import catalog
from lintel.sources import io as IO

q = catalog.add


def sql_list(words):
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def sql_any(c, words):
    return "(" + " OR ".join(f"contains({c}, '" + w.replace("'", "''") + "')" for w in words) + ")"


def sql_arr(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


STAMPS = "|".join(V.WATERMARKS)
CLEAN = (
    "coalesce(nullif(trim(regexp_replace(regexp_replace({c}, '\\b(" + STAMPS + ")\\b', '', 'gi'), '\\s+', ' ', 'g')), ''), trim({c}))"
)


@q("clean_mark", f"SELECT row_no, {CLEAN.format(c='printed_mark')} AS mark FROM v_sched", "v_sched")
def _(t):
    return t.v_sched.select("row_no", T.clean_mark("printed_mark").alias("mark"))


@q("mark_alnum", "SELECT s_suppkey, upper(trim(s_name)) AS mark_key, regexp_replace(upper(s_name), '[^A-Z0-9]', '', 'g') AS mark_alnum FROM supplier")
def _(t):
    return t.supplier.select("s_suppkey", T.mark_key("s_name").alias("mark_key"), T.mark_alnum("s_name").alias("mark_alnum"))


@q("floor_digit", "SELECT row_no, regexp_extract(mark, '([0-9])', 1) AS floor_digit FROM v_sched", "v_sched")
def _(t):
    return t.v_sched.select("row_no", T.floor_from_mark("mark").alias("floor_digit"))


WIDTH_SQL = r"""list_sum(list_transform(string_split(upper({c}), '/'), lambda p: CASE
  WHEN regexp_full_match(trim(p), '(\d+)''?\s*-\s*(\d+)"?')
    THEN CAST(regexp_extract(trim(p), '^(\d+)', 1) AS DOUBLE) * 12 + CAST(regexp_extract(trim(p), '-\s*(\d+)', 1) AS DOUBLE)
  WHEN regexp_full_match(trim(p), '\d+''') THEN CAST(regexp_extract(trim(p), '(\d+)', 1) AS DOUBLE) * 12
  WHEN TRY_CAST(replace(p, '"', '') AS DOUBLE) <= 10 THEN TRY_CAST(replace(p, '"', '') AS DOUBLE) * 12
  ELSE coalesce(TRY_CAST(replace(p, '"', '') AS DOUBLE), 0.0) END))"""


@q("width_inches", f"SELECT row_no, width, CAST({WIDTH_SQL.format(c='width')} AS DOUBLE) AS inches FROM v_sched", "v_sched")
def _(t):
    return t.v_sched.select("row_no", "width", T.width_inches("width").alias("inches"))


IMPERIAL = """CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS STRING) || '''-' || CAST(p_size % 12 AS STRING) || '"'
  WHEN 1 THEN CAST(p_size AS STRING) || ' 1/2"' WHEN 2 THEN CAST(p_size AS STRING) || '''' ELSE 'VIF' END"""


@q(
    "imperial_m",
    f"""SELECT p_partkey, {IMPERIAL} AS printed, CASE p_partkey % 4 WHEN 0 THEN round(p_size * 0.3048::DOUBLE + (p_size % 12) * 0.0254::DOUBLE, 4)
  WHEN 1 THEN round((p_size + 0.5::DOUBLE) * 0.0254::DOUBLE, 4) WHEN 2 THEN round(p_size * 0.3048::DOUBLE, 4) ELSE 0.0::DOUBLE END AS metres FROM part""",
)
def _(t):
    return t.part.select("p_partkey", F.expr(IMPERIAL).alias("printed")).withColumn("metres", T.imperial_to_m("printed"))


MODE_CASE = "CASE upper(trim({c})) " + " ".join(
    f"WHEN '{s}' THEN '{code}'" for code, names in V.MODE_SYNONYMS.items() for s in names
) + " ELSE 'SGL' END"


@q("mode_code", f"SELECT row_no, door_type, {MODE_CASE.format(c='door_type')} AS mode FROM v_sched", "v_sched")
def _(t):
    return t.v_sched.select("row_no", "door_type", T.opening_mode_code("door_type").alias("mode"))


@q(
    "unit_system",
    """SELECT project_id, col_no, CASE WHEN bool_or(regexp_matches(value, '[0-9]\\s*[''"]')) THEN 'imperial'
  WHEN bool_or(regexp_matches(lower(value), '[0-9]\\s*mm\\b')) THEN 'metric' ELSE 'unclear' END AS unit_system
  FROM v_cells GROUP BY ALL""",
    "v_cells",
)
def _(t):
    return T.unit_system(t.v_cells, ("project_id", "col_no"))


NOISY = """CASE event_id % 4 WHEN 0 THEN 'Sure, here it is: ```json ' || props || ' ``` done'
  WHEN 1 THEN 'result ' || props || ' end' WHEN 2 THEN props ELSE 'nothing readable ' || event_type END"""


@q(
    "loose_json",
    """SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k,
  CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'UNKNOWN' END AS kind FROM events""",
)
def _(t):
    noisy = t.events.select("event_id", F.expr(NOISY).alias("txt"), "event_type")
    return noisy.select(
        "event_id", IO.parse_loose_json("txt", "k INT")["k"].alias("k"), T.domain_check("event_type", ["click", "view"]).alias("kind")
    )


@q("quarantined_rows", "SELECT event_id, event_id % 4 = 3 AS unreadable FROM events")
def _(t):
    ok, bad = IO.quarantine(t.events.select("event_id", F.expr(NOISY).alias("txt")), "txt")
    return ok.select("event_id", F.lit(False).alias("unreadable")).unionByName(bad.select("event_id", F.lit(True).alias("unreadable")))


@q("quarantine", "SELECT CAST(count(*) FILTER (event_id % 4 < 3) AS BIGINT) AS ok_rows, CAST(count(*) FILTER (event_id % 4 = 3) AS BIGINT) AS bad_rows FROM events")
def _(t):
    ok, bad = IO.quarantine(t.events.select(F.expr(NOISY).alias("txt")), "txt")
    both = ok.select(F.lit(1).alias("o"), F.lit(0).alias("b")).unionByName(bad.select(F.lit(0).alias("o"), F.lit(1).alias("b")))
    return both.agg(F.sum("o").alias("ok_rows"), F.sum("b").alias("bad_rows"))


@q(
    "spec_notes",
    """SELECT row_no, array_to_string(list_filter([
  CASE WHEN comments <> '' THEN 'Exclusions: ' || comments || ', ' || door_type END,
  CASE WHEN door_material <> '' OR finish <> '' THEN 'Defaults: ' || array_to_string(list_filter([
    CASE WHEN door_material <> '' THEN 'material: ' || door_material END, CASE WHEN finish <> '' THEN 'finish: ' || finish END], lambda x: x IS NOT NULL), ', ') END,
  CASE WHEN fire_rating <> '' THEN 'Spec Rules: ' || fire_rating END], lambda x: x IS NOT NULL), ' | ') AS spec_notes FROM v_sched""",
    "v_sched",
)
def _(t):
    feats = F.when(F.col("fire_rating") != "", F.array("fire_rating")).otherwise(F.array().cast("array<string>"))
    return t.v_sched.select(
        "row_no",
        T.spec_notes(
            F.array("comments", "door_type"),
            F.create_map(F.lit("material"), F.col("door_material"), F.lit("finish"), F.col("finish")),
            feats,
        ).alias("spec_notes"),
    )


@q(
    "field_fallback",
    """SELECT row_no, coalesce(nullif(hardware, ''), nullif(fire_rating, ''), nullif(leaves, '')) AS v,
  coalesce(nullif(location, ''), nullif(comments, '')) AS w FROM v_sched""",
    "v_sched",
)
def _(t):
    s = t.v_sched
    return T.field_fallback(
        s.select("row_no", F.col("hardware").alias("v"), F.col("location").alias("w")),
        s.select("row_no", F.col("fire_rating").alias("v")),
        s.select("row_no", F.col("leaves").alias("v"), F.col("comments").alias("w")),
        on="row_no",
    )


SAID = """CASE turn % 4 WHEN 0 THEN 'Set floor height to ' || CAST(conv_id % 20 AS STRING) || ' ft. '
  WHEN 1 THEN 'The outer wall is ' || CAST(conv_id % 30 AS STRING) || ' inches, ' WHEN 2 THEN 'Number of floors to ' || CAST(conv_id AS STRING) || '. '
  ELSE '' END || text"""


TOLD = """CASE p_partkey % 5 WHEN 0 THEN 'Set wall thickness to ' || (p_size * 10) || ' mm please' WHEN 1 THEN 'FOUNDATION depth is ' || p_size || ' ft'
  WHEN 2 THEN 'footing  depth to ' || p_size || '.5 m' WHEN 3 THEN 'Floor height is ' || p_size || ' foot' ELSE p_name END"""


@q(
    "command_units",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'outer_wall.thickness_m' WHEN 1 THEN 'foundation_depth_m' WHEN 2 THEN 'foundation_depth_m' WHEN 3 THEN 'floor_height_m' END AS parameter,
  CASE p_partkey % 5 WHEN 0 THEN 'mm' WHEN 1 THEN 'ft' WHEN 2 THEN 'm' WHEN 3 THEN 'foot' END AS unit,
  CASE p_partkey % 5 WHEN 0 THEN round(p_size * 10 * 0.001::DOUBLE, 3) WHEN 2 THEN p_size + 0.5::DOUBLE WHEN 4 THEN NULL ELSE round(p_size * 0.3048::DOUBLE, 2) END AS value FROM part""",
)
def _(t):
    said = t.part.select("p_partkey", F.expr(TOLD).alias("said"))
    return T.command_extract(said, "said").select("p_partkey", "parameter", "unit", "value")


@q(
    "commands",
    """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'floor_height_m' WHEN 1 THEN 'outer_wall.thickness_m' WHEN 2 THEN 'num_floors' END AS parameter,
  CASE turn % 4 WHEN 0 THEN 'ft' WHEN 1 THEN 'inch' WHEN 2 THEN '' END AS unit,
  CASE turn % 4 WHEN 0 THEN round((conv_id % 20) * 0.3048::DOUBLE, 2) WHEN 1 THEN round((conv_id % 30) * 0.0254::DOUBLE, 3)
    WHEN 2 THEN CAST(conv_id AS DOUBLE) END AS value FROM conversations""",
)
def _(t):
    said = t.conversations.select("conv_id", "turn", F.expr(SAID).alias("said"))
    return T.command_extract(said, "said").select("conv_id", "turn", "parameter", "unit", "value")


@q(
    "registry_cells",
    "SELECT project_id, table_id, row_no, CAST(col_no AS INT) AS col_no, header, value, schedule_type FROM v_cells",
    "v_cells",
)
def _(t):
    return t.v_cells


@q(
    "registry_json",
    "SELECT 'R' || CAST(p_partkey AS STRING) AS project_id, tb AS table_id, CAST(r AS INT) AS row_no, CAST(h AS INT) AS col_no, "
    "CASE h WHEN 0 THEN 'Mark' ELSE 'Comments' END AS header, CASE h WHEN 0 THEN tb ||  CAST(p_partkey AS STRING) || '-' || CAST(r AS STRING) ELSE p_name END AS value, "
    "CASE tb WHEN 'D' THEN 'door' ELSE 'window' END AS schedule_type FROM part, (SELECT unnest(['D', 'W']) AS tb), (SELECT unnest([0, 1]) AS r), (SELECT unnest([0, 1]) AS h)",
)
def _(t):
    row = """'{"Mark": "' || tb || CAST(p_partkey AS STRING) || '-%d", "Comments": "' || p_name || '"}'"""
    body = f"'[' || {row % 0} || ', ' || {row % 1} || ']'"
    doc = f"""CASE p_partkey % 3 WHEN 0 THEN {body} WHEN 1 THEN '{{"instance_schedule": ' || {body} || '}}' ELSE '{{"data": ' || {body} || '}}' END"""
    both = t.part.withColumn("tb", F.explode(F.array(F.lit("D"), F.lit("W"))))
    docs = both.select(F.expr("'R' || p_partkey").alias("project_id"), F.col("tb").alias("table_id"), F.expr(doc).alias("value"))
    kind = F.when(F.col("table_id") == "D", "door").otherwise("window")
    return IO.registry_cells(docs, type_hint=kind)


def _canonical_sql():
    whens = []
    for kind, table in (("window", {V.WINDOW_HEADER_FOR.get(k, k): n for k, n in V.HEADER_SYNONYMS.items()}), ("", V.HEADER_SYNONYMS)):
        for k, names in table.items():
            guard = "schedule_type = 'window' AND" if kind else "schedule_type <> 'window' AND"
            whens.append(f"WHEN {guard} lower(header) IN {sql_list(names)} THEN '{k}'")
    return "CASE " + " ".join(whens) + " ELSE upper(header) END"


@q("header_canon", f"SELECT project_id, table_id, row_no, CAST(col_no AS INT) AS col_no, {_canonical_sql()} AS canonical FROM v_cells", "v_cells")
def _(t):
    return C.canonical_header(t.v_cells).select(*C.ROW, "col_no", "canonical")


@q(
    "resolve_mark_loc",
    f"""SELECT project_id, table_id, row_no, coalesce(m, '') AS mark, coalesce(l, '') AS location FROM (SELECT project_id, table_id, row_no,
  min_by(upper(trim(value)), rm * 100 + col_no) FILTER (trim(value) <> '' AND rm IS NOT NULL) AS m,
  min_by(trim(value), rl * 100 + col_no) FILTER (trim(value) <> '' AND rl IS NOT NULL) AS l
  FROM (SELECT *, CASE WHEN lower(trim(header)) IN {sql_list(V.MARK_HEADERS)} THEN 0
      WHEN (contains(lower(header), 'mark') OR contains(lower(header), 'type')) AND lower(trim(header)) NOT IN {sql_list(V.NOT_MARK_HEADERS)} THEN 1 END AS rm,
    CASE WHEN lower(trim(header)) IN {sql_list(V.LOCATION_HEADERS)} THEN 0
      WHEN (contains(lower(header), 'location') OR contains(lower(header), 'room')) THEN 1 END AS rl FROM v_cells) GROUP BY project_id, table_id, row_no)""",
    "v_cells",
)
def _(t):
    cells = t.v_cells
    return C.resolve_mark(cells).join(C.resolve_location(cells), list(C.ROW)).select(*C.ROW, "mark", "location")


@q(
    "schema_map",
    "SELECT row_no, upper(mark) AS mark, door_type AS \"DOOR TYPE\", 'Acme' AS maker, width FROM v_sched",
    "v_sched",
)
def _(t):
    s = t.v_sched.select("row_no", F.upper("mark").alias("d_no"), "door_type", "width", "finish")
    return H.apply_schema_map(
        s, {"d_no": "Door No", "door_type": "DOOR TYPE"}, ["finish"], ["row_no", "mark"], {"maker": "Acme"}
    ).drop("Door No")


@q(
    "append_registry",
    "SELECT row_no, mark, schedule_type FROM v_sched UNION ALL SELECT s_suppkey, s_name, 'window' FROM supplier",
    "v_sched",
)
def _(t):
    new = t.supplier.select(F.col("s_suppkey").alias("row_no"), F.col("s_name").alias("mark"))
    return H.append_registry(t.v_sched.select("row_no", "mark", "schedule_type"), new, "window")


@q("public_cols", "SELECT row_no, mark FROM v_sched", "v_sched")
def _(t):
    s = t.v_sched.select("row_no", "mark", F.lit(1).alias("_x"), F.lit(2).alias("QTY"), F.col("side").alias("INT/EXT"))
    return H.public_columns(s)


LOWH, VAL = "lower(trim(header))", "upper(trim(value))"


@q(
    "row_mode",
    f"""SELECT project_id, table_id, row_no, coalesce(leaf, CASE WHEN dbl THEN 'PR' END, 'SGL') AS opening_mode FROM (SELECT project_id, table_id, row_no,
  min_by(CASE WHEN {VAL} IN {sql_list(V.LEAF_PAIR)} THEN 'PR' ELSE 'SGL' END, col_no) FILTER ({sql_any(LOWH, V.LEAF_HEADERS)}
    AND {VAL} IN {sql_list(V.LEAF_PAIR + V.LEAF_SINGLE)}) AS leaf,
  bool_or({sql_any(LOWH, V.WIDTH_HEADERS)} AND ((contains(value, '/') AND len(list_filter(string_split(value, '/'), lambda p: NOT regexp_matches(p, '[0-9]'))) = 0)
    OR contains(replace(lower(value), ' ', ''), 'x2') OR (contains(value, '(') AND contains(value, '2')))) AS dbl FROM v_cells GROUP BY project_id, table_id, row_no)""",
    "v_cells",
)
def _(t):
    return C.row_opening_mode(t.v_cells)


PAIR_WORD = "list_contains(list_transform(regexp_split_to_array({v}, '\\s+'), lambda w: trim(w, '.,()[]{{}}-_#*')), 'PR')".format(v=VAL)
SLASHED = f"(contains({VAL}, '/') AND len(list_filter(string_split({VAL}, '/'), lambda p: NOT regexp_matches(p, '[0-9]'))) = 0)"
SPOKEN = sql_any(LOWH, V.COMMENT_HEADERS + ["type"])
FEATURES = f"""SELECT project_id, table_id, row_no,
  bool_or(filled AND {VAL} NOT IN {sql_list(V.EXISTING)} AND (contains({LOWH}, 'panel 2') OR contains({LOWH}, 'width 2') OR contains({LOWH}, 'second') OR ends_with({LOWH}, '_2')
    OR (regexp_matches({LOWH}, '\\b2\\b') AND NOT regexp_matches({LOWH}, '\\b1\\b')))) AS panel_2,
  bool_or(filled AND (({sql_any(LOWH, V.LEAF_HEADERS)} AND {VAL} IN {sql_list(V.LEAF_PAIR)}) OR ({sql_any(LOWH, V.WIDTH_HEADERS)} AND {SLASHED})
    OR ({SPOKEN} AND ({sql_any(VAL, V.PAIR_PHRASES)} OR {PAIR_WORD})))) AS pair_leaves,
  coalesce(max_by({VAL}, col_no) FILTER (filled AND {sql_any(LOWH, V.WIDTH_HEADERS)} AND NOT contains({LOWH}, 'frame')), '') AS door_width,
  bool_or(filled AND {sql_any(LOWH, V.HARDWARE_HEADERS)}) AS has_hardware,
  bool_or(filled AND (contains({LOWH}, 'material') OR contains({LOWH}, 'mat''l')) AND {VAL} NOT IN {sql_list(V.EXISTING)}) AS has_material,
  bool_or(filled AND {sql_any(LOWH, V.SIDE_HEADERS)} AND contains({VAL}, 'EXT')) AS explicit_exterior,
  bool_or({SPOKEN} AND contains({VAL}, 'SINGLE')) AS explicit_single,
  coalesce(min_by(upper(value), col_no) FILTER (contains({LOWH}, 'material')), '') AS first_material
  FROM (SELECT *, {VAL} NOT IN {sql_list(V.BLANK_CELL)} AS filled FROM v_cells) GROUP BY project_id, table_id, row_no"""
ROLE_DOOR = f"""(contains({LOWH}, 'door material') OR contains({LOWH}, 'door mat''l') OR contains({LOWH}, 'dr mat')
  OR ((contains({LOWH}, 'panel 1') OR contains({LOWH}, 'door panel') OR contains({LOWH}, 'panel type')) AND NOT contains({LOWH}, 'frame'))
  OR ((contains({LOWH}, 'material') OR contains({LOWH}, 'mat''l')) AND NOT contains({LOWH}, 'frame') AND NOT contains({LOWH}, 'window')))"""
ROLE_FRAME = f"((contains({LOWH}, 'material') OR contains({LOWH}, 'mat''l')) AND contains({LOWH}, 'frame'))"
ROLES = f"""SELECT project_id, table_id, row_no,
  coalesce(max_by({VAL}, col_no) FILTER ({ROLE_DOOR}), '') AS door_material,
  coalesce(max_by({VAL}, col_no) FILTER ({ROLE_FRAME} AND NOT {ROLE_DOOR}), '') AS frame_material,
  coalesce(max_by({VAL}, col_no) FILTER (contains({LOWH}, 'type') AND NOT contains({LOWH}, 'frame') AND NOT contains({LOWH}, 'window')), '') AS door_type,
  coalesce(max_by({VAL}, col_no) FILTER ({sql_any(LOWH, V.COMMENT_HEADERS)}), '') AS comments
  FROM v_cells GROUP BY project_id, table_id, row_no"""


@q("row_features", f"SELECT project_id, table_id, row_no, panel_2, pair_leaves, door_width, has_hardware, has_material, explicit_exterior, explicit_single, first_material, "
   f"NOT explicit_single AND (panel_2 OR pair_leaves OR {WIDTH_SQL.format(c='door_width')} >= 50) AS has_panel_2 FROM ({FEATURES})", "v_cells")
def _(t):
    return C.row_features(t.v_cells).drop("curtain_wall")


@q("role_columns", f"SELECT project_id, table_id, row_no, door_material, frame_material, '' AS window_material, door_type, '' AS frame_type, comments FROM ({ROLES})", "v_cells")
def _(t):
    return C.role_columns(t.v_cells)


SF_MAT = (
    "({c} NOT IN " + sql_list(V.BLANK_STOREFRONT) + " AND (len(list_intersect(string_split_regex({c}, '[^A-Z0-9]+'), "
    + sql_arr(V.STOREFRONT_TOKENS) + ")) > 0 OR contains({c}, 'AL/GL') OR contains({c}, 'GL/AL')))"
)


@q("storefront_token", f"SELECT row_no, {SF_MAT.format(c='door_material')} AS door_sf, {SF_MAT.format(c='frame_material')} AS frame_sf FROM v_sched", "v_sched")
def _(t):
    return t.v_sched.select("row_no", T.sf_material("door_material").alias("door_sf"), T.sf_material("frame_material").alias("frame_sf"))


DRIFT = "regexp_matches(finish, '^[A-Z0-9]+/[A-Z][0-9]+')"


@q(
    "detail_shift",
    f"""SELECT row_no, CASE WHEN {DRIFT} THEN '' ELSE finish END AS "FINISH", CASE WHEN {DRIFT} THEN finish ELSE head END AS "DETAIL HEAD",
  CASE WHEN {DRIFT} THEN head ELSE jamb END AS "DETAIL JAMB", CASE WHEN {DRIFT} THEN jamb END AS "DETAIL SILL" FROM v_sched""",
    "v_sched",
)
def _(t):
    s = t.v_sched.select(
        "row_no", F.col("finish").alias("FINISH"), F.col("head").alias("DETAIL HEAD"), F.col("jamb").alias("DETAIL JAMB")
    )
    return T.repair_detail_shift(s)


@q("bool_text", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END AS is_large FROM part")
def _(t):
    return t.part.select("p_partkey", T.render_bool(F.col("p_size") > 25).alias("is_large"))


@q(
    "bucket_color",
    "SELECT row_no, CASE location WHEN 'Lobby' THEN 'FFFF00' WHEN 'Bedroom' THEN '00B0F0' WHEN 'Stair A' THEN '92D050' WHEN 'Kitchen' THEN 'FFC000' "
    "WHEN 'Mech room' THEN 'FF69B4' ELSE 'FFFF00' END AS color FROM v_sched",
    "v_sched",
)
def _(t):
    bucket = F.expr(
        "CASE location WHEN 'Lobby' THEN 'Interior' WHEN 'Bedroom' THEN 'Exterior' WHEN 'Stair A' THEN 'Soft Exterior' "
        "WHEN 'Kitchen' THEN 'Window' WHEN 'Mech room' THEN 'Not in Scope' ELSE 'Other' END"
    )
    return t.v_sched.select("row_no", T.bucket_color(bucket).alias("color"))


@q(
    "annotation_color",
    """SELECT row_no, CASE WHEN contains(fire_rating, 'BARRIER') OR p.m = 'STOREFRONT' THEN 'FF69B4'
  WHEN p.m = 'GARAGE' THEN '92D050' WHEN p.m = 'WINDOW' THEN 'FFC000' WHEN contains(side, 'EXT') OR contains(fire_rating, 'PARTITION') THEN '00B0F0' ELSE 'FFFF00' END AS color
  FROM (SELECT *, CASE row_no % 10 WHEN 1 THEN 'STOREFRONT' WHEN 3 THEN 'GARAGE' WHEN 5 THEN 'WINDOW' ELSE '' END AS m FROM v_sched) p""",
    "v_sched",
)
def _(t):
    s = t.v_sched.withColumn("m", F.expr("CASE row_no % 10 WHEN 1 THEN 'STOREFRONT' WHEN 3 THEN 'GARAGE' WHEN 5 THEN 'WINDOW' ELSE '' END"))
    rating = F.concat_ws(" ", "fire_rating", F.when(F.col("m") == "GARAGE", F.lit("garage")))
    side = F.when(F.col("m") == "WINDOW", F.lit("Window")).otherwise(F.col("side"))
    mode = F.when(F.col("m") == "STOREFRONT", F.col("m"))
    return s.select("row_no", T.annotation_color(mode, side, rating, F.lit(False)).alias("color"))


ALUM = "(" + sql_any("door_material", V.NOTE_MATERIAL) + " OR door_material IN ('AL', 'GL', 'GLZ'))"


@q(
    "estimator_notes",
    f"""SELECT row_no, CASE WHEN {ALUM} THEN '{V.NOTE_ALUMINIUM}' || CASE WHEN contains(upper(comments), 'STOREFRONT') THEN ' | {V.NOTE_ALUMINIUM_EXCLUDED}' ELSE '' END ELSE '' END AS notes FROM v_sched""",
    "v_sched",
)
def _(t):
    spec = F.when(F.upper("comments").contains("STOREFRONT"), F.lit("Exclusions: excluded systems"))
    return t.v_sched.select("row_no", T.estimator_notes("door_material", spec).alias("notes"))


@q(
    "taxonomy",
    """SELECT row_no, CASE substring(mark, 1, 1) WHEN 'C' THEN 'Clubhouse' WHEN 'D' THEN 'Main' ELSE 'unclear' END AS building,
  CASE WHEN regexp_matches(digits, '^[0-9]{3}') THEN substring(digits, 1, 1) ELSE 'unclear' END AS floor, FALSE AS is_unit_type
  FROM (SELECT row_no, mark, regexp_extract(mark, '([0-9]+)', 1) AS digits FROM v_sched)""",
    "v_sched",
)
def _(t):
    both = t.v_sched.select("row_no", "mark", F.regexp_extract("mark", "([0-9]+)", 1).alias("digits"))
    prefixes = {"C": "Clubhouse", "D": "Main"}
    return both.select(
        "row_no", T.mark_taxonomy("mark", prefixes)["building"].alias("building"),
        T.mark_taxonomy("digits", prefixes)["floor"].alias("floor"), T.mark_taxonomy("mark", prefixes)["is_unit_type"].alias("is_unit_type"),
    )


HUNG = """CASE p_partkey % 9 WHEN 0 THEN 'POCKET ' || p_name WHEN 1 THEN p_name || ' Barn door' WHEN 2 THEN 'Overhead sectional' WHEN 3 THEN 'coiling shutter ' || p_name
  WHEN 4 THEN 'Roll-Up grille' WHEN 5 THEN 'BI-FOLD closet' WHEN 6 THEN 'pocket, coiling' WHEN 7 THEN 'bifold' ELSE p_name END"""


@q("mechanism_words", "SELECT p_partkey, ['sliding', 'sliding', 'overhead', 'overhead', 'overhead', 'bi-fold', 'sliding', 'swing', 'swing'][p_partkey % 9 + 1] AS mechanism FROM part")
def _(t):
    return t.part.select("p_partkey", T.mechanism(F.expr(HUNG)).alias("mechanism"))


@q("mechanism", "SELECT row_no, CASE WHEN contains(lower(location), 'roll-up') THEN 'overhead' ELSE 'swing' END AS mechanism FROM v_sched", "v_sched")
def _(t):
    return t.v_sched.select("row_no", T.mechanism(F.concat_ws(" ", "location", "comments")).alias("mechanism"))


@q(
    "floor_name",
    "SELECT det_id, CASE WHEN floor_name = 'Stilt Floor' THEN 'Ground Floor' ELSE floor_name END AS floor_name FROM v_det",
    "v_det",
)
def _(t):
    return t.v_det.select("det_id", T.floor_name("floor_name").alias("floor_name"))


@q(
    "interior_override",
    f"SELECT det_id, CASE WHEN int_ext = 'Exterior' AND {sql_any('upper(location)', V.INTERIOR_WORDS)} THEN 'Interior' ELSE int_ext END AS int_ext FROM v_det",
    "v_det",
)
def _(t):
    return t.v_det.select("det_id", T.interior_override("int_ext", "location").alias("int_ext"))


@q(
    "mark_text",
    f"""SELECT block, line, word, len(list_intersect(regexp_split_to_array(trim(lower(text), '.,'), '\\s+'), {sql_arr(V.HEADER_WORDS)})) = 0
  AND NOT regexp_matches(text, '[''"]') AND (regexp_matches(text, '[0-9]') OR (length(text) <= 4 AND regexp_matches(text, '[A-Z]') AND text = upper(text))) AS is_mark FROM v_words""",
    "v_words",
)
def _(t):
    return t.v_words.select("block", "line", "word", T.is_mark_text("text").alias("is_mark"))


@q(
    "text_similarity",
    "SELECT p_partkey, 1.0::DOUBLE - levenshtein(upper(p_name), upper(p_type)) / greatest(length(p_name), length(p_type)) AS likeness FROM part",
)
def _(t):
    return t.part.select("p_partkey", T.similarity("p_name", "p_type", "edit").alias("likeness"))


# Rules ---------------------------------------------------------------------------------------

CASED = f"((door_material IN {sql_list(V.BLANK_CASED_MATERIAL)} AND door_type IN {sql_list(V.BLANK_CASED_TYPE)}) OR door_type IN {sql_list(V.CASED_TYPES)})"


@q("cased", f"SELECT row_no, {CASED} AS is_cased FROM v_sched", "v_sched")
def _(t):
    return K.is_cased(t.v_sched).select("row_no", "is_cased")


def rule_rows(t):
    """Schedule rows with the columns the rules read, straight from the typed view."""
    return t.v_sched.select(
        "project_id", "row_no", "mark", "schedule_type", "location", "door_type", F.lit("").alias("frame_type"),
        "door_material", "frame_material", F.lit("").alias("window_material"), F.upper("comments").alias("comments"),
        (F.col("hardware") != "").alias("has_hardware"),
        (~F.col("door_material").isin(V.BLANK_CELL) | ~F.col("frame_material").isin(V.BLANK_CELL)).alias("has_material"),
        (F.col("side") == "EXT").alias("explicit_exterior"), F.lit(False).alias("curtain_wall"),
        ((F.col("leaves") == "2") & ~F.upper("comments").contains("SINGLE") & ~F.col("door_type").contains("SINGLE")).alias("has_panel_2"),
        F.lit("SGL").alias("schedule_mode"),
    )


RULE_ROWS = f"""rr AS (SELECT *, upper(comments) AS uc, {CASED} AS is_cased, hardware <> '' AS has_hardware,
  (door_material NOT IN {sql_list(V.BLANK_CELL)} OR frame_material NOT IN {sql_list(V.BLANK_CELL)}) AS has_material, side = 'EXT' AS explicit_exterior,
  (leaves = '2' AND NOT contains(upper(comments), 'SINGLE') AND NOT contains(door_type, 'SINGLE')) AS has_panel_2,
  (schedule_type = 'window' OR mark LIKE 'W%' OR mark LIKE 'V%') AS is_window FROM v_sched),
rs AS (SELECT *, {sql_any("(door_material || ' ' || frame_material || ' ' || door_type || ' ' || uc)", V.STOREFRONT_PHRASES)}
  OR (is_cased AND has_hardware AND frame_material IN {sql_list(V.BLANK_FRAME)}) OR {SF_MAT.format(c='door_material')} OR {SF_MAT.format(c='frame_material')} AS is_storefront,
  {sql_any('uc', V.DOUBLE_ACTING_PHRASES)} OR {sql_any('door_type', V.DOUBLE_ACTING_PHRASES)}
   OR len(list_intersect(string_split(door_type, ' '), ['DA', 'AB'])) > 0 OR len(list_intersect(string_split(uc, ' '), ['DA', 'AB'])) > 0 AS is_da FROM rr),
rm AS (SELECT *, CASE WHEN is_storefront OR is_window THEN 'STOREFRONT' WHEN is_cased THEN 'CO' WHEN is_da THEN 'DA' WHEN has_panel_2 THEN 'PR' ELSE 'SGL' END AS resolved_mode FROM rs)"""


def resolved_rows(t):
    return K.resolved_mode(K.is_double_acting(K.is_storefront(K.is_cased(rule_rows(t)))))


@q("storefront", f"WITH {RULE_ROWS} SELECT row_no, is_storefront FROM rm", "v_sched")
def _(t):
    return K.is_storefront(K.is_cased(rule_rows(t))).select("row_no", "is_storefront")


@q("double_acting", f"WITH {RULE_ROWS} SELECT row_no, is_da AS is_double_acting FROM rm", "v_sched")
def _(t):
    return K.is_double_acting(rule_rows(t)).select("row_no", "is_double_acting")


@q("resolved_mode", f"WITH {RULE_ROWS} SELECT row_no, resolved_mode FROM rm", "v_sched")
def _(t):
    return resolved_rows(t).select("row_no", "resolved_mode")


SECTION = f"""CASE WHEN mark LIKE 'OH%' OR {sql_any('lower(location)', V.OVERHEAD_LOCATION_WORDS)} OR contains(lower(comments), 'overhead') THEN 'OVERHEAD'
  WHEN mark LIKE 'CO%' OR contains(lower(location), 'cased') OR {sql_any('lower(comments)', ['cased opening', 'frame only'])} THEN 'CASED'
  WHEN mark LIKE 'W%' OR contains(lower(location), 'window') OR contains(lower(comments), 'window') THEN 'WINDOW'
  WHEN {sql_any('lower(location)', V.COMMON_AREA_WORDS)} THEN 'UNIQUE' ELSE 'REPEATING' END"""


@q("section_classifier", f"SELECT row_no, {SECTION} AS section FROM v_sched", "v_sched")
def _(t):
    return K.section(t.v_sched, notes="comments").select("row_no", "section")


@q("route_type", "SELECT row_no, CASE WHEN schedule_type IN ('door', 'window') THEN schedule_type WHEN mark LIKE 'W%' THEN 'window' ELSE 'door' END AS opening_kind FROM v_sched", "v_sched")
def _(t):
    return K.route_type(t.v_sched).select("row_no", "opening_kind")


BUCKETS = f"""bk AS (SELECT *, CASE WHEN explicit_exterior THEN 'Exterior' ELSE 'Interior' END AS side5,
  {sql_any('lower(comments)', V.MULTIFOLD_WORDS)} AS multifold, {sql_any('lower(comments)', V.SIDELITE_WORDS)} AS sidelite, {sql_any('lower(comments)', V.SOFT_EXTERIOR_WORDS)} AS soft FROM rm),
bb AS (SELECT *, multifold OR is_storefront AS excluded, CASE WHEN multifold OR is_storefront THEN 'Not in Scope' WHEN is_window OR sidelite THEN 'Window'
    WHEN is_cased THEN side5 WHEN soft THEN 'Soft Exterior' ELSE side5 END AS bucket,
  CASE WHEN multifold THEN '{V.NOTE_MULTIFOLD}' WHEN is_storefront THEN 'Door Excluded. Door material ' || coalesce(nullif(door_material, ''), 'HM') || ' but on elevation it is storefront.'
    WHEN is_window THEN NULL WHEN sidelite THEN '{V.NOTE_SIDELITE}' WHEN is_cased THEN '{V.NOTE_CASED}' END AS note FROM bk)"""


def bucket_rows(t):
    rows = resolved_rows(t).withColumns({"plan_wall": F.lit(None).cast("string"), "located": F.lit(False)})
    return K.bucket5(K.int_ext(rows), "comments")


@q("bucket5", f"WITH {RULE_ROWS}, {BUCKETS} SELECT row_no, excluded, bucket, note FROM bb", "v_sched")
def _(t):
    return bucket_rows(t).select("row_no", "excluded", "bucket", "note")


@q(
    "ad_override",
    f"""WITH {RULE_ROWS}, {BUCKETS} SELECT row_no, (resolved_mode = 'STOREFRONT' OR contains(uc, 'AD SYSTEM')) AS is_ad_system,
  CASE WHEN resolved_mode = 'STOREFRONT' THEN 'STOREFRONT' WHEN NOT sidelite THEN resolved_mode END AS reconciled_mode,
  CASE WHEN resolved_mode = 'STOREFRONT' AND is_window AND NOT is_storefront AND NOT excluded THEN bucket WHEN resolved_mode = 'STOREFRONT' THEN 'Not in Scope' ELSE bucket END AS reconciled_int_ext FROM bb""",
    "v_sched",
)
def _(t):
    rows = K.ad_override(bucket_rows(t).withColumn("final_mode", F.col("resolved_mode")))
    return rows.select("row_no", "is_ad_system", "reconciled_mode", "reconciled_int_ext")


@q(
    "scope",
    f"WITH {RULE_ROWS} SELECT row_no, NOT is_storefront AND NOT {SF_MAT.format(c='door_material')} AND (door_material IN ('HM', 'WD') OR is_cased) AS in_scope FROM rm",
    "v_sched",
)
def _(t):
    return K.scope(resolved_rows(t)).select("row_no", "in_scope")


@q("drop_unmarked", "SELECT row_no, mark FROM (SELECT row_no, CASE row_no % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'Fire Rating' ELSE mark END AS mark FROM v_sched) WHERE trim(mark) <> '' AND mark <> 'Fire Rating'", "v_sched")
def _(t):
    rows = t.v_sched.select("row_no", F.expr("CASE row_no % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'Fire Rating' ELSE mark END").alias("mark"))
    return T.drop_unmarked(rows)


@q(
    "drop_banners",
    """WITH b AS (SELECT project_id, table_id, row_no, col_no, header, CASE WHEN row_no % 6 = 0 AND table_id = 'T0' AND col_no > 0 THEN '' ELSE value END AS value FROM v_cells)
  SELECT project_id, table_id, row_no, CAST(col_no AS INT) AS col_no, header, value FROM b WHERE (project_id, table_id, row_no) NOT IN (SELECT (project_id, table_id, row_no) FROM b WHERE trim(value) <> '' GROUP BY project_id, table_id, row_no HAVING count(*) = 1)""",
    "v_cells",
)
def _(t):
    cells = t.v_cells.withColumn("value", F.when((F.col("row_no") % 6 == 0) & (F.col("table_id") == "T0") & (F.col("col_no") > 0), "").otherwise(F.col("value")))
    return C.drop_banners(cells).select(*C.ROW, "col_no", "header", "value")


@q(
    "drop_empty_cols",
    """SELECT project_id, table_id, row_no, CAST(col_no AS INT) AS col_no, header, value FROM (SELECT project_id, table_id, row_no, col_no, CASE WHEN col_no % 4 = 1 THEN 'COLUMN_' || CAST(col_no AS STRING) ELSE header END AS header,
  CASE WHEN col_no = 5 THEN '' ELSE value END AS value FROM v_cells) WHERE header <> 'COLUMN_5'""",
    "v_cells",
)
def _(t):
    header = F.when(F.col("col_no") % 4 == 1, F.concat(F.lit("COLUMN_"), F.col("col_no").cast("string"))).otherwise(F.col("header"))
    cells = t.v_cells.withColumns({"header": header, "value": F.when(F.col("col_no") == 5, "").otherwise(F.col("value"))})
    return C.drop_blank_columns(cells).select(*C.ROW, "col_no", "header", "value")


@q(
    "union_by_name",
    "SELECT row_no, mark, width, NULL AS acctbal FROM v_sched UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier",
    "v_sched",
)
def _(t):
    return C.union_rows(
        t.v_sched.select("row_no", "mark", "width"),
        t.supplier.select(F.col("s_suppkey").alias("row_no"), F.col("s_name").alias("mark"), F.col("s_acctbal").alias("acctbal")),
    )
