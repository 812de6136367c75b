"""Queries over table rebuilding, totals, gates, registry edits, streams and the full reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintel.operators import changes as H
from lintel.operators import classify as K
from lintel.operators import dedup as D
from lintel.operators import matrix as M
from lintel.operators import qa as Q
from lintel.operators import tables as B
from lintel.operators.reconcile import reconcile
from lintel.plans import q_joins as QJ
from lintel.plans import q_text as QT
from lintel.plans.views import CELLS, catalog
from lintel.sources import io as IO
from lintel.streaming import stream as ST

q = catalog.add
LINE = "project_id, page_id, block, line"


@q(
    "word_islands",
    f"""WITH p AS (SELECT *, lag(x1) OVER (PARTITION BY block, line ORDER BY x0, word) AS px1 FROM v_words),
  g AS (SELECT *, sum(CASE WHEN x0 - px1 >= 0 AND x0 - px1 < 2.5 THEN 0 ELSE 1 END) OVER (PARTITION BY block, line ORDER BY x0, word ROWS UNBOUNDED PRECEDING) AS island FROM p)
  SELECT block, line, min(word) AS word, string_agg(text, '' ORDER BY word) AS text, min(x0) AS x0, max(x1) AS x1 FROM g GROUP BY block, line, island""",
    "v_words",
)
def _(t):
    return B.join_words(t.v_words).select("block", "line", "word", "text", "x0", "x1")


@q(
    "interval_merge",
    """WITH i AS (SELECT user_id, CAST(epoch_us(ts) // 1000000 AS DOUBLE) AS lo, CAST(epoch_us(ts) // 1000000 AS DOUBLE) + floor(value) * 600 AS hi FROM events),
  m AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM i),
  g AS (SELECT *, sum(CASE WHEN pm IS NULL OR lo > pm + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS span_no FROM m)
  SELECT user_id, CAST(span_no AS BIGINT) AS span_no, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY user_id, span_no""",
)
def _(t):
    at = "cast(unix_micros(cast(ts as timestamp)) div 1000000 as double)"
    spans = t.events.select("user_id", F.expr(at).alias("lo"), F.expr(f"{at} + floor(value) * 600").alias("hi"))
    return B.merge_intervals(spans, key=["user_id"])


@q(
    "row_groups",
    """WITH RECURSIVE p AS (SELECT DISTINCT user_id, epoch_us(ts) // 3600000000 AS pos FROM events), n AS MATERIALIZED (SELECT p.user_id, p.pos, x.pos AS nxt FROM (SELECT user_id, pos, pos + 24 AS lim FROM p) p
   ASOF LEFT JOIN p x ON p.user_id = x.user_id AND p.lim <= x.pos),
  s AS (SELECT user_id, min(pos) AS st FROM p GROUP BY 1 UNION ALL SELECT s.user_id, n.nxt FROM s JOIN n ON s.user_id = n.user_id AND s.st = n.pos WHERE n.nxt IS NOT NULL)
  SELECT e.event_id, CAST(s.st AS BIGINT) AS row_start FROM (SELECT event_id, user_id, epoch_us(ts) // 3600000000 AS pos FROM events) e ASOF JOIN s ON e.user_id = s.user_id AND e.pos >= s.st""",
)
def _(t):
    rows = t.events.select("event_id", "user_id", F.expr("unix_micros(cast(ts as timestamp)) div 3600000000").alias("y0"))
    return B.group_rows(rows, 24, ["user_id"]).select("event_id", "row_start")


EDGES = "SELECT 'S' || CAST(l_suppkey AS STRING) AS page_id, CAST(l_orderkey * 17 % 12000 AS DOUBLE) / 4 AS x0, 0.0::DOUBLE AS y0, l_quantity AS y1 FROM lineitem"


@q(
    "line_clusters",
    f"""WITH e AS ({EDGES}), p AS (SELECT *, lag(x0) OVER (PARTITION BY page_id ORDER BY x0) AS px FROM e),
  g AS (SELECT *, sum(CASE WHEN px IS NULL OR x0 - px > 2.5 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY x0 ROWS UNBOUNDED PRECEDING) AS cluster FROM p)
  SELECT page_id, sum(x0) / count(*) AS x, sum(y1 - y0) AS total_len FROM g GROUP BY page_id, cluster HAVING sum(y1 - y0) >= 60""",
)
def _(t):
    edges = t.lineitem.select(
        F.expr("'S' || l_suppkey").alias("page_id"), F.expr("cast(l_orderkey * 17 % 12000 as double) / 4").alias("x0"), F.lit(0.0).alias("y0"), F.col("l_quantity").alias("y1")
    )
    return B.line_clusters(edges, min_len=60, key=["page_id"]).select("page_id", "x", "total_len")


@q(
    "header_suffix",
    "SELECT block, line, word, text || CASE WHEN n > 1 THEN '_' || CAST(n - 1 AS STRING) ELSE '' END AS text FROM (SELECT *, row_number() OVER (PARTITION BY block, line, text ORDER BY word) AS n FROM v_words)",
    "v_words",
)
def _(t):
    return B.suffix_duplicates(t.v_words, ["block", "line"], "word", "text").select("block", "line", "word", "text")


HEAD_VALUE = "CASE WHEN line = 0 AND word % 3 > 0 THEN '' WHEN line = 1 AND word = 0 AND block % 2 = 0 THEN '' ELSE text END"


@q(
    "header_ffill",
    f"""WITH c AS (SELECT block, line, word, {HEAD_VALUE} AS value FROM v_words WHERE line <= 1),
  h AS (SELECT block, word AS col_no, coalesce(max(value) FILTER (line = 0), '') AS r0, coalesce(max(value) FILTER (line = 1), '') AS r1 FROM c GROUP BY ALL),
  two AS (SELECT block, NOT coalesce(bool_or(word = 0 AND value <> ''), FALSE) AND bool_or(value <> '') AS pair FROM c WHERE line = 1 GROUP BY block),
  f AS (SELECT h.*, coalesce(pair, FALSE) AS pair, coalesce(last_value(nullif(r0, '') IGNORE NULLS) OVER (PARTITION BY block ORDER BY col_no ROWS UNBOUNDED PRECEDING), '') AS p FROM h LEFT JOIN two USING (block))
  SELECT block, col_no, CASE WHEN pair THEN trim(p || ' ' || r1) ELSE r0 END AS header, CASE WHEN pair THEN 2 ELSE 1 END AS data_start FROM f""",
    "v_words",
)
def _(t):
    cells = t.v_words.select("block", F.col("line").alias("row_no"), F.col("word").alias("col_no"), F.expr(HEAD_VALUE).alias("value"))
    return B.flatten_headers(cells, ["block"])


IS_MARK = f"""(len(list_intersect([lower(trim(text, '.,'))], {QT.sql_arr(QT.V.HEADER_WORDS)})) = 0
    AND NOT regexp_matches(text, '[''"]') AND (regexp_matches(text, '[0-9]') OR (length(text) <= 4 AND regexp_matches(text, '[A-Z]') AND text = upper(text))))"""
STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


@q(
    "continuation_rows",
    f"""WITH g AS (SELECT doc_id, line, line_text, sum(CASE WHEN line % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS grp FROM v_lines)
  SELECT doc_id, min(line) AS line, 'M' || CAST(min(line) AS STRING) AS mark, coalesce(string_agg({STRIP.format(c='line_text')}, ' ' ORDER BY line) FILTER ({STRIP.format(c='line_text')} <> ''), '') AS comments FROM g GROUP BY doc_id, grp""",
    "v_lines",
)
def _(t):
    rows = t.v_lines.select("doc_id", "line", F.expr("CASE WHEN line % 3 = 0 THEN 'M' || line ELSE '' END").alias("mark"), F.col("line_text").alias("comments"))
    return B.join_continuations(rows, key=["doc_id"], order="line")


@q(
    "mark_column",
    f"""WITH m AS (SELECT block, word, count(DISTINCT upper(trim(text))) AS n FROM v_words WHERE word < 3 AND len(list_intersect([lower(trim(text, '.,'))], {QT.sql_arr(QT.V.HEADER_WORDS)})) = 0
    AND NOT regexp_matches(text, '[''"]') AND (regexp_matches(text, '[0-9]') OR (length(text) <= 4 AND regexp_matches(text, '[A-Z]') AND text = upper(text))) GROUP BY ALL)
  SELECT b.block, coalesce(arg_max(word, (n, -word)), 0) AS mark_col, CAST(coalesce(max(n), 0) AS BIGINT) AS n_marks FROM (SELECT DISTINCT block FROM v_words) b LEFT JOIN m USING (block) GROUP BY b.block""",
    "v_words",
)
def _(t):
    return B.mark_column(t.v_words, ["block"], col_no="word")


@q("ordered_text", "SELECT block, string_agg(text, ' ' ORDER BY line, word) AS text FROM v_words GROUP BY block", "v_words")
def _(t):
    return B.ordered_text(t.v_words, "block", ("y0", "x0"))


UPPER = "replace(replace(upper({c}), 'ß', 'SS'), 'ẞ', 'SS')"


@q(
    "words_to_table",
    f"""WITH RECURSIVE w AS MATERIALIZED (SELECT project_id, block, text, x0, x1, y0, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, {IS_MARK} AS is_mark FROM v_words WHERE {STRIP.format(c='text')} <> ''),
  p AS (SELECT DISTINCT block, y0 AS pos FROM w), nx AS MATERIALIZED (SELECT p.block, p.pos, x.pos AS nxt FROM (SELECT block, pos, pos + 4 AS lim FROM p) p ASOF LEFT JOIN p x ON p.block = x.block AND p.lim <= x.pos),
  s AS (SELECT block, min(pos) AS st FROM p GROUP BY 1 UNION ALL SELECT s.block, nx.nxt FROM s JOIN nx ON s.block = nx.block AND s.st = nx.pos WHERE nx.nxt IS NOT NULL),
  r AS (SELECT w.*, s.st FROM w ASOF JOIN s ON w.block = s.block AND w.y0 >= s.st),
  ld AS (SELECT block, st, arg_min(is_mark, (x0, text)) AS data FROM r GROUP BY ALL), dp AS (SELECT DISTINCT block FROM ld WHERE data),
  iv AS (SELECT block, x0 AS lo, max(x1) AS hi FROM r JOIN ld USING (block, st) WHERE data OR block NOT IN (SELECT block FROM dp) GROUP BY ALL),
  m AS (SELECT *, max(hi) OVER (PARTITION BY block ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM iv),
  g AS (SELECT *, sum(CASE WHEN pm IS NULL OR lo > pm + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY block ORDER BY lo ROWS UNBOUNDED PRECEDING) - 1 AS col_no FROM m),
  sp AS (SELECT block, CAST(col_no AS INT) AS col_no, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY ALL),
  at_ AS (SELECT block, cx, arg_min(col_no, (greatest(0, lo - cx, cx - hi), col_no)) AS col_no FROM (SELECT DISTINCT block, cx FROM w) JOIN sp USING (block) GROUP BY ALL),
  pl AS MATERIALIZED (SELECT w.*, col_no FROM w JOIN at_ USING (block, cx)),
  mc AS (SELECT block, coalesce(arg_max(col_no, (n, -col_no)), 0) AS mark_col FROM (SELECT DISTINCT block FROM pl) LEFT JOIN
   (SELECT block, col_no, count(DISTINCT {UPPER.format(c=STRIP.format(c='text'))}) AS n FROM pl WHERE col_no < 3 AND is_mark GROUP BY ALL) USING (block) GROUP BY block),
  nb AS MATERIALIZED (SELECT project_id, block, cy, {UPPER.format(c='text')} AS m, row_number() OVER (PARTITION BY block ORDER BY cy, x0, text) AS row_no FROM pl JOIN mc USING (block) WHERE col_no = mark_col AND is_mark),
  f AS (SELECT pl.*, cy < coalesce(top, 'inf'::DOUBLE) AS above FROM pl LEFT JOIN (SELECT block, min(cy) - 8 AS top FROM nb GROUP BY 1) USING (block)),
  nm AS (SELECT block, col_no, trim(string_agg(text, ' ' ORDER BY y0, x0, text)) AS header FROM f WHERE above GROUP BY ALL),
  hd AS (SELECT block, col_no, CASE WHEN col_no = mark_col THEN 'mark' WHEN header IS NULL THEN 'COLUMN_' || CAST(col_no AS STRING)
    WHEN n > 1 THEN header || '_' || CAST(n - 1 AS STRING) ELSE header END AS header FROM (SELECT sp.block, sp.col_no, header, row_number() OVER (PARTITION BY sp.block, header ORDER BY sp.col_no) AS n FROM sp LEFT JOIN nm USING (block, col_no)) JOIN mc USING (block)),
  an AS (SELECT block, cy AS pos, min(row_no) AS id FROM nb GROUP BY ALL),
  lo AS (SELECT y.block, y.cy, an.pos AS lp, an.id AS li FROM (SELECT DISTINCT block, cy FROM f WHERE NOT above) y ASOF LEFT JOIN an ON y.block = an.block AND y.cy >= an.pos),
  hi AS (SELECT lo.*, an.pos AS hp, an.id AS hi FROM lo ASOF LEFT JOIN an ON lo.block = an.block AND lo.cy <= an.pos),
  vl AS (SELECT f.block, CASE WHEN lp IS NULL THEN hi.hi WHEN hp IS NULL OR f.cy - lp <= hp - f.cy THEN li ELSE hi.hi END AS row_no, col_no, string_agg(text, ' ' ORDER BY y0, x0, text) AS value FROM f JOIN hi ON f.block = hi.block AND f.cy = hi.cy WHERE NOT above GROUP BY ALL),
  c AS (SELECT project_id, block, nb.row_no, hd.col_no, header, CASE WHEN header = 'mark' THEN {UPPER.format(c="coalesce(nullif(value, ''), m)")} ELSE coalesce(value, '') END AS value FROM nb JOIN hd USING (block) LEFT JOIN vl ON vl.block = nb.block AND vl.row_no = nb.row_no AND vl.col_no = hd.col_no)
  SELECT project_id, block, row_no, col_no, header, value FROM c WHERE NOT starts_with(header, 'COLUMN_') OR (block, header) IN (SELECT (block, header) FROM c WHERE value <> '')""",
    "v_words",
)
def _(t):
    return B.words_to_table(t.v_words, key=["project_id", "block"])


# Totals ----------------------------------------------------------------------------------------


@q(
    "section_rollup",
    f"""WITH s AS (SELECT 'B' || CAST(supp_no % 3 AS STRING) AS building, floor_name AS floor, {QT.SECTION.replace('location', "''").replace('comments', "''")} AS section, mark FROM v_det)
  SELECT building, floor, section, mark, CAST(count(*) AS BIGINT) AS qty, CAST(grouping(building, floor, section, mark) AS BIGINT) AS level FROM s GROUP BY ROLLUP (building, floor, section, mark)""",
    "v_det",
)
def _(t):
    d = t.v_det.select("building", F.col("floor_name").alias("floor"), "mark", F.lit("").alias("location"), F.lit("").alias("notes"), F.lit(1).alias("qty"))
    return M.section_totals(K.section(d))


UNITS = "SELECT CASE WHEN c_nationkey % 5 < 4 THEN 'B' || CAST(c_nationkey % 3 AS STRING) END AS building, c_mktsegment || CASE WHEN c_acctbal < 0 THEN '-ADA' ELSE '' END AS unit_type, o_orderpriority AS floor FROM orders JOIN customer ON c_custkey = o_custkey"


def units(t):
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.expr("CASE WHEN c_nationkey % 5 < 4 THEN 'B' || c_nationkey % 3 END").alias("building"),
        F.expr("c_mktsegment || CASE WHEN c_acctbal < 0 THEN '-ADA' ELSE '' END").alias("unit_type"),
        F.col("o_orderpriority").alias("floor"), F.lit(1).alias("count"),
    )


@q(
    "unit_cube",
    f"""SELECT * FROM (SELECT building, unit_type, floor, CAST(count(*) AS BIGINT) AS n_units, CAST(grouping(building, unit_type, floor) AS BIGINT) AS level FROM ({UNITS}) GROUP BY CUBE (building, unit_type, floor)) WHERE level < 4 OR level = 7""",
)
def _(t):
    return M.unit_count(units(t))


@q(
    "extended_doors",
    f"""WITH u AS (SELECT building, unit_type, count(*) AS n FROM ({UNITS}) GROUP BY ALL), d AS (SELECT 'B' || CAST(n_nationkey % 3 AS STRING) AS building, unit_type, r_name AS tag, sum(n_nationkey) AS inp
    FROM nation JOIN region ON r_regionkey = n_regionkey, (SELECT DISTINCT unit_type FROM u) GROUP BY ALL)
  SELECT building, unit_type, tag, CAST(sum(n * inp) AS BIGINT) AS extended, CAST(grouping(building, unit_type, tag) AS BIGINT) AS level FROM u JOIN d USING (building, unit_type)
  GROUP BY GROUPING SETS ((building, unit_type, tag), (building, unit_type), (building, tag), (building))""",
)
def _(t):
    u = units(t)
    tags = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.expr("'B' || n_nationkey % 3").alias("building"), F.col("r_name").alias("tag"), F.col("n_nationkey").alias("per_unit")
    )
    kinds = u.select("building", "unit_type").distinct()
    every = kinds.select("unit_type").distinct().withColumn("building", F.explode(F.array(*[F.lit(f"B{i}") for i in range(3)])))
    return M.extended_doors(u, tags.join(every, "building"), ("building", "unit_type"))


@q(
    "expand_layout",
    """WITH s AS (SELECT project_id, building, CASE floor_no % 4 WHEN 0 THEN 'TYPICAL_REPEATED' WHEN 1 THEN 'EACH_FLOOR_UNIQUE' WHEN 2 THEN 'UNIT_TYPE_REPEATED' ELSE 'SINGLE_FLOOR' END AS layout, floor_no, location AS unit_type, vlm_opening_mode AS type FROM v_det),
  o AS (SELECT 'P' || CAST(p % 8 AS STRING) AS project_id, 'B' || CAST(s_suppkey % 3 AS STRING) AS building, 'Unit ' || CAST(s_suppkey AS STRING) AS unit_type, s_nationkey AS occ FROM supplier, (SELECT unnest(range(8)) AS p))
  SELECT project_id, building, type, CAST(sum(CASE layout WHEN 'TYPICAL_REPEATED' THEN floor_no WHEN 'UNIT_TYPE_REPEATED' THEN coalesce(occ, 1) ELSE 1 END) AS BIGINT) AS total FROM s LEFT JOIN o USING (project_id, building, unit_type) GROUP BY ALL""",
    "v_det",
)
def _(t):
    layout = "CASE floor_no % 4 WHEN 0 THEN 'TYPICAL_REPEATED' WHEN 1 THEN 'EACH_FLOOR_UNIQUE' WHEN 2 THEN 'UNIT_TYPE_REPEATED' ELSE 'SINGLE_FLOOR' END"
    sheets = t.v_det.select(
        "project_id", "building", F.col("location").alias("unit_type"), F.col("vlm_opening_mode").alias("type"),
        F.expr(layout).alias("layout"), F.col("floor_no").alias("n_floors"), F.lit(1).alias("count"),
    )
    occ = t.supplier.select(
        F.explode(F.sequence(F.lit(0), F.lit(7))).alias("p"), F.expr("'B' || s_suppkey % 3").alias("building"),
        F.expr("'Unit ' || s_suppkey").alias("unit_type"), F.col("s_nationkey").alias("occurrences"),
    ).withColumn("project_id", F.expr("'P' || p"))
    return M.expand_layout(sheets, matrix=occ)


FLOORS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
TAGS = ["F", "O", "P"]


@q(
    "unit_pivot",
    "SELECT building, unit_type, " + ", ".join(f"CAST(count(*) FILTER (floor = '{f}') AS BIGINT) AS \"{f}\"" for f in FLOORS)
    + f", CAST(count(*) AS BIGINT) AS total FROM ({UNITS}) GROUP BY ALL",
)
def _(t):
    return M.unit_count_pivot(units(t), FLOORS)


@q(
    "unit_door_pivot",
    "WITH l AS (SELECT c_mktsegment AS unit_type, CASE WHEN c_mktsegment = 'BUILDING' AND o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS tag, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL) SELECT unit_type, "
    + ", ".join(f"CAST(coalesce(max(n % 7) FILTER (tag = '{g}'), 0) AS BIGINT) AS \"{g}_Input\", CAST(coalesce(sum(n) FILTER (tag = '{g}'), 0) AS BIGINT) AS \"{g}_Extended\"" for g in TAGS)
    + ", CAST(sum(n) AS BIGINT) AS row_total FROM l GROUP BY unit_type",
)
def _(t):
    tag = F.expr("CASE WHEN c_mktsegment = 'BUILDING' AND o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END")
    joined = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    long = joined.groupBy(F.col("c_mktsegment").alias("unit_type"), tag.alias("tag")).agg(F.count(F.lit(1)).alias("extended"))
    return M.unit_door_pivot(long.withColumn("input", F.col("extended") % 7), TAGS, key=())


@q("section_counts", f"SELECT project_id, {QT.SECTION} AS section, CAST(count(*) AS BIGINT) AS n_rows FROM v_sched GROUP BY ALL", "v_sched")
def _(t):
    return M.section_counts(K.section(t.v_sched, notes="comments"))


@q("totals_by", "SELECT building, wall_type, CAST(sum(floor_no) AS BIGINT) AS total FROM v_det GROUP BY ALL", "v_det")
def _(t):
    return M.totals_by(t.v_det, ["building", "wall_type"], "floor_no")


@q(
    "door_schedule_23",
    f"""WITH {QJ.STATUS} SELECT row_no, CAST(coalesce(qty, 0) AS STRING) AS "Qty", mark AS "NUMBER", location AS "LOCATION", resolved_mode AS "Opening Mode", bucket AS "Int/Ext", 'DRY' AS "Wall Type",
  takeoff_notes AS "Takeoff Notes", width AS "WIDTH", '' AS "HEIGHT", '' AS "THICKNESS", door_type AS "DOOR TYPE", door_material AS "DOOR MATERIAL", finish AS "DOOR FINISH", '' AS "FRAME TYPE",
  frame_material AS "FRAME MATERIAL", '' AS "FRAME FINISH", head AS "HEAD", jamb AS "JAMB", '' AS "SILL", fire_rating AS "FIRE RATING", hardware AS "HARDWARE SET", 'No' AS "KEY CARD READER", uc AS "COMMENTS" FROM st""",
    "v_sched", "v_det",
)
def _(t):
    extra = t.v_sched.select(
        "row_no", F.col("location").alias("LOCATION"), F.col("width").alias("WIDTH"), F.col("finish").alias("FINISH"), F.col("head").alias("DETAIL HEAD"),
        F.col("jamb").alias("DETAIL JAMB"), F.col("fire_rating").alias("FIRE RATING"), F.col("hardware").alias("HARDWARE GROUP NO"),
    )
    rows = QJ.status_rows(t).withColumn("reconciled_mode", F.col("final_mode"))
    named = rows.select(
        "row_no", "qty", "mark", "reconciled_mode", "bucket", "takeoff_notes", F.col("door_type").alias("DOOR TYPE"),
        F.col("door_material").alias("DOOR MATERIAL"), F.col("frame_material").alias("FRAME MATERIAL"), F.col("comments").alias("COMMENTS"),
    )
    return M.door_schedule_23(named.join(extra, "row_no"), ("row_no",))


# Gates -----------------------------------------------------------------------------------------


NOTE_7 = "CASE WHEN row_no % 4 = 1 AND row_no % 8 < 4 THEN '' ELSE fire_rating END"
GATE_9 = """g9 AS (SELECT project_id, count(*) AS n FROM (SELECT project_id FROM doors WHERE is_cased AND section <> 'CASED'
   UNION ALL SELECT project_id FROM (SELECT DISTINCT project_id, mark FROM v_det WHERE mark LIKE 'OH%') o WHERE (o.project_id, o.mark) NOT IN (SELECT (project_id, original) FROM doors WHERE section = 'OVERHEAD')) GROUP BY 1)"""


@q(
    "qa_gates",
    f"""WITH d AS (SELECT *, contains(fire_rating, 'BARRIER') AS excluded, {NOTE_7} AS note, {QT.SECTION} AS section, door_type = 'CO' AND project_id = 'P1' AS is_cased FROM v_sched), {QJ.BIFURCATED},
  p AS (SELECT DISTINCT project_id FROM v_sched),
  u AS (SELECT project_id, count(*) FILTER (floor_no % 2 = 0) AS plan, count(*) FILTER (floor_no % 2 = 0) AS matrix, count(*) FILTER (floor_no IN (2, 4, 6) OR (floor_no = 7 AND project_id = 'P3')) AS mix FROM v_det GROUP BY project_id, building),
  un AS (SELECT project_id, building AS unit_type, sum(floor_no % 2) AS units FROM v_det GROUP BY ALL),
  inp AS (SELECT project_id, building AS unit_type, wall_type AS tag, sum(page_no) AS doors FROM v_det GROUP BY ALL),
  mx AS (SELECT project_id, unit_type, tag, units, doors, units * coalesce(doors, 1) AS right_, units * coalesce(doors, 1) + CASE WHEN project_id = 'P5' THEN 1 ELSE 0 END AS extended
   FROM un JOIN (SELECT DISTINCT project_id, wall_type AS tag FROM v_det) USING (project_id) LEFT JOIN inp USING (project_id, unit_type, tag)),
  doors AS (SELECT project_id, mark AS original, section, is_cased FROM d UNION ALL SELECT d.project_id, b.original, d.section, d.is_cased FROM bif b JOIN d ON d.project_id = b.project_id AND d.row_no = b.row_no WHERE is_bifurcated AND NOT (b.project_id = 'P6' AND b.mark LIKE '%.2')),
  g1 AS (SELECT project_id, count(*) AS n FROM (SELECT DISTINCT project_id, mark FROM v_det WHERE (project_id, mark) NOT IN (SELECT (project_id, mark) FROM v_sched)) GROUP BY 1),
  g2 AS (SELECT project_id, count(*) FILTER (plan <> matrix OR plan <> mix) AS n FROM u GROUP BY 1),
  g3 AS (SELECT project_id, count(*) FILTER (x <> e) AS n FROM (SELECT project_id, tag, sum(extended) AS x, sum(right_) + CASE WHEN project_id = 'P2' THEN 1 ELSE 0 END AS e FROM mx GROUP BY project_id, tag) GROUP BY 1),
  g5 AS (SELECT project_id, count(*) FILTER (extended <> right_) AS n FROM mx WHERE doors IS NOT NULL GROUP BY 1),
  g7 AS (SELECT project_id, count(*) FILTER (excluded AND note = '') AS n FROM d GROUP BY 1),
  g8 AS (SELECT project_id, count(*) FILTER (n <> walls OR blank) AS n FROM (SELECT b.project_id, b.original, any_value(len(v.ws)) AS walls, count(DISTINCT b.mark) FILTER (NOT (b.project_id = 'P6' AND b.mark LIKE '%.2')) AS n,
   bool_or(b.project_id = 'P4' AND b.mark LIKE '%.1') AS blank FROM bif b JOIN v ON v.project_id = b.project_id AND v.mark = b.original WHERE is_bifurcated GROUP BY 1, 2) GROUP BY 1),
  {GATE_9}
  SELECT project_id, gate, CAST(coalesce(n, 0) AS BIGINT) AS n_issues, CASE WHEN na THEN 'NOT_APPLICABLE' WHEN coalesce(n, 0) = 0 THEN 'PASSED' ELSE 'REVIEW_REQUIRED' END AS status FROM (
   SELECT p.project_id, 'gate1_schedule_reconciliation' AS gate, n, FALSE AS na FROM p LEFT JOIN g1 USING (project_id)
   UNION ALL SELECT p.project_id, 'gate2_unit_count_reconciliation', n, FALSE FROM p LEFT JOIN g2 USING (project_id)
   UNION ALL SELECT p.project_id, 'gate3_unit_door_matrix', n, FALSE FROM p LEFT JOIN g3 USING (project_id)
   UNION ALL SELECT project_id, 'gate4_formula_validation', 0, TRUE FROM p
   UNION ALL SELECT p.project_id, 'gate5_spot_checks', n, g5.project_id IS NULL FROM p LEFT JOIN g5 USING (project_id)
   UNION ALL SELECT p.project_id, 'gate7_scope_review', n, FALSE FROM p LEFT JOIN g7 USING (project_id)
   UNION ALL SELECT p.project_id, 'gate8_bifurcation_completeness', n, g8.project_id IS NULL FROM p LEFT JOIN g8 USING (project_id)
   UNION ALL SELECT p.project_id, 'gate9_cased_overhead', n, FALSE FROM p LEFT JOIN g9 USING (project_id))""",
    "v_sched", "v_det",
)
def _(t):
    """Every gate with inputs it can be held against: each passes in some projects and fails in others."""
    det = t.v_det
    plain = K.section(t.v_sched.withColumns(
        {"excluded": F.col("fire_rating").contains("BARRIER"), "is_bifurcated": F.lit(False), "original_tag": F.lit(None).cast("string"),
         "takeoff_notes": F.expr(NOTE_7), "is_cased": F.expr("door_type = 'CO' AND project_id = 'P1'")}
    ), notes="comments")
    split = D.bifurcate(t.v_sched, det).where("is_bifurcated AND NOT (project_id = 'P6' AND mark LIKE '%.2')").withColumns(
        {"excluded": F.lit(False), "is_cased": F.expr("door_type = 'CO' AND project_id = 'P1'"),
         "takeoff_notes": F.expr("CASE WHEN project_id = 'P4' AND mark LIKE '%.1' THEN '' ELSE bifurcation_note END")}
    )
    cols = ["project_id", "mark", "section", "excluded", "takeoff_notes", "is_bifurcated", "original_tag", "is_cased"]
    even = F.expr("cast(floor_no % 2 = 0 as int)")
    counts = det.groupBy("project_id", "building").agg(
        F.sum(even).alias("plan"), F.sum(even).alias("matrix"), F.sum(F.expr("cast(floor_no in (2, 4, 6) or (floor_no = 7 and project_id = 'P3') as int)")).alias("mix"),
    )
    mix = det.select("project_id", F.col("building").alias("unit_type"), F.expr("floor_no % 2").alias("count"))
    given = det.select("project_id", F.col("building").alias("unit_type"), F.col("wall_type").alias("tag"), F.col("page_no").alias("per_unit"))
    right = M.project_matrix(mix, det.select("project_id", F.col("wall_type").alias("mark")), given)
    stated = right.groupBy("project_id", "tag").agg(F.sum("extended").alias("expected"))
    return Q.qa_gates(
        {
            "rows": t.v_sched, "doors": plain.select(*cols).unionByName(K.section(split, notes="comments").select(*cols)),
            "queue": QJ.J.orphans(det, t.v_sched, QJ.MARK), "unit_counts": counts, "detections": det, "unit_mix": mix, "unit_door_input": given,
            "matrix": right.withColumn("extended", F.expr("extended + CASE WHEN project_id = 'P5' THEN 1 ELSE 0 END")),
            "expected_doors": stated.withColumn("expected", F.expr("expected + CASE WHEN project_id = 'P2' THEN 1 ELSE 0 END")),
        }
    )


@q(
    "self_check",
    """SELECT project_id, CAST(count(*) AS BIGINT) AS n_expected, CAST(count(*) FILTER (supp_no % 10 <> 3) AS BIGINT) AS n_actual,
  coalesce(array_to_string(list_sort(list(DISTINCT mark) FILTER (supp_no % 10 = 3)), ','), '') AS missing_marks, count(*) FILTER (supp_no % 10 = 3) = 0 AS passed FROM v_det GROUP BY project_id""",
    "v_det",
)
def _(t):
    return Q.self_check(t.v_det, t.v_det.where("supp_no % 10 <> 3"))


@q("missing_annotations", "SELECT project_id, mark, CAST(count(*) AS BIGINT) AS n_missing FROM v_det WHERE supp_no % 10 = 3 GROUP BY ALL", "v_det")
def _(t):
    return Q.missing_marks(t.v_det, t.v_det.where("supp_no % 10 <> 3"))


PROFILED = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@q("column_profile", " UNION ALL ".join(f"SELECT '{c}' AS column_name, max(length(CAST({c} AS STRING))) AS max_len, greatest(max(length(CAST({c} AS STRING))) + 4, 15) AS sheet_width FROM part" for c in PROFILED))
def _(t):
    return Q.column_profile(t.part.select(*PROFILED))


@q(
    "takeoff_summary",
    f"""WITH d AS (SELECT project_id, row_no % 40 AS qty, {QT.SECTION} AS section, contains(fire_rating, 'BARRIER') AS excluded, row_no % 9 = 0 AS odd FROM v_sched), {QJ.BIFURCATED}
  SELECT project_id, CAST(sum(CASE WHEN section = 'UNIQUE' THEN qty ELSE 0 END) AS BIGINT) AS unique_doors, CAST(sum(CASE WHEN section = 'REPEATING' THEN qty ELSE 0 END) AS BIGINT) AS repeating_doors,
   CAST(sum(CASE WHEN section = 'OVERHEAD' THEN qty ELSE 0 END) AS BIGINT) AS overhead_doors, CAST(sum(CASE WHEN section = 'CASED' THEN qty ELSE 0 END) AS BIGINT) AS cased_openings, CAST(sum(qty) AS BIGINT) AS all_doors,
   CAST(sum(CASE WHEN excluded THEN qty ELSE 0 END) AS BIGINT) AS not_in_scope, CAST(sum(CASE WHEN odd THEN 1 ELSE 0 END) AS BIGINT) AS to_verify,
   CAST(coalesce(any_value(b), 0) AS BIGINT) AS bifurcated_tags, CAST(coalesce(any_value(v), 0) AS BIGINT) AS variants, CAST(coalesce(any_value(nb), 0) AS BIGINT) AS buildings, CAST(coalesce(any_value(nf), 0) AS BIGINT) AS floors,
   CAST(coalesce(any_value(nt), 0) AS BIGINT) AS unit_types, CAST(coalesce(any_value(nu), 0) AS BIGINT) AS units, CAST(coalesce(any_value(wq), 0) AS BIGINT) AS windows, CAST(coalesce(any_value(wt), 0) AS BIGINT) AS window_types, CAST(coalesce(any_value(qn), 0) AS BIGINT) AS discrepancies
  FROM d LEFT JOIN (SELECT project_id, count(DISTINCT original) AS b, count(*) AS v FROM bif WHERE is_bifurcated GROUP BY 1) USING (project_id)
   LEFT JOIN (SELECT project_id, count(DISTINCT building) AS nb, count(DISTINCT floor_name) AS nf, count(DISTINCT page_no) AS nt, sum(floor_no) AS nu FROM v_det GROUP BY 1) USING (project_id)
   LEFT JOIN (SELECT project_id, sum(row_no % 40) AS wq, count(DISTINCT mark) AS wt FROM v_sched WHERE schedule_type = 'window' GROUP BY 1) USING (project_id)
   LEFT JOIN (SELECT project_id, count(*) AS qn FROM (SELECT DISTINCT project_id, mark FROM v_det WHERE (project_id, mark) NOT IN (SELECT (project_id, mark) FROM v_sched)) GROUP BY 1) USING (project_id) GROUP BY project_id""",
    "v_sched", "v_det",
)
def _(t):
    rows = K.section(t.v_sched, notes="comments").select(
        "project_id", F.expr("row_no % 40").alias("qty"), "section", F.col("fire_rating").contains("BARRIER").alias("excluded"),
        F.expr("CASE WHEN row_no % 9 = 0 THEN 'CONFLICT' ELSE 'VERIFIED' END").alias("status"),
    )
    units = t.v_det.select("project_id", "building", F.col("floor_name").alias("floor"), F.col("page_no").alias("unit_type"), F.col("floor_no").alias("count"))
    windows = t.v_sched.where("schedule_type = 'window'").select("project_id", "mark", F.expr("row_no % 40").alias("qty"))
    return Q.takeoff_summary({
        "doors": rows, "variants": D.bifurcate(t.v_sched, t.v_det).where("is_bifurcated"), "unit_mix": units, "windows": windows, "queue": QJ.J.orphans(t.v_det, t.v_sched, QJ.MARK),
    })


@q(
    "category_completeness",
    """SELECT project_id, category, CAST(coalesce(n, 0) AS BIGINT) AS extracted_count, CASE WHEN coalesce(n, 0) > 0 THEN 'pass' ELSE 'fail' END AS status FROM
  (SELECT DISTINCT project_id, CASE WHEN row_no % 17 = 0 THEN 'skylight' ELSE schedule_type END AS category FROM v_sched)
  LEFT JOIN (SELECT project_id, CASE WHEN mark LIKE 'W%' THEN 'window' ELSE 'door' END AS category, count(*) AS n FROM v_det GROUP BY ALL) USING (project_id, category)""",
    "v_sched", "v_det",
)
def _(t):
    expected = t.v_sched.select("project_id", F.expr("CASE WHEN row_no % 17 = 0 THEN 'skylight' ELSE schedule_type END").alias("category"))
    return Q.completeness(expected, t.v_det.select("project_id", F.expr("CASE WHEN mark LIKE 'W%' THEN 'window' ELSE 'door' END").alias("category")))


@q("default_usage", "SELECT project_id, type, CAST(count(*) AS BIGINT) AS n_defaults FROM (SELECT project_id, door_type AS type, width FROM v_sched) WHERE width = 'VIF' GROUP BY ALL", "v_sched")
def _(t):
    return Q.default_usage(t.v_sched.select("project_id", F.col("door_type").alias("type"), F.expr("CASE WHEN width = 'VIF' THEN 'default' ELSE 'schedule' END").alias("source")))


@q(
    "queue_counts",
    """SELECT project_id, type, CAST(count(*) AS BIGINT) AS n_items FROM (
   SELECT DISTINCT project_id, mark, 'orphan_plan_mark' AS type FROM v_det WHERE (project_id, mark) NOT IN (SELECT (project_id, mark) FROM v_sched)
   UNION ALL SELECT project_id, mark, 'missing_from_plan' FROM v_sched WHERE (project_id, mark) NOT IN (SELECT (project_id, mark) FROM v_det)) GROUP BY ALL""",
    "v_sched", "v_det",
)
def _(t):
    a = QJ.J.orphans(t.v_det, t.v_sched, QJ.MARK).withColumn("type", F.lit("orphan_plan_mark"))
    b = QJ.J.orphans(t.v_sched, t.v_det, QJ.MARK).withColumn("type", F.lit("missing_from_plan"))
    return Q.queue_counts(a.unionByName(b))


@q(
    "session_summary",
    """SELECT o_custkey, CAST(count(*) AS INT) AS num_floors, CAST(sum(n) AS INT) AS total_rooms, CAST(sum(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_orderkey % 5 END) AS INT) AS columns_count
  FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""",
)
def _(t):
    rooms = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("rooms"))
    intake = t.orders.join(rooms, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(
        F.collect_list(F.struct("rooms")).alias("floors"),
        F.collect_list(F.struct(F.expr("cast(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 5 END as int)").alias("count"))).alias("columns"),
    )
    return Q.session_summary(intake)


@q(
    "flatten_extraction",
    """SELECT order_no, CAST(floor_no AS STRING) AS floor, CASE WHEN wall_type = 'DRY' THEN 'window' ELSE 'door' END AS kind, CASE WHEN part_no % 6 = 0 THEN 'UNKNOWN' ELSE mark END AS type,
  floor_no AS count, 'plan' AS source, CASE WHEN floor_no < 7 THEN CAST(i AS INT) END AS box_no, CASE WHEN floor_no < 7 THEN CAST(i + w_cx AS DOUBLE) END AS box_x
  FROM v_det, unnest(range(CASE WHEN floor_no < 7 THEN floor_no ELSE 1 END)) AS x(i)""",
    "v_det",
)
def _(t):
    boxes = "CASE WHEN floor_no < 7 THEN transform(sequence(0, floor_no - 1), i -> array(cast(i + w_cx as double))) END"
    opening = F.struct(
        F.expr("CASE WHEN part_no % 6 = 0 THEN '' ELSE mark END").alias("type"), F.col("floor_no").alias("count"),
        F.lit("plan").alias("source"), F.expr(boxes).alias("bounding_boxes"),
    )
    per_floor = t.v_det.groupBy("order_no", "floor_no").agg(
        F.collect_list(F.when(F.col("wall_type") != "DRY", opening)).alias("doors"),
        F.collect_list(F.when(F.col("wall_type") == "DRY", opening)).alias("windows"),
    )
    nested = per_floor.groupBy("order_no").agg(
        F.collect_list(F.struct(F.col("floor_no").cast("string").alias("floor"), "doors", "windows")).alias("per_floor")
    )
    return B.flatten_extraction(nested).withColumn("box_x", F.col("box")[0]).drop("box")


# Registry edits and stores ----------------------------------------------------------------------


@q(
    "cells_roundtrip",
    "SELECT project_id, table_id, row_no, CAST(col_no AS INT) AS c, value FROM v_cells WHERE value <> ''",
    "v_cells",
)
def _(t):
    n, key = len(CELLS), ["project_id", "table_id"]
    wide = IO.cells_to_rows(t.v_cells, "row_no", "col_no", "value", range(n), key)
    return IO.rows_to_cells(wide, [f"c{i}" for i in range(n)], key, "row_no")


@q(
    "grid_cells",
    """SELECT p_partkey, 1 AS r, 1 AS c, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS value FROM part
  UNION ALL SELECT p_partkey, 2, 2, p_type FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 4, 3, p_type FROM part WHERE p_partkey % 2 = 1""",
)
def _(t):
    sparse = "array(named_struct('r', 0, 'c', 0, 'v', p_brand), named_struct('r', 3, 'c', 2, 'v', p_type))"
    dense = "CASE WHEN p_partkey % 2 = 0 THEN array(array(p_name, null), array('', p_type)) END"
    return IO.grid_cells(t.part.select("p_partkey", F.expr(sparse).alias("celldata"), F.expr(dense).alias("data")), key=["p_partkey"])


@q(
    "replicate_rows",
    """SELECT project_id, floor, det_id FROM (SELECT project_id, floor_name AS floor, det_id FROM v_det WHERE floor_name NOT IN ('Level 4', 'Level 6')
  UNION ALL SELECT project_id, unnest(['Level 4', 'Level 6', 'Roof']), det_id FROM v_det WHERE floor_name = 'Level 2')""",
    "v_det",
)
def _(t):
    targets = t.v_det.select("project_id", F.explode(F.array(F.lit("Level 4"), F.lit("Level 6"), F.lit("Roof"))).alias("floor")).distinct()
    return H.replicate_rows(t.v_det.select("project_id", F.col("floor_name").alias("floor"), "det_id"), "Level 2", targets)


@q(
    "apply_changes",
    """WITH c AS (SELECT event_id AS seq, user_id AS row_id, CASE event_type WHEN 'click' THEN 'mode' WHEN 'view' THEN 'note' WHEN 'purchase' THEN 'mode' WHEN 'error' THEN 'note' END AS field, props AS value,
    CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'delete' WHEN 'purchase' THEN 'append' ELSE 'set' END AS action FROM events),
  b AS (SELECT -1 AS seq, p_partkey AS row_id, 'mode' AS field, p_type AS value, 'set' AS action FROM part UNION ALL SELECT -1, p_partkey, 'note', p_name, 'set' FROM part),
  l AS (SELECT row_id, field, max(seq) AS seq, arg_max(value, seq) AS value, arg_max(action, seq) AS action FROM (SELECT * FROM b UNION ALL SELECT seq, row_id, field, value, action FROM c WHERE field IS NOT NULL) GROUP BY ALL),
  g AS (SELECT row_id, max(seq) AS gone FROM c WHERE field IS NULL GROUP BY 1)
  SELECT row_id, field, value FROM l LEFT JOIN g USING (row_id) WHERE action <> 'delete' AND (gone IS NULL OR seq > gone)""",
)
def _(t):
    base = t.part.select(F.col("p_partkey").alias("row_id"), F.explode(F.create_map(F.lit("mode"), F.col("p_type"), F.lit("note"), F.col("p_name"))).alias("field", "value"))
    log = t.events.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("row_id"), F.col("props").alias("value"),
        F.expr("CASE event_type WHEN 'click' THEN 'mode' WHEN 'view' THEN 'note' WHEN 'purchase' THEN 'mode' WHEN 'error' THEN 'note' END").alias("field"),
        F.expr("CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'delete' WHEN 'purchase' THEN 'append' ELSE 'set' END").alias("action"),
    )
    return H.apply_changes(base, log, ("row_id",))


@q("upsert_latest", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY 1, 2")
def _(t):
    e = t.events.select("user_id", "event_type", "value", "ts", "event_id")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    return IO.upsert_latest(IO.latest(e.where(F.col("ts") < cut), keys, order), e.where(F.col("ts") >= cut), keys, order).drop("event_id")


# Streams ------------------------------------------------------------------------------------------

NODE = "CASE event_type WHEN 'click' THEN 'specifications_analyzer_node' WHEN 'view' THEN 'ocr_consensus_node' WHEN 'purchase' THEN 'excel_writer_node' WHEN 'error' THEN 'human_review_node' ELSE 'cv_detector_node' END"
STATE = "CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'failed' ELSE 'paused_qa' END END"


@q(
    "progress_latest",
    f"""SELECT user_id, CASE node WHEN 'specifications_analyzer_node' THEN 'specs_analyzed' WHEN 'ocr_consensus_node' THEN 'ocr_completed' WHEN 'excel_writer_node' THEN 'completed' WHEN 'cv_detector_node' THEN 'cv_detector_completed' ELSE node END AS step,
  CASE node WHEN 'specifications_analyzer_node' THEN 10 WHEN 'ocr_consensus_node' THEN 45 WHEN 'excel_writer_node' THEN 100 WHEN 'cv_detector_node' THEN 75 ELSE 0 END AS progress,
  CASE WHEN node = 'excel_writer_node' THEN 'completed' ELSE coalesce(st, 'processing') END AS status, ts AS last_ts, coalesce(node = 'excel_writer_node' OR st = 'failed', FALSE) AS ended
  FROM (SELECT user_id, arg_max({NODE}, (ts, event_id)) AS node, arg_max(coalesce({STATE}, 'processing'), (ts, event_id)) AS st, max(ts) AS ts FROM events GROUP BY 1)""",
)
def _(t):
    rows = t.events.select("user_id", "ts", "event_id", F.expr(NODE).alias("node"), F.expr(STATE).alias("status"))
    return ST.track_progress(rows, "user_id", "ts", "event_id")


@q("trailing_count", "SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS n_recent FROM events")
def _(t):
    return ST.trailing_count(t.events, seconds=86400).select("event_id", "n_recent")


@q(
    "rate_limit",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events),
  s AS (SELECT user_id, [x.us] AS acc, x AS cur FROM (SELECT user_id, min({'us': us, 'id': event_id}) AS x FROM e GROUP BY 1)
   UNION ALL SELECT user_id, CASE WHEN len(acc) < 3 THEN list_append(acc, nx.us) ELSE list_append(acc[2:], nx.us) END, nx FROM (
    SELECT s.user_id, s.acc, min({'us': e.us, 'id': e.event_id}) AS nx FROM s JOIN e ON e.user_id = s.user_id
     AND (e.us > s.cur.us OR (e.us = s.cur.us AND e.event_id > s.cur.id)) AND (len(s.acc) < 3 OR e.us >= s.acc[1] + 172800000000) GROUP BY s.user_id, s.acc))
  SELECT event_id, event_id IN (SELECT s.cur.id FROM s) AS admitted FROM events""",
)
def _(t):
    return ST.admit_batch(t.events, limit=3, seconds=172800).select("event_id", "admitted")


# Full reconciliation ------------------------------------------------------------------------------


def tracks(t):
    """Inputs of the reconciliation bound to the views: every part, line item and document."""
    det = t.v_det
    ocr = t.v_passes.select("project_id", "mark")
    exclusions = t.nation.select(F.expr("'P' || n_nationkey % 8").alias("project_id"), F.expr("CASE WHEN n_nationkey % 5 = 0 THEN 'Alum doors ' ELSE 'Wood ' END || n_name").alias("exclusion"))
    spec = t.documents.select(F.expr("'P' || doc_id % 8").alias("project_id"), F.concat(F.expr("'Storefront at D' || doc_id || '. '"), F.col("text")).alias("text"))
    return {"cells": t.v_cells, "detections": det, "ocr": ocr, "exclusions": exclusions, "spec_text": spec}


SPEC_TOKENS = r"""SELECT DISTINCT project_id, unnest(list_transform(regexp_split_to_array(replace(s, ',', ' '), '\s+'), lambda w: trim(w, '.,()[]{}-_#*/"'''))) AS mark FROM (
  SELECT project_id, replace(replace(upper(x), 'ß', 'SS'), 'ẞ', 'SS') AS s FROM (SELECT 'P' || CAST(doc_id % 8 AS STRING) AS project_id,
   unnest(string_split_regex('Storefront at D' || CAST(doc_id AS STRING) || '. ' || text, '[.\n]')) AS x FROM documents)) WHERE """ + QT.sql_any(
    "s", QT.V.STOREFRONT_SENTENCE
)
RECONCILED = f"""sh AS ({SPEC_TOKENS}),
fe AS ({QT.FEATURES}), ro AS ({QT.ROLES}),
rt AS (SELECT project_id, table_id, row_no, string_agg(value, ' ' ORDER BY col_no) AS row_text FROM v_cells GROUP BY ALL),
md AS ({catalog.sql_body["row_mode"]}),
fd AS (SELECT project_id, mark, min_by(vlm_opening_mode, {QJ.ORDER_SQL}) AS plan_mode, min_by(vlm_wall_type, {QJ.ORDER_SQL}) AS plan_wall, min_by(vlm_reasoning, {QJ.ORDER_SQL}) AS plan_reason, count(*) AS qty FROM v_det GROUP BY ALL),
fl AS ({catalog.sql_body["floors_per_mark"]}),
r0 AS (SELECT s.project_id, s.table_id, s.table_row, s.row_no, s.mark, s.schedule_type, s.location, s.width, s.hardware, s.finish, s.head, s.jamb, s.comments AS printed, s.door_type AS printed_type, s.door_material AS printed_door, s.frame_material AS printed_frame,
   fe.* EXCLUDE (project_id, table_id, row_no, panel_2), NOT explicit_single AND (panel_2 OR pair_leaves OR {QT.WIDTH_SQL.format(c='door_width')} >= 50) AS has_panel_2,
   ro.* EXCLUDE (project_id, table_id, row_no), opening_mode AS schedule_mode, plan_mode, plan_wall, plan_reason, coalesce(qty, 0) AS qty, qty IS NOT NULL AS located, coalesce(floors, '') AS floors, sh.mark IS NOT NULL AS in_spec,
   lower(concat_ws(' ', row_text, s.mark, plan_wall, plan_mode)) AS txt, (s.schedule_type = 'window' OR s.mark LIKE 'W%' OR s.mark LIKE 'V%') AS is_window
  FROM v_sched s JOIN fe ON fe.project_id = s.project_id AND fe.table_id = s.table_id AND fe.row_no = s.table_row JOIN ro ON ro.project_id = s.project_id AND ro.table_id = s.table_id AND ro.row_no = s.table_row JOIN rt ON rt.project_id = s.project_id AND rt.table_id = s.table_id AND rt.row_no = s.table_row JOIN md ON md.project_id = s.project_id AND md.table_id = s.table_id AND md.row_no = s.table_row
   LEFT JOIN fd ON fd.project_id = s.project_id AND fd.mark = s.mark LEFT JOIN fl ON fl.project_id = s.project_id AND fl.mark = s.mark LEFT JOIN sh ON sh.project_id = s.project_id AND sh.mark = s.mark),
r1 AS (SELECT *, {QT.CASED} AS is_cased FROM r0),
r2 AS (SELECT *, in_spec OR {QT.sql_any("(door_material || ' ' || frame_material || ' ' || door_type || ' ' || comments)", QT.V.STOREFRONT_PHRASES)}
   OR (is_cased AND has_hardware AND frame_material IN {QT.sql_list(QT.V.BLANK_FRAME)}) OR {QT.SF_MAT.format(c='door_material')} OR {QT.SF_MAT.format(c='frame_material')} AS is_storefront,
  {QT.sql_any('comments', QT.V.DOUBLE_ACTING_PHRASES)} OR {QT.sql_any('door_type', QT.V.DOUBLE_ACTING_PHRASES)} OR len(list_intersect(string_split(door_type, ' '), ['DA', 'AB'])) > 0
   OR len(list_intersect(string_split(comments, ' '), ['DA', 'AB'])) > 0 AS is_da FROM r1),
r3 AS (SELECT *, CASE WHEN is_storefront OR is_window THEN 'STOREFRONT' WHEN is_cased THEN 'CO' WHEN is_da THEN 'DA' WHEN has_panel_2 THEN 'PR' ELSE schedule_mode END AS resolved_mode FROM r2),
r4 AS (SELECT *, CASE WHEN plan_mode IN ('CO', 'REV') AND (has_hardware OR has_material) THEN CASE WHEN has_panel_2 THEN 'PR' ELSE 'SGL' END
   WHEN plan_mode = 'PR' AND NOT has_panel_2 AND resolved_mode = 'SGL' THEN 'SGL' ELSE coalesce(plan_mode, 'UNKNOWN') END AS cleaned,
  CASE WHEN explicit_exterior OR coalesce(plan_wall, '') IN ('EXT', 'EXTERIOR') THEN 'Exterior' ELSE 'Interior' END AS side5,
  {QT.sql_any('txt', QT.V.MULTIFOLD_WORDS)} AS multifold, {QT.sql_any('txt', QT.V.SIDELITE_WORDS)} AS sidelite, {QT.sql_any('txt', QT.V.SOFT_EXTERIOR_WORDS)} AS soft FROM r3),
r5 AS (SELECT *, multifold OR is_storefront AS excluded, located AND resolved_mode <> 'STOREFRONT' AND coalesce(plan_mode, 'UNKNOWN') <> 'UNKNOWN' AND NOT (resolved_mode = cleaned OR (resolved_mode = 'PR' AND cleaned IN ('DE', 'DA'))) AS mode_conflict,
  CASE WHEN multifold OR is_storefront THEN 'Not in Scope' WHEN is_window OR sidelite THEN 'Window' WHEN is_cased THEN side5 WHEN soft THEN 'Soft Exterior' WHEN explicit_exterior THEN 'Exterior' ELSE side5 END AS bucket,
  CASE WHEN multifold THEN '{QT.V.NOTE_MULTIFOLD}' WHEN is_storefront THEN 'Door Excluded. Door material ' || coalesce(nullif(door_material, ''), 'HM') || ' but on elevation it is storefront.'
   WHEN is_window THEN NULL WHEN sidelite THEN '{QT.V.NOTE_SIDELITE}' WHEN is_cased THEN '{QT.V.NOTE_CASED}' END AS note FROM r4),
rec AS (SELECT *, {QT.SECTION} AS section, CASE WHEN schedule_type IN ('door', 'window') THEN schedule_type WHEN is_window THEN 'window' ELSE 'door' END AS opening_kind,
  CASE WHEN resolved_mode = 'STOREFRONT' THEN 'STOREFRONT' WHEN NOT is_window AND NOT sidelite THEN resolved_mode END AS reconciled_mode,
  CASE WHEN resolved_mode = 'STOREFRONT' AND is_window AND NOT is_storefront AND NOT excluded THEN bucket WHEN resolved_mode = 'STOREFRONT' THEN 'Not in Scope' ELSE bucket END AS reconciled_int_ext,
  CASE WHEN excluded THEN 'EXCLUDED' WHEN NOT located THEN 'NOT FOUND' WHEN mode_conflict THEN 'CONFLICT' ELSE 'VERIFIED' END AS status FROM r5),
{QJ.BIFURCATED},
doors AS (SELECT rec.* EXCLUDE (mark, status), CASE WHEN b.is_bifurcated AND status = 'VERIFIED' THEN 'CALCULATED' ELSE status END AS status, b.mark, b.original, b.is_bifurcated, b.wall_variant, trim(concat_ws(' ', CASE WHEN b.is_bifurcated THEN '{QT.V.NOTE_WALL}' ELSE note END, CASE WHEN NOT located THEN 'Not Found' END)) AS takeoff_notes
  FROM rec JOIN bif b ON rec.project_id = b.project_id AND rec.row_no = b.row_no WHERE opening_kind = 'door')"""
QUEUE_SQL = """tr AS (SELECT project_id, mark, bool_or(k = 0) AS s, bool_or(k = 1) AS o, bool_or(k = 2) AS c FROM (SELECT project_id, mark, 0 AS k FROM v_sched
   UNION ALL SELECT project_id, mark, 1 FROM v_passes UNION ALL SELECT project_id, mark, 2 FROM v_det) GROUP BY ALL),
ex AS (SELECT 'P' || CAST(n_nationkey % 8 AS STRING) AS project_id, 'Alum doors ' || n_name AS exclusion FROM nation WHERE n_nationkey % 5 = 0),
qu AS (SELECT project_id, 'orphan_plan_mark' AS type, mark, 'Found in floor plan but missing from the uploaded schedule.' AS context FROM tr WHERE (o OR c) AND NOT s
  UNION ALL SELECT project_id, 'missing_from_plan', mark, 'Exists in schedule but could not be located on the floor plan by OCR or CV.' FROM tr WHERE s AND NOT (o OR c)
  UNION ALL SELECT project_id, 'ocr_cv_mismatch', mark, 'Detected by CV but missed by OCR Consensus.' FROM tr WHERE c AND NOT o
  UNION ALL SELECT rec.project_id, 'aluminium_exclusion_flag', mark, 'Specification Exclusion Audit: ''' || exclusion || '''. Verify if this opening should be removed from scope.' FROM rec JOIN ex USING (project_id)
   WHERE """ + QT.sql_any("first_material", QT.V.ALUMINIUM_MATERIAL) + """
  UNION ALL SELECT project_id, 'opening_mode_conflict', mark, 'Opening Mode Conflict: Schedule suggests ''' || resolved_mode || ''' but floor plan crop reads as ''' || cleaned || '''. (Reasoning: ' || coalesce(nullif(plan_reason, ''), '""" + QT.V.NO_REASON + """') || ')' FROM rec WHERE mode_conflict
  UNION ALL SELECT project_id, 'mark_not_located', mark, 'Mark Not Located: Mark ''' || mark || ''' from schedule registry was not located on floor plan drawing. Flagged for human review.' FROM rec WHERE NOT located)"""
TRACK_VIEWS = ("v_sched", "v_cells", "v_det", "v_passes")


@q(
    "reconcile_full",
    f"""WITH {RECONCILED} SELECT project_id, table_id, table_row AS row_no, mark, CAST(qty AS BIGINT) AS qty, section, bucket, reconciled_mode, reconciled_int_ext, status, takeoff_notes, floors,
  mode_conflict OR NOT located AS needs_review, is_bifurcated, wall_variant FROM doors""",
    *TRACK_VIEWS,
)
def _(t):
    doors = reconcile(tracks(t))["doors"]
    return doors.select(
        "project_id", "table_id", "row_no", "mark", "qty", "section", "bucket", "reconciled_mode", "reconciled_int_ext", "status", "takeoff_notes",
        F.col("FLOOR / LEVEL").alias("floors"), "needs_review", "is_bifurcated", "wall_variant",
    )


@q(
    "reconcile_windows",
    f"""WITH {RECONCILED} SELECT project_id, table_id, table_row AS row_no, mark, CAST(qty AS BIGINT) AS qty, bucket, status,
  trim(concat_ws(' ', note, CASE WHEN NOT located THEN 'Not Found' END)) AS takeoff_notes FROM rec WHERE opening_kind = 'window'""",
    *TRACK_VIEWS,
)
def _(t):
    return reconcile(tracks(t))["windows"].select("project_id", "table_id", "row_no", "mark", "qty", "bucket", "status", "takeoff_notes")


@q(
    "reconcile_queue",
    f"WITH {RECONCILED}, {QUEUE_SQL} SELECT *, sha256(concat_ws('|', project_id, type, mark, context)) AS item_id FROM qu",
    *TRACK_VIEWS,
)
def _(t):
    return reconcile(tracks(t))["queue"]


@q(
    "reconcile_log",
    f"""WITH {RECONCILED}, {QUEUE_SQL}, lg AS (
   SELECT project_id, 0 AS part, table_row AS r, table_id AS t, coalesce(floors, '') AS floor, mark AS item, 'Bifurcated mark ''' || original || ''' on basis of wall type ''' || wall_variant || '''' AS issue,
    'Floor Plan / Partition Schedule' AS source, 'CALCULATED' AS action FROM doors WHERE is_bifurcated
   UNION ALL SELECT project_id, 1, 0, type, 'Multiple', mark, context, 'Floor Plan / Schedule', 'VERIFY' FROM qu),
  nb AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY part, r, t, item, issue) AS n FROM lg)
  SELECT project_id, 'A-' || lpad(CAST(n AS STRING), CAST(greatest(3, length(CAST(n AS STRING))) AS INT), '0') AS id, '' AS building, floor, item, issue, source, action FROM nb""",
    *TRACK_VIEWS,
)
def _(t):
    return reconcile(tracks(t))["log"]


@q(
    "reconcile_gates",
    f"""WITH {RECONCILED}, {QUEUE_SQL}, p AS (SELECT DISTINCT project_id FROM v_sched), n AS (SELECT project_id, count(*) AS n FROM qu GROUP BY 1),
  x AS (SELECT project_id, count(*) FILTER (excluded AND takeoff_notes = '') AS n7 FROM doors GROUP BY 1), {GATE_9},
  g8 AS (SELECT DISTINCT project_id FROM doors WHERE is_bifurcated)
  SELECT project_id, gate, CAST(n AS BIGINT) AS n_issues, CASE WHEN na THEN 'NOT_APPLICABLE' WHEN n = 0 THEN 'PASSED' ELSE 'REVIEW_REQUIRED' END AS status FROM (
   SELECT p.project_id, 'gate1_schedule_reconciliation' AS gate, coalesce(n, 0) AS n, FALSE AS na FROM p LEFT JOIN n USING (project_id)
   UNION ALL SELECT project_id, unnest(['gate2_unit_count_reconciliation', 'gate3_unit_door_matrix', 'gate4_formula_validation', 'gate5_spot_checks']), 0, TRUE FROM p
   UNION ALL SELECT project_id, 'gate7_scope_review', n7, FALSE FROM x UNION ALL SELECT p.project_id, 'gate8_bifurcation_completeness', 0, g8.project_id IS NULL FROM p LEFT JOIN g8 USING (project_id)
   UNION ALL SELECT p.project_id, 'gate9_cased_overhead', coalesce(n, 0), FALSE FROM p LEFT JOIN g9 USING (project_id))""",
    *TRACK_VIEWS,
)
def _(t):
    return reconcile(tracks(t))["gates"]


@q(
    "estimator_sheet",
    f"""WITH {RECONCILED} SELECT project_id, table_id, table_row AS row_no, CAST(qty AS STRING) AS "Qty", mark AS "NUMBER", location AS "LOCATION", coalesce(reconciled_mode, 'Single') AS "Opening Mode", bucket AS "Int/Ext",
  coalesce(wall_variant, 'DRY') AS "Wall Type", takeoff_notes AS "Takeoff Notes", CASE WHEN row_no % 4 IN (0, 3) THEN width ELSE '' END AS "WIDTH", '' AS "HEIGHT", '' AS "THICKNESS",
  CASE WHEN row_no % 4 = 3 THEN '' ELSE printed_type END AS "DOOR TYPE", printed_door AS "DOOR MATERIAL", CASE WHEN {QT.DRIFT} THEN '' ELSE finish END AS "DOOR FINISH", '' AS "FRAME TYPE",
  printed_frame AS "FRAME MATERIAL", '' AS "FRAME FINISH", CASE WHEN {QT.DRIFT} THEN finish ELSE head END AS "HEAD", CASE WHEN {QT.DRIFT} THEN head ELSE jamb END AS "JAMB",
  CASE WHEN {QT.DRIFT} THEN jamb ELSE '' END AS "SILL", '' AS "FIRE RATING", hardware AS "HARDWARE SET", 'No' AS "KEY CARD READER", CASE WHEN row_no % 4 IN (0, 3) THEN printed ELSE '' END AS "COMMENTS" FROM doors""",
    *TRACK_VIEWS,
)
def _(t):
    doors = reconcile(tracks(t))["doors"]
    return M.door_schedule_23(doors, ("project_id", "table_id", "row_no"))


@q(
    "review_step",
    """WITH l AS (SELECT 'D' || CAST(user_id AS STRING) AS item_id, arg_max(event_type, event_id) AS decision FROM events GROUP BY 1)
  SELECT s.mark AS item_id, coalesce(decision, 'open') AS decision FROM v_sched s LEFT JOIN l ON l.item_id = s.mark""",
    "v_sched",
)
def _(t):
    decisions = t.events.select(F.expr("'D' || user_id").alias("item_id"), F.col("event_type").alias("decision"), F.col("event_id").alias("seq"))
    waiting, resolved = ST.review_step(t.v_sched.select(F.col("mark").alias("item_id")), decisions)
    return waiting.withColumn("decision", F.lit("open")).unionByName(resolved.select("item_id", "decision"))


@q(
    "thickness_bifurcation",
    f"""SELECT row_no, s.mark || x AS mark, CASE WHEN x <> '' THEN 'Door Bifurcated due to larger wall.' END AS bifurcation_note FROM
  (SELECT s.row_no, s.mark, unnest(CASE WHEN b THEN ['', '.4'] ELSE [''] END) AS x FROM v_sched s LEFT JOIN (SELECT project_id, mark, bool_or(quantity <= 48) AND bool_or(quantity > 48) AS b FROM v_det GROUP BY ALL) USING (project_id, mark)) s""",
    "v_sched", "v_det",
)
def _(t):
    det = t.v_det.withColumn("thickness", F.expr("CASE WHEN quantity > 48 THEN 'LARGER' ELSE 'STANDARD' END"))
    rows = D.bifurcate_by(t.v_sched.select(*QJ.MARK, "row_no"), det, cond="thickness", suffix=".4", standard="STANDARD", note="Door Bifurcated due to larger wall.")
    return rows.select("row_no", "mark", "bifurcation_note")


@q(
    "room_boxes",
    """SELECT page_id, greatest(0.0, min(w_cx / 1000) - 0.01) AS x0, greatest(0.0, min(w_cy / 800) - 0.01) AS y0, least(1.0, max(w_cx / 1000) + 0.01) AS x1, least(1.0, max(w_cy / 800) + 0.01) AS y1 FROM v_det GROUP BY page_id""",
    "v_det",
)
def _(t):
    hits = t.v_det.selectExpr("page_id", "w_cx / 1000 as x0", "w_cy / 800 as y0", "w_cx / 1000 as x1", "w_cy / 800 as y1")
    return QJ.J.merge_boxes(hits, "page_id")
