"""Queries over joins, consensus, first-row operators and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintel import vocab as V
from lintel.functions import text as T
from lintel.operators import classify as K
from lintel.operators import consensus as N
from lintel.operators import dedup as D
from lintel.operators import joins as J
from lintel.operators import spatial as S
from lintel.plans.q_text import BUCKETS, CLEAN, RULE_ROWS, sql_any, sql_arr, sql_list
from lintel.plans.views import DET_ORDER, catalog

q = catalog.add
MARK = ["project_id", "mark"]
ORDER_SQL = "(floor_no, page_no, w_cy, w_cx, det_id)"


@q("orphan_marks", "SELECT DISTINCT project_id, mark FROM v_det WHERE (project_id, mark) NOT IN (SELECT (project_id, mark) FROM v_sched)", "v_sched", "v_det")
def _(t):
    return J.orphans(t.v_det, t.v_sched, MARK)


@q("missing_marks", "SELECT project_id, mark FROM v_sched WHERE (project_id, mark) NOT IN (SELECT (project_id, mark) FROM v_det)", "v_sched", "v_det")
def _(t):
    return J.orphans(t.v_sched, t.v_det, MARK)


@q(
    "pass_mismatch",
    "SELECT DISTINCT project_id, page_id, mark FROM v_passes a WHERE pass_no = 2 AND NOT EXISTS (SELECT 1 FROM v_passes b WHERE b.pass_no = 1 AND a.page_id = b.page_id AND a.mark = b.mark)",
    "v_passes",
)
def _(t):
    p = t.v_passes
    return J.orphans(p.where("pass_no = 2"), p.where("pass_no = 1"), ["project_id", "page_id", "mark"])


@q(
    "presence_matrix",
    """SELECT project_id, mark, bool_or(k = 0) AS in_schedule, bool_or(k = 1) AS in_plan FROM
  (SELECT project_id, mark, 0 AS k FROM v_sched UNION ALL SELECT project_id, mark, 1 FROM v_det) GROUP BY ALL""",
    "v_sched", "v_det",
)
def _(t):
    return J.presence({"schedule": t.v_sched, "plan": t.v_det}, MARK)


@q(
    "exclusion_audit",
    f"""SELECT s.project_id, 'aluminium_exclusion_flag' AS type, s.mark,
  'Specification Exclusion Audit: ''' || e.exclusion || '''. Verify if this opening should be removed from scope.' AS context
  FROM v_sched s JOIN (SELECT 'P' || CAST(n_nationkey % 8 AS STRING) AS project_id, CASE n_nationkey % 2 WHEN 0 THEN 'Alum doors by ' ELSE 'Wood by ' END || n_name AS exclusion FROM nation) e
  ON s.project_id = e.project_id AND contains(lower(e.exclusion), 'alum') WHERE {sql_any('frame_material', V.ALUMINIUM_MATERIAL)}""",
    "v_sched",
)
def _(t):
    excl = t.nation.select(
        F.expr("'P' || n_nationkey % 8").alias("project_id"),
        F.expr("CASE n_nationkey % 2 WHEN 0 THEN 'Alum doors by ' ELSE 'Wood by ' END || n_name").alias("exclusion"),
    )
    return J.exclusion_audit(t.v_sched, excl, "frame_material")


DET_SLIM = ["project_id", "mark", "vlm_opening_mode", *DET_ORDER]


@q(
    "first_detection",
    f"""SELECT row_no, vlm_opening_mode, det_id, det_id IS NOT NULL AS located FROM v_sched LEFT JOIN
  (SELECT project_id, mark, min_by(vlm_opening_mode, {ORDER_SQL}) AS vlm_opening_mode, min_by(det_id, {ORDER_SQL}) AS det_id FROM v_det GROUP BY ALL) USING (project_id, mark)""",
    "v_sched", "v_det",
)
def _(t):
    return J.attach_first(t.v_sched.select(*MARK, "row_no"), t.v_det.select(*DET_SLIM), MARK, DET_ORDER).select(
        "row_no", "vlm_opening_mode", "det_id", "located"
    )


@q(
    "last_detection",
    f"""SELECT row_no, vlm_opening_mode, det_id, det_id IS NOT NULL AS located FROM v_sched LEFT JOIN
  (SELECT project_id, mark, max_by(vlm_opening_mode, {ORDER_SQL}) AS vlm_opening_mode, max_by(det_id, {ORDER_SQL}) AS det_id FROM v_det GROUP BY ALL) USING (project_id, mark)""",
    "v_sched", "v_det",
)
def _(t):
    return J.attach_last(t.v_sched.select(*MARK, "row_no"), t.v_det.select(*DET_SLIM), MARK, DET_ORDER).select(
        "row_no", "vlm_opening_mode", "det_id", "located"
    )


@q(
    "instance_expansion_qty0",
    """SELECT s.row_no, s.mark, d.det_id, d.floor_name, CASE WHEN d.det_id IS NULL THEN 0 ELSE 1 END AS qty FROM
  (SELECT *, CASE WHEN row_no % 26 = 0 THEN replace(mark, 'CO', 'C0') ELSE mark END AS original_mark FROM v_sched) s
  LEFT JOIN v_det d ON s.project_id = d.project_id AND (d.mark = s.mark OR d.mark = s.original_mark)""",
    "v_sched", "v_det",
)
def _(t):
    rows = t.v_sched.select(*MARK, "row_no").withColumn(
        "original_mark", F.expr("CASE WHEN row_no % 26 = 0 THEN replace(mark, 'CO', 'C0') ELSE mark END")
    )
    return J.expand_instances(rows, t.v_det.select(*MARK, "det_id", "floor_name")).select("row_no", "mark", "det_id", "floor_name", "qty")


VARIANTS = """SELECT project_id, mark, list_sort(list(DISTINCT wall_type)) AS ws FROM v_det WHERE wall_type NOT IN ('', 'UNKNOWN') GROUP BY ALL HAVING count(DISTINCT wall_type) > 1"""
BIFURCATED = f"""v AS ({VARIANTS}), bif AS (SELECT s.project_id, s.row_no, s.mark AS original, CASE WHEN ws IS NULL THEN s.mark ELSE s.mark || '.' || CAST(i AS STRING) END AS mark,
  CASE WHEN ws IS NULL THEN NULL ELSE ws[i] END AS wall_variant, ws IS NOT NULL AS is_bifurcated
  FROM (SELECT s.*, ws, unnest(range(1, 1 + greatest(1, coalesce(len(ws), 1)))) AS i FROM v_sched s LEFT JOIN v USING (project_id, mark)) s)"""


@q("wall_bifurcation", f"WITH {BIFURCATED} SELECT row_no, mark, CASE WHEN is_bifurcated THEN original END AS original_tag, wall_variant, is_bifurcated FROM bif", "v_sched", "v_det")
def _(t):
    return D.bifurcate(t.v_sched.select(*MARK, "row_no"), t.v_det).select("row_no", "mark", "original_tag", "wall_variant", "is_bifurcated")


@q(
    "bifurcated_lookup",
    f"""WITH {BIFURCATED}, best AS (SELECT project_id, original, min_by(coalesce(wall_variant, 'NONE'), (row_no, mark)) AS value FROM bif GROUP BY ALL)
  SELECT det_id, value FROM v_det d LEFT JOIN best b ON d.project_id = b.project_id AND d.mark = b.original""",
    "v_sched", "v_det",
)
def _(t):
    rows = D.bifurcate(t.v_sched.select(*MARK, "row_no"), t.v_det).withColumns(
        {"value": F.coalesce("wall_variant", F.lit("NONE")), "pos": F.struct("row_no", "mark")}
    )
    return J.lookup_with_fallback(t.v_det.select(*MARK, "det_id"), rows, order="pos").select("det_id", "value")


@q(
    "location_bifurcation",
    """SELECT row_no, mark || sfx AS mark, sfx = '.L' AS is_bifurcated FROM (SELECT row_no, mark, unnest(CASE WHEN b THEN ['', '.L'] ELSE [''] END) AS sfx FROM
  (SELECT row_no, s.mark, coalesce(b, FALSE) AS b FROM v_sched s LEFT JOIN (SELECT project_id, mark, bool_or(int_ext = 'Interior') AND bool_or(int_ext <> 'Interior') AS b FROM v_det GROUP BY ALL) USING (project_id, mark)))""",
    "v_sched", "v_det",
)
def _(t):
    return D.bifurcate_by(t.v_sched.select(*MARK, "row_no"), t.v_det).select("row_no", "mark", "is_bifurcated")


@q("wall_types", "SELECT project_id, mark, array_to_string(list_sort(list(DISTINCT wall_type)), ',') AS wall_type FROM v_det GROUP BY ALL", "v_det")
def _(t):
    return D.distinct_values(t.v_det, "wall_type")


@q(
    "floors_per_mark",
    f"""SELECT project_id, mark, array_to_string(list(floor_name ORDER BY o), ', ') AS floors FROM (SELECT project_id, mark, floor_name, min({ORDER_SQL}) AS o FROM v_det GROUP BY ALL) GROUP BY ALL""",
    "v_det",
)
def _(t):
    return D.ordered_distinct(t.v_det, "floor_name", MARK, DET_ORDER)


@q("occurrences", "SELECT project_id, mark, CAST(count(*) AS BIGINT) AS qty FROM v_det GROUP BY ALL", "v_det")
def _(t):
    return D.occurrences(t.v_det)


@q(
    "set_ops",
    """SELECT mark, 'both' AS which FROM (SELECT mark FROM v_sched INTERSECT SELECT mark FROM v_det)
  UNION ALL SELECT mark, 'any' FROM (SELECT mark FROM v_sched UNION SELECT mark FROM v_det)""",
    "v_sched", "v_det",
)
def _(t):
    both = D.common_marks(t.v_sched, t.v_det).withColumn("which", F.lit("both"))
    return both.unionByName(D.union_marks(t.v_sched, t.v_det).withColumn("which", F.lit("any")))


SWAPPED = """[(0, w), (1, translate(w, '0O', 'CC')), (2, replace(w, 'C', '0')), (3, replace(w, 'O', '0')), (4, replace(w, '8', 'B')), (5, replace(w, 'B', '8'))]"""


@q(
    "confusion_join",
    """WITH ws AS (SELECT project_id, det_id, trim(mark, '.,()[]{}-_#*') AS w FROM v_det),
  vs AS (SELECT project_id, det_id, 0 AS priority, w AS mark FROM ws UNION ALL SELECT project_id, det_id, 1, translate(w, '0O', 'CC') FROM ws
    UNION ALL SELECT project_id, det_id, 2, replace(w, 'C', '0') FROM ws UNION ALL SELECT project_id, det_id, 3, replace(w, 'O', '0') FROM ws
    UNION ALL SELECT project_id, det_id, 4, replace(w, '8', 'B') FROM ws UNION ALL SELECT project_id, det_id, 5, replace(w, 'B', '8') FROM ws)
  SELECT det_id, min_by(mark, priority) AS mark, min(priority) AS priority FROM vs JOIN (SELECT DISTINCT project_id,
    CASE WHEN row_no % 10 = 8 THEN replace(mark, '8', 'B') ELSE mark END AS mark FROM v_sched) USING (project_id, mark) GROUP BY det_id""",
    "v_sched", "v_det",
)
def _(t):
    marks = t.v_sched.select("project_id", F.expr("CASE WHEN row_no % 10 = 8 THEN replace(mark, '8', 'B') ELSE mark END").alias("mark"))
    return J.confusion_join(t.v_det, marks, "mark", word_id=("det_id",)).select("det_id", "mark", "priority")


@q(
    "contains_join",
    """WITH tx AS (SELECT p_partkey AS text_id, upper(p_name) AS text FROM part), mk AS (SELECT DISTINCT upper(x) AS mark FROM (SELECT p_type AS x FROM part UNION ALL
    SELECT unnest(string_split(p_name, ' ')) FROM part UNION ALL SELECT 'THE ' || p_name || ' SET' FROM part)),
  best AS (SELECT text, min_by(mark, (CASE WHEN mark = text THEN 0 ELSE 1 END, -length(mark), mark)) AS mark FROM (SELECT DISTINCT text FROM tx) JOIN mk ON contains(text, mark) OR contains(mark, text) GROUP BY text)
  SELECT text_id, tx.text, mark FROM tx JOIN best USING (text)""",
)
def _(t):
    texts = t.part.select(F.lit("P").alias("project_id"), F.col("p_partkey").alias("text_id"), F.upper("p_name").alias("text"))
    names = F.concat(F.array("p_type", F.concat(F.lit("THE "), F.col("p_name"), F.lit(" SET"))), F.split("p_name", " "))
    marks = t.part.select(F.lit("P").alias("project_id"), F.explode(names).alias("mark")).select("project_id", F.upper("mark").alias("mark")).distinct()
    return J.contains_join(texts, marks).drop("project_id")


SENTENCE_KEYS = ["THE", "UND", "QUE", "ION"]


@q(
    "mark_in_sentence",
    f"""WITH s AS (SELECT lang, replace(replace(upper(x), 'ß', 'SS'), 'ẞ', 'SS') AS s FROM (SELECT lang, unnest(string_split_regex(text, '[.\\n]')) AS x FROM documents)),
  k AS (SELECT lang, unnest(list_transform(string_split_regex(replace(s, ',', ' '), '\\s+'), lambda w: trim(w, '.,()[]{{}}-_#*/"'''))) AS mark FROM s WHERE {sql_any('s', SENTENCE_KEYS)}),
  m AS (SELECT DISTINCT lang, replace(replace(upper(w), 'ß', 'SS'), 'ẞ', 'SS') AS mark FROM (SELECT lang, unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '')
  SELECT DISTINCT m.lang, m.mark FROM m JOIN k ON m.lang = k.lang AND m.mark = k.mark""",
)
def _(t):
    words = t.documents.select("lang", F.explode(F.split("text", " ")).alias("w")).where("w <> ''")
    marks = words.select("lang", F.upper("w").alias("mark"))
    return J.mark_in_text(t.documents, marks, SENTENCE_KEYS, ("lang",))


@q(
    "audit_flag",
    """WITH r AS (SELECT DISTINCT project_id, page_id, mark FROM v_passes WHERE pass_no = 1), a AS (SELECT DISTINCT project_id, page_id, mark FROM v_passes WHERE pass_no = 2)
  SELECT page_id, mark, page_id IN (SELECT page_id FROM a) AND (page_id, mark) NOT IN (SELECT (page_id, mark) FROM a) AS needs_review FROM r""",
    "v_passes",
)
def _(t):
    p = t.v_passes.select("project_id", "page_id", "mark", "pass_no")
    return J.audit(p.where("pass_no = 1").drop("pass_no").distinct(), p.where("pass_no = 2")).drop("project_id")


@q(
    "fuzzy_best",
    """WITH parts AS (SELECT p_partkey AS name_id, CAST(generate_subscripts(ws, 1) - 1 AS INT) AS part_no, unnest(ws) AS part FROM (SELECT p_partkey, string_split(upper(p_name), ' ') AS ws FROM part)),
  words AS (SELECT w, min(word_id) AS word_id FROM (SELECT p_partkey AS word_id, unnest(string_split(upper(replace(replace(p_name, 'l', 'I'), 'o', '0')), ' ')) AS w FROM part) GROUP BY w),
  sc AS (SELECT part, w, word_id, 1.0::DOUBLE - levenshtein(part, w) / greatest(length(part), length(w)) AS ratio FROM (SELECT DISTINCT part FROM parts WHERE length(part) >= 3) JOIN words ON TRUE),
  b AS (SELECT part, min_by(w, (-ratio, w)) AS text, max(ratio) AS ratio FROM sc WHERE ratio > 0.7 GROUP BY part)
  SELECT name_id, part_no, part, text, word_id, ratio FROM parts JOIN b USING (part) JOIN words ON words.w = b.text""",
)
def _(t):
    left = t.part.select(F.lit("P").alias("project_id"), F.col("p_partkey").alias("name_id"), F.col("p_name").alias("name"))
    noisy = F.explode(F.split(F.upper(F.translate("p_name", "lo", "I0")), " "))
    right = t.part.select(F.lit("P").alias("project_id"), F.col("p_partkey").alias("word_id"), noisy.alias("text"))
    return J.fuzzy_best(left, right, 0.7).drop("project_id")


@q(
    "floor_lookup",
    """SELECT det_id, CASE WHEN page_no = 0 THEN 'Url ' || CAST(supp_no % 25 AS STRING) WHEN floor_no <= 5 THEN 'Story ' || CAST(floor_no AS STRING) ELSE 'Level ' || CAST(floor_no AS STRING) END AS floor_name FROM v_det""",
    "v_det",
)
def _(t):
    det = t.v_det.select("project_id", "det_id", "floor_no", F.expr("CASE WHEN page_no = 0 THEN 'u' || supp_no % 25 END").alias("drawing_url"))
    projects = t.v_det.select("project_id").distinct()
    urls = t.nation.select(F.expr("'u' || n_nationkey").alias("url"), F.expr("'Url ' || n_nationkey").alias("name"))
    urls = urls.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(7)))).select(F.expr("'P' || _p").alias("project_id"), "url", "name")
    numbers = projects.select("project_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("floor_no")).select(
        "project_id", "floor_no", F.expr("'Story ' || floor_no").alias("name")
    )
    floors = urls.withColumn("floor_no", F.lit(None).cast("int")).unionByName(numbers, allowMissingColumns=True)
    return J.floor_name_for(det, floors).select("det_id", "floor_name")


@q(
    "totals_reconcile",
    """WITH s AS (SELECT o_orderstatus || CASE WHEN o_orderstatus = 'F' THEN '-late' ELSE '' END AS status, sum(o_custkey) AS st FROM orders GROUP BY 1),
  e AS (SELECT l_linestatus AS status, sum(l_suppkey) AS ex FROM lineitem GROUP BY 1)
  SELECT status, CAST(st AS BIGINT) AS stated_total, CAST(coalesce(ex, 0) AS BIGINT) AS extracted_total, CAST(coalesce(ex, 0) - st AS BIGINT) AS delta,
   CASE WHEN st IS NOT NULL THEN coalesce(ex, 0) = st END AS match FROM s FULL JOIN e USING (status)""",
)
def _(t):
    late = F.expr("o_orderstatus || CASE WHEN o_orderstatus = 'F' THEN '-late' ELSE '' END")  # a status only one side knows
    stated = t.orders.select(late.alias("status"), F.col("o_custkey").alias("total"))
    return J.reconcile_totals(stated, t.lineitem.select(F.col("l_linestatus").alias("status"), F.col("l_suppkey").alias("total")), "status")


@q(
    "coverage",
    """SELECT nation, bool_or(k = 0) AS in_schedule, bool_or(k = 1) AS in_plan FROM (SELECT c_nationkey + CASE WHEN c_acctbal > 0 THEN 0 ELSE 100 END AS nation, 0 AS k FROM customer
   UNION ALL SELECT s_nationkey, 1 FROM supplier) GROUP BY 1""",
)
def _(t):
    return J.coverage(t.customer.select(F.expr("c_nationkey + CASE WHEN c_acctbal > 0 THEN 0 ELSE 100 END").alias("nation")), t.supplier.select(F.col("s_nationkey").alias("nation")), "nation")


@q(
    "three_way_counts",
    """WITH u AS (SELECT c_mktsegment AS unit_type, o_orderpriority AS floor, o_orderstatus AS st FROM orders JOIN customer ON c_custkey = o_custkey)
  SELECT unit_type, floor, CAST(a AS BIGINT) AS plan, CAST(b AS BIGINT) AS matrix, CAST(c AS BIGINT) AS mix, 'VERIFY' AS status FROM
   (SELECT unit_type, floor, count(*) FILTER (st = 'F') AS a, count(*) FILTER (st = 'O') AS b, count(*) FILTER (st = 'P') AS c FROM u GROUP BY 1, 2) WHERE a <> b OR a <> c""",
)
def _(t):
    u = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy(
        F.col("c_mktsegment").alias("unit_type"), F.col("o_orderpriority").alias("floor"), "o_orderstatus"
    ).agg(F.count(F.lit(1)).alias("n"))
    pick = {n: u.where(F.col("o_orderstatus") == s) for n, s in (("plan", "F"), ("matrix", "O"), ("mix", "P"))}
    return J.three_way(pick, ["unit_type", "floor"])


@q(
    "qty_reconcile",
    """SELECT project_id, mark, CAST(sum(p) AS BIGINT) AS plan_qty, CAST(sum(s) AS BIGINT) AS schedule_qty, CASE WHEN sum(p) = sum(s) THEN 'VERIFIED' ELSE 'VERIFY' END AS status
  FROM (SELECT project_id, mark, 1 AS p, 0 AS s FROM v_det UNION ALL SELECT project_id, mark, 0, row_no % 40 FROM v_sched) GROUP BY ALL""",
    "v_sched", "v_det",
)
def _(t):
    return J.reconcile_qty(D.occurrences(t.v_det), t.v_sched.select(*MARK, F.expr("row_no % 40").alias("qty")), MARK)


@q("usable_sheets", "SELECT page_id, CASE WHEN contains(url, '/fr/') THEN 'MIXED' ELSE 'ARCHITECTURAL' END AS category FROM pages WHERE NOT contains(url, '/de/')")
def _(t):
    category = F.when(F.col("url").contains("/de/"), "NOT_APPLICABLE").when(F.col("url").contains("/fr/"), "MIXED").otherwise("ARCHITECTURAL")
    return J.usable_sheets(t.pages.select("page_id", category.alias("category")), "category")


# Consensus -----------------------------------------------------------------------------------

FLAGS = """f AS (SELECT page_id, upper(trim(mark)) AS mark, max(CASE WHEN pass_no = 1 THEN 1 ELSE 0 END) AS p1, max(CASE WHEN pass_no = 2 THEN 1 ELSE 0 END) AS p2,
  max(CASE WHEN pass_no = 3 THEN 1 ELSE 0 END) AS p3 FROM v_passes GROUP BY ALL),
r AS (SELECT page_id, sum(p1 * p2)::DOUBLE / nullif(sum(greatest(p1, p2)), 0) AS match_ratio FROM f GROUP BY page_id)"""


@q(
    "jaccard_consensus",
    f"""WITH {FLAGS} SELECT page_id, mark, match_ratio, CASE WHEN match_ratio >= 0.3 THEN 'agreement' ELSE '2-of-3' END AS method FROM f JOIN r USING (page_id)
  WHERE (match_ratio >= 0.3 AND p1 + p2 = 2) OR (match_ratio < 0.3 AND p1 + p2 + p3 >= 2)""",
    "v_passes",
)
def _(t):
    return N.jaccard_consensus(t.v_passes, min=0.3).drop("project_id")


@q("page_agreement", f"WITH {FLAGS} SELECT page_id, CAST(sum(p1 * p2) AS BIGINT) AS n_common, CAST(sum(greatest(p1, p2)) AS BIGINT) AS n_joint, sum(p1 * p2)::DOUBLE / nullif(sum(greatest(p1, p2)), 0) AS match_ratio FROM f GROUP BY 1", "v_passes")
def _(t):
    return N.page_agreement(t.v_passes).drop("project_id")


@q("vote_2of3", f"WITH {FLAGS} SELECT page_id, mark, p1 + p2 + p3 AS votes FROM f WHERE p1 + p2 + p3 >= 2", "v_passes")
def _(t):
    return N.vote(t.v_passes).drop("project_id")


def readings(t):
    """Three readings per catalogue item: as printed, with OCR noise, with another noise."""
    return t.part.select(
        "p_partkey", F.col("p_name").alias("pass_1"),
        F.expr("CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE translate(p_name, 'o', '0') END").alias("pass_2"),
        F.expr("CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE translate(p_name, 'le', '1c') END").alias("pass_3"),
    )


def blocks_sql(pairs: str) -> str:
    """CTE ``ratios`` (a, b, ratio) by matching blocks of the pairs (a, b) of texts under 200 letters; needs WITH RECURSIVE."""
    size = "coalesce(list_max(list_filter(range(1, least({ahi} - i, {bhi} - j) + 1), lambda k: substr(a, i + 1, k) = substr(b, j + 1, k))), 0)"
    best = "list_sort(flatten(list_transform(range({alo}, {ahi}), lambda i: list_transform(range({blo}, {bhi}), lambda j: {{'n': -" + size + ", 'i': i, 'j': j}}))))[1]"
    cut = lambda alo, ahi, blo, bhi: best.format(alo=alo, ahi=ahi, blo=blo, bhi=bhi)
    return f"""pairs AS (SELECT DISTINCT a, b FROM {pairs} WHERE a <> '' AND b <> ''),
  seg AS (SELECT a, b, 0::BIGINT AS alo, length(a) AS ahi, 0::BIGINT AS blo, length(b) AS bhi, {cut("0", "length(a)", "0", "length(b)")} AS m FROM pairs
   UNION ALL SELECT a, b, c.alo, c.ahi, c.blo, c.bhi, {cut("c.alo", "c.ahi", "c.blo", "c.bhi")} FROM (SELECT a, b, unnest([{{'alo': alo, 'ahi': m.i, 'blo': blo, 'bhi': m.j}}, {{'alo': m.i - m.n, 'ahi': ahi, 'blo': m.j - m.n, 'bhi': bhi}}]) AS c
    FROM seg WHERE m.n < 0) WHERE c.alo < c.ahi AND c.blo < c.bhi),
  ratios AS (SELECT a, b, 2.0::DOUBLE * sum(-m.n) / (length(a) + length(b)) AS ratio FROM seg GROUP BY a, b)"""


LEV = "1.0::DOUBLE - levenshtein(upper({a}), upper({b})) / greatest(length({a}), length({b}))"


@q(
    "string_consensus_edit",
    f"""WITH x AS (SELECT p_partkey, p_name AS a, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE translate(p_name, 'o', '0') END AS b,
   CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE translate(p_name, 'le', '1c') END AS c FROM part)
  SELECT p_partkey, coalesce(r, '') AS resolved, r IS NULL AS needs_review FROM (SELECT p_partkey, CASE WHEN {LEV.format(a='a', b='b')} >= 0.8 THEN a
   WHEN {LEV.format(a='a', b='c')} >= 0.8 THEN a WHEN {LEV.format(a='b', b='c')} >= 0.8 THEN b END AS r FROM x)""",
)
def _(t):
    return N.string_consensus(readings(t), method="edit").select("p_partkey", "resolved", "needs_review")


@q(
    "text_similarity_blocks",
    f"""WITH RECURSIVE x AS (SELECT p_partkey, upper(p_name) AS a, upper(p_type || ' ' || p_name || p_brand) AS b FROM part), {blocks_sql("x")}
  SELECT p_partkey, ratio AS likeness, 1.0::DOUBLE - levenshtein(x.a, x.b) / greatest(length(x.a), length(x.b)) AS by_edits FROM x JOIN ratios USING (a, b)""",
)
def _(t):
    other = F.concat("p_type", F.lit(" "), "p_name", "p_brand")
    return t.part.select("p_partkey", T.similarity("p_name", other).alias("likeness"), T.similarity("p_name", other, "edit").alias("by_edits"))


BRANDED = """SELECT p_partkey, upper(a) AS a, upper(b) AS b, upper(c) AS c FROM (SELECT p_partkey, p_name AS a, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS b,
   CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ' || p_type ELSE p_type || p_brand END AS c FROM part)"""


@q(
    "string_consensus",
    f"""WITH RECURSIVE x AS ({BRANDED}), {blocks_sql("(SELECT a, b FROM x UNION SELECT a, c FROM x UNION SELECT b, c FROM x)")}
  SELECT p_partkey, coalesce(r, '') AS resolved, r IS NULL AS needs_review FROM (SELECT p_partkey, CASE WHEN ab.ratio >= 0.8 THEN x.a WHEN ac.ratio >= 0.8 THEN x.a WHEN bc.ratio >= 0.8 THEN x.b END AS r
   FROM x JOIN ratios ab ON ab.a = x.a AND ab.b = x.b JOIN ratios ac ON ac.a = x.a AND ac.b = x.c JOIN ratios bc ON bc.a = x.b AND bc.b = x.c)""",
)
def _(t):
    turned = F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1)))
    third = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", "p_name", "p_type")).otherwise(F.concat("p_type", "p_brand"))
    shown = t.part.select("p_partkey", F.upper("p_name").alias("pass_1"), F.upper(turned).alias("pass_2"), F.upper(third).alias("pass_3"))
    return N.string_consensus(shown).select("p_partkey", "resolved", "needs_review")


# First rows, ids, evidence ------------------------------------------------------------------


@q(
    "dedup_first",
    f"""WITH c AS (SELECT project_id, row_no, upper(door_type || substring(printed_mark, length(mark) + 1)) AS raw FROM v_sched),
  d AS (SELECT project_id, row_no, raw, {CLEAN.format(c='raw')} AS mark FROM c)
  SELECT project_id, mark, row_no, CASE WHEN mark <> raw THEN raw END AS original FROM d
  QUALIFY row_number() OVER (PARTITION BY project_id, mark ORDER BY row_no) = 1""",
    "v_sched",
)
def _(t):
    s = t.v_sched.select("project_id", "row_no", F.expr("upper(door_type || substring(printed_mark, length(mark) + 1))").alias("mark"))
    return D.dedup_first(s).select("project_id", "mark", "row_no", F.col("_original_mark").alias("original"))


@q("seq_ids", "SELECT event_id, 'A-' || lpad(CAST(n AS STRING), CAST(greatest(3, length(CAST(n AS STRING))) AS INT), '0') AS id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events)")
def _(t):
    return D.sequence_ids(t.events.select("event_type", "event_id"), ["event_type"], ["event_id"]).select("event_id", "id")


@q(
    "occurrence_index",
    "SELECT det_id, row_number() OVER (PARTITION BY project_id, page_id, mark ORDER BY w_cy, w_cx, det_id) AS occurrence FROM v_det",
    "v_det",
)
def _(t):
    return D.occurrence_index(t.v_det, ["project_id", "page_id", "mark"], ["w_cy", "w_cx", "det_id"], 200).select("det_id", "occurrence")


@q(
    "evidence_precedence",
    f"""WITH o AS (SELECT o_custkey, o_orderstatus, o_orderkey % 10 + 1 AS p FROM orders), l AS (SELECT o_custkey, min(p) AS p FROM o GROUP BY 1)
  SELECT o_custkey, coalesce({sql_list(V.EVIDENCE_LEVELS).replace('(', '[').replace(')', ']')}[p], 'hearsay') AS level, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) END AS value,
   CASE WHEN min(o_orderstatus) <> max(o_orderstatus) THEN 'CONFLICT' WHEN p >= 9 THEN 'INFERRED' ELSE 'VERIFIED' END AS status FROM o JOIN l USING (o_custkey, p) GROUP BY o_custkey, p""",
)
def _(t):
    named = F.coalesce(F.get(F.array(*map(F.lit, V.EVIDENCE_LEVELS)), (F.col("o_orderkey") % 10).cast("int")), F.lit("hearsay"))
    o = t.orders.select("o_custkey", named.alias("level"), F.col("o_orderstatus").alias("value"))
    return D.best_evidence(o, key=("o_custkey",))


@q("top_recent", "SELECT user_id, event_id, recency FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recency FROM events) WHERE recency <= 5")
def _(t):
    return D.most_recent(t.events.select("user_id", "event_id", "ts"), n=5, tie="event_id").select("user_id", "event_id", "recency")


# Plan against schedule ------------------------------------------------------------------------

PLAN_ROWS = f"""{RULE_ROWS}, fd AS (SELECT project_id, mark, min_by(vlm_opening_mode, {ORDER_SQL}) AS plan_mode, min_by(vlm_wall_type, {ORDER_SQL}) AS plan_wall, min_by(vlm_reasoning, {ORDER_SQL}) AS plan_reason, count(*) AS qty FROM v_det GROUP BY ALL),
pm AS (SELECT *, fd.mark IS NOT NULL AS located FROM rm LEFT JOIN fd USING (project_id, mark)),
pc AS (SELECT *, CASE WHEN plan_mode IN ('CO', 'REV') AND (has_hardware OR has_material) THEN CASE WHEN has_panel_2 THEN 'PR' ELSE 'SGL' END
  WHEN plan_mode = 'PR' AND NOT has_panel_2 AND resolved_mode = 'SGL' THEN 'SGL' ELSE coalesce(plan_mode, 'UNKNOWN') END AS cleaned FROM pm),
pa AS (SELECT *, located AND resolved_mode <> 'STOREFRONT' AND coalesce(plan_mode, 'UNKNOWN') <> 'UNKNOWN' AND NOT (resolved_mode = cleaned OR (resolved_mode = 'PR' AND cleaned IN ('DE', 'DA'))) AS mode_conflict,
  CASE WHEN explicit_exterior OR coalesce(plan_wall, '') IN ('EXT', 'EXTERIOR') THEN 'Exterior' ELSE 'Interior' END AS plan_side FROM pc)"""


def plan_rows(t):
    from lintel.operators.reconcile import detection_facts
    from lintel.plans.q_text import resolved_rows

    facts = detection_facts(t.v_det)
    rows = resolved_rows(t).join(facts.withColumn("located", F.lit(True)), MARK, "left")
    return rows.withColumns({"located": F.coalesce("located", F.lit(False)), "qty": F.coalesce("qty", F.lit(0))})


@q("arbitrate_mode", f"WITH {PLAN_ROWS.replace('fd.mark IS NOT NULL', 'qty IS NOT NULL')} SELECT row_no, cleaned AS plan_mode_cleaned, mode_conflict, resolved_mode AS final_mode FROM pa", "v_sched", "v_det")
def _(t):
    return K.arbitrate_mode(plan_rows(t))[0].select("row_no", "plan_mode_cleaned", "mode_conflict", "final_mode")


@q("mode_conflicts", f"WITH {PLAN_ROWS.replace('fd.mark IS NOT NULL', 'qty IS NOT NULL')} SELECT project_id, 'opening_mode_conflict' AS type, mark, 'Opening Mode Conflict: Schedule suggests ''' || resolved_mode || ''' but floor plan crop reads as ''' || cleaned || '''. (Reasoning: ' || coalesce(nullif(plan_reason, ''), '{V.NO_REASON}') || ')' AS context FROM pa WHERE mode_conflict", "v_sched", "v_det")
def _(t):
    return K.arbitrate_mode(plan_rows(t))[1]


@q("int_ext", f"WITH {PLAN_ROWS.replace('fd.mark IS NOT NULL', 'qty IS NOT NULL')} SELECT row_no, plan_side AS side FROM pa", "v_sched", "v_det")
def _(t):
    return K.int_ext(plan_rows(t)).select("row_no", "side")


@q("not_located", f"WITH {PLAN_ROWS.replace('fd.mark IS NOT NULL', 'qty IS NOT NULL')} SELECT row_no, NOT located AS is_borderline, CASE WHEN NOT located THEN 'mark_not_located_on_drawing' END AS review_reason FROM pa", "v_sched", "v_det")
def _(t):
    return K.not_located(plan_rows(t))[0].select("row_no", "is_borderline", "review_reason")


STATUS = f"""{PLAN_ROWS.replace('fd.mark IS NOT NULL', 'qty IS NOT NULL')}, {BUCKETS.replace('FROM rm)', 'FROM pa)').replace("CASE WHEN explicit_exterior THEN 'Exterior' ELSE 'Interior' END AS side5", "plan_side AS side5")},
st AS (SELECT *, CASE WHEN excluded THEN 'EXCLUDED' WHEN NOT located THEN 'NOT FOUND' WHEN mode_conflict THEN 'CONFLICT' WHEN row_no % 50 = 0 THEN 'VERIFY' ELSE 'VERIFIED' END AS status,
  trim(concat_ws(' ', note, CASE WHEN NOT located THEN 'Not Found' END)) AS takeoff_notes FROM bb)"""


def status_rows(t):
    rows = K.bucket5(K.int_ext(K.with_arbitration(plan_rows(t))), "comments")
    return K.takeoff_notes(K.status(rows.withColumn("needs_review", F.col("row_no") % 50 == 0)))


@q("status", f"WITH {STATUS} SELECT row_no, status FROM st", "v_sched", "v_det")
def _(t):
    return status_rows(t).select("row_no", "status")


@q("takeoff_notes", f"WITH {STATUS} SELECT row_no, takeoff_notes, (excluded OR NOT located OR is_cased) AND takeoff_notes = '' AS note_missing FROM st", "v_sched", "v_det")
def _(t):
    return status_rows(t).select("row_no", "takeoff_notes", "note_missing")


# Geometry -------------------------------------------------------------------------------------

BOXES = """SELECT 'S' || CAST(p_partkey % {pages} AS STRING) AS page_id, 'P' AS project_id, p_partkey AS {id}, CAST(p_partkey * 37 % 2000 AS DOUBLE) AS x0, CAST(p_partkey * 91 % 1500 AS DOUBLE) AS y0,
  CAST(p_partkey * 37 % 2000 + p_size AS DOUBLE) AS x1, CAST(p_partkey * 91 % 1500 + {h} AS DOUBLE) AS y1, p_partkey % 3 = 0 AS has_curve, p_partkey % 7 = 0 AS is_dashed FROM {part}"""


def boxes(t, id, pages=5, h="p_size"):
    return t.spark.sql(BOXES.replace("{pages}", str(pages)).replace("{id}", id).replace("{h}", h), part=t.part)


def boxes_sql(id, pages=5, h="p_size"):
    return BOXES.format(pages=pages, id=id, h=h, part="part")


@q(
    "bbox_join",
    f"""WITH a AS ({boxes_sql('a_id')}), b AS ({boxes_sql('b_id', h='8')}) SELECT a_id, b_id FROM a JOIN b ON a.page_id = b.page_id AND a.x0 - 70 < b.x1 AND b.x0 < a.x1 + 70 AND a.y0 - 70 < b.y1 AND b.y0 < a.y1 + 70""",
)
def _(t):
    return S.bbox_join(boxes(t, "a_id"), boxes(t, "b_id", h="8")).select("a_id", "b_id")


CENTRE = "(x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, (x1 - x0) * (y1 - y0) AS area"
DIST = "sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2))"


@q(
    "radius_pairs",
    f"""WITH a AS (SELECT *, {CENTRE} FROM ({boxes_sql('a_id')})), b AS (SELECT *, {CENTRE} FROM ({boxes_sql('b_id', h='8')}))
  SELECT a_id, b_id AS b_b_id, {DIST} AS dist FROM a JOIN b ON a.page_id = b.page_id AND {DIST} <= 50""",
)
def _(t):
    a = S.path_centres(boxes(t, "a_id")).select("project_id", "page_id", "a_id", "cx", "cy")
    b = S.path_centres(boxes(t, "b_id", h="8")).select("project_id", "page_id", "b_id", "cx", "cy")
    return S.radius_join(a, b, 50.0).select("a_id", "b_b_id", "dist")


@q(
    "radius_count",
    f"""WITH a AS (SELECT *, {CENTRE} FROM ({boxes_sql('mark_id')})), b AS (SELECT *, {CENTRE} FROM ({boxes_sql('b_id', h='8')}) WHERE has_curve)
  SELECT mark_id, CAST(count(b.b_id) AS BIGINT) AS arc_count FROM a LEFT JOIN b ON a.page_id = b.page_id AND {DIST} <= 50 AND NOT ({DIST} < 15 AND b.area < 200) GROUP BY mark_id""",
)
def _(t):
    marks = S.path_centres(boxes(t, "mark_id")).select("project_id", "page_id", "mark_id", "cx", "cy")
    return S.path_count(marks, boxes(t, "b_id", h="8")).select("mark_id", "arc_count")


@q(
    "nearest_1d",
    """WITH p AS (SELECT event_id, user_id % 8 AS k, CAST(epoch_us(ts) // 1000000 AS DOUBLE) AS pos FROM events), a AS (SELECT o_orderkey AS anchor_id, o_orderkey % 8 AS k,
    CAST(1704067200 + (o_orderkey * 7919) % 2678400 AS DOUBLE) AS pos FROM orders),
  s AS (SELECT k, pos, min(anchor_id) AS id FROM a GROUP BY ALL),
  lo AS (SELECT p.event_id, p.pos, s.pos AS lpos, s.id AS lid FROM p ASOF LEFT JOIN s ON p.k = s.k AND p.pos >= s.pos),
  hi AS (SELECT p.event_id, s.pos AS hpos, s.id AS hid FROM p ASOF LEFT JOIN s ON p.k = s.k AND p.pos <= s.pos)
  SELECT event_id, CASE WHEN lid IS NULL THEN hid WHEN hid IS NULL THEN lid WHEN pos - lpos <= hpos - pos THEN lid ELSE hid END AS anchor_id,
   CASE WHEN lid IS NULL THEN hpos - pos WHEN hid IS NULL THEN pos - lpos WHEN pos - lpos <= hpos - pos THEN pos - lpos ELSE hpos - pos END AS dist FROM lo JOIN hi USING (event_id)""",
)
def _(t):
    pts = t.events.select("event_id", F.expr("user_id % 8").alias("k"), F.expr("cast(unix_micros(cast(ts as timestamp)) div 1000000 as double)").alias("pos"))
    anchors = t.orders.select(
        F.col("o_orderkey").alias("anchor_id"), F.expr("o_orderkey % 8").alias("k"),
        F.expr("cast(1704067200 + (o_orderkey * 7919) % 2678400 as double)").alias("pos"),
    )
    return S.nearest_1d(pts, anchors, key=["k"]).select("event_id", "anchor_id", "dist")


@q(
    "nearest_span",
    """WITH sp AS (SELECT n_nationkey AS span_no, CAST(n_nationkey * 40 AS DOUBLE) AS lo, CAST(n_nationkey * 40 + 10 + n_regionkey * 4 AS DOUBLE) AS hi FROM nation),
  p AS (SELECT DISTINCT w_cx AS pos FROM v_det),
  best AS (SELECT pos, min_by(span_no, (CASE WHEN pos BETWEEN lo AND hi THEN 0 ELSE 1 END, CASE WHEN pos BETWEEN lo AND hi THEN 0 ELSE least(abs(pos - lo), abs(pos - hi)) END, span_no)) AS span_no FROM p JOIN sp ON TRUE GROUP BY pos)
  SELECT det_id, span_no FROM v_det JOIN best ON w_cx = pos""",
    "v_det",
)
def _(t):
    spans = t.nation.select(
        F.lit("K").alias("k"), F.col("n_nationkey").alias("span_no"), F.expr("cast(n_nationkey * 40 as double)").alias("lo"),
        F.expr("cast(n_nationkey * 40 + 10 + n_regionkey * 4 as double)").alias("hi"),
    )
    pts = t.v_det.select("det_id", F.lit("K").alias("k"), F.col("w_cx").alias("pos"))
    return S.nearest_span(pts, spans, key=["k"]).select("det_id", "span_no")


SEG = """SELECT CASE WHEN s_acctbal >= 500 THEN 'S' ELSE 'X' END || CAST(s_suppkey AS STRING) AS page_id, CAST(s_suppkey % 500 AS DOUBLE) AS x0, 100.0::DOUBLE AS y0, CAST(s_suppkey % 500 + 300 AS DOUBLE) AS x1,
  CAST(200 + s_nationkey * 20 AS DOUBLE) AS y1 FROM supplier"""


@q(
    "segment_distance_bands",
    f"""WITH s AS ({SEG}), u AS (SELECT det_id, d.page_id, w_cx, w_cy, x0, y0, x1, y1, greatest(0.0, least(1.0, ((w_cx - x0) * (x1 - x0) + (w_cy - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) AS tt
   FROM v_det d LEFT JOIN s ON d.page_id = s.page_id),
  v AS (SELECT det_id, sqrt(pow(w_cx - (x0 + tt * (x1 - x0)), 2) + pow(w_cy - (y0 + tt * (y1 - y0)), 2)) AS d, x0 IS NOT NULL AS has FROM u)
  SELECT det_id, round(d, 6) AS dist, CASE WHEN NOT has THEN 'borderline' WHEN d <= 25 THEN 'perimeter' WHEN d <= 85 THEN 'borderline' ELSE 'inside' END AS zone FROM v""",
    "v_det",
)
def _(t):
    segs = t.supplier.select(
        F.expr("CASE WHEN s_acctbal >= 500 THEN 'S' ELSE 'X' END || s_suppkey").alias("page_id"), F.expr("cast(s_suppkey % 500 as double)").alias("x0"), F.lit(100.0).alias("y0"),
        F.expr("cast(s_suppkey % 500 + 300 as double)").alias("x1"), F.expr("cast(200 + s_nationkey * 20 as double)").alias("y1"),
    )
    pts = t.v_det.select("det_id", "page_id", F.col("w_cx").alias("cx"), F.col("w_cy").alias("cy"))
    out = S.nearest_segment(pts, segs, key=["page_id"], point_id="det_id")
    return out.select("det_id", F.round("dist", 6).alias("dist"), "zone")


@q("margin", "SELECT det_id FROM v_det WHERE w_cx BETWEEN 100 AND 900 AND w_cy BETWEEN 80 AND 720", "v_det")
def _(t):
    return t.v_det.where(T.in_margin("w_cx", "w_cy", F.lit(1000.0), F.lit(800.0))).select("det_id")


@q(
    "zones",
    """SELECT det_id FROM v_det d WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE d.page_id = 'S' || CAST(s_suppkey AS STRING) AND w_cx BETWEEN s_suppkey % 900 - 20 AND 1000 AND w_cy BETWEEN s_nationkey * 30 - 50 AND 800)""",
    "v_det",
)
def _(t):
    titles = t.supplier.select(
        F.lit("P").alias("project_id"), F.expr("'S' || s_suppkey").alias("page_id"), F.lit("Door Schedule").alias("text"),
        F.expr("cast(s_suppkey % 900 as double)").alias("x0"), F.expr("cast(s_nationkey * 30 as double)").alias("y0"),
    )
    sheets = titles.select("project_id", "page_id", F.lit(1000.0).alias("page_w"), F.lit(800.0).alias("page_h"))
    zones = S.schedule_zones(titles, sheets)
    pts = t.v_det.select("page_id", "det_id", F.col("w_cx").alias("cx"), F.col("w_cy").alias("cy"))
    return S.outside_zones(pts, zones.drop("project_id"), ["page_id"]).select("det_id")


LABELS = ["ondre", "und", "queeux", "tion", "the"]


@q(
    "label_blocks",
    f"SELECT block, line, word FROM v_words WHERE block NOT IN (SELECT block FROM v_words WHERE lower(trim(text, '.,()[]{{}}-_#*/')) IN {sql_list(LABELS)})",
    "v_words",
)
def _(t):
    return S.drop_labelled_blocks(t.v_words, LABELS).select("block", "line", "word")


@q(
    "prefer_if_any",
    """SELECT det_id FROM (SELECT *, supp_no % 7 = 0 AS f, bool_or(supp_no % 7 = 0) OVER (PARTITION BY project_id, mark) AS g FROM v_det) WHERE f OR NOT g""",
    "v_det",
)
def _(t):
    rows = t.v_det.select(*MARK, "det_id", F.expr("supp_no % 7 = 0").alias("in_circle"))
    return S.prefer_if_any(rows, key=MARK).select("det_id")


@q(
    "tag_circles",
    f"""WITH a AS (SELECT *, {CENTRE} FROM ({boxes_sql('mark_id')})), b AS (SELECT *, {CENTRE} FROM ({boxes_sql('b_id')}) WHERE has_curve AND x1 - x0 BETWEEN 12 AND 35 AND y1 - y0 BETWEEN 12 AND 35 AND abs((x1 - x0) - (y1 - y0)) <= 4)
  SELECT mark_id, EXISTS (SELECT 1 FROM b WHERE a.page_id = b.page_id AND {DIST} <= 12) AS in_circle FROM a""",
)
def _(t):
    marks = S.path_centres(boxes(t, "mark_id")).select("project_id", "page_id", "mark_id", "cx", "cy")
    return S.in_tag_circle(marks, boxes(t, "b_id")).select("mark_id", "in_circle")


def dedup_points(t):
    return t.v_det.select("page_id", "det_id", F.col("w_cx").alias("cx"), F.col("w_cy").alias("cy"), F.expr("-floor_no").alias("neg_arcs"))


@q(
    "spatial_dedup",
    """SELECT det_id FROM v_det a WHERE NOT EXISTS (SELECT 1 FROM v_det b WHERE a.page_id = b.page_id AND abs(a.w_cx - b.w_cx) < 8 AND abs(a.w_cy - b.w_cy) < 8
  AND (-b.floor_no, b.det_id) < (-a.floor_no, a.det_id))""",
    "v_det",
)
def _(t):
    return S.spatial_dedup(dedup_points(t), rank=("neg_arcs", "det_id"), key=["page_id"]).select("det_id")


@q(
    "spatial_dedup_greedy",
    """WITH RECURSIVE o AS (SELECT page_id, w_cx, w_cy, det_id, row_number() OVER (PARTITION BY page_id ORDER BY -floor_no, det_id) AS n FROM v_det),
  s AS (SELECT DISTINCT page_id, 0::BIGINT AS n, CAST([] AS STRUCT(x DOUBLE, y DOUBLE)[]) AS kept, NULL::VARCHAR AS det_id FROM o
   UNION ALL SELECT page_id, n, CASE WHEN free THEN list_append(kept, {'x': w_cx, 'y': w_cy}) ELSE kept END, CASE WHEN free THEN det_id END FROM (
    SELECT o.page_id, o.n, s.kept, o.w_cx, o.w_cy, o.det_id, len(list_filter(s.kept, lambda k: abs(k.x - o.w_cx) < 8 AND abs(k.y - o.w_cy) < 8)) = 0 AS free FROM s JOIN o ON o.page_id = s.page_id AND o.n = s.n + 1))
  SELECT det_id FROM v_det WHERE det_id IN (SELECT det_id FROM s)""",
    "v_det",
)
def _(t):
    return S.spatial_dedup(dedup_points(t), rank=("neg_arcs", "det_id"), key=["page_id"], exact=True).select("det_id")


NEAR_ARCS = f"""a AS (SELECT *, {CENTRE} FROM ({boxes_sql('mark_id')})), b AS (SELECT *, {CENTRE} FROM ({boxes_sql('b_id', h='8')})),
  pt AS (SELECT mark_id, cx, cy, row_number() OVER (PARTITION BY mark_id ORDER BY cx, cy) AS n FROM (SELECT DISTINCT mark_id, b.cx, b.cy FROM a JOIN b ON a.page_id = b.page_id AND b.has_curve
   AND {DIST} <= 50 AND NOT ({DIST} < 15 AND b.area < 200))),
  ed AS (SELECT p.mark_id, p.n AS f, r.n AS t FROM pt p JOIN pt r ON p.mark_id = r.mark_id AND sqrt(pow(p.cx - r.cx, 2) + pow(p.cy - r.cy, 2)) < 45),
  rc AS (SELECT mark_id, n, n AS root FROM pt UNION SELECT rc.mark_id, ed.t, rc.root FROM rc JOIN ed ON rc.mark_id = ed.mark_id AND rc.n = ed.f),
  gr AS (SELECT mark_id, count(DISTINCT root) AS leaf_groups FROM (SELECT mark_id, n, min(root) AS root FROM rc GROUP BY ALL) GROUP BY mark_id)"""


@q("leaf_groups", f"WITH RECURSIVE {NEAR_ARCS} SELECT mark_id, CAST(leaf_groups AS INT) AS leaf_groups FROM gr")
def _(t):
    marks = S.path_centres(boxes(t, "mark_id")).select("project_id", "page_id", "mark_id", "cx", "cy")
    return S.leaf_groups(S.arcs_near(marks, boxes(t, "b_id", h="8"))).select("mark_id", "leaf_groups")


@q(
    "mode_from_paths",
    f"""WITH RECURSIVE {NEAR_ARCS}, da AS (SELECT DISTINCT mark_id FROM a JOIN b ON a.page_id = b.page_id AND b.is_dashed AND (b.has_curve OR NOT (b.x1 - b.x0 > 80 OR b.y1 - b.y0 > 80))
   AND {DIST} < 65 AND NOT ({DIST} < 15 AND b.area < 200))
  SELECT mark_id, CASE WHEN mark_id IN (SELECT mark_id FROM da) THEN 'DA' WHEN leaf_groups >= 2 THEN 'PR' ELSE 'SGL' END AS opening_mode FROM a LEFT JOIN gr USING (mark_id)""",
)
def _(t):
    marks = S.path_centres(boxes(t, "mark_id")).select("project_id", "page_id", "mark_id", "cx", "cy")
    return S.mode_from_paths(marks, boxes(t, "b_id", h="8")).select("mark_id", "opening_mode")


@q(
    "fact_mode",
    f"""SELECT row_no, CASE WHEN door_material IN {sql_list(V.PATH_STOREFRONT_MATERIAL)} OR frame_material IN {sql_list(V.PATH_STOREFRONT_MATERIAL)} OR {sql_any('upper(comments)', V.PATH_STOREFRONT_COMMENT)} THEN 'STOREFRONT'
  WHEN leaves = '2' AND row_no % 2 = 0 THEN 'PR' WHEN leaves <> '' THEN 'SGL' WHEN {"((door_material IN " + sql_list(V.BLANK_CASED_MATERIAL) + " AND door_type IN " + sql_list(V.BLANK_CASED_TYPE) + ") OR door_type IN " + sql_list(V.CASED_TYPES) + ")"} THEN 'CO'
  WHEN {sql_any('upper(comments)', V.DOUBLE_ACTING_PHRASES)} OR len(list_intersect(string_split(door_type, ' '), {sql_arr(V.DOUBLE_ACTING_WORDS)})) > 0 THEN 'DA' END AS fact_mode FROM v_sched""",
    "v_sched",
)
def _(t):
    rows = t.v_sched.withColumns(
        {"comments": F.upper("comments"), "width_a": F.col("leaves"), "width_b": F.expr("CASE WHEN leaves = '2' AND row_no % 2 = 0 THEN '3' ELSE '-' END")}
    )
    return rows.select("row_no", S.fact_mode().alias("fact_mode"))


