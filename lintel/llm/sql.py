"""Expected results of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

from lintel.llm import collocations, mixing, quality_rules

SPACE = r"'[\x20\x09-\x0D]+'"
WORDS = f"list_filter(string_split_regex(coalesce(text, ''), {SPACE}), lambda x: x <> '')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS ws FROM documents),
  s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS g FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.n + ny.n - i)),
  r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
  SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, coalesce(min(r.root), d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id"""

_P5 = quality_rules.RISK / len(quality_rules.GRID)
_RULES = ", ".join(f"'{r}'" for r in quality_rules.GRID)
_OVERS = ", ".join("len(list_filter([" + ", ".join(f"CAST({c} AS DOUBLE)" for c in g) + f"], lambda c: {r} > c))" for r, g in quality_rules.GRID.items())
_CUTS = "MAP {" + ", ".join(f"'{r}': [" + ", ".join(f"CAST({c} AS DOUBLE)" for c in g) + "]" for r, g in quality_rules.GRID.items()) + "}"
_MOST = max(map(len, quality_rules.GRID.values()))
_P = quality_rules.RISK
_OVER = "greatest(" + ", ".join("len(list_filter([" + ", ".join(f"CAST({c} AS DOUBLE)" for c in g[: quality_rules.LEVELS]) + f"], lambda c: {r} > c))" for r, g in quality_rules.GRID.items()) + ")"
QUALITY_RULES = f"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, {WORDS} AS ws,
   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
  f5 AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
  tw AS (SELECT doc_id, i FROM f5 QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
  rp AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM tw, (SELECT unnest(range(5)) AS j) GROUP BY 1),
  b AS (SELECT doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
   length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper, len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rp USING (doc_id)),
  f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_share, CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END AS upper_share,
   CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word FROM b),
  gd AS (SELECT doc_id FROM labels GROUP BY 1 HAVING min(quality) = 1),
  h5 AS (SELECT stratum, unnest([{_RULES}]) AS rule, unnest([{_OVERS}]) AS over_ FROM f JOIN gd USING (doc_id) WHERE NOT base_failed),
  t5 AS (SELECT stratum, rule, count(*) AS n, list(over_) AS o, count(*) OVER () AS pairs FROM h5 GROUP BY 1, 2),
  c5 AS (SELECT stratum, rule, n, pairs, unnest({_CUTS}[rule]) AS cutoff, unnest(list_transform(range({_MOST}), lambda a: len(list_filter(o, lambda x: x > a)))) AS lost FROM t5),
  k5 AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM c5 WHERE lost < n * {_P5!r} AND list_sum(list_transform(range(0, lost + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_P5!r}) + (n - i) * ln(1 - {_P5!r}))))
   <= {quality_rules.ERROR!r} / pairs GROUP BY 1, 2),
  ct AS (SELECT stratum, {", ".join(f"min(cutoff) FILTER (rule = '{r}') AS x_{r}" for r in quality_rules.GRID)} FROM k5 GROUP BY 1),
  h AS (SELECT stratum, {_OVER} AS over_ FROM f JOIN gd USING (doc_id) WHERE NOT base_failed),
  t AS (SELECT stratum, count(*) AS n, list(over_) AS o, count(*) OVER () AS strata FROM h GROUP BY 1),
  c AS (SELECT stratum, n, strata, unnest(range({quality_rules.LEVELS})) AS level, unnest(list_transform(range({quality_rules.LEVELS}), lambda a: len(list_filter(o, lambda x: x > a)))) AS lost FROM t),
  k AS (SELECT stratum, min(level) AS level FROM c WHERE n < ln({quality_rules.ERROR!r} / ({len(quality_rules.GRID)} * strata)) / ln(1 - {_P5!r}) AND lost < n * {_P!r} AND list_sum(list_transform(range(0, lost + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_P!r}) + (n - i) * ln(1 - {_P!r}))))
   <= {quality_rules.ERROR!r} / strata GROUP BY 1)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT CASE WHEN ct.stratum IS NOT NULL THEN {" OR ".join(f"coalesce(f.{r} > ct.x_{r}, FALSE)" for r in quality_rules.GRID)}
   ELSE coalesce({_OVER} > level, FALSE) END AS kept FROM f LEFT JOIN k ON k.stratum = f.stratum LEFT JOIN ct ON ct.stratum = f.stratum"""

MIX_SOURCES = f"""WITH z AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
  o AS (SELECT source, ss, CAST([{", ".join(map(str, mixing.WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS DOUBLE) AS w, CAST(sum(ss) OVER () AS DOUBLE) AS total,
   CAST({mixing.MAX_EPOCHS} * ss AS DOUBLE) AS cap FROM (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM z GROUP BY 1)),
  l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
  t AS (SELECT source, ss, least(cap, (SELECT max(level) FROM l WHERE level <= cap / w) * w) AS target FROM l),
  d AS (SELECT z.*, ss, target, CASE WHEN ss > 0 THEN CAST(floor(target / ss) AS BIGINT) ELSE 0 END AS whole,
   sum(size) OVER (PARTITION BY z.source ORDER BY CAST('0x' || substring(md5('11:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source)
  SELECT doc_id, size, ss AS source_size, target, CAST(size * whole + greatest(0, least(size, CAST(round(target) AS BIGINT) - whole * ss - upto + size)) AS BIGINT) AS taken FROM d"""

SUFFIX_DEDUP = """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
  s AS (SELECT doc_id, p, substring(h, 2 * p + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM b)),
  m AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g HAVING count(*) > 1),
  t AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM s JOIN m USING (g) WHERE least < doc_id),
  r AS (SELECT doc_id, min(p) AS lo, max(p) + 50 AS hi FROM (SELECT *, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM t) GROUP BY doc_id, k),
  q AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS upto FROM r),
  x AS (SELECT doc_id, count(*) AS spans, sum(hi - lo) AS gone, max(hi) AS last, string_agg(substring(h, 2 * upto + 1, 2 * (lo - upto)), '' ORDER BY lo) AS head FROM q JOIN b USING (doc_id) GROUP BY doc_id)
  SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
   sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM b LEFT JOIN x USING (doc_id)"""

_PIECES = f"string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')"
COLLOCATIONS = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest({_PIECES}) AS piece FROM documents),
  w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
  z AS (SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM w GROUP BY 1),
  g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest(range(1, {collocations.DEPTH + 1})) AS m))),
  f AS (SELECT lang, m, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= {collocations.LEAST}),
  x AS (SELECT lang, phrase, f, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2),
  inner_ AS (SELECT DISTINCT s.lang, s.phrase FROM (SELECT lang, f, unnest([array_to_string(ws[1:len(ws) - 1], ' '), array_to_string(ws[2:len(ws)], ' ')]) AS phrase FROM x WHERE len(ws) >= 3) s JOIN x USING (lang, phrase) WHERE s.f >= x.f),
  c AS (SELECT lang, phrase, f AS a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:len(ws)], ' ') AS rp FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM x ANTI JOIN inner_ USING (lang, phrase))),
  s AS (SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, n, 1000 * a * n // (l.f * r.f) AS score FROM c JOIN f l ON l.lang = c.lang AND l.phrase = lp JOIN f r ON r.lang = c.lang AND r.phrase = rp JOIN z ON z.lang = c.lang),
  b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
  SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM t WHERE rank <= {collocations.TOP}"""
