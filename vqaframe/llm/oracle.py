"""DuckDB SQL for the queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.*, common.owner IS NOT NULL AND common.owner <> doc_id AS gone
  FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

#: The metrics and their fences: numerator, denominator, scale, floor, reach.
_METRICS = (("word_length", "word_chars", "n_words", 1000, 250, 6), ("symbols", "n_symbols", "n_words", 10000, 40, 25),
            ("dup_lines", "n_dup_lines", "n_lines", 10000, 240, 25), ("repeat_words", "n_repeat_words", "n_words", 10000, 50, 50),
            ("upper", "n_upper", "word_chars", 10000, 40, 25))
_METRIC_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, lang, source, '{m}' AS metric, CASE WHEN {under} > 0 THEN {over} * {scale} // {under} ELSE 0 END AS v "
    f"FROM st WHERE NOT base_failed" for m, over, under, scale, _, _ in _METRICS)
_FLOOR = " ".join(f"WHEN '{x[0]}' THEN {x[4]}" for x in _METRICS)
_REACH = " ".join(f"WHEN '{x[0]}' THEN {x[5]}" for x in _METRICS)
_TOP = ("((b - greatest(b // 32 - 1, 0) * 32 + 1) * (1::BIGINT << greatest(b // 32 - 1, 0)::INT) - 1)")


QUALITY = rf"""
WITH w AS (
  SELECT doc_id, lang, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
  FROM (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents)),
win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT doc_id, sum(least(3, coalesce(nx - i, 3))) AS r
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM rep) GROUP BY doc_id),
st0 AS (
  SELECT w.doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, len(ls) AS n_lines,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)),
st AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM st0),
m AS ({_METRIC_ROWS}),
coded AS (SELECT *, greatest(length(bin(v)) - 6, 0) * 32 + (v >> greatest(length(bin(v)) - 6, 0)::INT) AS bucket FROM m),
lv AS (
  SELECT 0 AS level, lang, source, metric, bucket, count(*) AS n FROM coded GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, metric, bucket, count(*) FROM coded GROUP BY ALL
  UNION ALL SELECT 3, NULL, NULL, metric, bucket, count(*) FROM coded GROUP BY ALL),
cu AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS cum,
         sum(n) OVER (PARTITION BY level, lang, source, metric) AS docs FROM lv),
b AS (
  SELECT level, lang, source, metric, docs, min(bucket) FILTER (WHERE cum >= (docs * 15 + 99) // 100) AS b15,
         min(bucket) FILTER (WHERE cum >= (docs * 50 + 99) // 100) AS b50,
         min(bucket) FILTER (WHERE cum >= (docs * 85 + 99) // 100) AS b85
  FROM cu GROUP BY level, lang, source, metric, docs),
q AS (
  SELECT level, lang, source, metric, docs, {_TOP.replace("b ", "b15 ")} AS q15, {_TOP.replace("b ", "b50 ")} AS q50,
         {_TOP.replace("b ", "b85 ")} AS q85, CASE metric {_FLOOR} END AS least, CASE metric {_REACH} END AS reach FROM b),
f AS (
  SELECT level, lang, source, metric, docs, q85 + reach * greatest(q85 - q50, least) AS high,
         CASE WHEN metric = 'word_length' THEN q15 - reach * greatest(q50 - q15, least) ELSE -1 END AS low FROM q),
bad AS (
  SELECT DISTINCT coded.doc_id
  FROM coded JOIN f own ON own.level = 0 AND own.metric = coded.metric AND own.lang IS NOT DISTINCT FROM coded.lang
                       AND own.source IS NOT DISTINCT FROM coded.source
  JOIN f lang ON lang.level = 1 AND lang.metric = coded.metric AND lang.lang IS NOT DISTINCT FROM coded.lang
  JOIN f every ON every.level = 3 AND every.metric = coded.metric
  WHERE v > CASE WHEN own.docs >= 100 THEN own.high WHEN lang.docs >= 100 THEN lang.high ELSE every.high END
     OR v < CASE WHEN own.docs >= 100 THEN own.low WHEN lang.docs >= 100 THEN lang.low ELSE every.low END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM st"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT * FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM s) WHERE rank <= 10"""

FILL_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || s[1:8])::BIGINT AS h1,
         ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
f AS (
  SELECT doc_id, t, len(u) AS n, u, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a,
         greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT doc_id, t, n, form, array_to_string(list_slice(u, 1, a), '') AS pre,
         array_to_string(list_slice(u, a + 1, b), '') AS mid, array_to_string(list_slice(u, b + 1, n), '') AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""

_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS kind, regexp_extract_all(t, '{x}') AS ms, string_split_regex(t, '{x}') AS gaps, "
    f"regexp_extract_all(t, '{x}', {2 if k == 0 else 0}) AS vs FROM d"
    for k, x in enumerate((_ASSIGN, "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}", "[A-Za-z0-9+/_=-]{16,}")))

SECRETS = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, kind, i, length(gaps[i]) AS skip, length(ms[i]) AS chars, vs[i] AS v
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM ({_MATCHES}))),
placed AS (
  SELECT doc_id, kind, v, z - chars AS s, z FROM (
    SELECT *, sum(skip + chars) OVER (PARTITION BY doc_id, kind ORDER BY i) AS z FROM m)),
rules AS (SELECT * FROM placed WHERE kind < 3 AND (kind <> 0 OR length(v) >= 6)),
alone AS (
  SELECT * FROM placed c WHERE kind = 3 AND regexp_matches(v, '[A-Za-z]')
    AND NOT EXISTS (SELECT 1 FROM rules b WHERE b.doc_id = c.doc_id AND b.s < c.z AND b.z > c.s)),
keyed AS (SELECT md5(doc_id::VARCHAR) AS k, t FROM d),
blanked AS (
  SELECT regexp_replace(regexp_replace(regexp_replace(t, '{_ASSIGN}', ' ', 'g'), 'AKIA[A-Z0-9]{{16,}}', ' ', 'g'),
                        '[0-9a-f]{{24,}}', ' ', 'g') AS t
  FROM keyed WHERE k <= (SELECT max(k) FROM (SELECT k FROM keyed ORDER BY k LIMIT 2000))),
names AS (SELECT DISTINCT v FROM (SELECT unnest(regexp_extract_all(t, '[A-Za-z0-9+/_=-]{{6,}}')) AS v FROM blanked) WHERE regexp_matches(v, '[A-Za-z]')),
labelled AS (SELECT v, 1 AS random FROM (SELECT DISTINCT v FROM rules) UNION ALL SELECT v, 0 FROM names),
al AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-' AS x),
steps AS (
  SELECT random, instr(x, v[i]) AS a, instr(x, v[i + 1]) AS b
  FROM (SELECT random, v, unnest(range(1, length(v))) AS i FROM labelled), al),
counts AS (SELECT a, b, sum(random) AS r, sum(1 - random) AS o FROM steps WHERE a > 0 AND b > 0 GROUP BY a, b),
grid AS (
  SELECT a, b, coalesce(r, 0) + 1.0::DOUBLE AS r, coalesce(o, 0) + 1.0::DOUBLE AS o
  FROM (SELECT a, unnest(range(1, 68)) AS b FROM (SELECT unnest(range(1, 68)) AS a)) LEFT JOIN counts USING (a, b)),
scores AS (
  SELECT a, b, round(1000 * (ln(r / sum(r) OVER (PARTITION BY a)) - ln(o / sum(o) OVER (PARTITION BY a))))::BIGINT AS score
  FROM grid),
judged AS (
  SELECT doc_id, s, z FROM (
    SELECT doc_id, s, z, instr(x, v[i]) AS a, instr(x, v[i + 1]) AS b
    FROM (SELECT doc_id, s, z, v, unnest(range(1, length(v))) AS i FROM alone), al) JOIN scores USING (a, b)
  GROUP BY doc_id, s, z HAVING sum(score) >= 10000),
spans AS (
  SELECT doc_id, kind, s, z, ['assign', 'access', 'hex'][kind + 1] || ':' || s || ':' || z AS x FROM rules
  UNION ALL SELECT doc_id, 3, s, z, 'markov:' || s || ':' || z FROM judged)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
       count(*) FILTER (WHERE kind = 2) AS n_hex,
       sha256(coalesce(string_agg(x, ',' ORDER BY s, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
       coalesce(string_agg(x, ',' ORDER BY s, kind), '') AS spans
FROM d LEFT JOIN spans ON d.doc_id = spans.doc_id GROUP BY d.doc_id"""

SQL = {
    "op4_exact_topk": TOP_K,
    "op5_quality_rules": QUALITY,
    "op10_line_dedup": LINE_DEDUP,
    "op11_fill_middle": FILL_MIDDLE,
    "op12_secret_scan": SECRETS,
}
