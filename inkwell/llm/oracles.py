"""SQL of the queries that SQL can say, for DuckDB, by the letter of what each returns."""

from __future__ import annotations

from inkwell.llm.decontaminate import ORACLE_SQL as CONTAINED

#: Spans of a pattern's leftmost matches: a match starts where the pieces and matches before it end.
_SPANS = """SELECT doc_id, source, repository, {k} AS k, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i-1], lambda x: length(x))), 0), 'm': m[i], 'v': v[i]}})) AS x
FROM (SELECT doc_id, source, repository, regexp_split_to_array(t, {p}) AS p, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {g}) AS v FROM d WHERE regexp_matches(t, {p}))"""
_ASSIGN = r"""'((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""
_WRITTEN = "coalesce(string_agg(['assign', 'access', 'hex', 'token'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k), '')"
SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source, concat_ws('/', source, lang) AS repository FROM documents),
a AS ({_SPANS.format(k=0, p=_ASSIGN, g=2)}), c AS ({_SPANS.format(k=1, p="'AKIA[A-Z0-9]+'", g=0)}), h AS ({_SPANS.format(k=2, p="'[0-9a-f]+'", g=0)}), n AS ({_SPANS.format(k=3, p="'[A-Za-z0-9_-]+'", g=0)}),
base AS (SELECT doc_id, source, repository, k, CAST(x.s AS BIGINT) AS s, CAST(x.s AS BIGINT) + length(x.m) AS e, x.v AS v FROM (SELECT * FROM a UNION ALL SELECT * FROM c UNION ALL SELECT * FROM h)
WHERE length(x.v) >= [6, 20, 24][k + 1]),
tok AS (SELECT doc_id, source, repository, k, CAST(x.s AS BIGINT) AS s, CAST(x.s AS BIGINT) + length(x.m) AS e, x.v AS v FROM n
WHERE length(x.m) >= 20 AND length(regexp_replace(x.m, '[^0-9]', '', 'g')) >= 4 AND length(regexp_replace(x.m, '[^A-Za-z]', '', 'g')) >= 4),
held AS (SELECT * FROM base UNION ALL SELECT * FROM tok WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = tok.doc_id AND b.s < tok.e AND tok.s < b.e)),
copied AS (SELECT v, count(DISTINCT source) >= 3 AND count(DISTINCT repository) >= 3 AS copied FROM held GROUP BY v),
told AS (SELECT held.*, copied FROM held JOIN copied USING (v) WHERE k < 3 OR NOT copied),
b AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, {_WRITTEN} AS spans FROM base GROUP BY doc_id),
l AS (SELECT doc_id, {_WRITTEN} AS spans, count(*) FILTER (NOT copied) AS n_live, count(*) FILTER (copied) AS n_copied FROM told GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(l.spans, '') AS spans,
coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id)
"""

#: Pairs by what they share; then each document takes the smallest id that it can reach.
NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE ['whole ' || array_to_string(w, ' ')] END) AS h FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(h, chr(10) ORDER BY h)) AS same FROM s GROUP BY doc_id),
c AS (SELECT min(doc_id) AS doc_id, same, any_value(n) AS n FROM n GROUP BY same),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN c ca ON ca.doc_id = a.doc_id JOIN s b USING (h) JOIN c cb ON cb.doc_id = b.doc_id WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r(a, b) AS (SELECT doc_id, doc_id FROM c UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS label FROM r GROUP BY a),
g AS (SELECT n.doc_id, n.n, m.label FROM n JOIN c USING (same) JOIN m ON m.doc_id = c.doc_id)
SELECT d.doc_id, CAST(coalesce(g.n, 0) AS BIGINT) AS n_shingles, coalesce(g.label, d.doc_id) AS component_id, coalesce(g.label, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN g USING (doc_id)
"""

#: Bytes as two hexadecimal digits each: strings that an earlier one equals, the runs that they cover, and what lies between.
SUBSTRINGS = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
p AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS i FROM d WHERE length(x) >= 200)),
o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM p),
g AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS new FROM o WHERE n > 1),
r AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g) GROUP BY doc_id, k),
c AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM r),
t AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(x, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS kept FROM c JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""

ORACLE_SQL = {
    "op2_secret_scans": SECRETS,
    "op3_benchmark_decontamination": CONTAINED,
    "op4_minhash_near_dedup": NEAR_DUPLICATES,
    "op8_suffix_array_dedup": SUBSTRINGS,
}
