"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from .quality_rules import RULES

WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"

OP5 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.doc_id, pos, line, coalesce(k.doc_id > f.first_doc, false) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP2 = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


WORD = r"'[^\x20\x09-\x0D]+'"
OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b, o, x.n AS na, y.n AS nb FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = d.doc_id) AS component_id,
  least(doc_id, coalesce((SELECT min(b) FROM e WHERE a = d.doc_id AND o = na AND o = nb), doc_id)) AS class_id
FROM d LEFT JOIN n USING (doc_id)
"""


def _op6(risk: float = 0.04, delta: float = 0.05, price: float = 3.0) -> str:
    rules = " UNION ALL ".join(f"SELECT stratum, label, picks, '{r}' AS rule, {i} AS nth, ({m})::DOUBLE AS v, {grid}::DOUBLE[] AS grid, {str(over).lower()} AS over FROM h" for i, (r, (m, grid, over)) in enumerate(RULES.items()))
    hits = ", ".join(f"CASE WHEN coalesce((SELECT ({m}) {'>' if over else '<'} cutoff FROM best WHERE best.stratum = f.stratum AND rule = '{r}'), false) THEN '{r}' END" for r, (m, _, over) in RULES.items())
    return f"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
tri AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORD})) AS l FROM w),
m AS (SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w JOIN l USING (doc_id) LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
k AS (SELECT doc_id, max(quality) AS label FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
h AS (SELECT f.*, label, md5(doc_id::VARCHAR)[1:1] IN ('0', '1', '2', '3') AS picks FROM f JOIN k USING (doc_id) WHERE NOT base_failed),
v AS ({rules}),
c AS (SELECT stratum, rule, label, picks, v, over, unnest(grid) AS cutoff, unnest(range(len(grid))) AS step FROM v),
g AS (SELECT *, CASE WHEN over THEN v > cutoff ELSE v < cutoff END AS r FROM c),
b0 AS (SELECT stratum, rule, step, cutoff, count(*) FILTER (WHERE label = 1 AND NOT picks) AS n, count(*) FILTER (WHERE label = 1 AND r AND NOT picks) AS bad_hit,
  count(*) FILTER (WHERE label = 1 AND r) AS bad_all, count(*) FILTER (WHERE label = 0 AND r) AS hit,
  count(*) FILTER (WHERE label = 0 AND r AND picks) - {price}::DOUBLE * count(*) FILTER (WHERE label = 1 AND r AND picks) AS first_gain FROM g GROUP BY ALL),
b1 AS (SELECT * FROM b0 QUALIFY max(first_gain) OVER (PARTITION BY stratum, rule) > 0),
b AS (SELECT b1.*, {risk}::DOUBLE / active AS share FROM b1 JOIN (SELECT stratum, count(DISTINCT rule) AS active FROM b1 GROUP BY stratum) USING (stratum)),
q AS (SELECT *, CASE WHEN n = 0 OR bad_hit >= n * share THEN 1.0 ELSE list_sum(list_transform(range(bad_hit + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(share) + (n - i) * ln(1 - share)))) END AS p FROM b),
z AS (SELECT *, min((p <= {delta}::DOUBLE / (SELECT count(*) FROM (SELECT DISTINCT stratum, rule FROM q)))::INTEGER) OVER (PARTITION BY stratum, rule ORDER BY step) AS passed, hit - {price}::DOUBLE * bad_all AS gain FROM q),
best AS (SELECT stratum, rule, cutoff FROM z WHERE passed = 1 AND gain > 0 QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, step) = 1),
o AS (SELECT *, CASE WHEN base_failed THEN 'base' ELSE concat_ws(',', {hits}) END AS rejected_by FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by = '' AS kept, stratum, rejected_by FROM o
"""


#: Lengths and products are sums of doubles; no pair of the given tables lies so near the threshold that their order would matter.
OP11 = """
WITH RECURSIVE v AS (SELECT DISTINCT vec_id, label, embedding FROM embeddings),
u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT r.vec_id, p.b FROM r JOIN p ON r.c = p.a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a), m AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, v.vec_id = c AS kept FROM v LEFT JOIN n ON a = v.vec_id JOIN m ON m.vec_id = v.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_vector_dedup": OP11, "op2_topk": OP2, "op3_jaccard_join": OP3, "op5_line_dedup": OP5, "op6_quality_rules": _op6()}
