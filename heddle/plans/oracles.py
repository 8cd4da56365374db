"""DuckDB SQL with the meaning of each catalogue query, written independently of the Spark code."""

from __future__ import annotations

from ..functions import dialogue
from ..functions.fixed import ABUSE, INJECTION, LANGUAGE_NAMES, MARATHI_WORDS, NO_WORDS, OCCUPATION_BUTTONS, OFFTOPIC, REFUSALS, SAFE_REPLIES, TOPIC_WORDS, YES_WORDS
from .catalog import LANG_WEIGHTS, MESSAGES

USAGE = """u AS (
  SELECT event_id AS id, user_id, user_id::VARCHAR AS session_id, ts, event_type AS call_type, k AS prompt_tokens, 2 * k AS completion_tokens, 3 * k AS total_tokens, value AS latency_ms,
    (event_id % 4 = 0)::INTEGER AS cache_hit, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS allowed, 1 + event_id % 2 AS stage,
    CASE WHEN event_type = 'error' AND user_id % 3 = 1 THEN 'offtopic' WHEN event_type = 'error' AND user_id % 3 = 2 THEN 'injection' END AS reason,
    CASE WHEN event_id % 7 <> 0 THEN 'p' || (user_id % 17)::VARCHAR END AS matched
  FROM (SELECT *, nullif(regexp_extract(props, '"k": (\\d+)', 1), '')::BIGINT AS k FROM events))"""
CHUNKS = "c AS (SELECT doc_id AS chunk_id, text, source AS entity, lang AS chunk_type FROM documents)"
TOKENS = "tok AS (SELECT doc_id AS chunk_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM documents)"
TF = f"{TOKENS}, tf AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL)"
STATS = "st AS (SELECT count(*) AS n, coalesce(sum(len(regexp_extract_all(lower(text), '\\p{L}+'))), 0) / greatest(count(*), 1) AS avgdl FROM documents)"
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def _any(c: str, needles) -> str:
    return "(" + " OR ".join(f"contains({c}, {_q(n)})" for n in sorted(needles)) + ")"


def _totals(where: str = "true") -> str:
    return f"""WITH {USAGE}, t AS (SELECT count(*) AS total, count(*) FILTER (WHERE allowed = 0) AS blocked, avg(latency_ms) AS a, avg(latency_ms) FILTER (WHERE stage = 1) AS a1, avg(latency_ms) FILTER (WHERE stage = 2) AS a2 FROM u WHERE {where})
SELECT total, blocked, total - blocked AS allowed, CASE WHEN total = 0 THEN 0.0 ELSE round(blocked / total * 100, 6) END AS block_rate_pct, round(a, 6) AS avg_latency_ms, round(a1, 6) AS avg_latency_stage1, round(a2, 6) AS avg_latency_stage2 FROM t"""


BY_TYPE = f"""WITH {USAGE}, g AS (SELECT call_type, count(*) AS calls, count(*) FILTER (WHERE cache_hit = 1) AS hits, avg(latency_ms) FILTER (WHERE cache_hit = 1) AS hot,
  avg(latency_ms) FILTER (WHERE cache_hit IS NULL OR cache_hit = 0) AS cold, avg(total_tokens) FILTER (WHERE cache_hit IS NULL OR cache_hit = 0) AS tok FROM u GROUP BY call_type),
b AS (SELECT call_type, calls, hits, round(hits / calls * 100, 6) AS hit_rate_pct, round(hot, 6) AS avg_latency_cached, round(cold, 6) AS avg_latency_uncached, round_even(coalesce(tok, 0) * hits, 0)::BIGINT AS tokens_saved FROM g)"""
CACHE = """cache AS (SELECT 'k' || session_id AS cache_key, min(call_type) AS call_type, 'r' AS response, 'en' AS lang, max(ts) AS created_at, max(ts) + INTERVAL 1 HOUR AS expires_at, count(*) AS hit_count FROM u GROUP BY session_id)"""


def _bm25(where: str = "true") -> str:
    return f"""{TF}, {STATS},
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
dl AS (SELECT chunk_id, sum(tf) AS dl FROM tf GROUP BY chunk_id),
q AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS term FROM benchmark WHERE {where}),
sc AS (SELECT query_id, tf.chunk_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (chunk_id), st GROUP BY ALL),
sparse AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1)::INTEGER AS rank, chunk_id, score FROM sc WHERE score > 0 QUALIFY rank < 20)"""


DENSE = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
dense AS (SELECT a.vec_id // 20 AS query_id, (row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.e, b.e), 6) DESC, b.vec_id) - 1)::INTEGER AS rank, b.vec_id AS chunk_id, round(list_dot_product(a.e, b.e), 6) AS score
  FROM v a, v b WHERE a.vec_id % 20 = 0 QUALIFY rank < 20)"""
_WEIGHT = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in LANG_WEIGHTS.items()) + " ELSE 1.0::DOUBLE END"
FUSED = f"""{_bm25()}, {DENSE},
both_ AS (SELECT query_id, chunk_id, max(d) AS dense_rank, max(s) AS sparse_rank, max(ds) AS ds FROM (
  SELECT query_id, chunk_id, rank AS d, NULL::INTEGER AS s, score AS ds FROM dense UNION ALL SELECT query_id, chunk_id, NULL, rank, NULL FROM sparse) GROUP BY ALL),
fused AS (SELECT b.*, source AS entity, round(CASE WHEN count(sparse_rank) OVER (PARTITION BY query_id) > 0
    THEN {_WEIGHT} * (coalesce(0.65::DOUBLE / (61 + dense_rank), 0) + coalesce(0.35::DOUBLE / (61 + sparse_rank), 0)) ELSE {_WEIGHT} * ds END, 9) AS rrf
  FROM both_ b JOIN documents ON doc_id = chunk_id)"""


def _re(patterns: list[str]) -> str:
    """Patterns for RE2, which knows no look-ahead: that alternative is split by the caller."""
    return _q("(?is)" + "|".join(p for p in patterns if "(?!" not in p))


_FIXED = ", ".join(f"({-i}::BIGINT, {_q(t)}, {str(f).lower()})" for i, t, f in MESSAGES)
MSG = f"""msg AS (SELECT * FROM (VALUES {_FIXED}) AS x(msg_id, text, in_flow)
  UNION ALL SELECT conv_id * 1000 + turn, text, conv_id % 3 = 0 FROM conversations WHERE role = 'user'),
m AS (SELECT msg_id, text, in_flow, lower({_strip("text")}) AS low, len(regexp_extract_all({_strip("text")}, '[^{WS}]+')) AS nw FROM msg)"""
#: No fixed or stored message holds "translate", so the look-ahead alternative cannot matter here.
_HIT = {k: f"CASE WHEN regexp_matches(low, {_re(p)}) THEN left(regexp_extract(low, {_re(p)}, 0), 120) END" for k, p in (("injection", INJECTION), ("abuse", ABUSE), ("offtopic", OFFTOPIC))}
_SAFE = "low IN (" + ", ".join(_q(x) for x in sorted(SAFE_REPLIES)) + ")"
CASCADE = f"""{MSG}, h AS (SELECT *, {_HIT["injection"]} AS inj, {_HIT["abuse"]} AS abu, {_HIT["offtopic"]} AS off, low = '__init__' OR {_SAFE} AS safe, {_any("low", TOPIC_WORDS)} AS topic FROM m),
r AS (SELECT *, CASE WHEN safe OR (in_flow AND nw <= 6 AND inj IS NULL) THEN NULL WHEN inj IS NOT NULL THEN 'injection' WHEN abu IS NOT NULL THEN 'abuse' WHEN off IS NOT NULL THEN 'offtopic' END AS reason FROM h)"""


def _script(lo: int, hi: int) -> str:
    return f"len(regexp_extract_all(text, '[\\x{{{lo:04X}}}-\\x{{{hi:04X}}}]'))"


_COUNTS = f"{_script(0xB80, 0xBFF)} AS ta, {_script(0x980, 0x9FF)} AS bn, {_script(0x900, 0x97F)} AS hi, {_script(0xC00, 0xC7F)} + {_script(0xC80, 0xCFF)} AS other, len(regexp_extract_all(text, '[A-Za-z]')) AS latin"
_MARKERS = "[" + ", ".join(_q(x) for x in sorted(MARATHI_WORDS)) + "]"


def _html(c: str = "html") -> str:
    # RE2 has no back-references: one replacement for each tag. Blocks of different tags do not nest in these pages.
    for tag in ("script", "style", "nav", "footer", "header", "aside"):
        c = f"regexp_replace({c}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    c = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    return _strip(f"regexp_replace({c}, '[{WS}]{{2,}}', ' ', 'g')")


_BUTTONS = " ".join(f"WHEN {_q(k.lower())} THEN {_q(v)}" for k, v in OCCUPATION_BUTTONS.items())
_REFUSALS = " ".join(f"WHEN coalesce(reason, CASE WHEN refused THEN 'offtopic' END) = {_q(r)} AND lang = {_q(lg)} THEN {_q(t)}" for r, by in REFUSALS.items() for lg, t in by.items())
_SLOTS = "[" + ", ".join(_q(s) for s in dialogue.SLOTS) + "]"
_NAMES = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in LANGUAGE_NAMES.items())
#: Content areas by the depth of their own tag: enough for pages whose elements nest as they should.
_AREA = """p AS (SELECT page_id, html, regexp_extract_all(html, '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<title\\b[^>]*>.*?</title\\s*>|<[^>]*>|[^<]+') AS ts FROM pages),
t AS (SELECT page_id, unnest(ts) AS t, unnest(range(len(ts))) AS i FROM p),
o AS (SELECT *, sum(length(t)) OVER (PARTITION BY page_id ORDER BY i) AS upto, lower(regexp_extract(t, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS name FROM t),
f AS (SELECT page_id, name, i, upto, CASE WHEN name = 'main' THEN 1 WHEN name = 'article' THEN 2 WHEN regexp_matches(t, 'id="content"') THEN 3 WHEN regexp_matches(t, 'class="([^"]* )?content( [^"]*)?"') THEN 4 WHEN regexp_matches(t, 'class="([^"]* )?scheme-detail( [^"]*)?"') THEN 5 WHEN name = 'body' THEN 6 END AS k
  FROM o WHERE regexp_matches(t, '^<[A-Za-z]')),
g AS (SELECT * FROM f WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id, k ORDER BY i) = 1),
d AS (SELECT g.page_id, g.k, g.upto AS a, o.i, o.upto - length(o.t) AS b, 1 + sum(CASE WHEN starts_with(o.t, '</') THEN -1 ELSE 1 END) OVER (PARTITION BY g.page_id, g.k ORDER BY o.i) AS depth
  FROM g JOIN o ON o.page_id = g.page_id AND o.name = g.name AND o.i > g.i),
z AS (SELECT page_id, k, b FROM d WHERE depth = 0 QUALIFY row_number() OVER (PARTITION BY page_id, k ORDER BY i) = 1),
e AS (SELECT g.page_id, g.k, g.upto AS a, coalesce(z.b, length(p.html)) AS b FROM g JOIN p ON p.page_id = g.page_id LEFT JOIN z ON z.page_id = g.page_id AND z.k = g.k),
h AS (SELECT page_id, html, coalesce((SELECT arg_min(substr(html, a::BIGINT + 1, (b - a)::BIGINT), k) FROM e WHERE e.page_id = p.page_id AND b - a > 500), html) AS area FROM p)"""

def _chunk(kind: str, text: str, when: str = "true") -> str:
    return f"CASE WHEN {when} THEN {{'t': '{kind}', 'x': p || {text}}} END"


def _local(lg: str, name: str, word: str, benefit: str, when: str) -> str:
    return _chunk({"ta": "tamil", "bn": "bengali", "mr": "marathi"}[lg], f"'{name} — ' || lang || ' {word}: ' || {benefit}", when + " AND lang <> ''")


#: Chunks of the nested records that the catalogue derives from documents.
_CHUNKS = ",\n  ".join([
    _chunk("overview", "src || ' — Overview: ' || de || ' Benefit: ' || be || ' Ministry: M Keywords: ' || CASE WHEN k % 3 = 2 THEN lang || ', ' || src ELSE '' END"),
    _chunk("benefit", "src || ' — Benefits and amount: ' || be || ' | हिंदी: ' || bh"),
    _chunk("eligibility", "src || ' — Eligibility criteria: Occupation: ' || lang || ', any | Gender: ' || CASE WHEN k % 2 = 0 THEN 'female' ELSE 'any' END || ' | BPL required: ' || CASE k % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'False' ELSE 'None' END || ' | Land ownership required: None | Age: ' || (k % 60) || '-None | Income max: ₹250000 | Aadhaar required: None | Other conditions: ' || lang"),
    _chunk("exclusion", "src || ' — Who CANNOT apply / exclusion criteria: ' || lang || '; x'", "k % 3 = 1"),
    _chunk("documents", "src || ' — Documents required (English): Aadhaar, ' || lang", "k % 2 = 0"),
    _chunk("hindi_docs", "hi || ' — आवश्यक दस्तावेज़: आधार'", "k % 4 = 0"),
    _chunk("tamil", "src || ' — Documents required (Tamil): ஆ'", "k % 8 = 0"), _chunk("bengali", "src || ' — Documents required (Bengali): আ'", "k % 9 = 0"), _chunk("marathi", "src || ' — Documents required (Marathi): आ'", "k % 10 = 0"),
    _chunk("apply", "src || ' — How to apply (steps): go; sign Apply URL: http://x'", "k % 2 = 1"), _chunk("hindi_apply", "hi || ' — आवेदन कैसे करें: जा'", "k % 6 = 1"),
    _chunk("hindi", "'नाम — वर्णन लाभ: ' || bh", "k % 3 = 0"),
    _local("ta", "பெயர்", "நன்மை", "be", "k % 5 = 0"), _local("bn", "নাম", "সুবিধা", "'সুবিধা'", "k % 7 = 0"), _local("mr", "नाव", "फायदा", "be", "k % 11 = 0"),
    _chunk("state_wise", "src || ' — State-wise benefit amounts (varies by state): Goa: Rs 5'", "k % 6 = 0"),
    _chunk("metadata", "src || ' — Helpline: 1800 | Apply at: http://x | Ministry: M | Launch year: ' || (2000 + k % 20) || ' | Processing time: '"),
    _chunk("renewal", "src || ' — Renewal information: Required: True | yearly'", "k % 4 = 0"), _chunk("keywords", "src || ' — Search keywords: ' || lang || ', ' || src", "k % 3 = 2"),
    _chunk("related", "src || ' — Related schemes: r1, r2'", "k % 5 = 1"), _chunk("mistakes", "src || ' — Common mistakes to avoid: m'", "k % 5 = 2"),
    _chunk("faq", "src || ' — FAQ: Q: Q A: A | हिंदी: प्र: प्र उ: उ'", "k % 3 = 0"),
])
_RECORDS = "r AS (SELECT doc_id AS k, lang, source AS src, substring(coalesce(text, ''), 1, 40) AS de, substring(coalesce(text, ''), 41, 30) AS be, CASE WHEN doc_id % 2 = 0 THEN 'लाभ' ELSE '' END AS bh, CASE WHEN doc_id % 3 = 0 THEN 'नाम' ELSE source END AS hi, 'passage: [SCHEME:d' || doc_id || '] ' AS p FROM documents)"

_CODES = " ".join(f"WHEN {_q(k)} THEN 'language:{v}'" for k, v in dialogue.LANGUAGE_WORDS.items())
_LOW = f"regexp_replace(lower(text), '^[{WS}]+|[{WS}]+$', '', 'g')"


def _in(words) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


def _intent() -> str:
    parts = " ".join(f"WHEN {_any('low', p)} THEN {_q(i)}" for i, p in dialogue.INTENT_WORDS.items())
    return f"CASE WHEN in_flow AND {_any('low', dialogue.YES_PARTS + dialogue.NO_PARTS)} THEN 'slot_fill_response' {parts} ELSE 'scheme_query' END"


def _amounts() -> str:
    units = "|".join(sorted(dialogue.UNITS, key=len, reverse=True))
    number, spoken = rf"(\d+(?:\.\d+)?)\s*({units})?\b", rf"\b({'|'.join(dialogue.NUMBER_WORDS)})\s+({units})\b"

    def pick(c: str, table: dict[str, int]) -> str:
        return f"CASE {c} " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in table.items()) + " END"

    return f"""WITH {MSG}, a AS (SELECT msg_id, text, regexp_extract(low, {_q(number)}, 1) AS n, regexp_extract(low, {_q(number)}, 2) AS u, regexp_extract(low, {_q(spoken)}, 1) AS w, regexp_extract(low, {_q(spoken)}, 2) AS wu
  FROM (SELECT msg_id, text, replace(lower(text), ',', '') AS low FROM msg))
SELECT msg_id, CASE WHEN regexp_matches(text, {_q(dialogue.NO_INCOME)}) THEN 0 WHEN n <> '' THEN TRY_CAST(round(TRY_CAST(n AS DOUBLE) * coalesce({pick('u', dialogue.UNITS)}, 1)) AS BIGINT)
  WHEN w <> '' THEN ({pick('w', dialogue.NUMBER_WORDS)}) * ({pick('wu', dialogue.UNITS)}) END::BIGINT AS amount FROM a"""


SQL: dict[str, str] = {
    "message_amounts": _amounts(),
    "text_forms": f"""SELECT conv_id, turn, replace(regexp_replace(text, '_(.+?)_', '<em>\\1</em>', 'g'), chr(10), '<br>') AS markup, regexp_replace(text, '[^\\x{{0}}-\\x{{FF}}]', '?', 'g') AS latin1, {_strip("text")} AS bare, role || ' turn text' AS words FROM conversations""",
    "language_precedence": """WITH e AS (SELECT event_id, user_id % 3 = 0 AND event_id % 10 <> 0 AS held, user_id % 3 = 0 AS chosen, event_id % 10 = 0 AS chooses, CASE WHEN event_type = 'click' THEN 'ta' ELSE 'en' END AS new FROM events)
SELECT event_id, CASE WHEN held THEN 'hi' ELSE new END AS lang, CASE WHEN held OR chooses THEN 'user_selected' ELSE 'auto_detected' END AS source FROM e""",
    "slot_questions": """WITH c AS (SELECT c_custkey, c_custkey % 4 AS o, c_custkey % 2 = 0 AS man, c_custkey % 3 = 0 AS landless, c_custkey % 5 = 0 AS ageless FROM customer),
n AS (SELECT *, CASE WHEN o = 0 THEN 'occupation' WHEN NOT man AND o <> 1 THEN 'gender' WHEN landless THEN 'has_land' WHEN ageless THEN 'age' END AS slot FROM c)
SELECT c_custkey, slot, concat_ws(',', CASE WHEN o = 0 THEN 'occupation' END, CASE WHEN NOT man THEN 'gender' END, CASE WHEN landless THEN 'has_land' END, CASE WHEN ageless THEN 'age' END) AS pending, coalesce(slot = 'has_land', false) AS yes_no, coalesce(slot = 'occupation', false) AS job,
  CASE slot WHEN 'occupation' THEN '👷 labourer' WHEN 'has_land' THEN '❌ no' ELSE '2' END AS reply, CASE slot WHEN 'occupation' THEN 'Q' || chr(10) || chr(10) || '1 or 2' WHEN 'has_land' THEN 'Q' || chr(10) || chr(10) || '1 yes 2 no' ELSE 'Q' END AS question FROM n""",
    "session_codec": """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id::VARCHAR AS id, CASE WHEN conv_id % 4 = 0 THEN 'ta' ELSE 'hi' END AS language, 'default' AS language_source, max(n)::INTEGER AS turn, least(max(n), 8)::INTEGER AS buffered, (min(turn) FILTER (WHERE back <= 8))::INTEGER AS first_turn, max(CASE WHEN role = 'user' THEN text END) FILTER (WHERE back = 1) AS last_said,
  CASE WHEN conv_id % 2 = 0 THEN conv_id % 90 END AS age, CASE WHEN conv_id % 3 = 0 THEN conv_id % 2 = 0 END AS has_land, CASE WHEN conv_id % 2 = 1 THEN 2 ELSE 9 END AS pending, conv_id::VARCHAR AS discussed, conv_id % 3 = 0 AS eligibility_done, false AS in_eligibility_flow FROM t GROUP BY conv_id""",
    "cache_aside": f"""WITH {USAGE}, {CACHE}, r AS (SELECT conv_id * 1000 + turn AS request_id, 'k' || (conv_id * 7 % 400)::VARCHAR AS cache_key FROM conversations WHERE role = 'user'), live AS (SELECT * FROM cache WHERE NOT expires_at < TIMESTAMP '2024-01-15 00:00:00')
SELECT request_id, r.cache_key, coalesce(live.response, upper('ask ' || r.cache_key)) AS response, live.cache_key IS NOT NULL AS hit FROM r LEFT JOIN live USING (cache_key)""",
    "usage_token_summary": f"""WITH {USAGE}, g AS (SELECT session_id, call_type, count(*) AS calls, coalesce(sum(cache_hit), 0)::BIGINT AS cache_hits, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens,
  sum(total_tokens)::BIGINT AS total_tokens, round(avg(latency_ms), 6) AS avg_latency_ms, count(latency_ms) AS n, list(latency_ms ORDER BY latency_ms) AS l FROM u GROUP BY ALL)
SELECT session_id, call_type, calls, cache_hits, prompt_tokens, completion_tokens, total_tokens, avg_latency_ms, CASE WHEN n >= 20 THEN round(l[least((n * 95) // 100, n - 1) + 1], 6) END AS p95_latency_ms FROM g""",
    "usage_p95_by_type": f"WITH {USAGE}, g AS (SELECT call_type, count(*) AS n, list(latency_ms ORDER BY latency_ms) AS l FROM u WHERE latency_ms IS NOT NULL GROUP BY 1) SELECT call_type, l[least((n * 95) // 100, n - 1) + 1] AS p95 FROM g WHERE n >= 20",
    "usage_grand_total": f"WITH {USAGE} SELECT coalesce(sum(coalesce(total_tokens, 0)), 0)::BIGINT AS grand_total_tokens FROM u",
    "usage_session_log": f"WITH {USAGE} SELECT id, session_id, epoch_us(ts) AS at_us, call_type, total_tokens, latency_ms, cache_hit FROM u WHERE session_id = '7' ORDER BY id",
    "usage_guardrail_totals": _totals(),
    "usage_guardrail_session": _totals("session_id = '7'"),
    "usage_guardrail_breakdown": f"WITH {USAGE} SELECT 'reason' AS section, reason AS item, count(*) AS n FROM u WHERE allowed = 0 GROUP BY reason UNION ALL SELECT 'stage', stage::VARCHAR, count(*) FROM u WHERE allowed = 0 GROUP BY stage",
    "usage_sketches": f"""WITH {USAGE}, p AS (SELECT call_type, matched, count(*) AS n FROM u WHERE allowed = 0 AND matched IS NOT NULL GROUP BY ALL),
t AS (SELECT call_type, string_agg(matched || ':' || n, ',' ORDER BY n DESC, matched) AS patterns FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY call_type ORDER BY n DESC, matched) <= 3) GROUP BY call_type)
SELECT u.call_type, count(*) AS events, count(latency_ms) AS n, true AS p95_near, true AS sessions_near, coalesce(any_value(t.patterns), '') AS patterns FROM u LEFT JOIN t ON t.call_type = u.call_type GROUP BY u.call_type""",
    "top_patterns": f"WITH {USAGE} SELECT matched AS pattern, count(*) AS n FROM u WHERE allowed = 0 AND matched IS NOT NULL GROUP BY 1 ORDER BY n DESC, pattern LIMIT 10",
    "usage_cache_by_call_type": f"{BY_TYPE} SELECT * FROM b",
    "usage_cache_totals": f"{BY_TYPE} SELECT coalesce(sum(calls), 0)::BIGINT AS total_calls, coalesce(sum(hits), 0)::BIGINT AS total_hits, coalesce(round(sum(hits) / sum(calls) * 100, 6), 0.0) AS hit_rate_pct, coalesce(sum(tokens_saved), 0)::BIGINT AS tokens_saved FROM b",
    "usage_sessions_recent": f"WITH {USAGE} SELECT session_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS events FROM u GROUP BY 1 ORDER BY max(ts) DESC, session_id LIMIT 50",
    "usage_live_searches": f"WITH {USAGE} SELECT id, epoch_us(ts) AS at_us, round(latency_ms / 100, 6) AS confidence, cache_hit AS tavily_fired, latency_ms FROM u WHERE session_id = '7' AND call_type = 'click' ORDER BY id",
    "cache_stats_rollup": f"WITH {USAGE}, {CACHE} SELECT call_type, count(*) AS entries, coalesce(sum(hit_count), 0)::BIGINT AS hits, grouping(call_type)::INTEGER AS is_total FROM cache GROUP BY ROLLUP (call_type)",
    "cache_purge": f"WITH {USAGE}, {CACHE} SELECT cache_key, epoch_us(expires_at) AS expires_us FROM cache WHERE NOT expires_at < TIMESTAMP '2024-01-15 00:00:00'",
    "upsert_keep_hits": f"""WITH {USAGE}, {CACHE}, new AS (SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'k' ELSE 'new' END || session_id AS cache_key FROM u WHERE user_id % 3 = 0 AND user_id % 9 <> 0),
now AS (SELECT TIMESTAMP '2024-03-01 00:00:00' AS now)
SELECT new.cache_key, 'slot_question' AS call_type, 'again' AS response, 'hi' AS lang, epoch_us(now) AS created_us, epoch_us(now + INTERVAL 7 DAY) AS expires_us, coalesce(hit_count, 0) AS hit_count FROM new LEFT JOIN cache USING (cache_key), now
UNION ALL SELECT cache_key, call_type, response, lang, epoch_us(created_at), epoch_us(expires_at), hit_count FROM cache WHERE cache_key NOT IN (SELECT cache_key FROM new)""",
    "cache_hits_applied": f"WITH {USAGE}, {CACHE} SELECT cache_key, hit_count + (SELECT count(*) FROM u WHERE cache_hit = 1 AND 'k' || session_id = cache_key) AS hit_count FROM cache",
    "cache_replay_ttl": """WITH RECURSIVE e AS (SELECT event_id, event_type || ':' || user_id AS cache_key, epoch_us(ts) AS at_us, CASE event_type WHEN 'view' THEN 604800 WHEN 'click' THEN 86400 WHEN 'error' THEN 21600 ELSE 3600 END * 1000000::BIGINT AS ttl FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY at_us, event_id) AS i FROM e),
r AS (SELECT cache_key, i, event_id, at_us, 0 AS hit, at_us + ttl AS until FROM n WHERE i = 1
  UNION ALL SELECT n.cache_key, n.i, n.event_id, n.at_us, (n.at_us <= r.until)::INTEGER, CASE WHEN n.at_us <= r.until THEN r.until ELSE n.at_us + n.ttl END FROM r JOIN n ON n.cache_key = r.cache_key AND n.i = r.i + 1)
SELECT cache_key, event_id, at_us, hit FROM r""",
    "tokenize_tf": f"WITH {TF} SELECT * FROM tf",
    "term_idf": f"WITH {TF}, {STATS}, d AS (SELECT term, count(*) AS df FROM tf GROUP BY term) SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM d, st",
    "corpus_stats": f"WITH {STATS} SELECT n, round(avgdl, 6) AS avgdl FROM st",
    "inverted_lists": f"WITH {TF} SELECT term, chunk_id // 10000 AS block, string_agg(chunk_id::VARCHAR, ',' ORDER BY chunk_id) AS chunk_list FROM tf GROUP BY ALL",
    "scheme_chunks": f"""WITH {_RECORDS}, l AS (SELECT k, list_filter([{_CHUNKS}], lambda c: c IS NOT NULL) AS l FROM r),
u AS (SELECT k, unnest(l) AS c, unnest(range(len(l)))::INTEGER AS pos FROM l) SELECT k AS doc_id, pos, c.t AS chunk_type, md5(c.x) AS digest FROM u""",
    "scheme_checklist": f"""WITH {_RECORDS}, d AS (SELECT *, CASE WHEN k % 4 = 0 THEN ['आधार'] WHEN k % 2 = 0 THEN ['Aadhaar', lang] ELSE [] END AS docs FROM r WHERE k % 7 = 1)
SELECT 'd' || k AS id, unnest(range(1, len(docs) + 1))::INTEGER AS pos, unnest(docs) AS document, be AS benefit, CASE WHEN k % 2 = 1 THEN 'go;sign' END AS steps, '1800' AS helpline FROM d""",
    "dedup_md5": "SELECT min(doc_id) AS chunk_id, md5(text) AS digest FROM documents GROUP BY md5(text)",
    "dedup_runs": """WITH d AS (SELECT doc_id, (doc_id % 3)::INTEGER AS run, md5(text) AS digest FROM documents),
f AS (SELECT digest, min(run) AS run FROM d GROUP BY digest) SELECT run, min(doc_id) AS chunk_id, digest FROM d JOIN f USING (digest, run) WHERE digest IS NOT NULL GROUP BY run, digest""",
    "chunk_type_histogram": "SELECT lang AS chunk_type, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, chunk_type",
    "chunk_ids": "WITH k AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(text)) SELECT row_number() OVER (ORDER BY source, doc_id) - 1 AS chunk_id, doc_id FROM k JOIN documents USING (doc_id)",
    "html_to_text": f"SELECT page_id, {_html()} AS text FROM pages",
    "page_content": f"WITH {_AREA} SELECT page_id, length(area)::INTEGER AS n_area, md5(left({_html('area')}, 20000)) AS digest FROM h",
    "page_timeouts": """WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS host FROM pages)
SELECT page_id, CASE WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN 45000 WHEN host = 'org' OR ends_with(host, '.org') THEN 40000 ELSE 25000 END AS timeout_ms FROM h""",
    "cache_keys": f"""SELECT conv_id, turn, 'scheme_answer:' || left(sha256('scheme_answer|' || regexp_replace(regexp_replace(lower({_strip("text")}), '[{WS}]+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_{WS}\\x{{0900}}-\\x{{097F}}\\x{{0980}}-\\x{{09FF}}\\x{{0B80}}-\\x{{0BFF}}]', '', 'g') || '|en|' || role), 24) AS cache_key FROM conversations""",
    "guardrail_cascade": f"WITH {CASCADE} SELECT msg_id, reason IS NULL AS allowed, reason, CASE WHEN reason IS NOT NULL THEN 1 END AS stage, CASE reason WHEN 'injection' THEN inj WHEN 'abuse' THEN abu WHEN 'offtopic' THEN off END AS matched FROM r",
    "guardrail_undecided": f"WITH {CASCADE} SELECT msg_id FROM h WHERE NOT (safe OR (in_flow AND nw <= 6) OR inj IS NOT NULL OR abu IS NOT NULL OR off IS NOT NULL OR topic OR nw <= 3)",
    "detect_language_script": f"""WITH {MSG}, s AS (SELECT msg_id, text, {_COUNTS} FROM m), t AS (SELECT *, ta + bn + hi + other AS n, greatest(ta, bn, hi) AS top FROM s)
SELECT msg_id, CASE WHEN n = 0 OR (n < 3 AND latin > 3 * n) THEN NULL WHEN top = 0 THEN 'en' WHEN ta = top THEN 'ta' WHEN bn = top THEN 'bn' WHEN list_has_any(regexp_extract_all(text, '[^{WS}]+'), {_MARKERS}) THEN 'mr' ELSE 'hi' END AS lang FROM t""",
    "message_classify": f"""WITH {MSG}, s AS (SELECT *, {_COUNTS} FROM m), t AS (SELECT *, ta + bn + hi + other AS n, greatest(ta, bn, hi) AS top FROM s),
r AS (SELECT msg_id, text, in_flow, (msg_id % 5 + 5) % 5 AS k, CASE WHEN n = 0 OR (n < 3 AND latin > 3 * n) THEN NULL WHEN top = 0 THEN 'en' WHEN ta = top THEN 'ta' WHEN bn = top THEN 'bn' WHEN list_has_any(regexp_extract_all(text, '[^{WS}]+'), {_MARKERS}) THEN 'mr' ELSE 'hi' END AS script,
  CASE WHEN msg_id % 7 = 0 THEN 'bn' END AS known, {_LOW} AS low FROM t),
i AS (SELECT *, ['has_land', 'age', 'state'][(msg_id % 3 + 3) % 3 + 1] AS slot, {_intent()} AS rule FROM r)
SELECT msg_id, coalesce(script, known, CASE k WHEN 0 THEN 'ta' WHEN 3 THEN 'en' ELSE 'hi' END) AS language, CASE WHEN script IS NOT NULL THEN 'script_detected' WHEN known IS NOT NULL THEN 'session' ELSE 'auto_detected' END AS language_source,
  CASE k WHEN 0 THEN 'document_query' WHEN 3 THEN 'general_info' ELSE rule END AS intent, CASE k WHEN 0 THEN 'age=30,has_land=true' ELSE '' END AS facts, CASE k WHEN 0 THEN 'nrega' END AS scheme_mentioned,
  md5(CASE k WHEN 0 THEN 'q' WHEN 3 THEN NULL ELSE text END) AS query, slot, CASE WHEN msg_id % 2 = 0 THEN 'true' WHEN slot = 'age' THEN '42' END AS value FROM i""",
    "intent_fallback": f"""WITH {MSG}, i AS (SELECT msg_id, {_intent()} AS intent FROM (SELECT msg_id, in_flow, {_LOW} AS low FROM m))
SELECT msg_id, intent, CASE WHEN intent = 'eligibility_check' THEN 'start_flow' WHEN intent IN ('scheme_query', 'document_query', 'how_to_apply') THEN 'retrieval' ELSE 'general' END AS route FROM i""",
    "button_replies": f"""WITH {MSG}, l AS (SELECT *, {_LOW} AS low, CASE low {_BUTTONS} END AS job FROM m),
b AS (SELECT *, CASE WHEN msg_id % 2 = 0 THEN 'is_bpl' ELSE 'has_land' END AS open, CASE WHEN low IN {_in(YES_WORDS)} THEN 'true' WHEN low IN {_in(NO_WORDS)} THEN 'false' END AS word FROM l)
SELECT msg_id, CASE WHEN job IS NOT NULL THEN 'occupation' WHEN in_flow AND word IS NOT NULL THEN open END AS slot, CASE WHEN job IS NOT NULL THEN job WHEN in_flow THEN word END AS value, CASE WHEN job = 'woman_hoh' THEN 'female' END AS gender,
  CASE WHEN low IN ('true', 'yes', '1') THEN true WHEN low IN ('false', 'no', '0') THEN false END AS truth, md5('age=30,state=' || coalesce(nullif(nullif(substring(text, 1, 4), 'hell'), ''), 'Goa')) AS merged FROM b""",
    "language_codes": f"""WITH c AS (SELECT doc_id, lang, ['en', 'ta', 'hi', 'bn', 'hi', 'hi', 'mr'][doc_id % 7 + 1] AS code FROM documents)
SELECT doc_id, code, CASE code {_NAMES} END AS name, CASE WHEN doc_id % 2 = 0 THEN CASE lang {_NAMES} ELSE 'Hindi (हिंदी)' END END AS other FROM c""",
    "audit_texts": "SELECT doc_id, md5(CASE WHEN doc_id % 5 < 2 OR trim(coalesce(text, '')) = '' THEN 'EMPTY' ELSE text END) AS digest, doc_id % 5 < 2 OR trim(coalesce(text, '')) = '' OR text = 'EMPTY' AS blank FROM documents",
    "search_sections": """WITH h AS (SELECT source AS scheme_id, doc_id % 3 AS q, lang, coalesce(text, '') AS text, row_number() OVER (PARTITION BY source, doc_id % 3 ORDER BY doc_id) AS rank FROM documents),
s AS (SELECT scheme_id, q, '=== Query: q' || q || ' ===' || chr(10) || string_agg('[' || coalesce(lang, '') || '] ' || substring(text, 1, 1200), chr(10) ORDER BY rank) AS s FROM h WHERE rank <= 8 GROUP BY scheme_id, q),
t AS (SELECT scheme_id, string_agg(s, chr(10) || chr(10) ORDER BY q) AS text FROM s GROUP BY scheme_id) SELECT scheme_id, length(text)::INTEGER AS n_chars, md5(text) AS digest FROM t""",
    "hydrated_hits": f"""WITH {_RECORDS}, h AS (SELECT k % 10 AS query_id, k // 10 AS place, k FROM r WHERE k % 6 = 0),
d AS (SELECT *, CASE WHEN k % 4 = 0 THEN 1 ELSE 2 END AS docs FROM h)
SELECT query_id, count(*) AS n, sum(docs)::BIGINT AS n_documents, count(*) AS n_states, count(*) AS n_blocks, count(*) AS n_amounts FROM d GROUP BY query_id""",
    # What was damaged reads as what it was.
    "json_repair": "SELECT conv_id, turn, conv_id AS found, 2::INTEGER AS second FROM conversations",
    "slot_dialogue": f"""WITH RECURSIVE m AS (SELECT conv_id, turn, lower({_strip("said")}) AS low, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i
  FROM (SELECT *, CASE turn WHEN 0 THEN '👩 woman hoh' WHEN 2 THEN 'yes' WHEN 4 THEN 'nahi' ELSE coalesce(text, '') END AS said FROM conversations WHERE role = 'user')),
j AS (SELECT *, CASE low {_BUTTONS} END AS job, low IN {_in(YES_WORDS | NO_WORDS)} AS word FROM m),
r AS (SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS turn, 0::BIGINT AS asked, false AS filled, '000000000' AS held FROM (SELECT DISTINCT conv_id FROM m)
  UNION ALL SELECT conv_id, i, turn, asked, spot > 0, CASE WHEN job = 'woman_hoh' THEN '11' || held[3:] WHEN spot > 0 THEN held[:spot - 1] || '1' || held[spot + 1:] ELSE held END FROM (
    SELECT *, CASE WHEN job IS NOT NULL THEN 1 WHEN asked = 0 OR low = '' THEN 0 WHEN asked BETWEEN 3 AND 6 AND NOT word THEN 0 ELSE asked END AS spot FROM (
      SELECT j.conv_id, j.i, j.turn, low, job, word, held, strpos(held, '0') AS asked FROM r JOIN j ON j.conv_id = r.conv_id AND j.i = r.i + 1)))
SELECT conv_id, turn, {_SLOTS}[nullif(asked, 0)] AS asked, filled, {_SLOTS}[nullif(strpos(held, '0'), 0)] AS next_slot FROM r WHERE i > 0""",
    "usage_log_rows": f"WITH {USAGE} SELECT id, session_id, epoch_us(ts) AS at_us, call_type, least(3 * (id % 200), 300)::INTEGER AS n_query, NULL::VARCHAR AS model, true AS grown FROM u",
    "guardrail_verdicts": f"""WITH {CASCADE}, v AS (SELECT *, reason IS NULL AND msg_id % 3 = 0 AND NOT (safe OR (in_flow AND nw <= 6) OR topic OR nw <= 3) AS refused, ['en', 'hi', 'mr', 'bn', 'ta', 'en'][(msg_id % 6 + 6) % 6 + 1] AS lang FROM r)
SELECT msg_id, reason IS NULL AND NOT refused AS allowed, CASE WHEN refused THEN 'offtopic' ELSE reason END AS reason, CASE WHEN refused THEN 2 WHEN reason IS NOT NULL THEN 1 END AS stage, md5(CASE {_REFUSALS} END) AS message FROM v""",
    "model_calls": "SELECT conv_id, turn, md5(text) AS reply, 1 AS model, NULL::VARCHAR AS error FROM conversations",
    "fallback_hits": "SELECT doc_id, lang, 'en' AS asked FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, lang, 'none' FROM documents",
    "message_commands": f"""WITH {MSG}, l AS (SELECT msg_id, {_LOW} AS low FROM m)
SELECT msg_id, CASE WHEN low IN {_in(dialogue.RESET_WORDS)} THEN 'reset' ELSE coalesce(CASE low {_CODES} END, CASE WHEN low IN {_in(dialogue.ELIGIBILITY_WORDS)} THEN 'eligibility' ELSE 'run' END) END AS command, {_any("low", dialogue.QUESTION_SIGNS)} AS question FROM l""",
    "bm25_index_topk": f"WITH {_bm25()} SELECT query_id, rank, chunk_id, score FROM sparse",
    "bm25_topk": f"WITH {_bm25()} SELECT query_id, rank, chunk_id, score FROM sparse",
    "dense_topk": f"WITH {DENSE} SELECT query_id, rank, chunk_id, score FROM dense",
    "hybrid_rrf": f"WITH {FUSED} SELECT query_id, chunk_id, rrf, dense_rank, sparse_rank FROM fused",
    "hybrid_search_entities": f"""WITH {FUSED}, one AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY query_id, entity ORDER BY rrf DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, chunk_id) = 1),
p AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, chunk_id)::INTEGER AS place, entity, chunk_id, rrf FROM one QUALIFY place <= 4),
cf AS (SELECT query_id, max(score) AS confidence FROM dense GROUP BY 1)
SELECT p.*, confidence, CASE WHEN confidence >= 0.65 THEN 'none' WHEN confidence >= 0.5 THEN 'enhance' ELSE 'live' END AS route FROM p JOIN cf USING (query_id)""",
    "routing_confidence": "SELECT CASE WHEN value / 100 >= 0.65 THEN 'none' WHEN value / 100 >= 0.5 THEN 'enhance' ELSE 'live' END AS route, count(*) AS n FROM events GROUP BY 1",
    "quality_issues": f"""WITH d AS (SELECT *, len(regexp_extract_all(text, '[^{WS}]+')) AS n FROM documents)
SELECT doc_id, concat_ws('|', CASE WHEN least(n, doc_id % 12) < 8 THEN 'documents_en < 8' END, CASE WHEN least(n, doc_id % 10) < 8 THEN 'apply_steps_en < 8' END, CASE WHEN doc_id % 5 = 0 OR source = '' THEN 'helpline missing' END,
  CASE WHEN least(length(text), 150) < 100 THEN 'benefit_en too short' END, CASE WHEN lang <> 'fr' THEN 'name_hi missing' END, CASE WHEN lang = '' THEN 'name_ta missing' END, CASE WHEN length(text) < 150 THEN 'description_en too short' END,
  CASE WHEN n = 0 THEN 'exclusion_criteria missing' END, CASE WHEN least(n, 20) < 15 THEN 'keywords < 15' END, CASE WHEN doc_id % 4 = 0 THEN 'eligibility_rules missing' END, CASE WHEN least(n, doc_id % 7) = 0 THEN 'faq missing' END,
  CASE WHEN least(n, doc_id % 7) < 5 THEN 'faq < 5 items' END, CASE WHEN n = 0 THEN 'documents_hi missing' END, CASE WHEN least(n, doc_id % 2) = 0 THEN 'apply_steps_hi missing' END) AS issues FROM d""",
    "eligibility_match": """SELECT c_custkey AS profile_id, n_name AS id FROM (SELECT *, floor(c_acctbal * 100) AS income, 18 + c_custkey % 60 AS age, lower(c_mktsegment) AS job FROM customer) c, (SELECT *, n_nationkey AS k FROM nation) n
WHERE (k % 5 = 0 OR job = (['automobile', 'building', 'furniture', 'household', 'machinery'])[k % 5 + 1])
  AND (k % 3 <> 0 OR c_custkey % 2 = 0) AND NOT (k % 4 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 4 <> 0) AND NOT (k % 6 = 0 AND c_custkey % 3 <> 0) AND k % 11 <> 10
  AND (k % 2 <> 0 OR age >= k + 18) AND (k % 7 <> 0 OR age <= 60) AND (k % 3 = 2 OR income <= CASE WHEN k % 3 = 0 THEN 250000 ELSE 600000 END)""",
    "eligible_semi": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "pending_anti": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')",
    "overlay_merge": """WITH n AS (SELECT o_custkey AS c_custkey, max(o_orderpriority) FILTER (WHERE o_orderstatus = 'F') AS tag, max(o_totalprice) AS amount FROM orders GROUP BY 1)
SELECT c_custkey, c_name AS name, coalesce(n.tag, c_mktsegment) AS tag, coalesce(n.amount, c_acctbal) AS amount FROM customer FULL JOIN n USING (c_custkey)""",
    "longer_list_wins": f"SELECT doc_id, greatest(least(n, doc_id % 12), least(n, doc_id % 10))::INTEGER AS n FROM (SELECT doc_id, len(regexp_extract_all(text, '[^{WS}]+')) AS n FROM documents)",
    "run_outcomes": f"WITH s AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'skipped' WHEN length({_html()}) < 1500 THEN 'failed' ELSE 'success' END AS status FROM pages) SELECT status, count(*) OVER (PARTITION BY status) AS n, page_id AS key FROM s",
    "history_last_k": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
    "history_text": """WITH t AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4)
SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Bot: ' ELSE 'System: ' END || coalesce(text, ''), chr(10) ORDER BY turn) AS history FROM t GROUP BY conv_id""",
    "entity_recent": """WITH RECURSIVE m AS (SELECT o_custkey, p_brand, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
r AS (SELECT o_custkey, i, [p_brand] AS recent FROM m WHERE i = 1
  UNION ALL SELECT m.o_custkey, m.i, CASE WHEN list_contains(recent, p_brand) THEN recent ELSE list_prepend(p_brand, recent)[1:5] END FROM r JOIN m ON m.o_custkey = r.o_custkey AND m.i = r.i + 1)
SELECT o_custkey, array_to_string(recent, ',') AS recent FROM r QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY i DESC) = 1""",
    "carry_forward": """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS last_spent, last_value(CASE WHEN event_type = 'error' THEN props END IGNORE NULLS) OVER w AS last_fault
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "keyed_turns": "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations WHERE conv_id % 9 <> 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "summary_turns": "SELECT conv_id, turn FROM conversations WHERE turn > 0 AND turn % 4 = 0",
    "events_windowed": "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "session_windows": """WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM l)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS events FROM s GROUP BY user_id, g""",
}
