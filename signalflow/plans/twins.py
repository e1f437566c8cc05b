"""DuckDB SQL of the registered queries, written apart from the Spark code: tables first, then one statement per query."""

from __future__ import annotations

from ..sources import config as C
from ..sources.adapters import ACTIONS, SOURCE_TYPES

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _any(text: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


def _squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'))"


def _escaped(x: str) -> str:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{sign}', '{name}')"
    return x


CANDIDATES = rf"""
flat AS (SELECT *, {_squeeze('text')} AS f, coalesce(try_cast(regexp_extract(source, '(\d+)', 1) AS INTEGER), 0) AS no FROM documents),
cand0 AS (
  SELECT doc_id AS ordinal, source AS source_name, 'https://' || source || '.example/feed' AS source_url, 30 + (no * 13) % 71 AS source_trust,
    30 + (no * 13) % 71 >= 80 AS source_is_primary,
    regexp_replace(substring(CASE WHEN regexp_extract(f, '^(.*?[.!?])(?:\s|$)', 1) <> '' THEN regexp_extract(f, '^(.*?[.!?])(?:\s|$)', 1) ELSE f END, 1, 180), '^[ :-]+|[ :-]+$', '', 'g') AS title,
    'https://news.example/' || (doc_id - CASE WHEN doc_id % 20 = 19 THEN 1 ELSE 0 END) AS canonical_url,
    {_squeeze("regexp_replace(text, '<[^>]+>', ' ', 'g')")} AS summary, text,
    CASE WHEN doc_id % 97 <> 0 THEN {NOW} - to_hours(CAST(doc_id * 37 % 1440 AS INTEGER)) END AS published_at,
    {_list(SOURCE_TYPES)}[CAST(doc_id % 5 + 1 AS INTEGER)] AS source_type, no
  FROM flat),
cand1 AS (SELECT *, {_squeeze(r"regexp_replace(lower(title), '[^\p{L}\p{N}_\s]', ' ', 'g')")} AS normalized_title FROM cand0),
cand AS (
  SELECT *, sha256(CASE WHEN summary <> '' THEN lower(summary) ELSE normalized_title END) AS content_hash,
    replace(normalized_title || ' ' || lower(summary), '_', ' ') AS body FROM cand1)"""

_SCORE_SUM = " + ".join(f"CASE WHEN contains(body, '{t}') THEN CAST({w} AS DECIMAL(10,4)) ELSE CAST(0 AS DECIMAL(10,4)) END" for t, w in C.active_terms())
SCORED = rf"""
kw AS (SELECT *, CAST(least(100, round_even(CAST(({_SCORE_SUM}) * 30 AS DECIMAL(18,4))::DOUBLE, 0)) AS INTEGER) AS keyword_score FROM cand),
pre AS (
  SELECT *, (keyword_score < 20 AND source_is_primary AND source_trust >= 95 AND {_any('body', C.BROAD_SIGNALS)}) AS primary_bypass,
    CASE WHEN normalized_title = '' THEN 'invalid' WHEN published_at IS NULL THEN 'invalid' WHEN published_at < {NOW} - INTERVAL 720 HOUR THEN 'too_old'
      WHEN source_trust < 40 THEN 'low_trust'
      WHEN source_type = 'web_changelog' AND {_any('body', C.LOW_VALUE_SIGNALS)} THEN 'low_relevance'
      WHEN keyword_score < 20 AND NOT (source_type = 'web_articles' AND {_any('body', C.ARTICLE_SIGNALS)})
        AND NOT (source_is_primary AND source_trust >= 95 AND {_any('body', C.BROAD_SIGNALS)}) THEN 'low_relevance' END AS reason
  FROM kw)"""

_A = _list(ACTIONS)
TABLES = rf"""
art AS (
  SELECT ordinal AS article_id, sha256(normalized_title) AS event_id, source_name AS source_id, 'https://news.example/' || ordinal AS canonical_url, title,
    normalized_title, published_at, {NOW} - to_hours(CAST(ordinal * 11 % 480 AS INTEGER)) AS discovered_at, source_trust, source_is_primary, source_type
  FROM cand),
ev0 AS (SELECT event_id, min(article_id) AS k, arg_min(title, article_id) AS title, max(article_id) AS last FROM art GROUP BY event_id),
ev AS (
  SELECT event_id, k, title, CASE WHEN k % 9 = 8 THEN 'discarded' WHEN k % 4 = 3 THEN 'pending' ELSE 'analyzed' END AS status,
    CASE WHEN k % 9 = 8 THEN CASE WHEN k % 2 = 0 THEN 'analysis_failed' ELSE 'low_relevance' END END AS event_discard_reason,
    (k * 7 % 101) / 100.0::DOUBLE AS confidence, CASE WHEN k % 23 = 0 THEN 0.95::DOUBLE ELSE (k * 3 % 50) / 100.0::DOUBLE END AS hype,
    k % 3 = 0 AS primary_source_verified, {NOW} - to_hours(CAST(k * 31 % 480 + 1 AS INTEGER)) AS first_seen_at,
    {NOW} - to_hours(CAST(last * 17 % 240 AS INTEGER)) AS last_seen_at, CASE WHEN k % 9 <> 8 THEN CAST(k % 360 AS INTEGER) END AS analyzed_run_no
  FROM ev0),
prof(profile_id, slug, name, enabled) AS (VALUES (1, 'finance', 'Finance', true), (2, 'teaching', 'Teaching', true), (3, 'research', 'Research', true), (4, 'archive', 'Archive', false)),
sc AS (
  SELECT event_id, k, profile_id, slug, name, enabled, CAST((k * 13 + profile_id * 29) % 101 AS INTEGER) AS relevance_score,
    CAST((k * 17 + profile_id * 31) % 101 AS INTEGER) AS alert_score, CAST((k * 19 + profile_id * 37) % 101 AS INTEGER) AS actionability_score,
    CASE WHEN (k + profile_id) % 6 < 5 THEN {_A}[CAST((k + profile_id) % 6 + 1 AS INTEGER)] END AS suggested_action
  FROM ev, prof WHERE status <> 'pending'),
mx AS (SELECT event_id, max(alert_score) AS max_alert, max(relevance_score) AS max_relevance, max(actionability_score) AS max_actionability FROM sc WHERE enabled GROUP BY event_id),
src AS (
  SELECT DISTINCT source_name AS source_id, source_name AS name, {_list(SOURCE_TYPES)}[no % 5 + 1] AS source_type, source_url AS base_url, source_trust AS trust_level,
    source_is_primary AS is_primary, no % 7 <> 6 AS enabled FROM cand)"""

LATEST = """
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY published_at DESC NULLS LAST, discovered_at DESC, article_id DESC) AS r FROM art) WHERE r = 1)"""

UPGRADES = """
up0 AS (
  SELECT a.*, e.status, e.event_discard_reason, e.confidence, e.k,
    row_number() OVER w AS n,
    max(CASE WHEN a.source_is_primary THEN 1 ELSE 0 END) OVER b AS any_primary,
    max(CASE WHEN a.source_is_primary THEN 1000 ELSE 0 END + a.source_trust) OVER b AS best
  FROM art a JOIN ev e USING (event_id)
  WINDOW w AS (PARTITION BY event_id ORDER BY article_id), b AS (PARTITION BY event_id ORDER BY article_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
up AS (
  SELECT *, CASE WHEN n = 1 THEN NULL WHEN status = 'pending' THEN 'pending_event_new_evidence'
    WHEN event_discard_reason = 'analysis_failed' AND source_is_primary THEN 'retry_failed_with_primary'
    WHEN source_is_primary AND any_primary = 0 THEN 'primary_source_discovered'
    WHEN source_trust >= best % 1000 + 10 THEN 'higher_trust_source'
    WHEN confidence < 0.6 AND (source_is_primary OR source_trust > best % 1000) THEN 'low_confidence_better_evidence' END AS upgrade_reason
  FROM up0),
dec0 AS (
  SELECT p.*, u.event_id, u.upgrade_reason, u.status, u.k, min(p.ordinal) OVER (PARTITION BY p.canonical_url) AS first_of_url FROM pre p JOIN up u ON u.article_id = p.ordinal),
dec AS (
  SELECT *, CAST(ordinal % 360 AS INTEGER) AS run_no, CASE WHEN published_at IS NOT NULL AND published_at < TIMESTAMP '2024-01-01 00:00:00' THEN 'too_old' WHEN published_at < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 720 HOUR THEN 'too_old'
    WHEN ordinal > first_of_url THEN CASE WHEN status = 'pending' THEN 'pending_reanalysis' ELSE 'already_seen' END
    WHEN ordinal <> k THEN CASE WHEN upgrade_reason IS NOT NULL THEN 'evidence_reanalysis' ELSE 'duplicate' END
    WHEN reason IS NOT NULL THEN reason ELSE 'analyze' END AS decision
  FROM dec0)"""

OUTCOMES = """
outc AS (
  SELECT e.*, m.max_alert, CASE WHEN e.k % 5 = 0 THEN 80 ELSE 90 END AS threshold FROM ev e JOIN mx m USING (event_id)),
outs AS (SELECT *, hype >= 0.9 AND max_alert < threshold AS high_hype, max_alert >= threshold AND confidence >= 0.75 AS alerts FROM outc)"""

RUNS = """
run0 AS (
  SELECT CAST(floor(epoch(ts) / 7200) AS BIGINT) AS run_no, count(*) AS collected, count(*) FILTER (WHERE event_type = 'purchase') AS analyzed,
    count(*) FILTER (WHERE event_type = 'error') AS errors, CAST(sum(coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS input_tokens,
    CAST(sum(coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) % 7) AS BIGINT) AS output_tokens, min(ts) AS started_at, max(ts) AS last_at
  FROM events GROUP BY 1),
run AS (
  SELECT *, CASE WHEN run_no % 50 <> 7 THEN last_at END AS finished_at,
    CASE WHEN run_no % 50 = 7 THEN 'running' WHEN errors > 8 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM run0)"""

HEALTH = f"""
h0 AS (
  SELECT user_id, CASE WHEN user_id % 50 = 0 THEN 503 ELSE 200 END AS http, CASE WHEN user_id % 31 = 0 THEN 0 ELSE count(*) END AS items_found,
    CASE WHEN user_id % 7 = 0 THEN max(ts) - INTERVAL 60 DAY ELSE max(ts) END AS latest_item_at, user_id % 29 <> 0 AS valid FROM events GROUP BY user_id),
h AS (
  SELECT 'src' || user_id AS source_id, items_found, latest_item_at, CASE WHEN http <> 200 THEN 'HTTP_ERROR' WHEN NOT valid THEN 'PARSE_ERROR' WHEN items_found = 0 THEN 'EMPTY'
    WHEN latest_item_at < {NOW} - INTERVAL 30 DAY THEN 'STALE' ELSE 'OK' END AS status FROM h0)"""

SUMMARY = """
hs AS (
  SELECT count(*) AS total, count(*) FILTER (WHERE h.status = 'OK') AS healthy, count(*) FILTER (WHERE h.status = 'STALE') AS stale,
    count(*) FILTER (WHERE h.status NOT IN ('OK', 'STALE')) AS error, count(*) FILTER (WHERE h.status IS NULL) AS unknown
  FROM src LEFT JOIN h USING (source_id) WHERE src.enabled)"""

DIGEST = f"""
per AS (
  SELECT event_id, max(coalesce(published_at, discovered_at)) AS recency_at FROM art
  WHERE coalesce(published_at, discovered_at) BETWEEN {NOW} - INTERVAL 240 HOUR AND {NOW} GROUP BY event_id),
top AS (
  SELECT e.event_id, e.k, e.title, m.max_alert, m.max_relevance, m.max_actionability, p.recency_at, e.k % 6 = 0 AS alerted_before,
    CASE WHEN max_alert >= 90 THEN 'CRITICAL' WHEN max_alert >= 75 THEN 'RELEVANT' WHEN max_alert >= 60 THEN 'INTERESTING' ELSE 'IGNORE' END AS category
  FROM ev e JOIN per p USING (event_id) JOIN mx m USING (event_id) WHERE m.max_alert >= 60
  ORDER BY max_alert DESC, max_relevance DESC, max_actionability DESC, recency_at DESC, event_id LIMIT 10)"""

_LABELS = "CASE suggested_action " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.ACTION_LABELS.items()) + " ELSE suggested_action END"


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def _ago(x: str) -> str:
    s = f"greatest(0, CAST(epoch({NOW}) - epoch({x}) AS BIGINT))"
    return f"CASE WHEN {x} IS NULL THEN '—' WHEN {s} < 60 THEN 'just now' WHEN {s} < 3600 THEN ({s} // 60) || ' min ago' WHEN {s} < 86400 THEN ({s} // 3600) || 'h ago' ELSE ({s} // 86400) || 'd ago' END"


_E = lambda x: f"CAST(floor(epoch({x})) AS BIGINT)"
_ALL = (CANDIDATES, TABLES)

SQL: dict[str, str] = {
    "canonical_urls": r"""
WITH u AS (SELECT page_id, regexp_extract(trim(url), '^([^#]*)', 1) AS b FROM pages),
q AS (
  SELECT page_id, b, lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract(b, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)) AS host,
    regexp_replace(regexp_extract(b, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_filter(string_split(CASE WHEN contains(b, '?') THEN substring(b, strpos(b, '?') + 1) ELSE '' END, '&'),
      lambda p: p <> '' AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_') AND lower(split_part(p, '=', 1)) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref', 'source')) AS kept FROM u)
SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url FROM q""",
    "normalized_titles": _with(CANDIDATES) + "SELECT ordinal, normalized_title FROM cand",
    # Each pair of titles that lengths and numbers of letters allow, and its common subsequence letter by letter: a row of lengths for the
    # first i letters of one title and each prefix of the other; places hold where a letter stands last up to there.
    "similar_title_pairs": _with(CANDIDATES).replace("WITH ", "WITH RECURSIVE ", 1) + """, k AS (SELECT normalized_title AS t, min(ordinal) AS id, CAST(length(normalized_title) AS INTEGER) AS n FROM cand WHERE normalized_title IS NOT NULL GROUP BY 1 HAVING length(t) > 1),
letters AS (SELECT id, c, count(*) AS m FROM (SELECT id, unnest(string_split(t, '')) AS c FROM k) GROUP BY 1, 2),
able AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b FROM letters x JOIN letters y ON x.c = y.c AND x.id < y.id JOIN k a ON a.id = x.id JOIN k b ON b.id = y.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 2 * sum(least(x.m, y.m)) >= 0.88 * (a.n + b.n)),
places AS MATERIALIZED (
  SELECT id, c, list_transform(range(1, n + 1), lambda j: CASE WHEN contains(left(t, j), c) THEN j + 1 - strpos(reverse(left(t, j)), c) ELSE 0 END) AS last
  FROM letters JOIN k USING (id) WHERE id IN (SELECT b FROM able)),
steps AS (
  SELECT a, b, 0 AS i, list_transform(range(n), lambda j: CAST(0 AS BIGINT)) AS row FROM able JOIN k ON k.id = b
  UNION ALL
  SELECT s.a, s.b, s.i + 1, CASE WHEN p.c IS NULL THEN s.row ELSE list_transform(range(1, len(s.row) + 1),
           lambda j: CASE WHEN p.last[j] = 0 THEN s.row[j] ELSE greatest(s.row[j], CASE WHEN p.last[j] = 1 THEN 0 ELSE s.row[p.last[j] - 1] END + 1) END) END
  FROM steps s JOIN k ON k.id = s.a AND s.i < k.n LEFT JOIN places p ON p.id = s.b AND p.c = substr(k.t, s.i + 1, 1)),
ended AS (SELECT s.a, s.b, 200.0::DOUBLE * s.row[-1] / (x.n + y.n) AS ratio FROM steps s JOIN k x ON x.id = s.a AND s.i = x.n JOIN k y ON y.id = s.b)
SELECT a, b, ratio FROM ended WHERE ratio >= 88""",
    "first_sentence_titles": _with(CANDIDATES) + "SELECT ordinal, title FROM cand",
    "content_hash_dups": _with(CANDIDATES) + """
SELECT ordinal, content_hash, f AS content_first, ordinal <> f AS is_copy FROM (
  SELECT ordinal, content_hash, CASE WHEN length(summary) >= 40 THEN min(ordinal) OVER (PARTITION BY length(summary) >= 40, content_hash) ELSE ordinal END AS f FROM cand)""",
    "model_identity": """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'qwen-' || doc_id % 5 || '-' || (doc_id % 70 + 1) || 'b-instruct' WHEN 1 THEN 'glm-' || doc_id % 5 || '.5-' || (doc_id % 70 + 1) || 'b'
  WHEN 2 THEN 'deepseek-' || doc_id % 5 WHEN 3 THEN 'command-r+-' || (doc_id % 70 + 1) || 'b-chat' END AS identity FROM documents""",
    "keyword_scores": _with(CANDIDATES, SCORED) + "SELECT ordinal, keyword_score FROM kw",
    "many_term_scores": _with(CANDIDATES) + """, x AS (SELECT ordinal, replace(normalized_title || ' ' || lower(summary), '_', ' ') AS t FROM cand),
w AS (SELECT DISTINCT term, length(term) % 5 + 1 AS weight FROM (SELECT unnest(string_split(normalized_title, ' ')) AS term FROM cand) WHERE length(term) >= 5),
h AS (SELECT ordinal, count(term) AS n_terms, CAST(coalesce(sum(weight), 0) * 30 AS BIGINT) AS s FROM x LEFT JOIN w ON contains(x.t, w.term) GROUP BY 1)
SELECT ordinal, n_terms, CAST(least(100, s // 1000 + CASE WHEN s % 1000 > 500 OR (s % 1000 = 500 AND (s // 1000) % 2 = 1) THEN 1 ELSE 0 END) AS INTEGER) AS keyword_score FROM h""",
    "errors_before_purchases": """
SELECT p.event_id, count(e.event_id) AS n_errors, arg_min(e.event_id, (e.ts, e.event_id)) AS first_error, arg_max(e.event_id, (e.ts, e.event_id)) AS last_error
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') e ON e.user_id = p.user_id AND e.ts <= p.ts AND e.ts >= p.ts - INTERVAL 14 DAY
GROUP BY 1""",
    "prefilter_decisions": _with(CANDIDATES, SCORED) + "SELECT ordinal, reason, primary_bypass FROM pre",
    "safety_flags": _with(CANDIDATES) + f"""
SELECT ordinal, {_any('t', C.SAFETY_SIGNALS)} AND {_any('t', C.AUTHORITY_SIGNALS)} AS is_safety FROM (
  SELECT ordinal, replace(lower(title || CASE WHEN ordinal % 3 = 0 THEN ' calls for a moratorium' ELSE '' END || CASE WHEN ordinal % 4 = 0 THEN ' says Yoshua_Bengio' ELSE '' END || ' ' || summary), '_', ' ') AS t FROM cand)""",
    "already_seen": _with(CANDIDATES) + """
SELECT c.ordinal, c.canonical_url, coalesce(s.article_id, CASE WHEN c.ordinal > c.f THEN c.f END) AS seen_article
FROM (SELECT ordinal, canonical_url, min(ordinal) OVER (PARTITION BY canonical_url) AS f FROM cand) c
LEFT JOIN (SELECT canonical_url, min(-ordinal - 1) AS article_id FROM cand WHERE ordinal % 8 = 0 GROUP BY 1) s USING (canonical_url)""",
    "best_primary_source": _with(*_ALL) + """
SELECT event_id, article_id AS primary_article_id, canonical_url AS primary_source_url FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY CASE source_type WHEN 'web_changelog' THEN 50 WHEN 'rss' THEN 45 WHEN 'web_articles' THEN 40 ELSE 30 END DESC, source_trust DESC, article_id) AS r
  FROM art WHERE source_is_primary) WHERE r = 1""",
    "evidence_upgrades": _with(CANDIDATES, SCORED, TABLES, UPGRADES) + "SELECT article_id, event_id, upgrade_reason FROM up",
    "decisions": _with(CANDIDATES, SCORED, TABLES, UPGRADES) + "SELECT ordinal, event_id, decision FROM dec",
    "run_summary": _with(CANDIDATES, SCORED, TABLES, UPGRADES) + """
SELECT run_no, CAST(sum(n) AS BIGINT) AS collected, CAST(sum(CASE WHEN decision = 'analyze' THEN n ELSE 0 END) AS BIGINT) AS prefilter_passed, CAST(sum(CASE WHEN decision = 'analyze' THEN bypass ELSE 0 END) AS BIGINT) AS primary_bypass_passed,
  CAST(sum(CASE WHEN decision = 'pending_reanalysis' THEN n ELSE 0 END) AS BIGINT) AS pending_reanalysis, CAST(sum(CASE WHEN decision = 'evidence_reanalysis' THEN n ELSE 0 END) AS BIGINT) AS evidence_reanalysis,
  CAST(sum(web) AS BIGINT) AS web_articles,
  coalesce(string_agg(CASE WHEN decision NOT IN ('analyze', 'pending_reanalysis', 'evidence_reanalysis') THEN decision || '=' || n END, ',' ORDER BY decision), '') AS discards
FROM (SELECT run_no, decision, count(*) AS n, count(*) FILTER (WHERE primary_bypass) AS bypass, count(*) FILTER (WHERE source_type = 'web_articles') AS web FROM dec GROUP BY 1, 2) GROUP BY run_no""",
    "stored_events": _with(CANDIDATES, SCORED, TABLES, UPGRADES) + """, o AS (
  SELECT event_id, ordinal, decision, ordinal = k AS leads, CASE WHEN decision NOT IN ('analyze', 'pending_reanalysis', 'evidence_reanalysis') THEN NULL WHEN ordinal % 13 = 5 THEN 'analysis_failed' WHEN ordinal % 17 = 3 THEN 'high_hype' ELSE 'analyzed' END AS outcome FROM dec),
r AS (
  SELECT *, CASE WHEN decision IN ('already_seen', 'duplicate') OR outcome = 'analyzed' THEN NULL WHEN outcome IS NOT NULL THEN outcome ELSE decision END AS reason FROM o),
e AS (
  SELECT *, CASE WHEN decision = 'too_old' AND NOT leads THEN NULL ELSE reason END AS event_reason FROM r),
g AS (
  SELECT event_id, arg_max(event_reason, ordinal) FILTER (event_reason IS NOT NULL) AS discard_reason, arg_max(CASE WHEN event_reason IS NOT NULL THEN 'discarded' ELSE 'analyzed' END, ordinal) FILTER (event_reason IS NOT NULL OR outcome = 'analyzed') AS status,
    count(*) FILTER (outcome IN ('analyzed', 'high_hype')) AS analysis_count, count(reason) AS candidates_discarded, count(reason) FILTER (reason <> 'analysis_failed') AS articles_discarded FROM e GROUP BY 1)
SELECT event_id, coalesce(g.status, ev.status) AS status, coalesce(g.discard_reason, ev.event_discard_reason) AS discard_reason, coalesce(analysis_count, 0) AS analysis_count, coalesce(candidates_discarded, 0) AS candidates_discarded, coalesce(articles_discarded, 0) AS articles_discarded
FROM ev LEFT JOIN g USING (event_id)""",
    "stored_scores": _with(*_ALL) + """
SELECT event_id, profile_id, CAST((alert_score + 7 * CASE (k + profile_id) % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END) % 101 AS INTEGER) AS alert_score, suggested_action,
  CAST(CASE (k + profile_id) % 4 WHEN 3 THEN 2 ELSE 1 END AS INTEGER) AS first_run, CAST(CASE (k + profile_id) % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS INTEGER) AS last_run, CAST(CASE (k + profile_id) % 4 WHEN 0 THEN 1 ELSE 2 END AS INTEGER) AS runs FROM sc""",
    "run_records": _with(CANDIDATES, SCORED, TABLES, UPGRADES) + """, u AS (
  SELECT d.run_no, d.ordinal, d.decision, d.primary_bypass, c.ordinal > min(c.ordinal) OVER (PARTITION BY c.canonical_url) AS seen, d.decision IN ('analyze', 'pending_reanalysis', 'evidence_reanalysis') AS called, length(c.summary) AS n
  FROM dec d JOIN cand c USING (ordinal)),
b AS (SELECT run_no, string_agg(decision || '=' || n, ',' ORDER BY decision) AS discards FROM (SELECT run_no, decision, count(*) AS n FROM u WHERE NOT called GROUP BY 1, 2) GROUP BY 1),
r AS (
  SELECT run_no, count(*) AS collected, count(*) FILTER (NOT seen) AS candidates_new, count(*) FILTER (decision = 'analyze') AS prefilter_passed, count(*) FILTER (decision = 'analyze' AND primary_bypass) AS primary_bypass_passed,
    count(*) FILTER (decision = 'pending_reanalysis') AS pending_reanalysis, count(*) FILTER (decision = 'evidence_reanalysis') AS evidence_reanalysis, count(*) FILTER (called AND ordinal % 13 <> 5) AS analyzed,
    count(*) FILTER (called) AS llm_calls, count(*) FILTER (called AND ordinal % 11 = 0) AS analysis_retries, count(*) FILTER (called AND ordinal % 13 <> 5 AND ordinal % 10 = 1) AS alerts_sent,
    CAST(coalesce(sum(n) FILTER (called), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(ordinal * 7 % 200) FILTER (called), 0) AS BIGINT) AS output_tokens,
    CAST(coalesce(sum(n * 3 + ordinal * 7 % 200 * 15) FILTER (called), 0) AS BIGINT) AS cost_micros, count(*) FILTER (called AND ordinal % 13 = 5) AS errors
  FROM u GROUP BY 1)
SELECT r.*, coalesce(discards, '') AS discards, llm_calls >= 2 AS call_limit_reached, CASE WHEN errors > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM r LEFT JOIN b USING (run_no)""",
    "alert_scores": _with(*_ALL) + """
SELECT event_id, slug, CAST(v AS INTEGER) AS final_alert, CASE WHEN v >= 90 THEN 'CRITICAL' WHEN v >= 75 THEN 'RELEVANT' WHEN v >= 60 THEN 'INTERESTING' ELSE 'IGNORE' END AS category FROM (
  SELECT s.event_id, s.slug, greatest(0, least(100, round_even(s.alert_score * (0.75::DOUBLE + e.confidence * 0.25::DOUBLE) + (a.source_trust - 80) * 0.1::DOUBLE + CASE WHEN a.source_is_primary THEN 2 ELSE 0 END - e.hype * 20, 0))) AS v
  FROM sc s JOIN ev e USING (event_id) JOIN art a ON a.article_id = e.k)""",
    "high_hype": _with(*_ALL, OUTCOMES) + "SELECT event_id, threshold, high_hype, alerts FROM outs",
    "alert_outbox": _with(*_ALL, OUTCOMES) + """,
due AS (SELECT event_id, '<b>' || replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</b>' AS text FROM outs WHERE alerts AND k % 3 <> 0)
SELECT sha256(event_id || '|immediate|telegram') AS alert_id, event_id, 'immediate' AS alert_type, 'telegram' AS channel, sha256(text) AS content_fingerprint, text, 'pending' AS delivery_status FROM due""".replace("\n,\ndue", ",\ndue"),
    "high_signal": _with(*_ALL) + f"""
SELECT event_id, max_alert, top_profile, {_E('r')} AS recency_at FROM (
  SELECT e.event_id, s.max_alert, s.top_profile, coalesce(a.p, e.first_seen_at) AS r FROM ev e
  JOIN (SELECT event_id, max(alert_score) AS max_alert, arg_max(name, alert_score * 10 - profile_id) AS top_profile FROM sc GROUP BY 1) s USING (event_id)
  JOIN (SELECT event_id, max(published_at) AS p FROM art GROUP BY 1) a USING (event_id) WHERE e.status = 'analyzed')
WHERE r >= {NOW} - INTERVAL 7 DAY ORDER BY max_alert DESC, r DESC, event_id LIMIT 5""",
    "event_list": _with(*_ALL, LATEST) + f"""
SELECT e.event_id, {_E('e.last_seen_at')} AS last_seen_at, l.source_id, coalesce(m.max_alert, 0) AS max_alert, coalesce(m.max_relevance, 0) AS max_relevance,
  {_E('coalesce(l.published_at, e.first_seen_at)')} AS recency_at, coalesce(l.published_at, e.first_seen_at) < {NOW} - INTERVAL 30 DAY AS historical, {_ago('coalesce(l.published_at, e.first_seen_at)')} AS ago
FROM (SELECT * FROM ev WHERE status = 'analyzed' AND title ILIKE '%th%' AND event_id IN (SELECT event_id FROM art WHERE published_at >= {NOW} - INTERVAL 30 DAY)
  AND event_id IN (SELECT event_id FROM sc WHERE enabled AND relevance_score >= 50 AND alert_score >= 40) ORDER BY last_seen_at DESC, event_id LIMIT 25 OFFSET 25) e
LEFT JOIN latest l USING (event_id) LEFT JOIN mx m USING (event_id)""",
    "filtered_event_count": _with(*_ALL) + """
SELECT count(*) AS events, CAST(ceil(count(*) / 25) AS BIGINT) AS pages FROM ev WHERE status = 'analyzed' AND primary_source_verified
  AND event_id IN (SELECT event_id FROM art WHERE source_id = 'src3') AND event_id IN (SELECT event_id FROM sc WHERE enabled AND slug = 'teaching')""",
    "event_badges": _with(*_ALL) + """
SELECT event_id, place, slug, alert_score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY alert_score DESC, profile_id) AS INTEGER) AS place FROM sc WHERE enabled) WHERE place <= 3""",
    "latest_article": _with(*_ALL, LATEST) + f"SELECT event_id, article_id, {_E('published_at')} AS published_at FROM latest",
    "event_detail": _with(*_ALL) + """
SELECT e.event_id, e.title, e.status, s.scores, a.articles, a.n_articles, p.canonical_url AS primary_source_url FROM ev e
JOIN (SELECT event_id, string_agg(CAST(article_id AS VARCHAR), ',' ORDER BY article_id) AS articles, count(*) AS n_articles FROM art GROUP BY 1) a USING (event_id)
LEFT JOIN (SELECT event_id, string_agg(slug || ':' || alert_score, ',' ORDER BY slug || ':' || alert_score) AS scores FROM sc GROUP BY 1) s USING (event_id)
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY CASE source_type WHEN 'web_changelog' THEN 50 WHEN 'rss' THEN 45 WHEN 'web_articles' THEN 40 ELSE 30 END DESC, source_trust DESC, article_id) AS r
  FROM art WHERE source_is_primary) WHERE r = 1) p USING (event_id)""",
    "source_stats": _with(*_ALL) + f"SELECT source_id, count(*) AS items, {_E('max(discovered_at)')} AS last_discovered, {_E('max(published_at)')} AS last_published FROM art GROUP BY 1",
    "sources_with_health": _with(*_ALL, HEALTH) + f""",
s AS (SELECT CASE WHEN source_id = 'src4' THEN 'none' ELSE source_id END AS source_id, source_type, name, enabled FROM src)
SELECT s.source_id, s.source_type, s.name, s.enabled, coalesce(h.status, 'UNKNOWN') AS health, {_E('a.p')} AS last_published FROM s LEFT JOIN h USING (source_id)
LEFT JOIN (SELECT source_id, max(published_at) AS p FROM art GROUP BY 1) a USING (source_id)""",
    "source_status": _with(HEALTH) + f"SELECT source_id, items_found, {_E('latest_item_at')} AS latest_item_at, status FROM h",
    "health_summary": _with(*_ALL, HEALTH, SUMMARY) + "SELECT * FROM hs",
    "system_state": _with(*_ALL, HEALTH, SUMMARY, RUNS) + f""",
st AS (
  SELECT 'sources' AS component, CASE WHEN total = 0 THEN 1 WHEN error > 0 THEN 2 WHEN stale > 0 OR unknown > 0 THEN 1 ELSE 0 END AS state FROM hs
  UNION ALL (SELECT 'last run', CASE WHEN status = 'completed_with_errors' THEN 1 WHEN finished_at IS NULL AND started_at < {NOW} - INTERVAL 1 HOUR THEN 2 WHEN finished_at IS NULL THEN 0
    WHEN finished_at < {NOW} - INTERVAL 6 HOUR THEN 1 ELSE 0 END FROM run ORDER BY started_at DESC LIMIT 1))
SELECT * FROM st UNION ALL SELECT 'overall', max(state) FROM st""",
    "runs_list": _with(RUNS) + f"SELECT run_no, status, collected, analyzed, {_E('started_at')} AS started_at, CAST(floor(epoch(finished_at)) - floor(epoch(started_at)) AS BIGINT) AS seconds FROM run ORDER BY run.started_at DESC, run_no LIMIT 25",
    "run_detail": _with(*_ALL) + f"SELECT event_id, status, {_E('last_seen_at')} AS last_seen_at FROM ev WHERE analyzed_run_no = 50",
    "alert_messages": _with(*_ALL, OUTCOMES) + f""",
pr AS (
  SELECT *, CASE slug {' '.join(f"WHEN '{p[1]}' THEN '{p[3]}'" for p in C.SAMPLE_PROFILES)} END || ' <b>' || {_escaped('name')} || '</b>' AS head FROM sc WHERE enabled),
ps AS (
  SELECT event_id, max(alert_score) AS top,
    string_agg(head || chr(10) || 'Relevance: ' || relevance_score || chr(10) || 'Alert: ' || alert_score, chr(10) || chr(10) ORDER BY alert_score DESC, profile_id) AS lines,
    string_agg(head || ': ' || {_escaped('(' + _LABELS + ')')}, chr(10) ORDER BY profile_id) FILTER (suggested_action IS NOT NULL) AS actions,
    string_agg('• ' || {_escaped('name')} || ': fits ' || slug, chr(10) ORDER BY profile_id) AS reasons FROM pr GROUP BY event_id),
fa AS (SELECT event_id, arg_min(source_trust, article_id) AS trust, arg_min(source_is_primary, article_id) AS prim, arg_min(canonical_url, article_id) AS url FROM art GROUP BY event_id)
SELECT e.event_id, '<b>ALERT ' || top || '/100</b>' || chr(10) || chr(10) || '<b>' || {_escaped('e.title')} || '</b>' || chr(10) || 'Confidence: ' || printf('%.2f', e.confidence) || chr(10)
  || 'Hype: ' || printf('%.2f', e.hype) || chr(10)
  || CASE WHEN prim THEN 'Primary source: yes' WHEN trust < 60 THEN 'Secondary source, to be verified by a primary one' ELSE 'Primary source: no' END
  || chr(10) || chr(10) || lines || chr(10) || chr(10) || '<b>WHAT HAPPENED</b>' || chr(10) || '&lt;' || {_escaped('e.title')} || '&gt;'
  || chr(10) || chr(10) || '<b>WHY IT MATTERS</b>' || chr(10) || 'It&#x27;s new &amp; matters' || chr(10) || chr(10) || '<b>REASONS</b>' || chr(10) || reasons
  || chr(10) || chr(10) || '<b>SUGGESTED ACTION</b>' || chr(10) || coalesce(actions, 'No action suggested.') || chr(10) || chr(10) || '<a href="' || {_escaped('url')} || '">Source</a>' AS text
FROM ev e JOIN ps USING (event_id) JOIN fa USING (event_id) WHERE e.event_id IN (SELECT event_id FROM outs WHERE alerts)""".replace("\n,\npr", ",\npr"),
    "run_report": _with(*_ALL, RUNS) + """,
r AS (SELECT * FROM run WHERE run_no % 360 = 50),
f AS (SELECT event_id, status, title FROM ev WHERE analyzed_run_no = 50
  UNION SELECT event_id, ev.status, title FROM ev JOIN r ON ev.last_seen_at BETWEEN r.started_at AND r.finished_at WHERE analyzed_run_no IS NULL)
SELECT f.event_id, f.status, m.max_alert, m.max_relevance FROM f LEFT JOIN (SELECT event_id, max(alert_score) AS max_alert, max(relevance_score) AS max_relevance FROM sc GROUP BY 1) m USING (event_id)
ORDER BY max_alert DESC NULLS LAST, max_relevance DESC NULLS LAST, f.title, f.event_id LIMIT 40""",
    "llm_cost": _with(RUNS) + "SELECT run_no, (input_tokens * 0.5::DOUBLE + output_tokens * 2.0::DOUBLE) / 1000000 AS cost_usd FROM run",
    "candidate_lineage": _with(CANDIDATES, SCORED, TABLES, UPGRADES) + """
SELECT d.ordinal, d.article_id, a.event_id, d.decision, coalesce(a.canonical_url, '') AS article_url, coalesce(e.status, 'none') AS event_status, coalesce(s.source_id, d.source_name) AS source, s.trust_level
FROM (SELECT ordinal, CASE WHEN ordinal % 11 <> 0 THEN ordinal END AS article_id, source_name, decision FROM dec) d
LEFT JOIN art a USING (article_id) LEFT JOIN ev e ON e.event_id = a.event_id LEFT JOIN src s ON s.source_id = a.source_id""",
    "digest_ranking": _with(*_ALL, DIGEST) + f"SELECT event_id, max_alert, max_relevance, max_actionability, category, alerted_before, {_E('recency_at')} AS recency_at FROM top",
    "digest_categories": _with(*_ALL, DIGEST) + "SELECT category, count(*) AS n FROM top GROUP BY 1",
    "digest_profile_counts": _with(*_ALL, DIGEST) + "SELECT name, count(*) AS n FROM sc JOIN top USING (event_id) WHERE enabled AND (relevance_score >= 50 OR alert_score >= 50) GROUP BY 1",
    "digest_actions": _with(*_ALL, DIGEST) + f"""
SELECT {_LABELS} AS label, max(actionability_score) AS actionability FROM sc JOIN top USING (event_id) WHERE enabled AND suggested_action IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""",
    "digest_messages": _with(*_ALL, DIGEST).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
,
newest AS (SELECT event_id, canonical_url, row_number() OVER (PARTITION BY event_id ORDER BY coalesce(published_at, discovered_at) DESC, article_id DESC) AS r
  FROM art WHERE coalesce(published_at, discovered_at) BETWEEN {NOW} - INTERVAL 240 HOUR AND {NOW}),
act AS (SELECT event_id, {_LABELS} AS action, row_number() OVER (PARTITION BY event_id ORDER BY actionability_score DESC, profile_id) AS r FROM sc WHERE enabled),
numbered AS (SELECT *, row_number() OVER (ORDER BY max_alert DESC, max_relevance DESC, max_actionability DESC, recency_at DESC, event_id) AS place FROM top),
bl AS (SELECT place, concat_ws(chr(10), '<b>' || place || '. ' || {_escaped('t.title')} || '</b>', category, CASE WHEN alerted_before THEN 'alerted before' END, action,
    '<a href="' || {_escaped('canonical_url')} || '">source</a>') AS body
  FROM numbered t JOIN newest n ON n.event_id = t.event_id AND n.r = 1 LEFT JOIN act a ON a.event_id = t.event_id AND a.r = 1),
sep AS (SELECT chr(10) || chr(10) || repeat('━', 18) || chr(10) || chr(10) AS s),
pk AS (
  SELECT place, CAST(1 AS INTEGER) AS part, body FROM bl WHERE place = 1
  UNION ALL
  SELECT b.place, CASE WHEN length(pk.body || s || b.body) <= 3750 THEN part ELSE part + 1 END, CASE WHEN length(pk.body || s || b.body) <= 3750 THEN pk.body || s || b.body ELSE b.body END
  FROM pk JOIN bl b ON b.place = pk.place + 1, sep)
SELECT 'now' AS digest_id, part, '<b>DIGEST' || CASE WHEN max(part) OVER () > 1 THEN ' (' || part || '/' || max(part) OVER () || ')' ELSE '' END || '</b>' || chr(10) || chr(10) || body AS text
FROM (SELECT part, arg_max(body, place) AS body FROM pk GROUP BY part)""",
    "page_items": r"""
WITH t AS (
  SELECT page_id, page_id % 41 = 0 AS failed,
    trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages)
SELECT CAST(page_id AS VARCHAR) AS source_id, CASE WHEN NOT failed AND title <> '' THEN 0 END AS position, CASE WHEN NOT failed AND title <> '' THEN title END AS title,
  CASE WHEN failed THEN 'HTTP_ERROR' WHEN title = '' THEN 'EMPTY' END AS error FROM t""",
    "event_actions": _with(*_ALL) + f"""
SELECT event_id, {_LABELS} AS action FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY actionability_score DESC, profile_id) AS r FROM sc WHERE enabled) WHERE r = 1""",
    "anchor_contradictions": """
SELECT doc_id, array_to_string(list_concat(CASE WHEN doc_id % 8 = 0 THEN ['subject:another'] ELSE [] END, CASE WHEN doc_id % 5 <> doc_id % 4 THEN ['gpt-' || doc_id % 5] ELSE [] END), ',') AS contradictions FROM documents""",
    "class_closed_set": _with(*_ALL) + """,
c AS (SELECT event_id, slug, [relevance_score % 8, alert_score % 8, 1] AS cs, CASE slug WHEN 'finance' THEN [1, 2, 3] WHEN 'teaching' THEN [2, 4] WHEN 'research' THEN [1, 5, 6] ELSE [7] END AS ok FROM sc)
SELECT event_id, slug, array_to_string(list_filter(cs, lambda x: list_contains(ok, x)), ',') AS valid_classes, array_to_string(list_filter(cs, lambda x: NOT list_contains(ok, x)), ',') AS invalid_classes FROM c""",
    "analysis_parse": _with(*_ALL) + """
SELECT event_id, k AS input_tokens, CASE WHEN k % 2 = 0 THEN 5 ELSE 6 END AS output_tokens, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 19 = 0 THEN 2 ELSE 3 END AS n_profiles,
  CASE WHEN k % 7 = 0 THEN 'analysis_failed' WHEN k % 17 = 0 OR confidence > 1 THEN 'out_of_range' WHEN k % 13 = 0 THEN 'encoded_text' WHEN k % 19 = 0 THEN 'profile_set' END AS problem
FROM ev WHERE status <> 'pending'""",
    "profiles_sync": r"""
WITH s AS (SELECT DISTINCT source AS slug, coalesce(try_cast(regexp_extract(source, '(\d+)', 1) AS INTEGER), 0) AS no FROM documents)
SELECT slug, upper(slug) || CASE WHEN no % 3 <> 0 THEN '!' ELSE '' END AS name, '*' AS icon, no % 3 <> 0 AS enabled FROM s
UNION ALL SELECT DISTINCT lang, lang, '+', true FROM documents""",
    "source_upserts": _with(CANDIDATES) + """
SELECT source_type, source_url, ordinal FROM (
  SELECT source_type, source_url, ordinal, row_number() OVER (PARTITION BY source_type, source_url ORDER BY ordinal % 2 DESC, ordinal DESC) AS r FROM cand) WHERE r = 1""",
    "relative_times": _with(*_ALL) + f"""
SELECT article_id, {_ago('published_at')} AS ago, published_at < {NOW} - INTERVAL 30 DAY AS historical, coalesce(strftime(published_at - INTERVAL 3 HOUR, '%d %b %Y · %H:%M'), '—') AS local FROM art""",
}


def oracle_sql() -> dict[str, str]:
    """SQL by query name. Continuations of the table list begin with a comma, which joins on to the tables before."""
    return {name: sql.replace("\n,\n", ",\n") for name, sql in SQL.items()}
