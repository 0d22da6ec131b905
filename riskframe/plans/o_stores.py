"""DuckDB formulations for :mod:`riskframe.plans.q_stores`."""
from __future__ import annotations

from riskframe.plans import o_detect
from riskframe.plans import q_stores as Q
from riskframe.streaming.windows import ESCALATION_SCORE, ESCALATION_SOURCE

_RISK = "CASE WHEN value >= 150 THEN 'HIGH' WHEN value >= 60 THEN 'MEDIUM' ELSE 'LOW' END"

MERGED = f"""
WITH r AS (SELECT sha256(CAST(user_id AS VARCHAR)) AS prompt_hash, {_RISK} AS risk, value AS score, event_type AS source,
    least((CAST(ts AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM events)) // {Q.EPOCH_DAYS}, {Q.EPOCHS - 1}) AS epoch FROM events),
o AS (SELECT *, CASE risk WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END AS s, max(epoch) FILTER (risk = 'HIGH') OVER (PARTITION BY prompt_hash) AS high FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY prompt_hash ORDER BY epoch, s, risk, score, source) AS rn FROM o),
x AS (SELECT *, coalesce(risk <> 'HIGH' AND high > epoch, false) AS raised FROM f WHERE rn = 1)
SELECT prompt_hash, CASE WHEN raised THEN 'HIGH' ELSE risk END AS risk, CASE WHEN raised THEN {ESCALATION_SCORE}::DOUBLE ELSE score END AS score,
    CASE WHEN raised THEN '{ESCALATION_SOURCE}' ELSE source END AS source FROM x"""

PROGRESS = """
WITH l AS (SELECT event_type AS detector, CAST(ts AS DATE) AS run, count(*) FILTER (value > 20) AS rows, count(*) FILTER (NOT value > 20) AS failed,
    epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM events GROUP BY ALL),
g AS (SELECT detector, count(*) AS runs, CAST(sum(rows) AS BIGINT) AS done, CAST(sum(failed) AS BIGINT) AS failed, (SELECT count(*) FROM events) AS total,
    sum(rows) * 1e6 / nullif(sum(us), 0) AS per_s FROM l GROUP BY detector)
SELECT detector, runs, done, failed, total, round(done / total, 6) AS rate, round(per_s, 6) AS rows_per_sec,
    round(greatest(total - done, 0) / nullif(per_s, 0), 6) AS eta_seconds FROM g"""

TIMEOUTS = f"""
SELECT event_type AS endpoint, count(*) AS n_requests,
    count(*) FILTER (event_type = 'error' OR NOT coalesce(CAST(value AS DECIMAL(18,6)) BETWEEN 0 AND {Q.DEADLINE_SECONDS}, false)) AS n_timeouts
FROM events GROUP BY event_type"""

CONFIRMED = f"""
WITH s AS (SELECT event_id, {_RISK} AS risk, event_id % 5 <> 0 AND (event_id * 37) % 900 <= {Q.JUDGE_DEADLINE} AS judged,
    CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) >= 70 THEN 'HIGH' ELSE 'LOW' END AS judge FROM events)
SELECT event_id, risk, CASE WHEN NOT judged THEN 'unverified' WHEN judge = 'HIGH' AND risk <> 'HIGH' THEN 'escalated' ELSE 'stands' END AS confirmation,
    CASE WHEN judged AND judge = 'HIGH' THEN 'HIGH' ELSE risk END AS final_risk FROM s"""

SKETCHES = f"""
SELECT event_type, q, count(*) AS n, true AS within_rank_error FROM events, (SELECT unnest({Q.SKETCH_QUANTILES}::DOUBLE[]) AS q)
WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY event_type, q"""

RULES = f"""
WITH p AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+ [a-z]+ [a-z]+')) AS p FROM documents),
t AS (SELECT p, md5(p) AS h FROM p ORDER BY h, p LIMIT {Q.PACK}),
r AS (SELECT p, h, row_number() OVER (ORDER BY h, p) - 1 AS pattern_id FROM t),
k AS (SELECT pattern_id, CAST(('0x' || h[1:2])::BIGINT % 3 AS INTEGER) AS priority, p FROM r),
m AS (SELECT d.doc_id, k.priority, k.pattern_id FROM documents d JOIN k ON k.pattern_id >= {Q.PACK_REGEX} AND contains(d.text, k.p)
    UNION ALL SELECT d.doc_id, k.priority, k.pattern_id FROM documents d JOIN k ON k.pattern_id < {Q.PACK_REGEX} AND regexp_matches(d.text, replace(k.p, ' ', '\\s+'))
    UNION ALL SELECT doc_id, 0, {Q.PACK} FROM documents WHERE regexp_matches(text, '[qz][a-z][qxz]')
    UNION ALL SELECT doc_id, 2, {Q.PACK + 1} FROM documents WHERE regexp_matches(text, '(?i)THE (the|an) the'))
SELECT doc_id, arg_min(pattern_id, (priority, pattern_id)) AS pattern_id, min(priority) AS priority FROM m GROUP BY doc_id"""

ORACLE = {
    "verdict_store_merged": MERGED,
    "incremental_scoring": o_detect.MODEL_SCORES,
    "scoring_progress": PROGRESS,
    "request_timeouts": TIMEOUTS,
    "confirmed_verdicts": CONFIRMED,
    "latency_sketches": SKETCHES,
    "large_rule_pack": RULES,
}
