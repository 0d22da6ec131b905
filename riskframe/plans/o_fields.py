"""DuckDB formulations for :mod:`riskframe.plans.q_fields`."""
from __future__ import annotations

from riskframe import config as C
from riskframe.plans import o_eval, o_ops, o_vectors
from riskframe.plans import q_fields as Q
from riskframe.plans.sqlfrag import q

CLIENT = """
WITH x AS (SELECT event_id,
    CASE event_type WHEN 'view' THEN '10.0.0.' || user_id || ', 192.168.1.' || (event_id % 250) WHEN 'click' THEN ' , '
                    WHEN 'error' THEN '  203.0.113.' || user_id || ' ,' END AS fwd,
    CASE event_id % 3 WHEN 0 THEN '172.16.0.' || user_id END AS peer,
    CASE event_type WHEN 'view' THEN 'tok' || user_id WHEN 'click' THEN 'tok' || user_id END AS credential FROM events)
SELECT event_id, coalesce(list_filter(list_transform(string_split(fwd, ','), lambda h: trim(h)), lambda h: h <> '')[-1], peer, 'unknown') AS proxied,
       coalesce(peer, 'unknown') AS direct, credential FROM x"""

ENTITY = """
SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Z][a-z]{11,}|[0-9]{3,}')) AS BIGINT) AS n_spans,
       sha256(regexp_replace(regexp_replace(text, '[A-Z][a-z]{11,}', '[REDACTED:PERSON]', 'g'), '[0-9]{3,}', '[REDACTED:ORG]', 'g')) AS redacted_sha256
FROM documents"""

PROBABILITIES = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT vec_id, round(CASE WHEN v[1] > 0 THEN v[1] ELSE 1 + v[1] END, 9) AS one_sided,
       round(1 / (1 + exp(v[2] - v[3])), 9) AS two_logit,
       round(1 / (1 + exp(-greatest(v[1], v[3]))), 9) AS sigmoid_max,
       round(exp(greatest(v[1], v[3])) / (exp(v[1]) + exp(v[2]) + exp(v[3]) + exp(v[4])), 9) AS softmax_max FROM e"""

# the readings of the six judge answers and five hazard answers, by hand
ARBITRATION = """
WITH j(k, judge_verdict) AS (VALUES (0, 'SAFE'), (1, 'DANGEROUS'), (2, 'AMBIGUOUS'), (3, 'DANGEROUS'), (4, 'DANGEROUS'), (5, NULL)),
h(k, hazard_verdict, categories) AS (VALUES (0, 'SAFE', ''), (1, 'DANGEROUS', 'S1,S10'), (2, 'SAFE', 'S9'), (3, 'DANGEROUS', ''), (4, NULL, '')),
x AS (SELECT conv_id, turn, length(text) % 2 = 0 AS threat, judge_verdict, hazard_verdict, categories
      FROM conversations c JOIN j ON j.k = (conv_id * 7 + turn) % 6 JOIN h ON h.k = (conv_id + turn) % 5),
s AS (SELECT *, CASE WHEN hazard_verdict = 'DANGEROUS' THEN 'llama_guard_arbitration'
                     WHEN hazard_verdict = 'SAFE' THEN CASE WHEN threat THEN 'llama_guard_override_restricted' ELSE 'llama_guard_override' END
                     WHEN judge_verdict = 'DANGEROUS' THEN 'semantic_judge' WHEN judge_verdict = 'AMBIGUOUS' THEN 'semantic_judge_ambiguous'
                     WHEN judge_verdict = 'SAFE' THEN CASE WHEN threat THEN 'semantic_judge_override_restricted' ELSE 'semantic_judge_override' END
                     ELSE 'judge_failure_fail_closed' END AS lenient_source FROM x)
SELECT conv_id, turn, judge_verdict, hazard_verdict, categories,
       CASE WHEN lenient_source IN ('llama_guard_arbitration', 'semantic_judge', 'judge_failure_fail_closed') THEN 'HIGH' ELSE 'MEDIUM' END AS risk,
       CASE WHEN lenient_source IN ('llama_guard_override', 'semantic_judge_override') THEN lenient_source || '_capped' ELSE lenient_source END AS source,
       CASE WHEN lenient_source IN ('llama_guard_arbitration', 'semantic_judge', 'judge_failure_fail_closed') THEN 'HIGH'
            WHEN lenient_source IN ('llama_guard_override', 'semantic_judge_override') THEN 'LOW' ELSE 'MEDIUM' END AS lenient_risk, lenient_source
FROM s"""

ESCALATED = """
WITH x AS (SELECT sha256(CAST(user_id AS VARCHAR)) AS prompt_hash, event_id, user_id, event_type,
                  CASE WHEN value >= 100 THEN 'HIGH' WHEN value >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk, 'stage_' || event_type AS source, value AS score FROM events),
st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt_hash ORDER BY event_id) AS rn FROM x
                      WHERE event_type = 'view' AND user_id % 3 <> 0) WHERE rn = 1),
up AS (SELECT *, CASE risk WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END AS sev FROM x
       WHERE event_type IN ('error', 'click') AND (risk <> 'HIGH' OR score < 130)),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt_hash ORDER BY sev DESC, source, score) AS rn FROM up) WHERE rn = 1)
SELECT coalesce(st.prompt_hash, be.prompt_hash) AS prompt_hash,
       CASE WHEN st.risk IS NULL THEN be.risk WHEN st.risk <> 'HIGH' AND be.risk = 'HIGH' THEN 'HIGH' ELSE st.risk END AS risk,
       CASE WHEN st.risk IS NULL THEN be.source WHEN st.risk <> 'HIGH' AND be.risk = 'HIGH' THEN 'llama_guard_async_escalation' ELSE st.source END AS source,
       CASE WHEN st.risk IS NULL THEN be.score WHEN st.risk <> 'HIGH' AND be.risk = 'HIGH' THEN 1.0 ELSE st.score END AS score
FROM st FULL JOIN be ON st.prompt_hash = be.prompt_hash"""

ANCHOR_DETECTOR = f"""
WITH {o_vectors.SIG}
SELECT vec_id, round(CASE WHEN label = 3 THEN 1.0 ELSE greatest(threat_score, meta_intent_score) END, 6) AS score FROM sig"""

_F = o_vectors.FEATURES
AVAILABILITY = f"""
WITH {o_vectors.SIG},
f AS (SELECT * REPLACE (CASE WHEN label % 3 <> 0 THEN {_F['injection']} END AS {_F['injection']},
                        CASE WHEN label % 4 <> 0 THEN {_F['toxicity']} END AS {_F['toxicity']}) FROM sig)
SELECT vec_id, label % 3 <> 0 AND label % 4 <> 0 AS fusion_available,
       CASE {" ".join(f"WHEN {_F[n]} IS NULL THEN {q(n + ' unavailable')}" for n in o_vectors.ORDER)} END AS detail,
       CASE WHEN label % 3 <> 0 AND label % 4 <> 0 THEN round({o_vectors._sigmoid(o_vectors._z(o_vectors.POL, o_vectors.ORDER))}, 9) END AS fusion_score FROM f"""

PREVALENCE = f"""
WITH {o_eval.EV},
c AS (SELECT k_band, count(*) FILTER (WHERE label = 1 AND score >= {Q.PREVALENCE_THRESHOLD}) / count(*) FILTER (WHERE label = 1) AS tpr,
             count(*) FILTER (WHERE label = 0 AND score >= {Q.PREVALENCE_THRESHOLD}) / count(*) FILTER (WHERE label = 0) AS fpr FROM s GROUP BY k_band),
p AS (SELECT unnest({Q.PREVALENCES}::DOUBLE[]) AS prevalence)
SELECT k_band, prevalence, round(coalesce(prevalence * tpr / nullif(prevalence * tpr + (1 - prevalence) * fpr, 0), 0.0), 9) AS precision FROM c CROSS JOIN p"""

_U = "('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':42'), 1, 13))::BIGINT / 4503599627370496.0"
HOLDOUT = f"SELECT doc_id, CASE WHEN {_U} < 0.3 THEN 'test' ELSE 'train' END AS split FROM documents"
FOLDS = f"""
SELECT doc_id, toxic, CAST((row_number() OVER (PARTITION BY toxic ORDER BY {_U}) - 1) % 5 AS INTEGER) AS fold FROM labels"""

CACHE = f"""
SELECT sha256(CAST(event_id AS VARCHAR)) AS prompt_hash, CASE WHEN value >= 100 THEN 'HIGH' ELSE 'LOW' END AS risk, value AS score, event_type AS source
FROM events WHERE epoch_us(ts) > (SELECT max(epoch_us(ts)) FROM events) - {C.CACHE_TTL_SECONDS * 1_000_000}"""

STORE = "SELECT 'remote' AS detector, CAST(event_id AS VARCHAR) AS id, value AS score FROM events WHERE event_type = 'click'"

AUDIT = f"""
WITH {o_ops.VLOG}
SELECT CAST(event_id AS VARCHAR) AS request_id, coalesce(tenant, 'unset') AS tenant, 'GENERAL' AS capability, risk_level AS risk, decision,
       sha256('prompt ' || user_id) AS prompt_hash, CASE WHEN value >= 10 THEN value ELSE 0.0 END AS semantic_score,
       CASE WHEN source = 'signup' THEN 'unknown' ELSE source END AS source, false AS symbolic_triggered, false AS judge_invoked FROM v"""

FIXTURE = """
WITH b AS (SELECT count(*) AS n, min(item_id) + 1 AS min_id, max(item_id) + 1 AS max_id, count(DISTINCT item_id) AS distinct_ids,
                  count(DISTINCT text) AS distinct_text FROM benchmark)
SELECT CAST(n AS BIGINT) AS n, min_id, max_id, CAST(distinct_ids AS BIGINT) AS distinct_ids, CAST(distinct_text AS BIGINT) AS distinct_text,
       min_id = 1 AND max_id = n AND distinct_ids = n AS ids_sequential, distinct_text = n AS text_unique FROM b"""

REPORT = """
SELECT toxic, CAST(count(*) AS BIGINT) AS n_rows, CAST((SELECT count(*) FROM labels) AS BIGINT) AS n,
       CAST((SELECT sum(toxic) FROM labels) AS BIGINT) AS n_toxic FROM labels GROUP BY toxic"""

ORACLE = {
    "client_identity": CLIENT,
    "entity_redaction": ENTITY,
    "detector_probabilities": PROBABILITIES,
    "verdict_arbitration": ARBITRATION,
    "escalated_verdicts": ESCALATED,
    "anchor_detector_score": ANCHOR_DETECTOR,
    "fusion_availability": AVAILABILITY,
    "prevalence_precision": PREVALENCE,
    "holdout_assignment": HOLDOUT,
    "fold_assignment": FOLDS,
    "verdict_cache_roundtrip": CACHE,
    "score_store_roundtrip": STORE,
    "audit_projection": AUDIT,
    "fixture_expectations": FIXTURE,
    "report_roundtrip": REPORT,
}
