"""DuckDB formulations for :mod:`riskframe.plans.q_more`."""
from __future__ import annotations

from riskframe import config as C
from riskframe.plans import o_ops, o_stores, o_vectors
from riskframe.plans import q_more as Q
from riskframe.plans.o_detect import SUITE, auc_sql, recall_sql

TTL_US = int(round(C.CACHE_TTL_SECONDS * 1_000_000))

EXACT = f"""
WITH u AS (SELECT user_id, ts, 0 AS kind, event_id AS eid, NULL::BIGINT AS rid FROM events WHERE event_type = 'view'
           UNION ALL SELECT user_id, ts, 1, NULL::BIGINT, event_id FROM events WHERE event_type <> 'view'),
w AS (SELECT *, last_value(CASE WHEN kind = 0 THEN eid END IGNORE NULLS)
                  OVER (PARTITION BY user_id ORDER BY ts, kind, eid ROWS UNBOUNDED PRECEDING) AS le,
                last_value(CASE WHEN kind = 0 THEN ts END IGNORE NULLS)
                  OVER (PARTITION BY user_id ORDER BY ts, kind, eid ROWS UNBOUNDED PRECEDING) AS lt FROM u)
SELECT rid AS event_id, coalesce(epoch_us(ts) - epoch_us(lt) < {TTL_US}, false) AS hit,
       CASE WHEN epoch_us(ts) - epoch_us(lt) < {TTL_US} THEN le END AS origin_id FROM w WHERE kind = 1"""

FUZZY = f"""
WITH {o_vectors.PHRASES_CTE},
c AS (SELECT f.vec_id, f.v, ev.ts FROM ph f JOIN events ev ON ev.event_id = f.vec_id WHERE f.vec_id >= 0),
q AS (SELECT f.vec_id, f.v, ev.ts + to_hours(CAST(((-1 - f.vec_id) * {Q.ASK_STEP}) % {Q.ASK_HOURS} - {Q.ASK_BEFORE} AS INTEGER)) AS ts
      FROM ph f JOIN events ev ON ev.event_id = -1 - f.vec_id WHERE f.vec_id < 0),
p AS (SELECT q.vec_id, c.vec_id AS nn_id, c.ts AS cached_at, q.ts, list_cosine_similarity(q.v, c.v) AS sim,
             row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, c.v) DESC, c.vec_id) AS rn
      FROM q JOIN c ON c.ts <= q.ts AND list_cosine_similarity(q.v, c.v) > {C.CACHE_SIMILARITY_THRESHOLD}),
b AS (SELECT * FROM p WHERE rn = 1)
SELECT q.vec_id, b.nn_id, round(b.sim, 6) AS sim, coalesce(epoch_us(b.ts) - epoch_us(b.cached_at) < {TTL_US}, false) AS hit,
       coalesce(epoch_us(b.ts) - epoch_us(b.cached_at) >= {TTL_US}, false) AS expired FROM q LEFT JOIN b ON b.vec_id = q.vec_id"""

SPEEDUP = f"""
{o_ops.REUSE.replace("SELECT event_id, h AS prompt_hash, hit, origin AS origin_id FROM r", ", res AS (SELECT event_id, hit, origin AS origin_id FROM r)").replace("WITH RECURSIVE", "WITH RECURSIVE", 1)}
SELECT w.event_type, CAST(count(*) AS BIGINT) AS n_pairs, round(avg(c.value), 9) AS avg_cold, round(avg(w.value), 9) AS avg_warm,
       round(avg(c.value) / avg(w.value), 9) AS speedup
FROM res JOIN events w ON res.event_id = w.event_id JOIN events c ON res.origin_id = c.event_id
WHERE res.hit GROUP BY w.event_type"""

HARBOUR = f"""
WITH {o_vectors.SIG},
{o_vectors._PC}
SELECT CASE {" ".join(f"WHEN label IN {tuple(labs)} THEN '{c}'" for c, labs in o_vectors.CLASS_LABELS.items())} ELSE 'benign' END AS attack_class,
       CAST(count(*) AS BIGINT) AS n_ambiguous, CAST(count(*) FILTER (WHERE educational_score > {Q.HARBOUR_EDUCATIONAL}) AS BIGINT) AS n_flipped
FROM pc WHERE w_score >= w_md AND w_score < w_hi GROUP BY 1"""


def _in(labs):
    return "(" + ", ".join(str(x) for x in labs) + ")"


ABL_LONG = " UNION ALL ".join(
    f"SELECT '{n}' AS anchor_set, vec_id, attack AS label, coalesce(max(cs) FILTER (WHERE alabel IN {_in(labs)}), 0.0) AS score "
    f"FROM sims JOIN (SELECT vec_id AS vid, CAST(label <= 6 AS INTEGER) AS attack FROM e) l ON sims.vec_id = l.vid GROUP BY vec_id, attack"
    for n, labs in Q.ABLATION_SETS.items())

ABLATION = f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
a AS (SELECT label AS alabel, arg_min(v, vec_id) AS av FROM e GROUP BY label),
sims AS (SELECT e.vec_id, a.alabel, list_cosine_similarity(e.v, a.av) AS cs FROM e CROSS JOIN a),
lg AS ({ABL_LONG}),
au AS {auc_sql('lg', ['anchor_set'])},
rc AS {recall_sql('lg', ['anchor_set'], C.DEFAULT_FPR_BUDGET)}
SELECT au.anchor_set, au.auc, rc.recall, round(rc.threshold, 9) AS threshold FROM au JOIN rc ON au.anchor_set = rc.anchor_set"""

GROUNDING = f"""
WITH {o_vectors.SIG}
SELECT vec_id, round(domain_score, 6) AS grounding_score, domain_score < {C.GROUNDING_THRESHOLD} AS hallucination_flag FROM sig"""

OPEN_STATE = f"""
{o_ops.BREAKER.replace("SELECT event_id, user_id, skipped, opened IS NOT NULL AS open_after, CAST(fails AS INTEGER) AS failures_after FROM r", ", b AS (SELECT event_id, user_id, opened IS NOT NULL AS open_after FROM r)")}
SELECT b.user_id, date_trunc('hour', e.ts) AS bucket_start, arg_max(b.open_after, (e.ts, b.event_id)) AS open
FROM b JOIN events e ON b.event_id = e.event_id GROUP BY b.user_id, date_trunc('hour', e.ts)"""

COVERAGE = f"""
WITH {SUITE}
SELECT attack_class, lang, CAST(count(*) AS BIGINT) AS n FROM suite GROUP BY ALL"""

ACCURACY = f"""
WITH {o_vectors.SIG},
{o_vectors._PC},
{o_vectors._cascade_body()},
x AS (SELECT attack, (CASE WHEN risk = 'HIGH' THEN 'BLOCK' WHEN risk = 'MEDIUM' THEN 'RESTRICT' ELSE 'ALLOW' END)
                     = (CASE WHEN attack = 1 THEN 'BLOCK' ELSE 'ALLOW' END) AS ok FROM v)
SELECT CAST(attack AS VARCHAR) AS slice, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS n_correct,
       count(*) FILTER (WHERE ok) / count(*) AS accuracy FROM x GROUP BY attack
UNION ALL
SELECT 'all', CAST(count(*) AS BIGINT), CAST(count(*) FILTER (WHERE ok) AS BIGINT), count(*) FILTER (WHERE ok) / count(*) FROM x"""


def _excl(i: int) -> str:
    j = f"least(greatest(CAST(floor({i} * (n + 1) / 100) AS BIGINT), 1), n - 1)"
    return (f"round((xs[{j}] * (100 - ({i} * (n + 1) - {j} * 100)) + xs[{j} + 1] * ({i} * (n + 1) - {j} * 100)) / 100.0, 9)")


EXCLUSIVE = f"""
WITH s AS (SELECT event_type, count(value) AS n, list_sort(list(value) FILTER (WHERE value IS NOT NULL)) AS xs
           FROM events GROUP BY event_type)
SELECT event_type, CAST(n AS BIGINT) AS n, {_excl(50)} AS p50, {_excl(95)} AS p95, {_excl(99)} AS p99 FROM s"""

COUNTERS = f"""
{o_ops.QUOTA.replace("SELECT event_id, user_id, allowed, round(retry, 6) AS retry_after FROM r", ", q AS (SELECT event_id, user_id, allowed FROM r)")},
k AS (SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal >= 0),
j AS (SELECT q.*, k.c_custkey IS NOT NULL AS authenticated FROM q LEFT JOIN k ON q.user_id = k.c_custkey),
{o_ops.VLOG}
SELECT 'rate_limited' AS counter, CAST(authenticated AS VARCHAR) AS label, CAST(count(*) AS BIGINT) AS n FROM j WHERE NOT allowed GROUP BY authenticated
UNION ALL SELECT 'requests', CAST(authenticated AS VARCHAR), CAST(count(*) AS BIGINT) FROM j GROUP BY authenticated
UNION ALL SELECT 'unknown_source', substr(coalesce(source, 'None'), 1, {C.UNKNOWN_SOURCE_TRUNCATE}), CAST(count(*) AS BIGINT)
  FROM v WHERE source IS NULL OR source NOT IN {o_ops.KNOWN} GROUP BY 2
UNION ALL SELECT 'timeouts', endpoint, n_timeouts FROM ({o_stores.TIMEOUTS})
UNION ALL SELECT 'judge_invocations', 'judge', count(*) FROM ({o_stores.CONFIRMED}) WHERE confirmation <> 'unverified'"""

RUN_SUMMARY = f"""
WITH {o_vectors.SIG},
{o_vectors._PC},
{o_vectors._cascade_body()},
m AS (SELECT risk, source, topicality, GROUPING(risk, source, topicality) AS gid, CAST(count(*) AS BIGINT) AS n,
             CAST(count(*) FILTER (WHERE judge_invoked) AS BIGINT) AS n_judge,
             CAST(count(*) FILTER (WHERE attack = 0 AND topicality = 'OUT_OF_DOMAIN') AS BIGINT) AS n_benign_out_of_domain
      FROM v GROUP BY GROUPING SETS ((risk), (source), (topicality), ()))
SELECT CASE WHEN gid = 3 THEN 'risk' WHEN gid = 5 THEN 'source' WHEN gid = 6 THEN 'topicality' ELSE 'all' END AS slice_kind,
       CASE WHEN gid = 3 THEN risk WHEN gid = 5 THEN source WHEN gid = 6 THEN topicality END AS slice_value,
       n, n_judge, n_benign_out_of_domain FROM m"""

BENIGN_CAP = f"""
WITH {SUITE}
SELECT doc_id, label FROM suite WHERE label <> 0
UNION ALL
SELECT doc_id, label FROM (SELECT doc_id, label, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42')) AS rn
                           FROM suite WHERE label = 0) WHERE rn <= {Q.BENIGN_CAP}"""

STRATIFIED = f"""
WITH {SUITE}
SELECT doc_id, attack_class FROM (
  SELECT doc_id, attack_class, row_number() OVER (PARTITION BY attack_class ORDER BY md5(CAST(doc_id AS VARCHAR) || ':3')) AS rn
  FROM suite) WHERE attack_class NOT IN ('benign', 'harmful_content') OR rn <= 40"""

TOP_COLLISIONS = f"""
WITH {o_vectors.PHRASES_CTE},
{o_vectors.PHRASES_NN}
SELECT vec_id, nn_id, round(sim, 6) AS sim, label, nn_label FROM nn WHERE label <> nn_label
ORDER BY round(sim, 6) DESC, vec_id LIMIT 8"""

ORACLE = {
    "run_summary": RUN_SUMMARY,
    "benign_cap_suite": BENIGN_CAP,
    "stratified_sample": STRATIFIED,
    "top_collisions": TOP_COLLISIONS,
    "exact_cache_lookup": EXACT,
    "fuzzy_cache_lookup": FUZZY,
    "cache_speedup": SPEEDUP,
    "safe_harbour_impact": HARBOUR,
    "anchor_set_ablation": ABLATION,
    "grounding_check": GROUNDING,
    "breaker_open_state": OPEN_STATE,
    "category_coverage": COVERAGE,
    "decision_accuracy": ACCURACY,
    "latency_exclusive_percentiles": EXCLUSIVE,
    "event_counters": COUNTERS,
}
