"""DuckDB formulations for :mod:`riskframe.plans.q_ops`."""
from __future__ import annotations

from riskframe import config as C
from riskframe.operators.folds import bucket_parameters
from riskframe.plans import bound
from riskframe.plans import q_ops as Q
from riskframe.plans.sqlfrag import normalize_ctes, q, redaction_ctes, symbolic_case


def _policy_values(policy: dict) -> str:
    rows = [(t, c, r, a) for t, caps in policy.items() for c, risks in caps.items() for r, a in risks.items()
            if a in C.ACTIONS]
    return ", ".join(f"({q(t)}, {q(c)}, {q(r)}, {q(a)})" for t, c, r, a in rows)


POLICY = f"""
WITH g AS (SELECT sha256(CAST(c_custkey AS VARCHAR)) AS key_hash,
             CASE WHEN c_mktsegment = 'MACHINERY' THEN 'INTERNAL' WHEN c_mktsegment = 'BUILDING' THEN 'ELEVATED'
                  WHEN c_mktsegment = 'HOUSEHOLD' THEN 'general' ELSE 'GENERAL' END AS capability,
             'nation_' || CAST(c_nationkey AS VARCHAR) AS tenant FROM customer WHERE c_acctbal >= 0),
gv AS (SELECT * FROM g WHERE capability IN ('GENERAL', 'ELEVATED', 'INTERNAL')),
req AS (SELECT o_orderkey, sha256(CAST(o_custkey AS VARCHAR)) AS h,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HIGH' WHEN o_orderpriority = '3-MEDIUM' THEN 'MEDIUM'
                    ELSE 'LOW' END AS risk FROM orders),
p AS (SELECT req.*, coalesce(gv.capability, 'GENERAL') AS capability, coalesce(gv.tenant, 'default') AS tenant
      FROM req LEFT JOIN gv ON req.h = gv.key_hash),
t AS (SELECT 'nation_' || CAST(n_nationkey AS VARCHAR) AS tenant_id,
             CASE WHEN n_regionkey = 4 THEN 'suspended' ELSE 'active' END AS status FROM nation),
pt AS (SELECT p.*, coalesce(t.status, 'active') AS tenant_status FROM p LEFT JOIN t ON p.tenant = t.tenant_id),
pol(p_tenant, p_capability, p_risk, p_action) AS (VALUES {_policy_values(Q.OVERRIDE_POLICY)}),
r AS (SELECT pt.*, CASE WHEN pt.tenant IN (SELECT p_tenant FROM pol) THEN pt.tenant ELSE 'default' END AS tr FROM pt),
x AS (SELECT r.*, EXISTS (SELECT 1 FROM pol WHERE p_tenant = r.tr AND p_capability = r.capability) AS cap_ok,
             (SELECT any_value(p_action) FROM pol WHERE p_tenant = r.tr AND p_capability = r.capability AND p_risk = r.risk) AS act,
             CASE WHEN r.tr = r.tenant THEN r.tr ELSE r.tenant || ' -> ' || r.tr || ' (fallback)' END AS note FROM r)
SELECT tenant, capability, risk,
       CASE WHEN tenant_status = 'suspended' THEN 'REJECT' WHEN NOT cap_ok THEN '{C.DEFAULT_ACTION}'
            ELSE coalesce(act, '{C.DEFAULT_ACTION}') END AS action,
       CASE WHEN NOT cap_ok THEN 'Role ''' || capability || ''' not defined for tenant ''' || note || ''''
            ELSE 'Policy applied for ' || capability || ' (Risk: ' || risk || ', Tenant: ' || note || ')' END AS reason,
       CAST(count(*) AS BIGINT) AS n
FROM x GROUP BY ALL"""


def _combined() -> str:
    pa, pa_out = redaction_ctes("pairs", "prompt", "conv_id, turn, prompt, response", prefix="pa")
    pb, pb_out = redaction_ctes("pa_mid", "response", "conv_id, turn, prompt, clean_prompt, prompt_items, response", prefix="pb")
    nz, nz_out = normalize_ctes(pb_out, "clean_prompt")
    return f"""
WITH pairs AS (SELECT p.conv_id, p.turn, p.text AS prompt, r.text AS response
               FROM conversations p LEFT JOIN conversations r
               ON r.conv_id = p.conv_id AND r.turn = p.turn + 1 AND r.role = 'assistant' WHERE p.role = 'user'),
{pa},
pa_mid AS (SELECT conv_id, turn, prompt, response, clean_text AS clean_prompt, redacted_items AS prompt_items FROM {pa_out}),
{pb},
{nz},
g AS (SELECT *, list_distinct(regexp_extract_all(lower(response), '[a-z]+')) AS said,
             list_distinct(regexp_extract_all(lower(prompt), '[a-z]+')) AS asked FROM {nz_out}),
d AS (SELECT conv_id, turn, response,
             CASE WHEN len(redacted_items) > 0 THEN 'pii_leakage' WHEN contains(lower(response), 'ing the') THEN 'semantic_judge_output'
                  WHEN len(said) > 0 AND len(list_intersect(said, asked)) / len(said) < {Q.OUTPUT_GROUNDING} THEN 'semantic_grounding_check'
                  ELSE 'clean_pass' END AS found,
             CASE WHEN ({symbolic_case('normalized', bound.RULES)}) IS NOT NULL THEN 'BLOCK' ELSE 'ALLOW' END AS prompt_decision
      FROM g),
o AS (SELECT *, CASE WHEN prompt_decision <> 'BLOCK' AND response IS NOT NULL THEN
                  CASE WHEN found <> 'clean_pass' THEN 'BLOCK' ELSE 'ALLOW' END END AS output_decision,
                CASE WHEN prompt_decision <> 'BLOCK' AND response IS NOT NULL THEN found END AS output_source FROM d)
SELECT conv_id, turn, prompt_decision, output_decision, output_source,
       CASE WHEN output_decision IS NULL THEN prompt_decision
            WHEN (CASE output_decision WHEN 'BLOCK' THEN 2 WHEN 'RESTRICT' THEN 1 ELSE 0 END)
               > (CASE prompt_decision WHEN 'BLOCK' THEN 2 WHEN 'RESTRICT' THEN 1 ELSE 0 END)
            THEN output_decision ELSE prompt_decision END AS final_decision
FROM o"""


VLOG = """v AS (SELECT event_id, ts, user_id, event_type, value,
  CASE WHEN event_type = 'error' THEN 'BLOCK' WHEN event_type = 'signup' THEN 'RESTRICT' ELSE 'ALLOW' END AS decision,
  CASE WHEN value >= 300 THEN 'HIGH' WHEN value >= 100 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  CASE WHEN event_type = 'view' THEN 'cache' WHEN event_type = 'click' THEN 'clean_pass'
       WHEN event_type = 'purchase' THEN 'fusion_clean_pass' ELSE event_type END AS source,
  'k' || CAST(CAST(CAST(json_extract(props, '$.k') AS INTEGER) // 25 AS INTEGER) AS VARCHAR) AS tenant FROM events)"""

KNOWN = "(" + ", ".join(q(s) for s in C.KNOWN_SOURCES) + ")"

COUNTERS = f"""
WITH {VLOG}
SELECT 'assessments' AS counter, decision, risk_level,
       CASE WHEN source IN {KNOWN} THEN source ELSE 'other' END AS label, CAST(count(*) AS BIGINT) AS n
FROM v GROUP BY ALL
UNION ALL
SELECT 'tenant_decisions', decision, NULL, tenant, CAST(count(*) AS BIGINT) FROM v GROUP BY decision, tenant"""

UNKNOWN = f"""
WITH {VLOG}
SELECT substr(coalesce(source, 'None'), 1, {C.UNKNOWN_SOURCE_TRUNCATE}) AS source, CAST(count(*) AS BIGINT) AS n
FROM v WHERE source IS NULL OR source NOT IN {KNOWN} GROUP BY 1"""

PCT = """
WITH s AS (SELECT event_type, count(value) AS n, avg(value) AS avg, min(value) AS min, max(value) AS max,
                  list_sort(list(value) FILTER (WHERE value IS NOT NULL)) AS xs FROM events GROUP BY event_type)
SELECT event_type, CAST(n AS BIGINT) AS n, round(avg, 6) AS avg, min, max,
       xs[least(CAST(floor(n * 0.5) AS BIGINT), n - 1) + 1] AS p50,
       xs[least(CAST(floor(n * 0.95) AS BIGINT), n - 1) + 1] AS p95,
       xs[least(CAST(floor(n * 0.99) AS BIGINT), n - 1) + 1] AS p99 FROM s"""

PCT_M1 = """
WITH s AS (SELECT event_type, count(value) AS n, list_sort(list(value) FILTER (WHERE value IS NOT NULL)) AS xs
           FROM events GROUP BY event_type)
SELECT event_type, CAST(n AS BIGINT) AS n,
       CASE WHEN n >= 20 THEN xs[CAST(floor(n * 0.95) AS BIGINT) - 1 + 1] ELSE xs[n] END AS p95 FROM s"""

BOUNDS = "[" + ", ".join(repr(float(b)) for b in C.LATENCY_BUCKETS) + "]::DOUBLE[]"
NB = len(C.LATENCY_BUCKETS)

HIST_CTE = f"""obs AS (SELECT event_type AS stage, len(list_filter({BOUNDS}, lambda b: b < value / 1000.0)) AS bi
        FROM events WHERE value IS NOT NULL AND value >= 0),
st AS (SELECT DISTINCT stage FROM obs),
bk AS (SELECT range AS bi FROM range(0, {NB + 1})),
h AS (SELECT st.stage, bk.bi, CASE WHEN bk.bi < {NB} THEN ({BOUNDS})[bk.bi + 1] ELSE 'inf'::DOUBLE END AS le,
             (SELECT count(*) FROM obs WHERE obs.stage = st.stage AND obs.bi <= bk.bi) AS cum_count
      FROM st CROSS JOIN bk)"""

HIST = f"""
WITH {HIST_CTE}
SELECT stage, le, CAST(cum_count AS BIGINT) AS cum_count FROM h"""


def _hq(qv: float, name: str) -> str:
    return f"""{name} AS (
  SELECT stage, arg_min(CASE WHEN le = 'inf'::DOUBLE THEN prev_le WHEN cum_count - prev_cum <= 0 THEN le
                             ELSE prev_le + (le - prev_le) * ({qv} * total - prev_cum) / (cum_count - prev_cum) END, bi) AS {name}
  FROM hh WHERE total > 0 AND cum_count >= {qv} * total GROUP BY stage)"""


HQ = f"""
WITH {HIST_CTE},
hh AS (SELECT *, coalesce(lag(cum_count) OVER (PARTITION BY stage ORDER BY bi), 0) AS prev_cum,
              coalesce(lag(le) OVER (PARTITION BY stage ORDER BY bi), 0.0) AS prev_le,
              max(cum_count) OVER (PARTITION BY stage) AS total FROM h),
{_hq(0.5, 'p50')}, {_hq(0.95, 'p95')}, {_hq(0.99, 'p99')}
SELECT st.stage, round(p50.p50, 9) AS p50, round(p95.p95, 9) AS p95, round(p99.p99, 9) AS p99
FROM st LEFT JOIN p50 ON st.stage = p50.stage LEFT JOIN p95 ON st.stage = p95.stage LEFT JOIN p99 ON st.stage = p99.stage"""

RATE = """
WITH w AS (SELECT time_bucket(INTERVAL '1 minute', ts) - to_minutes(k) AS window_start, event_type
           FROM events, (SELECT unnest(range(0, 5)) AS k))
SELECT window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(count(*) / 300.0, 9) AS rate
FROM w GROUP BY ALL"""

RATE_DIM = f"""
WITH {VLOG},
s AS (SELECT *, CASE WHEN source IN {KNOWN} THEN source ELSE 'other' END AS ssource FROM v),
w AS (SELECT time_bucket(INTERVAL '1 minute', ts) - to_minutes(k) AS ws, decision, ssource, tenant, event_type
      FROM s, (SELECT unnest(range(0, 5)) AS k)),
g AS (SELECT ws, decision, ssource, tenant, event_type, GROUPING(ws, decision, ssource, tenant, event_type) AS gid, count(*) AS n
      FROM w GROUP BY GROUPING SETS ((ws, decision), (ws, ssource), (ws, tenant), (ws, event_type)))
SELECT ws AS window_start,
       CASE gid WHEN 7 THEN 'decision' WHEN 11 THEN 'source' WHEN 13 THEN 'tenant' ELSE 'endpoint' END AS dimension,
       CASE gid WHEN 7 THEN decision WHEN 11 THEN ssource WHEN 13 THEN tenant ELSE event_type END AS value,
       CAST(n AS BIGINT) AS n, round(n / 300.0, 9) AS rate FROM g"""

CONC = """
WITH d AS (SELECT event_id AS rid, ts AS t, 1 AS d FROM events
           UNION ALL
           SELECT event_id, ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)), -1 FROM events),
lv AS (SELECT *, date_trunc('hour', t) AS b, sum(d) OVER (ORDER BY t, d, rid ROWS UNBOUNDED PRECEDING) AS level FROM d),
f AS (SELECT b, arg_min(level - d, (t, d, rid)) AS level_in, max(level) AS max_level,
             count(*) FILTER (WHERE d = 1) AS n_starts FROM lv GROUP BY b)
SELECT b AS bucket_start, CAST(n_starts AS BIGINT) AS n_starts, CAST(greatest(level_in, max_level) AS BIGINT) AS peak FROM f"""

CAP, REFILL = bucket_parameters(Q.QUOTA_RPM, Q.QUOTA_BURST_SECONDS)
TK = (f"(CASE WHEN (e.t - r.last) / 1e6 > 0 THEN least(CAST({CAP!r} AS DOUBLE), r.tokens + ((e.t - r.last) / 1e6) "
      f"* CAST({REFILL!r} AS DOUBLE)) ELSE r.tokens END)")

QUOTA = f"""
WITH RECURSIVE ev AS (SELECT event_id, user_id, epoch_us(ts) AS t,
                             row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events),
r AS (SELECT user_id, rn, event_id, t AS last, CAST({CAP!r} AS DOUBLE) - 1.0 AS tokens, true AS allowed,
             CAST(0.0 AS DOUBLE) AS retry FROM ev WHERE rn = 1
      UNION ALL
      SELECT e.user_id, e.rn, e.event_id,
             CASE WHEN (e.t - r.last) / 1e6 > 0 THEN e.t ELSE r.last END,
             CASE WHEN {TK} >= 1.0 THEN {TK} - 1.0 ELSE {TK} END,
             {TK} >= 1.0,
             CASE WHEN {TK} >= 1.0 THEN CAST(0.0 AS DOUBLE) ELSE (1.0 - {TK}) / CAST({REFILL!r} AS DOUBLE) END
      FROM r JOIN ev e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT event_id, user_id, allowed, round(retry, 6) AS retry_after FROM r"""

TKP = ("(CASE WHEN (e.t - r.last) / 1e6 > 0 THEN least(e.cap, r.tokens + ((e.t - r.last) / 1e6) * e.rate) "
       "ELSE r.tokens END)")

QUOTA_PRINCIPAL = f"""
WITH RECURSIVE p0 AS (
  SELECT e.event_id, epoch_us(e.ts) AS t,
         c.c_name IS NOT NULL AS authenticated,
         CASE WHEN c.c_name IS NOT NULL THEN 'key:' || c.c_name ELSE 'ip:user-' || CAST(e.user_id AS VARCHAR) END AS identity,
         CASE WHEN c.c_name IS NOT NULL THEN coalesce(CASE WHEN n.n_regionkey = 0 THEN 30.0 END, {C.KEYED_RPM!r})
              ELSE {C.ANONYMOUS_RPM!r} END AS rpm
  FROM events e LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) c ON e.user_id = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey),
ev AS (SELECT *, CAST(rpm AS DOUBLE) / CAST({Q.QUOTA_SLOWDOWN!r} AS DOUBLE) / 60.0 AS rate,
              greatest(CAST(1.0 AS DOUBLE), (CAST(rpm AS DOUBLE) / CAST({Q.QUOTA_SLOWDOWN!r} AS DOUBLE) / 60.0) * {float(C.BURST_SECONDS)!r}) AS cap,
              row_number() OVER (PARTITION BY identity ORDER BY t, event_id) AS rn FROM p0),
r AS (SELECT identity, rn, event_id, t AS last, cap - 1.0 AS tokens, true AS allowed, CAST(0.0 AS DOUBLE) AS retry
      FROM ev WHERE rn = 1
      UNION ALL
      SELECT e.identity, e.rn, e.event_id, CASE WHEN (e.t - r.last) / 1e6 > 0 THEN e.t ELSE r.last END,
             CASE WHEN {TKP} >= 1.0 THEN {TKP} - 1.0 ELSE {TKP} END,
             {TKP} >= 1.0,
             CASE WHEN {TKP} >= 1.0 THEN CAST(0.0 AS DOUBLE) ELSE (1.0 - {TKP}) / e.rate END
      FROM r JOIN ev e ON e.identity = r.identity AND e.rn = r.rn + 1)
SELECT event_id, identity, allowed, round(retry, 6) AS retry_after,
       CASE WHEN NOT allowed THEN greatest(1, CAST(floor(retry + 0.999) AS INTEGER)) END AS retry_header FROM r"""

TTL_US = int(round(Q.TTL * 1_000_000))

REUSE = f"""
WITH RECURSIVE ev AS (SELECT event_id, sha256(CAST(user_id AS VARCHAR) || ':' || event_type) AS h, epoch_us(ts) AS t,
                             row_number() OVER (PARTITION BY sha256(CAST(user_id AS VARCHAR) || ':' || event_type)
                                                ORDER BY epoch_us(ts), event_id) AS rn FROM events),
r AS (SELECT h, rn, event_id, false AS hit, t AS wt, event_id AS origin FROM ev WHERE rn = 1
      UNION ALL
      SELECT e.h, e.rn, e.event_id, e.t - r.wt < {TTL_US},
             CASE WHEN e.t - r.wt < {TTL_US} THEN r.wt ELSE e.t END,
             CASE WHEN e.t - r.wt < {TTL_US} THEN r.origin ELSE e.event_id END
      FROM r JOIN ev e ON e.h = r.h AND e.rn = r.rn + 1)
SELECT event_id, h AS prompt_hash, hit, origin AS origin_id FROM r"""

CD_US = int(round(Q.BREAKER_COOLDOWN * 1_000_000))
TH = C.BREAKER_FAILURE_THRESHOLD
SKIP = f"(r.opened IS NOT NULL AND e.t - r.opened < {CD_US})"
F0 = "(CASE WHEN r.opened IS NOT NULL THEN 0 ELSE r.fails END)"

BREAKER = f"""
WITH RECURSIVE ev AS (SELECT event_id, user_id, epoch_us(ts) AS t, event_type <> 'error' AS ok,
                             row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events),
r AS (SELECT user_id, rn, event_id, CASE WHEN ok THEN 0 ELSE 1 END AS fails,
             CASE WHEN NOT ok AND 1 >= {TH} THEN t END AS opened, false AS skipped FROM ev WHERE rn = 1
      UNION ALL
      SELECT e.user_id, e.rn, e.event_id,
             CASE WHEN {SKIP} THEN r.fails WHEN e.ok THEN 0 ELSE {F0} + 1 END,
             CASE WHEN {SKIP} THEN r.opened WHEN e.ok THEN NULL WHEN {F0} + 1 >= {TH} THEN e.t ELSE NULL END,
             {SKIP}
      FROM r JOIN ev e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT event_id, user_id, skipped, opened IS NOT NULL AS open_after, CAST(fails AS INTEGER) AS failures_after FROM r"""

ORACLE = {
    "policy_decision": POLICY,
    "combined_output_decision": _combined(),
    "outcome_counters": COUNTERS,
    "unknown_source_counter": UNKNOWN,
    "latency_index_percentiles": PCT,
    "latency_minus_one_percentile": PCT_M1,
    "stage_histogram": HIST,
    "stage_histogram_quantile": HQ,
    "rate_5m": RATE,
    "rate_5m_by_dimension": RATE_DIM,
    "concurrency_peak": CONC,
    "quota_token_bucket": QUOTA,
    "quota_by_principal": QUOTA_PRINCIPAL,
    "verdict_reuse_within_ttl": REUSE,
    "verdict_reuse_doubling": REUSE,
    "failure_run_intervals": BREAKER,
}
