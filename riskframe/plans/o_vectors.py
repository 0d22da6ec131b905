"""DuckDB formulations for :mod:`riskframe.plans.q_vectors`."""
from __future__ import annotations

from riskframe import config as C
from riskframe.operators.cascade import load_policy
from riskframe.plans.q_vectors import CLASS_LABELS, DOMAIN_LABEL, EDU_LABELS, META_LABELS, REWORDED

R = 6


def _in(labs) -> str:
    return "(" + ", ".join(str(x) for x in labs) + ")"


THREAT = [x for labs in CLASS_LABELS.values() for x in labs]

SIG = f"""e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
a AS (SELECT label AS alabel, arg_min(v, vec_id) AS av FROM e GROUP BY label),
sims AS (SELECT e.vec_id, a.alabel, list_cosine_similarity(e.v, a.av) AS cs FROM e CROSS JOIN a),
ms AS (SELECT vec_id,
   coalesce(max(cs) FILTER (WHERE alabel IN {_in(THREAT)}), 0.0) AS threat_score,
   greatest(coalesce(max(cs) FILTER (WHERE alabel IN {_in(META_LABELS)}), 0.0), 0.0) AS meta_intent_score,
   coalesce(max(cs) FILTER (WHERE alabel IN {_in(EDU_LABELS)}), 0.0) AS educational_score,
   coalesce(max(cs) FILTER (WHERE alabel IN {_in(EDU_LABELS)}), 0.0) > {C.EDUCATIONAL_THRESHOLD} AS is_educational,
   {", ".join(f"coalesce(max(cs) FILTER (WHERE alabel IN {_in(labs)}), 0.0) AS {cls}_score" for cls, labs in CLASS_LABELS.items())}
   FROM sims GROUP BY vec_id),
ce AS (SELECT i, avg(x) AS x FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e WHERE label = {DOMAIN_LABEL}) GROUP BY i),
cen AS (SELECT list(x ORDER BY i) AS c FROM ce),
sig AS (SELECT ms.*, e.label, list_cosine_similarity(e.v, cen.c) AS domain_score,
               list_cosine_similarity(e.v, cen.c) >= {C.DOMAIN_THRESHOLD} AS domain_aligned,
               CAST(e.label <= 6 AS INTEGER) AS attack, false AS symbolic
        FROM ms JOIN e ON ms.vec_id = e.vec_id CROSS JOIN cen)"""

ANCHOR = f"""
WITH {SIG}
SELECT vec_id, round(threat_score, {R}) AS threat_score, round(meta_intent_score, {R}) AS meta_intent_score,
       is_educational, round(domain_score, {R}) AS domain_score, domain_aligned FROM sig"""

CENTROID = f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ce AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY label, i),
cen AS (SELECT label, list(x ORDER BY i) AS c FROM ce GROUP BY label),
ncen AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y))))  AS nc FROM cen)
SELECT e.vec_id, e.label, round(list_cosine_similarity(e.v, cen.c), {R}) AS centroid_sim,
       round(list_dot_product(list_transform(e.v, lambda x: x / sqrt(list_sum(list_transform(e.v, lambda y: y * y)))), ncen.nc), {R})
         AS unit_centroid_dot
FROM e JOIN cen ON e.label = cen.label JOIN ncen ON e.label = ncen.label"""

NN_CTE = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT x.vec_id, x.label, y.vec_id AS nn_id, y.label AS nn_label, list_cosine_similarity(x.v, y.v) AS sim,
             row_number() OVER (PARTITION BY x.vec_id ORDER BY list_cosine_similarity(x.v, y.v) DESC, y.vec_id) AS rn
      FROM e x JOIN e y ON x.vec_id <> y.vec_id),
nn AS (SELECT * FROM p WHERE rn = 1)"""

NN = f"""
WITH {NN_CTE}
SELECT vec_id, nn_id, round(sim, {R}) AS sim, label = nn_label AS same_label FROM nn"""

PHRASES_CTE = f"""e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ph AS (SELECT vec_id, label, v FROM e UNION ALL
       SELECT -1 - vec_id, CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END,
              list_transform(v, lambda x, i: x * (1 + {REWORDED}[CAST(vec_id % {len(REWORDED)} + 1 AS INTEGER)] * CASE WHEN i % 2 = 1 THEN 1.0 ELSE -1.0 END)) FROM e)"""

PHRASES_NN = """p AS (SELECT x.vec_id, x.label, y.vec_id AS nn_id, y.label AS nn_label, list_cosine_similarity(x.v, y.v) AS sim,
             row_number() OVER (PARTITION BY x.vec_id ORDER BY list_cosine_similarity(x.v, y.v) DESC, y.vec_id) AS rn
      FROM ph x JOIN ph y ON x.vec_id <> y.vec_id),
nn AS (SELECT * FROM p WHERE rn = 1)"""

COLLISION = f"""
WITH {PHRASES_CTE},
{PHRASES_NN},
t AS (SELECT unnest({[float(x) for x in C.COLLISION_THRESHOLDS]}::DOUBLE[]) AS threshold),
n AS (SELECT count(*) AS n FROM ph),
agg AS (SELECT threshold, CAST(count(*) FILTER (WHERE sim >= threshold) AS BIGINT) AS n_hits,
               CAST(count(*) FILTER (WHERE sim >= threshold AND label = nn_label) AS BIGINT) AS n_same
        FROM t CROSS JOIN nn GROUP BY threshold)
SELECT threshold, n_hits,
       round(CASE WHEN n_hits > 0 THEN n_same / n_hits END, {R}) AS pct_same,
       round(1 - CASE WHEN n_hits > 0 THEN n_same / n_hits END, {R}) AS pct_diff,
       round(n_hits / n.n, {R}) AS hit_rate,
       coalesce((1 - CASE WHEN n_hits > 0 THEN n_same / n_hits END) > 0.01, false) AS unsafe
FROM agg CROSS JOIN n"""

FEATURES = {"anchors": "threat_score", "injection": "prompt_injection_score",
            "jailbreak": "jailbreak_score", "toxicity": "harmful_content_score"}


def _z(pol_part: dict, order) -> str:
    z = f"({float(pol_part['intercept'])!r})"
    for name, mu, sc, w in zip(order, pol_part["scaler_mean"], pol_part["scaler_scale"], pol_part["coefficients"]):
        term = "0.0" if not sc else f"({float(w)!r} * (({FEATURES[name]} - {float(mu)!r}) / {float(sc)!r}))"
        z = f"({z} + {term})"
    return z


def _sigmoid(z: str) -> str:
    return (f"(CASE WHEN {z} < -{C.SIGMOID_CLAMP} THEN 0.0 WHEN {z} > {C.SIGMOID_CLAMP} THEN 1.0 "
            f"ELSE 1.0 / (1.0 + exp(-{z})) END)")


POL = load_policy()
ORDER = POL["feature_order"]
CLASSES = list(POL["per_class"].keys())

FUSED = f"""
WITH {SIG}
SELECT vec_id, round({_sigmoid(_z(POL, ORDER))}, 9) AS fusion_score,
       ({" AND ".join(f"{FEATURES[f]} IS NOT NULL" for f in ORDER)}) AS fusion_available FROM sig"""


def _per_class_cte() -> str:
    cols = []
    for i, c in enumerate(CLASSES):
        p = POL["per_class"][c]
        s = _sigmoid(_z(p, ORDER))
        hi, md = float(p["threshold_high"]), float(p["threshold_medium"])
        cols.append(f"{s} AS s{i}")
        cols.append(f"CASE WHEN {s} >= {hi!r} THEN 2 WHEN {s} >= {md!r} THEN 1 ELSE 0 END AS t{i}")
        cols.append(f"{s} / {hi!r} AS r{i}" if hi else f"0.0 AS r{i}")
        cols.append(f"{hi!r} AS hi{i}, {md!r} AS md{i}")
    base = f"pc0 AS (SELECT *, {', '.join(cols)} FROM sig)"
    # winner: max (tier, ratio), first in artifact order on ties
    n = len(CLASSES)
    conds = []
    for i in range(n):
        beats = [f"(t{i} > t{j} OR (t{i} = t{j} AND r{i} {'>=' if j > i else '>'} r{j}))" for j in range(n) if j != i]
        conds.append((i, " AND ".join(beats) if beats else "true"))

    def pick(fmt):
        return "CASE " + " ".join(f"WHEN {c} THEN {fmt.format(i=i)}" for i, c in conds) + " END"
    win = (f"pc AS (SELECT *, {pick(repr_class())} AS triggering_class, {pick('s{i}')} AS w_score, "
           f"{pick('t{i}')} AS w_tier, {pick('hi{i}')} AS w_hi, {pick('md{i}')} AS w_md FROM pc0)")
    return base + ",\n" + win


def repr_class() -> str:
    return "CASE {i} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES)) + " END"


PER_CLASS = f"""
WITH {SIG},
{_per_class_cte().replace("{pick(repr_class())}", "")}
SELECT vec_id, triggering_class, round(w_score, 9) AS class_score, w_tier AS tier FROM pc"""


def _cascade_body() -> str:
    hi, md, mt = C.SEMANTIC_THRESHOLD_HIGH, C.SEMANTIC_THRESHOLD_MEDIUM, C.META_INTENT_THRESHOLD
    fa = "(" + " AND ".join(f"{FEATURES[f]} IS NOT NULL" for f in ORDER) + ")"
    fused = [
        (f"meta_intent_score >= {mt}", "HIGH", "semantic_meta_intent", "false"),
        (f"{fa} AND w_score >= w_hi", "HIGH", "fusion_threat_critical", "false"),
        (f"{fa} AND w_score >= w_md AND is_educational", "MEDIUM", "fusion_educational_safe_harbor", "false"),
        (f"{fa} AND w_score >= w_md", "MEDIUM", "fusion_judge_pending", "true"),
        (f"{fa}", "LOW", "fusion_clean_pass", "false"),
        (f"threat_score >= {hi}", "HIGH", "vector_threat_critical", "false"),
        (f"threat_score >= {md} AND is_educational", "MEDIUM", "educational_safe_harbor", "false"),
        (f"threat_score >= {md}", "MEDIUM", "judge_pending", "true"),
    ]

    def case(idx, default):
        return "CASE " + " ".join(f"WHEN {c[0]} THEN {c[idx] if idx == 3 else repr(c[idx])}" for c in fused) + \
            f" ELSE {default} END"
    band = lambda s, m, h: f"(CASE WHEN ({h}) - ({m}) <= 0 THEN true ELSE {s} >= ({m}) + (({h}) - ({m})) / 2.0 END)"
    tp = f"(CASE WHEN {fa} THEN {band('w_score', 'w_md', 'w_hi')} ELSE {band('threat_score', str(md), str(hi))} END)"
    return f"""
v0 AS (SELECT pc.*, j.judge_verdict,
   CASE WHEN meta_intent_score >= {mt} THEN 'fast_path_meta_intent' WHEN threat_score >= {hi} THEN 'fast_path_anchor_critical' END AS fast_src,
   {case(1, "'LOW'")} AS f_risk, {case(2, "'clean_pass'")} AS f_src, {case(3, 'false')} AS f_judge,
   CASE WHEN domain_aligned IS NULL THEN 'UNKNOWN' WHEN domain_aligned THEN 'IN_DOMAIN' ELSE 'OUT_OF_DOMAIN' END AS f_topic,
   {tp} AS tp
   FROM pc LEFT JOIN (SELECT vec_id, CASE WHEN label <= 3 THEN 'DANGEROUS' WHEN label <= 6 THEN 'AMBIGUOUS'
                                      WHEN label <= 8 THEN 'SAFE' END AS judge_verdict FROM embeddings) j
   ON pc.vec_id = j.vec_id),
v AS (SELECT vec_id, attack,
   CASE WHEN fast_src IS NOT NULL THEN 'HIGH' WHEN f_judge THEN
        CASE WHEN judge_verdict = 'DANGEROUS' THEN 'HIGH' WHEN judge_verdict = 'SAFE' THEN 'MEDIUM'
             WHEN judge_verdict = 'AMBIGUOUS' THEN 'MEDIUM' ELSE 'HIGH' END
        ELSE f_risk END AS risk,
   CASE WHEN fast_src IS NOT NULL THEN fast_src WHEN f_judge THEN
        CASE WHEN judge_verdict = 'DANGEROUS' THEN 'semantic_judge'
             WHEN judge_verdict = 'SAFE' THEN CASE WHEN tp THEN 'semantic_judge_override_restricted' ELSE 'semantic_judge_override_capped' END
             WHEN judge_verdict = 'AMBIGUOUS' THEN 'semantic_judge_ambiguous' ELSE 'judge_failure_fail_closed' END
        ELSE f_src END AS source,
   CASE WHEN fast_src IS NOT NULL THEN 'UNKNOWN' ELSE f_topic END AS topicality,
   fast_src IS NULL AND f_judge AS judge_invoked,
   CASE WHEN fast_src IS NOT NULL THEN NULL ELSE triggering_class END AS triggering_class
   FROM v0)"""


_PC = _per_class_cte().replace("{pick(repr_class())}", "")

CASCADE = f"""
WITH {SIG},
{_PC},
{_cascade_body()}
SELECT * FROM v"""


def _cm(view: str, pred: str) -> str:
    return f"""SELECT '{view}' AS view,
  CAST(count(*) FILTER (WHERE attack = 1 AND {pred}) AS BIGINT) AS TP,
  CAST(count(*) FILTER (WHERE attack = 0 AND {pred}) AS BIGINT) AS FP,
  CAST(count(*) FILTER (WHERE attack = 0 AND NOT ({pred})) AS BIGINT) AS TN,
  CAST(count(*) FILTER (WHERE attack = 1 AND NOT ({pred})) AS BIGINT) AS FN FROM v"""


def derived(inner: str) -> str:
    p = "(CASE WHEN TP + FP > 0 THEN TP / (TP + FP) ELSE 0.0 END)"
    r = "(CASE WHEN TP + FN > 0 THEN TP / (TP + FN) ELSE 0.0 END)"
    return f"""SELECT *, CASE WHEN TP + FP + TN + FN > 0 THEN (TP + TN) / (TP + FP + TN + FN) ELSE 0.0 END AS accuracy,
  {p} AS precision, {r} AS recall,
  CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END AS f1,
  CASE WHEN FP + TN > 0 THEN FP / (FP + TN) ELSE 0.0 END AS fpr FROM ({inner})"""


OPS_STRICT = f"""
WITH {SIG},
{_PC},
{_cascade_body()}
{derived(_cm('operational', "risk IN ('HIGH', 'MEDIUM') AND source <> 'domain_guardrail'")
         + " UNION ALL " + _cm('strict', "risk = 'HIGH' AND source <> 'domain_guardrail'"))}"""


def _grid_values():
    return C.grid_values(*C.GRID_T_MED), C.grid_values(*C.GRID_T_META)


def _grid_cte() -> str:
    tmed, tmeta = _grid_values()
    nm = len(tmeta)
    gm = ", ".join(f"({i}, CAST({v!r} AS DOUBLE))" for i, v in enumerate(tmed))
    gt = ", ".join(f"({i}, CAST({v!r} AS DOUBLE))" for i, v in enumerate(tmeta))
    return f"""gmed(b, t_med) AS (VALUES {gm}),
gmeta(a, t_meta) AS (VALUES {gt}),
grid AS (SELECT b * {nm} + a AS grid_order, t_med, t_meta FROM gmed CROSS JOIN gmeta),
cells AS (SELECT grid_order, t_med, t_meta,
   CAST(count(*) FILTER (WHERE attack = 1 AND (symbolic OR meta_intent_score >= t_meta OR threat_score >= t_med)) AS BIGINT) AS TP,
   CAST(count(*) FILTER (WHERE attack = 0 AND (symbolic OR meta_intent_score >= t_meta OR threat_score >= t_med)) AS BIGINT) AS FP,
   CAST(count(*) FILTER (WHERE attack = 0 AND NOT (symbolic OR meta_intent_score >= t_meta OR threat_score >= t_med)) AS BIGINT) AS TN,
   CAST(count(*) FILTER (WHERE attack = 1 AND NOT (symbolic OR meta_intent_score >= t_meta OR threat_score >= t_med)) AS BIGINT) AS FN
   FROM grid CROSS JOIN sig GROUP BY grid_order, t_med, t_meta),
gd AS ({derived("SELECT * FROM cells")})"""


GRID = f"""
WITH {SIG},
{_grid_cte()}
SELECT *, greatest(t_med, {C.SEMANTIC_THRESHOLD_HIGH}) AS t_high FROM gd"""

BEST = f"""
WITH {SIG},
{_grid_cte()},
g AS (SELECT *, greatest(t_med, {C.SEMANTIC_THRESHOLD_HIGH}) AS t_high FROM gd),
feas AS (SELECT * FROM g WHERE fpr <= {C.DEFAULT_FPR_BUDGET} ORDER BY recall DESC, precision DESC, grid_order LIMIT 1),
mf AS (SELECT * FROM g ORDER BY fpr, grid_order LIMIT 1),
bf AS (SELECT * FROM g ORDER BY f1 DESC, grid_order LIMIT 1),
pick AS (SELECT 'max_recall_within_budget' AS kind, * FROM feas
         UNION ALL SELECT 'min_fpr' AS kind, * FROM mf WHERE NOT EXISTS (SELECT 1 FROM feas))
SELECT kind, grid_order, t_med, t_meta, t_high, TP, FP, TN, FN, accuracy, precision, recall, f1, fpr FROM pick
UNION ALL
SELECT 'best_f1', grid_order, t_med, t_meta, t_high, TP, FP, TN, FN, accuracy, precision, recall, f1, fpr FROM bf"""

UCLS = ["harmful_content_score", "prompt_injection_score", "jailbreak_score"]

UNION = f"""
WITH {SIG},
neg AS (SELECT * FROM sig WHERE attack = 0),
gg AS (SELECT *, {", ".join(f"rank() OVER (ORDER BY {c} DESC) - 1 AS g_{c}" for c in UCLS)} FROM neg),
mm AS (SELECT least({", ".join(f"g_{c}" for c in UCLS)}) AS m FROM gg),
nn AS (SELECT count(*) AS n, CAST(floor(count(*) * {C.DEFAULT_FPR_BUDGET}) AS BIGINT) AS kmax FROM neg),
ks AS (SELECT range AS k FROM range(0, 1000000), nn WHERE range <= nn.kmax),
fl AS (SELECT k, (SELECT count(*) FROM mm WHERE m <= k) AS flagged FROM ks),
best AS (SELECT coalesce(max(k) FILTER (WHERE flagged <= {C.DEFAULT_FPR_BUDGET} * nn.n), 0) AS k FROM fl, nn),
{", ".join(f"o_{c} AS (SELECT {c} AS v, row_number() OVER (ORDER BY {c} DESC) - 1 AS rk FROM neg)" for c in UCLS)}
SELECT best.k, CAST(nn.n AS BIGINT) AS n_neg, best.k / nn.n AS alpha,
       (SELECT count(*) FROM mm WHERE m <= best.k) / nn.n AS union_fpr,
       {", ".join(f"round((SELECT v FROM o_{c} WHERE rk = least(best.k, nn.n - 1)), 9) AS thr_{c}" for c in UCLS)}
FROM best, nn"""

ORACLE = {
    "anchor_max_similarity": ANCHOR,
    "centroid_similarity": CENTROID,
    "nearest_neighbour": NN,
    "collision_sweep": COLLISION,
    "fused_score": FUSED,
    "per_class_verdict": PER_CLASS,
    "cascade_decision": CASCADE,
    "operational_vs_strict_confusion": OPS_STRICT,
    "confusion_grid_sweep": GRID,
    "best_grid_point": BEST,
    "union_fpr_budget": UNION,
}
