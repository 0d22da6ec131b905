"""DuckDB formulations for :mod:`riskframe.plans.q_eval`."""
from __future__ import annotations

from riskframe import config as C

EV = """s AS (SELECT event_id, ts, user_id, value AS score, CAST(event_type = 'error' AS INTEGER) AS label,
              CAST(CAST(json_extract(props, '$.k') AS INTEGER) // 25 AS INTEGER) AS k_band FROM events)"""

GROUPS = """g AS (SELECT k_band, score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg
              FROM s GROUP BY k_band, score),
c AS (SELECT *, sum(pos) OVER (PARTITION BY k_band ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
             sum(neg) OVER (PARTITION BY k_band ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
             sum(pos) OVER (PARTITION BY k_band) AS P, sum(neg) OVER (PARTITION BY k_band) AS N FROM g)"""

ROC_AUC = f"""
WITH {EV},
r AS (SELECT k_band, label, rank() OVER (PARTITION BY k_band ORDER BY score) AS rk,
             count(*) OVER (PARTITION BY k_band, score) AS tie FROM s WHERE score IS NOT NULL),
a AS (SELECT k_band, sum(CASE WHEN label = 1 THEN rk + (tie - 1) / 2.0 ELSE 0 END) AS rs,
             CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(1 - label) AS BIGINT) AS n_neg FROM r GROUP BY k_band)
SELECT k_band, CASE WHEN n_pos > 0 AND n_neg > 0
       THEN (rs - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) ELSE 'NaN'::DOUBLE END AS auc, n_pos, n_neg
FROM a"""

ROC_POINTS = f"""
WITH {EV}, {GROUPS}
SELECT k_band, score AS threshold, fp / N AS fpr, tp / P AS tpr FROM c WHERE P > 0 AND N > 0
UNION ALL
SELECT DISTINCT k_band, 'inf'::DOUBLE AS threshold, 0.0 AS fpr, 0.0 AS tpr FROM c WHERE P > 0 AND N > 0"""

PR_POINTS = f"""
WITH {EV}, {GROUPS}
SELECT k_band, score AS threshold, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
       tp / P AS recall FROM c WHERE P > 0"""

RECALL_AT_FPR = f"""
WITH {EV}, {GROUPS},
pts AS (SELECT k_band, fp / N AS fpr, tp / P AS tpr, score AS threshold FROM c WHERE P > 0 AND N > 0
        UNION ALL SELECT DISTINCT k_band, 0.0, 0.0, 'inf'::DOUBLE FROM c WHERE P > 0 AND N > 0),
f AS (SELECT * FROM pts WHERE fpr <= {C.DEFAULT_FPR_BUDGET}),
b AS (SELECT k_band, tpr, threshold, row_number() OVER (PARTITION BY k_band ORDER BY tpr DESC, threshold DESC) AS rn FROM f)
SELECT k_band, tpr AS recall, threshold FROM b WHERE rn = 1"""

THRESHOLD_RANK = f"""
WITH {EV},
n AS (SELECT k_band, score, row_number() OVER (PARTITION BY k_band ORDER BY score DESC) - 1 AS rk,
             count(*) OVER (PARTITION BY k_band) AS nn FROM s WHERE label = 0 AND score IS NOT NULL),
k AS (SELECT DISTINCT k_band, nn, least(CAST(floor(nn * {C.DEFAULT_FPR_BUDGET}) AS BIGINT), nn - 1) AS kk FROM n),
keys AS (SELECT DISTINCT k_band FROM s WHERE score IS NOT NULL)
SELECT keys.k_band, coalesce(n.score, 'inf'::DOUBLE) AS threshold
FROM keys LEFT JOIN k ON keys.k_band = k.k_band LEFT JOIN n ON n.k_band = k.k_band AND n.rk = k.kk"""

TRAPEZOID = f"""
WITH {EV}, {GROUPS},
pts AS (SELECT k_band, score, fp / N AS fpr, tp / P AS tpr FROM c WHERE P > 0 AND N > 0
        UNION ALL SELECT DISTINCT k_band, 'inf'::DOUBLE, 0.0, 0.0 FROM c WHERE P > 0 AND N > 0),
o AS (SELECT *, lag(fpr) OVER (PARTITION BY k_band ORDER BY score DESC) AS pf,
             lag(tpr) OVER (PARTITION BY k_band ORDER BY score DESC) AS pt FROM pts)
SELECT k_band, round(sum(coalesce((fpr - pf) * (tpr + pt) / 2.0, 0.0)), 9) AS area FROM o GROUP BY k_band"""


def _confusion(src: str, key: str, pred: str) -> str:
    return f"""
SELECT {key},
  CAST(count(*) FILTER (WHERE label = 1 AND {pred}) AS BIGINT) AS TP,
  CAST(count(*) FILTER (WHERE label = 0 AND {pred}) AS BIGINT) AS FP,
  CAST(count(*) FILTER (WHERE label = 0 AND NOT ({pred})) AS BIGINT) AS TN,
  CAST(count(*) FILTER (WHERE label = 1 AND NOT ({pred})) AS BIGINT) AS FN
FROM {src} GROUP BY {key}"""


def _derived(inner: str) -> str:
    return f"""
SELECT *,
  CASE WHEN TP + FP + TN + FN > 0 THEN (TP + TN) / (TP + FP + TN + FN) ELSE 0.0 END AS accuracy,
  CASE WHEN TP + FP > 0 THEN TP / (TP + FP) ELSE 0.0 END AS precision,
  CASE WHEN TP + FN > 0 THEN TP / (TP + FN) ELSE 0.0 END AS recall,
  CASE WHEN (CASE WHEN TP + FP > 0 THEN TP / (TP + FP) ELSE 0.0 END) + (CASE WHEN TP + FN > 0 THEN TP / (TP + FN) ELSE 0.0 END) > 0
       THEN 2 * (CASE WHEN TP + FP > 0 THEN TP / (TP + FP) ELSE 0.0 END) * (CASE WHEN TP + FN > 0 THEN TP / (TP + FN) ELSE 0.0 END)
            / ((CASE WHEN TP + FP > 0 THEN TP / (TP + FP) ELSE 0.0 END) + (CASE WHEN TP + FN > 0 THEN TP / (TP + FN) ELSE 0.0 END))
       ELSE 0.0 END AS f1,
  CASE WHEN FP + TN > 0 THEN FP / (FP + TN) ELSE 0.0 END AS fpr
FROM ({inner})"""


CONFUSION = f"WITH {EV}" + _derived(_confusion("s", "k_band", "coalesce(score >= 200.0, false)"))

EVAL_SLICES = f"""
WITH {EV.replace('FROM events)', ', CAST(dayofweek(ts) + 1 AS INTEGER) AS etype_day FROM events)')},
sv AS (SELECT * FROM s WHERE score IS NOT NULL),
r AS (SELECT etype_day, label, rank() OVER (PARTITION BY etype_day ORDER BY score) AS rk,
             count(*) OVER (PARTITION BY etype_day, score) AS tie FROM sv),
a AS (SELECT etype_day, sum(CASE WHEN label = 1 THEN rk + (tie - 1) / 2.0 ELSE 0 END) AS rs,
             CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(1 - label) AS BIGINT) AS n_neg FROM r GROUP BY etype_day),
g AS (SELECT etype_day, score, sum(label) AS pos, sum(1 - label) AS neg FROM sv GROUP BY etype_day, score),
c AS (SELECT *, sum(pos) OVER (PARTITION BY etype_day ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
             sum(neg) OVER (PARTITION BY etype_day ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
             sum(pos) OVER (PARTITION BY etype_day) AS P, sum(neg) OVER (PARTITION BY etype_day) AS N FROM g),
pts AS (SELECT etype_day, fp / N AS fpr, tp / P AS tpr, score AS threshold FROM c WHERE P > 0 AND N > 0
        UNION ALL SELECT DISTINCT etype_day, 0.0, 0.0, 'inf'::DOUBLE FROM c WHERE P > 0 AND N > 0),
b AS (SELECT etype_day, tpr, threshold, row_number() OVER (PARTITION BY etype_day ORDER BY tpr DESC, threshold DESC) AS rn
      FROM pts WHERE fpr <= {C.DEFAULT_FPR_BUDGET}),
cm AS ({_derived(_confusion("sv", "etype_day", "score >= 200.0"))})
SELECT a.etype_day,
       CASE WHEN n_pos > 0 AND n_neg > 0 THEN (rs - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) ELSE 'NaN'::DOUBLE END AS auc,
       n_pos, n_neg, b.tpr AS recall, b.threshold AS threshold_at_budget,
       n_pos + n_neg AS n, (n_pos + n_neg) < {C.UNDERPOWERED_N} AS underpowered,
       CASE WHEN n_pos = 0 THEN 'no positives: FPR only' WHEN n_neg = 0 THEN 'no negatives: recall only' END AS note,
       cm.TP, cm.FP, cm.TN, cm.FN, cm.recall AS recall_at_threshold, cm.fpr AS fpr_at_threshold
FROM a LEFT JOIN b ON a.etype_day = b.etype_day AND b.rn = 1 LEFT JOIN cm ON a.etype_day = cm.etype_day"""


def _bootstrap(budget: float | None = None) -> str:
    from riskframe.plans.o_detect import boot_sql
    return f"""
WITH base AS (SELECT d.doc_id AS id, d.lang, CAST(d.n_chars AS DOUBLE) AS score, l.toxic AS label
              FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT * FROM {boot_sql('base', ['lang'], 50, 0.05, 0, budget)}"""


ORACLE = {
    "roc_auc_by_slice": ROC_AUC,
    "roc_points": ROC_POINTS,
    "pr_points": PR_POINTS,
    "recall_at_fpr": RECALL_AT_FPR,
    "threshold_at_fpr_rank": THRESHOLD_RANK,
    "roc_trapezoid": TRAPEZOID,
    "confusion_at_threshold": CONFUSION,
    "evaluate_slices": EVAL_SLICES,
    "bootstrap_auc_ci": _bootstrap(),
    "bootstrap_recall_ci": _bootstrap(C.DEFAULT_FPR_BUDGET),
}
