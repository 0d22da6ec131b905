"""DuckDB formulations for :mod:`riskframe.plans.q_detect`."""
from __future__ import annotations

from riskframe import config as C
from riskframe.plans import q_detect as Q
from riskframe.plans.sqlfrag import interval, poisson_draws, q

SUITE = """suite AS (SELECT d.doc_id, d.source, d.lang, d.text, d.n_chars, l.toxic AS label,
    CASE WHEN l.toxic = 1 AND l.quality = 0 THEN 'jailbreak' WHEN l.toxic = 1 THEN 'harmful_content' ELSE 'benign' END
      AS attack_class FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

EXPR = {
    "length": "least(CAST(1.0 AS DOUBLE), n_chars / 20000.0)",
    "digits": "length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(1, length(text))",
    "upper": "length(regexp_replace(text, '[^A-Z]', '', 'g')) / greatest(1, length(text))",
    "punct": "length(regexp_replace(text, '[^!?.,;:]', '', 'g')) / greatest(1, length(text))",
}


def _scored(src: str = "suite", names=None, extra: str = ", source, lang, label, attack_class") -> str:
    names = names or [d.name for d in Q.DETECTORS]
    return " UNION ALL ".join(f"SELECT {q(n)} AS detector, doc_id AS id, CAST({EXPR[n]} AS DOUBLE) AS score{extra} FROM {src}"
                              for n in names)


SCORED = f"{SUITE},\nscored AS ({_scored()})"
REG = ", ".join(f"({q(d.name)}, {q(s)})" for d in Q.DETECTORS for s in d.trained_on)
KEPT = f"""reg(detector, src) AS (VALUES {REG}),
kept AS (SELECT * FROM scored s WHERE NOT EXISTS (SELECT 1 FROM reg WHERE reg.detector = s.detector AND reg.src = s.source))"""


def auc_sql(src: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    return f"""(SELECT {k}, CASE WHEN n_pos > 0 AND n_neg > 0 THEN (rs - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg)
            ELSE 'NaN'::DOUBLE END AS auc, n_pos, n_neg FROM (
      SELECT {k}, sum(CASE WHEN label = 1 THEN rk + (tie - 1) / 2.0 ELSE 0 END) AS rs,
             CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(1 - label) AS BIGINT) AS n_neg
      FROM (SELECT {k}, label, rank() OVER (PARTITION BY {k} ORDER BY score) AS rk,
                   count(*) OVER (PARTITION BY {k}, score) AS tie FROM {src} WHERE score IS NOT NULL) GROUP BY {k}))"""


def recall_sql(src: str, keys: list[str], budget: float) -> str:
    k = ", ".join(keys)
    return f"""(SELECT {k}, tpr AS recall, threshold FROM (
      SELECT {k}, tpr, threshold, row_number() OVER (PARTITION BY {k} ORDER BY tpr DESC, threshold DESC) AS rn FROM (
        SELECT {k}, fp / N AS fpr, tp / P AS tpr, score AS threshold FROM (
          SELECT *, sum(pos) OVER (PARTITION BY {k} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
                 sum(neg) OVER (PARTITION BY {k} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
                 sum(pos) OVER (PARTITION BY {k}) AS P, sum(neg) OVER (PARTITION BY {k}) AS N
          FROM (SELECT {k}, score, sum(label) AS pos, sum(1 - label) AS neg FROM {src} WHERE score IS NOT NULL
                GROUP BY {k}, score)) WHERE P > 0 AND N > 0
        UNION ALL
        SELECT DISTINCT {k}, 0.0, 0.0, 'inf'::DOUBLE FROM (
          SELECT {k}, sum(label) OVER (PARTITION BY {k}) AS P, sum(1 - label) OVER (PARTITION BY {k}) AS N
          FROM {src} WHERE score IS NOT NULL) WHERE P > 0 AND N > 0) WHERE fpr <= {budget}) WHERE rn = 1)"""


def boot_sql(src: str, keys: list[str], replicates: int, alpha: float, seed: int, budget: float | None = None) -> str:
    """Poisson bootstrap per key over ``src(id, score, label, keys)``: of the
    AUC, or of the recall at ``budget`` where one is given."""
    k = ", ".join(keys)
    same = " AND ".join(f"pt.{x} = dist.{x}" for x in keys)
    point = auc_sql(src, keys)
    if budget is None:
        value = "sum(pos * (2 * (N - neg_ge) + neg)) / (2.0 * any_value(P) * any_value(N))"
    else:
        value = f"coalesce(max(pos_ge / P) FILTER (WHERE neg_ge / N <= {budget}), 0.0)"
        on = " AND ".join(f"a.{x} = r.{x}" for x in keys)
        point = (f"(SELECT {', '.join('a.' + x for x in keys)}, r.recall AS auc, a.n_pos, a.n_neg FROM {auc_sql(src, keys)} a "
                 f"LEFT JOIN {recall_sql(src, keys, budget)} r ON {on})")
    return f"""(WITH {poisson_draws(src, 'id', replicates, seed)},
g AS (SELECT {k}, rep, score, sum(w * label) AS pos, sum(w * (1 - label)) AS neg FROM rw WHERE w > 0 GROUP BY ALL),
c AS (SELECT *, sum(neg) OVER (PARTITION BY {k}, rep ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS neg_ge,
             sum(pos) OVER (PARTITION BY {k}, rep ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS pos_ge,
             sum(pos) OVER (PARTITION BY {k}, rep) AS P, sum(neg) OVER (PARTITION BY {k}, rep) AS N FROM g),
ra AS (SELECT {k}, rep, {value} AS v FROM c WHERE P > 0 AND N > 0 GROUP BY {k}, rep),
dist AS (SELECT {k}, list_sort(list(v)) AS s, count(*) AS m FROM ra GROUP BY {k}),
pt AS {point}
SELECT {', '.join('pt.' + x for x in keys)}, pt.auc AS point, {interval('s', alpha)}, pt.n_pos + pt.n_neg AS n,
       CAST(coalesce(m, 0) AS BIGINT) AS n_boot_effective, {1.0 - alpha} AS ci_level
FROM pt LEFT JOIN dist ON {same})"""


SCORES = f"WITH {SCORED}\nSELECT detector, id, round(score, 9) AS score FROM scored"

COVERAGE = f"""
WITH {SCORED},
tot AS (SELECT count(DISTINCT doc_id) AS total FROM documents),
dn AS (SELECT detector, count(DISTINCT id) AS done FROM scored WHERE id IN (SELECT doc_id FROM documents) GROUP BY detector),
reg_all(detector) AS (VALUES {", ".join(f"({q(d.name)})" for d in Q.DETECTORS)})
SELECT r.detector, CAST(coalesce(done, 0) AS BIGINT) AS done, CAST(total AS BIGINT) AS total, coalesce(done, 0) / total AS rate
FROM reg_all r LEFT JOIN dn ON r.detector = dn.detector CROSS JOIN tot"""

COMPARISON = f"""
WITH {SCORED},
{KEPT},
tot AS (SELECT detector, count(*) AS n_all FROM scored GROUP BY detector),
a AS {auc_sql('kept', ['detector'])},
r AS {recall_sql('kept', ['detector'], Q.BUDGET)},
f AS (SELECT kept.detector, count(*) FILTER (WHERE label = 0 AND score >= r.threshold) / count(*) FILTER (WHERE label = 0) AS actual_fpr
      FROM kept JOIN r ON kept.detector = r.detector GROUP BY kept.detector)
SELECT tot.detector, CAST(n_all - n_pos - n_neg AS BIGINT) AS rows_excluded, n_pos + n_neg AS n, n_pos, n_neg, auc,
       r.recall, round(r.threshold, 9) AS threshold, f.actual_fpr
FROM tot LEFT JOIN a ON tot.detector = a.detector LEFT JOIN r ON tot.detector = r.detector LEFT JOIN f ON tot.detector = f.detector"""

TARGETS = " OR ".join(
    (f"(detector = {q(d.name)} AND attack_class IN ({', '.join(q(t) for t in d.targets)}))" if d.targets
     else f"detector = {q(d.name)}") for d in Q.DETECTORS)
TARGETED = " OR ".join(f"(detector = {q(d.name)} AND attack_class IN ({', '.join(q(t) for t in d.targets)}))"
                       for d in Q.DETECTORS if d.targets)
CLS = "(" + ", ".join(q(c) for c in Q.CLASSES) + ")"

PER_CLASS = f"""
WITH {SCORED},
{KEPT},
r AS {recall_sql('kept', ['detector'], Q.BUDGET)}
SELECT kept.detector, attack_class, CAST(count(*) AS BIGINT) AS n,
       avg(CAST(score >= r.threshold AS DOUBLE)) AS detected, ({TARGETED.replace('detector', 'kept.detector')}) AS targeted
FROM kept JOIN r ON kept.detector = r.detector WHERE attack_class IN {CLS} GROUP BY kept.detector, attack_class"""

PER_LANG = f"""
WITH {SCORED},
{KEPT}
SELECT * FROM {auc_sql('kept', ['detector', 'lang'])} WHERE n_pos > 0 AND n_neg > 0 AND n_pos + n_neg >= 10"""

VS = " UNION ALL ".join(f"SELECT *, {q(c)} AS vs_class FROM scored WHERE label = 0 UNION ALL "
                        f"SELECT *, {q(c)} AS vs_class FROM scored WHERE label = 1 AND attack_class = {q(c)}"
                        for c in Q.CLASSES)
CLASS_VS_BENIGN = f"""
WITH {SCORED},
x AS ({VS})
SELECT * FROM {auc_sql('x', ['detector', 'vs_class'])}"""

POLARITY = f"""
WITH {SCORED}
SELECT detector, round(avg(score) FILTER (WHERE label = 1 AND ({TARGETS})), 9) AS mean_attack,
       round(avg(score) FILTER (WHERE label = 0), 9) AS mean_benign,
       coalesce(avg(score) FILTER (WHERE label = 1 AND ({TARGETS})) > avg(score) FILTER (WHERE label = 0), false) AS polarity_ok
FROM scored GROUP BY detector"""

ENSEMBLE = f"""
WITH {SCORED},
cfg AS (SELECT detector, id, score, label FROM scored
        UNION ALL SELECT 'max_ensemble', id, max(score), label FROM scored GROUP BY id, label),
ci AS {boot_sql('cfg', ['detector'], 50, 0.05, 0)},
best AS (SELECT arg_max(detector, point) AS bd, arg_max(ci_lo, point) AS blo, arg_max(ci_hi, point) AS bhi
         FROM ci WHERE detector <> 'max_ensemble')
SELECT ci.*, CASE WHEN ci.detector = 'max_ensemble' THEN
         CASE WHEN ci.ci_lo > best.bhi THEN 'ensemble better' WHEN ci.ci_hi < best.blo THEN 'single better' ELSE 'overlap' END
       END AS verdict,
       CASE WHEN ci.detector = 'max_ensemble' THEN best.bd END AS best_single
FROM ci CROSS JOIN best"""

QUANT = f"""
WITH {SCORED}
SELECT detector, attack_class, CAST(count(score) AS BIGINT) AS n, round(quantile_cont(score, 0.25), 9) AS p25,
       round(quantile_cont(score, 0.5), 9) AS p50, round(quantile_cont(score, 0.75), 9) AS p75
FROM scored GROUP BY detector, attack_class"""

SWEEP_SQL = f"""
WITH {SCORED},
t AS (SELECT unnest({[float(x) for x in Q.SWEEP]}::DOUBLE[]) AS threshold)
SELECT detector, attack_class, threshold, CAST(count(*) AS BIGINT) AS n, avg(CAST(score >= threshold AS DOUBLE)) AS detected
FROM scored CROSS JOIN t WHERE attack_class IN {CLS} GROUP BY ALL"""

RUN_DIFF = f"""
WITH {SCORED}
SELECT score >= 0.05 AS old, score >= 0.04 AS new, label, CAST(count(*) AS BIGINT) AS n
FROM scored WHERE detector = 'upper' GROUP BY ALL"""

MATRIX = f"""
WITH {SUITE}
SELECT doc_id AS id, {", ".join(f"round({e}, 9) AS {n}" for n, e in EXPR.items())} FROM suite WHERE lang = 'en'"""

MODEL_SCORES = """
SELECT 'vowels' AS detector, doc_id AS id, round(length(regexp_replace(text, '[^aeiou]', '', 'g')) / length(text), 9) AS score
FROM documents WHERE contains(text, '.')"""

RUNS = f"""{SCORED},
j AS (SELECT id, label, score >= 0.05 AS old, score >= 0.04 AS new FROM scored WHERE detector = 'upper')"""

FLIPPED = f"""
WITH {RUNS}
SELECT id, label, old, new, (label = 1) = new AS fixed FROM j WHERE old <> new"""


def _cells(run: str) -> str:
    rule = {"TP": f"label = 1 AND {run}", "FP": f"label = 0 AND {run}", "TN": f"label = 0 AND NOT {run}", "FN": f"label = 1 AND NOT {run}"}
    return ", ".join(f"CAST(count(*) FILTER (WHERE {r}) AS BIGINT) AS {c}_{run}" for c, r in rule.items())


CHANGE = f"""
WITH {RUNS},
k AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE old <> new) AS BIGINT) AS n_flipped, {_cells('old')}, {_cells('new')} FROM j)
SELECT *, {", ".join(f"{c}_new - {c}_old AS {c}_change" for c in ("TP", "FP", "TN", "FN"))} FROM k"""

CLASS_BUDGET = f"""
WITH {SCORED},
x AS ({VS}),
a AS {auc_sql('x', ['detector', 'vs_class'])},
r AS {recall_sql('x', ['detector', 'vs_class'], Q.BUDGET)}
SELECT a.*, r.recall, round(r.threshold, 9) AS threshold FROM a LEFT JOIN r ON a.detector = r.detector AND a.vs_class = r.vs_class"""

_COLS = "id, score, label"
REPORT_SLICES = f"""x AS (SELECT detector, 'all' AS slice, {_COLS} FROM kept
  UNION ALL SELECT detector, 'lang=' || lang, {_COLS} FROM kept
  """ + " ".join(f"UNION ALL SELECT detector, {q('class=' + c)}, {_COLS} FROM kept WHERE label = 0 OR attack_class = {q(c)}" for c in Q.CLASSES) + ")"

REPORT = f"""
WITH {SCORED},
{KEPT},
{REPORT_SLICES},
a AS (SELECT * FROM {boot_sql('x', ['detector', 'slice'], Q.REPORT_REPLICATES, 0.05, 0)}),
r AS (SELECT * FROM {boot_sql('x', ['detector', 'slice'], Q.REPORT_REPLICATES, 0.05, 0, Q.BUDGET)})
SELECT a.detector, a.slice, a.n, a.point AS auc, a.ci_lo AS auc_lo, a.ci_hi AS auc_hi, r.point AS recall, r.ci_lo AS recall_lo, r.ci_hi AS recall_hi
FROM a JOIN r ON a.detector = r.detector AND a.slice = r.slice WHERE a.n >= {C.MIN_LANGUAGE_ROWS} AND NOT isnan(a.point)"""

FLAG_UNION = f"""
WITH {SCORED},
r AS {recall_sql('scored', ['detector'], Q.BUDGET)},
fl AS (SELECT id, label, attack_class, max(CAST(score >= r.threshold AS INTEGER)) AS flag
       FROM scored JOIN r ON scored.detector = r.detector GROUP BY id, label, attack_class)
SELECT attack_class, CAST(count(*) AS BIGINT) AS n, avg(flag) AS rate FROM fl WHERE label = 1 GROUP BY attack_class
UNION ALL SELECT 'all', CAST(count(*) AS BIGINT), avg(flag) FROM fl WHERE label = 1"""

CARRY = f"""
WITH {SUITE},
alld AS (SELECT doc_id, n_chars, text FROM documents),
u AS (SELECT *, 0 AS p FROM ({_scored('suite', ['length', 'digits'], '')})
      UNION ALL SELECT detector, id, round(score, 2), 1 FROM ({_scored('alld', ['length'], '')})),
r AS (SELECT *, row_number() OVER (PARTITION BY detector, id ORDER BY p) AS rn FROM u)
SELECT detector, id, round(score, 9) AS score FROM r WHERE rn = 1"""

COMPLETE = f"""
WITH {SUITE},
store AS ({_scored('suite', ['length', 'digits', 'upper'], '')}
          UNION ALL {_scored("(SELECT * FROM suite WHERE lang = 'en')", ['punct'], '')}),
smp AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY attack_class
          ORDER BY md5(CAST(doc_id AS VARCHAR) || ':7')) AS rn FROM suite) WHERE rn <= 30),
cov AS (SELECT detector, count(DISTINCT id) AS n_scored FROM store WHERE id IN (SELECT doc_id FROM smp) GROUP BY detector)
SELECT detector, CAST(n_scored AS BIGINT) AS n_scored FROM cov WHERE n_scored = (SELECT count(DISTINCT doc_id) FROM smp)"""

ORACLE = {
    "detector_scores": SCORES,
    "scoring_coverage": COVERAGE,
    "detector_comparison": COMPARISON,
    "per_class_detection_rate": PER_CLASS,
    "per_language_auc": PER_LANG,
    "class_vs_benign_auc": CLASS_VS_BENIGN,
    "polarity_check": POLARITY,
    "ensemble_vs_single": ENSEMBLE,
    "score_quantiles_by_class": QUANT,
    "recall_sweep": SWEEP_SQL,
    "run_diff": RUN_DIFF,
    "feature_matrix": MATRIX,
    "model_scores": MODEL_SCORES,
    "flipped_rows": FLIPPED,
    "confusion_change": CHANGE,
    "class_vs_benign_at_budget": CLASS_BUDGET,
    "detector_report": REPORT,
    "flag_union_rate": FLAG_UNION,
    "carry_over_scores": CARRY,
    "complete_detectors_on_sample": COMPLETE,
}
