"""DuckDB formulations for :mod:`riskframe.plans.q_learn`: Newton's method
written out, one aggregate and one elimination a step."""
from __future__ import annotations

from riskframe.operators import learn
from riskframe.plans import o_vectors
from riskframe.plans import q_learn as Q
from riskframe.plans.o_detect import auc_sql, recall_sql

STEPS = 10
_D = len(Q.FEATURES)


def newton_ctes(src: str, steps: int = STEPS, d: int = _D) -> str:
    """CTEs over ``src(g, y, z1..zd)``; the last is ``fit(g, w0..wd)``."""
    idx = range(d + 1)
    z = lambda i: "1.0" if i == 0 else f"z{i}"
    out = [f"w_0 AS MATERIALIZED (SELECT g, {', '.join(f'0.0::DOUBLE AS w{i}' for i in idx)} FROM {src} GROUP BY g)"]
    for t in range(steps):
        eta = " + ".join(f"w{i} * {z(i)}" for i in idx)
        out.append(f"p_{t} AS MATERIALIZED (SELECT s.*, {', '.join(f'w{i}' for i in idx)}, 1 / (1 + exp(-({eta}))) AS p FROM {src} s JOIN w_{t} USING (g))")
        cells = [f"sum(p * (1 - p) * {z(i)} * {z(j)}) + {1 if i == j and i else 0} AS a{i}_{j}" for i in idx for j in idx]
        cells += [f"sum((p - y) * {z(i)}) + {f'any_value(w{i})' if i else '0'} AS a{i}_{d + 1}" for i in idx]
        out.append(f"e_{t}_0 AS MATERIALIZED (SELECT g, {', '.join(f'any_value(w{i}) AS w{i}' for i in idx)}, {', '.join(cells)} FROM p_{t} GROUP BY g)")
        for k in idx:
            done = [f"a{k}_{j} / a{k}_{k} AS a{k}_{j}" if i == k else f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} AS a{i}_{j}"
                    for i in idx for j in range(k + 1, d + 2)]
            out.append(f"e_{t}_{k + 1} AS MATERIALIZED (SELECT g, {', '.join(f'w{i}' for i in idx)}, {', '.join(done)} FROM e_{t}_{k})")
        out.append(f"w_{t + 1} AS MATERIALIZED (SELECT g, {', '.join(f'w{i} - a{i}_{d + 1} AS w{i}' for i in idx)} FROM e_{t}_{d + 1})")
    out.append(f"fit AS (SELECT * FROM w_{steps})")
    return ",\n".join(out)


_LABELS = " ".join(f"WHEN s.label IN {tuple(labs)} THEN '{c}'" for c, labs in
                   (("harmful_content", (0, 1)), ("prompt_injection", (2, 3)), ("jailbreak", (4, 5, 6))))
_STATS = ", ".join(f"avg({f}) AS m{i}, stddev_pop({f}) AS s{i}" for i, f in enumerate(Q.FEATURES, 1))
_SCORE = "1 / (1 + exp(-(w0 + " + " + ".join(f"w{i} * z{i}" for i in range(1, _D + 1)) + ")))"

_POLICIES = "[" + ", ".join(f"'{c}'" for c in ["global", *Q.CLASSES]) + "]"
FIT = f"""
WITH {o_vectors.SIG},
r AS MATERIALIZED (SELECT g, s.*, CASE WHEN g = 'global' THEN attack ELSE CAST(cls = g AS INTEGER) END AS y FROM
    (SELECT s.vec_id, s.attack, {', '.join('s.' + f for f in Q.FEATURES)}, CASE {_LABELS} ELSE 'benign' END AS cls FROM sig s) s,
    (SELECT unnest({_POLICIES}) AS g) WHERE g = 'global' OR attack = 0 OR cls = g),
st AS MATERIALIZED (SELECT g, count(*) AS n, sum(y) AS n_pos, {_STATS} FROM r GROUP BY g),
x AS MATERIALIZED (SELECT r.g, r.vec_id, r.y, {', '.join(f'(r.{f} - m{i}) / s{i} AS z{i}' for i, f in enumerate(Q.FEATURES, 1))} FROM r JOIN st USING (g)),
{newton_ctes('x')},
sc AS MATERIALIZED (SELECT x.g, x.y AS label, {_SCORE} AS score FROM x JOIN fit USING (g)),
hi AS (SELECT * FROM {recall_sql('sc', ['g'], learn.HIGH_FPR_BUDGET)}), md AS (SELECT * FROM {recall_sql('sc', ['g'], learn.MEDIUM_FPR_BUDGET)}),
chi AS (SELECT * FROM {recall_sql('sc', ['g'], learn.PER_CLASS_HIGH_FPR_BUDGET)}), cmd AS (SELECT * FROM {recall_sql('sc', ['g'], learn.PER_CLASS_MEDIUM_FPR_BUDGET)}),
f AS (SELECT unnest(range(1, {_D + 1})) AS i)
SELECT st.g AS policy, {[str(x) for x in Q.FEATURES]}[i] AS feature, round([{', '.join(f'm{i}' for i in range(1, _D + 1))}][i], 6) AS mean,
    round([{', '.join(f's{i}' for i in range(1, _D + 1))}][i], 6) AS scale, round([{', '.join(f'w{i}' for i in range(1, _D + 1))}][i], 6) AS coef,
    round(w0, 6) AS intercept, round(CASE WHEN st.g = 'global' THEN hi.threshold ELSE chi.threshold END, 6) AS threshold_high,
    round(CASE WHEN st.g = 'global' THEN md.threshold ELSE cmd.threshold END, 6) AS threshold_medium,
    st.n AS n_rows, CAST(st.n_pos AS BIGINT) AS n_positive, true AS converged
FROM st JOIN fit USING (g) JOIN hi USING (g) JOIN md USING (g) JOIN chi USING (g) JOIN cmd USING (g), f"""

_SETS = learn.feature_sets(Q.FEATURES)
_USED = "CASE c " + " ".join(f"WHEN {c} THEN {[int(f in fs) for f in Q.FEATURES]}" for c, (_, fs) in enumerate(_SETS)) + " END"
_OOF = f"""
WITH {o_vectors.SIG},
fo AS MATERIALIZED (SELECT vec_id, attack, {', '.join(Q.FEATURES)}, CAST((row_number() OVER (PARTITION BY attack ORDER BY
    ('0x' || substr(md5(CAST(vec_id AS VARCHAR) || ':42'), 1, 13))::BIGINT / 4503599627370496.0) - 1) % {Q.FOLDS} AS INTEGER) AS fold FROM sig),
gr AS (SELECT c * {Q.FOLDS} + j AS g, c, j, {_USED} AS u FROM (SELECT unnest(range({len(_SETS)})) AS c), (SELECT unnest(range({Q.FOLDS})) AS j)),
st AS MATERIALIZED (SELECT g, any_value(c) AS c, any_value(j) AS j, any_value(u) AS u, count(*) AS n, sum(attack) AS n_pos, {_STATS}
    FROM fo JOIN gr ON fo.fold <> gr.j GROUP BY g),
al AS MATERIALIZED (SELECT g, c, j, fold, vec_id, attack AS y, {', '.join(f'u[{i}] * ({f} - m{i}) / s{i} AS z{i}' for i, f in enumerate(Q.FEATURES, 1))} FROM fo, st),
x AS MATERIALIZED (SELECT * FROM al WHERE fold <> j),
{newton_ctes('x')}"""
_NAMES = str([n for n, _ in _SETS])

OOF_AUC = f"""{_OOF},
sc AS MATERIALIZED (SELECT {_NAMES}[c + 1] AS config, y AS label, {_SCORE} AS score FROM al JOIN fit USING (g) WHERE fold = j)
SELECT config, round(auc, 6) AS auc, n_pos, n_neg FROM {auc_sql('sc', ['config'])}"""

OOF_REPORT = f"""{_OOF}
SELECT {_NAMES}[c + 1] AS config, CAST(j AS INTEGER) AS fold, n AS n_rows, CAST(n_pos AS BIGINT) AS n_positive, round(w0, 6) AS intercept,
    true AS converged, true AS few_rounds FROM st JOIN fit USING (g)"""

ORACLE = {"fusion_policy_fit": FIT, "oof_fusion_auc": OOF_AUC, "oof_fit_report": OOF_REPORT}
