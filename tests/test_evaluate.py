"""Confusion, slices, bootstrap, threshold grid and union-FPR budget."""
import math
import random

import pytest
from pyspark.sql import functions as F

from riskframe import config as C
from riskframe.operators import evaluate as EV


def test_confusion_and_derived(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.3, 1), (0.1, 0)], "score double, label int")
    r = EV.confusion_at_threshold(df, "score", "label", 0.5).first()
    assert (r.TP, r.FP, r.TN, r.FN) == (1, 1, 1, 1)
    assert r.precision == 0.5 and r.recall == 0.5 and r.f1 == 0.5 and r.fpr == 0.5


def test_derived_zero_denominators(spark):
    df = spark.createDataFrame([(0.1, 0)], "score double, label int")
    r = EV.confusion_at_threshold(df, "score", "label", 0.5).first()
    assert r.precision == 0.0 and r.recall == 0.0 and r.f1 == 0.0


def test_slices_underpowered_and_single_class(spark):
    rows = [(0.1 * i, int(i % 2), "big") for i in range(30)] + [(0.5, 1, "tiny"), (0.6, 1, "tiny")]
    df = spark.createDataFrame(rows, "score double, label int, s string")
    out = {r.s: r for r in EV.evaluate_slices(df, "score", "label", ["s"], threshold=0.5).collect()}
    assert out["big"].underpowered is False and out["tiny"].underpowered is True
    assert math.isnan(out["tiny"].auc) and out["tiny"].note == "no negatives: recall only"
    assert out["tiny"].TP == 2  # shared threshold applied per slice


def _boot_df(spark, n=200, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, rng.random() + (0.3 if i % 3 == 0 else 0.0), int(i % 3 == 0))
                                  for i in range(n)], "id long, score double, label int")


def test_bootstrap_brackets_point_and_is_deterministic(spark):
    df = _boot_df(spark)
    a = EV.bootstrap_auc(df, "id", "score", "label", replicates=100).first()
    b = EV.bootstrap_auc(df, "id", "score", "label", replicates=100).first()
    assert a.ci_lo <= a.point <= a.ci_hi
    assert (a.ci_lo, a.ci_hi) == (b.ci_lo, b.ci_hi)
    assert a.n_boot_effective == 100


def test_bootstrap_small_sample_wider(spark):
    big = EV.bootstrap_auc(_boot_df(spark, 400), "id", "score", "label", replicates=100).first()
    small = EV.bootstrap_auc(_boot_df(spark, 40), "id", "score", "label", replicates=100).first()
    assert (small.ci_hi - small.ci_lo) > (big.ci_hi - big.ci_lo)


def test_bootstrap_skips_degenerate(spark):
    df = spark.createDataFrame([(0, 0.9, 1), (1, 0.1, 0), (2, 0.2, 0)], "id long, score double, label int")
    r = EV.bootstrap_auc(df, "id", "score", "label", replicates=200).first()
    assert 0 < r.n_boot_effective < 200   # replicates without the single positive are skipped


def test_poisson_draw_mean_is_one(spark):
    df = spark.range(20000).select(EV.poisson1_draw(EV.hash_uniform(F.col("id"), F.lit(0))).alias("w"))
    m = df.agg(F.avg("w")).first()[0]
    assert m == pytest.approx(1.0, abs=0.03)


def _grid_brute(rows, tmed, tmeta):
    out = {}
    for b, tm in enumerate(tmed):
        for a, tt in enumerate(tmeta):
            tp = fp = tn = fn = 0
            for meta, threat, sym, y in rows:
                flag = sym or meta >= tt or threat >= tm
                tp += y and flag
                fp += (not y) and flag
                tn += (not y) and not flag
                fn += y and not flag
            out[b * len(tmeta) + a] = (tp, fp, tn, fn)
    return out


def test_grid_matches_bruteforce(spark):
    rng = random.Random(2)
    rows = [(round(rng.random() * 0.9, 3), round(rng.random() * 0.9, 3), rng.random() < 0.05, int(rng.random() < 0.3))
            for _ in range(400)]
    df = spark.createDataFrame(rows, "meta double, threat double, sym boolean, y int")
    tmed, tmeta = C.grid_values(*C.GRID_T_MED), C.grid_values(*C.GRID_T_META)
    got = {r.grid_order: (r.TP, r.FP, r.TN, r.FN) for r in EV.grid_sweep(df, "meta", "threat", "sym", "y").collect()}
    assert got == _grid_brute(rows, tmed, tmeta)


def test_best_grid_point_rules(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        y = int(rng.random() < 0.3)
        rows.append((rng.random() * 0.5 + 0.3 * y, rng.random() * 0.5 + 0.3 * y, False, y))
    df = spark.createDataFrame(rows, "meta double, threat double, sym boolean, y int")
    g = EV.grid_sweep(df, "meta", "threat", "sym", "y")
    pts = [r.asDict() for r in g.collect()]
    best = {r.kind: r for r in EV.best_grid_point(g).collect()}
    feas = [p for p in sorted(pts, key=lambda p: p["grid_order"]) if p["fpr"] <= 0.05]
    assert feas
    exp = max(feas, key=lambda p: (p["recall"], p["precision"]))  # first maximal in grid order
    assert best["max_recall_within_budget"].grid_order == exp["grid_order"]
    none = EV.best_grid_point(g, budget=-1.0).collect()
    exp_min = min(sorted(pts, key=lambda p: p["grid_order"]), key=lambda p: p["fpr"])
    assert {r.kind for r in none} == {"min_fpr", "best_f1"}
    assert [r for r in none if r.kind == "min_fpr"][0].grid_order == exp_min["grid_order"]
    exp_f1 = max(sorted(pts, key=lambda p: p["grid_order"]), key=lambda p: p["f1"])
    assert best["best_f1"].grid_order == exp_f1["grid_order"]


def _thr_rank(scores, labels, alpha):
    neg = sorted((s for s, y in zip(scores, labels) if y == 0), reverse=True)
    k = int(len(neg) * alpha)
    return neg[k] if k < len(neg) else neg[-1]


def test_union_fpr_matches_bisection(spark):
    rng = random.Random(9)
    n = 400
    y = [int(rng.random() < 0.3) for _ in range(n)]
    s = [[round(rng.random(), 3) for _ in range(n)] for _ in range(3)]
    rows = [(i, s[0][i], s[1][i], s[2][i], y[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, c0 double, c1 double, c2 double, y int")
    r = EV.union_fpr_budget(df, ["c0", "c1", "c2"], "y", "id", 0.05).first()
    benign = [i for i in range(n) if y[i] == 0]

    def union_fpr(alpha):
        thr = [_thr_rank(s[c], y, alpha) for c in range(3)]
        return sum(any(s[c][i] >= thr[c] for c in range(3)) for i in benign) / len(benign)
    lo, hi = 0.0, 0.05
    for _ in range(40):
        mid = (lo + hi) / 2
        if union_fpr(mid) > 0.05:
            hi = mid
        else:
            lo = mid
    assert r.k == int(len(benign) * lo)
    assert r.union_fpr == pytest.approx(union_fpr(lo))
    assert r.thr_c0 == pytest.approx(_thr_rank(s[0], y, lo))


def test_holdout_and_kfold_are_stable(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    a = EV.holdout_split(df, "id").where("split = 'test'").count()
    assert 200 < a < 400
    f = EV.kfold(df, "id", "y", 5)
    counts = {(r.y, r.fold): r["count"] for r in f.groupBy("y", "fold").count().collect()}
    assert all(counts[(1, k)] == 50 for k in range(5)) and all(counts[(0, k)] == 150 for k in range(5))


def test_bootstrap_streams_a_large_tie_block(spark):
    """One score for every row: the bucket spans Arrow batches and chunks;
    every replicate must give exactly 0.5."""
    df = spark.range(25000).select(F.col("id"), F.lit(0.0).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    r = EV.bootstrap_auc(df, "id", "score", "label", replicates=20, chunk_cells=60_000).first()
    assert r.point == 0.5 and r.ci_lo == 0.5 and r.ci_hi == 0.5 and r.n_boot_effective == 20


def test_bootstrap_recall_equals_a_direct_computation(spark):
    """Every replicate recomputed in numpy from the same weights, ties included."""
    import hashlib

    import numpy as np

    from riskframe import config as C
    rng = np.random.default_rng(3)
    n, reps, budget = 300, 40, 0.1
    score = rng.integers(0, 25, n) / 10.0
    label = (rng.random(n) < 0.3 + 0.1 * (score > 1.5)).astype(int)
    df = spark.createDataFrame([(i, float(score[i]), int(label[i])) for i in range(n)], "id long, score double, label int")
    got = EV.bootstrap_recall(df.repartition(5), "id", "score", "label", budget=budget, replicates=reps, buckets=8).first()
    base = np.array([int(hashlib.md5(f"{i}:0".encode()).hexdigest()[:15], 16) for i in range(n)])
    W = EV._poisson_weights(base, reps, C.poisson1_cdf(20))
    values = []
    for r in range(reps):
        w = W[:, r]
        P, N = (w * label).sum(), (w * (1 - label)).sum()
        best = 0.0
        for t in np.unique(score):
            up = score >= t
            if (w * (1 - label))[up].sum() / N <= budget:
                best = max(best, (w * label)[up].sum() / P)
        values.append(best)
    values.sort()
    assert got["ci_lo"] == values[int(0.025 * reps)] and got["ci_hi"] == values[min(int(0.975 * reps), reps - 1)]
    assert got["n_boot_effective"] == reps and got["ci_lo"] <= got["point"] <= got["ci_hi"]
    # the weights are Poisson(1): mean and variance one
    assert abs(W.mean() - 1) < 0.05 and abs(W.var() - 1) < 0.1
