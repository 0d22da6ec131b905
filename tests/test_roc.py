"""AUC, ROC points, budgets and prefix sums on hand-computed inputs."""
import math
import random

import pytest

from pyspark.sql import functions as F

from riskframe.operators import roc


@pytest.fixture(autouse=True, params=[0, roc.WINDOW_ROWS], ids=["buckets", "window"])
def running_sums(request, monkeypatch):
    """Every test runs with bucketed running sums and with plain windows."""
    monkeypatch.setattr(roc, "WINDOW_ROWS", request.param)


def _df(spark, scores, labels, keys=None):
    keys = keys or ["a"] * len(scores)
    return spark.createDataFrame([(float(s), int(y), k) for s, y, k in zip(scores, labels, keys)],
                                 "score double, label int, k string")


def _auc(spark, scores, labels, buckets=4096):
    t = roc.score_table(_df(spark, scores, labels), "score", "label", buckets=buckets)
    return roc.auc(t).first()["auc"]


def test_auc_perfect(spark):
    assert _auc(spark, [0.1, 0.2, 0.8, 0.9], [0, 0, 1, 1]) == 1.0


def test_auc_inverted(spark):
    assert _auc(spark, [0.9, 0.8, 0.2, 0.1], [0, 0, 1, 1]) == 0.0


def test_auc_all_tied(spark):
    assert _auc(spark, [0.5] * 6, [0, 1, 0, 1, 0, 1]) == pytest.approx(0.5)


def test_auc_partial_ties(spark):
    assert _auc(spark, [0.1, 0.5, 0.5, 0.9], [0, 0, 1, 1]) == pytest.approx(0.875)


def test_auc_single_class_nan(spark):
    assert math.isnan(_auc(spark, [0.1, 0.2, 0.3], [1, 1, 1]))
    assert math.isnan(_auc(spark, [0.1, 0.2, 0.3], [0, 0, 0]))


def _brute_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("buckets", [1, 3, 4096])
def test_auc_matches_pairs_any_bucketing(spark, buckets):
    rng = random.Random(7)
    scores = [round(rng.random(), 2) for _ in range(300)]
    labels = [int(rng.random() < 0.3) for _ in range(300)]
    assert _auc(spark, scores, labels, buckets) == pytest.approx(_brute_auc(scores, labels), abs=1e-12)


def test_auc_symmetry(spark):
    rng = random.Random(3)
    scores = [rng.random() for _ in range(200)]
    labels = [int(rng.random() < 0.5) for _ in range(200)]
    a = _auc(spark, scores, labels)
    b = _auc(spark, [-s for s in scores], labels)
    assert a + b == pytest.approx(1.0)


def test_prefix_before_matches_bruteforce(spark):
    rng = random.Random(11)
    rows = [(k, float(x), rng.randint(0, 5)) for k in "abc" for x in rng.sample(range(1000), 120)]
    df = spark.createDataFrame(rows, "k string, x double, v int")
    got = {(r["k"], r["x"]): r["v_lt"] for r in roc.prefix_before(df, ["k"], "x", ["v"], buckets=7).collect()}
    for k, x, _ in rows:
        assert got[(k, x)] == sum(v for kk, xx, v in rows if kk == k and xx < x)


def test_recall_at_fpr_budgets(spark):
    # 5 positives above all negatives except one negative on top
    scores = [0.99, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]
    labels = [0, 1, 1, 1, 1, 0, 0, 1, 0, 0]
    t = roc.score_table(_df(spark, scores, labels), "score", "label")
    r0 = roc.recall_at_fpr(t, 0.0).first()
    assert r0["recall"] == 0.0 and r0["threshold"] == float("inf")
    r2 = roc.recall_at_fpr(t, 0.2).first()
    assert r2["recall"] == pytest.approx(0.8) and r2["threshold"] == pytest.approx(0.6)
    r4 = roc.recall_at_fpr(t, 0.4).first()
    assert r4["recall"] == pytest.approx(0.8)
    r6 = roc.recall_at_fpr(t, 0.6).first()
    assert r6["recall"] == pytest.approx(1.0) and r6["threshold"] == pytest.approx(0.3)


def test_threshold_rank_rule(spark):
    neg = [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0]
    scores = neg + [0.95]
    labels = [0] * 10 + [1]
    t = roc.score_table(_df(spark, scores, labels), "score", "label")
    assert roc.threshold_at_fpr_rank(t, 0.2).first()["threshold"] == pytest.approx(0.7)   # neg[int(10*.2)]
    assert roc.threshold_at_fpr_rank(t, 0.99).first()["threshold"] == pytest.approx(0.0)  # neg[9]
    assert roc.threshold_at_fpr_rank(t, 2.0).first()["threshold"] == pytest.approx(0.0)   # out of range -> last


def test_trapezoid_equals_auc(spark):
    rng = random.Random(5)
    scores = [round(rng.random(), 1) for _ in range(150)]
    labels = [int(rng.random() < 0.4) for _ in range(150)]
    t = roc.score_table(_df(spark, scores, labels), "score", "label")
    assert roc.roc_trapezoid(t).first()["area"] == pytest.approx(_brute_auc(scores, labels))


def test_slices_keep_keys_apart(spark):
    scores = [0.1, 0.9, 0.2, 0.8, 0.3, 0.7]
    labels = [0, 1, 1, 0, 0, 1]
    keys = ["a", "a", "b", "b", "c", "c"]
    t = roc.score_table(_df(spark, scores, labels, keys), "score", "label", ["k"])
    got = {r["k"]: r["auc"] for r in roc.auc(t, ["k"]).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": 1.0}


@pytest.mark.parametrize("inclusive,buckets", [(True, 3), (False, 3), (True, 4096), (False, 1)])
def test_last_before_matches_bruteforce(spark, inclusive, buckets):
    rng = random.Random(21)
    rows = []
    for i in range(300):
        k = rng.choice("ab")
        t = rng.randint(0, 60)
        v = rng.randint(0, 9) if rng.random() < 0.3 else None
        rows.append((i, k, t, v))
    df = spark.createDataFrame(rows, "id long, k string, t long, v int")
    got = {r.id: r.lv for r in roc.last_before(df, ["k"], "t", ["id"], F.col("v"), "lv", inclusive, buckets).collect()}
    for i, k, t, _ in rows:
        prior = [(tt, ii, vv) for ii, kk, tt, vv in rows if kk == k and vv is not None and
                 ((tt, ii) <= (t, i) if inclusive else (tt, ii) < (t, i))]
        exp = max(prior)[2] if prior else None
        assert got[i] == exp


def test_an_outlier_does_not_collapse_the_buckets(spark):
    """10 000 scores in [0, 1] and one of 1e9 still fill all range buckets."""
    df = spark.range(10_000).select((F.col("id") / 10_000.0).alias("s")).union(spark.createDataFrame([(1e9,)], "s double"))
    n = roc.range_buckets(df, [], ["s"], 4096).groupBy("__b").count().collect()
    assert len(n) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(r["count"] for r in n) < 3 * 10_001 / len(n)


def test_nan_scores_are_left_out(spark):
    df = spark.createDataFrame([(0.1, 0), (0.9, 1), (float("nan"), 0)], "score double, y int")
    assert roc.auc(roc.score_table(df, "score", "y")).first().auc == 1.0
