"""The composed decision, its arbitration, the anchor matrix and run diffs."""
import numpy as np
from pyspark.sql import functions as F

from riskframe.operators import cascade as K
from riskframe.operators import detectors as D
from riskframe.operators import vectors as V

POL = {"feature_order": ["a"], "scaler_mean": [0.0], "scaler_scale": [1.0], "coefficients": [1.0], "intercept": 0.0,
       "per_class": {"x": {"scaler_mean": [0.0], "scaler_scale": [1.0], "coefficients": [1.0], "intercept": 0.0,
                           "threshold_high": 0.9, "threshold_medium": 0.5}}}


def test_stages_in_order(spark):
    rows = [  # id, cached risk, violation, meta, threat, a, hazard, judge
        (1, "HIGH", "JAILBREAK_DETECTED", 0.9, 0.9, 5.0, None, None),
        (2, "LOW", "JAILBREAK_DETECTED", 0.9, 0.9, 5.0, None, None),
        (3, None, "JAILBREAK_DETECTED", 0.9, 0.9, 5.0, None, None),
        (4, None, None, 0.9, 0.1, 5.0, None, None),
        (5, None, None, 0.0, 0.9, 5.0, None, None),
        (6, None, None, 0.0, 0.1, 5.0, None, None),
        (7, None, None, 0.0, 0.1, 0.5, "SAFE", "DANGEROUS"),
        (8, None, None, 0.0, 0.1, 0.5, None, "AMBIGUOUS"),
        (9, None, None, 0.0, 0.1, 0.5, None, None),
        (10, None, None, 0.0, 0.1, -3.0, None, None),
        (11, None, None, 0.0, 0.4, None, "DANGEROUS", "SAFE"),
        (12, None, None, None, None, None, None, None)]
    d = spark.createDataFrame(rows, "id int, c string, v string, meta double, threat double, a double, hz string, j string")
    d = d.withColumn("cached", F.when(F.col("c").isNotNull(), F.struct(F.col("c").alias("risk"), F.lit(0.7).alias("score"))))
    got = {r.id: (r.risk, r.source, r.judge_invoked, r.triggering_class) for r in K.assess(
        d, {"a": "a"}, POL, "meta", "threat", F.lit(False), None, "cached", "v", "hz", "j").collect()}
    assert got == {
        1: ("HIGH", "cache_locked_high", False, None), 2: ("LOW", "cache", False, None), 3: ("HIGH", "symbolic_rule", False, None),
        4: ("HIGH", "fast_path_meta_intent", False, None), 5: ("HIGH", "fast_path_anchor_critical", False, None),
        6: ("HIGH", "fusion_threat_critical", False, "x"), 7: ("MEDIUM", "llama_guard_override_capped", True, "x"),
        8: ("MEDIUM", "semantic_judge_ambiguous", True, "x"), 9: ("HIGH", "judge_failure_fail_closed", True, "x"),
        10: ("LOW", "fusion_clean_pass", False, "x"), 11: ("HIGH", "llama_guard_arbitration", True, None),
        12: ("LOW", "clean_pass", False, None)}


def test_anchor_cosines(spark):
    rng = np.random.default_rng(1)
    X, A = rng.normal(size=(40, 6)), rng.normal(size=(3, 6))
    rows = [(i, x.tolist()) for i, x in enumerate(X)] + [(100, [0.0] * 6), (101, None)]
    d = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    d = d.withColumn("cos", V.anchor_cosines("v", A.tolist()))
    got = {r.id: (r.cos, r.b, r.none) for r in d.select("id", "cos", V.best_cosine("cos", [0, 2]).alias("b"), V.best_cosine("cos", []).alias("none")).collect()}
    want = (X / np.linalg.norm(X, axis=1, keepdims=True)) @ (A / np.linalg.norm(A, axis=1, keepdims=True)).T
    for i in range(40):
        assert np.allclose(got[i][0], want[i]) and np.isclose(got[i][1], max(want[i][0], want[i][2])) and got[i][2] == 0.0
    assert got[100][0] == [0.0] * 3 and got[101][0] is None


def test_confusion_change_and_flips(spark):
    old = spark.createDataFrame([(1, 1, True), (2, 1, False), (3, 0, True), (4, 0, False)], "id int, label int, pred boolean")
    new = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "id int, pred boolean")
    c = D.confusion_change(old, new, "id").first()
    assert (c.n, c.n_flipped, c.TP_change, c.FP_change, c.TN_change, c.FN_change) == (4, 3, 1, 0, 0, -1)
    assert {(r.id, r.fixed) for r in D.flipped_rows(old, new, "id").collect()} == {(2, True), (3, True), (4, False)}


def test_arbitration_falls_back(spark):
    d = spark.createDataFrame([("SAFE", "DANGEROUS"), (None, "SAFE"), (None, None)], "h string, j string")
    got = [tuple(r.x) for r in d.select(K.arbitrate("h", "j", F.lit(False), True).alias("x")).collect()]
    assert got == [("LOW", "llama_guard_override"), ("LOW", "semantic_judge_override"), ("HIGH", "judge_failure_fail_closed")]


def test_audit_rows_take_a_hash_for_the_prompt(spark):
    from riskframe.sources import io
    v = spark.createDataFrame([("a", "h1")], "request_id string, prompt_hash string")
    assert [(r.request_id, r.prompt_hash) for r in io.audit_rows(v).collect()] == [("a", "h1")]
