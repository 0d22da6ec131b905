"""Decision tables of the cascade, fusion maths and output checks."""
import math

import pytest
from pyspark.sql import functions as F

from riskframe.operators import cascade as K


def _fuse(spark, rows, **kw):
    schema = ("meta double, threat double, edu boolean, dom boolean, fa boolean, fs double, fh double, fm double")
    df = spark.createDataFrame(rows, schema)
    c = K.fuse_signals("meta", "threat", "edu", "dom", "fa", "fs", "fh", "fm", **kw)
    return [tuple(r.r) for r in df.select(c.alias("r")).collect()]


@pytest.mark.parametrize("row,expected", [
    ((0.30, 0.0, False, None, False, None, None, None), ("HIGH", "semantic_meta_intent", False, "UNKNOWN")),
    ((0.0, 0.0, False, None, True, 0.28, 0.28, 0.10), ("HIGH", "fusion_threat_critical", False, "UNKNOWN")),
    ((0.0, 0.0, True, None, True, 0.10, 0.28, 0.10), ("MEDIUM", "fusion_educational_safe_harbor", False, "UNKNOWN")),
    ((0.0, 0.0, False, None, True, 0.10, 0.28, 0.10), ("MEDIUM", "fusion_judge_pending", True, "UNKNOWN")),
    ((0.0, 0.9, False, None, True, 0.05, 0.28, 0.10), ("LOW", "fusion_clean_pass", False, "UNKNOWN")),
    ((0.0, 0.48, False, None, False, None, None, None), ("HIGH", "vector_threat_critical", False, "UNKNOWN")),
    ((0.0, 0.30, True, None, False, None, None, None), ("MEDIUM", "educational_safe_harbor", False, "UNKNOWN")),
    ((0.0, 0.30, False, None, False, None, None, None), ("MEDIUM", "judge_pending", True, "UNKNOWN")),
    ((0.0, 0.29, False, False, False, None, None, None), ("LOW", "clean_pass", False, "OUT_OF_DOMAIN")),
    ((0.0, 0.29, False, True, False, None, None, None), ("LOW", "clean_pass", False, "IN_DOMAIN")),
])
def test_fuse_signals_table(spark, row, expected):
    assert _fuse(spark, [row])[0] == expected


def test_domain_guardrail_enforcing(spark):
    row = (0.0, 0.9, False, False, False, None, None, None)
    assert _fuse(spark, [row], domain_mode="enforcing")[0] == ("MEDIUM", "domain_guardrail", False, "OUT_OF_DOMAIN")
    assert _fuse(spark, [row])[0][0] == "HIGH"    # advisory: topicality never changes risk


@pytest.mark.parametrize("s,m,h,exp", [(0.19, 0.10, 0.30, False), (0.20, 0.10, 0.30, True), (0.5, 0.30, 0.30, True)])
def test_upper_band(spark, s, m, h, exp):
    df = spark.createDataFrame([(s, m, h)], "s double, m double, h double")
    assert df.select(K.upper_ambiguous_band("s", "m", "h")).first()[0] is exp


@pytest.mark.parametrize("verdict,tp,exp", [
    ("DANGEROUS", False, ("HIGH", "semantic_judge")),
    ("SAFE", True, ("MEDIUM", "semantic_judge_override_restricted")),
    ("SAFE", False, ("MEDIUM", "semantic_judge_override_capped")),
    ("AMBIGUOUS", False, ("MEDIUM", "semantic_judge_ambiguous")),
    (None, False, ("HIGH", "judge_failure_fail_closed")),
    ("garbage", False, ("HIGH", "judge_failure_fail_closed")),
])
def test_judge_arbitration(spark, verdict, tp, exp):
    df = spark.createDataFrame([(verdict, tp)], "v string, tp boolean")
    assert tuple(df.select(K.judge_arbitration("v", "tp").alias("r")).first().r) == exp


def test_hazard_preferred_then_judge(spark):
    df = spark.createDataFrame([("DANGEROUS", "SAFE", False), (None, "DANGEROUS", False), ("SAFE", None, True)],
                               "hv string, jv string, tp boolean")
    c = F.coalesce(K.hazard_arbitration("hv", "tp"), K.judge_arbitration("jv", "tp"))
    got = [tuple(r.r) for r in df.select(c.alias("r")).collect()]
    assert got == [("HIGH", "llama_guard_arbitration"), ("HIGH", "semantic_judge"),
                   ("MEDIUM", "llama_guard_override_restricted")]


def test_fast_path_order_and_equality(spark):
    df = spark.createDataFrame([(0.30, 0.9), (0.29, 0.48), (0.29, 0.47)], "m double, t double")
    got = [r.r.source if r.r else None for r in df.select(K.fast_path("m", "t").alias("r")).collect()]
    assert got == ["fast_path_meta_intent", "fast_path_anchor_critical", None]


POL = {"feature_order": ["a", "b", "c", "d"], "scaler_mean": [0.2, 0.1, 0.1, 0.05],
       "scaler_scale": [0.25, 0.2, 0.2, 0.1], "coefficients": [1.5, 1.6, 0.6, 0.5], "intercept": -1.2,
       "threshold_high": 0.28, "threshold_medium": 0.10,
       "per_class": {"x": {"scaler_mean": [0, 0, 0, 0], "scaler_scale": [1, 1, 1, 1], "coefficients": [1, 0, 0, 0],
                           "intercept": 0.0, "threshold_high": 0.6, "threshold_medium": 0.5},
                     "y": {"scaler_mean": [0, 0, 0, 0], "scaler_scale": [1, 1, 1, 1], "coefficients": [0, 1, 0, 0],
                           "intercept": 0.0, "threshold_high": 0.6, "threshold_medium": 0.5}}}


def test_fused_score_manual(spark):
    feats = {k: k for k in "abcd"}
    df = spark.createDataFrame([(0.5, 0.3, 0.2, 0.1)], "a double, b double, c double, d double")
    got = df.select(K.fused_score(feats, POL)).first()[0]
    z = -1.2 + 1.5 * (0.5 - 0.2) / 0.25 + 1.6 * (0.3 - 0.1) / 0.2 + 0.6 * (0.2 - 0.1) / 0.2 + 0.5 * (0.1 - 0.05) / 0.1
    assert got == pytest.approx(1 / (1 + math.exp(-z)))


def test_sigmoid_clamp(spark):
    df = spark.createDataFrame([(-100.0,), (100.0,), (0.0,)], "z double")
    assert [r[0] for r in df.select(K.sigmoid("z")).collect()] == [0.0, 1.0, 0.5]


def test_missing_detector_not_imputed(spark):
    feats = {k: k for k in "abcd"}
    df = spark.createDataFrame([(0.5, None, 0.2, 0.1)], "a double, b double, c double, d double")
    assert df.select(K.fusion_available(feats, POL)).first()[0] is False


def test_per_class_tier_beats_ratio_and_ties_go_first(spark):
    feats = {k: k for k in "abcd"}
    # x: sigmoid(2.0)=0.88 tier 2; y: sigmoid(5)=0.99 tier 2, larger ratio -> y
    df = spark.createDataFrame([(2.0, 5.0, 0.0, 0.0), (1.0, 1.0, 0.0, 0.0)], "a double, b double, c double, d double")
    got = [r.w.triggering_class for r in df.select(K.per_class_verdict(feats, POL).alias("w")).collect()]
    assert got == ["y", "x"]


def test_verdict_parsers(spark):
    df = spark.createDataFrame([('```json\n{"verdict": "safe"}\n```',), ('{"verdict": "maybe"}',), ("not json",)],
                               "raw string")
    assert [r[0] for r in df.select(K.parse_chat_verdict("raw")).collect()] == ["SAFE", "DANGEROUS", "DANGEROUS"]
    hz = spark.createDataFrame([("unsafe\nS1,S10",), ("Safe",), ("weird",)], "raw string")
    got = [(r.v.verdict, list(r.v.categories)) for r in hz.select(K.parse_hazard_verdict("raw").alias("v")).collect()]
    assert got == [("DANGEROUS", ["S1", "S10"]), ("SAFE", []), ("DANGEROUS", [])]


def test_output_checks_and_combined(spark):
    df = spark.createDataFrame([(True, None, 0.5), (False, "DANGEROUS", 0.5), (False, "SAFE", 0.1), (False, "SAFE", 0.5)],
                               "pii boolean, jv string, g double")
    got = [r.o.source for r in df.select(K.assess_output("pii", "jv", "g").alias("o")).collect()]
    assert got == ["pii_leakage", "semantic_judge_output", "semantic_grounding_check", "clean_pass"]
    c = spark.createDataFrame([("ALLOW", "BLOCK"), ("RESTRICT", "ALLOW"), ("BLOCK", None)], "p string, o string")
    assert [r[0] for r in c.select(K.combined_decision("p", "o")).collect()] == ["BLOCK", "RESTRICT", "BLOCK"]


def test_detector_helpers(spark):
    df = spark.createDataFrame([(0.4, -0.3, True, 0.2, 0.1)], "s double, n double, sym boolean, t double, m double")
    r = df.select(K.one_sided_probability("s"), K.one_sided_probability("n"),
                  K.anchor_detector("sym", "t", "m"), K.two_logit_probability(F.lit(0.0), F.lit(0.0))).first()
    assert tuple(r) == pytest.approx((0.4, 0.7, 1.0, 0.5))
