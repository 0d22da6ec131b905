"""Policy fallback, grants, tenants, pairing and metric operators."""
import random

import pytest
from pyspark.sql import functions as F

from riskframe.operators import govern, metrics

POLICY = {
    "default": {"GENERAL": {"HIGH": "BLOCK", "MEDIUM": "RESTRICT", "LOW": "ALLOW"},
                "ELEVATED": {"HIGH": "BLOCK", "MEDIUM": "ALLOW", "LOW": "ALLOW"}},
    "acme": {"GENERAL": {"HIGH": "BLOCK", "MEDIUM": "BLOCK"}},
}


def test_policy_two_level_fallback(spark):
    df = spark.createDataFrame([("acme", "GENERAL", "MEDIUM"), ("acme", "GENERAL", "LOW"),
                                ("acme", "ELEVATED", "LOW"), ("zeta", "ELEVATED", "MEDIUM"),
                                ("zeta", "INTERNAL", "LOW")], "tenant string, capability string, risk string")
    got = [(r.action, r.reason) for r in govern.policy_decision(df, POLICY).orderBy("tenant", "capability", "risk").collect()]
    assert got == [
        ("BLOCK", "Role 'ELEVATED' not defined for tenant 'acme'"),          # missing capability -> default_action
        ("BLOCK", "Policy applied for GENERAL (Risk: LOW, Tenant: acme)"),    # missing risk -> default_action
        ("BLOCK", "Policy applied for GENERAL (Risk: MEDIUM, Tenant: acme)"),
        ("ALLOW", "Policy applied for ELEVATED (Risk: MEDIUM, Tenant: zeta -> default (fallback))"),
        ("BLOCK", "Role 'INTERNAL' not defined for tenant 'zeta -> default (fallback)'"),
    ]


def test_policy_fail_safe_without_default(spark):
    df = spark.createDataFrame([("x", "GENERAL", "LOW")], "tenant string, capability string, risk string")
    r = govern.policy_decision(df, {"acme": {}}).first()
    assert r.action == "BLOCK" and r.reason.startswith("System Error")


def test_grants_validation_and_anonymous(spark):
    grants = spark.createDataFrame([("h1", "ELEVATED", "t1", "k1"), ("h2", "general", "t1", "k2"),
                                    ("h3", "INTERNAL", "", "k3")], "key_hash string, capability string, tenant string, key_id string")
    ok, bad = govern.validate_grants(grants)
    assert ok.count() == 1 and {r.reject_reason for r in bad.collect()} == {"invalid capability", "missing tenant"}
    req = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, None)], "rid int, credential_hash string")
    got = [(r.rid, r.authenticated, r.capability, r.tenant) for r in govern.resolve_principal(req, ok).orderBy("rid").collect()]
    assert got == [(1, True, "ELEVATED", "t1"), (2, False, "GENERAL", "default"), (3, False, "GENERAL", "default")]


def test_tenants_default_and_suspended(spark):
    df = spark.createDataFrame([("t1",), ("t2",), ("tx",)], "tenant string")
    tenants = spark.createDataFrame([("t1", "active", 60.0), ("t2", "suspended", None), ("t3", "weird", None)],
                                    "tenant_id string, status string, rate_limit_rpm double")
    got = {r.tenant: (r.tenant_status, r.tenant_rpm) for r in govern.apply_tenants(df, tenants).collect()}
    assert got == {"t1": ("active", 60.0), "t2": ("suspended", None), "tx": ("active", None)}


def test_pair_turns(spark):
    conv = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"),
                                  (1, 3, "user", "q2")], "conv_id long, turn long, role string, text string")
    got = sorted((r.turn, r.prompt, r.response) for r in govern.pair_turns(conv).collect())
    assert got == [(1, "q1", "a1"), (3, "q2", None)]


def test_safe_source_and_unknown_counter(spark):
    df = spark.createDataFrame([("cache",), ("x" * 50,), ("weird",), (None,)], "source string")
    assert [r[0] for r in df.select(metrics.safe_source("source")).collect()] == ["cache", "other", "other", "other"]
    got = {r.source: r.n for r in metrics.unknown_sources(df).collect()}
    assert got == {"x" * 40: 1, "weird": 1, "None": 1}


def test_latency_index_rule_matches_sorted(spark):
    rng = random.Random(1)
    vals = [round(rng.random() * 100, 1) for _ in range(537)]
    df = spark.createDataFrame([("s", v) for v in vals], "k string, v double")
    r = metrics.latency_summary(df, ["k"], "v").first()
    xs = sorted(vals)
    n = len(xs)
    assert (r.p50, r.p95, r.p99) == (xs[min(int(n * .5), n - 1)], xs[min(int(n * .95), n - 1)], xs[min(int(n * .99), n - 1)])
    m = metrics.latency_summary(df, ["k"], "v", (0.95,), "minus_one").first()
    assert m.p95 == xs[int(n * .95) - 1]


def test_histogram_ms_to_seconds_and_quantile(spark):
    df = spark.createDataFrame([("fusion", 3.0), ("fusion", 30.0), ("fusion", 300.0), ("fusion", -1.0),
                                ("fusion", None), ("fusion", 120000.0)], "stage string, ms double")
    h = {r.le: r.cum_count for r in metrics.stage_histogram(df, "stage", "ms").collect()}
    assert h[0.001] == 0 and h[0.005] == 1 and h[0.05] == 2 and h[0.5] == 3 and h[60.0] == 3 and h[float("inf")] == 4
    hist = metrics.stage_histogram(df, "stage", "ms")
    q = metrics.histogram_quantile(hist, 0.5, "p50").first().p50
    # rank 2 falls in bucket (0.025, 0.05] holding 1 obs: 0.025 + 0.025*(2-1)/1
    assert q == pytest.approx(0.05)
    assert metrics.histogram_quantile(hist, 0.99, "p99").first().p99 == 60.0   # +Inf bucket -> last bound


def test_sliding_rate_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:02:30", "a")], "ts string, k string").select(
        F.to_timestamp("ts").alias("ts"), "k")
    got = sorted(str(r.window_start) for r in metrics.sliding_rate(df, "ts", ["k"]).collect())
    assert len(got) == 5 and got[0].endswith("23:58:00") and got[-1].endswith("00:02:00")


def test_concurrency_peaks(spark):
    rows = [(1, "2024-01-01 00:10:00", 600.0), (2, "2024-01-01 00:15:00", 60.0), (3, "2024-01-01 00:20:00", 1.0),
            (4, "2024-01-01 00:50:00", 1200.0)]
    df = spark.createDataFrame(rows, "id long, ts string, d double").select("id", F.to_timestamp("ts").alias("ts"), "d")
    got = {str(r.bucket_start)[-8:]: (r.n_starts, r.peak) for r in metrics.concurrency_peaks(df, "ts", "d").collect()}
    assert got == {"00:00:00": (4, 2), "01:00:00": (0, 1)}
