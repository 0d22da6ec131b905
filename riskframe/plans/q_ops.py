"""Governance, metrics and keyed-state queries.

Bindings:
* ``orders`` are requests from ``customer`` credentials.  The request's
  credential hash is SHA-256 of its customer key; ``customer`` is the
  grant store (segment -> capability; HOUSEHOLD carries a malformed
  lower-case tier and is rejected; a negative balance is a revoked key);
  the tenant is the customer's nation; ``nation`` holds tenant configs
  (region 4 suspended); order priority gives the risk level.
* ``conversations``: a user turn is a prompt, the next assistant turn its
  response.
* ``events`` is the request/verdict log: ``value`` is latency in ms,
  ``event_type`` the outcome/stage, ``user_id`` the caller identity.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from riskframe import config as C
from riskframe.functions import rules as R
from riskframe.functions import text as X
from riskframe.operators import cascade as K
from riskframe.operators import folds, govern, metrics
from riskframe.plans import bound
from riskframe.sources.tables import table, text_table

OVERRIDE_POLICY = {
    "default": C.DEFAULT_POLICY["default"],
    "nation_1": {
        "GENERAL": {"HIGH": "BLOCK", "MEDIUM": "BLOCK", "LOW": "ALLOW"},
        "ELEVATED": {"HIGH": "BLOCK", "MEDIUM": "RESTRICT"},
    },
}
QUOTA_RPM = 1.0 / 720.0          # one request per 12 h sustained
QUOTA_BURST_SECONDS = 86400.0    # 24 h burst -> capacity 2
BREAKER_COOLDOWN = 2 * 86400.0
TTL = C.CACHE_TTL_SECONDS


def _grants(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    cap = (F.when(F.col("c_mktsegment") == "MACHINERY", "INTERNAL")
           .when(F.col("c_mktsegment") == "BUILDING", "ELEVATED")
           .when(F.col("c_mktsegment") == "HOUSEHOLD", "general")
           .otherwise("GENERAL"))
    g = c.where(F.col("c_acctbal") >= 0).select(
        F.sha2(F.col("c_custkey").cast("string"), 256).alias("key_hash"), cap.alias("capability"),
        F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("tenant"),
        F.col("c_name").alias("key_id"))
    return govern.validate_grants(g)[0]


def _tenants(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("tenant_id"),
                    F.when(F.col("n_regionkey") == 4, "suspended").otherwise("active").alias("status"),
                    F.lit(None).cast("double").alias("rate_limit_rpm"))


def policy_decision(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    risk = (F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "HIGH")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "MEDIUM").otherwise("LOW"))
    req = o.select(F.col("o_orderkey").alias("request_id"),
                   F.sha2(F.col("o_custkey").cast("string"), 256).alias("credential_hash"), risk.alias("risk"))
    p = govern.resolve_principal(req, _grants(spark, sf_dir))
    p = govern.apply_tenants(p, _tenants(spark, sf_dir))
    d = govern.policy_decision(p, OVERRIDE_POLICY)
    action = F.when(F.col("tenant_status") == "suspended", F.lit("REJECT")).otherwise(F.col("action"))
    return d.groupBy("tenant", "capability", "risk", action.alias("action"), "reason") \
        .agg(F.count(F.lit(1)).alias("n"))


def _screen(col):
    return R.symbolic_violation(X.normalize_prompt(col), bound.RULES)


# bound below the production threshold: answers repeat few words of a prompt
OUTPUT_GROUNDING = 0.1


def combined_output_decision(spark, sf_dir):
    """C9 + C10: the judge's verdict is DANGEROUS for a response with "ing
    the", and its grounding is the share of its words that the prompt has."""
    conv = text_table(spark, sf_dir, "conversations", "conv_id")
    pairs = govern.pair_turns(conv)
    pairs = X.with_redaction(pairs, "prompt", "clean_prompt", "prompt_items")
    pairs = X.with_redaction(pairs, "response", "clean_response", "response_items")
    risk = F.when(_screen("clean_prompt").isNotNull(), "HIGH").otherwise("LOW")
    pairs = pairs.withColumn("risk", risk).withColumn("capability", F.lit("GENERAL")) \
        .withColumn("tenant", F.lit("default"))
    d = govern.policy_decision(pairs)
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    said = words("response")
    grounding = F.try_divide(F.size(F.array_intersect(said, words("prompt"))), F.size(said))
    judge = F.when(F.lower("response").contains("ing the"), "DANGEROUS").otherwise("SAFE")
    out = K.assess_output(F.size("response_items") > 0, judge, grounding, OUTPUT_GROUNDING)
    checked = (F.col("action") != "BLOCK") & F.col("response").isNotNull()
    d = d.withColumn("o", F.when(checked, out))
    return d.select("conv_id", "turn", F.col("action").alias("prompt_decision"),
                    F.col("o.decision").alias("output_decision"), F.col("o.source").alias("output_source"),
                    K.combined_decision("action", "o.decision").alias("final_decision"))


def _verdict_log(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    decision = (F.when(F.col("event_type") == "error", "BLOCK")
                .when(F.col("event_type") == "signup", "RESTRICT").otherwise("ALLOW"))
    risk = F.when(F.col("value") >= 300, "HIGH").when(F.col("value") >= 100, "MEDIUM").otherwise("LOW")
    source = (F.when(F.col("event_type") == "view", "cache").when(F.col("event_type") == "click", "clean_pass")
              .when(F.col("event_type") == "purchase", "fusion_clean_pass").otherwise(F.col("event_type")))
    tenant = F.concat(F.lit("k"), (F.get_json_object("props", "$.k").try_cast("int") / 25).cast("int").cast("string"))
    return ev.select("event_id", "ts", "user_id", "event_type", "value", decision.alias("decision"),
                     risk.alias("risk_level"), source.alias("source"), tenant.alias("tenant"))


def outcome_counters(spark, sf_dir):
    v = _verdict_log(spark, sf_dir)
    a = v.groupBy(F.lit("assessments").alias("counter"), "decision", "risk_level",
                  metrics.safe_source("source").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    b = v.groupBy(F.lit("tenant_decisions").alias("counter"), "decision", F.lit(None).cast("string").alias("risk_level"),
                  F.col("tenant").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)


def unknown_source_counter(spark, sf_dir):
    return metrics.unknown_sources(_verdict_log(spark, sf_dir), "source")


def latency_index_percentiles(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    s = metrics.latency_summary(ev, ["event_type"], "value", (0.5, 0.95, 0.99), "index")
    return s.select("event_type", "n", F.round("avg", 6).alias("avg"), "min", "max", "p50", "p95", "p99")


def latency_minus_one_percentile(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    s = metrics.latency_summary(ev, ["event_type"], "value", (0.95,), "minus_one")
    return s.select("event_type", "n", "p95")


def stage_histogram(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return metrics.stage_histogram(ev, "event_type", "value").select("stage", "le", "cum_count")


def stage_histogram_quantile(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    h = metrics.stage_histogram(ev, "event_type", "value")
    out = None
    for q, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
        x = metrics.histogram_quantile(h, q, name)
        out = x if out is None else out.join(x, "stage", "outer")
    return out.select("stage", *[F.round(c, 9).alias(c) for c in ("p50", "p95", "p99")])


def rate_5m(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    r = metrics.sliding_rate(ev, "ts", ["event_type"])
    return r.select(F.col("window_start").cast("timestamp").alias("window_start"), "event_type", "n",
                    F.round("rate", 9).alias("rate"))


def rate_5m_by_dimension(spark, sf_dir):
    """T5 dashboard rates: per sliding 5-minute window, events per second by
    decision, by (bounded) source, by tenant and by endpoint (the event
    type) — one grouping-sets pass."""
    v = _verdict_log(spark, sf_dir).withColumn("source", metrics.safe_source("source")).withColumn("endpoint", F.col("event_type")) \
        .withColumn("w", F.window("ts", "5 minutes", "1 minute").start)
    dims = ["decision", "source", "tenant", "endpoint"]
    g = v.groupingSets([["w", d] for d in dims], "w", *dims).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    # the grouping id has a bit per column that is not grouped by
    only = lambda i: F.col("gid") == 15 - (8 >> i)
    dim = F.when(only(0), dims[0]).when(only(1), dims[1]).when(only(2), dims[2]).otherwise(dims[3])
    val = F.when(only(0), F.col(dims[0])).when(only(1), F.col(dims[1])).when(only(2), F.col(dims[2])).otherwise(F.col(dims[3]))
    return g.select(F.col("w").cast("timestamp").alias("window_start"), dim.alias("dimension"), val.alias("value"),
                    "n", F.round(F.col("n") / 300.0, 9).alias("rate"))


def concurrency_peak(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return metrics.concurrency_peaks(ev, "ts", "value").select(
        F.col("bucket_start").cast("timestamp").alias("bucket_start"), "n_starts", "peak")


def quota_token_bucket(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    cap, refill = folds.bucket_parameters(QUOTA_RPM, QUOTA_BURST_SECONDS)
    out = folds.token_bucket(ev, "user_id", "ts", "event_id", cap, refill)
    return out.select("event_id", F.col("user_id").cast("long").alias("user_id"), "allowed",
                      F.round("retry_after", 6).alias("retry_after"))


# test callers come a few times a day: quotas are scaled down so that some
# requests are denied
QUOTA_SLOWDOWN = 10_000.0


def quota_by_principal(spark, sf_dir):
    """T3b + T3: callers with a live grant are ``key:<name>`` with their
    tenant's override (region-0 tenants: 30 rpm) or 120 rpm; others are
    anonymous ``ip:`` identities at 20 rpm, all over ``QUOTA_SLOWDOWN``;
    10 s burst."""
    ev = table(spark, sf_dir, "events")
    c = table(spark, sf_dir, "customer").where(F.col("c_acctbal") >= 0).select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("key_id"), "c_nationkey")
    n = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"),
        F.when(F.col("n_regionkey") == 0, F.lit(30.0)).alias("tenant_rpm"))
    p = ev.join(c, "user_id", "left").join(n, "c_nationkey", "left") \
        .withColumn("authenticated", F.col("key_id").isNotNull()) \
        .withColumn("client_ip", F.concat(F.lit("user-"), F.col("user_id").cast("string")))
    p = p.withColumn("identity", folds.quota_identity("authenticated", "key_id", "client_ip")) \
        .withColumn("rpm", folds.quota_rpm("authenticated", "tenant_rpm") / F.lit(QUOTA_SLOWDOWN))
    cap, refill = folds.bucket_columns("rpm", C.BURST_SECONDS)
    p = p.withColumn("cap", cap).withColumn("rate", refill)
    out = folds.token_bucket(p, "identity", "ts", "event_id", "cap", "rate")
    return out.select("event_id", "identity", "allowed", F.round("retry_after", 6).alias("retry_after"),
                      F.when(~F.col("allowed"), folds.retry_after_header("retry_after")).alias("retry_header"))


def verdict_reuse_within_ttl(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn(
        "prompt_hash", F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), "event_type"), 256))
    return folds.ttl_reuse(ev, "prompt_hash", "ts", "event_id", TTL)


def verdict_reuse_doubling(spark, sf_dir):
    """T1 again, computed by pointer doubling (no per-key sequential pass);
    must equal ``verdict_reuse_within_ttl``."""
    ev = table(spark, sf_dir, "events").withColumn(
        "prompt_hash", F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), "event_type"), 256))
    return folds.ttl_reuse_doubling(ev, "prompt_hash", "ts", "event_id", TTL)


def failure_run_intervals(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error")
    out = folds.circuit_breaker(ev, "user_id", "ts", "event_id", "ok", C.BREAKER_FAILURE_THRESHOLD,
                                BREAKER_COOLDOWN)
    return out.select("event_id", F.col("user_id").cast("long").alias("user_id"), "skipped", "open_after",
                      "failures_after")


QUERIES = {
    "policy_decision": policy_decision,
    "combined_output_decision": combined_output_decision,
    "outcome_counters": outcome_counters,
    "unknown_source_counter": unknown_source_counter,
    "latency_index_percentiles": latency_index_percentiles,
    "latency_minus_one_percentile": latency_minus_one_percentile,
    "stage_histogram": stage_histogram,
    "stage_histogram_quantile": stage_histogram_quantile,
    "rate_5m": rate_5m,
    "rate_5m_by_dimension": rate_5m_by_dimension,
    "concurrency_peak": concurrency_peak,
    "quota_token_bucket": quota_token_bucket,
    "quota_by_principal": quota_by_principal,
    "verdict_reuse_within_ttl": verdict_reuse_within_ttl,
    "verdict_reuse_doubling": verdict_reuse_doubling,
    "failure_run_intervals": failure_run_intervals,
}
