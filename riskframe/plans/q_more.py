"""Cache lookups, cascade impact reports and remaining counters.

Bindings: ``events`` of type ``view`` are verdict-cache writes keyed by
``user_id`` and the other events are lookups (J9); embeddings are the cached
prompt vectors and their reworded twins the incoming ones (J10);
the TTL-reuse fold over ``events`` pairs warm hits with their cold origin
(J13).  Other bindings are those of :mod:`q_vectors`, :mod:`q_ops` and
:mod:`q_detect`.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from riskframe import config as C
from riskframe.operators import cascade as K
from riskframe.operators import folds, lookup, metrics, roc
from riskframe.operators import similar as S
from riskframe.operators import vectors as V
from riskframe.plans import q_detect, q_ops, q_vectors
from riskframe.plans.q_stores import confirmed_verdicts, request_timeouts
from riskframe.sources.tables import table

BENIGN_CAP = 150
ABLATION_SETS = {"harmful": [0, 1], "harmful_injection": [0, 1, 2, 3], "all_threat": [0, 1, 2, 3, 4, 5, 6]}


def exact_cache_lookup(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    writes = ev.where(F.col("event_type") == "view")
    reqs = ev.where(F.col("event_type") != "view")
    return lookup.asof_cache_lookup(reqs, writes, "user_id", "ts", "event_id", "event_id", C.CACHE_TTL_SECONDS)


# asks of the reworded twins come this many hours after (or before) the
# verdict of their vector was cached: in time, too late, or too early
ASK_HOURS, ASK_STEP, ASK_BEFORE = 36, 7, 4


def cache_entries(spark, sf_dir):
    """``vec_id, embedding, ts``: a verdict per vector, cached at the time of
    the event with its number."""
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("vec_id"), F.col("ts").cast("timestamp").alias("ts"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").join(ev, "vec_id")


def fuzzy_cache_lookup(spark, sf_dir):
    """The most similar verdict cached before the request is reused if
    its cosine is above the threshold and it is within its TTL; an expired
    best match is a miss."""
    cached = cache_entries(spark, sf_dir)
    hours = F.pmod(F.col("vec_id") * ASK_STEP, F.lit(ASK_HOURS)) - ASK_BEFORE
    asked = cached.select((-1 - F.col("vec_id")).alias("vec_id"), (F.col("ts") + F.make_dt_interval(hours=hours.cast("int"))).alias("ts"))
    asks = q_vectors.reworded(table(spark, sf_dir, "embeddings")).drop("label").join(asked, "vec_id")
    index = S.sphere_index(S.unit_rows(cached, "vec_id", "embedding", "ts"))
    nn = S.nearest_within(index, S.unit_rows(asks, "vec_id", "embedding", "ts"), C.CACHE_SIMILARITY_THRESHOLD, strict=True, as_of=True)
    j = (asked.join(nn.withColumnRenamed("id", "vec_id"), "vec_id", "left")
         .join(cached.select(F.col("vec_id").alias("nn_id"), F.col("ts").alias("cached_at")), "nn_id", "left"))
    live = F.unix_micros("ts") - F.unix_micros("cached_at") < int(round(C.CACHE_TTL_SECONDS * 1_000_000))
    return j.select("vec_id", "nn_id", F.round("sim", 6).alias("sim"), F.coalesce(live, F.lit(False)).alias("hit"),
                    F.coalesce(~live, F.lit(False)).alias("expired"))


def cache_speedup(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn(
        "prompt_hash", F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), "event_type"), 256))
    r = folds.ttl_reuse(ev, "prompt_hash", "ts", "event_id", q_ops.TTL)
    hits = r.where("hit").select(F.col("event_id").alias("warm_id"), "origin_id")
    warm = ev.select(F.col("event_id").alias("warm_id"), F.col("value").alias("warm_ms"), "event_type")
    cold = ev.select(F.col("event_id").alias("origin_id"), F.col("value").alias("cold_ms"))
    j = hits.join(warm, "warm_id").join(cold, "origin_id")
    g = j.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("cold_ms").alias("avg_cold"),
                                    F.avg("warm_ms").alias("avg_warm"))
    return g.select("event_type", "n_pairs", F.round("avg_cold", 9).alias("avg_cold"),
                    F.round("avg_warm", 9).alias("avg_warm"),
                    F.round(F.try_divide(F.col("avg_cold"), F.col("avg_warm")), 9).alias("speedup"))


# bound below the production threshold, which only the anchor itself passes
HARBOUR_EDUCATIONAL = 0.10


def attack_class(label):
    """The class whose anchors carry the label, else benign."""
    c = F.lit("benign")
    for name, labs in q_vectors.CLASS_LABELS.items():
        c = F.when(label.isin(*labs), name).otherwise(c)
    return c


def safe_harbour_impact(spark, sf_dir):
    """C14: rows in the fusion policy's ambiguous band by attack class, and
    how many the educational safe harbour keeps from the judge."""
    pol, f = K.load_policy(), q_vectors._features()
    s = q_vectors.signals(spark, sf_dir).withColumn("w", K.per_class_verdict(f, pol))
    amb = s.where(K.fusion_available(f, pol) & (F.col("w.score") >= F.col("w.threshold_medium")) & (F.col("w.score") < F.col("w.threshold_high")))
    return amb.groupBy(attack_class(F.col("label")).alias("attack_class")).agg(
        F.count(F.lit(1)).alias("n_ambiguous"), F.count_if(F.col("educational_score") > HARBOUR_EDUCATIONAL).alias("n_flipped"))


def anchor_set_ablation(spark, sf_dir):
    a = q_vectors._anchors(spark, sf_dir)
    emb = table(spark, sf_dir, "embeddings")
    labels = sorted(a)
    wide = emb.withColumn("cos", V.anchor_cosines("embedding", [a[x] for x in labels]) if a else F.array().cast("array<double>")).select(
        "vec_id", (F.col("label") <= 6).cast("int").alias("attack"),
        *[V.best_cosine("cos", [labels.index(x) for x in labs if x in a]).alias(name) for name, labs in ABLATION_SETS.items()])
    stack = ", ".join(f"'{n}', `{n}`" for n in ABLATION_SETS)
    long = wide.selectExpr("vec_id", "attack", f"stack({len(ABLATION_SETS)}, {stack}) AS (anchor_set, score)")
    t = roc.score_table(long, "score", "attack", ["anchor_set"])
    return roc.auc(t, ["anchor_set"]).join(roc.recall_at_fpr(t, C.DEFAULT_FPR_BUDGET, ["anchor_set"]), "anchor_set") \
        .select("anchor_set", "auc", "recall", F.round("threshold", 9).alias("threshold"))


def grounding_check(spark, sf_dir):
    s = q_vectors.signals(spark, sf_dir)
    return s.select("vec_id", F.round("domain_score", 6).alias("grounding_score"),
                    (F.col("domain_score") < C.GROUNDING_THRESHOLD).alias("hallucination_flag"))


def breaker_open_state(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error")
    out = folds.circuit_breaker(ev, "user_id", "ts", "event_id", "ok", C.BREAKER_FAILURE_THRESHOLD,
                                q_ops.BREAKER_COOLDOWN)
    o = folds.open_intervals(out, "user_id", ev, "event_id", "ts")
    return o.select(F.col("user_id").cast("long").alias("user_id"),
                    F.col("bucket_start").cast("timestamp").alias("bucket_start"), "open")


def category_coverage(spark, sf_dir):
    return q_detect.suite(spark, sf_dir).groupBy("attack_class", "lang").agg(F.count(F.lit(1)).alias("n"))


def decision_accuracy(spark, sf_dir):
    v = q_vectors.verdicts(spark, sf_dir)
    actual = F.when(F.col("risk") == "HIGH", "BLOCK").when(F.col("risk") == "MEDIUM", "RESTRICT").otherwise("ALLOW")
    expected = F.when(F.col("attack") == 1, "BLOCK").otherwise("ALLOW")
    x = v.select("attack", (actual == expected).alias("ok"))
    per = x.groupBy(F.col("attack").cast("string").alias("slice")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_correct"))
    allr = x.agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_correct")).select(
        F.lit("all").alias("slice"), "n", "n_correct")
    return per.unionByName(allr).withColumn("accuracy", F.try_divide(F.col("n_correct"), F.col("n")))


def latency_exclusive_percentiles(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    s = metrics.latency_summary(ev, ["event_type"], "value", (0.5, 0.95, 0.99), "exclusive")
    return s.select("event_type", "n", *[F.round(c, 9).alias(c) for c in ("p50", "p95", "p99")])


def event_counters(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    cap, refill = folds.bucket_parameters(q_ops.QUOTA_RPM, q_ops.QUOTA_BURST_SECONDS)
    q = folds.token_bucket(ev, "user_id", "ts", "event_id", cap, refill)
    keyed = table(spark, sf_dir, "customer").where(F.col("c_acctbal") >= 0) \
        .select(F.col("c_custkey").cast("string").alias("user_id"), F.lit(True).alias("authenticated"))
    j = q.join(keyed, "user_id", "left").withColumn("authenticated", F.coalesce("authenticated", F.lit(False)))
    limited = j.where(~F.col("allowed")).groupBy(F.col("authenticated").cast("string").alias("label")) \
        .agg(F.count(F.lit(1)).alias("n")).withColumn("counter", F.lit("rate_limited"))
    reqs = j.groupBy(F.col("authenticated").cast("string").alias("label")) \
        .agg(F.count(F.lit(1)).alias("n")).withColumn("counter", F.lit("requests"))
    unk = metrics.unknown_sources(q_ops._verdict_log(spark, sf_dir)).select(
        F.col("source").alias("label"), "n").withColumn("counter", F.lit("unknown_source"))
    late = request_timeouts(spark, sf_dir).select(F.col("endpoint").alias("label"), F.col("n_timeouts").alias("n")).withColumn("counter", F.lit("timeouts"))
    judged = confirmed_verdicts(spark, sf_dir).where("confirmation <> 'unverified'").groupBy(F.lit("judge").alias("label")) \
        .agg(F.count(F.lit(1)).alias("n")).withColumn("counter", F.lit("judge_invocations"))
    return reduce(lambda a, b: a.unionByName(b), [limited, reqs, unk, late, judged]).select("counter", "label", "n")


def run_summary(spark, sf_dir):
    """Risk, source and topicality distributions of one run with the
    judge count and benign out-of-domain rows — one grouping-sets pass."""
    from riskframe.operators import corpus
    v = q_vectors.verdicts(spark, sf_dir)
    return corpus.slice_counts(v, ["risk", "source", "topicality"], {
        "n": F.count(F.lit(1)),
        "n_judge": F.count_if("judge_invoked"),
        "n_benign_out_of_domain": F.count_if((F.col("attack") == 0) & (F.col("topicality") == "OUT_OF_DOMAIN"))})


def benign_cap_suite(spark, sf_dir):
    """L2: attacks kept whole, benign rows capped (hash order)."""
    from riskframe.operators import corpus
    s = q_detect.suite(spark, sf_dir).select("doc_id", "label")
    return corpus.capped_sample(s, "label", "doc_id", {"0": BENIGN_CAP}, seed=42)


def stratified_sample(spark, sf_dir):
    """One class whole, the others capped."""
    from riskframe.operators import corpus
    s = q_detect.suite(spark, sf_dir).select("doc_id", "attack_class")
    return corpus.capped_sample(s, "attack_class", "doc_id", {"benign": 40, "harmful_content": 40}, seed=3)


def top_collisions(spark, sf_dir):
    """L3: the eight most similar nearest-neighbour pairs whose labels differ,
    of all rows however far their neighbour (a top-k report)."""
    vectors = q_vectors.phrases(spark, sf_dir)
    nn = q_vectors.with_label(S.nearest_other(vectors, "vec_id", "embedding"), vectors)
    return nn.where("label <> nn_label").select("vec_id", "nn_id", F.round("sim", 6).alias("sim"), "label", "nn_label") \
        .orderBy(F.desc("sim"), "vec_id").limit(8)


QUERIES = {
    "run_summary": run_summary,
    "benign_cap_suite": benign_cap_suite,
    "stratified_sample": stratified_sample,
    "top_collisions": top_collisions,
    "exact_cache_lookup": exact_cache_lookup,
    "fuzzy_cache_lookup": fuzzy_cache_lookup,
    "cache_speedup": cache_speedup,
    "safe_harbour_impact": safe_harbour_impact,
    "anchor_set_ablation": anchor_set_ablation,
    "grounding_check": grounding_check,
    "breaker_open_state": breaker_open_state,
    "category_coverage": category_coverage,
    "decision_accuracy": decision_accuracy,
    "latency_exclusive_percentiles": latency_exclusive_percentiles,
    "event_counters": event_counters,
}
