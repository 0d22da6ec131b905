"""Vector, fusion and cascade queries over ``embeddings``.

Binding: each vector is a prompt embedding and ``label`` its topic.  The
first vector of each label (smallest ``vec_id``) is that label's anchor:
labels 0-1 are the harmful-content anchors, 2-3 prompt injection, 4-6
jailbreak, 7-8 meta-intent and 9 educational; the domain corpus is every
label-9 vector.  Ground truth: labels 0-6 are attacks.  The judge-verdict
table is derived per label (0-3 DANGEROUS, 4-6 AMBIGUOUS, 7-8 SAFE, 9 no
answer), standing in for the pluggable judge.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from riskframe import config as C
from riskframe.operators import cascade as K
from riskframe.operators import evaluate as EV
from riskframe.operators import similar as S
from riskframe.operators import vectors as V
from riskframe.sources import io
from riskframe.sources.tables import table

CLASS_LABELS = {"harmful_content": [0, 1], "prompt_injection": [2, 3], "jailbreak": [4, 5, 6]}
META_LABELS = [7, 8]
EDU_LABELS = [9]
ANCHOR_LABELS = sorted({x for labs in CLASS_LABELS.values() for x in labs} | {*META_LABELS, *EDU_LABELS})
DOMAIN_LABEL = 9
ROUND = 6


def _anchors(spark, sf_dir) -> dict:
    # the labels that name anchor sets: a fixed list, whatever the table holds
    emb = table(spark, sf_dir, "embeddings").where(F.col("label").isin(ANCHOR_LABELS))
    rows = V.collect_small(V.first_per_group(emb, "label", "vec_id", "embedding"))
    return {int(r["label"]): [float(x) for x in r["embedding"]] for r in rows}


def _domain_centroid(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").where(F.col("label") == DOMAIN_LABEL)
    rows = V.collect_small(V.centroids(emb, "label", "embedding"), 1)
    return [float(x) for x in rows[0]["centroid"]] if rows else None


def signals(spark, sf_dir):
    """One row of detector signals per vector, written once per input and
    read back by every query that needs it (K5)."""
    emb = table(spark, sf_dir, "embeddings")
    key = io.input_fingerprint(spark, emb, CLASS_LABELS, META_LABELS, EDU_LABELS, DOMAIN_LABEL, C.DOMAIN_THRESHOLD, C.EDUCATIONAL_THRESHOLD)
    return io.stored(spark, "signals", key, lambda: extract_signals(spark, sf_dir))


def extract_signals(spark, sf_dir):
    """The cosines to all anchors and the domain centroid come from one
    matrix product a batch."""
    a = _anchors(spark, sf_dir)
    labels = sorted(a)
    cen = _domain_centroid(spark, sf_dir)
    matrix = [a[x] for x in labels] + ([cen] if cen else [])
    best = lambda labs: V.best_cosine("cos", [labels.index(x) for x in labs if x in a])
    emb = table(spark, sf_dir, "embeddings").withColumn(
        "cos", V.anchor_cosines("embedding", matrix) if matrix else F.array().cast("array<double>"))
    threat_labels = [lab for labs in CLASS_LABELS.values() for lab in labs]
    s = emb.select(
        "vec_id", "label", best(threat_labels).alias("threat_score"),
        F.greatest(best(META_LABELS), F.lit(0.0)).alias("meta_intent_score"), best(EDU_LABELS).alias("educational_score"),
        *[best(labs).alias(f"{cls}_score") for cls, labs in CLASS_LABELS.items()],
        (F.col("cos")[len(labels)] if cen else F.lit(None).cast("double")).alias("domain_score"),
        (F.col("label") <= 6).cast("int").alias("attack"), F.lit(False).alias("symbolic"))
    s = s.withColumn("domain_aligned", F.col("domain_score") >= C.DOMAIN_THRESHOLD) \
        .withColumn("is_educational", F.col("educational_score") > C.EDUCATIONAL_THRESHOLD)
    return s


def _features():
    return {"anchors": "threat_score", "injection": "prompt_injection_score",
            "jailbreak": "jailbreak_score", "toxicity": "harmful_content_score"}


def anchor_max_similarity(spark, sf_dir):
    s = signals(spark, sf_dir)
    return s.select("vec_id", F.round("threat_score", ROUND).alias("threat_score"),
                    F.round("meta_intent_score", ROUND).alias("meta_intent_score"),
                    "is_educational", F.round("domain_score", ROUND).alias("domain_score"), "domain_aligned")


def centroid_similarity(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    cen = V.centroids(emb, "label", "embedding")
    ncen = V.centroids(emb, "label", "embedding", normalize=True).withColumnRenamed("centroid", "ncentroid")
    j = emb.join(cen, "label").join(ncen, "label")
    v = V.as_double_array("embedding")
    return j.select("vec_id", "label", F.round(V.cosine(v, "centroid"), ROUND).alias("centroid_sim"),
                    F.round(V.dot(V.l2_normalize(v), "ncentroid"), ROUND).alias("unit_centroid_dot"))


def with_label(nn, vectors):
    """Adds the labels of both ends of ``vec_id, nn_id`` pairs."""
    lab = vectors.select("vec_id", "label")
    return nn.join(lab, "vec_id").join(lab.select(F.col("vec_id").alias("nn_id"), F.col("label").alias("nn_label")), "nn_id")


def nearest_neighbour(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    nn = with_label(S.nearest_other(emb, "vec_id", "embedding"), emb)
    return nn.select("vec_id", "nn_id", F.round("sim", ROUND).alias("sim"),
                     (F.col("label") == F.col("nn_label")).alias("same_label"))


# a reworded twin of every vector: alternate components grow and shrink by an
# amount chosen by the id, so that pairs lie above each threshold of the sweep
REWORDED = [0.0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.45]


def reworded(emb):
    """The twins, with ids ``-1 - vec_id``; one in three has another label."""
    amount = F.element_at(F.array(*[F.lit(x) for x in REWORDED]), (F.pmod("vec_id", F.lit(len(REWORDED))) + 1).cast("int"))
    # a column of its own: inside a lambda, ``vec_id`` would be the new one
    x = emb.withColumn("amount", amount)
    bent = F.transform(V.as_double_array("embedding"), lambda x, i: x * (1 + F.col("amount") * F.when(i % 2 == 0, 1.0).otherwise(-1.0)))
    label = F.when(F.pmod("vec_id", F.lit(3)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return x.select((-1 - F.col("vec_id")).alias("vec_id"), bent.alias("embedding"), label.cast("long").alias("label"))


def phrases(spark, sf_dir):
    """All vectors and their twins."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", V.as_double_array("embedding").alias("embedding"), F.col("label").cast("long").alias("label")).unionByName(reworded(emb))


def collision_sweep(spark, sf_dir):
    """At each threshold, nearest-neighbour pairs at or above it and
    the share whose labels agree/disagree (unsafe when >1% disagree)."""
    vectors = phrases(spark, sf_dir)
    nn = with_label(S.nearest_other(vectors, "vec_id", "embedding", min(C.COLLISION_THRESHOLDS)), vectors)
    n = vectors.count()
    thr = F.explode(F.array(*[F.lit(float(t)) for t in C.COLLISION_THRESHOLDS])).alias("threshold")
    x = nn.select(thr, "sim", (F.col("label") == F.col("nn_label")).alias("same"))
    agg = x.groupBy("threshold").agg(F.count_if(F.col("sim") >= F.col("threshold")).alias("n_hits"),
                                     F.count_if((F.col("sim") >= F.col("threshold")) & F.col("same")).alias("n_same"))
    pct_same = F.when(F.col("n_hits") > 0, F.col("n_same") / F.col("n_hits"))
    return agg.select("threshold", "n_hits", F.round(pct_same, ROUND).alias("pct_same"),
                      F.round(1 - pct_same, ROUND).alias("pct_diff"),
                      F.round(F.try_divide(F.col("n_hits"), F.lit(n)), ROUND).alias("hit_rate"),
                      F.coalesce((1 - pct_same) > 0.01, F.lit(False)).alias("unsafe"))


def fused_score(spark, sf_dir):
    pol = K.load_policy()
    s = signals(spark, sf_dir)
    f = _features()
    return s.select("vec_id", F.round(K.fused_score(f, pol), 9).alias("fusion_score"),
                    K.fusion_available(f, pol).alias("fusion_available"))


def per_class_verdict(spark, sf_dir):
    pol = K.load_policy()
    s = signals(spark, sf_dir)
    w = K.per_class_verdict(_features(), pol)
    return s.select("vec_id", w["triggering_class"].alias("triggering_class"),
                    F.round(w["score"], 9).alias("class_score"), w["tier"].alias("tier"))


def judge_verdicts(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    lab = F.col("label")
    v = (F.when(lab <= 3, "DANGEROUS").when(lab <= 6, "AMBIGUOUS").when(lab <= 8, "SAFE"))
    return emb.select("vec_id", v.alias("judge_verdict"))


def verdicts(spark, sf_dir, domain_mode: str = "advisory"):
    """C8 without the cache stage: fast path, fused decision with per-class
    fusion, judge arbitration for the ambiguous band, row projection."""
    pol = K.load_policy()
    f = _features()
    s = signals(spark, sf_dir).join(judge_verdicts(spark, sf_dir), "vec_id", "left")
    w = K.per_class_verdict(f, pol)
    s = s.withColumn("fusion_available", K.fusion_available(f, pol)) \
        .withColumn("w", w) \
        .withColumn("fusion_score", F.col("w.score")) \
        .withColumn("fusion_high", F.col("w.threshold_high")) \
        .withColumn("fusion_medium", F.col("w.threshold_medium"))
    fast = K.fast_path("meta_intent_score", "threat_score")
    fused = K.fuse_signals("meta_intent_score", "threat_score", "is_educational",
                           "domain_aligned" if domain_mode != "off" else None,
                           "fusion_available", "fusion_score", "fusion_high", "fusion_medium",
                           domain_mode=domain_mode)
    s = s.withColumn("fast", fast).withColumn("fused", fused)
    tp = F.when(F.col("fusion_available"),
                K.upper_ambiguous_band("fusion_score", "fusion_medium", "fusion_high")) \
        .otherwise(K.upper_ambiguous_band("threat_score", F.lit(C.SEMANTIC_THRESHOLD_MEDIUM),
                                          F.lit(C.SEMANTIC_THRESHOLD_HIGH)))
    arb = K.judge_arbitration("judge_verdict", tp)
    judged = F.col("fused.judge_required")
    risk = F.when(F.col("fast").isNotNull(), F.col("fast.risk")) \
        .when(judged, arb["risk"]).otherwise(F.col("fused.risk"))
    source = F.when(F.col("fast").isNotNull(), F.col("fast.source")) \
        .when(judged, arb["source"]).otherwise(F.col("fused.source"))
    topic = F.when(F.col("fast").isNotNull(), F.lit("UNKNOWN")).otherwise(F.col("fused.topicality"))
    judge_invoked = F.col("fast").isNull() & judged
    return s.select("vec_id", "attack", risk.alias("risk"), source.alias("source"),
                    topic.alias("topicality"), judge_invoked.alias("judge_invoked"),
                    F.when(F.col("fast").isNotNull(), F.lit(None).cast("string"))
                    .otherwise(F.col("w.triggering_class")).alias("triggering_class"))


def cascade_decision(spark, sf_dir):
    return verdicts(spark, sf_dir)


def operational_vs_strict_confusion(spark, sf_dir):
    v = verdicts(spark, sf_dir)
    ops = EV.confusion(v, K.positive_prediction("risk", "source", strict=False), "attack") \
        .withColumn("view", F.lit("operational"))
    strict = EV.confusion(v, K.positive_prediction("risk", "source", strict=True), "attack") \
        .withColumn("view", F.lit("strict"))
    return EV.derived_metrics(ops.unionByName(strict))


def confusion_grid_sweep(spark, sf_dir):
    s = signals(spark, sf_dir)
    return EV.grid_sweep(s, "meta_intent_score", "threat_score", "symbolic", "attack")


def best_grid_point(spark, sf_dir):
    return EV.best_grid_point(confusion_grid_sweep(spark, sf_dir))


def union_fpr_budget(spark, sf_dir):
    s = signals(spark, sf_dir)
    cls = ["harmful_content_score", "prompt_injection_score", "jailbreak_score"]
    u = EV.union_fpr_budget(s, cls, "attack", "vec_id", C.DEFAULT_FPR_BUDGET)
    # thresholds are cosine values: rounded like every other cosine output
    return u.select("k", "n_neg", "alpha", "union_fpr", *[F.round(f"thr_{c}", 9).alias(f"thr_{c}") for c in cls])


QUERIES = {
    "anchor_max_similarity": anchor_max_similarity,
    "centroid_similarity": centroid_similarity,
    "nearest_neighbour": nearest_neighbour,
    "collision_sweep": collision_sweep,
    "fused_score": fused_score,
    "per_class_verdict": per_class_verdict,
    "cascade_decision": cascade_decision,
    "operational_vs_strict_confusion": operational_vs_strict_confusion,
    "confusion_grid_sweep": confusion_grid_sweep,
    "best_grid_point": best_grid_point,
    "union_fpr_budget": union_fpr_budget,
}
