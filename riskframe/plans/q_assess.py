"""End-to-end assessment of the prompt table.

``assess_cascade`` composes every stage over stored vectors.
``assess_prompts`` (rows-only check) embeds the text itself: every document is a prompt from the default tenant with GENERAL
capability.  The pipeline masks PII, normalises and applies the rule pack
(vetoed prompts leave the cascade here: filter-and-route), embeds the
remaining clean text with the hashed TF-IDF embedder fitted on the corpus,
scores it against the benchmark passages as the threat-anchor pack (in
blocks of bounded size), runs the fast path and the anchors-only
decision bands, arbitrates the ambiguous band from a judge-verdict table
(none here: the judge is offline, so the band fails closed), maps risk to
the tenant policy and projects the audit row.
"""
from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskframe import config as C
from riskframe.functions import text as X
from riskframe.operators import cascade as K
from riskframe.operators import govern, learn, screening
from riskframe.operators import vectors as V
from riskframe.plans import bound, q_vectors
from riskframe.sources import io
from riskframe.sources.tables import table, text_table

DIMS = 1 << 10


def assess_prompts(spark, sf_dir):
    docs = text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "source", "text")
    # screened rows feed both routes and the embedder fit: keep the columns
    # that those read, with one copy of the text (lineage stays intact, so
    # lost blocks are recomputed)
    s = screening.screen_prompts(docs).select("doc_id", "source", "pii_found", "violation", "clean_text").persist(StorageLevel.MEMORY_AND_DISK)
    vetoed = s.where(F.col("violation").isNotNull())
    rest = s.where(F.col("violation").isNull())
    emb = learn.hashed_tfidf_embedder("clean_text", DIMS).fit(s.select("clean_text"))
    bench = table(spark, sf_dir, "benchmark").select(F.col("text").alias("clean_text"))
    anchors = emb.transform(bench).select(vector_to_array("embedding_vec").alias("a"))
    # only the vector crosses into Python, not the text
    x = emb.transform(rest).select("doc_id", "source", "pii_found", vector_to_array("embedding_vec").alias("v"))
    x = V.anchor_max_blocks(x, "v", anchors, "a", "threat_score").drop("v")
    x = x.withColumn("meta_intent_score", F.lit(0.0)).withColumn("is_educational", F.lit(False))
    fast = K.fast_path("meta_intent_score", "threat_score")
    fused = K.fuse_signals("meta_intent_score", "threat_score", "is_educational")
    tp = K.upper_ambiguous_band("threat_score", F.lit(C.SEMANTIC_THRESHOLD_MEDIUM), F.lit(C.SEMANTIC_THRESHOLD_HIGH))
    arb = K.judge_arbitration(F.lit(None).cast("string"), tp)
    x = x.withColumn("fast", fast).withColumn("fused", fused)
    risk = F.when(F.col("fast").isNotNull(), F.col("fast.risk")).when(F.col("fused.judge_required"), arb["risk"]) \
        .otherwise(F.col("fused.risk"))
    src = F.when(F.col("fast").isNotNull(), F.col("fast.source")).when(F.col("fused.judge_required"), arb["source"]) \
        .otherwise(F.col("fused.source"))
    scored = x.select("doc_id", "source", "pii_found", risk.alias("risk"), src.alias("route"),
                      F.col("threat_score").alias("semantic_score"),
                      F.col("fused.judge_required").alias("judge_invoked"), F.lit(False).alias("symbolic_triggered"))
    veto = vetoed.select("doc_id", "source", "pii_found", F.lit("HIGH").alias("risk"),
                         F.lit("symbolic_rule").alias("route"), F.lit(1.0).alias("semantic_score"),
                         F.lit(False).alias("judge_invoked"), F.lit(True).alias("symbolic_triggered"))
    v = scored.unionByName(veto).withColumn("capability", F.lit("GENERAL")).withColumn("tenant", F.lit("default"))
    d = govern.policy_decision(v)
    return d.select("doc_id", "source", "pii_found", "risk", "route", F.round("semantic_score", 6).alias("semantic_score"),
                    "judge_invoked", "symbolic_triggered", F.col("action").alias("decision"))


def stored_verdicts(spark, sf_dir):
    """The verdict cache by text hash: labelled documents, toxic ones HIGH,
    good ones LOW, the rest not stored; the most severe of equal texts."""
    lab = table(spark, sf_dir, "labels").where("toxic = 1 or quality = 1").select("doc_id", "toxic")
    d = table(spark, sf_dir, "documents").select("doc_id", X.prompt_hash("text").alias("prompt_hash")).join(lab, "doc_id")
    return d.groupBy("prompt_hash").agg(F.max("toxic").alias("t")).select(
        "prompt_hash", F.struct(F.when(F.col("t") == 1, "HIGH").otherwise("LOW").alias("risk"),
                                F.when(F.col("t") == 1, 1.0).otherwise(0.05).alias("score")).alias("cached"))


def assess_cascade(spark, sf_dir):
    """C8 in one composition.  Prompts are the documents; their stored
    vector (same id) gives the signals, and none leaves them open; the veto
    pack is the bound one; a third of the vectors' labels each gets a SAFE,
    a DANGEROUS and no answer of the hazard classifier, the judge answers by
    label; the default tenant's policy decides."""
    docs = text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    s = screening.screen_prompts(docs, rules=bound.RULES).select("doc_id", "violation", X.prompt_hash("text").alias("prompt_hash"))
    sig = q_vectors.signals(spark, sf_dir).join(q_vectors.judge_verdicts(spark, sf_dir), "vec_id", "left").withColumnRenamed("vec_id", "doc_id")
    hazard = F.when(F.col("label") % 3 == 0, "SAFE").when(F.col("label") % 3 == 1, "DANGEROUS")
    x = s.join(stored_verdicts(spark, sf_dir), "prompt_hash", "left").join(sig, "doc_id", "left").withColumn("hazard", hazard)
    x = K.assess(x, q_vectors._features(), K.load_policy(), "meta_intent_score", "threat_score", "is_educational", "domain_aligned",
                 "cached", "violation", "hazard", "judge_verdict")
    x = x.withColumn("tenant", F.lit("default")).withColumn("capability", F.lit("GENERAL"))
    return govern.policy_decision(x).select(
        "doc_id", "risk", "source", F.round("semantic_score", 6).alias("semantic_score"), "topicality", "judge_invoked",
        "symbolic_triggered", "triggering_class", F.col("action").alias("decision"))


def audit_log(spark, sf_dir):
    """S9 projection of the assessment: hashes, never the prompt text."""
    a = assess_prompts(spark, sf_dir)
    # hashed before the join: the texts do not move
    docs = table(spark, sf_dir, "documents").select("doc_id", X.prompt_hash("text").alias("prompt_hash"))
    v = a.join(docs, "doc_id").withColumn("request_id", F.col("doc_id").cast("string")) \
        .withColumnRenamed("route", "source_route").withColumn("capability", F.lit("GENERAL")) \
        .withColumn("tenant", F.lit("default")).withColumn("timestamp", F.lit(None).cast("timestamp")) \
        .withColumn("source", F.col("source_route"))
    return io.audit_rows(v).drop("timestamp")


QUERIES = {
    "assess_prompts": assess_prompts,
    "assess_cascade": assess_cascade,
    "audit_log": audit_log,
}
