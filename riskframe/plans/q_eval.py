"""Evaluation queries over the driver tables.

Binding: ``events`` is a scored stream — ``value`` is the detector score, an
``error`` event is the positive class and ``k_band`` (``props.k`` in bands
of 25) is the slice key.  ``documents`` joined with ``labels`` gives a
labelled corpus (``toxic`` is the attack label).
"""
from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import evaluate as EV
from riskframe.operators import roc
from riskframe.sources.tables import table

BUDGET = 0.05
THRESHOLD = 200.0
REPLICATES = 50


def scored_events(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id", "ts", "user_id",
        F.col("value").alias("score"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        (F.get_json_object("props", "$.k").try_cast("int") / 25).cast("int").alias("k_band"))


def _table(spark, sf_dir):
    return roc.score_table(scored_events(spark, sf_dir), "score", "label", ["k_band"])


def roc_auc_by_slice(spark, sf_dir):
    return roc.auc(_table(spark, sf_dir), ["k_band"])


def roc_points(spark, sf_dir):
    return roc.roc_points(_table(spark, sf_dir), ["k_band"])


def pr_points(spark, sf_dir):
    return roc.pr_points(_table(spark, sf_dir), ["k_band"])


def recall_at_fpr(spark, sf_dir):
    return roc.recall_at_fpr(_table(spark, sf_dir), BUDGET, ["k_band"])


def threshold_at_fpr_rank(spark, sf_dir):
    return roc.threshold_at_fpr_rank(_table(spark, sf_dir), BUDGET, ["k_band"])


def roc_trapezoid(spark, sf_dir):
    t = roc.roc_trapezoid(_table(spark, sf_dir), ["k_band"])
    return t.select("k_band", F.round("area", 9).alias("area"))


def confusion_at_threshold(spark, sf_dir):
    return EV.confusion_at_threshold(scored_events(spark, sf_dir), "score", "label", THRESHOLD, ["k_band"])


def evaluate_slices(spark, sf_dir):
    ev = scored_events(spark, sf_dir).withColumn(
        "etype_day", F.dayofweek("ts").cast("int"))
    return EV.evaluate_slices(ev, "score", "label", ["etype_day"], BUDGET, THRESHOLD)


def labelled_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return d.join(lab, "doc_id").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"),
                                        "label")


def bootstrap_auc_ci(spark, sf_dir):
    return EV.bootstrap_auc(labelled_docs(spark, sf_dir), "doc_id", "score", "label", ["lang"],
                            replicates=REPLICATES, alpha=0.05, seed=0)


def bootstrap_recall_ci(spark, sf_dir):
    return EV.bootstrap_recall(labelled_docs(spark, sf_dir), "doc_id", "score", "label", ["lang"], budget=BUDGET,
                               replicates=REPLICATES, alpha=0.05, seed=0)


QUERIES = {
    "roc_auc_by_slice": roc_auc_by_slice,
    "roc_points": roc_points,
    "pr_points": pr_points,
    "recall_at_fpr": recall_at_fpr,
    "threshold_at_fpr_rank": threshold_at_fpr_rank,
    "roc_trapezoid": roc_trapezoid,
    "confusion_at_threshold": confusion_at_threshold,
    "evaluate_slices": evaluate_slices,
    "bootstrap_auc_ci": bootstrap_auc_ci,
    "bootstrap_recall_ci": bootstrap_recall_ci,
}
