"""Fitting queries.

Bindings: fusion features are the per-class anchor similarities of
:mod:`q_vectors` with class = the anchor group of the vector's label; the
text classifier is trained on the hash-split training half of the labelled
corpus of :mod:`q_detect` and evaluated on the other half.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import evaluate as EV
from riskframe.operators import learn, roc
from riskframe.plans import q_detect, q_vectors

FEATURES = ["threat_score", "prompt_injection_score", "jailbreak_score", "harmful_content_score"]
CLASSES = ["harmful_content", "jailbreak", "prompt_injection"]


def _signals(spark, sf_dir):
    s = q_vectors.signals(spark, sf_dir)
    lab = F.col("label")
    cls = (F.when(lab <= 1, "harmful_content").when(lab <= 3, "prompt_injection").when(lab <= 6, "jailbreak")
           .otherwise("benign"))
    return s.withColumn("attack_class", cls)


# a fit is done when no component of its penalised gradient exceeds this
GRADIENT_LIMIT = 1e-6
FOLDS = 5


def fusion_policy_fit(spark, sf_dir):
    """The fitted artifact as rows (one per class and feature)."""
    s = _signals(spark, sf_dir)
    pol = learn.fit_fusion_policy(s, FEATURES, "attack", "attack_class", CLASSES)
    rows = []
    parts = [("global", pol)] + list((pol.get("per_class") or {}).items())
    for name, p in parts:
        t = p["training"]
        for f, mu, sc, w in zip(FEATURES, p["scaler_mean"], p["scaler_scale"], p["coefficients"], strict=True):
            rows.append((name, f, *[round(x, 6) for x in (mu, sc, w, p["intercept"], p["threshold_high"], p["threshold_medium"])],
                         t["n_rows"], t["n_positive"], t["gradient_norm"] <= GRADIENT_LIMIT))
    return spark.createDataFrame(rows, "policy string, feature string, mean double, scale double, coef double, intercept double, "
                                       "threshold_high double, threshold_medium double, n_rows long, n_positive long, converged boolean")


def oof_fusion_auc(spark, sf_dir):
    """E12 + E24: out-of-fold AUC with all features and without each one."""
    m = learn.marginal_value(_signals(spark, sf_dir), FEATURES, "attack", "vec_id", k=FOLDS)
    return m.select("config", F.round("auc", 6).alias("auc"), "n_pos", "n_neg")


def oof_fit_report(spark, sf_dir):
    """The training rows of every feature set and fold, and whether the
    fits, made together, reached the optimum of their penalised loss."""
    sets = learn.feature_sets(FEATURES)
    _, fits = learn.oof_table(_signals(spark, sf_dir), sets, "attack", "vec_id", FOLDS)
    rows = [(sets[g // FOLDS][0], g % FOLDS, f.n, f.n_pos, round(float(f.theta[0]), 6), f.gradient <= GRADIENT_LIMIT, f.rounds <= 15) for g, f in fits.items()]
    return spark.createDataFrame(rows, "config string, fold int, n_rows long, n_positive long, intercept double, converged boolean, few_rounds boolean")


def text_classifier_holdout_auc(spark, sf_dir):
    """U-6 + E11: train on the hash-split training part, AUC per language
    on the held-out part."""
    s = EV.holdout_split(q_detect.suite(spark, sf_dir), "doc_id", 0.3, 42)
    model = learn.fit_text_classifier(s.where("split = 'train'"), "text", "label")
    test = s.where("split = 'test'")
    sc = learn.classifier_scores(model, test, "doc_id").join(
        test.select(F.col("doc_id").alias("id"), "label", "lang"), "id")
    return roc.auc(roc.score_table(sc, "score", "label", ["lang"]), ["lang"])


QUERIES = {
    "fusion_policy_fit": fusion_policy_fit,
    "oof_fusion_auc": oof_fusion_auc,
    "oof_fit_report": oof_fit_report,
    "text_classifier_holdout_auc": text_classifier_holdout_auc,
}
