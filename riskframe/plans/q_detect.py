"""Detector-evaluation queries over the labelled corpus.

Binding: the suite is ``documents`` joined with ``labels``; ``toxic`` is the
attack label and the attack class is ``jailbreak`` for toxic low-quality
rows, ``harmful_content`` for other toxic rows, else ``benign``.  Four
native detectors score every row; the registry declares their targets and
the sources they were trained on (excluded from their evaluation).
"""
from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import corpus, detectors as D
from riskframe.operators import roc
from riskframe.session import cut_lineage
from riskframe.sources.tables import table, text_table

CLASSES = ["harmful_content", "jailbreak"]
SWEEP = [0.01, 0.05, 0.1, 0.2]
BUDGET = 0.05


def _frac(pattern: str):
    return lambda: F.length(F.regexp_replace("text", pattern, "")) / F.greatest(F.lit(1), F.length("text"))


DETECTORS = [
    D.Detector("length", ("harmful_content",), ("src0", "src1"), column=lambda: F.least(F.lit(1.0), F.col("n_chars") / 20000.0)),
    D.Detector("digits", ("jailbreak",), (), column=_frac("[^0-9]")),
    D.Detector("upper", ("harmful_content", "jailbreak"), ("src2",), column=_frac("[^A-Z]")),
    D.Detector("punct", (), (), column=_frac("[^!?.,;:]")),
]
KEEP = ["source", "lang", "label", "attack_class"]


def suite(spark, sf_dir):
    d = text_table(spark, sf_dir, "documents", "doc_id")
    lab = table(spark, sf_dir, "labels")
    cls = (F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "jailbreak")
           .when(F.col("toxic") == 1, "harmful_content").otherwise("benign"))
    return d.join(lab, "doc_id").select("doc_id", "source", "lang", "text", "n_chars",
                                        F.col("toxic").alias("label"), cls.alias("attack_class"))


def scored(spark, sf_dir):
    """The score store (S4): written once, then read by every report."""
    return cut_lineage(D.score_long(suite(spark, sf_dir), "doc_id", DETECTORS, keep=KEEP))


def registry(spark):
    return D.registry_frame(spark, DETECTORS)


def detector_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("detector", "id", F.round("score", 9).alias("score"))


def scoring_coverage(spark, sf_dir):
    store = scored(spark, sf_dir).select("detector", "id", "score")
    allDocs = table(spark, sf_dir, "documents").select("doc_id")
    return D.coverage(store, allDocs, "doc_id", registry(spark))


def detector_comparison(spark, sf_dir):
    c = D.comparison(scored(spark, sf_dir), registry(spark), BUDGET)
    return c.select("detector", "rows_excluded", "n", "n_pos", "n_neg", "auc", "recall",
                    F.round("threshold", 9).alias("threshold"), "actual_fpr")


def per_class_detection_rate(spark, sf_dir):
    reg = registry(spark)
    s = scored(spark, sf_dir)
    kept = D.exclude_contaminated(s, reg)
    thr = roc.recall_at_fpr(roc.score_table(kept, "score", "label", ["detector"]), BUDGET, ["detector"]) \
        .select("detector", "threshold")
    return D.per_class_detection(kept, thr, reg, CLASSES)


def per_language_auc(spark, sf_dir):
    kept = D.exclude_contaminated(scored(spark, sf_dir), registry(spark))
    a = roc.auc(roc.score_table(kept, "score", "label", ["detector", "lang"]), ["detector", "lang"])
    return a.where((F.col("n_pos") > 0) & (F.col("n_neg") > 0) & (F.col("n_pos") + F.col("n_neg") >= 10))


def class_vs_benign_auc(spark, sf_dir):
    return D.class_vs_benign(scored(spark, sf_dir), CLASSES)


def polarity_check(spark, sf_dir):
    p = D.polarity(scored(spark, sf_dir), registry(spark))
    return p.select("detector", F.round("mean_attack", 9).alias("mean_attack"),
                    F.round("mean_benign", 9).alias("mean_benign"), "polarity_ok")


def ensemble_vs_single(spark, sf_dir):
    s = scored(spark, sf_dir).select("detector", "id", "score", "label")
    return D.ensemble_vs_single(s, "id", replicates=50, seed=0)


def score_quantiles_by_class(spark, sf_dir):
    q = D.quantiles_by(scored(spark, sf_dir), ["detector", "attack_class"], "score")
    return q.select("detector", "attack_class", "n", *[F.round(c, 9).alias(c) for c in ("p25", "p50", "p75")])


def recall_sweep(spark, sf_dir):
    s = scored(spark, sf_dir).where(F.col("attack_class").isin(*CLASSES))
    x = s.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in SWEEP])))
    return x.groupBy("detector", "attack_class", "threshold").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("score") >= F.col("threshold")).cast("double")).alias("detected"))


def _two_runs(spark, sf_dir):
    """The predictions of one detector at two thresholds."""
    s = D.score_long(suite(spark, sf_dir), "doc_id", [d for d in DETECTORS if d.name == "upper"], keep=KEEP)
    return (s.select("id", "label", (F.col("score") >= 0.05).alias("pred")),
            s.select("id", (F.col("score") >= 0.04).alias("pred")))


def run_diff(spark, sf_dir):
    return D.run_diff(*_two_runs(spark, sf_dir), "id")


def flipped_rows(spark, sf_dir):
    return D.flipped_rows(*_two_runs(spark, sf_dir), "id")


def confusion_change(spark, sf_dir):
    return D.confusion_change(*_two_runs(spark, sf_dir), "id")


def class_vs_benign_at_budget(spark, sf_dir):
    c = D.class_vs_benign_at_budget(scored(spark, sf_dir), CLASSES, BUDGET)
    return c.select("detector", "vs_class", "auc", "n_pos", "n_neg", "recall", F.round("threshold", 9).alias("threshold"))


REPORT_REPLICATES = 50


def detector_report(spark, sf_dir):
    return D.report(scored(spark, sf_dir), registry(spark), CLASSES, BUDGET, replicates=REPORT_REPLICATES)


def feature_matrix(spark, sf_dir):
    """One row per document that all four detectors scored; ``punct``
    scored the English ones only."""
    x = suite(spark, sf_dir)
    store = D.score_long(x, "doc_id", DETECTORS[:3]).unionByName(D.score_long(x.where(F.col("lang") == "en"), "doc_id", DETECTORS[3:]))
    names = [d.name for d in DETECTORS]
    matrix, _ = D.feature_matrix(cut_lineage(store), names)
    return matrix.select("id", *[F.round(n, 9).alias(n) for n in names])


def vowel_share(texts):
    """A model standing in for a remote scorer: it fails on a text without a
    full stop."""
    out = []
    for t in texts:
        if "." not in t:
            raise ValueError("no sentence")
        out.append(sum(t.count(v) for v in "aeiou") / len(t))
    return out


def model_scores(spark, sf_dir):
    """U-1: rows the model fails on stay unscored, their batch does not."""
    d = text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    s = D.model_scores(d, "doc_id", "text", D.Detector("vowels", batch_fn=vowel_share))
    return s.select("detector", "id", F.round("score", 9).alias("score"))


def flag_union_rate(spark, sf_dir):
    kept = scored(spark, sf_dir)
    thr = roc.recall_at_fpr(roc.score_table(kept, "score", "label", ["detector"]), BUDGET, ["detector"]) \
        .select("detector", "threshold")
    flags = kept.join(thr, "detector").groupBy("id", "label", "attack_class").agg(
        F.max((F.col("score") >= F.col("threshold")).cast("int")).alias("flag"))
    attacks = flags.where(F.col("label") == 1)
    per = attacks.groupBy("attack_class").agg(F.count(F.lit(1)).alias("n"), F.avg("flag").alias("rate"))
    allc = attacks.agg(F.count(F.lit(1)).alias("n"), F.avg("flag").alias("rate")).select(
        F.lit("all").alias("attack_class"), "n", "rate")
    return per.unionByName(allc)


def carry_over_scores(spark, sf_dir):
    s = suite(spark, sf_dir)
    first = D.score_long(s, "doc_id", DETECTORS[:2])
    second = D.score_long(table(spark, sf_dir, "documents"), "doc_id", DETECTORS[:1]) \
        .withColumn("score", F.round("score", 2))
    return D.carry_over([first, second]).select("detector", "id", F.round("score", 9).alias("score"))


def complete_detectors_on_sample(spark, sf_dir):
    s = suite(spark, sf_dir)
    store = D.score_long(s, "doc_id", DETECTORS[:3]).unionByName(
        D.score_long(s.where(F.col("lang") == "en"), "doc_id", DETECTORS[3:]))
    sample = corpus.capped_sample(s, "attack_class", "doc_id", 30, seed=7)
    return D.complete_on_sample(store, sample, "doc_id")


QUERIES = {
    "detector_scores": detector_scores,
    "scoring_coverage": scoring_coverage,
    "detector_comparison": detector_comparison,
    "per_class_detection_rate": per_class_detection_rate,
    "per_language_auc": per_language_auc,
    "class_vs_benign_auc": class_vs_benign_auc,
    "polarity_check": polarity_check,
    "ensemble_vs_single": ensemble_vs_single,
    "score_quantiles_by_class": score_quantiles_by_class,
    "recall_sweep": recall_sweep,
    "run_diff": run_diff,
    "feature_matrix": feature_matrix,
    "model_scores": model_scores,
    "flipped_rows": flipped_rows,
    "confusion_change": confusion_change,
    "class_vs_benign_at_budget": class_vs_benign_at_budget,
    "detector_report": detector_report,
    "flag_union_rate": flag_union_rate,
    "carry_over_scores": carry_over_scores,
    "complete_detectors_on_sample": complete_detectors_on_sample,
}
