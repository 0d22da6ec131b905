"""Fitting: fusion policies (E14/E15), out-of-fold scores (E12/E24), the
default text embedder (U-2) and text classifier (U-6).

Fusion fits run together as grouped Newton rounds (:mod:`newton`), the text
classifier is a ``pyspark.ml`` job; only sums and coefficients — a few numbers
per feature — come back to the driver, where they are written into a policy
artifact that compiles to a plain column expression for scoring.
"""
from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators import evaluate as EV
from riskframe.operators import newton as NW
from riskframe.operators import roc
from riskframe.session import cut_lineage

HIGH_FPR_BUDGET = 0.05
MEDIUM_FPR_BUDGET = 0.20
PER_CLASS_HIGH_FPR_BUDGET = 0.0224
PER_CLASS_MEDIUM_FPR_BUDGET = 0.0895


def _fit_linear(df: DataFrame, features: list[str], label: str, C: float = 1.0) -> dict:
    """One L2 logistic regression (``1/2||w||^2 + C * sum(loss)``) over
    features standardised with the population std (scale 0 -> dropped)."""
    fits = NW.fit_groups(df, features, F.array(NW.member(0, label)), C=C)
    if 0 not in fits:
        raise ValueError("a fit needs rows of both labels")
    return fits[0].policy()


ROWS_PER_FIT_PARTITION = 100_000


def _sized(df: DataFrame, n_rows: int) -> DataFrame:
    """Iterative optimisers pay per task on every iteration: give the
    training set about one partition per 100k rows (at most the cluster's
    parallelism, at least one)."""
    par = df.sparkSession.sparkContext.defaultParallelism
    want = max(1, min(par, -(-n_rows // ROWS_PER_FIT_PARTITION)))
    return df.coalesce(want) if df.rdd.getNumPartitions() > want else df


def _thresholds(scored: DataFrame, budgets: list[float]) -> dict[int, list[float]]:
    """ROC-rule thresholds of every group at each budget from one score
    table and one aggregate: the feasible point with the largest (tpr,
    threshold), the origin (0, +inf) included."""
    t = roc.score_table(scored, "score", "__y", ["__g"]).where((F.col("P") > 0) & (F.col("N") > 0))
    fpr = (F.col("N") - F.col("neg_lt")) / F.col("N")
    pt = F.struct(((F.col("P") - F.col("pos_lt")) / F.col("P")).alias("tpr"), F.col("score").alias("thr"))
    origin = F.struct(F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("thr"))
    r = t.groupBy("__g").agg(*[F.greatest(F.max(F.when(fpr <= b, pt)), origin)["thr"].alias(f"b{i}") for i, b in enumerate(budgets)]).collect()
    return {x["__g"]: [float(x[f"b{i}"]) for i in range(len(budgets))] for x in r}


def fit_fusion_policy(df: DataFrame, features: list[str], label: str, class_col: str | None = None,
                      classes: list[str] | None = None) -> dict:
    """E14 (+E15 when ``classes`` are given): the policy artifact.  The
    global fit and the class-against-benign fits run together.  Rows missing
    any feature are dropped first (their count is reported)."""
    usable = cut_lineage(df.dropna(subset=features).select(*features, F.col(label).cast("int").alias("__y"),
                                                           (F.col(class_col) if class_col else F.lit(None)).cast("string").alias("__cls")))
    dropped = df.count() - usable.count()
    names = list(classes or []) if class_col else []
    one = lambda i, c: F.when((F.col("__y") == 0) | (F.col("__cls") == c), NW.member(i, F.coalesce(F.col("__cls") == c, F.lit(False))))
    members = F.array_compact(F.array(NW.member(0, "__y"), *[one(i + 1, c) for i, c in enumerate(names)]))
    fits = NW.fit_groups(usable, features, members)
    if 0 not in fits:
        raise ValueError("a fit needs rows of both labels")
    thr = _thresholds(NW.member_scores(usable, fits, features, members, []),
                      [HIGH_FPR_BUDGET, MEDIUM_FPR_BUDGET, PER_CLASS_HIGH_FPR_BUDGET, PER_CLASS_MEDIUM_FPR_BUDGET])
    describe = lambda f: {"n_rows": f.n, "n_positive": f.n_pos, "gradient_norm": f.gradient, "rounds": f.rounds}
    pol = {"version": 2, "feature_order": list(features), "rows_dropped_missing_feature": int(dropped), **fits[0].policy(),
           "threshold_high": thr[0][0], "threshold_medium": thr[0][1], "training": describe(fits[0])}
    if names:
        pol["per_class"] = {c: {**fits[i + 1].policy(), "threshold_high": thr[i + 1][2], "threshold_medium": thr[i + 1][3], "training": describe(fits[i + 1])}
                            for i, c in enumerate(names) if i + 1 in fits}
    return pol


def oof_table(df: DataFrame, configs: list[tuple[str, list[str]]], label: str, id_col: str, k: int = 5, seed: int = 42) -> tuple[DataFrame, dict]:
    """Out-of-fold scores of several feature sets.  Group ``c * k + j``
    is set ``c`` trained without fold ``j``; all of them are fitted together
    and one table ``(config, id, label, fold, score)`` holds their scores.
    Returns it with the fits."""
    features = sorted({f for _, fs in configs for f in fs})
    folded = cut_lineage(EV.kfold(df.dropna(subset=features), id_col, label, k, seed).select(id_col, label, "fold", *features))
    groups = [(c, j) for c in range(len(configs)) for j in range(k)]
    train = F.filter(F.array(*[NW.member(c * k + j, label) for c, j in groups]), lambda m: F.pmod(m["g"], F.lit(k)) != F.col("fold"))
    fits = NW.fit_groups(folded, features, train, {c * k + j: [f for f in features if f not in configs[c][1]] for c, j in groups})
    test = F.transform(F.array(*[F.lit(c) for c in range(len(configs))]),
                       lambda c: F.struct((c * k + F.col("fold")).cast("int").alias("g"), F.col(label).cast("int").alias("y")))
    s = NW.member_scores(folded, fits, features, test, [id_col, label, "fold"])
    name = F.element_at(F.array(*[F.lit(n) for n, _ in configs]), (F.floor(F.col("__g") / k) + 1).cast("int"))
    return s.select(name.alias("config"), id_col, label, "fold", "score"), fits


def oof_scores(df: DataFrame, features: list[str], label: str, id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Stratified hash folds; each fold is scored by a model fitted on
    the other folds.  Returns ``(id, label, fold, score)``."""
    return oof_table(df, [("all", features)], label, id_col, k, seed)[0].drop("config")


def feature_sets(features: list[str]) -> list[tuple[str, list[str]]]:
    """All features, and all without each one."""
    return [("all", list(features))] + [(f"without_{f}", [g for g in features if g != f]) for f in features]


def marginal_value(df: DataFrame, features: list[str], label: str, id_col: str, k: int = 5) -> DataFrame:
    """Out-of-fold AUC with every feature, and without each one."""
    scores, _ = oof_table(df, feature_sets(features), label, id_col, k)
    return roc.auc(roc.score_table(scores, "score", label, ["config"]), ["config"]).select("config", "auc", "n_pos", "n_neg")


def hashed_tfidf_embedder(text_col: str = "text", num_features: int = 1 << 14, ngram_pattern: str = r"\W+"
                          ) -> Pipeline:
    """U-2: deterministic text -> unit vector (tokens -> hashed TF -> IDF ->
    L2).  Fit once (the IDF pass), then ``transform`` anywhere."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="__tok", pattern=ngram_pattern, toLowercase=True),
        HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=num_features),
        IDF(inputCol="__tf", outputCol="__tfidf"),
        Normalizer(inputCol="__tfidf", outputCol="embedding_vec", p=2.0)])


def text_classifier(text_col: str = "text", label: str = "label", num_features: int = 1 << 16) -> Pipeline:
    """U-6: default text classifier (tokens -> hashed TF -> logistic
    regression), one per target label."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="__tok", pattern=r"\W+", toLowercase=True),
        HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=num_features),
        LogisticRegression(featuresCol="__tf", labelCol=label, regParam=1e-3, maxIter=50)])


def fit_text_classifier(df: DataFrame, text_col: str = "text", label: str = "label",
                        num_features: int = 1 << 16) -> PipelineModel:
    """Fits :func:`text_classifier` with the tokenising done once, in
    parallel, and the optimiser's iterations over a training set sized to
    its rows (featurised rows are kept for the iterations)."""
    pipe = text_classifier(text_col, label, num_features)
    tok, tf, lr = pipe.getStages()
    feats = tf.transform(tok.transform(df)).select("__tf", F.col(label).cast("double").alias(label))
    feats = feats.persist(StorageLevel.MEMORY_AND_DISK)
    n = feats.count()
    model = lr.fit(_sized(feats, n))
    feats.unpersist()
    return PipelineModel(stages=[tok, tf, model])


def classifier_scores(model, df: DataFrame, id_col: str, name: str = "text_classifier") -> DataFrame:
    """Applies a fitted classifier: ``(detector, id, score)`` with score =
    P(label = 1)."""
    out = model.transform(df)
    return out.select(F.lit(name).alias("detector"), F.col(id_col).alias("id"),
                      vector_to_array("probability")[1].alias("score"))
