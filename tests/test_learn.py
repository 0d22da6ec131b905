"""Logistic-regression parity with the penalised objective, policy
artifacts, out-of-fold scores and the text pipelines."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import cascade as K
from riskframe.operators import learn


def _newton(X, y, C=1.0, iters=50):
    """argmin 1/2||w||^2 + C*sum(logloss), intercept unpenalised."""
    n, d = X.shape
    A = np.hstack([X, np.ones((n, 1))])
    w = np.zeros(d + 1)
    reg = np.eye(d + 1) / C
    reg[-1, -1] = 0.0
    for _ in range(iters):
        p = 1 / (1 + np.exp(-A @ w))
        g = A.T @ (p - y) + reg @ w
        H = A.T @ (A * (p * (1 - p))[:, None]) + reg
        w -= np.linalg.solve(H, g)
    return w[:-1], w[-1]


def test_logistic_parity_with_population_scaling(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(400, 3)) * [1.0, 2.0, 0.5] + [0.2, -1.0, 3.0]
    y = (X @ [1.0, -0.5, 2.0] + rng.normal(size=400) > 6.0).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(t)) for (a, b, c), t in zip(X, y)],
                               "a double, b double, c double, y int")
    p = learn._fit_linear(df, ["a", "b", "c"], "y")
    Z = (X - X.mean(0)) / X.std(0)            # population std
    w, b = _newton(Z, y)
    assert np.allclose(p["coefficients"], w, atol=1e-4) and abs(p["intercept"] - b) < 1e-4
    assert np.allclose(p["scaler_scale"], X.std(0))


def test_policy_artifact_thresholds_and_classes(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        cls = ["benign", "x", "y"][i % 3]
        base = {"benign": 0.0, "x": 1.0, "y": 0.5}[cls]
        rows.append((i, float(rng.normal() + base), float(rng.normal() + (1.5 if cls == "y" else 0.0)),
                     int(cls != "benign"), cls))
    df = spark.createDataFrame(rows, "id long, f1 double, f2 double, label int, cls string")
    pol = learn.fit_fusion_policy(df, ["f1", "f2"], "label", "cls", ["x", "y"])
    assert set(pol["per_class"]) == {"x", "y"}
    assert pol["threshold_high"] >= pol["threshold_medium"]
    probs = df.select(K.fused_score({"f1": "f1", "f2": "f2"}, pol).alias("p"), "label")
    fpr = probs.where("label = 0").agg(F.avg((F.col("p") >= pol["threshold_high"]).cast("double"))).first()[0]
    assert fpr <= 0.05 + 1e-12


def test_oof_scores_cover_every_row(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal() + (i % 2)), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, f double, label int")
    s = learn.oof_scores(df, ["f"], "label", "id", k=3)
    assert s.count() == 300 and s.select("id").distinct().count() == 300


def test_text_pipelines(spark):
    df = spark.createDataFrame([(0, "buy cheap pills now", 1.0), (1, "meeting notes for monday", 0.0),
                                (2, "cheap pills cheap", 1.0), (3, "notes from the meeting", 0.0)] * 5,
                               "id long, text string, label double")
    emb = learn.hashed_tfidf_embedder().fit(df).transform(df)
    norms = [float(np.linalg.norm(v.toArray())) for v in emb.select("embedding_vec").toPandas()["embedding_vec"]]
    assert all(abs(n - 1.0) < 1e-9 or n == 0.0 for n in norms)
    m = learn.text_classifier().fit(df)
    sc = {r.id: r.score for r in learn.classifier_scores(m, df, "id").collect()}
    assert sc[0] > 0.5 > sc[1]
