"""Remaining API surface: label mapping, request bounds, multi-label
probabilities, prevalence-adjusted precision, policy rows, sinks and the
foreachBatch writers."""
import json
import math

import pytest
from pyspark.sql import functions as F

from riskframe.functions import text as X
from riskframe.operators import cascade as K
from riskframe.operators import corpus, evaluate as EV, govern
from riskframe.sources import io
from riskframe.streaming import windows


def test_attack_label_mapping(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (0, 0)], "jb int, tox int")
    got = [tuple(r.x) for r in df.select(corpus.attack_label("jb", "tox").alias("x")).collect()]
    assert got == [(1, "jailbreak"), (1, "harmful"), (0, "benign")]


def test_length_bounds_and_row_id(spark):
    df = spark.createDataFrame([("",), ("ok",), ("x" * 50_001,), (None,)], "t string")
    assert [r[0] for r in df.select(X.length_valid("t")).collect()] == [False, True, False, False]
    import hashlib
    k = spark.createDataFrame([("hello world",)], "k string").select(X.row_id("k")).first()[0]
    assert k == hashlib.sha1(b"hello world").hexdigest()[:16]


def test_multilabel_max(spark):
    df = spark.createDataFrame([([0.0, 2.0, -1.0],)], "lg array<double>")
    sig = df.select(K.multilabel_max("lg", [1, 2], True)).first()[0]
    soft = df.select(K.multilabel_max("lg", [1, 2], False)).first()[0]
    assert sig == pytest.approx(1 / (1 + math.exp(-2.0)))
    den = math.exp(0.0) + math.exp(2.0) + math.exp(-1.0)
    assert soft == pytest.approx(math.exp(2.0) / den)


def test_prevalence_adjusted_precision(spark):
    df = spark.createDataFrame([(0.8, 0.05)], "tpr double, fpr double")
    v = df.select(EV.prevalence_adjusted_precision(F.col("tpr"), F.col("fpr"), 0.01)).first()[0]
    assert v == pytest.approx(0.01 * 0.8 / (0.01 * 0.8 + 0.99 * 0.05))


def test_policy_frame_drops_invalid_actions(spark):
    pf = govern.policy_frame(spark, {"default": {"GENERAL": {"HIGH": "BLOCK", "LOW": "MAYBE"}}})
    assert [tuple(r) for r in pf.collect()] == [("default", "GENERAL", "HIGH", "BLOCK")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "id int, v string")
    io.write_rows_and_summary(rows, rows.agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "r"), fmt="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "r" / "rows")).count() == 1
    io.write_policy_artifact({"feature_order": ["a"], "intercept": 0.5}, str(tmp_path / "p.json"))
    assert json.loads((tmp_path / "p.json").read_text())["intercept"] == 0.5


def test_stream_dedup_and_upsert_writer(spark, tmp_path):
    from riskframe.sources.tables import SCHEMAS
    import datetime as dt
    src = tmp_path / "src"
    t0 = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, t0, 1, "view", 1.0, "{}"), (1, t0, 1, "view", 1.0, "{}"), (2, t0, 2, "view", 1.0, "{}")],
                          SCHEMAS["events"]).coalesce(1).write.parquet(str(src))
    s = windows.dedup_requests(windows.read_stream(spark, str(src), SCHEMAS["events"]), "ts", "event_id")
    q = (s.writeStream.format("memory").queryName("dedup_out").option("checkpointLocation", str(tmp_path / "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r.event_id for r in spark.table("dedup_out").collect()) == [1, 2]

    table = str(tmp_path / "verdicts")
    w = windows.upsert_writer(table)
    b0 = spark.createDataFrame([("h1", "MEDIUM", "judge_pending")], "prompt_hash string, risk string, source string")
    b1 = spark.createDataFrame([("h1", "HIGH", "escalation"), ("h2", "LOW", "clean_pass")],
                               "prompt_hash string, risk string, source string")
    w(b0, 0)
    w(b1, 1)
    w(b1, 1)                                          # replayed epoch: same result
    got = {r.prompt_hash: r.risk for r in spark.read.parquet(f"{table}/v=1").collect()}
    assert got == {"h1": "HIGH", "h2": "LOW"}


def test_fuzzy_reuse_writer(spark, tmp_path):
    cache = spark.createDataFrame([("h", "LOW", 0.1, 1000.0, "x", [1.0, 0.0])], io.CACHE_SCHEMA)
    io.save_cache(cache, str(tmp_path / "cache"))
    reqs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "request_id long, vector array<float>") \
        .withColumn("ts", F.timestamp_seconds(F.lit(1500)))
    windows.fuzzy_reuse_writer(str(tmp_path / "cache"), str(tmp_path / "out"))(reqs, 0)
    got = {r.request_id: r.hit for r in spark.read.parquet(str(tmp_path / "out" / "epoch=0")).collect()}
    assert got == {1: True, 2: False}


def test_format_ci(spark):
    df = spark.createDataFrame([(0.9441, 0.9362, 0.9512)], "p double, lo double, hi double")
    assert df.select(EV.format_ci("p", "lo", "hi")).first()[0] == "0.944 [0.936, 0.951]"
