"""The assessment as a stream equals the table job on out-of-order input."""
import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from riskframe.plans import bound
from riskframe.streaming import assess as A
from riskframe.streaming import windows

POLICY = {"feature_order": ["threat"], "scaler_mean": [0.0], "scaler_scale": [1.0], "coefficients": [4.0], "intercept": -2.0,
          "per_class": {"x": {"scaler_mean": [0.0], "scaler_scale": [1.0], "coefficients": [4.0], "intercept": -2.0, "threshold_high": 0.8, "threshold_medium": 0.4}}}
SCHEMA = "request_id long, ts timestamp, text string, embedding array<double>, credential_hash string"
START = dt.datetime(2024, 1, 1)


def context(spark):
    r = np.random.default_rng(1)
    anchors = {"meta": r.normal(size=(2, 4)).tolist(), "threat": r.normal(size=(3, 4)).tolist(), "educational": r.normal(size=(1, 4)).tolist()}
    grants = spark.createDataFrame([("c1", "GENERAL", "t1", "k1"), ("c2", "RESEARCH", "t2", "k2"), ("c3", "GENERAL", "t3", "k3")],
                                   "key_hash string, capability string, tenant string, key_id string")
    tenants = spark.createDataFrame([("t1", "active", None), ("t2", "suspended", 5.0)], "tenant_id string, status string, rate_limit_rpm double")
    return A.Context(anchors, POLICY, {"threat": "threat"}, grants, tenants, bound.RULES, ttl_seconds=1800.0)


def requests():
    r, rows = random.Random(4), []
    texts = [f"prompt number {i}" for i in range(7)] + ["and and goes", "that the was one", None]
    for i in range(120):
        v = None if r.random() < 0.1 else [r.gauss(0, 1) for _ in range(4)]
        rows.append((i, START + dt.timedelta(seconds=60 * i + r.randrange(50)), r.choice(texts), v, r.choice(["c1", "c2", "c3", "unknown", None])))
    return rows


def test_stream_assessment_equals_the_table(spark, tmp_path):
    ctx, rows = context(spark), requests()
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = A.assess_requests(table, ctx)
    for i in range(0, 120, 30):
        part = rows[i:i + 30]
        random.Random(i).shuffle(part)                     # out of order inside the delay
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for j in (1, 2):                                       # moves the watermark past all rows and deadlines
        far = [(1000 + j, START + dt.timedelta(days=10 * j), "far", None, None)]
        spark.createDataFrame(far, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = A.stream_assess(windows.read_stream(spark, str(tmp_path / "in"), table.schema), ctx, "1 hour")
    q = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out")).where("request_id < 1000")
    order = lambda d: sorted(map(repr, d.select(sorted(d.columns)).collect()))
    assert order(got) == order(want) and got.count() == 120
    seen = want.select(F.collect_set("source").alias("s"), F.collect_set("decision").alias("d"), F.count_if("hit").alias("h")).first()
    assert {"cache", "cache_locked_high", "symbolic_rule"} <= set(seen.s) and {"REJECT", "BLOCK"} <= set(seen.d) and 20 < seen.h < 110
