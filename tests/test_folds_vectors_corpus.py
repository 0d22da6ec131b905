"""State folds against direct simulation; vectors and corpus operators."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import corpus, folds, vectors as V


def _events(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, sec double").select(
        "id", "k", F.timestamp_micros((F.col("sec") * 1e6).cast("long")).alias("ts"))


def test_token_bucket_burst_refill_retry(spark):
    # capacity 5, refill 0.5 token/s: five allowed at t=0, sixth refused with retry 2.0 s
    rows = [(i, "u", 0.0) for i in range(6)] + [(6, "u", 2.0), (7, "u", 2.0)]
    out = {r.id: (r.allowed, r.retry_after) for r in folds.token_bucket(_events(spark, rows), "k", "ts", "id", 5.0, 0.5).collect()}
    assert [out[i][0] for i in range(6)] == [True] * 5 + [False]
    assert out[5][1] == pytest.approx(2.0)
    assert out[6][0] is True and out[7][0] is False


def test_token_bucket_non_positive_config_allows(spark):
    out = folds.token_bucket(_events(spark, [(0, "u", 0.0), (1, "u", 0.0)]), "k", "ts", "id", 0.0, 0.0)
    assert all(r.allowed for r in out.collect())


def _sim_bucket(times, cap, rate):
    tokens, last, res = None, None, []
    for t in times:
        if tokens is None:
            tokens, last = cap, t
        elif t - last > 0:
            tokens, last = min(cap, tokens + (t - last) * rate), t
        if tokens >= 1:
            tokens -= 1
            res.append(True)
        else:
            res.append(False)
    return res


def test_token_bucket_segments_equal_sequential(spark):
    rng = random.Random(3)
    rows, t = [], 0.0
    for i in range(600):
        t += rng.choice([0.1, 0.2, 0.5, 3.0, 30.0])
        rows.append((i, rng.choice("ab"), round(t, 3)))
    out = {r.id: r.allowed for r in folds.token_bucket(_events(spark, rows), "k", "ts", "id", 3.0, 0.2).collect()}
    for k in "ab":
        mine = [r for r in rows if r[1] == k]
        exp = _sim_bucket([r[2] for r in mine], 3.0, 0.2)
        assert [out[r[0]] for r in mine] == exp


def test_ttl_reuse(spark):
    rows = [(1, "h", 0.0), (2, "h", 10.0), (3, "h", 99.0), (4, "h", 100.0), (5, "h", 150.0), (6, "g", 1.0)]
    got = {r.id: (r.hit, r.origin_id) for r in folds.ttl_reuse(_events(spark, rows), "k", "ts", "id", 100.0).collect()}
    assert got == {1: (False, 1), 2: (True, 1), 3: (True, 1), 4: (False, 4), 5: (True, 4), 6: (False, 6)}


def test_breaker_threshold_cooldown_probe(spark):
    rows = [(1, "b", 0.0, False), (2, "b", 1.0, False), (3, "b", 2.0, False),   # opens at t=2
            (4, "b", 10.0, True),                                              # skipped (cooldown 30)
            (5, "b", 32.0, False),                                             # probe fails: count 1, stays closed
            (6, "b", 33.0, True), (7, "b", 34.0, False)]
    df = spark.createDataFrame(rows, "id long, k string, sec double, ok boolean").select(
        "id", "k", "ok", F.timestamp_micros((F.col("sec") * 1e6).cast("long")).alias("ts"))
    got = {r.id: (r.skipped, r.open_after, r.failures_after)
           for r in folds.circuit_breaker(df, "k", "ts", "id", "ok", 3, 30.0).collect()}
    assert got == {1: (False, False, 1), 2: (False, False, 2), 3: (False, True, 3), 4: (True, True, 3),
                   5: (False, False, 1), 6: (False, False, 0), 7: (False, False, 1)}


def test_nearest_neighbour_matches_numpy(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(150, 8))
    rows = [(i, [float(x) for x in X[i]]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r.id: (r.nn_id, r.sim) for r in V.nearest_neighbour(df, "id", "v", block_rows=40).collect()}
    Xn = X / np.linalg.norm(X, axis=1, keepdims=True)
    S = Xn @ Xn.T
    np.fill_diagonal(S, -np.inf)
    for i in range(150):
        j = int(np.argmax(S[i]))
        assert got[i][0] == j and got[i][1] == pytest.approx(S[i, j])


def test_anchor_similarity_and_centroid(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 2.0]), (3, "b", [3.0, 4.0])],
                               "id long, g string, v array<double>")
    sim = df.select(V.max_anchor_similarity("v", [[1.0, 0.0], [0.0, -1.0]]).alias("s")).orderBy("s").collect()
    assert [round(r.s, 6) for r in sim] == [0.0, 0.6, 1.0]
    assert df.select(V.max_anchor_similarity("v", []).alias("s")).first().s == 0.0
    meta = df.select(V.max_anchor_similarity("v", [[-1.0, 0.0]], clamp_at_zero=True).alias("s")).collect()
    assert all(r.s >= 0.0 for r in meta)
    cen = {r.g: list(r.centroid) for r in V.centroids(df, "g", "v").collect()}
    assert cen == {"a": [0.5, 1.0], "b": [3.0, 4.0]}
    ncen = {r.g: list(r.centroid) for r in V.centroids(df, "g", "v", normalize=True).collect()}
    assert ncen["b"] == pytest.approx([0.6, 0.8])


def test_collect_small_refuses_large(spark):
    with pytest.raises(OverflowError):
        V.collect_small(spark.range(10), limit=5)


def test_anchor_blocks_take_any_number_of_anchors(spark):
    import numpy as np
    r = np.random.default_rng(5)
    A, X = r.normal(size=(5000, 8)), r.normal(size=(40, 8))
    anchors = spark.createDataFrame([(x.tolist(),) for x in A], "a array<double>")
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, v array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = (unit(X) @ unit(A).T).max(axis=1)
    for block in (4096, 700, 10_000):
        got = {x.id: x.s for x in V.anchor_max_blocks(df, "v", anchors, "a", "s", block).collect()}
        assert np.allclose([got[i] for i in range(40)], want)
    empty = V.anchor_max_blocks(df, "v", anchors.limit(0), "a", "s").collect()
    assert {x.s for x in empty} == {0.0}


def test_capped_sample_matches_bruteforce(spark):
    import hashlib
    rows = [(i, "big" if i % 3 else f"s{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, src string")
    got = {(r.src, r.id) for r in corpus.capped_sample(df, "src", "id", 37, seed=5).collect()}
    exp = set()
    for s in {r[1] for r in rows}:
        ids = sorted((i for i, k in rows if k == s), key=lambda i: hashlib.md5(f"{i}:5".encode()).hexdigest())
        exp |= {(s, i) for i in ids[:37]}
    assert got == exp


def test_dedup_first_wins_priority(spark):
    rows = [(1, "Hello, World!", 1), (2, "hello world", 0), (3, "HELLO   world", 0), (4, "ab", 0), (5, "other text", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, priority int")
    got = {r.doc_id: r.copies for r in corpus.dedup_first_wins(df, "priority", "doc_id", ["doc_id"]).collect()}
    assert got == {2: 3, 5: 1}       # "ab" is too short; priority 0 beats 1, then lowest ordinal
    m = {r.source: r for r in corpus.manifest(df.withColumn("source", F.concat(F.lit("s"), F.col("priority").cast("string"))),
                                              "priority", "doc_id").collect()}
    assert (m["s0"].kept, m["s0"].duplicates_dropped, m["s0"].short_dropped) == (1, 1, 1)
    assert (m["s1"].kept, m["s1"].duplicates_dropped) == (0, 1)


def test_slice_counts_grouping_sets(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y")], "c1 string, c2 string")
    got = {(r.slice_kind, r.slice_value): r.n for r in corpus.slice_counts(df, ["c1", "c2"], {"n": F.count(F.lit(1))}).collect()}
    assert got == {("c1", "a"): 2, ("c1", "b"): 1, ("c2", "x"): 1, ("c2", "y"): 2, ("all", None): 3}


def test_anchor_max_arrow_matches_numpy(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(60, 16))
    A = rng.normal(size=(7, 16))
    df = spark.createDataFrame([(i, [float(x) for x in X[i]]) for i in range(60)], "id long, v array<double>")
    got = {r.id: r.s for r in V.anchor_max_arrow(df, "v", A, "s").collect()}
    Xn = X / np.linalg.norm(X, axis=1, keepdims=True)
    An = A / np.linalg.norm(A, axis=1, keepdims=True)
    exp = (Xn @ An.T).max(axis=1)
    assert all(abs(got[i] - exp[i]) < 1e-12 for i in range(60))
    empty = V.anchor_max_arrow(df, "v", np.zeros((0, 16)), "s").collect()
    assert all(r.s == 0.0 for r in empty)


def test_ttl_doubling_equals_fold(spark):
    rng = random.Random(8)
    rows, t = [], 0.0
    for i in range(800):
        t += rng.choice([1.0, 5.0, 20.0, 60.0, 400.0])
        rows.append((i, rng.choice(["hot", "hot", "hot", "b", "c"]), round(t, 3)))
    ev = _events(spark, rows)
    a = {r.id: (r.hit, r.origin_id) for r in folds.ttl_reuse(ev, "k", "ts", "id", 300.0).collect()}
    b = {r.id: (r.hit, r.origin_id) for r in folds.ttl_reuse_doubling(ev, "k", "ts", "id", 300.0).collect()}
    assert a == b and sum(h for h, _ in a.values()) > 100


def test_token_bucket_per_principal_parameters(spark):
    rows = [(i, "key:a" if i < 6 else "ip:1.2.3.4", 0.0) for i in range(12)]
    df = _events(spark, rows).withColumn("auth", F.col("k").startswith("key:"))
    cap, refill = folds.bucket_columns(F.when(F.col("auth"), F.lit(120.0)).otherwise(F.lit(6.0)))
    df = df.withColumn("cap", cap).withColumn("rate", refill)
    out = {r.id: r.allowed for r in folds.token_bucket(df, "k", "ts", "id", "cap", "rate").collect()}
    # keyed: capacity 20 -> all six allowed; anonymous 6 rpm: capacity max(1, 0.1*10)=1 -> one allowed
    assert [out[i] for i in range(6)] == [True] * 6
    assert [out[i] for i in range(6, 12)] == [True] + [False] * 5
    r = spark.createDataFrame([(0.2,), (2.0,), (2.5,)], "s double").select(folds.retry_after_header("s")).collect()
    assert [x[0] for x in r] == [1, 2, 3]


def _sim_breaker(calls, threshold, cd):
    fails, opened, out = 0, None, []
    for t, ok in calls:
        if opened is not None:
            if t - opened >= cd:
                fails, opened = 0, None
            else:
                out.append((True, True, fails))
                continue
        if ok:
            fails, opened = 0, None
        else:
            fails += 1
            if fails >= threshold and opened is None:
                opened = t
        out.append((False, opened is not None, fails))
    return out


def test_breaker_segments_equal_sequential(spark):
    rng = random.Random(12)
    rows, t = [], 0.0
    for i in range(700):
        t += rng.choice([1.0, 2.0, 5.0, 40.0, 100.0])
        rows.append((i, rng.choice("xy"), round(t, 3), rng.random() < 0.55))
    df = spark.createDataFrame(rows, "id long, k string, sec double, ok boolean").select(
        "id", "k", "ok", F.timestamp_micros((F.col("sec") * 1e6).cast("long")).alias("ts"))
    got = {r.id: (r.skipped, r.open_after, r.failures_after)
           for r in folds.circuit_breaker(df, "k", "ts", "id", "ok", 3, 30.0).collect()}
    for k in "xy":
        mine = [r for r in rows if r[1] == k]
        exp = _sim_breaker([(r[2], r[3]) for r in mine], 3, 30.0)
        assert [got[r[0]] for r in mine] == exp


def test_breaker_plan_is_cut_into_segments(spark):
    df = spark.createDataFrame([(i, "b", 1000.0 + 40 * i, True) for i in range(50)], "id long, k string, s double, ok boolean") \
        .withColumn("ts", F.timestamp_seconds("s"))
    out = folds.circuit_breaker(df, "k", "ts", "id", "ok", 3, 30.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    import re
    assert re.search(r"hashpartitioning\(k#\d+, seg#\d+L?,", plan)
    assert out.count() == 50 and out.where("skipped").count() == 0
