"""Pruned similarity search against all pairs, grouped fits against a direct
solve."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import learn
from riskframe.operators import newton as NW
from riskframe.operators import similar as S


def clustered(seed=1, clusters=12, each=25, dim=16, spread=0.08):
    """Planted groups of near copies, exact copies, unusable rows."""
    r = np.random.default_rng(seed)
    x = np.repeat(r.normal(size=(clusters, dim)), each, axis=0)
    x = x + r.normal(size=x.shape) * spread * np.linalg.norm(x, axis=1, keepdims=True) / np.sqrt(dim)
    x[5], x[6], x[200] = x[4], x[4], x[4]
    return x


@pytest.fixture(scope="module")
def vectors(spark):
    x = clustered()
    rows = [(i, [float(t) for t in v], f"2024-01-01 00:{i % 60:02d}:00", "x") for i, v in enumerate(x)]
    extra = [(1000, None, None, "x"), (1001, [0.0] * 16, None, "x"), (1002, [float("nan")] * 16, None, "x"), (None, rows[0][1], None, "x"), (1003, [None] * 16, None, "x")]
    df = spark.createDataFrame(rows + extra, "id long, v array<double>, ts string, `key` string")
    return x / np.linalg.norm(x, axis=1, keepdims=True), df.withColumn("ts", F.col("ts").cast("timestamp")).repartition(3)


def best(m, threshold, strict=False):
    out = {}
    for i in range(len(m)):
        top = m[i].max()
        if (top > threshold) if strict else (top >= threshold):
            out[i] = (int(np.flatnonzero(m[i] >= top - 1e-12)[0]), top)
    return out


@pytest.mark.parametrize("block,pivots", [(4096, 1024), (7, 5), (50, 1)])
@pytest.mark.parametrize("threshold", [0.05, 0.9, 0.985, 0.999])
def test_nearest_other_equals_all_pairs(vectors, threshold, block, pivots):
    x, df = vectors
    m = x @ x.T
    np.fill_diagonal(m, -2)
    want = best(m, threshold)
    got = {r.id: (r.nn_id, r.sim) for r in S.nearest_other(df, "id", "v", threshold, block, pivots).collect()}
    assert got.keys() == want.keys() and len(want) > 3
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9 for i in want)


def test_nearest_other_without_a_threshold(vectors):
    x, df = vectors
    m = x @ x.T
    np.fill_diagonal(m, -2)
    got = {r.id: (r.nn_id, r.sim) for r in S.nearest_other(df, "id", "v", max_pivots=9).collect()}
    want = best(m, -1)
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9 for i in want)


def test_only_earlier_candidates_and_strict_bound(spark, vectors):
    x, df = vectors
    cand = df.where("id < 150")
    asks = df.where("id >= 150").union(df.where("id = 4").withColumn("id", F.lit(900).cast("long")))
    index = S.sphere_index(S.unit_rows(cand, "id", "v", "ts"), 6)
    got = {r.id: (r.nn_id, r.sim) for r in S.nearest_within(index, S.unit_rows(asks, "id", "v", "ts"), 0.97, strict=True, as_of=True).collect()}
    at = np.arange(150) % 60
    want = {}
    for i in [*range(150, 300), 900]:
        v, t = (x[4], 4) if i == 900 else (x[i], i % 60)
        s = np.where(at <= t, x[:150] @ v, -2)
        if s.max() > 0.97:
            want[i] = int(np.flatnonzero(s >= s.max() - 1e-12)[0])
    assert {i: n for i, (n, _) in got.items()} == want and 900 in want
    with pytest.raises(ValueError):
        S.nearest_within(index, S.unit_rows(asks, "id", "v"), 0.0)


def test_pruned_rings_are_not_shuffled(spark):
    x = clustered(clusters=40, each=40, dim=12, spread=0.02)
    df = spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)], "id long, v array<double>")
    units = S.unit_rows(df, "id", "v").cache()
    index = S.sphere_index(units)
    seen = S.ring_visits(index, units.withColumn("least", F.lit(0.99)))
    pairs = seen.select(F.sum(F.size("rings"))).first()[0]
    assert pairs < 0.1 * len(x) * len(index.rings)
    plan = S.nearest_within(index, units, 0.99, exclude_self=True)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    # a dense ring is dealt into blocks
    groups = S.search(index, seen, 0.99, block_rows=10)
    assert groups.count() > 0


def test_empty_sides(spark, vectors):
    _, df = vectors
    none = S.unit_rows(df.limit(0), "id", "v")
    index = S.sphere_index(none)
    assert S.nearest_within(index, S.unit_rows(df, "id", "v"), 0.5).count() == 0
    full = S.sphere_index(S.unit_rows(df, "id", "v"))
    assert S.nearest_within(full, none, 0.5).count() == 0 and S.nearest_any(full, none).count() == 0
    assert S.nearest_other(df.limit(0), "id", "v", 0.5).count() == 0


def test_vectors_without_near_neighbours_are_sent_once_a_block(spark):
    """Where nothing can be pruned, a query goes to blocks, not to each of
    the rings in them."""
    x = np.random.default_rng(3).normal(size=(1500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)], "id long, v array<double>")
    units = S.unit_rows(df, "id", "v")
    index = S.sphere_index(units)
    seen = S.ring_visits(index, units.withColumn("least", F.lit(0.4)))
    zone, held = S.zones_of(index.rings["n"].to_numpy(), 500)
    sent = S.zone_visits(seen, zone).select(F.sum(F.size("zones"))).first()[0]
    assert held.sum() == 1500 and len(held) <= 6 and sent <= 1500 * len(held)
    assert seen.select(F.sum(F.size("rings"))).first()[0] > 5 * sent
    m = x @ x.T
    np.fill_diagonal(m, -2)
    got = {r.id: r.nn_id for r in S.nearest_other(df, "id", "v", block_rows=500).collect()}
    assert got == dict(enumerate(m.argmax(axis=1).tolist()))


# -- grouped fits ---------------------------------------------------------

def solve(X, y, C=1.0, iters=60):
    scale = X.std(0)
    Z = (X - X.mean(0)) / np.where(scale > 0, scale, 1) * (scale > 0)
    A = np.hstack([np.ones((len(Z), 1)), Z])
    reg = np.diag([0.0, *[1 / C] * X.shape[1]])
    w = np.zeros(A.shape[1])
    for _ in range(iters):
        p = 1 / (1 + np.exp(-A @ w))
        w -= np.linalg.solve(A.T @ (A * (p * (1 - p))[:, None]) + reg, A.T @ (p - y) + reg @ w)
    return w


@pytest.fixture(scope="module")
def scored(spark):
    r = np.random.default_rng(7)
    X = r.normal(size=(500, 3)) * [1.0, 3.0, 0.2] + [0.0, 5.0, -1.0]
    X = np.hstack([X, np.full((500, 1), 2.5)])
    y = (X[:, 0] + 0.4 * X[:, 1] + r.normal(size=500) > 2.2).astype(int)
    cls = np.where(y == 0, "benign", np.where(X[:, 2] > -1, "x", "y"))
    df = spark.createDataFrame([(i, *map(float, X[i]), int(y[i]), str(cls[i])) for i in range(500)],
                               "id long, a double, b double, c double, d double, y int, cls string").repartition(5)
    return X, y, cls, df


def test_groups_equal_separate_fits(scored):
    X, y, cls, df = scored
    part = F.array_compact(F.array(NW.member(0, "y"), F.when(F.col("id") % 3 != 0, NW.member(1, "y")),
                                   F.when(F.col("cls") != "y", NW.member(2, (F.col("cls") == "x"))), F.when(F.col("y") == 1, NW.member(3, "y"))))
    fits = NW.fit_groups(df, ["a", "b", "c", "d"], part, {1: ["b"]})
    assert sorted(fits) == [0, 1, 2]          # the group of one label is not fitted
    i = np.arange(500)
    cases = {0: (X, y), 1: (X * [1, 0, 1, 1], y), 2: (X, (cls == "x").astype(int))}
    for g, keep in ((0, i >= 0), (1, i % 3 != 0), (2, cls != "y")):
        Xg, yg = cases[g]
        want = solve(Xg[keep], yg[keep])
        assert np.allclose(fits[g].theta, want, atol=1e-7)
        assert fits[g].gradient < 1e-6 and fits[g].rounds <= 12 and fits[g].n == keep.sum() and fits[g].n_pos == yg[keep].sum()
    assert fits[1].theta[2] == 0 and fits[0].theta[4] == 0


def test_all_folds_and_sets_in_few_jobs(spark, scored):
    X, y, _, df = scored
    sets = learn.feature_sets(["a", "b", "c"])
    rounds = []
    plain = NW._round
    NW._round = lambda *a: rounds.append(len(a[1])) or plain(*a)
    try:
        table, fits = learn.oof_table(df, sets, "y", "id", 5)
    finally:
        NW._round = plain
    assert len(fits) == 20 and rounds[0] == 20 and len(rounds) <= 15
    rows = table.collect()
    assert len(rows) == 2000
    fold = {r.id: r.fold for r in rows}
    for c, (name, fs) in enumerate(sets):
        at = ["abc".index(f) for f in fs]
        for j in range(5):
            train = np.array([fold[i] != j for i in range(500)])
            w = solve(X[train][:, at], y[train])
            f = fits[c * 5 + j]
            mean, scale = X[train][:, at].mean(0), X[train][:, at].std(0)
            for r in rows:
                if r.config == name and r.fold == j:
                    p = 1 / (1 + np.exp(-(w[0] + ((X[r.id, at] - mean) / scale) @ w[1:])))
                    assert abs(p - r.score) < 1e-7
            assert f.n == train.sum()


def test_policy_needs_both_labels(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1)], "a double, y int")
    with pytest.raises(ValueError):
        learn.fit_fusion_policy(df, ["a"], "y")


def test_top_collisions_has_no_threshold(spark, tmp_path):
    """Twins bent by 0.45 lie below 0.95: they are still the nearest."""
    from riskframe.plans import q_more
    r = np.random.default_rng(5)
    spark.createDataFrame([(24 * i + 15, [float(t) for t in r.choice([-1.0, 1.0], size=16)], i % 10) for i in range(12)],
                          "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = q_more.top_collisions(spark, str(tmp_path)).collect()
    assert len(got) == 8 and all(row.sim < 0.95 and row.label != row.nn_label for row in got)
