"""Keyed tables, committed runs, deadlines, sketches and large rule packs."""
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import detectors as D
from riskframe.operators import outcomes as O
from riskframe.operators import rule_index as RI
from riskframe.operators import sketch
from riskframe.operators import vectors as V
from riskframe.sources import keyed, runs
from riskframe.sources.io import child_names, write_small
from riskframe.streaming import windows

VERDICT = "prompt_hash string, risk string, score double, source string"
ESCALATE = keyed.escalating({"risk": "HIGH", "score": 1.0, "source": "late"})


def verdicts(spark, rows):
    return spark.createDataFrame([(*r, "fast") if len(r) == 3 else r for r in rows], VERDICT)


def view(table, spark):
    return {r.prompt_hash: (r.risk, r.score, r.source) for r in table.read(spark).collect()}


def folded(epochs):
    """The verdicts of epochs in order, by a plain loop."""
    out, sev = {}, {"LOW": 0, "MEDIUM": 1, "HIGH": 2}
    for rows in epochs:
        best = {}
        for k, risk, score in rows:
            r = (-sev[risk], risk, score, "fast")
            best[k] = min(best.get(k, r), r)
        for k, r in best.items():
            if k not in out:
                out[k] = r[1:]
            elif r[1] == "HIGH" and out[k][0] != "HIGH":
                out[k] = ("HIGH", 1.0, "late")
    return out


# -- keyed table ----------------------------------------------------------

def test_keyed_table_follows_the_fold(spark, tmp_path):
    r = random.Random(2)
    epochs = [[(f"k{r.randrange(40)}", r.choice(["LOW", "LOW", "MEDIUM", "HIGH"]), float(r.randrange(5))) for _ in range(r.randrange(1, 25))] for _ in range(6)]
    table = keyed.KeyedTable(f"file://{tmp_path}/t", "prompt_hash", VERDICT, ESCALATE, buckets=4)
    assert view(table, spark) == {}
    for e, rows in enumerate(epochs):
        table.write_epoch(verdicts(spark, rows), e)
        if e in (1, 4):
            table.write_epoch(verdicts(spark, rows), e)      # a replayed epoch
        assert view(table, spark) == folded(epochs[:e + 1])
        if e in (2, 4):
            assert table.compact(spark) and table.compact(spark) == []
            assert view(table, spark) == folded(epochs[:e + 1])
    # an epoch replayed after its compaction changes nothing
    table.write_epoch(verdicts(spark, epochs[4]), 4)
    assert view(table, spark) == folded(epochs)


def test_an_epoch_writes_only_its_buckets(spark, tmp_path):
    table = keyed.KeyedTable(str(tmp_path / "t"), "prompt_hash", VERDICT, ESCALATE, buckets=32)
    table.write_epoch(verdicts(spark, [(f"k{i}", "LOW", 0.0) for i in range(200)]), 0)
    table.compact(spark)
    before = sorted(p for p in (tmp_path / "t" / "base").rglob("*.parquet"))
    table.write_epoch(verdicts(spark, [("k1", "HIGH", 0.5), ("k1", "LOW", 0.1)]), 1)
    assert len([n for n in child_names(spark, str(tmp_path / "t/delta/epoch=1")) if n.startswith("bucket=")]) == 1
    assert len(table.compact(spark)) == 1
    assert [p for p in before if p.exists()] == before and view(table, spark)["k1"] == ("HIGH", 1.0, "late")


def test_crashes_leave_nothing_that_readers_see(spark, tmp_path):
    at = tmp_path / "t"
    table = keyed.KeyedTable(str(at), "prompt_hash", VERDICT, ESCALATE, buckets=2)
    table.write_epoch(verdicts(spark, [("a", "LOW", 0.0), ("b", "LOW", 0.0)]), 0)
    # between two files of an epoch: files are there, the commit mark is not
    table.write_epoch(verdicts(spark, [("a", "HIGH", 0.0)]), 1)
    (at / "delta" / "epoch=1" / "_SUCCESS").rename(tmp_path / "mark")
    assert view(table, spark)["a"][0] == "LOW"
    # a compaction that wrote files and died before its manifest
    table.compact(spark)
    (at / "manifest" / "0.json").rename(tmp_path / "manifest")
    assert view(table, spark) == {"a": ("LOW", 0.0, "fast"), "b": ("LOW", 0.0, "fast")}
    # a manifest half written: the old state still holds
    write_small(spark, str(at / "manifest" / "0.json"), '{"upto": 0, "buck')
    assert view(table, spark)["b"] == ("LOW", 0.0, "fast")
    # the replay and the next compaction mend it
    table.write_epoch(verdicts(spark, [("a", "HIGH", 0.0)]), 1)
    table.compact(spark)
    assert view(table, spark) == {"a": ("HIGH", 1.0, "late"), "b": ("LOW", 0.0, "fast")}


def test_readers_during_compaction_keep_their_files(spark, tmp_path):
    table = keyed.KeyedTable(str(tmp_path / "t"), "prompt_hash", VERDICT, ESCALATE, buckets=2)
    table.write_epoch(verdicts(spark, [("a", "LOW", 0.0)]), 0)
    table.compact(spark)
    table.write_epoch(verdicts(spark, [("a", "HIGH", 0.0)]), 1)
    reading = table.read(spark)          # planned on the old manifest
    table.compact(spark)
    assert reading.first().risk == "HIGH" and view(table, spark)["a"][0] == "HIGH"


def test_latest_value_wins_in_a_cache(spark, tmp_path):
    table = keyed.KeyedTable(str(tmp_path / "t"), "k", "k string, v int", buckets=2)
    for e, v in enumerate([3, 1, 2]):
        table.write_epoch(spark.createDataFrame([("x", v), (f"y{e}", e)], "k string, v int"), e)
    assert {r.k: r.v for r in table.read(spark).collect()} == {"x": 2, "y0": 0, "y1": 1, "y2": 2}


def test_keyed_writer_as_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    epochs = [[("a", "LOW", 0.1), ("b", "HIGH", 0.9)], [("a", "HIGH", 0.2)], [("b", "LOW", 0.0), ("c", "MEDIUM", 0.4)]]
    for i, rows in enumerate(epochs):
        verdicts(spark, rows).coalesce(1).write.mode("append").parquet(str(src))
    table = keyed.KeyedTable(str(tmp_path / "t"), "prompt_hash", VERDICT, ESCALATE, buckets=2)
    q = (windows.read_stream(spark, str(src), verdicts(spark, epochs[0]).schema).writeStream.foreachBatch(keyed.keyed_writer(table, 2))
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = view(table, spark)
    assert got["a"] == ("HIGH", 1.0, "late") and got["b"][0] == "HIGH" and got["c"][0] == "MEDIUM"
    assert child_names(spark, str(tmp_path / "t/manifest"))


# -- committed runs -------------------------------------------------------

def suite(spark, n=60):
    return spark.createDataFrame([(i, f"text {i}") for i in range(n)], "doc_id long, text string").repartition(3)


def numbers():
    """A model that travels by value."""
    def number(texts):
        out = []
        for t in texts:
            if int(t.split()[1]) % 7 == 0:
                raise RuntimeError("cannot score")
            out.append(int(t.split()[1]) / 100)
        return out
    return number


def test_a_retried_run_doubles_no_row(spark, tmp_path, monkeypatch):
    store = runs.RunStore(f"file://{tmp_path}/s")
    det = D.Detector("m", batch_fn=numbers())
    commit, calls = runs.RunStore.commit, []

    def dies(self, spark_, run, chunk, *a):
        calls.append(chunk)
        if len(calls) == 2:          # the data of a chunk is written, its commit is not
            raise KeyboardInterrupt
        return commit(self, spark_, run, chunk, *a)
    monkeypatch.setattr(runs.RunStore, "commit", dies)
    with pytest.raises(KeyboardInterrupt):
        D.incremental_run(suite(spark), store, "doc_id", det, "r1", chunk_rows=20)
    monkeypatch.setattr(runs.RunStore, "commit", commit)
    assert 0 < store.read(spark).count() < 40
    D.incremental_run(suite(spark), store, "doc_id", det, "r1", chunk_rows=20)
    want = {i: i / 100 for i in range(60) if i % 7}
    assert sorted((r.id, r.score) for r in store.read(spark, ["m"]).collect()) == sorted(want.items())
    # the same run again, and another one, add nothing
    assert D.incremental_run(suite(spark), store, "doc_id", det, "r1", chunk_rows=20) == 0
    assert D.incremental_run(suite(spark), store, "doc_id", det, "r2", chunk_rows=20, abort_after=1000) == 0
    log = store.log(spark).collect()
    assert len(log) == 3 and sum(r.rows for r in log) == len(want) and all(r.ended_at >= r.started_at for r in log)
    assert D.incremental_run(suite(spark, 65), store, "doc_id", det, "r3", chunk_rows=20, abort_after=1000) == 4     # 60, 61, 62, 64


def test_a_model_that_is_down_stops_the_run(spark, tmp_path):
    store = runs.RunStore(str(tmp_path / "s"))
    store.write(spark.createDataFrame([(1, 0.5)], "id long, score double"), "old", 0, "m")
    store.commit(spark, "old", 0, "m", 1, 0, 0.0, 1.0)

    def down(texts):
        raise RuntimeError("no server")
    with pytest.raises(D.ModelDown):
        D.incremental_run(suite(spark), store, "doc_id", D.Detector("m", batch_fn=down), "new", max_tries=1, chunk_rows=5)
    assert [tuple(r) for r in store.read(spark).collect()] == [("m", 1, 0.5)]
    # a commit being written is not one yet
    (tmp_path / "s" / "commits" / "new-0-m.json").write_text('{"run": "new", "chu')
    assert store.read(spark).count() == 1


def test_failed_batches_are_halved():
    import pandas as pd
    calls = []

    def fn(texts):
        calls.append(len(texts))
        if "bad" in list(texts):
            raise RuntimeError
        return [1.0 if t != "none" else None for t in texts]
    t = pd.Series(["ok"] * 1000)
    t.iloc[[300, 700]] = "bad"
    t.iloc[500] = "none"
    s = D._score_texts(fn, t, 3)
    assert s.isna().sum() == 3 and s.notna().sum() == 997 and len(calls) < 60


def test_progress_from_a_write_log(spark):
    log = spark.createDataFrame([("a", 0, "m", 30, 2, 0, 10), ("a", 1, "m", 10, 0, 10, 20), ("b", 0, "n", 0, 5, 0, 5)],
                                "run string, chunk int, detector string, rows long, failed long, s int, e int")
    log = log.select("run", "chunk", "detector", "rows", "failed", F.timestamp_seconds("s").alias("started_at"), F.timestamp_seconds("e").alias("ended_at"))
    got = {r.detector: r for r in runs.progress(log, 100).collect()}
    assert (got["m"].done, got["m"].failed, got["m"].rate, got["m"].rows_per_sec, got["m"].eta_seconds) == (40, 2, 0.4, 2.0, 30.0)
    assert got["n"].rows_per_sec == 0 and got["n"].eta_seconds is None


# -- deadlines ------------------------------------------------------------

START = 1_700_000_000
REQ = [(1, 0, "a"), (2, 5, "a"), (3, 10, "b"), (4, 20, "b"), (5, 30, "c"), (6, 700, "c")]
END = [(1, 30, "x"), (2, 66, "y"), (3, 70, "z"), (4, 10, "w"), (6, 701, "v")]


def frames(spark):
    r = spark.createDataFrame(REQ, "id long, t long, endpoint string").select("id", F.timestamp_seconds(F.col("t") + START).alias("ts"), "endpoint")
    e = spark.createDataFrame(END, "id long, t long, verdict string").select("id", F.timestamp_seconds(F.col("t") + START).alias("ts"), "verdict")
    return r, e


def test_outcomes_and_timeouts(spark):
    r, e = frames(spark)
    o = O.outcomes(r, e.union(e.where("id = 1").withColumn("ts", F.timestamp_seconds(F.lit(START + 40)))), "id", "ts", 60, ["verdict"])
    got = {x.id: (x.outcome, x.verdict) for x in o.collect()}
    # 2 ends a second late, 4 before it began, 5 never
    assert got == {1: ("done", "x"), 2: ("timeout", None), 3: ("done", "z"), 4: ("timeout", None), 5: ("timeout", None), 6: ("done", "v")}
    assert {x.endpoint: (x.n_requests, x.n_timeouts) for x in O.timeouts_by_endpoint(o).collect()} == {"a": (2, 1), "b": (2, 1), "c": (2, 1)}


def test_stream_outcomes_equal_the_table(spark, tmp_path):
    r, e = frames(spark)
    # a last pair far ahead moves the watermark past every deadline
    far = spark.createDataFrame([(99, 100_000)], "id long, t long")
    r = r.union(far.select("id", F.timestamp_seconds(F.col("t") + START), F.lit("z")))
    e = e.union(far.select("id", F.timestamp_seconds(F.col("t") + START), F.lit("q")))
    order = lambda d, ids: d.where(F.col("id").isin(ids))
    for i, ids in enumerate(([3, 1], [2, 4, 5], [6], [99])):          # out of order within the watermark
        order(r, ids).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
        order(e, ids[::-1]).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    out = O.stream_outcomes(windows.read_stream(spark, str(tmp_path / "r"), r.schema), windows.read_stream(spark, str(tmp_path / "e"), e.schema),
                            "id", "ts", 60, ["verdict"], "20 minutes")
    q = (out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(240)
    cols = ["id", "endpoint", "verdict", "outcome", "ended_at"]
    got = sorted(map(repr, spark.read.parquet(str(tmp_path / "out")).where("id < 99").select(cols).collect()))
    assert got == sorted(map(repr, O.outcomes(r, e, "id", "ts", 60, ["verdict"]).where("id < 99").select(cols).collect()))


def test_confirmations_never_downgrade(spark):
    served = spark.createDataFrame([(1, 0, "LOW"), (2, 0, "HIGH"), (3, 0, "MEDIUM"), (4, 0, "LOW")], "id long, t long, risk string").withColumn("ts", F.timestamp_seconds("t"))
    judged = spark.createDataFrame([(1, 5, "HIGH"), (2, 5, "LOW"), (3, 99, "HIGH")], "id long, t long, risk string").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.id: (r.confirmation, r.final_risk) for r in O.confirmations(served, judged, "id", "ts", 60).collect()}
    assert got == {1: ("escalated", "HIGH"), 2: ("stands", "HIGH"), 3: ("unverified", "MEDIUM"), 4: ("unverified", "LOW")}


# -- sketches -------------------------------------------------------------

def test_merged_sketches_keep_the_rank_error(spark):
    r = np.random.default_rng(3)
    x = [("a", float(v)) for v in r.exponential(50, 20_000).round(1)] + [("b", float(v)) for v in r.normal(0, 1, 500)] + [("b", float("nan")), ("b", None), ("c", 7.0)]
    df = spark.createDataFrame([(k, v, i % 10) for i, (k, v) in enumerate(x)], "k string, v double, d int").withColumn("ts", F.timestamp_seconds(F.col("d") * 86400)).repartition(8)
    windows_ = sketch.window_sketches(df, ["k"], "ts", "v")
    est = sketch.quantiles(sketch.merged(windows_, ["k"]), ["k"], [0.01, 0.5, 0.95, 0.99])
    got = sketch.rank_errors(est, df, ["k"], "v").collect()
    assert len(got) == 12 and windows_.count() > 20
    assert all(r.rank_error <= sketch.RANK_ERROR for r in got) and {r.k: r.n for r in got} == {"a": 20_000, "b": 500, "c": 1}


# -- rule packs -----------------------------------------------------------

def test_literal_runs():
    assert RI.literal_runs("ignore (all|previous) rules") == ["ignore ", " rules"]
    assert RI.literal_runs("colou?r and [xy]+ end") == ["colo", "r and ", " end"]
    assert RI.literal_runs("a|b") == [] and RI.literal_runs("(?i)abc") == [] and RI.literal_runs(r"x\.y\s+zed{2,3}w") == ["x.y", "ze", "w"]
    assert RI.literal_runs("ab*c") == ["a", "c"] and RI.literal_runs(r"\bword\b") == ["word"]


def test_rule_pack_equals_one_test_per_pattern(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(2, 6)))
    texts = [None, "", "abc", "héllo wörld", "a.b.c literal"] + [" ".join(word() for _ in range(r.randint(1, 80))) for _ in range(120)]
    pool = [w for t in texts if t for w in re.findall(r"\w+ \w+", t)]
    rules = [(i, r.randrange(3), p, True) for i, p in enumerate(dict.fromkeys(r.sample(pool, 300)))]
    n = len(rules)
    rules += [(n, 0, r"a.b.c", True), (n + 1, 1, r"wör", True), (n + 2, 2, r"e[ab]+d", False), (n + 3, 0, "abcd+ (a|b)", False), (n + 4, 2, "x|y|abc", False), (n + 5, 1, "nothing like it", True)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, body string").repartition(3)
    got = {x.doc: (x.priority, x.pattern_id) for x in RI.match(df, RI.pattern_frame(spark, rules), "doc", "body").collect()}
    want = {}
    for i, t in enumerate(texts):
        hit = [(p, k) for k, p, pat, lit in rules if t is not None and ((pat in t) if lit else re.search(pat, t))]
        if hit:
            want[i] = min(hit)
    assert got == want and len(want) > 60


def test_grams_of_texts_are_not_written(spark, monkeypatch):
    """Only the patterns' grams are kept; a match before a regular
    expression ends the search, one after it does not."""
    kept = []
    monkeypatch.setattr(RI, "cut_lineage", lambda df: kept.append(df.columns) or df)
    texts = spark.createDataFrame([(1, "one two three"), (2, "three four 55555"), (3, "one two 55555"), (None, "one two"), (4, None)], "doc long, body string")
    rules = RI.pattern_frame(spark, [(0, 1, "one two", True), (1, 0, "55555?", False), (2, 0, "three four", True), (3, 2, "one two", True)])
    got = {r.doc: r.pattern_id for r in RI.match(texts, rules, "doc", "body").collect()}
    assert got == {1: 0, 2: 1, 3: 1}
    assert not [c for c in kept if "__id" in c or "__t" in c]


# -- vector means ---------------------------------------------------------

def test_centroids_make_no_row_per_component(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 6))
    df = spark.createDataFrame([(None if i % 11 == 0 else i % 3, None if i == 7 else x[i].tolist()) for i in range(300)], "g int, v array<double>").repartition(5)
    c = V.centroids(df, "g", "v")
    plan = c._jdf.queryExecution().toString()
    assert "posexplode" not in plan.lower() and "Generate" not in plan
    got = {row.g: row.centroid for row in c.collect()}
    for g in (None, 0, 1, 2):
        at = [i for i in range(300) if i != 7 and ((i % 11 == 0) if g is None else (i % 11 and i % 3 == g))]
        assert np.allclose(got[g], x[at].mean(axis=0))
    assert json.dumps(sorted(got, key=str)) and V.centroids(df.limit(0), "g", "v").count() == 0


# -- tables stored under a fingerprint ------------------------------------

def test_stored_tables_follow_their_input(spark, tmp_path):
    from riskframe.sources import io
    at, made = str(tmp_path / "t"), []

    def build():
        made.append(1)
        return spark.read.parquet(at).selectExpr("id * 2 AS x")
    spark.range(3).write.parquet(at)
    key = lambda *p: io.input_fingerprint(spark, spark.read.parquet(at), *p)
    first = key("a")
    for _ in range(2):
        assert sorted(r.x for r in io.stored(spark, "twice", first, build).collect()) == [0, 2, 4]
    assert len(made) == 1 and key("a") == first and key("b") != first
    spark.range(4).write.mode("append").parquet(at)
    assert key("a") != first
    assert io.stored(spark, "twice", key("a"), build).count() == 7 and len(made) == 2
