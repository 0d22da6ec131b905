"""Readers and sinks: tolerant JSONL, anchor packs, validated configs,
audit rows, cache snapshots, score store and fixture checks."""
import json

import pytest
from pyspark.sql import functions as F

from riskframe.operators import detectors as D
from riskframe.sources import io


def test_tolerant_jsonl_drops_half_written_line(spark, tmp_path):
    p = tmp_path / "scores.jsonl"
    p.write_text('{"id": "a", "score": 0.1}\n\n{"id": "b", "score": 0.9}\n{"id": "c", "sco')
    rows = {r.id: r.score for r in io.read_jsonl_tolerant(spark, str(p)).collect()}
    assert rows == {"a": 0.1, "b": 0.9}


def test_anchor_pack_classes_and_legacy(spark, tmp_path):
    a = tmp_path / "a.json"
    a.write_text(json.dumps({"safe_anchors": ["s1", "s2"], "threat_anchor_classes": {"jailbreak": ["j1"], "harmful": ["h1", "h2"]}}))
    got = sorted((r.set, r["class"], r.text) for r in io.read_anchor_pack(spark, str(a)).collect())
    assert got == [("safe", "safe", "s1"), ("safe", "safe", "s2"), ("threat", "harmful", "h1"),
                   ("threat", "harmful", "h2"), ("threat", "jailbreak", "j1")]
    b = tmp_path / "b.json"
    b.write_text(json.dumps({"threat_anchors": ["t1"]}))
    assert [(r["class"], r.text) for r in io.read_anchor_pack(spark, str(b)).collect()] == [("unclassified", "t1")]
    assert io.read_anchor_pack(spark, str(tmp_path / "missing.json")).count() == 0


def test_text_list(spark, tmp_path):
    p = tmp_path / "threats.txt"
    p.write_text("one\n\n  two  \n")
    assert [r.text for r in io.read_text_list(spark, str(p), "threat").collect()] == ["one", "two"]


def test_tenant_config_one_bad_entry(spark, tmp_path):
    p = tmp_path / "tenants.json"
    p.write_text(json.dumps({"acme": {"display_name": "Acme", "status": "active", "rate_limit_rpm": 60},
                             "bad": {"display_name": "B", "status": "paused"},
                             "neg": {"display_name": "N", "status": "active", "rate_limit_rpm": -1},
                             "off": {"display_name": "O", "status": "suspended"}}))
    valid, rejected = io.tenants_from_config(spark, str(p))
    assert sorted(r.tenant_id for r in valid.collect()) == ["acme", "off"]
    assert {r.key: r.reject_reason for r in rejected.collect()} == {"bad": "invalid status", "neg": "invalid rate limit"}


def test_audit_rows_hash_not_text(spark, tmp_path):
    v = spark.createDataFrame([("secret prompt", "GENERAL", "LOW", "ALLOW", "t1")],
                              "prompt string, capability string, risk string, decision string, tenant string")
    a = io.audit_rows(v)
    assert "prompt" not in a.columns
    r = a.first()
    import hashlib
    assert r.prompt_hash == hashlib.sha256(b"secret prompt").hexdigest() and r.request_id == "unset"
    io.write_audit(a, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).where("tenant = 't1'").count() == 1


def test_cache_snapshot_ttl(spark, tmp_path):
    rows = [("h1", "LOW", 0.1, 1000.0, "clean_pass", [1.0]), ("h2", "HIGH", 0.9, 1000.0 - 90000, "cache", [0.0])]
    io.save_cache(spark.createDataFrame(rows, io.CACHE_SCHEMA), str(tmp_path / "c"))
    alive = io.load_cache(spark, str(tmp_path / "c"), now_epoch=2000.0)
    assert [r.prompt_hash for r in alive.collect()] == ["h1"]
    assert io.load_cache(spark, str(tmp_path / "none"), 0.0).count() == 0


def test_score_store_incremental(spark, tmp_path):
    suite = spark.createDataFrame([(i, f"text {i}") for i in range(10)], "doc_id long, text string")

    def flaky(texts):                    # fails on odd rows -> they stay unscored
        return [0.5 if int(t.split()[1]) % 2 == 0 else None for t in texts]
    det = D.Detector("m", batch_fn=flaky)
    store = str(tmp_path / "store")
    io.append_scores(D.score_long(suite, "doc_id", [det]), store)
    s = io.read_scores(spark, store, ["m"])
    assert s.count() == 5 and not io.store_complete(s, suite, "doc_id", "m")
    todo = D.todo(suite, s, "doc_id", "m")
    assert sorted(r.doc_id for r in todo.collect()) == [1, 3, 5, 7, 9]


def test_fixture_checks(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, prompt string")
    r = io.fixture_checks(df, "id", "prompt").first()
    assert r.ids_sequential and not r.text_unique


def test_incremental_scoring_retries_and_resumes(spark, tmp_path):
    suite = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string").coalesce(1)
    store = str(tmp_path / "store")

    def flaky(texts):
        t = texts.iloc[0]
        n = int(t.split()[1])
        if n % 5 == 0:
            raise RuntimeError("model hiccup")        # always fails: stays unscored
        return [n / 100.0]
    det = D.Detector("m", batch_fn=flaky)
    assert D.incremental_score(suite, store, "doc_id", det) == 16
    assert D.incremental_score(suite, store, "doc_id", det) == 0   # failed rows retried, still failing
    s = io.read_scores(spark, store, ["m"])
    assert s.count() == 16 and s.where("score = 0").count() == 0

    def down(texts):
        raise RuntimeError("server down")
    with pytest.raises(D.ModelDown):
        D.incremental_score(suite, str(tmp_path / "s2"), "doc_id", D.Detector("d", batch_fn=down), abort_after=3)
    assert not io.path_exists(spark, str(tmp_path / "s2"))
    # a store that cannot be read is an error, not an empty store
    (tmp_path / "bad" / "detector=m").mkdir(parents=True)
    (tmp_path / "bad" / "detector=m" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):  # noqa: B017
        D.incremental_score(suite, str(tmp_path / "bad"), "doc_id", det)


def test_incremental_scoring_passes_rows_that_always_fail(spark, tmp_path):
    # the rows with the smallest id hashes always fail, one good row comes last
    ids = [r.id for r in spark.range(20).orderBy(F.xxhash64("id"), "id").collect()]
    suite = spark.createDataFrame([(i, "good" if i == ids[-1] else "bad") for i in ids], "doc_id long, text string")

    def fn(texts):
        if (texts == "bad").any():
            raise RuntimeError("cannot score")
        return [1.0] * len(texts)
    store = str(tmp_path / "store")
    assert D.incremental_score(suite, store, "doc_id", D.Detector("m", batch_fn=fn)) == 1
    assert [r.id for r in io.read_scores(spark, store, ["m"]).collect()] == [ids[-1]]


def test_one_bad_row_leaves_the_rest_of_its_batch(spark):
    def fn(texts):
        if (texts == "bad").any():
            raise RuntimeError("cannot score")
        return [float(len(t)) for t in texts]
    df = spark.createDataFrame([(i, "bad" if i == 7 else "x" * i) for i in range(100)], "id long, text string")
    for parts in (1, 5):
        got = D.model_scores(df.repartition(parts), "id", "text", D.Detector("m", batch_fn=fn)).collect()
        assert sorted(r.id for r in got) == [i for i in range(100) if i != 7]


def test_coverage_eta(spark):
    import datetime as dt
    store = spark.createDataFrame([("m", 1, 0.1, dt.datetime(2024, 1, 1, 0, 0, 0)),
                                   ("m", 2, 0.2, dt.datetime(2024, 1, 1, 0, 0, 10))],
                                  "detector string, id long, score double, scored_at timestamp")
    suite = spark.createDataFrame([(i,) for i in range(12)], "doc_id long")
    r = D.coverage_eta(store, suite, "doc_id").first()
    assert (r.done, r.total) == (2, 12) and abs(r.rows_per_sec - 0.2) < 1e-12 and abs(r.eta_seconds - 50.0) < 1e-9
