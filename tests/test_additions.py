"""Source provenance, feature matrix, fusion detail, entity spans,
per-stratum caps."""
import hashlib
import re

from pyspark.sql import functions as F

from riskframe.functions import text as X
from riskframe.operators import cascade as K
from riskframe.operators import corpus, detectors as D


def test_load_sources_skips_failures(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text('{"text": "hello there", "label": 0, "attack_class": "benign"}\n')
    reg = {"good": lambda s: s.read.schema("text string, label int, attack_class string").json(str(good)),
           "missing": lambda s: s.read.parquet(str(tmp_path / "nope.parquet"))}
    u, prov = corpus.load_sources(spark, reg, ["text", "label", "attack_class"])
    assert u.count() == 1
    st = {r.source: r.status for r in prov.collect()}
    assert st == {"good": "ok", "missing": "skipped"}


def test_feature_matrix_drops_incomplete(spark):
    store = spark.createDataFrame([("a", 1, 0.1), ("b", 1, 0.2), ("a", 2, 0.3)], "detector string, id long, score double")
    m, dropped = D.feature_matrix(store, ["a", "b"])
    assert [(r.id, r.a, r.b) for r in m.collect()] == [(1, 0.1, 0.2)]
    assert dropped.first().dropped == 1


def test_fusion_detail_first_missing_in_order(spark):
    pol = {"feature_order": ["x", "y", "z"]}
    df = spark.createDataFrame([(None, None, 1.0), (1.0, 1.0, 1.0)], "x double, y double, z double")
    got = [r[0] for r in df.select(K.fusion_detail({"x": "x", "y": "y", "z": "z"}, pol)).collect()]
    assert got == ["x unavailable", None]


def test_entity_tagger_to_span_redaction(spark):
    def _caps_tagger(text):
        return [(m.start(), m.end(), "PERSON") for m in re.finditer(r"\b[A-Z][a-z]+\b", text)]
    df = spark.createDataFrame([(1, "ask Alice and Bob now"), (2, "nothing here")], "id long, text string")
    spans = X.tag_entities(df, "id", "text", _caps_tagger)
    agg = spans.groupBy("id").agg(F.collect_list(F.struct("start", "end", "label")).alias("spans"))
    out = df.join(agg, "id", "left").select(
        "id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(X.redact_spans("text", "spans")).alias("t"))
    got = {r.id: r.t for r in out.collect()}
    assert got == {1: "ask [REDACTED:PERSON] and [REDACTED:PERSON] now", 2: "nothing here"}


def test_capped_sample_per_stratum(spark):
    rows = [(i, ["a", "b", "c"][i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string")
    got = corpus.capped_sample(df, "k", "id", {"a": 10, "b": 20}, seed=1).groupBy("k").count()
    assert {r.k: r["count"] for r in got.collect()} == {"a": 10, "b": 20, "c": 100}
    keep_a = {r.id for r in corpus.capped_sample(df, "k", "id", {"a": 10}, seed=1).where("k = 'a'").collect()}
    exp = sorted((i for i, k in rows if k == "a"), key=lambda i: hashlib.md5(f"{i}:1".encode()).hexdigest())[:10]
    assert keep_a == set(exp)


def test_shuffle_key_is_md5(spark):
    df = spark.createDataFrame([(7,)], "id long")
    assert df.select(corpus.shuffle_key("id", 3)).first()[0] == hashlib.md5(b"7:3").hexdigest()
