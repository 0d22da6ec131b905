"""Queries of the row-local and keyed operators on request fields, verdict
texts, entity spans, splits and stored verdicts.

Bindings: ``events`` carry the request fields (a proxy header, a peer
address and a credential header written from the event's own columns);
``conversations`` turns carry the answers of a judge and a hazard
classifier, in every shape the parsers know; ``documents`` are tagged with
numbers as organisations and long capitalised words as persons; the stored
verdicts are one per user.
"""
from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from riskframe.functions import text as X
from riskframe.operators import cascade as K
from riskframe.operators import evaluate as EV
from riskframe.plans import q_eval, q_ops, q_vectors
from riskframe.session import checkpoint_dir
from riskframe.sources import io
from riskframe.sources.tables import table, text_table
from riskframe.streaming.windows import escalate_verdicts

PREVALENCES = [0.001, 0.01, 0.1]
PREVALENCE_THRESHOLD = 40.0


def client_identity(spark, sf_dir):
    """P3 + P4: the caller's address behind and without a trusted proxy, and
    its bearer credential."""
    t, u = F.col("event_type"), F.col("user_id").cast("string")
    forwarded = (F.when(t == "view", F.concat(F.lit("10.0.0."), u, F.lit(", 192.168.1."), (F.col("event_id") % 250).cast("string")))
                 .when(t == "click", " , ").when(t == "error", F.concat(F.lit("  203.0.113."), u, F.lit(" ,"))))
    peer = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("172.16.0."), u)).when(F.col("event_id") % 3 == 1, "  ")
    header = (F.when(t == "view", F.concat(F.lit("Bearer tok"), u)).when(t == "click", F.concat(F.lit(" bearer   tok"), u))
              .when(t == "error", F.concat(F.lit("Basic "), u)).when(t == "signup", "Bearer"))
    return table(spark, sf_dir, "events").select(
        "event_id", X.client_address(forwarded, peer).alias("proxied"), X.client_address(forwarded, peer, False).alias("direct"),
        X.bearer_credential(header).alias("credential"))


_ENTITY = re.compile(r"(?P<PERSON>[A-Z][a-z]{11,})|(?P<ORG>[0-9]{3,})|(?P<DATE>%)")


def tag_words(text: str) -> list[tuple[int, int, str]]:
    """A tagger; its DATE entities are not among the labels asked for."""
    return [(m.start(), m.end(), m.lastgroup) for m in _ENTITY.finditer(text)]


def entity_redaction(spark, sf_dir):
    """U-3 + N6: tagged entities are spliced out of the text."""
    d = text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    spans = X.tag_entities(d, "doc_id", "text", tag_words).groupBy(F.col("id").alias("doc_id")).agg(
        F.collect_list(F.struct("start", "end", "label")).alias("spans"))
    d = d.join(spans, "doc_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,label:string>>")))
    return d.select("doc_id", F.size("spans").cast("long").alias("n_spans"), F.sha2(X.redact_spans("text", "spans"), 256).alias("redacted_sha256"))


def detector_probabilities(spark, sf_dir):
    """N17 + N18: vector components as signed scores and logits."""
    v = F.col("embedding").cast("array<double>")
    d = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    four = F.slice("v", 1, 4)
    return d.select(
        "vec_id", F.round(K.one_sided_probability(F.col("v")[0]), 9).alias("one_sided"),
        F.round(K.two_logit_probability(F.col("v")[1], F.col("v")[2]), 9).alias("two_logit"),
        F.round(K.multilabel_max(four, [0, 2], True), 9).alias("sigmoid_max"),
        F.round(K.multilabel_max(four, [0, 2], False), 9).alias("softmax_max"))


def verdict_arbitration(spark, sf_dir):
    """N15 + N16 + C6 + C5: answers are parsed, and the hazard classifier
    decides where it answered, else the judge; with and without clearance
    to LOW."""
    j, h = (F.col("conv_id") * 7 + F.col("turn")) % 6, (F.col("conv_id") + F.col("turn")) % 5
    judge = (F.when(j == 0, '```json\n{"verdict": "safe", "n": 1}\n```').when(j == 1, '{"verdict":"DANGEROUS"}')
             .when(j == 2, '{"verdict": " Ambiguous "}').when(j == 3, '{"verdict": "perhaps"}').when(j == 4, "I think it is safe"))
    hazard = (F.when(h == 0, "safe").when(h == 1, "unsafe\nS1,S10,S14").when(h == 2, " Safe \nS9").when(h == 3, "I cannot say"))
    d = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", (F.length("text") % 2 == 0).alias("threat"), judge.alias("judge"), hazard.alias("hazard"))
    d = d.withColumn("hz", K.parse_hazard_verdict("hazard")).select(
        "conv_id", "turn", "threat", F.when(F.col("judge").isNotNull(), K.parse_chat_verdict("judge")).alias("judge_verdict"),
        F.when(F.col("hazard").isNotNull(), F.col("hz.verdict")).alias("hazard_verdict"), F.array_join("hz.categories", ",").alias("categories"))
    strict, lenient = (K.arbitrate("hazard_verdict", "judge_verdict", "threat", low) for low in (False, True))
    return d.select("conv_id", "turn", "judge_verdict", "hazard_verdict", "categories", strict["risk"].alias("risk"), strict["source"].alias("source"),
                    lenient["risk"].alias("lenient_risk"), lenient["source"].alias("lenient_source"))


def _verdicts_of(spark, sf_dir):
    v = F.col("value")
    risk = F.when(v >= 100, "HIGH").when(v >= 40, "MEDIUM").otherwise("LOW")
    return table(spark, sf_dir, "events").select(
        F.sha2(F.col("user_id").cast("string"), 256).alias("prompt_hash"), "event_id", "user_id", "event_type",
        risk.alias("risk"), F.concat(F.lit("stage_"), "event_type").alias("source"), v.alias("score"))


def escalated_verdicts(spark, sf_dir):
    """C7 + T9: the first view of a user is the stored verdict (for two users
    in three); errors and clicks are late verdicts that may raise it."""
    x = _verdicts_of(spark, sf_dir)
    stored = (x.where((F.col("event_type") == "view") & (F.col("user_id") % 3 != 0)).groupBy("prompt_hash")
              .agg(F.min_by(F.struct("risk", "source", "score"), "event_id").alias("v")).select("prompt_hash", "v.*"))
    late = x.where(F.col("event_type").isin("error", "click") & ((F.col("risk") != "HIGH") | (F.col("score") < 130)))
    return escalate_verdicts(stored, late.select("prompt_hash", "risk", "source", "score"))


def anchor_detector_score(spark, sf_dir):
    """A symbolic hit (label 3 stands for one) scores 1."""
    s = q_vectors.signals(spark, sf_dir)
    return s.select("vec_id", F.round(K.anchor_detector(F.col("label") == 3, "threat_score", "meta_intent_score"), 6).alias("score"))


def fusion_availability(spark, sf_dir):
    """Detectors that did not answer (by label) make the fusion
    unavailable, with the first one in declared order as its detail."""
    pol = K.load_policy()
    f = q_vectors._features()
    s = q_vectors.signals(spark, sf_dir)
    s = s.withColumn(f["injection"], F.when(F.col("label") % 3 != 0, F.col(f["injection"]))) \
        .withColumn(f["toxicity"], F.when(F.col("label") % 4 != 0, F.col(f["toxicity"])))
    return s.select("vec_id", K.fusion_available(f, pol).alias("fusion_available"), K.fusion_detail(f, pol).alias("detail"),
                    F.round(K.fused_score(f, pol), 9).alias("fusion_score"))


def prevalence_precision(spark, sf_dir):
    """Precision per slice at assumed base rates."""
    c = EV.confusion_at_threshold(q_eval.scored_events(spark, sf_dir), "score", "label", PREVALENCE_THRESHOLD, ["k_band"])
    at = F.array(*[F.struct(F.lit(p).alias("prevalence"), EV.prevalence_adjusted_precision(F.col("recall"), F.col("fpr"), p).alias("p")) for p in PREVALENCES])
    x = c.withColumn("at", F.explode(at))
    return x.select("k_band", "at.prevalence", F.round("at.p", 9).alias("precision"))


def holdout_assignment(spark, sf_dir):
    """Train or test by a hash of the id."""
    return EV.holdout_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def fold_assignment(spark, sf_dir):
    """Stratified folds in hash order."""
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return EV.kfold(lab, "doc_id", "toxic").select("doc_id", "toxic", "fold")


def _folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def verdict_cache_roundtrip(spark, sf_dir):
    """Verdicts are saved, and loaded at the time of the last one; the
    expired ones stay behind."""
    ev = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    now = ev.agg(F.max("t")).first()[0]
    x = ev.select(F.sha2(F.col("event_id").cast("string"), 256).alias("prompt_hash"), F.when(F.col("value") >= 100, "HIGH").otherwise("LOW").alias("risk"),
                  F.col("value").alias("score"), F.col("t").alias("timestamp_epoch"), F.col("event_type").alias("source"),
                  F.array(F.col("value").cast("float")).alias("vector"))
    path = _folder(spark, "verdict-cache")
    io.save_cache(x, path)
    return io.load_cache(spark, path, now or 0.0).select("prompt_hash", "risk", "score", "source")


def score_store_roundtrip(spark, sf_dir):
    """S4 + S5: scores appended in two runs under their detector, one of them
    read back; the second run's JSON lines include half-written ones."""
    ev = table(spark, sf_dir, "events")
    store, lines = _folder(spark, "score-store"), _folder(spark, "score-lines")
    first = ev.where(F.col("event_type") == "view").select(F.lit("latency").alias("detector"), F.col("event_id").cast("string").alias("id"), F.col("value").alias("score"))
    io.append_scores(first, store)
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("value").alias("score")))
    torn = F.when(F.col("event_type") == "error", F.substring(line, 1, 9)).otherwise(line)
    ev.where(F.col("event_type").isin("click", "error")).select(torn.alias("value")).write.text(lines)
    io.append_scores(io.read_jsonl_tolerant(spark, lines).withColumn("detector", F.lit("remote")), store)
    return io.read_scores(spark, store, ["remote"]).select("detector", F.col("id").cast("string").alias("id"), "score")


def audit_projection(spark, sf_dir):
    """The audit row of a verdict: the prompt only as its hash, defaults
    for what is missing."""
    v = q_ops._verdict_log(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("request_id"), F.concat(F.lit("prompt "), F.col("user_id").cast("string")).alias("prompt"),
        "tenant", F.col("risk_level").alias("risk"), "decision", F.when(F.col("source") != "signup", F.col("source")).alias("source"),
        F.when(F.col("value") >= 10, F.col("value")).alias("semantic_score"), F.lit("GENERAL").alias("capability"), "ts")
    return io.audit_rows(v.withColumnRenamed("ts", "timestamp")).select(
        "request_id", "tenant", "capability", "risk", "decision", "prompt_hash", "semantic_score", "source", "symbolic_triggered", "judge_invoked")


def fixture_expectations(spark, sf_dir):
    """Row count, id range and uniqueness of the benchmark items."""
    b = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1).alias("item_id"), "text")
    return io.fixture_checks(b, "item_id", "text")


def report_roundtrip(spark, sf_dir):
    """S3 + S11: row output and its one-row summary, read back together."""
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    at = _folder(spark, "report")
    io.write_rows_and_summary(lab, lab.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("n_toxic")), at, "csv")
    rows = spark.read.schema("doc_id long, toxic int").option("header", True).csv(f"{at}/rows")
    summary = spark.read.schema("n long, n_toxic long").json(f"{at}/summary")
    head = summary.select(F.struct("n", "n_toxic")).scalar()
    return rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n_rows")).withColumns({"n": head["n"], "n_toxic": head["n_toxic"]})


QUERIES = {f.__name__: f for f in (
    client_identity, entity_redaction, detector_probabilities, verdict_arbitration, escalated_verdicts, anchor_detector_score,
    fusion_availability, prevalence_precision, holdout_assignment, fold_assignment, verdict_cache_roundtrip, score_store_roundtrip,
    audit_projection, fixture_expectations, report_roundtrip)}
