"""Source loading, packs, set operations and composed reports.

Bindings: ``documents`` and ``conversations`` are corpus sources beside one
that is missing; ``benchmark`` items are anchors of a policy file and lines of
a text list; the warm verdict of an event is served from the event it reuses.
"""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions import rules as R
from riskframe.functions import text as X
from riskframe.operators import corpus, folds
from riskframe.operators import evaluate as EV
from riskframe.plans import bound, q_corpus, q_eval, q_ops, q_vectors
from riskframe.session import checkpoint_dir
from riskframe.sources import io
from riskframe.sources.tables import table, text_table

REQUIRED_FIELDS = ["k", "tenant", "v"]
LIMIT = 50


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def source_load_report(spark, sf_dir) -> DataFrame:
    """S1 + U1: sources mapped to one schema and united; a source that fails
    to load is recorded, the others go on."""
    cols = ["id", "text"]
    registry = {
        "documents": lambda s: table(s, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"),
        "missing": lambda s: s.read.parquet(f"{sf_dir.rstrip('/')}/no_such_table.parquet").select(*cols),
        "conversations": lambda s: table(s, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "text"),
    }
    rows, provenance = corpus.load_sources(spark, registry, cols)
    n = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.max("priority").alias("priority"))
    return provenance.join(n, "source", "left").select("source", "status", F.col("reason").isNotNull().alias("has_reason"),
                                                       F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "priority")


def attack_labels(spark, sf_dir) -> DataFrame:
    """Label and class of each labelled row from its two flags (a
    document of low quality plays the jailbreaking one)."""
    lab = table(spark, sf_dir, "labels").withColumn("jailbreaking", (F.col("quality") == 0).cast("int"))
    a = corpus.attack_label("jailbreaking", "toxic")
    return lab.select(a.alias("a")).groupBy("a.label", "a.attack_class").agg(F.count(F.lit(1)).alias("n"))


def anchor_packs(spark, sf_dir) -> DataFrame:
    """S6 + S14: the anchors of a policy file (safe ones, and threats by
    class) and of a text list with blank lines."""
    b = table(spark, sf_dir, "benchmark")
    # a policy file is one JSON document: its lists are as long as the pack
    items = F.sort_array(F.collect_list(F.struct("item_id", "text")))
    of = lambda k: F.transform(F.filter("items", lambda x: F.pmod(x["item_id"], F.lit(3)) == k), lambda x: x["text"])
    policy, lines = _folder(spark, "policy"), _folder(spark, "anchors")
    (b.agg(items.alias("items")).select(F.to_json(F.struct(of(0).alias("safe_anchors"), F.struct(of(1).alias("jailbreak"), of(2).alias("harmful")).alias("threat_anchor_classes"))).alias("value"))
     .coalesce(1).write.text(policy))
    b.select(F.concat(F.lit("\n  "), F.regexp_replace("text", "[\r\n]+", " "), F.lit(" \n")).alias("value")).write.text(lines)
    pack = io.read_anchor_pack(spark, policy).select("set", "class", "anchor_id", "text")
    listed = io.read_text_list(spark, lines, "listed").select("set", F.lit("listed").alias("class"), F.lit(None).cast("int").alias("anchor_id"), "text")
    return pack.unionByName(listed)


def rule_pack_verdicts(spark, sf_dir) -> DataFrame:
    """Documents under a rule pack loaded from a file, and under one
    whose file is missing, which fails closed."""
    path = _folder(spark, "rules")
    io.write_small(spark, f"{path}/pack.json", json.dumps({
        "jailbreak_patterns": bound.RULES.jailbreak, "instruction_override_patterns": bound.RULES.override,
        "hard_ban_keywords": bound.RULES.hard_ban, "suspicious_phrases": bound.RULES.suspicious}))
    d = text_table(spark, sf_dir, "documents", "doc_id").select(F.lower("text").alias("t"))
    packs = {"loaded": R.load_rule_pack(spark, f"{path}/pack.json"), "missing": R.load_rule_pack(spark, f"{path}/none.json")}
    v = F.explode(F.array(*[F.struct(F.lit(n).alias("pack"), R.symbolic_violation("t", p, lowered=True).alias("violation")) for n, p in packs.items()]))
    return d.select(v.alias("v")).groupBy("v.pack", "v.violation").agg(F.count(F.lit(1)).alias("n"))


def interval_labels(spark, sf_dir) -> DataFrame:
    """The bootstrap intervals as printed in reports."""
    b = q_eval.bootstrap_auc_ci(spark, sf_dir)
    return b.select("lang", EV.format_ci("point", "ci_lo", "ci_hi").alias("auc"))


def cold_and_warm(spark, sf_dir) -> DataFrame:
    """A row per warm hit: risk and latency of the hit and of the event it
    reuses."""
    ev = table(spark, sf_dir, "events").withColumn("prompt_hash", F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), "event_type"), 256))
    risk = F.when(F.col("value") >= 60, "HIGH").when(F.col("value") >= 20, "MEDIUM").otherwise("LOW")
    hits = folds.ttl_reuse(ev, "prompt_hash", "ts", "event_id", q_ops.TTL).where("hit").select(F.col("event_id").alias("warm_id"), "origin_id")
    side = lambda p, i: ev.select(F.col("event_id").alias(i), F.col("value").alias(f"{p}_ms"), risk.alias(f"{p}_risk"), *(["prompt_hash", "event_type"] if p == "warm" else []))
    return hits.join(side("warm", "warm_id"), "warm_id").join(side("cold", "origin_id"), "origin_id")


def cold_warm_agreement(spark, sf_dir) -> DataFrame:
    """Per prompt, whether its warm verdicts agree with the cold ones."""
    p = cold_and_warm(spark, sf_dir).groupBy("event_type", "prompt_hash").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("warm_risk") == F.col("cold_risk")).alias("same"))
    return p.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_prompts"), F.sum("n").alias("n_hits"), F.sum("same").alias("n_same"),
                                       F.count_if(F.col("n") == F.col("same")).alias("n_prompts_agree"))


def decision_quality_report(spark, sf_dir) -> DataFrame:
    """One report: the operational and the strict view, agreement of
    cold and warm verdicts, and how much faster the warm ones are."""
    views = q_vectors.operational_vs_strict_confusion(spark, sf_dir)
    metrics = ["accuracy", "precision", "recall", "f1", "fpr"]
    stack = ", ".join(f"'{m}', {m}" for m in metrics)
    quality = views.selectExpr("view AS section", f"stack({len(metrics)}, {stack}) AS (metric, value)")
    cw = cold_and_warm(spark, sf_dir).agg(
        F.count(F.lit(1)).cast("double").alias("n_hits"), F.avg((F.col("warm_risk") == F.col("cold_risk")).cast("double")).alias("agreement"),
        F.try_divide(F.avg("cold_ms"), F.avg("warm_ms")).alias("speedup"))
    cache = cw.selectExpr("'cold_warm' AS section", "stack(3, 'n_hits', n_hits, 'agreement', agreement, 'speedup', speedup) AS (metric, value)")
    return quality.unionByName(cache).select("section", "metric", F.round("value", 6).alias("value"))


def missing_fields(spark, sf_dir) -> DataFrame:
    """Required fields that a record lacks, and fields nobody asked for,
    as set differences per row."""
    have = F.coalesce(F.map_keys(F.from_json("props", "map<string,string>")), F.array().cast("array<string>"))
    need = F.array(*[F.lit(f) for f in REQUIRED_FIELDS])
    ev = table(spark, sf_dir, "events").select("event_type", F.array_union(
        F.transform(F.array_except(need, have), lambda f: F.struct(F.lit("missing").alias("kind"), f.alias("field"))),
        F.transform(F.array_except(have, need), lambda f: F.struct(F.lit("extra").alias("kind"), f.alias("field")))).alias("d"))
    return ev.select("event_type", F.explode("d").alias("d")).groupBy("event_type", "d.kind", "d.field").agg(F.count(F.lit(1)).alias("n"))


def pattern_overlap(spark, sf_dir) -> DataFrame:
    """U4: whether pattern lists are disjoint: the phrases of each language
    are one list; lists that share a phrase, and how many."""
    d = text_table(spark, sf_dir, "documents", "doc_id")
    lists = d.select("lang", F.explode(F.regexp_extract_all("text", F.lit("[a-z]+ [a-z]+ [a-z]+"), F.lit(0))).alias("p")).distinct()
    # a phrase is in one list per language at most: few pairs a phrase
    of = lists.groupBy("p").agg(F.sort_array(F.collect_set("lang")).alias("l")).where(F.size("l") > 1)
    pairs = F.filter(F.flatten(F.transform("l", lambda a: F.transform("l", lambda b: F.struct(a.alias("a"), b.alias("b"))))), lambda x: x["a"] < x["b"])
    return of.select(F.explode(pairs).alias("x")).groupBy(F.col("x.a").alias("list_a"), F.col("x.b").alias("list_b")).agg(F.count(F.lit(1)).alias("n_shared"))


def limited_suite(spark, sf_dir) -> DataFrame:
    """The first rows of the suite in its shuffled order (the report's
    ``limit`` option)."""
    return q_corpus.build_suite_uncapped(spark, sf_dir).orderBy("shuffle_key", "id").limit(LIMIT).select("id", "source", "label", "language")


def normalised_text(spark, sf_dir) -> DataFrame:
    """The digest of each document's normalised text."""
    d = text_table(spark, sf_dir, "documents", "doc_id")
    return d.select("doc_id", F.sha2(X.normalize_prompt("text"), 256).alias("normalised_sha256"))


QUERIES = {f.__name__: f for f in (
    source_load_report, attack_labels, anchor_packs, rule_pack_verdicts, interval_labels, cold_warm_agreement, decision_quality_report,
    missing_fields, pattern_overlap, limited_suite, normalised_text)}
