"""Corpus queries over ``documents`` (+ ``labels``).

Binding: ``source`` is the corpus source; its registry priority is the
number in its name (src0 first); ``doc_id`` is the row ordinal.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions import rules as R
from riskframe.functions import text as X
from riskframe.operators import corpus
from riskframe.plans import bound
from riskframe.sources.tables import table, text_table

CAP_PER_SOURCE = 20
SEED = 42


def _docs(spark, sf_dir):
    d = text_table(spark, sf_dir, "documents", "doc_id")
    return d.withColumn("priority", F.regexp_extract("source", r"(\d+)$", 1).try_cast("int"))


def language_tag_crosstab(spark, sf_dir):
    d = text_table(spark, sf_dir, "documents", "doc_id").select("lang", "text")
    return d.groupBy("lang", X.detect_language("text").alias("language")).agg(F.count(F.lit(1)).alias("n"))


def dedup_first_wins(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("language", X.detect_language("text"))
    out = corpus.dedup_first_wins(d, "priority", "doc_id", ["doc_id", "source", "language"])
    return out.select("id", "doc_id", "source", "language", F.col("copies").cast("long").alias("copies"))


def suite_manifest(spark, sf_dir):
    d = _docs(spark, sf_dir).join(
        table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id", "left")
    return corpus.manifest(d, "priority", "doc_id", "source", "text", "label")


def source_cap_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return corpus.capped_sample(d, "source", "doc_id", CAP_PER_SOURCE, SEED)


def slice_report(spark, sf_dir):
    d = text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "source", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    x = d.join(lab, "doc_id").select(
        "source", X.detect_language("text").alias("language"),
        F.when(F.col("toxic") == 1, "harmful").otherwise("benign").alias("attack_class"),
        F.col("toxic").alias("label"),
        (R.phrase_intent("text", bound.RULES, bound.MEDIUM_PHRASES) != "LOW").alias("flagged"))
    return corpus.slice_counts(x, ["attack_class", "language", "source"], {
        "n": F.count(F.lit(1)),
        "n_attack": F.count_if(F.col("label") == 1),
        "n_flagged": F.count_if("flagged"),
    })


# bound so that short and long documents are rejected
REQUEST_CHARS = (100, 10_000)


def request_validation(spark, sf_dir):
    """Prompts are the documents; a response that never came (a prompt
    turn without one) is a missing text of the source ``conversation``."""
    from riskframe.operators import govern
    from riskframe.operators.screening import validate_requests
    d = table(spark, sf_dir, "documents").select("source", "text")
    c = govern.pair_turns(table(spark, sf_dir, "conversations")).select(F.lit("conversation").alias("source"), F.col("response").alias("text"))
    d = validate_requests(d.unionByName(c), "text", *REQUEST_CHARS)
    status = F.coalesce(F.col("reject_reason"), F.lit("accepted"))
    return d.groupBy("source", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def request_ids(spark, sf_dir):
    """The last path segment of each page URL is an incoming request id;
    it is kept when it is a clean token (trimmed, at most 64 characters of
    [A-Za-z0-9._:-]) and otherwise replaced by a replayable minted id."""
    pg = table(spark, sf_dir, "pages").select("page_id", "url")
    raw = F.regexp_extract("url", r"[^/]*$", 0)
    minted = F.substring(F.sha2(F.concat(F.lit("page:"), F.col("page_id").cast("string")), 256), 1, 32)
    rid = X.sanitize_request_id(raw, minted)
    return pg.select("page_id", rid.alias("request_id"), (rid == minted).alias("minted"))


def incremental_todo(spark, sf_dir):
    """Rows not scored yet (``labels`` plays the score store)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    scored = table(spark, sf_dir, "labels").select("doc_id")
    return d.join(scored, "doc_id", "left_anti")


SUITE_SOURCE_CAP = 45
SUITE_BENIGN_CAP = 120


def build_suite(spark, sf_dir):
    """K2 over the labelled corpus: 45 rows per source (hash order), dedup,
    language, then at most 120 benign rows."""
    d = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")),
                                  "doc_id")
    out = corpus.build_suite(d, "priority", "doc_id", SUITE_SOURCE_CAP, SUITE_BENIGN_CAP, SEED)
    return out.select("id", "doc_id", "source", "label", "language", "shuffle_key")


def build_suite_uncapped(spark, sf_dir):
    """K2 over every document, labelled or not (an unlabelled one is
    benign): no caps, so deduplication sees the whole table."""
    d = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id", "left")
    out = corpus.build_suite(d.fillna(0, ["label"]), "priority", "doc_id", seed=SEED)
    return out.select("id", "doc_id", "source", "label", "language", "shuffle_key")


QUERIES = {
    "build_suite_uncapped": build_suite_uncapped,
    "build_suite": build_suite,
    "language_tag_crosstab": language_tag_crosstab,
    "dedup_first_wins": dedup_first_wins,
    "suite_manifest": suite_manifest,
    "source_cap_sample": source_cap_sample,
    "slice_report": slice_report,
    "request_validation": request_validation,
    "incremental_todo": incremental_todo,
    "request_ids": request_ids,
}
