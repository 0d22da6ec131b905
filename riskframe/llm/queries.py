"""Registered queries of this package: each applies one operator to its whole
table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import (decontam, filter_audit, fim, genetic_packing, html_extract, jaccard, lm_score, packing, quality, secret_scan,
                           suffix_dedup, token_counts, urls)
from riskframe.sources.tables import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return d.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                    F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rows(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return d.select(
        F.col("row.doc_id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.spans_text("spans", kinds=secret_scan.BASE), 256).alias("base_sha256"),
        secret_scan.spans_text("spans").alias("spans"))


def op5_benchmark_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = jaccard.near_duplicates(table(spark, sf_dir, "documents"))
    return d.select(F.col("k_id").alias("doc_id"), "class_id", "n_links", "n_copies")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet").select("page_id", "url")
    return urls.judge(pages, urls.train(urls.labelled_rows(urls.labelled_table(spark))))


def op8_lm_score_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lm_score.backoff_scores(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_top", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.context_table(token_counts.histogram(table(spark, sf_dir, "documents")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fim.transform(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                    F.sha2(fim.restored(), 256).alias("restored_sha256"))


def op13_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genetic_packing.pack(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_quality_rules, op3_html_text, op4_secret_scan, op5_benchmark_templates, op6_ngram_jaccard, op7_url_filter, op8_lm_score_order3, op9_packing, op10_token_counts,
                                op11_filter_audit, op12_fill_in_middle, op13_genetic_packing)}
