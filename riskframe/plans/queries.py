"""Registered queries: each binds an operator chain to the input tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole tables.  Column names match the DuckDB cross-check in
:mod:`riskframe.plans.oracle`.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import screening
from riskframe.plans import bound
from riskframe.sources.tables import text_table


def symbolic_veto_by_source(spark, sf_dir):
    docs = text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "source", "text")
    return screening.veto_tally(screening.screen_prompts(docs, rules=bound.RULES), "source")


def pii_redact_regex(spark, sf_dir):
    docs = text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    from riskframe.functions.text import with_redaction
    r = with_redaction(docs, "text")
    return r.select(
        "doc_id",
        F.size("redacted_items").cast("long").alias("n_items"),
        F.array_join("redacted_items", "|").alias("items"),
        F.length("clean_text").cast("long").alias("clean_len"),
        F.sha2("clean_text", 256).alias("clean_sha256"))


QUERIES = {
    "symbolic_veto_by_source": symbolic_veto_by_source,
    "pii_redact_regex": pii_redact_regex,
}

from riskframe.plans import q_eval  # noqa: E402

QUERIES.update(q_eval.QUERIES)

from riskframe.plans import q_corpus  # noqa: E402

QUERIES.update(q_corpus.QUERIES)

from riskframe.plans import q_vectors  # noqa: E402

QUERIES.update(q_vectors.QUERIES)

from riskframe.plans import q_ops  # noqa: E402

QUERIES.update(q_ops.QUERIES)

from riskframe.plans import q_detect  # noqa: E402

QUERIES.update(q_detect.QUERIES)

from riskframe.plans import q_more  # noqa: E402

QUERIES.update(q_more.QUERIES)

from riskframe.plans import q_learn  # noqa: E402

QUERIES.update(q_learn.QUERIES)

from riskframe.plans import q_assess  # noqa: E402

QUERIES.update(q_assess.QUERIES)

from riskframe.plans import q_fields  # noqa: E402

QUERIES.update(q_fields.QUERIES)

from riskframe.plans import q_stores  # noqa: E402

QUERIES.update(q_stores.QUERIES)

from riskframe.plans import q_reports  # noqa: E402

QUERIES.update(q_reports.QUERIES)
