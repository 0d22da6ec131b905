"""Exact length histogram of encoded documents, and what its suffix sums
answer for every context limit.

Documents are aggregated by encoded length.  With ``C(L)`` the documents
longer than L and ``S(L)`` their tokens, a corpus truncated at L keeps
``total - S(L) + L * C(L)`` tokens; quantiles are read off the running
count.  Sums run over ranges of lengths: the totals of the ranges (at most
the largest length divided by ``RANGE``) are summed first, then each range
inside itself.

Defined results: a null or empty text has length 0; repeated rows count
each; ties share a histogram row; texts are encoded whole; an empty table
gives no rows; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskframe.llm import tokens
from riskframe.llm.common import frugal, saved

RANGE = 512


def encoded_length(text_col: str = "text", tokenizer: str | None = None):
    """Column: number of ids of a whole text."""
    path = tokenizer or tokens.tokenizer_path()

    @F.arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = tokens.encoder(path)
        for text in frugal(batches):
            parts = [np.diff(off) for _, _, _, off in enc.blocks(text)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
    return lengths(F.col(text_col).cast("string"))


def histogram(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): one row per encoded length that occurs, written
    once, as its users read it more than once."""
    return saved(docs.select(encoded_length(text_col, tokenizer).alias("n_tokens"))
                 .groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))


def context_table(hist: DataFrame, range_size: int = RANGE) -> DataFrame:
    """For each length L that occurs, taken as a context limit: documents and
    tokens within and over it, the total truncated at L and the padded
    total.  Between two rows all columns are linear in L or constant, see
    :func:`at_limits`."""
    h = hist.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tok"),
                    F.floor(F.col("n_tokens") / range_size).alias("r"))
    before = W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0))
    ranges = (h.groupBy("r").agg(F.sum("n_docs").alias("rd"), F.sum("tok").alias("rt"))
              .select("r", F.coalesce(F.sum("rd").over(before), F.lit(0)).alias("d0"),
                      F.coalesce(F.sum("rt").over(before), F.lit(0)).alias("t0"),
                      F.sum("rd").over(every).alias("docs_total"), F.sum("rt").over(every).alias("tokens_total")))
    inside = W.partitionBy("r").orderBy("n_tokens").rowsBetween(W.unboundedPreceding, 0)
    j = h.join(ranges, "r")
    within = F.sum("n_docs").over(inside) + F.col("d0")
    tokens_within = F.sum("tok").over(inside) + F.col("t0")
    t = j.select(F.col("n_tokens").alias("context_limit"), "n_docs", within.alias("docs_within"),
                 tokens_within.alias("tokens_within"), "docs_total", "tokens_total")
    over = F.col("docs_total") - F.col("docs_within")
    return t.select("context_limit", "n_docs", "docs_within", over.alias("docs_over"), "tokens_within",
                    (F.col("tokens_total") - F.col("tokens_within")).alias("tokens_over"),
                    (F.col("tokens_within") + over * F.col("context_limit")).alias("tokens_truncated"),
                    (F.col("docs_total") * F.col("context_limit")).alias("tokens_padded"),
                    (F.col("docs_within") / F.col("docs_total")).alias("quantile"))


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """Rows (context_limit, docs_within, docs_over, tokens_truncated) for any
    limits: the totals over a limit are the suffix above it."""
    limit = table.sparkSession.createDataFrame([(int(x),) for x in limits], "l long")
    below = F.col("context_limit") <= F.col("l")
    return (table.join(F.broadcast(limit), F.lit(True)).groupBy("l")
            .agg(F.sum(F.when(below, F.col("n_docs")).otherwise(0)).alias("docs_within"),
                 F.sum(F.when(~below, F.col("n_docs")).otherwise(0)).alias("docs_over"),
                 F.sum(F.col("n_docs") * F.least("context_limit", "l")).alias("tokens_truncated"))
            .withColumnRenamed("l", "context_limit"))


def quantile(table: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share ``q`` of documents do not
    exceed (one row; none for an empty table)."""
    return table.where(F.col("docs_within") >= F.lit(q) * (F.col("docs_within") + F.col("docs_over"))).agg(
        F.min("context_limit").alias("length")).where("length is not null")
