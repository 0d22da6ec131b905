"""Mergeable quantile sketches per key and window (A9, A10, A19 at scale).

The exact percentiles of :mod:`metrics` sort every value.  A KLL sketch holds
a few kilobytes a group whatever the number of values, is built with map-side
partial sketches, and sketches of windows merge into sketches of days or of
all keys, so a long history is read once.  ``k`` sets the rank error: about
``2.3 / k`` of the rows (1.2 % at 200, the default).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 400
RANK_ERROR = 0.015


def window_sketches(df: DataFrame, keys: list[str], ts: str, value: str, window: str = "1 day", k: int = K) -> DataFrame:
    """One sketch per key and window; null and NaN values are left out."""
    x = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return (x.groupBy(*keys, F.window(F.col(ts).cast("timestamp"), window).alias("w"))
            .agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"))
            .select(*keys, F.col("w.start").alias("window_start"), "sketch", "n"))


def merged(sketches: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Sketches of coarser groups from those of finer ones."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """``keys, n, q, value``: a row per asked quantile."""
    each = [F.struct(F.lit(float(q)).alias("q"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias("value")) for q in qs]
    return sketches.select(*keys, "n", F.explode(F.array(*each)).alias("e")).select(*keys, "n", "e.q", "e.value")


def rank_errors(estimates: DataFrame, df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The exact rank of every estimate in ``df`` and its distance from the
    rank asked for.  An estimate is one of the values, and every rank from
    the share of smaller values to the share of values up to it is its own."""
    x = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    # a row per key and asked quantile: a small side
    est = estimates.select(*keys, "q", F.col("value").alias("__est"), F.col("n").alias("__n"))
    j = x.select(*keys, F.col(value).cast("double").alias("__v")).join(F.broadcast(est), keys)
    r = j.groupBy(*keys, "q", "__est", "__n").agg(F.count_if(F.col("__v") < F.col("__est")).alias("lt"), F.count_if(F.col("__v") <= F.col("__est")).alias("le"))
    low, high = F.col("lt") / F.col("__n"), F.col("le") / F.col("__n")
    return r.select(*keys, "q", F.col("__n").alias("n"), F.col("__est").alias("value"),
                    F.greatest(low - F.col("q"), F.col("q") - high, F.lit(0.0)).alias("rank_error"))
