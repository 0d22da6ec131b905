"""Tie-aware ROC statistics on a distributed prefix sum.

A global ``Window.orderBy(score)`` sends a whole slice to one task.  Instead:

1. collapse rows to score groups ``(keys, score) -> pos, neg`` (map-side
   partial aggregation; ties become one row),
2. range-partition the groups by (keys, score): the cut points are sampled
   quantiles, so buckets hold about as many rows each whatever the values
   (an outlier, a peak or a burst does not empty the others); total each
   bucket and turn the totals into offsets with a small window,
3. run the running sum inside ``(keys, bucket)`` only and add the offset.

Every statistic below reads the resulting *score table*
``(keys, score, pos, neg, pos_lt, neg_lt, P, N)``, so evaluating a slice
costs the same as evaluating everything.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKETS = 4096
# up to so many rows in all, a running sum needs no buckets: one window per
# key holds them.  The result is the same either way.
WINDOW_ROWS = 100_000


ALL = "__all"


def _keys(keys) -> list[str]:
    """Key columns; no keys means one synthetic constant key, so every
    statistic is an equi-keyed aggregate/join and never a cross product."""
    if not keys:
        return [ALL]
    return [keys] if isinstance(keys, str) else list(keys)


def _done(df: DataFrame) -> DataFrame:
    return df.drop(ALL)


def score_groups(df: DataFrame, score: str, label: str, keys=None, weight: str | None = None) -> DataFrame:
    """``(keys, score) -> pos, neg`` (weighted counts when ``weight`` given).
    Rows with a null or NaN score are not scored and are left out."""
    ks = _keys(keys)
    w = F.col(weight) if weight else F.lit(1)
    is_pos = F.col(label).cast("int") == 1
    if ks == [ALL]:
        df = df.withColumn(ALL, F.lit(0))
    return (df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
            .groupBy(*ks, F.col(score).cast("double").alias("score"))
            .agg(F.sum(F.when(is_pos, w).otherwise(0)).cast("long").alias("pos"),
                 F.sum(F.when(is_pos, 0).otherwise(w)).cast("long").alias("neg")))


def range_buckets(df: DataFrame, keys: list[str], order_cols: list[str], buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """``df`` with ``__b``, its range partition by (keys, order columns): the
    order of ``__b`` follows the order of the columns inside each key, equal
    values share a bucket, and buckets are cut at sampled quantiles.  There
    are as many as shuffle partitions, ``buckets`` at most.  Written once, as
    sampling again could cut elsewhere."""
    from riskframe.session import cut_lineage
    n = max(1, min(buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return cut_lineage(df.repartitionByRange(n, *keys, *order_cols).withColumn("__b", F.spark_partition_id()))


def prefix_before(g: DataFrame, keys, order_col: str, value_cols, buckets: int = DEFAULT_BUCKETS,
                  ) -> DataFrame:
    """For each value column ``v`` adds ``v_lt``: the sum of ``v`` over rows of
    the same key with a strictly smaller ``order_col`` (``order_col`` must be
    unique per key).  Also adds per-key totals ``v_total``."""
    from riskframe.session import cut_lineage
    ks = _keys(keys)
    vals = list(value_cols)
    g = cut_lineage(g)
    if g.count() <= WINDOW_ROWS:
        before = Window.partitionBy(*ks).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
        # written, as the table is read by several branches: each would sort
        # again, and a union of branches partitioned alike must find as many
        # partitions on both sides
        return cut_lineage(g.select("*", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_lt") for v in vals],
                                    *[F.sum(v).over(Window.partitionBy(*ks)).alias(f"{v}_total") for v in vals]))
    gb = range_buckets(g, ks, [order_col], buckets)
    bt = gb.groupBy(*ks, "__b").agg(*[F.sum(v).alias(f"__bt_{v}") for v in vals])
    w_off = Window.partitionBy(*ks).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*ks)
    bt = bt.select(*ks, "__b", *[F.coalesce(F.sum(f"__bt_{v}").over(w_off), F.lit(0)).alias(f"__off_{v}") for v in vals],
                   *[F.sum(f"__bt_{v}").over(w_all).alias(f"{v}_total") for v in vals])
    w_in = Window.partitionBy(*ks, "__b").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    # without keys ``bt`` has one row per partition: a bounded side
    out = gb.join(F.broadcast(bt) if ks == [ALL] else bt, ks + ["__b"], "inner")
    for v in vals:
        out = out.withColumn(f"{v}_lt", F.col(f"__off_{v}") + F.coalesce(F.sum(v).over(w_in), F.lit(0)))
    return out.drop("__b", *[f"__off_{v}" for v in vals])


def score_table(df: DataFrame, score: str, label: str, keys=None, weight: str | None = None,
                buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """``(keys, score, pos, neg, pos_lt, neg_lt, P, N)``.  The score groups
    are read by several branches of the prefix sum, which writes them once."""
    g = score_groups(df, score, label, keys, weight)
    t = prefix_before(g, keys, "score", ["pos", "neg"], buckets)
    return t.withColumnRenamed("pos_total", "P").withColumnRenamed("neg_total", "N")


def auc(table: DataFrame, keys=None) -> DataFrame:
    """Mann-Whitney AUC with average ranks for ties; NaN when one class
    is absent.  ``sum(pos * (2*neg_lt + neg))`` is an exact integer, so the
    result does not depend on summation order."""
    ks = _keys(keys)
    agg = table.groupBy(*ks).agg(
        F.sum(F.col("pos") * (2 * F.col("neg_lt") + F.col("neg"))).alias("__num2"),
        F.first("P").alias("P"), F.first("N").alias("N"))
    a = F.when((F.col("P") > 0) & (F.col("N") > 0),
               F.col("__num2") / (2.0 * F.col("P") * F.col("N"))).otherwise(F.lit(float("nan")))
    return _done(agg.select(*ks, a.alias("auc"), F.col("P").alias("n_pos"), F.col("N").alias("n_neg")))


def roc_points(table: DataFrame, keys=None, include_origin: bool = True) -> DataFrame:
    """One point per distinct score: predicting ``score >= thr`` gives
    ``(fpr, tpr)``.  Starts with ``(0, 0, +inf)``.  Keys with one class only
    produce no points."""
    ks = _keys(keys)
    t = table.where((F.col("P") > 0) & (F.col("N") > 0))
    pts = t.select(*ks, F.col("score").alias("threshold"),
                   ((F.col("N") - F.col("neg_lt")) / F.col("N")).alias("fpr"),
                   ((F.col("P") - F.col("pos_lt")) / F.col("P")).alias("tpr"))
    if include_origin:
        origin = t.select(*ks).distinct().select(
            *ks, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
        pts = pts.unionByName(origin)
    return _done(pts)


def pr_points(table: DataFrame, keys=None) -> DataFrame:
    """E5: precision/recall per distinct threshold (``score >= thr``)."""
    ks = _keys(keys)
    tp = F.col("P") - F.col("pos_lt")
    fp = F.col("N") - F.col("neg_lt")
    return _done(table.where(F.col("P") > 0).select(
        *ks, F.col("score").alias("threshold"),
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0)).alias("precision"),
        (tp / F.col("P")).alias("recall")))


def recall_at_fpr(table: DataFrame, budget: float = 0.05, keys=None) -> DataFrame:
    """E3 + E4 (ROC rule): best recall with ``fpr <= budget`` and its
    threshold (largest threshold among equal recalls; +inf when only the
    origin qualifies)."""
    ks = _keys(keys)
    t = table.where((F.col("P") > 0) & (F.col("N") > 0))
    fpr = (F.col("N") - F.col("neg_lt")) / F.col("N")
    tpr = (F.col("P") - F.col("pos_lt")) / F.col("P")
    pts = t.select(*ks, fpr.alias("fpr"), tpr.alias("tpr"), F.col("score").alias("threshold"))
    origin = t.select(*ks).distinct().select(*ks, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
                                             F.lit(float("inf")).alias("threshold"))
    best = pts.where(F.col("fpr") <= budget).unionByName(origin) \
        .groupBy(*ks).agg(F.max(F.struct("tpr", "threshold")).alias("b"))
    return _done(best.select(*ks, F.col("b.tpr").alias("recall"),
                             F.col("b.threshold").alias("threshold")))


def threshold_at_fpr_rank(table: DataFrame, budget: float = 0.05, keys=None) -> DataFrame:
    """E4 (rank rule): negatives sorted descending, ``k = int(n*budget)``,
    threshold = ``neg_desc[k]`` (last one when k is out of range, +inf when
    there are no negatives).  The score group holding rank k is found by a
    row-local test inside one aggregate — no sort, no join."""
    ks = _keys(keys)
    n = F.col("N")
    k = F.floor(n * F.lit(budget)).cast("long")
    k = F.when(k < n, k).otherwise(n - 1)
    gt = n - F.col("neg_lt") - F.col("neg")        # negatives strictly above this score
    hit = (F.col("neg") > 0) & (gt <= k) & (k < gt + F.col("neg"))
    out = table.groupBy(*ks).agg(F.max("N").alias("__n"), F.max(F.when(hit, F.col("score"))).alias("__t"))
    return _done(out.select(*ks, F.when(F.col("__n") == 0, F.lit(float("inf")))
                            .otherwise(F.col("__t")).alias("threshold")))


def roc_trapezoid(table: DataFrame, keys=None) -> DataFrame:
    """Trapezoid area under the per-distinct-score ROC curve.  The
    previous point of a score group is the point of the next higher score,
    i.e. ``(fpr - neg/N, tpr - pos/P)``, so every segment is row-local and
    no ordering window is needed."""
    ks = _keys(keys)
    t = table.where((F.col("P") > 0) & (F.col("N") > 0))
    fpr = (F.col("N") - F.col("neg_lt")) / F.col("N")
    tpr = (F.col("P") - F.col("pos_lt")) / F.col("P")
    prev_tpr = tpr - F.col("pos") / F.col("P")
    seg = (F.col("neg") / F.col("N")) * (tpr + prev_tpr) / 2.0
    return _done(t.groupBy(*ks).agg(F.sum(seg).alias("area")))


def last_before(df: DataFrame, keys, time_col: str, tie_cols: list[str], value: Column, out: str,
                inclusive: bool = True, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Adds ``out``: the last non-null ``value`` of the same key at or before
    each row (strictly before when ``inclusive`` is false) in
    ``(time_col, *tie_cols)`` order — a running "last value" without a
    window over a whole key.

    Rows are range-partitioned by (key, time) at sampled quantiles (rows with
    equal times share a bucket).  Inside a (key, bucket) a window gives the
    running last value; the last value of every earlier bucket comes from
    one summary row per (key, bucket) and a running last over them."""
    ks = _keys(keys)
    x = df.withColumn("__v", value)
    if ks == [ALL]:
        x = x.withColumn(ALL, F.lit(0))
    order = [time_col, *tie_cols]
    frame = (Window.unboundedPreceding, 0) if inclusive else (Window.unboundedPreceding, -1)
    if x.count() <= WINDOW_ROWS:
        whole = Window.partitionBy(*ks).orderBy(*order).rowsBetween(*frame)
        return _done(x.withColumn(out, F.last("__v", ignorenulls=True).over(whole)).drop("__v"))
    x = range_buckets(x, ks, [time_col], buckets).withColumnRenamed("__b", "__lb")
    inside = Window.partitionBy(*ks, "__lb").orderBy(*order).rowsBetween(*frame)
    x = x.withColumn("__in", F.last("__v", ignorenulls=True).over(inside))
    summ = x.where(F.col("__v").isNotNull()).groupBy(*ks, "__lb").agg(
        F.max_by("__v", F.struct(*order)).alias("__bl"))
    # every bucket of a key (at most `buckets` rows) takes the last value of
    # the buckets before it
    carry = Window.partitionBy(*ks).orderBy("__lb").rowsBetween(Window.unboundedPreceding, -1)
    allb = x.select(*ks, "__lb").distinct().join(summ, ks + ["__lb"], "left")
    allb = allb.select(*ks, "__lb", F.last("__bl", ignorenulls=True).over(carry).alias("__carry2"))
    x = x.join(allb, ks + ["__lb"], "left")
    res = x.withColumn(out, F.coalesce(F.col("__in"), F.col("__carry2")))
    return _done(res.drop("__v", "__lb", "__in", "__carry2"))
