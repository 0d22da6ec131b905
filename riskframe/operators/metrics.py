"""Operational metrics: bounded-label counters, exact index-rule
percentiles, cumulative latency histograms with interpolated quantiles,
sliding-window rates and concurrency peaks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe import config as C
from riskframe.operators import roc


def safe_source(c) -> Column:
    """Known verdict sources pass, anything else becomes 'other'."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin(*C.KNOWN_SOURCES), c).otherwise(F.lit("other"))


def unknown_sources(df: DataFrame, source: str = "source") -> DataFrame:
    """Count of unknown sources by value truncated to 40 chars."""
    s = F.col(source)
    return df.where(~s.isin(*C.KNOWN_SOURCES) | s.isNull()) \
        .groupBy(F.substring(F.coalesce(s.cast("string"), F.lit("None")), 1, C.UNKNOWN_SOURCE_TRUNCATE)
                 .alias("source")).agg(F.count(F.lit(1)).alias("n"))


def value_at_ranks(df: DataFrame, keys: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """Exact order statistics without sorting a key's rows in one task.

    ``ranks`` holds ``(keys, rank_name, r)`` with 0-based ranks.  Values are
    collapsed to ``(keys, value) -> count`` (ties merge), the running count
    comes from the bucketed prefix sum, and each rank picks the value group
    with ``c_lt <= r < c_lt + c``."""
    from riskframe.session import cut_lineage
    g = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v"))
                    .agg(F.count(F.lit(1)).alias("__c")))
    t = roc.prefix_before(g, keys, "__v", ["__c"])
    j = t.join(ranks, keys).where((F.col("__c_lt") <= F.col("r")) & (F.col("r") < F.col("__c_lt") + F.col("__c")))
    return j.select(*keys, "rank_name", F.col("__v").alias("value"))


def latency_summary(df: DataFrame, keys: list[str], value: str, quantiles=(0.5, 0.95, 0.99),
                    method: str = "index") -> DataFrame:
    """N, avg, min, max and percentiles per key.

    ``method='index'``: ``sorted[min(int(n*p), n-1)]``;
    ``method='minus_one'``: ``sorted[int(n*p)-1]`` when n >= 20 else the last
    value; ``method='exclusive'``: the exclusive-method 100-quantiles
    (``m = n+1``, ``j = clamp(i*m//100, 1, n-1)``, interpolated between
    ``sorted[j-1]`` and ``sorted[j]`` with weight ``(i*m - j*100)/100``;
    needs n >= 2)."""
    if method == "exclusive":
        return _exclusive_summary(df, keys, value, quantiles)
    base = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("avg"),
                                 F.min(value).alias("min"), F.max(value).alias("max"))
    rk = []
    for q in quantiles:
        name = f"p{int(round(q * 100))}"
        raw = F.floor(F.col("n") * F.lit(q)).cast("long")
        if method == "index":
            r = F.least(raw, F.col("n") - 1)
        elif method == "minus_one":
            r = F.when(F.col("n") >= 20, raw - 1).otherwise(F.col("n") - 1)
        else:
            raise ValueError(method)
        rk.append(base.select(*keys, F.lit(name).alias("rank_name"), r.alias("r")))
    ranks = rk[0]
    for x in rk[1:]:
        ranks = ranks.unionByName(x)
    picked = value_at_ranks(df, keys, value, ranks.where(F.col("r") >= 0))
    wide = picked.groupBy(*keys).pivot("rank_name", [f"p{int(round(q * 100))}" for q in quantiles]) \
        .agg(F.first("value"))
    return base.join(wide, keys, "left")


def _exclusive_summary(df: DataFrame, keys: list[str], value: str, quantiles) -> DataFrame:
    base = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("avg"),
                                 F.min(value).alias("min"), F.max(value).alias("max"))
    rk, names = [], []
    for q in quantiles:
        i = int(round(q * 100))
        name = f"p{i}"
        m = F.col("n") + 1
        j = F.least(F.greatest(F.floor(F.lit(i) * m / 100).cast("long"), F.lit(1)), F.col("n") - 1)
        names += [f"{name}_a", f"{name}_b"]
        rk.append(base.select(*keys, F.lit(f"{name}_a").alias("rank_name"), (j - 1).alias("r")))
        rk.append(base.select(*keys, F.lit(f"{name}_b").alias("rank_name"), j.alias("r")))
    ranks = rk[0]
    for x in rk[1:]:
        ranks = ranks.unionByName(x)
    picked = value_at_ranks(df, keys, value, ranks.where(F.col("r") >= 0))
    wide = picked.groupBy(*keys).pivot("rank_name", names).agg(F.first("value"))
    out = base.join(wide, keys, "left")
    cols = []
    for q in quantiles:
        i = int(round(q * 100))
        m = F.col("n") + 1
        j = F.least(F.greatest(F.floor(F.lit(i) * m / 100).cast("long"), F.lit(1)), F.col("n") - 1)
        delta = F.lit(i) * m - j * 100
        cols.append(((F.col(f"p{i}_a") * (100 - delta) + F.col(f"p{i}_b") * delta) / 100.0).alias(f"p{i}"))
    return out.select(*keys, "n", "avg", "min", "max", *cols)


def stage_histogram(df: DataFrame, stage: str, ms: str, buckets=None) -> DataFrame:
    """Cumulative histogram of stage latency in seconds (``ms/1000``),
    missing or negative observations skipped; ``le`` over the bounds plus
    +Inf.  Counts per (stage, bucket) are aggregated first; the cumulative
    sum runs over at most len(bounds)+1 rows per stage."""
    bounds = list(buckets or C.LATENCY_BUCKETS)
    arr = F.array(*[F.lit(float(b)) for b in bounds])
    secs = F.col(ms) / 1000.0
    idx = F.size(F.filter(arr, lambda b: b < secs))     # first bound >= secs
    obs = df.where(F.col(ms).isNotNull() & (F.col(ms) >= 0)).select(F.col(stage).alias("stage"), idx.alias("bi"))
    counts = obs.groupBy("stage", "bi").agg(F.count(F.lit(1)).alias("c"))
    stages = counts.select("stage").distinct()
    grid = stages.withColumn("bi", F.explode(F.sequence(F.lit(0), F.lit(len(bounds)))))
    full = grid.join(counts, ["stage", "bi"], "left").fillna(0, subset=["c"])
    w = Window.partitionBy("stage").orderBy("bi").rowsBetween(Window.unboundedPreceding, 0)
    le = F.when(F.col("bi") < len(bounds), F.element_at(arr, F.col("bi") + 1)).otherwise(F.lit(float("inf")))
    return full.select("stage", "bi", le.alias("le"), F.sum("c").over(w).alias("cum_count"))


def histogram_quantile(hist: DataFrame, q: float, name: str) -> DataFrame:
    """Quantile interpolated linearly inside the bucket where the
    cumulative count first reaches ``q*total`` (lower edge 0 for the first
    bucket; a quantile landing in +Inf returns the last finite bound)."""
    w = Window.partitionBy("stage").orderBy("bi")
    h = hist.withColumn("prev_cum", F.coalesce(F.lag("cum_count").over(w), F.lit(0))) \
        .withColumn("prev_le", F.coalesce(F.lag("le").over(w), F.lit(0.0)))
    tot = h.groupBy("stage").agg(F.max("cum_count").alias("total"))
    h = h.join(tot, "stage").withColumn("rank", F.lit(q) * F.col("total"))
    hit = h.where((F.col("total") > 0) & (F.col("cum_count") >= F.col("rank")))
    first = hit.groupBy("stage").agg(F.min_by(F.struct("le", "prev_le", "cum_count", "prev_cum", "rank"),
                                              F.col("bi")).alias("b"))
    b = F.col("b")
    inb = b["cum_count"] - b["prev_cum"]
    val = F.when(b["le"] == float("inf"), b["prev_le"]).when(inb <= 0, b["le"]).otherwise(
        b["prev_le"] + (b["le"] - b["prev_le"]) * (b["rank"] - b["prev_cum"]) / inb)
    return first.select("stage", val.alias(name))


def sliding_rate(df: DataFrame, ts: str, keys: list[str], window: str = "5 minutes", slide: str = "1 minute",
                 seconds: int = 300) -> DataFrame:
    """T5: events per second over sliding windows (``count/seconds``)."""
    g = df.groupBy(F.window(ts, window, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), *keys, "n", (F.col("n") / float(seconds)).alias("rate"))


def concurrency_peaks(df: DataFrame, start: str, duration_s: str, bucket: str = "1 hour") -> DataFrame:
    """Peak number of in-flight requests per time bucket.

    Each request adds +1 at its start and -1 at its end (ends sort before
    starts at equal times).  Deltas at the same (time, sign) are summed
    first: within such a group the level moves monotonically, so the peak is
    reached at a group boundary.  The level entering each bucket and the
    running level inside it are bucketed prefix sums — no window over a
    whole bucket or over all time."""
    st = F.col(start).cast("timestamp")
    end = st + F.make_dt_interval(secs=F.col(duration_s).cast("decimal(18,6)"))
    d = df.select(F.explode(F.array(
        F.struct(st.alias("t"), F.lit(1).alias("d")), F.struct(end.alias("t"), F.lit(-1).alias("d")))).alias("e"))
    d = d.select("e.t", "e.d").withColumn("b", F.date_trunc(bucket.split()[-1], "t"))
    per_b = d.groupBy("b").agg(F.sum("d").alias("net"), F.count_if(F.col("d") == 1).alias("n_starts"))
    per_b = roc.prefix_before(per_b.withColumn("__all", F.lit(0)).withColumn("__bt", F.unix_micros("b")),
                              ["__all"], "__bt", ["net"]).select("b", "n_starts", F.col("net_lt").alias("level_in"))
    g = d.groupBy("b", "t", "d").agg(F.sum("d").alias("gnet")) \
        .withColumn("__o", F.unix_micros("t") * 2 + (F.col("d") == 1).cast("long"))
    inside = roc.prefix_before(g, ["b"], "__o", ["gnet"]).groupBy("b").agg(
        F.max(F.col("gnet_lt") + F.col("gnet")).alias("max_run"))
    out = per_b.join(inside, "b")
    return out.select(F.col("b").alias("bucket_start"), "n_starts",
                      F.greatest(F.col("level_in"), F.col("level_in") + F.col("max_run")).alias("peak"))
