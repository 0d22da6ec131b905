"""Streaming sources, windowed metrics, late-row routing and the
escalate-only verdict upsert (T5, T9 and the watermark plumbing)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.sources.io import child_names, path_exists

def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """File-source stream with a declared schema (streams never infer)."""
    return (spark.readStream.format("parquet").schema(schema)
            .option("maxFilesPerTrigger", files_per_trigger).load(path))


def dedup_requests(df: DataFrame, ts: str, id_col: str, delay: str = "10 minutes") -> DataFrame:
    """Drops replayed request ids; state is kept only within the watermark."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_col])


def stream_rates(df: DataFrame, ts: str, keys: list[str], delay: str = "10 minutes", window: str = "5 minutes",
                 slide: str = "1 minute", seconds: int = 300) -> DataFrame:
    """T5 on a stream: count/seconds per sliding window, emitted in append
    mode once the watermark closes the window."""
    g = (df.withWatermark(ts, delay).groupBy(F.window(ts, window, slide).alias("w"), *keys)
         .agg(F.count(F.lit(1)).alias("n")))
    return g.select(F.col("w.start").alias("window_start"), *keys, "n", (F.col("n") / float(seconds)).alias("rate"))


class LateRowRouter:
    """``foreachBatch`` writer splitting each micro-batch at the watermark the
    engine would apply to it (max event time of earlier batches minus the
    delay): on-time rows go to ``on_time_path``, older rows to
    ``late_path``.  Each epoch owns one folder in the three places and
    overwrites it, so a replayed epoch recomputes the same split and leaves
    the same rows."""

    def __init__(self, ts: str, delay_seconds: float, on_time_path: str, late_path: str, state_path: str):
        self.ts, self.delay = ts, float(delay_seconds)
        self.on_time, self.late, self.state = on_time_path, late_path, state_path

    def _prior_max(self, spark: SparkSession, epoch: int):
        if not path_exists(spark, self.state):
            return None
        st = spark.read.schema("max_ts timestamp, epoch long").parquet(self.state).where(F.col("epoch") < epoch)
        return st.agg(F.max("max_ts")).first()[0]

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        prior = self._prior_max(spark, epoch)
        if prior is None:
            late_cond = F.lit(False)
        else:
            wm = F.lit(prior).cast("timestamp") - F.make_dt_interval(secs=F.lit(self.delay))
            late_cond = F.coalesce(F.col(self.ts).cast("timestamp") < wm, F.lit(False))
        tagged = batch.withColumn("__late", late_cond)
        for path, rows in ((self.on_time, ~F.col("__late")), (self.late, F.col("__late"))):
            tagged.where(rows).drop("__late").write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch}")
        batch.agg(F.max(F.col(self.ts).cast("timestamp")).alias("max_ts")).write.mode("overwrite").parquet(
            f"{self.state.rstrip('/')}/epoch={epoch}")


# fixed values: what an escalation writes
ESCALATION_SCORE = 1.0
ESCALATION_SOURCE = "llama_guard_async_escalation"


def escalate_verdicts(current: DataFrame, updates: DataFrame, key: str = "prompt_hash",
                      risk: str = "risk", source: str = "source", score: str = "score") -> DataFrame:
    """Keyed merge in which only a HIGH update changes a stored
    verdict that is not HIGH, writing the escalation's score and source; all
    other stored verdicts stay.  A key without a stored verdict takes its
    most severe update (of equals the smallest row).  Both sides are grouped
    by key with a map-side partial."""
    cols = [c for c in current.columns if c != key]
    sev = lambda r: F.when(r == "HIGH", 2).when(r == "MEDIUM", 1).otherwise(0)
    rank = F.struct((-sev(F.col(risk))).alias("s"), F.struct(*cols).alias("v"))
    both = (current.withColumn("__stored", F.lit(True))
            .unionByName(updates.withColumn("__stored", F.lit(False)), allowMissingColumns=True))
    g = both.groupBy(key).agg(F.min(F.when(F.col("__stored"), rank)).alias("old"), F.min(F.when(~F.col("__stored"), rank)).alias("new"))
    raised = (F.col("old.s") != -2) & F.coalesce(F.col("new.s") == -2, F.lit(False))
    fixed = {risk: F.lit("HIGH"), source: F.lit(ESCALATION_SOURCE), score: F.lit(ESCALATION_SCORE)}
    kept = F.coalesce("old.v", "new.v")
    return g.select(key, *[F.when(raised, fixed[c].cast(current.schema[c].dataType) if c in fixed else kept[c]).otherwise(kept[c]).alias(c)
                           for c in cols])


def upsert_writer(table_path: str, key: str = "prompt_hash"):
    """``foreachBatch`` function applying :func:`escalate_verdicts` to a
    Parquet table on any Hadoop file system; each epoch writes a new version
    folder from the version before it, so a replayed epoch overwrites its
    own output only.  The first epoch merges its own duplicate keys."""
    base = table_path.rstrip("/")

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        # a version counts once its write has been committed
        prev = [v for v in sorted(int(d[2:]) for d in child_names(spark, base) if d.startswith("v=") and d[2:].isdigit())
                if v < epoch and path_exists(spark, f"{base}/v={v}/_SUCCESS")]
        cur = spark.read.parquet(f"{base}/v={prev[-1]}") if prev else batch.limit(0)
        merged = escalate_verdicts(cur, batch.select(*cur.columns), key)
        merged.write.mode("overwrite").parquet(f"{base}/v={epoch}")
    return write


def cache_index(cache: DataFrame):
    """A cache snapshot as a :class:`~riskframe.operators.similar.SphereIndex`
    with its entries: ``(index, entries)``.  Entry ids are a hash of the
    prompt hash, whatever the layout of the snapshot."""
    from riskframe.operators import similar
    c = cache.select(F.xxhash64("prompt_hash").alias("nn_id"), "prompt_hash", "vector", "risk", "score", "timestamp_epoch")
    return similar.sphere_index(similar.unit_rows(c, "nn_id", "vector")), c.drop("vector")


def fuzzy_reuse(requests: DataFrame, cache: DataFrame, threshold: float = 0.99,
                ttl_seconds: float = 24 * 3600.0, id_col: str = "request_id", vec: str = "vector",
                ts: str = "ts", indexed=None) -> DataFrame:
    """The nearest cached vector (exact search by pivot cells and
    rings) is reused when its cosine is strictly above ``threshold`` *and*
    that entry is still within its TTL; otherwise the request is a miss (an
    expired best match is not replaced by a worse live one) and ``sim`` is
    null if no entry is that similar.  ``cache`` holds ``prompt_hash, vector,
    risk, score, timestamp_epoch``; ``indexed`` is its :func:`cache_index`,
    where one is at hand."""
    from riskframe.operators import similar
    index, c = indexed or cache_index(cache)
    q = requests.select(F.col(id_col).cast("long").alias("__qid"), F.col(vec).alias("__v"), F.col(ts).alias("__ts"))
    nn = similar.nearest_within(index, similar.unit_rows(q, "__qid", "__v"), threshold, strict=True)
    j = nn.withColumnRenamed("id", "__qid").join(q.select("__qid", "__ts"), "__qid").join(c, "nn_id")
    hit = (F.unix_micros(F.col("__ts").cast("timestamp")) / 1e6 - F.col("timestamp_epoch")) < ttl_seconds
    res = j.select(F.col("__qid").alias(id_col), hit.alias("hit"), F.when(hit, F.col("risk")).alias("cached_risk"),
                   F.when(hit, F.col("prompt_hash")).alias("cached_hash"), F.col("sim"))
    return requests.select(F.col(id_col).cast("long").alias(id_col)).join(res, id_col, "left") \
        .fillna(False, subset=["hit"])


def fuzzy_reuse_writer(cache_path: str, out_path: str, threshold: float = 0.99, ttl_seconds: float = 24 * 3600.0,
                       id_col: str = "request_id", vec: str = "vector", ts: str = "ts"):
    """``foreachBatch`` function: each micro-batch is matched against the
    current cache snapshot and written under its epoch (replays overwrite
    their own epoch only).  A snapshot is indexed once, when it is first
    seen."""
    held: dict = {}

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        from riskframe.sources.io import CACHE_SCHEMA, input_fingerprint
        # without a snapshot every request misses
        cache = (spark.read.schema(CACHE_SCHEMA).parquet(cache_path) if path_exists(spark, cache_path)
                 else spark.createDataFrame([], CACHE_SCHEMA))
        key = input_fingerprint(spark, cache)
        if key not in held:
            held.clear()
            held[key] = cache_index(cache)
        out = fuzzy_reuse(batch, cache, threshold, ttl_seconds, id_col, vec, ts, held[key])
        out.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/epoch={epoch}")
    return write
