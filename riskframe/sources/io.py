"""Readers and writers around the engine.

Everything is a Spark reader/writer with a declared schema; malformed input
is dropped or rejected per row, never fatal for its siblings.  Sinks are
partitioned so later reads prune by partition (detector, date, tenant).
"""
from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe import config as C

SCORE_SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType())])

AUDIT_COLUMNS = ["timestamp", "request_id", "tenant", "capability", "risk", "decision", "prompt_hash",
                 "semantic_score", "source", "educational_context", "domain_score", "symbolic_triggered",
                 "judge_invoked", "dynamic_threat_score"]

CACHE_SCHEMA = T.StructType([
    T.StructField("prompt_hash", T.StringType()), T.StructField("risk", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("timestamp_epoch", T.DoubleType()),
    T.StructField("source", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType()))])


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any Hadoop file system exists; errors other than
    its absence are raised, so a failed read never passes for an empty one."""
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any Hadoop file system (none if it is missing)."""
    fs, p = _file_system(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def read_small(spark: SparkSession, path: str) -> str:
    """A small UTF-8 file (a manifest, a commit) of any Hadoop file system."""
    fs, p = _file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small UTF-8 file, replacing an old one."""
    fs, p = _file_system(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def input_fingerprint(spark: SparkSession, df: DataFrame, *params) -> str:
    """Digest of the files a table is read from (path, size, time of change)
    and of the parameters of what is made from it."""
    h = hashlib.sha256()
    for path in sorted(df.inputFiles()):
        fs, p = _file_system(spark, path)
        st = fs.getFileStatus(p)
        h.update(f"{path}|{st.getLen()}|{st.getModificationTime()}\n".encode())
    h.update(repr(params).encode())
    return h.hexdigest()[:32]


def stored(spark: SparkSession, name: str, fingerprint: str, build: Callable[[], DataFrame]) -> DataFrame:
    """K5: the table ``build`` makes, written once under its fingerprint in
    the shared folder and read back by all later callers.  It is written
    aside and renamed, so a reader never meets half of it; of two writers at
    the same time one stays."""
    from riskframe.session import checkpoint_dir
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{fingerprint}"
    if not path_exists(spark, path):
        aside = f"{base}/_{name}-{uuid.uuid4().hex}"
        build().write.parquet(aside)
        fs, p = _file_system(spark, path)
        if not fs.exists(p):
            fs.rename(_file_system(spark, aside)[1], p)
    return spark.read.parquet(path)


# --- S5 tolerant JSONL -------------------------------------------------------------

def read_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType = SCORE_SCHEMA) -> DataFrame:
    """Blank or half-written lines (e.g. the last line of a killed writer)
    are dropped; the row is simply redone by the next incremental run."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path) \
        .where(F.col(schema.fields[0].name).isNotNull())


# --- S4 score store ----------------------------------------------------------------

def append_scores(scores: DataFrame, path: str) -> None:
    """Append ``(detector, id, score)`` rows partitioned by detector."""
    scores.write.mode("append").partitionBy("detector").parquet(path)


def read_scores(spark: SparkSession, path: str, detectors: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("detector").isin(*detectors)) if detectors else df   # partition pruning


def store_complete(store: DataFrame, suite: DataFrame, id_col: str, detector: str) -> bool:
    """All-or-rescore test: no suite row lacks a score (left anti is empty)."""
    done = store.where(F.col("detector") == detector).select(F.col("id").alias(id_col))
    return suite.join(done, id_col, "left_anti").limit(1).count() == 0


# --- S6 anchors / S14 text lists ----------------------------------------------------

def read_anchor_pack(spark: SparkSession, path: str) -> DataFrame:
    """``(set, class, anchor_id, text)`` from a policy JSON holding
    ``safe_anchors`` and ``threat_anchor_classes`` (class -> list), or the
    legacy flat ``threat_anchors`` list (class 'unclassified').  A missing
    file gives an empty pack."""
    schema = "set string, class string, anchor_id int, text string"
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    raw = spark.read.option("multiLine", True).json(path)
    parts = []
    cols = set(raw.columns)
    if "safe_anchors" in cols:
        parts.append(raw.select(F.posexplode("safe_anchors").alias("anchor_id", "text"))
                     .select(F.lit("safe").alias("set"), F.lit("safe").alias("class"), "anchor_id", "text"))
    if "threat_anchor_classes" in cols:
        m = raw.select(F.from_json(F.to_json("threat_anchor_classes"), "map<string, array<string>>").alias("m"))
        parts.append(m.select(F.explode("m").alias("class", "xs"))
                     .select(F.lit("threat").alias("set"), "class", F.posexplode("xs").alias("anchor_id", "text")))
    elif "threat_anchors" in cols:
        parts.append(raw.select(F.posexplode("threat_anchors").alias("anchor_id", "text"))
                     .select(F.lit("threat").alias("set"), F.lit("unclassified").alias("class"), "anchor_id", "text"))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("set", "class", F.col("anchor_id").cast("int"), "text")


def read_text_list(spark: SparkSession, path: str, set_name: str) -> DataFrame:
    """One anchor per non-blank line."""
    return spark.read.text(path).select(F.lit(set_name).alias("set"), F.trim("value").alias("text")) \
        .where(F.length("text") > 0)


# --- S8 per-entry validated config --------------------------------------------------

def read_keyed_config(spark: SparkSession, path: str, entry_schema: str) -> DataFrame:
    """Reads a JSON object ``{key: {...}}`` into ``(key, entry struct)``
    rows; an entry that does not parse into ``entry_schema`` yields a null
    struct (reject it with a predicate) without affecting its siblings.  A
    missing file gives no rows; any other read error is raised."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"key string, entry struct<{_struct_body(entry_schema)}>")
    txt = spark.read.option("wholetext", True).text(path)
    m = txt.select(F.from_json("value", "map<string, string>").alias("m"))
    return m.select(F.explode("m").alias("key", "raw")).select(
        "key", F.from_json("raw", entry_schema).alias("entry"), "raw")


def _struct_body(schema: str) -> str:
    return ", ".join(f"{p.split()[0]}: {p.split()[1]}" for p in schema.split(","))


def tenants_from_config(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Tenant configs with validity rules: status active/suspended, rate
    limit absent or positive.  Returns (valid, rejected-with-reason)."""
    cfg = read_keyed_config(spark, path, "display_name string, status string, rate_limit_rpm double")
    e = F.col("entry")
    reason = (F.when(e.isNull(), "unparsable entry")
              .when(~e["status"].isin("active", "suspended"), "invalid status")
              .when(e["rate_limit_rpm"].isNotNull() & (e["rate_limit_rpm"] <= 0), "invalid rate limit"))
    x = cfg.withColumn("reject_reason", reason)
    valid = x.where(F.col("reject_reason").isNull()).select(
        F.col("key").alias("tenant_id"), "entry.display_name", "entry.status", "entry.rate_limit_rpm")
    return valid, x.where(F.col("reject_reason").isNotNull()).select("key", "reject_reason")


# --- S9 audit sink -------------------------------------------------------------------

def audit_rows(verdicts: DataFrame, prompt_col: str = "prompt") -> DataFrame:
    """Audit projection: the raw prompt is replaced by its SHA-256 and never
    written (rows without a prompt bring the hash as ``prompt_hash``);
    missing fields take the documented defaults."""
    d = {c: F.col(c) if c in verdicts.columns else None for c in AUDIT_COLUMNS}
    defaults = {"request_id": F.lit("unset"), "tenant": F.lit("unset"), "semantic_score": F.lit(0.0),
                "source": F.lit("unknown"), "educational_context": F.lit(False),
                "symbolic_triggered": F.lit(False), "judge_invoked": F.lit(False)}
    cols = []
    for c in AUDIT_COLUMNS:
        if c == "prompt_hash" and prompt_col in verdicts.columns:
            cols.append(F.sha2(F.col(prompt_col), 256).alias(c))
        elif c == "timestamp":
            cols.append((d[c] if d[c] is not None else F.current_timestamp()).alias(c))
        elif d[c] is not None:
            cols.append(F.coalesce(d[c], defaults[c]).alias(c) if c in defaults else d[c].alias(c))
        else:
            cols.append((defaults.get(c, F.lit(None))).alias(c))
    out = verdicts.select(*cols)
    return out.withColumn("dynamic_threat_score", F.col("dynamic_threat_score").cast("double")) \
        .withColumn("domain_score", F.col("domain_score").cast("double"))


def write_audit(audit: DataFrame, path: str) -> None:
    audit.withColumn("date", F.to_date("timestamp")).write.mode("append") \
        .partitionBy("date", "tenant").parquet(path)


# --- S10 verdict-cache snapshot -----------------------------------------------------

def load_cache(spark: SparkSession, path: str, now_epoch: float, ttl: float = C.CACHE_TTL_SECONDS) -> DataFrame:
    """Entries still alive at ``now_epoch`` (``now - written < ttl``)."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    df = spark.read.schema(CACHE_SCHEMA).parquet(path)
    return df.where(F.lit(float(now_epoch)) - F.col("timestamp_epoch") < ttl)


def save_cache(cache: DataFrame, path: str) -> None:
    cache.write.mode("overwrite").parquet(path)


# --- S3 / S11 / S12 reports and artifacts --------------------------------------------

def write_rows_and_summary(rows: DataFrame, summary: DataFrame, out_dir: str, fmt: str = "json") -> None:
    """Row-level output (JSON lines or CSV with header) plus a
    one-row summary next to it."""
    if fmt == "csv":
        rows.write.mode("overwrite").option("header", True).csv(f"{out_dir}/rows")
    else:
        rows.write.mode("overwrite").json(f"{out_dir}/rows")
    summary.coalesce(1).write.mode("overwrite").json(f"{out_dir}/summary")


def write_policy_artifact(policy: dict, path: str) -> None:
    """The fusion artifact is a small JSON document built on the driver
    from the fitted coefficients (a handful of numbers)."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(policy, f, indent=2, sort_keys=True)


def fixture_checks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Load-time expectations of a fixture table in one aggregate —
    row count, ids sequential from 1, prompt text unique."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("min_id"), F.max(id_col).alias("max_id"),
                  F.countDistinct(id_col).alias("distinct_ids"), F.countDistinct(text_col).alias("distinct_text")) \
        .withColumn("ids_sequential", (F.col("min_id") == 1) & (F.col("max_id") == F.col("n"))
                    & (F.col("distinct_ids") == F.col("n"))) \
        .withColumn("text_unique", F.col("distinct_text") == F.col("n"))
