"""Readers for the input tables with declared schemas (no inference)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMAS = {
    "documents": T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType())]),
    "labels": T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
        T.StructField("toxic", T.IntegerType())]),
    "conversations": T.StructType([
        T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]),
    "benchmark": T.StructType([
        T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())]),
    "pages": T.StructType([
        T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType())]),
    "embeddings": T.StructType([
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.LongType())]),
    "events": T.StructType([
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
        T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())]),
    "customer": T.StructType([
        T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
        T.StructField("c_nationkey", T.IntegerType()), T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType())]),
    "orders": T.StructType([
        T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.TimestampType()), T.StructField("o_orderpriority", T.StringType())]),
    "nation": T.StructType([
        T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType()),
        T.StructField("n_regionkey", T.IntegerType())]),
    "region": T.StructType([
        T.StructField("r_regionkey", T.IntegerType()), T.StructField("r_name", T.StringType())]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads ``{sf_dir}/{name}.parquet``; parquet carries its own schema, so
    no inference happens — the declared schema is checked, not imposed."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    want = SCHEMAS.get(name)
    if want is not None:
        have = {f.name for f in df.schema.fields}
        missing = [f.name for f in want.fields if f.name not in have]
        if missing:
            raise ValueError(f"table {name} lacks columns {missing}")
    return df


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Spreads rows for CPU-heavy per-row work (regexes over long texts)
    when the scan yields fewer splits than the cluster has cores — e.g. a
    file holding one large row group, where a single task would get every
    row.  Hash-partitions by ``key`` (deterministic on retry, no sort); a
    no-op for inputs already split wider than the cluster."""
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= par:
        return df
    return df.repartition(par, key) if key else df.repartition(par)


def text_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """:func:`table` followed by :func:`spread` on ``key``."""
    return spread(table(spark, sf_dir, name), key)
