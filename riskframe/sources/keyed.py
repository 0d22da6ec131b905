"""A keyed table on a file system that grows by small deltas.

Rows live in hash buckets of their key.  An epoch writes only the buckets its
rows fall into, under ``delta/epoch=E``; readers merge the base files with the
deltas committed since.  Compaction rewrites only the buckets that have
pending deltas into a new base version and then publishes a manifest that
names, for every bucket, the version to read: until the manifest is there,
readers go on with the old one, and files they may be reading are kept.

A replayed epoch overwrites its own folder; a crash before an epoch's
``_SUCCESS`` or before a manifest leaves nothing that readers see.
"""
from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.sources.io import child_names, path_exists, read_small, write_small

BASE_EPOCH = -1


def latest(rows: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """The value of a key's latest epoch (of equals the largest row)."""
    v = F.struct(*cols)
    return rows.groupBy(key).agg(F.max_by(v, F.struct("epoch", v)).alias("v")).select(key, "v.*")


def escalating(fixed: dict, risk: str = "risk") -> Callable[[DataFrame, str, list[str]], DataFrame]:
    """A key keeps the value of its first epoch (of that epoch's rows the
    most severe); a HIGH row of a later epoch raises it and sets the
    ``fixed`` columns; nothing lowers it."""
    def merge(rows: DataFrame, key: str, cols: list[str]) -> DataFrame:
        sev = F.when(F.col(risk) == "HIGH", 2).when(F.col(risk) == "MEDIUM", 1).otherwise(0)
        v = F.struct(*cols)
        g = rows.groupBy(key).agg(F.min(F.struct("epoch", (-sev).alias("s"), v.alias("v"))).alias("first"),
                                  F.max(F.when(F.col(risk) == "HIGH", F.col("epoch"))).alias("high"))
        raised = (F.col("first.s") != -2) & F.coalesce(F.col("high") > F.col("first.epoch"), F.lit(False))
        return g.select(key, *[F.when(raised, F.lit(fixed[c])).otherwise(F.col(f"first.v.{c}")).cast(rows.schema[c].dataType).alias(c)
                               if c in fixed else F.col(f"first.v.{c}").alias(c) for c in cols])
    return merge


@dataclass(frozen=True)
class KeyedTable:
    """``schema`` is the DDL of key and value columns; ``merge(rows, key,
    value columns)`` folds rows with an ``epoch`` into one row per key."""
    path: str
    key: str
    schema: str
    merge: Callable[[DataFrame, str, list[str]], DataFrame] = latest
    buckets: int = 64

    def _cols(self, spark: SparkSession) -> list[str]:
        return [c for c in spark.createDataFrame([], self.schema).columns if c != self.key]

    def write_epoch(self, batch: DataFrame, epoch: int) -> None:
        """Appends one epoch: one row per key, in its buckets only."""
        spark = batch.sparkSession
        cols = self._cols(spark)
        rows = self.merge(batch.select(self.key, *cols, F.lit(epoch).cast("long").alias("epoch")), self.key, cols)
        (rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")).repartition("bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/delta/epoch={epoch}"))

    def manifest(self, spark: SparkSession) -> dict:
        names = sorted(int(n[:-5]) for n in child_names(spark, f"{self.path}/manifest") if n.endswith(".json") and n[:-5].isdigit())
        for n in reversed(names):
            try:
                return json.loads(read_small(spark, f"{self.path}/manifest/{n}.json"))
            except ValueError:  # being written: the one before still holds
                continue
        return {"upto": BASE_EPOCH, "buckets": {}}

    def pending(self, spark: SparkSession, upto: int) -> list[int]:
        """Committed epochs after ``upto``."""
        names = [n[6:] for n in child_names(spark, f"{self.path}/delta") if n.startswith("epoch=")]
        return sorted(int(n) for n in names if int(n) > upto and path_exists(spark, f"{self.path}/delta/epoch={n}/_SUCCESS"))

    def _rows(self, spark: SparkSession, folders: list[str], epoch) -> DataFrame:
        cols = self._cols(spark)
        empty = spark.createDataFrame([], f"{self.schema}, epoch long")
        if not folders:
            return empty
        return spark.read.schema(self.schema).parquet(*folders).select(self.key, *cols, epoch.cast("long").alias("epoch"))

    def _merged(self, spark: SparkSession, base: dict, epochs: list[int], buckets: set[int] | None = None) -> DataFrame:
        old = [f"{self.path}/base/version={v}/bucket={b}" for b, v in sorted(base.items()) if buckets is None or int(b) in buckets]
        rows = self._rows(spark, old, F.lit(BASE_EPOCH))
        for e in epochs:
            at = f"{self.path}/delta/epoch={e}"
            new = [f"{at}/{n}" for n in child_names(spark, at) if n.startswith("bucket=") and (buckets is None or int(n[7:]) in buckets)]
            rows = rows.unionByName(self._rows(spark, new, F.lit(e)))
        return self.merge(rows, self.key, self._cols(spark))

    def read(self, spark: SparkSession) -> DataFrame:
        """The merged view of base and committed deltas."""
        m = self.manifest(spark)
        return self._merged(spark, m["buckets"], self.pending(spark, m["upto"]))

    def compact(self, spark: SparkSession) -> list[int]:
        """Folds pending deltas into the base; returns the buckets written."""
        m = self.manifest(spark)
        epochs = self.pending(spark, m["upto"])
        changed = {int(n[7:]) for e in epochs for n in child_names(spark, f"{self.path}/delta/epoch={e}") if n.startswith("bucket=")}
        if not changed:
            return []
        version = epochs[-1]
        (self._merged(spark, m["buckets"], epochs, changed).withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
         .repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/base/version={version}"))
        buckets = {**m["buckets"], **{str(b): version for b in sorted(changed)}}
        write_small(spark, f"{self.path}/manifest/{version}.json", json.dumps({"upto": version, "buckets": buckets}))
        return sorted(changed)


def keyed_writer(table: KeyedTable, compact_every: int = 16):
    """``foreachBatch`` function: an epoch appends its delta; every so many
    epochs the changed buckets are compacted."""
    def write(batch: DataFrame, epoch: int) -> None:
        table.write_epoch(batch, epoch)
        if (epoch + 1) % compact_every == 0:
            table.compact(batch.sparkSession)
    return write
