"""A score store whose appends are committed once.

A run writes its rows in chunks, each to a folder named by run and chunk, and
then commits the chunk by one small JSON file.  Readers list the commits and
read the folders they name, so rows of a job that died before its commit are
never seen, and a retried job overwrites its own chunks: no row is doubled.
The commits are the write log: run, chunk, detector, rows, failures, times.
"""
from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.sources.io import child_names, path_exists, read_small, write_small

ROWS = "detector string, id long, score double"
LOG = "run string, chunk int, detector string, rows long, failed long, started_at timestamp, ended_at timestamp"


@dataclass(frozen=True)
class RunStore:
    path: str

    def _data(self, run: str, chunk: int, detector: str) -> str:
        return f"{self.path}/data/run={run}/chunk={chunk}/detector={detector}"

    def chunks(self, spark: SparkSession, run: str, wanted: int) -> int:
        """Into how many chunks a run is cut: fixed when it first starts."""
        at = f"{self.path}/runs/{run}.json"
        if not path_exists(spark, at):
            write_small(spark, at, json.dumps({"chunks": wanted}))
        return json.loads(read_small(spark, at))["chunks"]

    def write(self, rows: DataFrame, run: str, chunk: int, detector: str) -> tuple[int, int]:
        """Writes ``id, score`` rows (null: failed) of a chunk; returns how
        many have a score and how many have not."""
        at = self._data(run, chunk, detector)
        rows.select("id", "score").write.mode("overwrite").parquet(at)
        n = rows.sparkSession.read.schema("id long, score double").parquet(at).agg(F.count("score").alias("ok"), F.count(F.lit(1)).alias("n")).first()
        return n["ok"], n["n"] - n["ok"]

    def commit(self, spark: SparkSession, run: str, chunk: int, detector: str, rows: int, failed: int, started: float, ended: float | None = None) -> None:
        iso = lambda t: time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(t)) + f".{int(t % 1 * 1e6):06d}Z"
        row = {"run": run, "chunk": chunk, "detector": detector, "rows": rows, "failed": failed, "started_at": iso(started),
               "ended_at": iso(time.time() if ended is None else ended)}
        write_small(spark, f"{self.path}/commits/{run}-{chunk}-{detector}.json", json.dumps(row) + "\n")

    def committed(self, spark: SparkSession, run: str, chunk: int, detector: str) -> bool:
        return path_exists(spark, f"{self.path}/commits/{run}-{chunk}-{detector}.json")

    def log(self, spark: SparkSession) -> DataFrame:
        """One row per commit; a commit being written is not one yet."""
        if not child_names(spark, f"{self.path}/commits"):
            return spark.createDataFrame([], LOG)
        return spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(f"{self.path}/commits").where("run is not null and ended_at is not null")

    def read(self, spark: SparkSession, detectors: list[str] | None = None) -> DataFrame:
        """Scores of committed chunks."""
        log = self.log(spark).where("rows > 0")
        if detectors:
            log = log.where(F.col("detector").isin(*detectors))
        # one short row per commit: a list of folders, as a file listing
        folders = [self._data(r.run, r.chunk, r.detector) for r in log.select("run", "chunk", "detector").collect()]
        if not folders:
            return spark.createDataFrame([], ROWS)
        df = spark.read.option("basePath", f"{self.path}/data").parquet(*folders)
        return df.where("score is not null").select(F.col("detector").cast("string").alias("detector"), "id", "score")


def progress(log: DataFrame, total) -> DataFrame:
    """A20 from a write log: per detector rows done, total, rate, rows per
    second of running time, and the seconds the rest will take at that
    speed (null while there is none)."""
    total = total if not isinstance(total, int) else F.lit(total)
    took = F.sum(F.unix_micros("ended_at") - F.unix_micros("started_at"))
    g = log.groupBy("detector").agg(F.sum("rows").alias("done"), F.sum("failed").alias("failed"), took.alias("us"),
                                    F.countDistinct("run").alias("runs"))
    per_s = F.try_divide(F.col("done") * 1e6, F.col("us"))
    return g.select("detector", "runs", "done", "failed", total.alias("total"), F.try_divide(F.col("done"), total).alias("rate"),
                    per_s.alias("rows_per_sec"), F.try_divide(F.greatest(total - F.col("done"), F.lit(0)), per_s).alias("eta_seconds"))
