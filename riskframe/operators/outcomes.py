"""What became of a request by its deadline (C7, A14), on tables and streams.

A request is left-joined with the event that ends it: same id, not before the
request, at most a deadline later.  Without one in time the request timed
out (a verdict without a confirmation stays unverified).  The join has an
equality and an interval, so on streams both sides keep state only as long
as their watermarks allow and a missing end is emitted once it can no longer
come; on tables the same columns come from one shuffle by id.

An id has one request and one end; the stream drops repeats within the
watermark, the table form keeps the earliest end.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _interval(seconds: float):
    # a literal: the stream join reads its state's bounds from it
    return F.expr(f"INTERVAL '{seconds:.6f}' SECOND")


def _in_time(ts: str, seconds: float):
    return (F.col("__id") == F.col("__end_id")) & (F.col("__end_ts") >= F.col(ts)) & (F.col("__end_ts") <= F.col(ts) + _interval(seconds))


def _outcome(joined: DataFrame, cols: list[str], end_cols: list[str]) -> DataFrame:
    return joined.select(*cols, *end_cols, F.col("__end_ts").alias("ended_at"),
                         F.when(F.col("__end_id").isNull(), "timeout").otherwise("done").alias("outcome"))


def outcomes(requests: DataFrame, ends: DataFrame, id_col: str, ts: str, deadline_seconds: float, end_cols: list[str] | None = None) -> DataFrame:
    """``requests`` with ``outcome`` (done or timeout), ``ended_at`` and the
    ``end_cols`` of the event that ended it in time."""
    end_cols = end_cols or []
    first = ends.groupBy(F.col(id_col).alias("__end_id")).agg(F.min(F.struct(F.col(ts).cast("timestamp").alias("t"), *end_cols)).alias("e"))
    e = first.select("__end_id", F.col("e.t").alias("__end_ts"), *[F.col(f"e.{c}").alias(c) for c in end_cols])
    r = requests.withColumn(ts, F.col(ts).cast("timestamp")).withColumn("__id", F.col(id_col))
    return _outcome(r.join(e, _in_time(ts, deadline_seconds), "left"), requests.columns, end_cols)


def stream_outcomes(requests: DataFrame, ends: DataFrame, id_col: str, ts: str, deadline_seconds: float, end_cols: list[str] | None = None,
                    delay: str = "10 minutes") -> DataFrame:
    """:func:`outcomes` of two streams (append mode): a timeout is emitted
    once the watermark has passed the deadline."""
    end_cols = end_cols or []
    r = requests.withColumn("__id", F.col(id_col)).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["__id"])
    e = (ends.select(F.col(id_col).alias("__end_id"), F.col(ts).alias("__end_ts"), *end_cols)
         .withWatermark("__end_ts", delay).dropDuplicatesWithinWatermark(["__end_id"]))
    return _outcome(r.join(e, _in_time(ts, deadline_seconds), "leftOuter"), requests.columns, end_cols)


def timeouts_by_endpoint(outcome: DataFrame, endpoint: str = "endpoint") -> DataFrame:
    """Requests and timeouts of every endpoint."""
    return outcome.groupBy(F.col(endpoint).alias("endpoint")).agg(F.count(F.lit(1)).alias("n_requests"),
                                                                  F.count_if(F.col("outcome") == "timeout").alias("n_timeouts"))


def confirmations(verdicts: DataFrame, confirmed: DataFrame, id_col: str, ts: str, deadline_seconds: float, risk: str = "risk") -> DataFrame:
    """Each served verdict with what a slower judge said within the
    deadline: ``unverified`` (nothing, or too late), ``escalated`` (HIGH over
    a lower one) or ``stands`` (never downgraded), and the final risk."""
    c = confirmed.withColumnRenamed(risk, "__judge")
    o = outcomes(verdicts, c, id_col, ts, deadline_seconds, ["__judge"])
    raised = (F.col("outcome") == "done") & (F.col("__judge") == "HIGH") & (F.col(risk) != "HIGH")
    status = F.when(F.col("outcome") == "timeout", "unverified").when(raised, "escalated").otherwise("stands")
    return o.select(*verdicts.columns, status.alias("confirmation"), F.when(raised, "HIGH").otherwise(F.col(risk)).alias("final_risk"))
