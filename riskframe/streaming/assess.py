"""The whole assessment of requests, as a table job and as one stream.

Both forms share their row-local parts: the rule pack and signals give each
request the verdict it would get alone, grants and tenants (static tables
joined to the stream) and the policy turn a verdict into a decision.  Between
them stands the verdict store: within a TTL, requests for the same prompt are
served the verdict of the first.  On a table that is
:func:`folds.ttl_reuse`; on a stream one keyed state holds the stored verdict
of a prompt, rows wait in state until the watermark has passed them, and a
timer drops a verdict when its TTL is over, so rows that arrive out of order
within the delay get the verdicts of the table form.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe import config as C
from riskframe.config import RulePack
from riskframe.operators import cascade as K
from riskframe.operators import folds, govern, screening
from riskframe.operators import vectors as V
from riskframe.streaming import stateful

VERDICT = "risk string, source string, semantic_score double, topicality string, judge_invoked boolean, symbolic_triggered boolean, triggering_class string"
SERVED = "rid long, k string, hit boolean, origin_id long, own string, served string"


@dataclass
class Context:
    """What an assessment holds against requests: rules, anchor vectors by
    set (collected behind a size check), fusion policy and its features,
    grants and tenants as tables, tenant policies."""
    anchors: dict[str, list[list[float]]]
    policy: dict
    features: dict[str, str]
    grants: DataFrame
    tenants: DataFrame
    rules: RulePack
    tenant_policy: dict | None = None
    ttl_seconds: float = C.CACHE_TTL_SECONDS


def signal_columns(df: DataFrame, vec: str, anchors: dict[str, list[list[float]]]) -> DataFrame:
    """A score per anchor set: the largest cosine to one of its anchors, all
    sets from one matrix product a batch (null without a vector)."""
    flat = [a for group in anchors.values() for a in group]
    d = df.withColumn("__cos", V.anchor_cosines(vec, flat))
    at = 0
    for name, group in anchors.items():
        d = d.withColumn(name, V.best_cosine("__cos", list(range(at, at + len(group)))))
        at += len(group)
    return d.drop("__cos")


def own_verdicts(requests: DataFrame, ctx: Context) -> DataFrame:
    """``request_id, ts, credential_hash, prompt_hash, verdict``: the verdict
    of every request by itself (a null text is the empty prompt).  Columns needed: request_id, ts, text,
    embedding, credential_hash; anchor sets ``meta``, ``threat`` and
    ``educational`` beside those of the policy's features."""
    x = requests.select("request_id", "ts", "text", "embedding", "credential_hash", F.sha2(F.coalesce("text", F.lit("")), 256).alias("prompt_hash"))
    x = signal_columns(screening.screen_prompts(x, rules=ctx.rules), "embedding", ctx.anchors)
    x = K.assess(x, ctx.features, ctx.policy, "meta", "threat", F.coalesce(F.col("educational") > C.EDUCATIONAL_THRESHOLD, F.lit(False)), violation="violation")
    names = [f.split()[0] for f in VERDICT.split(", ")]
    return x.select("request_id", "ts", "credential_hash", "prompt_hash", F.struct(*[F.col(c).alias(c) for c in names]).alias("verdict"))


def decided(served: DataFrame, ctx: Context) -> DataFrame:
    """Decisions from ``request_id, credential_hash, hit, origin_id,
    verdict``: a served verdict names the cache as its source."""
    locked = F.when(F.col("verdict.risk") == "HIGH", "cache_locked_high").otherwise("cache")
    x = served.select("request_id", "credential_hash", "hit", "origin_id", "verdict.risk",
                      F.when(F.col("hit"), locked).otherwise(F.col("verdict.source")).alias("source"),
                      "verdict.semantic_score", "verdict.topicality", "verdict.triggering_class")
    x = govern.apply_tenants(govern.resolve_principal(x, ctx.grants), ctx.tenants)
    d = govern.policy_decision(x, ctx.tenant_policy)
    action = F.when(F.col("tenant_status") == "suspended", "REJECT").otherwise(F.col("action"))
    return d.select("request_id", "hit", "origin_id", "risk", "source", "semantic_score", "topicality", "triggering_class",
                    "tenant", "capability", "authenticated", action.alias("decision"))


def assess_requests(requests: DataFrame, ctx: Context) -> DataFrame:
    """The assessment of a table of requests."""
    from riskframe.session import cut_lineage
    own = cut_lineage(own_verdicts(requests, ctx))
    r = folds.ttl_reuse(own, "prompt_hash", "ts", "request_id", ctx.ttl_seconds).select("request_id", "hit", "origin_id")
    origin = own.select(F.col("request_id").alias("origin_id"), "verdict")
    return decided(own.drop("verdict").join(r, "request_id").join(origin, "origin_id"), ctx)


class VerdictReuse(stateful.EventTimeFold):
    """:class:`EventTimeFold` whose rows carry a payload."""

    def init(self, handle) -> None:
        self.handle = handle
        self.step = self._factory()
        self.buf = handle.getListState("buf", "rid long, t long, p string")
        self.state = handle.getValueState("fold", "s string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r), int(t), p) for pdf in rows for r, t, p in zip(pdf["rid"], pdf["t"], pdf["p"], strict=True)]
        if new:
            self.buf.appendList(new)
            due = stateful._ceil_ms(min(t for _, t, _ in new))
            timers = list(self.handle.listTimers())
            if not timers or due < min(timers):
                self.handle.registerTimer(due)
        return iter(())


def verdict_step(ttl_us: int):
    """Serves the stored payload within its TTL, else stores the row's."""
    def step(state, r):
        if state is not None and r.t - state[0] < ttl_us:
            return state, (r.rid, r.k, True, state[1], r.ok, state[2])
        return (int(r.t), int(r.rid), r.ok), (r.rid, r.k, False, r.rid, r.ok, r.ok)
    return step


def stream_assess(requests: DataFrame, ctx: Context, delay: str = "10 minutes") -> DataFrame:
    """The assessment of a stream of requests (append mode): the rows of
    :func:`assess_requests`, each once the watermark has passed it."""
    spark = requests.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != stateful.ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    ttl_us = int(round(ctx.ttl_seconds * 1_000_000))
    own = own_verdicts(requests.withWatermark("ts", delay), ctx)
    rows = own.select(F.col("prompt_hash").alias("k"), F.col("request_id").cast("long").alias("rid"), F.unix_micros("ts").alias("t"),
                      F.to_json(F.struct("credential_hash", "verdict")).alias("p"), "ts")
    out = rows.groupBy("k").transformWithStateInPandas(
        statefulProcessor=VerdictReuse(lambda: verdict_step(ttl_us), [c.split()[0] for c in SERVED.split(", ")], stateful.ttl_fresh_at(ttl_us)),
        outputStructType=SERVED, outputMode="Append", timeMode="EventTime")
    body = f"credential_hash string, verdict struct<{VERDICT.replace(' ', ':').replace(',:', ',')}>"
    served = out.select(F.col("rid").alias("request_id"), F.from_json("own", body)["credential_hash"].alias("credential_hash"), "hit", "origin_id",
                        F.from_json("served", body)["verdict"].alias("verdict"))
    return decided(served, ctx)
