"""Keyed, time-ordered state machines run as batch jobs.

The three online state machines (verdict reuse within a TTL, the per-identity
token bucket and the per-backend failure breaker) are folds over each key's
requests in event-time order.  Two things keep them distributed:

* **Exact segmentation.**  Where a row provably resets the state (a TTL
  gap empties the cache entry; a gap of ``capacity/refill`` refills the
  bucket; a successful call a cooldown after the previous one closes the
  breaker), rows are cut into independent segments — found per (key, time
  window) and numbered by a bucketed prefix count, so no key's history is
  ordered in one task — and segments, not whole keys, are the unit of work.
* **Streaming fold.**  Rows are hash-partitioned by (key, segment), sorted
  within partitions, and streamed through ``mapInPandas`` carrying O(1)
  state across Arrow batches.  No group is ever materialised in memory, so
  a key holding a third of all rows costs time in one task but not memory.

Timestamps are compared in integer microseconds; elapsed seconds are
``Δµs / 1e6`` so every implementation (batch, stream, SQL) computes the same
floats.
"""
from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import config as C


def _micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _compact(x: DataFrame) -> DataFrame:
    """The fold input — a few narrow columns — is read by several branches
    (segmentation scan, prefix count, the fold itself): write it once to
    the checkpoint folder instead of re-deriving its lineage (scans, joins)
    in every branch."""
    from riskframe.session import cut_lineage
    return cut_lineage(x)


def sorted_fold(df: DataFrame, keys: list[str], order: list[str], step: Callable, schema: str,
                partitions: int | None = None) -> DataFrame:
    """Runs ``step(state, row) -> (state, out_row)`` over each key's rows in
    ``order``; ``state`` is None at the start of every key."""
    n = partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = df.repartition(int(n), *keys).sortWithinPartitions(*keys, *order)
    names = [f.split()[0] for f in schema.split(",")]
    key_names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur, state = None, None
        for pdf in batches:
            out = []
            kv = pdf[key_names].itertuples(index=False, name=None)
            for k, row in zip(kv, pdf.itertuples(index=False)):
                if k != cur:
                    cur, state = k, None
                state, o = step(state, row)
                out.append(o)
            yield pd.DataFrame(out, columns=names)

    return ordered.mapInPandas(run, schema)


def _segments(df: DataFrame, key: str, t_us: str, reset: Callable) -> DataFrame:
    """Adds ``seg``: the number of state resets at or before each row of its
    key (a reset = ``reset(gap to the previous request)``, which may also
    read the row's own columns; the first request sees an unbounded gap),
    without ordering any key's whole history in one task: the previous
    request comes from the bucketed running-last scan and the reset count
    from the bucketed prefix sum.  Rows at equal times share a segment (a
    zero gap never resets)."""
    from riskframe.operators.roc import last_before, prefix_before
    x = last_before(df, [key], t_us, ["rid"], F.col(t_us), "__prev", inclusive=False)
    gap = F.when(F.col("__prev").isNull(), F.lit(1 << 62)).otherwise(F.col(t_us) - F.col("__prev"))
    x = x.withColumn("__r", F.when(reset(gap), 1).otherwise(0))
    per_t = x.groupBy(key, t_us).agg(F.sum("__r").alias("__r"))
    pre = prefix_before(per_t, [key], t_us, ["__r"]).select(
        key, t_us, (F.col("__r_lt") + F.col("__r")).alias("seg"))
    return x.drop("__prev", "__r").join(pre, [key, t_us])


# --- step functions shared by the batch folds and the streaming processors ------------
# Each takes (state, row) with row fields rid, k, t (µs) [, ok] and returns
# (new_state, output tuple).  State is a plain tuple (JSON-serialisable).

TTL_SCHEMA = "rid long, k string, hit boolean, origin_id long"
BUCKET_SCHEMA = "rid long, k string, allowed boolean, retry_after double"
BREAKER_SCHEMA = "rid long, k string, skipped boolean, open_after boolean, failures_after int"


def ttl_step(ttl_us: int):
    def step(state, r):
        if state is not None and r.t - state[0] < ttl_us:
            return state, (r.rid, r.k, True, state[1])
        return (int(r.t), int(r.rid)), (r.rid, r.k, False, r.rid)
    return step


def bucket_step(cap: float | None, rate: float | None):
    """``cap``/``rate`` None: read per-row ``r.cap``/``r.rate`` (constant per
    identity, e.g. chosen per principal)."""
    def step(state, r):
        if cap is None:
            return _bucket(state, r, float(r.cap), float(r.rate))
        return _bucket(state, r, cap, rate)
    return step


def _bucket(state, r, cap, rate):
    if state is None:
        tokens, last = cap, int(r.t)
    else:
        tokens, last = state
        elapsed = (r.t - last) / 1e6
        if elapsed > 0:
            tokens = min(cap, tokens + elapsed * rate)
            last = int(r.t)
    if tokens >= 1.0:
        return (float(tokens - 1.0), last), (r.rid, r.k, True, 0.0)
    return (float(tokens), last), (r.rid, r.k, False, (1.0 - tokens) / rate)


def breaker_step(threshold: int, cd_us: int):
    def step(state, r):
        fails, opened = state if state is not None else (0, None)
        if opened is not None:
            if r.t - opened >= cd_us:
                fails, opened = 0, None
            else:
                return (fails, opened), (r.rid, r.k, True, True, fails)
        if r.ok:
            fails, opened = 0, None
        else:
            fails += 1
            if fails >= threshold and opened is None:
                opened = int(r.t)
        return (fails, opened), (r.rid, r.k, False, opened is not None, fails)
    return step


# --- T1 verdict reuse within TTL ----------------------------------------------------

def ttl_reuse(df: DataFrame, key: str, ts: str, id_col: str, ttl_seconds: float = C.CACHE_TTL_SECONDS
              ) -> DataFrame:
    """Per ``key`` (prompt hash): the first request computes and writes; a
    later request reuses it while ``t - write_time < ttl`` (a hit does not
    extend the entry); the first request at or past the TTL recomputes.
    Returns ``(id, key, hit, origin_id)``; ``origin_id`` is the request whose
    verdict is served."""
    ttl_us = int(round(ttl_seconds * 1_000_000))
    x = _compact(df.select(F.col(id_col).cast("long").alias("rid"), F.col(key).cast("string").alias("k"),
                           _micros(ts).alias("t")))
    x = _segments(x, "k", "t", lambda g: g >= ttl_us)
    out = sorted_fold(x, ["k", "seg"], ["t", "rid"], ttl_step(ttl_us), TTL_SCHEMA)
    return out.select(F.col("rid").alias(id_col), F.col("k").alias(key), "hit", "origin_id")


# --- T3 token bucket ------------------------------------------------------------------

def bucket_parameters(rpm: float, burst_seconds: float = C.BURST_SECONDS) -> tuple[float, float]:
    """(capacity, refill per second); capacity is floored at 1 token."""
    refill = rpm / 60.0
    return max(1.0, refill * burst_seconds), refill


def token_bucket(df: DataFrame, identity: str, ts: str, id_col: str, capacity, refill) -> DataFrame:
    """Per identity: a new identity starts full; ``tokens = min(cap, tokens +
    elapsed*refill)`` on every request (allowed or denied); allowed when at
    least one token, which is spent; otherwise ``retry_after = (1 -
    tokens)/refill``.  Non-positive configuration allows everything.

    ``capacity``/``refill`` are numbers, or column names holding per-row
    values that are constant per identity (T3b: parameters chosen per
    principal).  A pause with ``elapsed*refill >= cap`` (float, as the fold
    computes it) refills the bucket completely whatever came before, so it
    starts an independent segment."""
    per_row = isinstance(capacity, str)
    cap_c = F.col(capacity).cast("double") if per_row else F.lit(float(capacity))
    rate_c = F.col(refill).cast("double") if per_row else F.lit(float(refill))
    x = df.select(F.col(id_col).cast("long").alias("rid"), F.col(identity).cast("string").alias("k"),
                  _micros(ts).alias("t"), cap_c.alias("cap"), rate_c.alias("rate"))
    unlimited = (F.col("cap") <= 0) | (F.col("rate") <= 0)
    free = x.where(unlimited).select(F.col("rid").alias(id_col), F.col("k").alias(identity),
                                     F.lit(True).alias("allowed"), F.lit(0.0).alias("retry_after"))
    lim = _compact(x.where(~unlimited))
    # any gap of at least `width` refills the bucket (2 µs of slack over cap/rate
    # keeps the float test true there); shorter gaps are tested exactly
    lim = _segments(lim, "k", "t", lambda g: (g / F.lit(1e6)) * F.col("rate") >= F.col("cap"))
    out = sorted_fold(lim, ["k", "seg"], ["t", "rid"], bucket_step(None, None), BUCKET_SCHEMA)
    return out.select(F.col("rid").alias(id_col), F.col("k").alias(identity), "allowed", "retry_after") \
        .unionByName(free)


def retry_after_header(seconds) -> Column:
    """Whole seconds for a ``Retry-After`` header, at least 1."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.greatest(F.lit(1), F.floor(s + 0.999).cast("int"))


def quota_identity(authenticated, key_id, client_ip) -> Column:
    """``key:<id>`` for authenticated callers, else ``ip:<address>``."""
    return F.when(F.col(authenticated), F.concat(F.lit("key:"), F.col(key_id))) \
        .otherwise(F.concat(F.lit("ip:"), F.col(client_ip)))


def quota_rpm(authenticated, tenant_rpm) -> Column:
    """Tenant override or the keyed default for authenticated callers,
    the anonymous default otherwise."""
    return F.when(F.col(authenticated), F.coalesce(F.col(tenant_rpm).cast("double"), F.lit(C.KEYED_RPM))) \
        .otherwise(F.lit(C.ANONYMOUS_RPM))


def bucket_columns(rpm, burst_seconds: float = C.BURST_SECONDS) -> tuple[Column, Column]:
    """N20 as columns: (capacity, refill per second)."""
    r = (F.col(rpm) if isinstance(rpm, str) else rpm) / 60.0
    return F.greatest(F.lit(1.0), r * F.lit(float(burst_seconds))), r


# --- T4 failure runs (circuit breaker) -------------------------------------------------------

def circuit_breaker(df: DataFrame, backend: str, ts: str, id_col: str, ok: str,
                    threshold: int = C.BREAKER_FAILURE_THRESHOLD,
                    cooldown_seconds: float = C.BREAKER_COOLDOWN_SECONDS) -> DataFrame:
    """Per backend, calls in event-time order: ``threshold`` consecutive
    failures open the breaker; while open (``t - opened < cooldown``) calls
    are skipped and record nothing; the first call at or past the cooldown
    is a probe that starts from a zero failure count.  Returns
    ``(id, backend, skipped, open_after, failures_after)``.  Backends are cut
    into independent segments at successful calls that follow a pause of at
    least one cooldown."""
    cd_us = int(round(cooldown_seconds * 1_000_000))
    x = _compact(df.select(F.col(id_col).cast("long").alias("rid"), F.col(backend).cast("string").alias("k"),
                           _micros(ts).alias("t"), F.col(ok).cast("boolean").alias("ok")))

    # such a call finds the breaker closed or past its cooldown, and leaves it
    # closed without failures
    x = _segments(x, "k", "t", lambda g: (g >= cd_us) & F.coalesce(F.col("ok"), F.lit(False)))
    out = sorted_fold(x, ["k", "seg"], ["t", "rid"], breaker_step(threshold, cd_us), BREAKER_SCHEMA)
    return out.select(F.col("rid").alias(id_col), F.col("k").alias(backend), "skipped", "open_after",
                      "failures_after")


def open_intervals(breaker_out: DataFrame, backend: str, ts_df: DataFrame, id_col: str, ts: str,
                   bucket: str = "1 hour") -> DataFrame:
    """Last known open/closed state per backend and time bucket
    (``max_by(state, time)``)."""
    j = breaker_out.join(ts_df.select(id_col, ts), id_col)
    return j.groupBy(backend, F.date_trunc(bucket.split()[-1], F.col(ts)).alias("bucket_start")).agg(
        F.max_by("open_after", F.struct(F.col(ts), F.col(id_col))).alias("open"))


# --- T1 without a sequential fold: pointer doubling --------------------------------

def _next_pointer(x: DataFrame, w_us: int) -> DataFrame:
    """``(rid, nx)``: the first request of the same key at or after
    ``t + ttl`` (in (t, rid) order), null when there is none — the bucketed
    running-last scan run backwards in time over requests and probes
    (probes sort after requests at equal times in the reversed order, so a
    request exactly at ``t + ttl`` qualifies)."""
    from riskframe.operators.roc import last_before
    probes = x.select("k", (-(F.col("t") + w_us)).alias("rt"), F.lit(0).alias("rkind"),
                      F.col("rid").alias("src"), F.lit(None).cast("long").alias("nrid"))
    reqs = x.select("k", (-F.col("t")).alias("rt"), F.lit(-1).alias("rkind"),
                    F.lit(None).cast("long").alias("src"), (-F.col("rid")).alias("nrid"))
    u = probes.unionByName(reqs)
    nxt = last_before(u, ["k"], "rt", ["rkind", "nrid"], F.when(F.col("rkind") == -1, -F.col("nrid")), "nx",
                      inclusive=True)
    return nxt.where(F.col("rkind") == 0).select(F.col("src").alias("rid"), "nx")


def ttl_reuse_doubling(df: DataFrame, key: str, ts: str, id_col: str, ttl_seconds: float = C.CACHE_TTL_SECONDS,
                       max_levels: int = 62) -> DataFrame:
    """T1 for keys that never pause (a hot prompt), with no per-key
    sequential pass; same output as :func:`ttl_reuse`.

    The misses of a key are the chain ``h, nxt(h), nxt(nxt(h)), ...`` from its
    first request ``h`` (:func:`_next_pointer`).  The chain is enumerated by
    pointer doubling: jump tables ``J_k = nxt^(2^k)`` until one is empty, then
    ``S <- S ∪ J_k(S)`` over all levels — ``log2(chain length)`` joins, each
    written once to the checkpoint folder.  A hit's origin is the latest miss
    before it (the as-of lookup).  Work is O(n log L) with no key ever
    processed in one task."""
    from riskframe.operators.lookup import asof_cache_lookup
    from riskframe.session import cut_lineage
    w_us = int(round(ttl_seconds * 1_000_000))
    x = _compact(df.select(F.col(id_col).cast("long").alias("rid"), F.col(key).cast("string").alias("k"),
                           _micros(ts).alias("t")))
    tables = [cut_lineage(_next_pointer(x, w_us))]
    for _ in range(max_levels):
        j = tables[-1]
        nxt2 = cut_lineage(j.alias("a").join(j.alias("c"), F.col("a.nx") == F.col("c.rid"), "left")
                           .select(F.col("a.rid").alias("rid"), F.col("c.nx").alias("nx")))
        if nxt2.where(F.col("nx").isNotNull()).limit(1).count() == 0:
            break
        tables.append(nxt2)
    misses = x.groupBy("k").agg(F.min(F.struct("t", "rid")).alias("h")).select(F.col("h.rid").alias("rid"))
    for j in reversed(tables):
        step = misses.join(j, "rid").where(F.col("nx").isNotNull()).select(F.col("nx").alias("rid"))
        misses = cut_lineage(misses.unionByName(step).distinct())
    lab = x.join(misses.withColumn("miss", F.lit(True)), "rid", "left") \
        .withColumn("miss", F.coalesce("miss", F.lit(False)))
    req = lab.select("k", F.timestamp_micros("t").alias("ts_"), "rid")
    ent = lab.where("miss").select("k", F.timestamp_micros("t").alias("ts_"), "rid")
    org = asof_cache_lookup(req, ent, "k", "ts_", "rid", "rid", ttl_seconds)
    out = lab.join(org.select("rid", "origin_id"), "rid", "left")
    return out.select(F.col("rid").alias(id_col), F.col("k").alias(key), (~F.col("miss")).alias("hit"),
                      F.when(F.col("miss"), F.col("rid")).otherwise(F.col("origin_id")).alias("origin_id"))
