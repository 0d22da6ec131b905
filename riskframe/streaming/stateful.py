"""Keyed state machines as Structured Streaming operators (T1, T3, T4 twins).

``EventTimeFold`` is a ``transformWithStateInPandas`` processor that runs the
*same* step functions as the batch folds in :mod:`riskframe.operators.folds`.
Rows of a key are buffered in list state and folded in ``(event time, id)``
order only once the watermark has passed them (an event-time timer per key
at the oldest buffered row), so out-of-order arrival inside the watermark
delay gives exactly the batch answer.  The fold state itself is one small
value per key, and a timer clears it at the event time from which it equals
a fresh start (an entry past its TTL, a full bucket, a breaker past its
cooldown), so the keys held are those of recent rows; only a breaker with
uncleared failures stays until its next call.
"""
from __future__ import annotations

import json
from collections import namedtuple
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from riskframe import config as C
from riskframe.operators import folds

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_Row = namedtuple("_Row", ["rid", "k", "t", "ok"])


def _ceil_ms(t_us: int) -> int:
    return -(-int(t_us) // 1000)


class EventTimeFold(StatefulProcessor):
    """Buffers (rid, t, ok) per key; on each expired timer folds every
    buffered row with ``t <= watermark`` in order and emits the outputs.
    ``fresh_at(state)`` is the event time (µs) from which the state equals
    no state, or None if it never does."""

    def __init__(self, step_factory, out_columns: list[str], fresh_at):
        self._factory = step_factory
        self._cols = out_columns
        self._fresh_at = fresh_at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.step = self._factory()
        self.buf = handle.getListState("buf", "rid long, t long, ok boolean")
        self.state = handle.getValueState("fold", "s string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for pdf in rows:
            new.extend(zip(pdf["rid"].astype("int64"), pdf["t"].astype("int64"), pdf["ok"].astype(bool)))
        if new:
            self.buf.appendList([(int(r), int(t), bool(o)) for r, t, o in new])
            earliest = min(t for _, t, _ in new)
            timers = list(self.handle.listTimers())
            if not timers or _ceil_ms(earliest) < min(timers):
                self.handle.registerTimer(_ceil_ms(earliest))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        wm_us = int(timerValues.getCurrentWatermarkInMs()) * 1000
        k = key[0] if isinstance(key, tuple) else key
        rows = list(self.buf.get()) if self.buf.exists() else []
        ready = sorted((r for r in rows if r[1] <= wm_us), key=lambda r: (r[1], r[0]))
        rest = [r for r in rows if r[1] > wm_us]
        st = self.state.get() if self.state.exists() else None
        state = _load(st[0]) if st else None
        out = []
        for rid, t, ok in ready:
            state, o = self.step(state, _Row(rid, str(k), t, ok))
            out.append(o)
        due = self._fresh_at(state) if state is not None else None
        if due is not None and due <= wm_us:
            # no later row can be older than the watermark
            state = due = None
        if state is not None:
            if ready:
                self.state.update((json.dumps(state),))
        elif self.state.exists():
            self.state.clear()
        self.buf.clear()
        wake = [_ceil_ms(min(t for _, t, _ in rest))] if rest else []
        if rest:
            self.buf.put(rest)
        if due is not None:
            wake.append(_ceil_ms(due))
        if wake:
            self.handle.registerTimer(min(wake))
        if out:
            yield pd.DataFrame(out, columns=self._cols)

    def close(self) -> None:
        pass


def _load(s: str):
    v = json.loads(s)
    return tuple(v) if isinstance(v, list) else v


def _prepare(df: DataFrame, key: str, ts: str, id_col: str, ok: str | None, delay: str) -> DataFrame:
    return (df.withWatermark(ts, delay)
            .select(F.col(key).cast("string").alias("k"), F.col(id_col).cast("long").alias("rid"),
                    F.unix_micros(F.col(ts).cast("timestamp")).alias("t"),
                    (F.col(ok).cast("boolean") if ok else F.lit(True)).alias("ok"), F.col(ts)))


def ttl_fresh_at(ttl_us: int):
    return lambda state: state[0] + ttl_us


def bucket_fresh_at(cap: float, rate: float):
    # 2 µs of slack keep the float test of the refill true there
    return lambda state: state[1] + int(max(0.0, (cap - state[0]) / rate) * 1e6) + 2 if rate > 0 else None


def breaker_fresh_at(cd_us: int):
    def at(state):
        fails, opened = state
        if opened is not None:
            return opened + cd_us
        return None if fails else 0
    return at


def _run(df: DataFrame, factory, schema: str, fresh_at) -> DataFrame:
    spark = df.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    cols = [c.split()[0] for c in schema.split(",")]
    return df.groupBy("k").transformWithStateInPandas(
        statefulProcessor=EventTimeFold(factory, cols, fresh_at), outputStructType=schema,
        outputMode="Append", timeMode="EventTime")


def _named(out: DataFrame, id_col: str, key: str) -> DataFrame:
    """Same column names as the batch fold."""
    return out.withColumnRenamed("rid", id_col).withColumnRenamed("k", key)


def stream_ttl_reuse(df: DataFrame, key: str, ts: str, id_col: str, ttl_seconds: float = C.CACHE_TTL_SECONDS,
                     delay: str = "10 minutes") -> DataFrame:
    """T1 on a stream: ``(id, key, hit, origin_id)`` as :func:`folds.ttl_reuse`."""
    ttl_us = int(round(ttl_seconds * 1_000_000))
    return _named(_run(_prepare(df, key, ts, id_col, None, delay), lambda: folds.ttl_step(ttl_us),
                       folds.TTL_SCHEMA, ttl_fresh_at(ttl_us)), id_col, key)


def stream_token_bucket(df: DataFrame, identity: str, ts: str, id_col: str, capacity: float, refill: float,
                        delay: str = "10 minutes") -> DataFrame:
    """T3 on a stream: ``(id, identity, allowed, retry_after)`` as
    :func:`folds.token_bucket`."""
    cap, rate = float(capacity), float(refill)
    return _named(_run(_prepare(df, identity, ts, id_col, None, delay), lambda: folds.bucket_step(cap, rate),
                       folds.BUCKET_SCHEMA, bucket_fresh_at(cap, rate)), id_col, identity)


def stream_circuit_breaker(df: DataFrame, backend: str, ts: str, id_col: str, ok: str,
                           threshold: int = C.BREAKER_FAILURE_THRESHOLD,
                           cooldown_seconds: float = C.BREAKER_COOLDOWN_SECONDS,
                           delay: str = "10 minutes") -> DataFrame:
    """T4 on a stream: ``(id, backend, skipped, open_after, failures_after)``
    as :func:`folds.circuit_breaker`."""
    cd_us = int(round(cooldown_seconds * 1_000_000))
    return _named(_run(_prepare(df, backend, ts, id_col, ok, delay), lambda: folds.breaker_step(threshold, cd_us),
                       folds.BREAKER_SCHEMA, breaker_fresh_at(cd_us)), id_col, backend)
