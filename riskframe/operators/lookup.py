"""As-of lookups against a verdict cache (J9) without pairing rows.

For each request, the latest cache entry of the same key written at or
before the request time, valid while ``t_request - t_entry < ttl``.  The
latest entry is a bucketed running "last value" over the key's time range,
so no request is paired with more than one candidate and a hot key is split
over its time buckets.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def asof_cache_lookup(requests: DataFrame, entries: DataFrame, key: str, ts: str, req_id: str, ent_id: str,
                      ttl_seconds: float) -> DataFrame:
    """Returns ``(req_id, hit, origin_id)``; entries at the same timestamp as
    a request count as written before it; among equal times the larger
    entry id is the later one.  The latest entry comes from the bucketed
    running-last scan (:func:`riskframe.operators.roc.last_before`), so a
    hot key is spread over its time buckets."""
    from riskframe.operators.roc import last_before
    w_us = int(round(ttl_seconds * 1_000_000))
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    r = requests.select(F.col(key).alias("k"), t.alias("t"), F.lit(1).alias("kind"),
                        F.col(req_id).cast("long").alias("rid"), F.lit(None).cast("long").alias("eid"))
    e = entries.select(F.col(key).alias("k"), t.alias("t"), F.lit(0).alias("kind"),
                       F.lit(None).cast("long").alias("rid"), F.col(ent_id).cast("long").alias("eid"))
    ent = F.when(F.col("kind") == 0, F.struct(F.col("t").alias("et"), F.col("eid").alias("eid")))
    from riskframe.session import cut_lineage
    u = cut_lineage(r.unionByName(e))     # narrow rows, read by several branches of the scan
    x = last_before(u, ["k"], "t", ["kind", "eid"], ent, "cand", inclusive=True) \
        .where(F.col("kind") == 1)
    hit = F.col("cand").isNotNull() & (F.col("t") - F.col("cand.et") < w_us)
    return x.select(F.col("rid").alias(req_id), hit.alias("hit"), F.when(hit, F.col("cand.eid")).alias("origin_id"))
