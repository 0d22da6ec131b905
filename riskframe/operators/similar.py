"""Exact similarity search on unit vectors without comparing all pairs.

On the unit sphere ``cos >= t`` is ``distance <= r`` with ``r =
sqrt(2 - 2t)``, a metric, so the triangle inequality rules out most of the
table.  Every candidate belongs to the cell of its nearest pivot and, inside
it, to a ring of distances from that pivot.  A query visits a ring only if

* the ring's distances overlap ``d(query, pivot) +- r``, and
* the query is at most ``r`` beyond the plane halfway between its own
  nearest pivot and that pivot.

Both are necessary for a match, so no pair at or above the threshold is
lost, whatever the pivots.  Rings of neighbouring cells are put together to
zones of up to ``BLOCK_ROWS`` candidates, and a query travels to a zone once
if it visits any ring of it.  Candidates and queries of a zone are dealt into
blocks, so a dense ring (near copies of one vector) is split over many tasks,
and matrix products over tiles of a block pair keep the best match of each
query.  A vector is sent at most once for every ``BLOCK_ROWS`` vectors of the
other side, even where nothing can be pruned (random vectors in many
dimensions), and a task holds two blocks of at most ``BLOCK_BYTES`` each.

What the driver holds is bounded by parameters: ``MAX_PIVOTS`` vectors and
``MAX_PIVOTS * ceil(2 / RING)`` ring summaries.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.vectors import as_double_array
from riskframe.session import cut_lineage

MAX_PIVOTS = 1024
RING = 0.1
BLOCK_ROWS = 1 << 16
# wide vectors make smaller blocks: what one side of a block pair may take
BLOCK_BYTES = 1 << 25
TILE = 2048
# room for rounding in the pruning tests; the match itself is tested exactly
SLACK = 1e-7
PRUNE_CELLS = 1 << 22

UNIT = "id long, at long, key binary, v array<double>"
ASSIGNED = "id long, at long, cell int, ring int, delta double, v array<double>"


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def rows_of(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * (x.shape[1] if x.ndim == 2 else 0), pa.int32()), pa.array(x.reshape(-1)))


def unit_rows(df: DataFrame, id_col: str, vec: str, at: str | None = None) -> DataFrame:
    """``id, at, key, v``: unit vectors with a 128-bit key of their numbers.
    ``at`` is a time in microseconds (null without one).  Rows whose vector
    is null, of zero norm or not finite match nothing and are left out."""
    t = F.unix_micros(F.col(at).cast("timestamp")) if at else F.lit(None).cast("long")
    src = df.select(F.col(id_col).cast("long").alias("id"), t.alias("at"), as_double_array(vec).alias("v")) \
        .where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(2))
            n = np.sqrt((x * x).sum(axis=1))
            ok = np.isfinite(n) & (n > 0)
            raw = np.ascontiguousarray(x[ok] + 0.0)
            keys = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in raw]
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(keys, pa.binary()),
                                              rows_of(raw / n[ok][:, None])], ["id", "at", "key", "v"])
    return src.mapInArrow(run, UNIT)


@dataclass
class SphereIndex:
    """Candidates by cell and ring: the pivots, one summary per ring that
    holds a candidate, and the table ``id, at, cell, ring, delta, v``."""
    pivots: np.ndarray
    rings: pd.DataFrame      # cell, ring, n, low, high
    table: DataFrame


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ pivots.T), 0.0))


def chained(pivots: np.ndarray) -> np.ndarray:
    """The pivots in an order in which each is followed by the nearest one
    left, so that neighbouring cells come to lie in the same zone."""
    if len(pivots) < 3:
        return pivots
    apart = distances(pivots, pivots)
    order, left = [0], np.ones(len(pivots), bool)
    left[0] = False
    while left.any():
        order.append(int(np.where(left, apart[order[-1]], np.inf).argmin()))
        left[order[-1]] = False
    return pivots[order]


def sphere_index(units: DataFrame, max_pivots: int = MAX_PIVOTS, ring: float = RING) -> SphereIndex:
    """Index of a table of :func:`unit_rows`.  Pivots are the candidates
    with the smallest keys, as many as the square root of their number up to
    ``max_pivots``; any choice gives the same matches."""
    units = cut_lineage(units.select("id", "at", "key", "v"))
    few = min(max_pivots, max(1, math.isqrt(units.count())))
    pivots = chained(np.array([r.v for r in units.orderBy("key", "id").limit(few).select("v").collect()]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d = distances(matrix(b.column(3)), pivots)
            cell = d.argmin(axis=1)
            delta = d[np.arange(len(cell)), cell]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array((delta / ring).astype(np.int32)),
                                              pa.array(delta), b.column(3)], ["id", "at", "cell", "ring", "delta", "v"])

    assigned = cut_lineage(units.mapInArrow(assign, ASSIGNED))
    rings = assigned.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("delta").alias("low"), F.max("delta").alias("high"))
    return SphereIndex(pivots, rings.toPandas().sort_values(["cell", "ring"], ignore_index=True), assigned)


def radius_of(threshold) -> np.ndarray:
    """Distance on the unit sphere at which the cosine is ``threshold``."""
    return np.sqrt(np.maximum(2.0 - 2.0 * np.asarray(threshold, float), 0.0)) + SLACK


def visits(index: SphereIndex) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """For unit vectors and a radius each, the matrix of (query, ring) pairs
    that may hold a match."""
    cell = index.rings["cell"].to_numpy(np.int64)
    low, high = index.rings["low"].to_numpy(float), index.rings["high"].to_numpy(float)
    pivots = index.pivots
    apart = distances(pivots, pivots)

    def of(x: np.ndarray, r: np.ndarray) -> np.ndarray:
        d = distances(x, pivots)
        own = d.argmin(axis=1)
        near = d[np.arange(len(x)), own]
        r = r[:, None]
        # distance to the plane halfway between the two pivots
        beyond = (d * d - (near * near)[:, None]) <= 2 * r * apart[own] + SLACK
        to = d[:, cell]
        return beyond[:, cell] & (high >= to - r) & (low <= to + r)
    return of


def home_ring(index: SphereIndex) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """For unit vectors, the one ring of the nearest pivot that lies nearest:
    a first guess that bounds the distance of the best match."""
    cell = index.rings["cell"].to_numpy(np.int64)
    low, high = index.rings["low"].to_numpy(float), index.rings["high"].to_numpy(float)
    pivots = index.pivots

    def of(x: np.ndarray, r: np.ndarray) -> np.ndarray:
        d = distances(x, pivots)
        to = d[:, cell]
        off = np.maximum(np.maximum(low - to, to - high), 0.0) + np.where(cell == d.argmin(axis=1)[:, None], 0.0, 4.0)
        out = np.zeros(off.shape, bool)
        out[np.arange(len(x)), off.argmin(axis=1)] = True
        return out
    return of


def ring_visits(index: SphereIndex, queries: DataFrame, choose: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``id, at, v, rings``: the places in ``index.rings`` that each query
    ``id, at, v, least`` has to visit to find every match whose cosine is
    ``least`` or more."""
    of, wide = choose or visits(index), max(1, len(index.rings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, r = matrix(b.column(2)), radius_of(b.column(3).to_numpy(zero_copy_only=False))
            step = max(1, PRUNE_CELLS // wide)
            for i in range(0, len(x), step):
                seen = of(x[i:i + step], r[i:i + step])
                bounds = np.concatenate([[0], np.cumsum(seen.sum(axis=1))]).astype(np.int32)
                part = b.slice(i, step)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2),
                                                  pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.nonzero(seen)[1].astype(np.int32)))],
                                                 ["id", "at", "v", "rings"])
    return queries.select("id", "at", "v", "least").mapInArrow(run, "id long, at long, v array<double>, rings array<int>")


def zones_of(sizes: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The zone of every ring, and the candidates of every zone: consecutive
    rings of up to ``block_rows`` together, a larger ring alone."""
    zone, room, total = np.zeros(len(sizes), np.int32), -1, []
    for i, n in enumerate(sizes):
        if n > room:
            total.append(0)
            room = block_rows
        zone[i] = len(total) - 1
        total[-1] += int(n)
        room -= int(n)
    return zone, np.array(total, np.int64)


def zone_visits(seen: DataFrame, zone: np.ndarray) -> DataFrame:
    """``id, at, v, zones``: a :func:`ring_visits` table by zones (rings and
    zones ascend together)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            wide = b.column(3).value_lengths().to_numpy(zero_copy_only=False)
            row, to = np.repeat(np.arange(b.num_rows), wide), zone[b.column(3).flatten().to_numpy(zero_copy_only=False)]
            new = np.ones(len(to), bool)
            new[1:] = (to[1:] != to[:-1]) | (row[1:] != row[:-1])
            bounds = np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=b.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.ListArray.from_arrays(pa.array(bounds), pa.array(to[new]))],
                                             ["id", "at", "v", "zones"])
    return seen.select("id", "at", "v", "rings").mapInArrow(run, "id long, at long, v array<double>, zones array<int>")


def best_in_block(threshold: float | None, strict: bool, exclude_self: bool, as_of: bool) -> Callable[[pa.Table], pa.Table]:
    def side(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = [matrix(c) for c in t.column("v").chunks if len(c)]
        return t.column("id").to_numpy(), t.column("at").cast(pa.float64()).to_numpy(), np.vstack(v) if v else np.zeros((0, 0))

    def best(t: pa.Table) -> pa.Table:
        qid, q_at, q = side(t.filter(t.column("is_q")))
        cid, c_at, c = side(t.filter(pa.compute.invert(t.column("is_q"))))
        order = np.argsort(cid, kind="stable")   # ties: the smaller id
        cid, c_at, c = cid[order], c_at[order], c[order]
        sim, nn = np.full(len(qid), -np.inf), np.zeros(len(qid), np.int64)
        for i in range(0, len(qid) if len(cid) else 0, TILE):
            rows = slice(i, i + TILE)
            for k in range(0, len(cid), TILE):
                ids = cid[k:k + TILE]
                s = q[rows] @ c[k:k + TILE].T
                if exclude_self:
                    own, end = np.searchsorted(ids, qid[rows], "left"), np.searchsorted(ids, qid[rows], "right")
                    while len(at := np.flatnonzero(own < end)):
                        s[at, own[at]] = -np.inf
                        own[at] += 1
                if as_of:
                    s[c_at[None, k:k + TILE] > q_at[rows, None]] = -np.inf
                j = s.argmax(axis=1)
                top = s[np.arange(len(j)), j]
                better = top > sim[rows]
                sim[rows], nn[rows] = np.where(better, top, sim[rows]), np.where(better, ids[j], nn[rows])
        ok = np.isfinite(sim)
        if threshold is not None:
            ok &= sim > threshold if strict else sim >= threshold
        return pa.table({"id": qid[ok], "nn_id": nn[ok], "sim": sim[ok]})
    return best


def search(index: SphereIndex, seen: DataFrame, threshold: float | None, strict: bool = False, exclude_self: bool = False,
           as_of: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Best match of each query of a :func:`ring_visits` table among the
    zones of the rings it visits."""
    spark = seen.sparkSession
    out = "id long, nn_id long, sim double"
    block_rows = max(1, min(block_rows, BLOCK_BYTES // (8 * max(1, index.pivots.shape[-1]))))
    zone, held = zones_of(index.rings["n"].to_numpy(), block_rows)
    seen = cut_lineage(zone_visits(seen, zone))
    wanted = {int(r["zone"]): int(r["n"]) for r in seen.select(F.explode("zones").alias("zone")).groupBy("zone").agg(F.count("*").alias("n")).collect()}
    if not wanted:
        return spark.createDataFrame([], out)
    blocks = lambda n: -(-n // block_rows)
    plan = spark.createDataFrame([(z, blocks(int(held[z])), blocks(n)) for z, n in sorted(wanted.items())], "zone int, c_blocks int, q_blocks int")
    rings = spark.createDataFrame([(int(r.cell), int(r.ring), int(zone[no])) for no, r in enumerate(index.rings.itertuples())], "cell int, ring int, zone int")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = (seen.select("id", "at", "v", F.explode("zones").alias("zone")).join(F.broadcast(plan), "zone")
         .select("id", "at", "v", "zone", deal("q_blocks").alias("qb"), every("c_blocks").alias("cb"), F.lit(True).alias("is_q")))
    c = (index.table.join(F.broadcast(rings), ["cell", "ring"]).join(F.broadcast(plan), "zone")
         .select("id", "at", "v", "zone", deal("c_blocks").alias("cb"), every("q_blocks").alias("qb"), F.lit(False).alias("is_q")))
    part = q.unionByName(c).groupBy("zone", "qb", "cb").applyInArrow(best_in_block(threshold, strict, exclude_self, as_of), out)
    best = part.groupBy("id").agg(F.max_by(F.struct("sim", "nn_id"), F.struct("sim", -F.col("nn_id"))).alias("b"))
    return best.select("id", "b.nn_id", "b.sim")


def nearest_within(index: SphereIndex, queries: DataFrame, threshold: float, strict: bool = False, exclude_self: bool = False,
                   as_of: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id, nn_id, sim``: for each query of a :func:`unit_rows` table its
    most similar candidate, if that is at or (``strict``) above the
    threshold; ties go to the smaller id.  With ``as_of`` only candidates
    whose time is not after the query's count."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    if not len(index.rings):
        return queries.sparkSession.createDataFrame([], "id long, nn_id long, sim double")
    seen = ring_visits(index, queries.withColumn("least", F.lit(float(threshold))))
    return search(index, seen, threshold, strict, exclude_self, as_of, block_rows)


def nearest_any(index: SphereIndex, queries: DataFrame, exclude_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id, nn_id, sim``: the most similar candidate of each query, however
    far.  The best match in the nearest ring bounds how far a better one can
    lie; the second pass visits only rings within that distance.  (Where
    vectors have no near neighbours, as random ones in many dimensions, few
    rings can be left out and the products near those of all pairs.)"""
    if not len(index.rings):
        return queries.sparkSession.createDataFrame([], "id long, nn_id long, sim double")
    q = cut_lineage(queries.select("id", "at", "v"))
    guess = search(index, ring_visits(index, q.withColumn("least", F.lit(-1.0)), home_ring(index)), None, exclude_self=exclude_self, block_rows=block_rows)
    bound = q.join(guess.select("id", F.col("sim").alias("least")), "id", "left").withColumn("least", F.coalesce("least", F.lit(-1.0)))
    return search(index, ring_visits(index, bound), None, exclude_self=exclude_self, block_rows=block_rows)


def nearest_other(df: DataFrame, id_col: str, vec: str, threshold: float | None = None, block_rows: int = BLOCK_ROWS,
                  max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """For every row its most similar *other* row, if that reaches the
    threshold (without one: however far).  Rows with equal vectors are
    searched once, by the smallest of their ids; the others, and the smallest
    among themselves, have each other at similarity 1."""
    rows = cut_lineage(unit_rows(df, id_col, vec))
    first = cut_lineage(rows.groupBy("key").agg(F.min("id").alias("id")))
    lead = rows.join(first, ["key", "id"], "left_semi")
    index = sphere_index(lead, max_pivots)
    near = (nearest_any(index, lead, True, block_rows) if threshold is None
            else nearest_within(index, lead, threshold, exclude_self=True, block_rows=block_rows))
    copies = cut_lineage(rows.select("key", "id").join(first, ["key", "id"], "left_anti"))
    second = copies.groupBy("key").agg(F.min("id").alias("nn_id"))
    twin = first.join(second, "key").select("id", "nn_id", F.lit(1.0).alias("sim"))
    of_copies = copies.join(first.withColumnRenamed("id", "nn_id"), "key").select("id", "nn_id", F.lit(1.0).alias("sim"))
    return near.join(twin, "id", "left_anti").unionByName(twin).unionByName(of_copies).withColumnRenamed("id", id_col)
