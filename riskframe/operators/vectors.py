"""Vector operators: cosine/L2 scalars, anchor similarity, centroids and an
exact blocked nearest-neighbour self-join.

Small anchor packs are shipped to the tasks as literal arrays after a size
check; packs beyond the limit go through the blocked join instead, which
never builds all pairs as rows (each block pair is one Arrow GEMM that emits
only its per-query best match).
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_INLINE_ANCHORS = 4096     # literal-array path up to this many anchors
NN_BLOCK_ROWS = 4096          # rows per side of one block pair in the exact join


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double_array(c) -> Column:
    return _col(c).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(a) -> Column:
    """Unit vector (zero vector stays zero)."""
    n = l2_norm(a)
    return F.when(n > 0, F.transform(_col(a), lambda x: x / n)).otherwise(_col(a))


def cosine(a, b) -> Column:
    """Cosine similarity, 0.0 when either side has zero norm."""
    na, nb = l2_norm(a), l2_norm(b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


# --- anchors -------------------------------------------------------------------

def first_per_group(df: DataFrame, group: str, order: str, vec: str) -> DataFrame:
    """One representative vector per group (smallest ``order``); min_by is a
    partial aggregate, so a hot group is combined map-side."""
    return df.groupBy(group).agg(F.min_by(vec, order).alias(vec))


def collect_small(df: DataFrame, limit: int = MAX_INLINE_ANCHORS) -> list:
    """Collects a table to the driver only after proving it has at most
    ``limit`` rows (a ``limit+1`` probe, not a full count)."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise OverflowError(f"table exceeds {limit} rows; use the blocked join path")
    return rows


def max_anchor_similarity(vec, anchors: list, clamp_at_zero: bool = False, empty_value: float = 0.0
                          ) -> Column:
    """Max cosine between ``vec`` and each anchor (anchors are python
    float lists, already collected behind a size check).  Empty pack ->
    ``empty_value``; ``clamp_at_zero`` floors the result at 0 (meta-intent)."""
    if not anchors:
        return F.lit(float(empty_value))
    v = _col(vec)
    nv = l2_norm(v)
    sims = []
    for a in anchors:
        arr = [float(x) for x in a]
        na = math.sqrt(sum(x * x for x in arr))
        if na == 0:
            sims.append(F.lit(0.0))
            continue
        lit = F.lit(arr)
        sims.append(F.when(nv > 0, dot(v, lit) / (nv * F.lit(na))).otherwise(F.lit(0.0)))
    m = F.greatest(*sims) if len(sims) > 1 else sims[0]
    return F.greatest(m, F.lit(0.0)) if clamp_at_zero else m


# --- A15 centroids ------------------------------------------------------------------

def centroids(df: DataFrame, group: str, vec: str, normalize: bool = False) -> DataFrame:
    """Element-wise mean vector per group (``normalize`` -> unit length).

    Every task adds up its vectors by group with numpy and emits one partial
    sum per group it saw; the partial sums of a group (one per task at most)
    are added in a second step, so a hot group is summed where its rows are
    and no row per component is made.  Rows with a null vector are left out."""
    kind = df.schema[group].dataType.simpleString()
    src = df.where(F.col(vec).isNotNull()).select(F.col(group).alias("__g"), as_double_array(vec).alias("__v"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            coded = pa.compute.dictionary_encode(b.column(0), null_encoding="encode")
            at = coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            part = np.add.reduceat(x[order], first, axis=0)
            n = np.diff(np.append(first, len(at)))
            for i, g in enumerate(coded.dictionary.take(pa.array(at[order][first])).to_pylist()):
                s, c = sums.get(g, (0.0, 0))
                sums[g] = (s + part[i], c + int(n[i]))
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), coded.dictionary.type), pa.array([s.tolist() for s, _ in sums.values()], pa.list_(pa.float64())),
                                              pa.array([c for _, c in sums.values()], pa.int64())], ["g", "s", "n"])

    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        mean = np.sum(np.vstack(rows["s"].to_numpy()), axis=0) / rows["n"].sum()
        return pd.DataFrame({group: [key[0]], "centroid": [mean.tolist()]})

    parts = src.mapInArrow(partial, f"g {kind}, s array<double>, n long")
    cen = parts.groupBy("g").applyInPandas(total, f"`{group}` {kind}, centroid array<double>")
    if normalize:
        cen = cen.withColumn("centroid", l2_normalize("centroid"))
    return cen


# --- J12 exact nearest neighbour ----------------------------------------------------

def nearest_neighbour(df: DataFrame, id_col: str, vec: str, extra: list | None = None,
                      block_rows: int = NN_BLOCK_ROWS) -> DataFrame:
    """For every row, the most similar *other* row (cosine, ties to the
    smaller id).  Exact; see :func:`nearest_between`."""
    return nearest_between(df, df, id_col, vec, extra, block_rows, exclude_self=True)


def nearest_between(queries: DataFrame, candidates: DataFrame, id_col: str, vec: str,
                    extra: list | None = None, block_rows: int = NN_BLOCK_ROWS,
                    exclude_self: bool = False) -> DataFrame:
    """For every query row, the most similar candidate row (cosine,
    ties to the smaller id; the same id is skipped when ``exclude_self``).

    Both sides are hashed into blocks of about ``block_rows``; every
    (query block, candidate block) pair is one group holding those two
    blocks — each row is replicated once per block of the other side, never
    paired row by row — and one Arrow GEMM per group keeps each query's best
    candidate.  A ``max_by`` over the partial answers gives the result.
    Work is O(|Q|·|C|·d) by definition of the exact operator; memory per
    task is O(block_rows·d)."""
    extra = extra or []
    nq = queries.count()
    nc = candidates.count()
    bq = max(1, math.ceil(nq / block_rows))
    bc = max(1, math.ceil(nc / block_rows))

    def prep(df):
        return df.select(F.col(id_col).cast("long").alias("id"), as_double_array(vec).alias("v"))
    q = prep(queries).withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(bq)).cast("int"))
    c = prep(candidates).withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(bc)).cast("int"))
    side_q = q.select("id", "v", "qb", F.explode(F.sequence(F.lit(0), F.lit(bc - 1))).alias("cb"),
                      F.lit(True).alias("is_q"))
    side_c = c.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(bq - 1))).alias("qb"), "cb",
                      F.lit(False).alias("is_q"))
    both = side_q.unionByName(side_c)
    skip_self = bool(exclude_self)

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        qq = pdf[pdf.is_q]
        cc = pdf[~pdf.is_q]
        if len(qq) == 0 or len(cc) == 0:
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "nn_id": pd.Series([], dtype="int64"),
                                 "sim": pd.Series([], dtype="float64")})
        Q = np.vstack(qq.v.to_numpy()).astype(np.float64)
        Cm = np.vstack(cc.v.to_numpy()).astype(np.float64)
        qn = np.linalg.norm(Q, axis=1)
        cn = np.linalg.norm(Cm, axis=1)
        Qn = np.divide(Q, qn[:, None], out=np.zeros_like(Q), where=qn[:, None] > 0)
        Cn = np.divide(Cm, cn[:, None], out=np.zeros_like(Cm), where=cn[:, None] > 0)
        qid = qq.id.to_numpy()
        cid = cc.id.to_numpy()
        order = np.argsort(cid, kind="stable")      # ties -> smaller id (argmax takes the first)
        cid = cid[order]
        S = Qn @ Cn[order].T
        if skip_self:
            S[qid[:, None] == cid[None, :]] = -np.inf
        j = np.argmax(S, axis=1)
        sim = S[np.arange(len(qid)), j]
        ok = np.isfinite(sim)
        return pd.DataFrame({"id": qid[ok].astype("int64"), "nn_id": cid[j][ok].astype("int64"),
                             "sim": sim[ok].astype("float64")})

    part = both.groupBy("qb", "cb").applyInPandas(best, "id long, nn_id long, sim double")
    res = part.groupBy("id").agg(F.max_by(F.struct("sim", "nn_id"),
                                          F.struct(F.col("sim"), -F.col("nn_id"))).alias("b"))
    res = res.select("id", F.col("b.nn_id").alias("nn_id"), F.col("b.sim").alias("sim"))
    if extra:
        res = res.join(queries.select(F.col(id_col).cast("long").alias("id"), *extra), "id").join(
            candidates.select(F.col(id_col).cast("long").alias("nn_id"), *[F.col(x).alias(f"nn_{x}") for x in extra]),
            "nn_id")
    return res.withColumnRenamed("id", id_col)


# --- J11 several anchor sets in one matrix product ---------------------------------------

def anchor_cosines(vec, anchors: list) -> Column:
    """Array column with the cosine of ``vec`` to each anchor, one
    Arrow matrix product a batch (0.0 for a vector of zero norm; null for a
    null vector).  The anchors travel with the function: they must come from
    :func:`collect_small` or another fixed list."""
    A = np.asarray(anchors, dtype=np.float64).reshape(len(anchors), -1)
    n = np.linalg.norm(A, axis=1, keepdims=True)
    A = np.divide(A, n, out=np.zeros_like(A), where=n > 0)

    @F.pandas_udf("array<double>")
    def cosines(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            out: list = [None] * len(v)
            some = np.flatnonzero(v.notna().to_numpy())
            if len(some):
                X = np.vstack(v.iloc[some].to_numpy()).astype(np.float64)
                norm = np.linalg.norm(X, axis=1, keepdims=True)
                for i, row in zip(some, np.divide(X, norm, out=np.zeros_like(X), where=norm > 0) @ A.T, strict=True):
                    out[i] = row
            yield pd.Series(out, dtype=object)
    return cosines(_col(vec))


def best_cosine(cosines, places: list[int], empty_value: float = 0.0) -> Column:
    """The largest of the cosines at ``places`` (an empty set scores
    ``empty_value``)."""
    c = [_col(cosines)[i] for i in places]
    return F.greatest(*c) if len(c) > 1 else c[0] if c else F.lit(float(empty_value))


# --- J11 broadcast-matrix anchor scores ----------------------------------------------

def anchor_max_arrow(df: DataFrame, vec: str, anchors: np.ndarray, out_col: str = "threat_score",
                     empty_value: float = 0.0) -> DataFrame:
    """J11/N8 for wide vectors: ``max_a cos(v, a)`` per row as one Arrow GEMM
    per batch against the anchor matrix, shipped once per executor as a
    broadcast variable.  The anchor matrix must come from
    :func:`collect_small` (its size is checked)."""
    spark = df.sparkSession
    A = np.asarray(anchors, dtype=np.float64)
    if A.size:
        n = np.linalg.norm(A, axis=1, keepdims=True)
        A = np.divide(A, n, out=np.zeros_like(A), where=n > 0)
    bc = spark.sparkContext.broadcast(A)
    at = df.columns.index(vec)
    schema = df.select("*").schema.add(out_col, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        M = bc.value
        for b in batches:
            if not b.num_rows:
                continue
            if M.size == 0:
                s = np.full(b.num_rows, float(empty_value))
            else:
                X = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
                xn = np.linalg.norm(X, axis=1, keepdims=True)
                X = np.divide(X, xn, out=np.zeros_like(X), where=xn > 0)
                s = (X @ M.T).max(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, out_col])

    return df.mapInArrow(run, schema)


def anchor_max_blocks(df: DataFrame, vec: str, anchors: DataFrame, anchor_vec: str, out_col: str = "threat_score",
                      block: int = MAX_INLINE_ANCHORS, empty_value: float = 0.0) -> DataFrame:
    """:func:`anchor_max_arrow` for an anchor table of any size: the anchors
    are dealt by hash into blocks of about ``block`` rows; each block's matrix
    is sent, its maxima are taken and written, and only then the next one
    follows, so one bounded matrix is alive at a time.  The numbers are the
    same at every size."""
    from riskframe.session import cut_lineage
    a = cut_lineage(anchors.select(F.col(anchor_vec).alias("a")).distinct())
    blocks = max(1, math.ceil(a.count() / block))
    if blocks == 1:
        rows = a.collect()
        return anchor_max_arrow(df, vec, np.array([r.a for r in rows]) if rows else np.zeros((0, 1)), out_col, empty_value)
    df = df.withColumn(out_col, F.lit(None).cast("double"))
    for k in range(blocks):
        rows = a.where(F.pmod(F.xxhash64("a"), F.lit(blocks)) == k).collect()
        if rows:
            df = anchor_max_arrow(df, vec, np.array([r.a for r in rows]), "__max", empty_value)
            df = cut_lineage(df.withColumn(out_col, F.greatest(out_col, "__max")).drop("__max"))
    return df
