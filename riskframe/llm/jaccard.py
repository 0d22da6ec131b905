"""Near duplicates on word shingles: a chosen-path similarity join.

Documents become sets of hashed five-word shingles; equal sets are one class
and are joined once.  Each set walks down random trees: at a node a shingle
is chosen with probability ``1 / (threshold * size)``, by a hash of the node
and the shingle, so sets that share shingles choose the same ones; a node's
path is a bucket key.  A pair at the threshold keeps one common child per
node on average, which fixes the chance that it still meets at a given
depth; runs are repeated until the chance of never meeting is below
``1 - recall``.  Members of buckets above ``BUCKET`` start again in deeper
trees, with as many runs as those need.  Sizes and 16 bytes of a 128-byte
sketch travel with the keys and part most members that met by chance; what is
left of a bucket is compared by brute force on the whole sketches.
Pairs that pass give connected candidate groups, and inside each group every
pair is verified exactly on its whole sets, in blocks of ``UNIT`` sets, so
no link that met is lost and each is counted once.

Defined results: fewer than five words give one shingle of all of them; a
null, empty or blank text has none, is alone in its class and has no links;
repeated rows and equal sets share a class; texts are taken whole; an empty
table gives an empty result; ids are cast to long; other columns are ignored or
passed through.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import U, Rolling, frugal, grams, mix, only_held, row_key, saved, text_blocks, word_spans
from riskframe.llm.graph import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
DEPTH = 2
MAX_DEPTH = 8
BUCKET = 4096
UNIT = 256
SKETCH = 128
# sketch bytes that travel with the bucket keys, and how many must agree of how many in use
COARSE, COARSE_USED, COARSE_LEAST = 16, 14, 3
# estimate a pair must reach to be verified: five standard deviations below
SLACK = 5 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / SKETCH)

SIGNATURE = "k_id long, k_row long, k_text long, digest binary, size long, sketch binary, keys array<long>"


def runs_needed(recall: float, depth: int) -> int:
    """Runs until a pair at the threshold has met with probability
    ``recall``: its common children are Poisson(1) at each level."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def shingle_sets(text: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    for _, _, data, off in text_blocks(text):
        starts, ends, _ = word_spans(data, off)
        wh = Rolling(data).spans(starts, ends)
        woff = np.searchsorted(starts, off)
        g = grams(wh, words)
        for i, j in zip(woff[:-1], woff[1:], strict=True):
            if j - i >= words:
                yield np.unique(g[i:j - words + 1])
            else:
                yield grams(wh[i:j], int(j - i)) if j > i else np.zeros(0, U)


def children(paths: np.ndarray, tokens: np.ndarray, threshold: float) -> np.ndarray:
    """Paths one level down: each path with each token its hash chooses."""
    p = 1 / (threshold * len(tokens))
    x = (tokens[None, :] + paths[:, None]) * U(0x9E3779B97F4A7C15)
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    if p >= 1:
        i, j = np.divmod(np.arange(x.size), len(tokens))
    else:
        i, j = np.nonzero(x < U(int(p * 2.0 ** 64)))
    return mix(paths[i] * U(0x2545F4914F6CDD1D) + tokens[j])


def chosen_paths(tokens: np.ndarray, seeds: np.ndarray, depth: int, threshold: float = THRESHOLD) -> np.ndarray:
    paths = seeds
    for _ in range(depth):
        if not len(paths):
            break
        paths = children(paths, tokens, threshold)
    return np.unique(paths)


def run_seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0xD1342543DE82EF95))


def sketch_of(tokens: np.ndarray) -> bytes:
    """One byte of the smallest hash in each of 128 ranges (0: none)."""
    out = np.zeros(SKETCH, np.uint8)
    b = (tokens >> U(57)).astype(np.int64)
    at = np.flatnonzero(np.diff(b, prepend=-1))
    out[b[at]] = 1 + (tokens[at] % U(255)).astype(np.uint8)
    return out.tobytes()


def digest_of(tokens: np.ndarray) -> bytes:
    a, b = mix(tokens).sum(dtype=U), np.bitwise_xor.reduce(mix(tokens ^ U(0x5851F42D4C957F2D)))
    return np.array([a, mix(b + U(len(tokens)))], U).tobytes()


def signatures(docs: DataFrame, threshold: float, recall: float, depth: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: class digest, set size, sketch and bucket keys
    (all null or empty for a text without words)."""
    seeds = run_seeds(runs_needed(recall, depth))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            dig, size, sk, keys = [], [], [], []
            for s in shingle_sets(batch.column(3), words):
                size.append(len(s))
                dig.append(digest_of(s) if len(s) else None)
                sk.append(sketch_of(s) if len(s) else None)
                keys.append(chosen_paths(s, seeds, depth, threshold).view(np.int64) if len(s) else np.zeros(0, np.int64))
            off = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:3], pa.array(dig, pa.binary()), pa.array(size, pa.int64()), pa.array(sk, pa.binary()),
                pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], ["k_id", "k_row", "k_text", "digest", "size", "sketch", "keys"])

    return (docs.select(F.col(id_col).cast("long").alias("k_id"), *row_key(text_col, id_col), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(sign, SIGNATURE))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups only (rows come sorted by the first
    ``keys`` columns), with the row at which each group begins."""
    held: pa.Table | None = None

    def begins(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for c in range(keys):
            code = t.column(c).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    for batch in frugal(batches):
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if not held.num_rows:
            continue
        at = begins(held)
        if at[-1] > 0:
            yield held.slice(0, int(at[-1])), at[:-1]
            held = held.slice(int(at[-1]))
    if held is not None and held.num_rows:
        yield held, begins(held)


def labels_from_pairs(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    lab = np.arange(n)
    while len(i):
        low = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    return lab


def similar_pairs(sketch: np.ndarray, size: np.ndarray, threshold: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a bucket whose sketches may belong to sets at the
    threshold."""
    n = len(size)
    out_i, out_j = [], []
    for i in range(n - 1):
        s, z = sketch[i + 1:], size[i + 1:]
        near = np.flatnonzero(np.minimum(z, size[i]) >= threshold * np.maximum(z, size[i]))
        if not len(near):
            continue
        s = s[near]
        have = sketch[i] != 0
        both = ((s == sketch[i]) & have).sum(1)
        used = ((s != 0) | have).sum(1)
        ok = near[both >= (threshold - slack) * used] + i + 1
        out_i.append(np.full(len(ok), i))
        out_j.append(ok)
    z = np.zeros(0, np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (z, z)


def may_match(a: np.ndarray, size_a, b: np.ndarray, size_b, threshold: float) -> np.ndarray:
    """Whether sets may be at the threshold, by their sizes and the first
    bytes of their sketches: at the threshold a byte agrees four times in
    five, so ``COARSE_LEAST`` agreeing bytes of ``COARSE_USED`` are missed
    once in four million pairs.  With fewer bytes in use nothing is said."""
    inked = (a != 0) | (b != 0)
    both = ((a == b) & inked).sum(-1)
    near = np.minimum(size_a, size_b) >= threshold * np.maximum(size_a, size_b)
    return near & ((inked.sum(-1) < COARSE_USED) | (both >= COARSE_LEAST))


def bucket_lists(threshold: float):
    """The members of each bucket that may match another one, as lists: a
    list is named by a hash of its members, so that the same ones meeting in
    many buckets are one list.  Half a digest stands for a member: classes
    that share it are members together, and are told apart later."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, 1):
            size = t.column("size").to_numpy()
            raw = np.frombuffer(b"".join(t.column("coarse").to_pylist()), np.uint8).reshape(-1, COARSE)
            member_of = t.column("half").combine_chunks()
            half = mix(member_of.to_numpy().view(U))
            ends = np.append(at[1:], t.num_rows)
            n = ends - at
            pair = at[n == 2]
            pair = pair[may_match(raw[pair], size[pair], raw[pair + 1], size[pair + 1], threshold)]
            rows = [np.stack([pair, pair + 1], 1).ravel()]
            names = [np.repeat(mix(half[pair] + half[pair + 1]), 2)]
            for lo, hi in zip(at[n > 2].tolist(), ends[n > 2].tolist(), strict=True):
                i, j = [], []
                for k in range(lo, hi - 1):
                    ok = np.flatnonzero(may_match(raw[k + 1:hi], size[k + 1:hi], raw[k], size[k], threshold)) + k + 1
                    i.append(np.full(len(ok), k - lo))
                    j.append(ok - lo)
                label = labels_from_pairs(hi - lo, np.concatenate(i), np.concatenate(j))
                total = np.zeros(hi - lo, U)
                np.add.at(total, label, half[lo:hi])
                member = np.flatnonzero(np.bincount(label, minlength=hi - lo)[label] > 1)
                rows.append(lo + member)
                names.append(mix(total[label[member]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names).view(np.int64)), member_of.take(pa.array(np.concatenate(rows)))], ["bucket", "half"])
    return run


def bucket_edges(threshold: float, slack: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, 1):
            dig = t.column("digest").to_pylist()
            size = t.column("size").to_numpy()
            sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            a, b = [], []
            for lo, hi in zip(at, [*at[1:], t.num_rows], strict=True):
                i, j = similar_pairs(sk[lo:hi], size[lo:hi], threshold, slack)
                if len(i):
                    for k, root in enumerate(labels_from_pairs(hi - lo, i, j)):
                        if root != k:
                            a.append(dig[lo + k])
                            b.append(dig[lo + root])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
    return run


def set_rows(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``wanted`` (k_row, k_text, digest, ...) with the shingle set of that
    document as ``tokens``; repeated rows give one.  Other texts stay where
    they are."""
    wanted = saved(wanted)
    rest = [c for c in wanted.columns if c not in ("k_row", "k_text")]
    text = docs.select(*row_key(text_col, id_col), F.col(text_col).cast("string").alias("text"))
    j = only_held(text, wanted, "k_row").join(wanted, ["k_row", "k_text"]).groupBy("k_row", "k_text").agg(*[F.first(c).alias(c) for c in [*rest, "text"]])
    schema = T.StructType([*wanted.select(*rest).schema.fields, T.StructField("tokens", T.ArrayType(T.LongType()))])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            sets = list(shingle_sets(batch.column(len(rest)), words))
            off = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = (np.concatenate(sets) if sets else np.zeros(0, U)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(rest)], pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], [*rest, "tokens"])

    return j.select(*rest, "text").mapInArrow(tokens, schema)


def candidate_edges(docs: DataFrame, classes: DataFrame, threshold: float, recall: float, depth: int, bucket: int,
                    words: int, id_col: str, text_col: str) -> DataFrame:
    """Edges between class digests whose closure joins every pair that met
    in a bucket and passed the sketches."""
    edges = []
    coarse = F.substring("sketch", 1, COARSE).alias("coarse")
    half = F.xxhash64("digest").alias("half")
    rows = classes.select(F.explode("keys").alias("key"), half, "size", coarse)
    sketches = classes.select(half, "digest", "size", "sketch")
    while True:
        # at most one row per ``bucket`` rows, so it can go to every task, and the rows move once
        large = saved(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("key"))
        lists = (rows.join(F.broadcast(large), "key", "left_anti").repartition("key").sortWithinPartitions("key", "half").select("key", "half", "size", "coarse")
                 .mapInArrow(bucket_lists(threshold), "bucket long, half long"))
        ready = lists.dropDuplicates(["bucket", "half"]).join(sketches, "half").select("bucket", "digest", "size", "sketch")
        edges.append(ready.repartition("bucket").sortWithinPartitions("bucket", "digest")
                     .mapInArrow(bucket_edges(threshold, SLACK), "a binary, b binary"))
        if large.isEmpty():
            break
        over = rows.join(F.broadcast(large), "key").select("key", "half")
        if depth >= MAX_DEPTH:
            # members agree in eight chosen shingles: one candidate group
            over = over.join(classes.select(half, "digest"), "half").select("key", "digest")
            root = over.groupBy("key").agg(F.min("digest").alias("b"))
            edges.append(over.join(root, "key").select(F.col("digest").alias("a"), "b").where("a != b"))
            break
        # those members start again in deeper trees, with the runs that need
        depth *= 2
        seeds = run_seeds(runs_needed(recall, depth))
        wanted = over.select("half").distinct().join(classes.select(half, "k_row", "k_text", "size", coarse), "half")

        def again(batches: Iterator[pa.RecordBatch], seeds=seeds, depth=depth) -> Iterator[pa.RecordBatch]:
            for batch in frugal(batches):
                for i, tok in enumerate(batch.column(3)):
                    k = chosen_paths(tok.values.to_numpy().view(U), seeds, depth, threshold).view(np.int64)
                    same = pa.array(np.full(len(k), i))
                    yield pa.RecordBatch.from_arrays([pa.array(k), *(batch.column(c).take(same) for c in range(3))], ["key", "half", "size", "coarse"])

        rows = saved(set_rows(docs, wanted.select("k_row", "k_text", "half", "size", "coarse"), words, id_col, text_col)
                     .mapInArrow(again, "key long, half long, size long, coarse binary"))
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    return out


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes; tokens of one set only are left out and
    the rest counted by products of 0/1 blocks."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, code, cnt = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = cnt[code] > 1
    owner, code = owner[keep], code[keep]
    _, code = np.unique(code, return_inverse=True)
    out = np.zeros((n, n), np.int64)
    if len(code):
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        step = 8192
        for lo in range(0, int(code[-1]) + 1, step):
            a, b = np.searchsorted(code, [lo, lo + step])
            x = np.zeros((n, step), np.float32)
            x[owner[a:b], code[a:b] - lo] = 1
            out += np.rint(x @ x.T).astype(np.int64)
    return out


def unit_links(threshold: float):
    """Verifies all pairs of a unit: within one block, or across two."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, 3):
            dig = t.column("digest").to_pylist()
            texts = t.column("n_texts").to_numpy()
            blk, ui, uj = (t.column(c).to_numpy() for c in ("blk", "ui", "uj"))
            tok = t.column("tokens").combine_chunks()
            off = tok.offsets.to_numpy()
            flat = tok.values.to_numpy().view(U)
            a, b, n = [], [], []
            for lo, hi in zip(at, [*at[1:], t.num_rows], strict=True):
                if hi - lo < 2:
                    continue
                sets = [flat[off[r]:off[r + 1]] for r in range(lo, hi)]
                size = np.array([len(s) for s in sets])
                both = common_counts(sets)
                ok = both * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-9
                np.fill_diagonal(ok, False)
                if ui[lo] != uj[lo]:
                    ok &= blk[lo:hi, None] != blk[None, lo:hi]
                links = ok @ texts[lo:hi]
                i, j = np.nonzero(ok)
                root = labels_from_pairs(hi - lo, i, j)
                for r in np.flatnonzero(links):
                    a.append(dig[lo + r])
                    b.append(dig[lo + root[r]])
                    n.append(int(links[r]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], ["a", "b", "n"])
    return run


def verified(docs: DataFrame, classes: DataFrame, groups: DataFrame, threshold: float, unit: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b, n): n linked texts of class a found in one unit, and a class b
    it is connected to there."""
    sizes = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / unit).cast("int").alias("blocks"))
    g = groups.withColumnRenamed("v", "digest").join(sizes, "root").join(classes.select("digest", "k_row", "k_text", "n_texts"), "digest")
    g = g.withColumn("blk", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    s = set_rows(docs, g.select("k_row", "k_text", "digest", "root", "blocks", "blk", "n_texts"), words, id_col, text_col)
    s = s.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    s = s.select("root", F.least("blk", "o").alias("ui"), F.greatest("blk", "o").alias("uj"), "digest", "blk", "n_texts", "tokens")
    return (s.repartition("root", "ui", "uj").sortWithinPartitions("root", "ui", "uj", "digest")
            .mapInArrow(unit_links(threshold), "a binary, b binary, n long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                    recall: float = RECALL, depth: int = DEPTH, bucket: int = BUCKET, unit: int = UNIT, words: int = WORDS) -> DataFrame:
    """One row per document: ``k_id`` (its id), ``k_row, k_text`` (its row
    key), ``label`` (its group), ``class_id`` (smallest id of the group),
    ``n_links`` (other texts at the threshold) and ``n_copies`` (documents
    with the same set)."""
    sig = saved(signatures(docs, threshold, recall, depth, words, id_col, text_col))
    texts = sig.where("digest is not null").select("digest", "k_text").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts"))
    classes = saved(sig.where("digest is not null").groupBy("digest").agg(
        F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"), F.min(F.struct("k_row", "k_text")).alias("rep"),
        F.min("k_id").alias("k_id"), F.count(F.lit(1)).alias("n_copies"))
        .select("digest", "size", "sketch", "keys", "rep.*", "k_id", "n_copies").join(texts, "digest"))
    groups = components(candidate_edges(docs, classes, threshold, recall, depth, bucket, words, id_col, text_col))
    links = saved(verified(docs, classes, groups, threshold, unit, words, id_col, text_col))
    roots = components(links.select("a", "b")).withColumnsRenamed({"v": "digest"})
    counts = links.groupBy(F.col("a").alias("digest")).agg(F.sum("n").alias("linked"))
    info = saved(classes.select("digest", "n_copies", "n_texts", "k_id").join(roots, "digest", "left").join(counts, "digest", "left")
                 .select("digest", F.coalesce("root", "digest").alias("label"), "n_copies", "k_id",
                         (F.coalesce("linked", F.lit(0)) + F.col("n_texts") - 1).alias("n_links")))
    first = info.groupBy("label").agg(F.min("k_id").alias("class_id"))
    named = info.drop("k_id").join(first, "label")
    d = sig.select("k_id", "k_row", "k_text", "digest")
    return d.join(named, "digest", "left").select(
        "k_id", "k_row", "k_text", "label", F.when(F.col("digest").isNull(), F.col("k_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the smallest
    id, then the smallest text hash; of rows equal in both, one.  Documents
    without words stay."""
    near = near_duplicates(docs, id_col, text_col, **options).where("label is not null")
    best = (near.groupBy("label").agg(F.min(F.struct(F.col("k_id").isNull().alias("z"), "k_id", "k_text", "k_row")).alias("best"))
            .select("best.k_row", "best.k_text"))
    rows = docs.select(*row_key(text_col, id_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("ink"))
    kept = rows.where("ink").join(best, ["k_row", "k_text"]).groupBy("k_row", "k_text").agg(F.first("row").alias("row"))
    return kept.select("row").union(rows.where("not ink").select("row")).select("row.*")
