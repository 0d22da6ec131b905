"""Stupid-backoff scores of all documents under the corpus's own n-grams.

Relational plan, with n-grams as 60-bit hashes (two of a billion different
ones are expected to meet about once): documents are read in blocks
of whole documents; a block's distinct n-grams with their counts are dealt by
hash range to buckets (one packed row per block and bucket that it has
n-grams in, so an n-gram travels once per block); a bucket, one task, sums
the counts of all blocks, which is its part of the count table, and answers
each row with the n-grams that also occur in other blocks: an n-gram without
an answer has the block's own count.  The answers meet their block's
documents, which travel compressed, by block id, where each document's terms
are summed.  A bucket holds a bounded share of the corpus: their number
follows its size, and frequent n-grams are summed per block first, so none is
hot.

Scores leave the document's own occurrences out: with ``c`` the corpus count
less the count in the document, a word after context ``h`` scores
``c(h w) / c(h)`` if ``c(h w) > 0``, else ``alpha`` times its score after the
shorter context; at the end ``c(w) / N``, or ``1 / (N + 1)`` for a word seen
nowhere else, with N the words of other documents.  Two copies of a text
count for each other.

Blocks are formed twice, so the input must give the same rows in the same
order when it is read again, as file scans do; pass ``stable=False`` to write
it first.  A difference raises an error.

Defined results: a null, empty or blank text has no words, a sum of 0 and a
null mean; repeated rows are documents of their own; texts are read whole;
an empty table gives an empty result; ids are cast to long; other columns
are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import U, Rolling, frugal, grams, mix, saved, text_blocks, word_spans

ORDER = 3
ALPHA = 0.4
KEY_BITS = 60
TEXT_LEVEL = 5
BLOCK_BYTES = 6 << 20
BUCKET_BYTES = 16 << 20
BLOCK_BYTES_AT_ONCE = 1 << 19
TOTAL = U(0)  # the key under which blocks count all their words


def pack(x: np.ndarray) -> bytes:
    """Sorted 64-bit values: differences, byte by byte, compressed."""
    d = np.diff(x, prepend=U(0)).view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.T).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    b = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(b.T).view(U).ravel(), dtype=U)


def squeeze(x: np.ndarray) -> bytes:
    """Integers, byte by byte, compressed: small values cost their low byte."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def spread(raw: bytes, kind) -> np.ndarray:
    b = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(b.T).view(kind).ravel()


class Block:
    """The words of whole documents, as hashes with document bounds."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        self.words, self.bounds = words, bounds
        self.doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))

    def keys(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, key) of the n-grams that lie in one document."""
        g = self.words if n == 1 else grams(self.words, n)
        at = np.arange(len(g))
        if n > 1 and len(g):
            at = np.flatnonzero(self.doc[:len(g)] == self.doc[n - 1:])
        # no key is TOTAL, and the lengths do not meet
        return at, ((mix(g[at] + U((n * 0xD1342543DE82EF95) % (1 << 64))) >> U(64 - KEY_BITS)) | U(1))


def words_of(data: np.ndarray, off: np.ndarray) -> Block:
    """The block's words, hashed a bounded piece of it at a time."""
    words, counts, a, n = [np.zeros(0, U)], [np.zeros(0, np.int64)], 0, len(off) - 1
    while a < n:
        b = min(max(a + 1, int(np.searchsorted(off, off[a] + BLOCK_BYTES_AT_ONCE, "right")) - 1), n)
        part, at = data[off[a]:off[b]], off[a:b + 1] - off[a]
        s, e, _ = word_spans(part, at)
        words.append(Rolling(part).spans(s, e))
        counts.append(np.diff(np.searchsorted(s, at)))
        a = b
    return Block(np.concatenate(words), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64))


def cut_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int):
    """(block id, ids, bytes, offsets) for each block of the task; columns:
    part, id, text.  Documents are cut at the same places whatever the
    batches are."""
    part, seq, size = 0, 0, 0
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

    def close():
        off = np.concatenate([[0], np.cumsum(np.concatenate([h[2] for h in held]))]).astype(np.int64)
        return (part << 32) | seq, pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), off

    for batch in frugal(batches):
        if not batch.num_rows:
            continue
        part = batch.column(0)[0].as_py()
        for r0, r1, data, off in text_blocks(batch.column(2)):
            a = 0
            while a < r1 - r0:
                # documents up to the one that fills the block
                b = min(int(np.searchsorted(off, off[a] + block_bytes - size, "left")), r1 - r0)
                b = max(b, a + 1)
                held.append((batch.column(1).slice(r0 + a, b - a), data[off[a]:off[b]].copy(), np.diff(off[a:b + 1])))
                size += int(off[b] - off[a])
                a = b
                if size >= block_bytes:
                    yield close()
                    seq, size, held = seq + 1, 0, []
    if held:
        yield close()


def edges(buckets: int) -> np.ndarray:
    return np.array([(i << KEY_BITS) // buckets for i in range(1, buckets)], U)


def block_counts(b: Block, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's distinct keys in order with its own counts; the first one
    counts its words."""
    keys, counts = np.unique(np.concatenate([b.keys(n)[1] for n in range(1, order + 1)]), return_counts=True)
    return np.concatenate([[TOTAL], keys]), np.concatenate([[len(b.words)], counts]).astype(np.int64)


def parts_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin, and the end."""
    return np.concatenate([[0], np.searchsorted(keys, edges(buckets)), [len(keys)]])


def check_of(keys: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(keys).astype(np.int64))


def requests(order: int, buckets: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, data, off in cut_blocks(batches, block_bytes):
            keys, counts = block_counts(words_of(data, off), order)
            cut = parts_of(keys, buckets)
            rows = [(i, block, check_of(keys[a:b]), pack(keys[a:b]), squeeze(counts[a:b]))
                    for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                             ["bucket", "block", "check", "keys", "counts"])
    return run


ANSWERS = "block long, bucket int, check long, places binary, sums binary"


def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums each bucket's counts over its blocks (rows come sorted by bucket)
    and answers every row with the places of its keys whose sum is not the
    block's own count, and the sums."""
    from riskframe.llm.jaccard import whole_groups
    for t, at in whole_groups(batches, 1):
        block, bucket, check = (t.column(c).to_pylist() for c in ("block", "bucket", "check"))
        for lo, hi in zip(at, [*at[1:], t.num_rows], strict=True):
            keys = [unpack(t.column("keys")[i].as_py()) for i in range(lo, hi)]
            counts = [spread(t.column("counts")[i].as_py(), np.int64) for i in range(lo, hi)]
            table, inv = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.zeros(len(table), np.int64)
            np.add.at(sums, inv, np.concatenate(counts))
            stop = np.cumsum([len(k) for k in keys])
            for i, b, own in zip(range(lo, hi), stop, counts, strict=True):
                total = sums[inv[b - len(own):b]]
                places = np.flatnonzero(total != own)
                yield pa.RecordBatch.from_arrays([
                    pa.array([block[i]], pa.int64()), pa.array([bucket[i]], pa.int32()), pa.array([check[i]], pa.int64()),
                    pa.array([squeeze(np.diff(places, prepend=0).astype(np.int32))], pa.binary()), pa.array([squeeze(total[places])], pa.binary())],
                    ["block", "bucket", "check", "places", "sums"])


DOCS = "block long, ids array<long>, off array<long>, texts binary"


def documents_of(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, data, off in cut_blocks(batches, block_bytes):
            yield pa.RecordBatch.from_arrays([
                pa.array([block]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([off.tolist()], pa.list_(pa.int64())),
                pa.array([zstandard.ZstdCompressor(level=TEXT_LEVEL).compress(data.tobytes())], pa.binary())], ["block", "ids", "off", "texts"])
    return run


def own_counts(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often each key occurs in its own document."""
    salt = mix(np.arange(1, (doc.max() if len(doc) else 0) + 2, dtype=U))
    _, inv, c = np.unique(mix(key ^ salt[doc]), return_inverse=True, return_counts=True)
    return c[inv]


def score_block(b: Block, order: int, alpha: float, lookup) -> tuple[np.ndarray, np.ndarray]:
    """(sum of log scores, words scored at the highest order) per document.
    ``lookup(keys)`` gives corpus counts."""
    m = len(b.words)
    words = np.diff(b.bounds)
    rest = float(lookup(np.array([TOTAL], U))[0]) - words[b.doc]
    at, key = b.keys(1)
    c1 = lookup(key) - own_counts(b.doc, key)
    score = np.where(c1 > 0, np.log(np.maximum(c1, 1)) - np.log(np.maximum(rest, 1)), -np.log(rest + 1))
    level = np.ones(m, np.int64)
    before, before_at = c1.astype(float), np.arange(m)
    for n in range(2, order + 1):
        # words without that much context stay as they are
        at, key = b.keys(n)
        c = (lookup(key) - own_counts(b.doc[at], key)).astype(float)
        context = np.zeros(m)
        context[before_at] = before
        last = at + n - 1
        h = context[at]
        score[last] = np.where(c > 0, np.log(np.maximum(c, 1)) - np.log(np.maximum(h, 1)), score[last] + np.log(alpha))
        level[last] = np.where(c > 0, n, level[last])
        before, before_at = c, at
    docs = len(b.bounds) - 1
    return (np.bincount(b.doc, weights=score, minlength=docs), np.bincount(b.doc[level == order], minlength=docs))


SCORED = "doc_id long, n_words long, n_top long, log_score double, mean_log_score double"


def scored(order: int, alpha: float, buckets: int):
    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in SCORED.split(", ")]
        if not block.num_rows:
            raise RuntimeError(ANOTHER_ORDER)
        off = block.column("off")[0].values.to_numpy()
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(block.column("texts")[0].as_py(), max_output_size=int(off[-1])), np.uint8)
        b = words_of(data, off)
        table, counts = block_counts(b, order)
        cut = parts_of(table, buckets)
        if told.num_rows != int((np.diff(cut) > 0).sum()):
            raise RuntimeError(ANOTHER_ORDER)
        for bucket, check, places, sums in zip(*(told.column(c).to_pylist() for c in ("bucket", "check", "places", "sums")), strict=True):
            if check_of(table[cut[bucket]:cut[bucket + 1]]) != check:
                raise RuntimeError(ANOTHER_ORDER)
            counts[cut[bucket] + np.cumsum(spread(places, np.int32))] = spread(sums, np.int64)
        s, top = score_block(b, order, alpha, lambda keys: counts[np.searchsorted(table, keys)])
        n = np.diff(b.bounds)
        mean = np.divide(s, n, out=np.zeros(len(n)), where=n > 0)
        return pa.Table.from_arrays([block.column("ids")[0].values, pa.array(n), pa.array(top, pa.int64()), pa.array(s, pa.float64()),
                                     pa.array(mean, pa.float64(), mask=n == 0)], names)
    return run


ANOTHER_ORDER = "the documents were not read again in the same order; pass stable=False"


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA,
                   block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, stable: bool = True) -> DataFrame:
    """doc_id, n_words, ``n_top`` (words scored at the highest order), the
    summed log score and its mean per word."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not stable:
        d = saved(d)
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    d = d.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    asked = d.mapInArrow(requests(order, buckets, block_bytes), "bucket int, block long, check long, keys binary, counts binary")
    told = asked.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "block").mapInArrow(answers, ANSWERS)
    blocks = d.mapInArrow(documents_of(block_bytes), DOCS)
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(scored(order, alpha, buckets), SCORED)
