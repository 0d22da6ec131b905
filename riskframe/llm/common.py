"""Vectorised text helpers used inside Arrow tasks, and small plan helpers.

Texts are handled as UTF-8 bytes in blocks of bounded size: a block is one
contiguous byte array with document offsets, so a task's memory depends on
the block size (or on one document, when that is longer), never on the
partition.
"""
from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: its memory stays with the process
    _LIBC = None

U = np.uint64
BLOCK_BYTES = 1 << 19
BLOOM_BITS = 26

# bytes that separate words: space, \t \n \v \f \r
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift multiply): every input bit reaches
    every output bit."""
    x = np.asarray(x, U).copy()
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        p = np.full(max(n, BLOCK_BYTES + 1), base, U)
        p[0] = 1
        _POWERS[name] = have = np.multiply.accumulate(p)
    return have[:n]


class Rolling:
    """Hashes of byte spans of one array in O(1) each, from prefix sums of
    ``table[byte] * base**position`` modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, U)
        np.cumsum(_BYTE[data] * _powers("up", _BASE, n), out=self.prefix[1:])
        self.n = n

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inv = _powers("down", _INV, self.n + 1)
        h = (self.prefix[end] - self.prefix[start]) * inv[start]
        return mix(h + (end - start).astype(U) * U(0x9E3779B97F4A7C15))

    def windows(self, k: int) -> np.ndarray:
        """Hash of ``[i, i + k)`` for every i."""
        n = self.n - k + 1
        if n <= 0:
            return np.zeros(0, U)
        return mix((self.prefix[k:] - self.prefix[:n]) * _powers("down", _INV, self.n + 1)[:n])


def text_blocks(arr: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into ``(first row, end row, bytes, offsets)``
    blocks of about ``max_bytes``; a null is an empty text.  A longer
    document is a block of its own and always whole."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    n = len(arr)
    if n == 0:
        return
    wide = pa.types.is_large_string(arr.type)
    _, off, buf = arr.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset:arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + max_bytes, "right")) - 1)
        b = min(b, n)
        yield a, b, data[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document index) of the maximal runs of bytes outside
    :data:`SPACE`; a run never crosses a document end."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~SPACE[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    edge = off[1:-1]
    edge = edge[edge < n]
    first[edge] = ink[edge]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    cut = edge[edge > 0] - 1
    last[cut] = ink[cut]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of ``words[i:i+n]`` for every i (order-sensitive)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = words[:m].copy()
    for j in range(1, n):
        out *= U(_BASE)
        out += words[j:j + m]
    return mix(out)


def per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each ``[off[d], off[d+1])``."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key occurs at least twice, key occurs earlier) for each entry."""
    n = len(keys)
    twice, later = np.zeros(n, bool), np.zeros(n, bool)
    if n > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        later[order[1:]] = same
        twice[order[1:]] = same
        twice[order[:-1]] |= same
    return twice, later


def frugal(batches: Iterator) -> Iterator:
    """The batches of a task; memory freed while one was worked on goes back
    to the system before the next, so that idle workers stay small."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if _LIBC is not None:
            _LIBC.malloc_trim(0)


def row_key(text: str = "text", doc: str = "doc_id") -> list:
    """``k_row, k_text``: the key of a document row, 128 bits over id and
    text, never null.  Rows that agree in both are interchangeable; two
    texts under one id (or under a null id) stay apart."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(F.col(doc), t).alias("k_row"), F.xxhash64(t).alias("k_text")]


def saved(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (cuts the lineage)."""
    from riskframe.session import cut_lineage
    return cut_lineage(df)


def bloom(hashes: DataFrame, column: str) -> bytes:
    """The filter of a column of hashes: ``2**BLOOM_BITS`` bits, whatever the
    number of hashes."""
    h = F.col(column)
    first = F.shiftrightunsigned(h, 64 - BLOOM_BITS)
    second = F.shiftrightunsigned(h, 8).bitwiseAND(F.lit((1 << BLOOM_BITS) - 1))
    b = hashes.select(F.explode(F.array(first, second)).alias("b"))
    rows = b.groupBy(F.shiftright("b", 3).alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(b & 7 AS int)))").alias("v"))
    held = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
    # at most one short row per byte of the filter
    t = rows.toArrow()
    held[t.column("byte").to_numpy()] = t.column("v").to_numpy().astype(np.uint8)
    return held.tobytes()


def only_held(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose 64-bit ``column`` may be among ``keys``, which has it
    too: all that are and, by a Bloom filter, few others.  For a table of
    texts before it is moved to join a smaller one."""
    bits = df.sparkSession.sparkContext.broadcast(bloom(keys, column))

    @F.arrow_udf("boolean")
    def may_hold(hashes: pa.Array) -> pa.Array:
        h = hashes.to_numpy(zero_copy_only=False).view(U)
        held = np.frombuffer(bits.value, np.uint8)
        ok = np.ones(len(h), bool)
        for b in (h >> U(64 - BLOOM_BITS), (h >> U(8)) & U((1 << BLOOM_BITS) - 1)):
            ok &= (held[b >> U(3)] >> (b & U(7)).astype(np.uint8)) & 1 == 1
        return pa.array(ok)

    return df.where(may_hold(F.col(column)))
