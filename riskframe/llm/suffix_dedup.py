"""Exact substring dedup: removes every byte covered by a 400-byte string
that also starts elsewhere in the corpus.

The corpus-wide suffix order is needed only among strings that can be equal,
so it is built in pieces that are independent of each other:

1.  Anchors.  Of the 32-byte grams in a 400-byte string the one with the
    smallest hash (the leftmost of equals) is its anchor.  Equal strings have
    equal anchors at equal offsets, and each string has one, so strings are
    compared only under a common anchor hash.  A row stands for all strings
    of one anchor, with a digest of the text they span: about one row per
    190 bytes.
2.  Anchors whose digest occurs twice are repeated as a whole.  The others,
    if their hash occurs with other digests, lie at the border of a repeat.
3.  At a border, strings whose starts fall in the same 32 offsets share a
    core of 369 bytes; rows are grouped by it.  In a group the texts differ in
    at most 31 bytes on either side, and the suffix array of the group, with
    the core as one symbol, shows by common prefixes which of its strings
    occur twice.
4.  Groups above ``GROUP`` members are answered exactly by counting each of
    their 32 strings, with no group held together.
5.  Ranges return to their documents and are cut out.

Defined results: a null text is empty; repeated rows are different documents,
so a text of 400 bytes or more that occurs in two rows is removed from both;
texts are taken whole; all strings are judged on the input; an empty table
gives an empty result; ids are cast to long; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import U, Rolling, frugal, row_key, saved, text_blocks
from riskframe.llm.jaccard import whole_groups
from riskframe.llm.suffix_array import common_prefixes, suffix_array

LENGTH = 400
GRAM = 32
CHUNK = 32
GROUP = 256
SLICE = 1 << 22
PLACE = U((1 << 24) - 1)

# distances from the anchor take 9 bits of a place
MOST_LENGTH = GRAM + (1 << 9) - 1
# place: anchor << 18 | (anchor - first start) << 9 | (anchor - last start)
ANCHORS = "k_row long, k_text long, h long, g long, place long"


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive entries, from running minima of
    blocks of ``w`` in both directions."""
    n = len(x) - w + 1
    pad = -len(x) % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1:w - 1 + n])


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM, starts: int = SLICE):
    """(document, anchor, first start, last start, gram hash) of all strings
    of ``length`` bytes in a block; long blocks go in slices of ``starts``
    starts, and a run of one anchor that a slice ends in stays one row."""
    docs = []
    total = len(data)
    for lo in range(0, max(total - length + 1, 0), starts):
        part = data[lo:lo + starts + length - 1]
        n = len(part) - length + 1
        h = Rolling(part).windows(gram)
        key = (h & ~PLACE) | np.arange(len(h), dtype=U)
        p = (window_minima(key, length - gram + 1) & PLACE).astype(np.int64)
        s = np.arange(n)
        # starts whose string stays in one document
        doc = np.searchsorted(off, s + lo, "right") - 1
        ok = s + lo + length <= off[doc + 1]
        first = ok.copy()
        first[1:] &= ~ok[:-1] | (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])
        a = np.flatnonzero(first)
        if not len(a):
            continue
        last = ok.copy()
        last[:-1] &= ~ok[1:] | (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])
        b = np.flatnonzero(last)
        docs.append((doc[a], p[a] + lo, a + lo, b + lo, h[p[a]]))
    if not docs:
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, U)
    doc, p, a, b, g = (np.concatenate([d[k] for d in docs]) for k in range(5))
    first = np.ones(len(a), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (p[1:] != p[:-1]) | (a[1:] != b[:-1] + 1)
    return doc[first], p[first], a[first], b[np.append(first[1:], True)], g[first]


def anchor_rows(length: int, starts: int = SLICE):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            for r0, r1, data, off in text_blocks(batch.column(2)):
                doc, p, lo, hi, h = anchors(data, off, length, starts=starts)
                if not len(doc):
                    continue
                raw = memoryview(np.ascontiguousarray(data))
                blake = hashlib.blake2b
                dig = b"".join(blake(raw[a:b], digest_size=8, salt=int(c).to_bytes(2, "little")).digest()
                               for a, b, c in zip(lo.tolist(), (hi + length).tolist(), (p - lo).tolist(), strict=True))
                at = p - off[doc]
                place = (at << 18) | ((p - lo) << 9) | (p - hi)
                keys = [batch.column(c).slice(r0, r1 - r0).take(pa.array(doc)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(h.view(np.int64)), pa.array(np.frombuffer(dig, "<i8")), pa.array(place)],
                    ["k_row", "k_text", "h", "g", "place"])
    return run


BORDERS = "q1 long, q2 long, l binary, r binary, k_row long, k_text long, core long, known boolean"


def border_rows(length: int):
    """For each wanted anchor of a document, one row per 32 offsets: digest
    of the core, the bytes on either side, where the core starts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            rows: list[tuple] = []
            size = 0
            for k_row, k_text, text, want in zip(*(batch.column(c) for c in range(4)), strict=True):
                raw = (text.as_py() or "").encode()
                k_row, k_text = k_row.as_py(), k_text.as_py()
                for w in want.as_py():
                    p, far, near = w["place"] >> 18, (w["place"] >> 9) & 511, w["place"] & 511
                    for c in range(near // CHUNK, far // CHUNK + 1):
                        core = p - CHUNK * c
                        end = core - (CHUNK - 1) + length
                        q = hashlib.blake2b(raw[core:end], digest_size=16, salt=c.to_bytes(2, "little")).digest()
                        rows.append((int.from_bytes(q[:8], "little", signed=True), int.from_bytes(q[8:], "little", signed=True),
                                     raw[max(core - (CHUNK - 1), 0):core], raw[end:end + CHUNK - 1], k_row, k_text, core, w["n"] > 1))
                size = len(rows)
                if size > 50_000:
                    yield _border_batch(rows)
                    rows = []
            if rows:
                yield _border_batch(rows)
    return run


def _border_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["q1", "q2", "l", "r", "k_row", "k_text", "core", "known"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


CORE, SEPARATOR = 300, 1


def repeated_strings(members: list[tuple[bytes, bytes]], chunk: int = CHUNK) -> list[set[int]]:
    """For each (left, right) of a group, which x are repeated, where x is
    the number of left bytes in the string ``left[-x:] + core +
    right[:chunk-1-x]``.  The members are different."""
    s: list[int] = []
    begin, core = [], []
    for left, right in members:
        begin.append(len(s))
        s.extend(b + 2 for b in left)
        core.append(len(s))
        s.append(CORE)
        s.extend(b + 2 for b in right)
        s.append(SEPARATOR)
    s.append(0)
    sa = suffix_array(s)
    lcp = common_prefixes(s, sa, SEPARATOR)
    owner = [0] * len(s)
    for m, b in enumerate(begin):
        for i in range(b, core[m] + 1):
            owner[i] = m + 1
    out: list[set[int]] = [set() for _ in members]
    for k in range(1, len(sa)):
        # chunk symbols that include the core are `length` bytes
        if lcp[k] >= chunk:
            for i in (sa[k - 1], sa[k]):
                m = owner[i] - 1
                if m >= 0 and core[m] - i < chunk:
                    out[m].add(core[m] - i)
    return out


def runs_of(xs: set[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x in sorted(xs):
        if out and x == out[-1][1] + 1:
            out[-1] = (out[-1][0], x)
        else:
            out.append((x, x))
    return out


def group_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(q1, q2, l, r, x0, x1): repeated strings of each group, by its suffix
    array; a member that occurs twice is repeated as a whole."""
    for t, at in whole_groups(batches, 2):
        q1, q2, l, r, n = (t.column(c).to_pylist() for c in ("q1", "q2", "l", "r", "n"))
        rows = []
        for lo, hi in zip(at, [*at[1:], t.num_rows], strict=True):
            members = list(zip(l[lo:hi], r[lo:hi], strict=True))
            found = repeated_strings(members) if hi - lo > 1 else [set()]
            for k, xs in enumerate(found):
                i = lo + k
                if n[i] > 1:
                    xs = xs | {x for x in range(CHUNK) if x <= len(l[i]) and CHUNK - 1 - x <= len(r[i])}
                rows.extend((q1[i], q2[i], l[i], r[i], a, b) for a, b in runs_of(xs))
        cols = zip(*rows, strict=True) if rows else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["q1", "q2", "l", "r", "x0", "x1"])


def counted_ranges(members: DataFrame) -> DataFrame:
    """The same for groups of any size, by counting every string."""
    m = members.select("q1", "q2", "l", "r", "n", F.explode(F.sequence(F.lit(0), F.lit(CHUNK - 1))).alias("x0"))
    m = m.where((F.octet_length("l") >= F.col("x0")) & (F.octet_length("r") >= CHUNK - 1 - F.col("x0")))
    m = m.withColumn("string", F.concat(F.expr("substring(l, octet_length(l) - x0 + 1, x0)"), F.expr(f"substring(r, 1, {CHUNK - 1} - x0)")))
    twice = m.groupBy("q1", "q2", "x0", "string").agg(F.sum("n").alias("total")).where("total > 1")
    return m.join(twice, ["q1", "q2", "x0", "string"]).select("q1", "q2", "l", "r", "x0", F.col("x0").alias("x1"))


def repeat_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP,
                  starts: int = SLICE) -> DataFrame:
    """(k_row, k_text, s, e): byte ranges covered by repeated strings; they
    may overlap."""
    text = docs.select(*row_key(text_col, id_col), F.col(text_col).cast("string").alias("text"))
    a = saved(text.mapInArrow(anchor_rows(length, starts), ANCHORS))
    # a hot hash is split over tasks by the join: both its sides are plain tables
    often = saved(a.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"))
    a = saved(a.join(often, "h"))
    by_digest = saved(a.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k_row", "k_text", "place")).alias("rep")))
    far = F.shiftright("place", 9).bitwiseAND(511)
    p = F.shiftright("place", 18)
    whole = (a.join(by_digest.where("n > 1").select("h", "g"), ["h", "g"])
             .select("k_row", "k_text", (p - far).alias("s"), (p - F.col("place").bitwiseAND(511) + length).alias("e")))

    # borders: under one hash several digests, one of them found once
    mixed = saved(by_digest.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least")).where("c > 1 and least = 1").select("h"))
    wanted = (by_digest.join(mixed, "h").select("rep.*", "n")
              .groupBy("k_row", "k_text").agg(F.collect_list(F.struct("place", "n")).alias("want")))
    held = (text.join(wanted, ["k_row", "k_text"]).groupBy("k_row", "k_text")
            .agg(F.first("text").alias("text"), F.first("want").alias("want")))
    b = held.select("k_row", "k_text", "text", "want").mapInArrow(border_rows(length), BORDERS)
    b = saved(b)
    shared = saved(b.groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("q1", "q2"))
    b = saved(b.join(shared, ["q1", "q2"]))
    members = b.groupBy("q1", "q2", "l", "r").agg(F.sum(F.when(F.col("known"), 2).otherwise(1)).alias("n"))
    sizes = members.groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("size"))
    members = saved(members.join(sizes, ["q1", "q2"]))
    ordered = (members.where(F.col("size") <= group).drop("size").repartition("q1", "q2").sortWithinPartitions("q1", "q2"))
    found = ordered.mapInArrow(group_ranges, "q1 long, q2 long, l binary, r binary, x0 int, x1 int")
    found = found.union(counted_ranges(members.where(F.col("size") > group)))
    border = (b.where("not known").join(found, ["q1", "q2", "l", "r"])
              .select("k_row", "k_text", (F.col("core") - F.col("x1")).alias("s"), (F.col("core") - F.col("x0") + length).alias("e")))
    return whole.union(border)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges a document's ranges and cuts them out."""
    for batch in frugal(batches):
        for r0, r1, data, off in text_blocks(batch.column(1)):
            raw = memoryview(np.ascontiguousarray(data))
            spans, kept = [], []
            ranges = batch.column(2).slice(r0, r1 - r0)
            for d in range(r1 - r0):
                own, x = [], ranges[d]
                if x.is_valid:
                    v = x.values
                    s, e = v.field(0).to_numpy(), v.field(1).to_numpy()
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.maximum.accumulate(e[order])
                    new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
                    own = list(zip(s[new].tolist(), e[np.append(new[1:] - 1, len(e) - 1)].tolist(), strict=True))
                at, parts = int(off[d]), []
                for a, b in own:
                    parts.append(raw[at:off[d] + a])
                    at = int(off[d]) + b
                parts.append(raw[at:off[d + 1]])
                kept.append(b"".join(parts))
                spans.append([{"start": a, "end": b} for a, b in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(r0, r1 - r0), pa.array(np.diff(off)),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP,
                   starts: int = SLICE) -> DataFrame:
    """One row per document: id, size in bytes, the maximal removed spans
    (byte offsets) and the remaining bytes.  ``length`` is 64 to
    ``MOST_LENGTH`` bytes."""
    if not 2 * GRAM <= length <= MOST_LENGTH:
        raise ValueError(f"length must be {2 * GRAM} to {MOST_LENGTH} bytes")
    ranges = (repeat_ranges(docs, id_col, text_col, length, group, starts).groupBy("k_row", "k_text")
              .agg(F.collect_set(F.struct("s", "e")).alias("ranges")))
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(text_col, id_col), F.col(text_col).cast("string").alias("text"))
    return (text.join(ranges, ["k_row", "k_text"], "left").select("doc_id", "text", "ranges")
            .mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"))
