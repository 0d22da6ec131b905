"""Packing token ids into sequences: first-fit decreasing over a tournament
tree of bin capacities, run independently in randomised groups.

A document's ids plus one end id are cut into pieces of ``SEQUENCE`` ids and
one rest.  Documents go to groups by a hash of their ids and their place in
the task that encodes them, so equal rows do not meet in one group; the
number of groups follows the number of pieces, so a group is bounded
whatever the corpus size.  Inside a group pieces are placed longest first
into the leftmost bin that has room.

Defined results: a null or empty text is one piece holding the end id;
repeated rows are packed one by one; ties in length are placed by document
id and start; a text of any length is cut whole; an empty table gives an
empty result; ids are cast to long; other columns are ignored.
"""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import tokens
from riskframe.llm.common import U, frugal, mix, saved

SEQUENCE = 2048
GROUP_PIECES = 8192

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class TournamentTree:
    """Room left in each bin, with the larger of two children above them:
    the leftmost bin with enough room is found in one descent."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < bins:
            self.leaves *= 2
        self.most = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Puts ``size`` into the first bin with room: (bin, room before)."""
        most, i = self.most, 1
        while i < self.leaves:
            i *= 2
            if most[i] < size:
                i += 1
        room = most[i]
        most[i] = room - size
        at = i - self.leaves
        while i > 1:
            i //= 2
            top = max(most[2 * i], most[2 * i + 1])
            if most[i] == top:
                break
            most[i] = top
        return at, room


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset in it) for sizes in descending order, none above
    ``capacity``."""
    tree = TournamentTree(len(sizes), capacity)
    bins, offsets = [], []
    for s in sizes:
        at, room = tree.place(s)
        bins.append(at)
        offsets.append(capacity - room)
    return bins, offsets


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           tokenizer: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece: where it starts in its document's ids, its length
    and the checksum of its ids."""
    path = tokenizer or tokens.tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        seen = 0
        for batch in frugal(batches):
            for a, b, ids, off in enc.blocks(batch.column(1)):
                n = np.diff(off) + 1
                # the ids with one end id after each document
                whole = np.full(len(ids) + (b - a), tokens.END_ID, np.uint32)
                keep = np.ones(len(whole), bool)
                last = np.cumsum(n) - 1
                keep[last] = False
                whole[keep] = ids
                per = (n + sequence - 1) // sequence
                doc = np.repeat(np.arange(b - a), per)
                first = np.repeat(np.cumsum(per) - per, per)
                start = (np.arange(len(doc)) - first) * sequence
                length = np.minimum(sequence, n[doc] - start)
                begin = (last - n + 1)[doc] + start
                raw = memoryview(whole.astype("<u4").tobytes())
                crc = np.array([zlib.crc32(raw[4 * i:4 * (i + k)]) for i, k in zip(begin, length, strict=True)], np.int64)
                # one salt for all pieces of a document: its first checksum and its place
                head = crc[np.cumsum(per) - per].astype(U)
                salt = mix(mix(head + U(1)) + np.arange(seen, seen + b - a, dtype=U)) >> U(1)
                seen += b - a
                yield pa.RecordBatch.from_arrays([
                    pc_take(batch.column(0).slice(a, b - a), doc), pa.array(start), pa.array(length), pa.array(crc),
                    pa.array(n[doc]), pa.array(salt[doc].astype(np.int64))],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, PIECES)


def pc_take(arr: pa.Array, at: np.ndarray) -> pa.Array:
    return arr.take(pa.array(at))


def pack_group(sequence: int) -> Callable:
    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["length", "doc_id", "start", "salt"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(g["length"].tolist(), sequence)
        g = g.assign(sequence_id=np.array(bins, np.int64) + (int(key[0]) << 32), offset=np.array(offsets, np.int64))
        return g[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]
    return pack


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces of all documents with their sequence and offset.  Sequence ids
    are ``group * 2**32 + bin``; offsets in a sequence run from 0 gapless."""
    p = saved(pieces(docs, id_col, text_col, tokenizer, sequence))
    groups = max(1, -(-p.count() // group_pieces))
    p = p.withColumn("g", F.pmod("salt", F.lit(groups)))
    return p.groupBy("g").applyInPandas(pack_group(sequence), PACKED)
