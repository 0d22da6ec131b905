"""Fill-in-middle transformation over a compressed set of line ends.

A text is cut into units (a line with its newline, or what follows the last
newline).  The unit ends of a block of texts are one sorted set of byte
offsets, held as containers of 2**16 offsets each: a sorted array, a bitmap
or a list of runs, whichever is smallest.  Cumulative cardinalities over the
containers turn "the end of unit k" into a search for the container and a
select inside it; both cut offsets of all texts of a block are looked up
together.

Prefix, middle and suffix are then written as suffix-prefix-middle or
prefix-suffix-middle with three marks, chosen by a hash of the document id;
:func:`restored` undoes it from the output and its form alone.

Defined results: a null text is an empty one; an empty text, a text that
contains a mark, and a share ``100 - rate`` of the others stay plain (their
cut lengths are null); a null id hashes as the empty string; repeated rows
get the same result each; texts of any length are cut whole; an empty table
gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import frugal, text_blocks

# fixed values: marks of prefix, suffix and middle, seed of the id hash
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
RATE = 100
SPM = 50

ARRAY_MOST = 4096
BITMAP_BYTES = 8192
CUT = "doc_id {id}, n long, form string, prefix_chars long, middle_chars long, output string"


class ArrayContainer:
    def __init__(self, low: np.ndarray):
        self.low = low

    def select(self, k: np.ndarray) -> np.ndarray:
        return self.low[k].astype(np.int64)


class BitmapContainer:
    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << 16, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little")
        per = np.bitwise_count(self.words).astype(np.int64)
        self.upto = np.concatenate([[0], np.cumsum(per)])

    def select(self, k: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.upto, k, "right") - 1
        bits = np.unpackbits(self.words[at][:, None], axis=1, bitorder="little")
        rank = np.cumsum(bits, axis=1)
        # the place where the (k - upto + 1)-th one stands
        return at * 8 + np.argmax(rank > (k - self.upto[at])[:, None], axis=1)


class RunContainer:
    def __init__(self, low: np.ndarray, first: np.ndarray):
        self.start = low[first].astype(np.int64)
        self.upto = np.append(first, len(low)).astype(np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.upto, k, "right") - 1
        return self.start[run] + k - self.upto[run]


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container for sorted 16-bit values: 2 bytes a value, 4 a
    run, or a bitmap of 8 KiB."""
    first = np.concatenate([[0], np.flatnonzero(np.diff(low.astype(np.int64)) != 1) + 1])
    plain = 2 * len(low) if len(low) <= ARRAY_MOST else BITMAP_BYTES
    if 4 * len(first) < plain:
        return RunContainer(low, first)
    return ArrayContainer(low) if len(low) <= ARRAY_MOST else BitmapContainer(low)


class BoundarySet:
    """A set of offsets in containers by their high bits, with the number of
    members before each container."""

    def __init__(self, values: np.ndarray):
        high = values >> 16
        first = np.flatnonzero(np.diff(high, prepend=-1)) if len(values) else np.zeros(0, np.int64)
        self.high = high[first]
        self.before = np.append(first, len(values)).astype(np.int64)
        low = (values & 0xFFFF).astype(np.uint16)
        self.parts = [container(low[a:b]) for a, b in zip(self.before[:-1], self.before[1:], strict=True)]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest members (from 0)."""
        out = np.zeros(len(k), np.int64)
        where = np.searchsorted(self.before, k, "right") - 1
        for c in np.unique(where):
            mine = where == c
            out[mine] = (int(self.high[c]) << 16) + self.parts[c].select(k[mine] - self.before[c])
        return out


def unit_ends(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end offsets of all units of a block, number of ends before each
    text): an end follows each newline, and closes each text that is not
    empty and does not end in one."""
    ends = np.flatnonzero(data == 0x0A) + 1
    full = off[1:] > off[:-1]
    last = off[1:][full]
    open_end = last[data[last - 1] != 0x0A]
    ends = np.sort(np.concatenate([ends, open_end]))
    return ends, np.searchsorted(ends, off, "right")


def cut_offsets(data: np.ndarray, off: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, end of the prefix, end of the middle) of each text, the last
    two as byte offsets in the block."""
    ends, before = unit_ends(data, off)
    n = np.diff(before)
    a, b = h1 % (n + 1), h2 % (n + 1)
    index = BoundarySet(ends)
    at = []
    for units in (np.minimum(a, b), np.maximum(a, b)):
        cut = off[:-1].copy()
        some = units > 0
        cut[some] = index.select(before[:-1][some] + units[some] - 1)
        at.append(cut)
    return n, at[0], at[1]


def hashes(doc: str = "doc_id", seed: int = SEED) -> list[Column]:
    """Four unsigned integers from the id: the first 8-digit groups of a
    SHA-256."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """Per document: id, units, form (``plain``, ``spm`` or ``psm``), code
    points of prefix and middle, and the output text."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            h = [np.asarray(batch.column(2 + i).to_numpy(zero_copy_only=False), np.int64) for i in range(4)]
            for a, b, data, off in text_blocks(batch.column(1)):
                n, first, second = cut_offsets(data, off, h[0][a:b], h[1][a:b])
                upto = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=upto[1:])
                raw = data.tobytes()
                out, form = [], []
                for i in range(b - a):
                    s, e = int(off[i]), int(off[i + 1])
                    whole = raw[s:e]
                    if not whole or any(m in whole for m in marks) or h[2][a + i] % 100 >= rate:
                        form.append("plain")
                        out.append(whole)
                        continue
                    p, m = int(first[i]), int(second[i])
                    head, mid, tail = raw[s:p], raw[p:m], raw[m:e]
                    if h[3][a + i] % 100 < spm:
                        form.append("spm")
                        out.append(marks[1] + tail + marks[0] + head + marks[2] + mid)
                    else:
                        form.append("psm")
                        out.append(marks[0] + head + marks[1] + tail + marks[2] + mid)
                plain = np.array([f == "plain" for f in form])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                    pa.array(upto[first] - upto[off[:-1]], pa.int64(), mask=plain), pa.array(upto[second] - upto[first], pa.int64(), mask=plain),
                    pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", "text", *hashes(seed=seed))
    return d.mapInArrow(cut, CUT.format(id=kind))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output of :func:`transform` was made from.  A mark
    occurs in no cut text and cannot begin inside one and end in the next
    mark, so the first place of each mark is the mark."""
    k = len(PREFIX)

    def parts(second: str) -> tuple[Column, Column, Column]:
        body = F.substr(F.col(output), F.lit(k + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.char_length(one) + F.lit(k + 1))
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.char_length(two) + F.lit(k + 1))

    head, tail, mid = parts(SUFFIX)
    tail2, head2, mid2 = parts(PREFIX)
    return (F.when(F.col(form) == "psm", F.concat(head, mid, tail))
            .when(F.col(form) == "spm", F.concat(head2, mid2, tail2)).otherwise(F.col(output)))
