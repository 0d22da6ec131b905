"""How document filters interact: what each removes in every order.

One pass of a finite-state byte transducer over a block of UTF-8 texts emits
an action per byte (word begins, word ends, code point, capital, symbol)
from a table indexed by state and byte.  The word spans it emits are
inserted into an open-addressing hash table whose matches are verified byte
by byte, which counts the different words of each text exactly.  From the
counts follow the failures of filters A to D; filter E (an equal text under
a smaller id) comes from one aggregate over text digests.

Documents then collapse to cells (part, set of failed filters, labels), at
most 32 x 4 a part, and the audit of all orders is computed from the cells.

Defined results: a null text is an empty one; a null part is the empty
string; a row with a null id is never a copy, nor is it the smaller one of
another row; rows equal in id and text are the same document seen twice,
and none of them is a copy of the other; an id labelled more than once has
a label if any of its rows has it; texts are read whole; an empty table
gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import SPACE, U, Rolling, frugal, mix, per_doc, saved, text_blocks

# fixed values: filters in the order of their bits, limits, symbol set
FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 3
SYMBOLS = "#$%&*|"

GAP, WORD = 0, 1
BEGIN, END, POINT, CAPITAL, SYMBOL = 1, 2, 4, 8, 16
COUNTS = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")
SCANNED = "doc_id {id}, part string, digest binary, " + ", ".join(f"{c} long" for c in COUNTS)


def transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, actions) by ``state * 256 + byte``.  A word ends where
    its state meets white space, so its last byte needs no look-ahead."""
    byte = np.arange(256)
    step = np.tile(np.where(SPACE, GAP, WORD), 2)
    act = np.zeros((2, 256), np.uint8)
    act[GAP, ~SPACE] |= BEGIN
    act[WORD, SPACE] |= END
    act[:, (byte & 0xC0) != 0x80] |= POINT
    act[:, ord("A"):ord("Z") + 1] |= CAPITAL
    act[:, list(SYMBOLS.encode())] |= SYMBOL
    return step.astype(np.uint16), act.reshape(-1)


STEP, ACT = transducer()


def transduce(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The action at every byte of a block; each text starts between words.
    The next state of this machine depends on the byte alone, so the states
    of a whole block are one lookup of the bytes before."""
    if not len(data):
        return np.zeros(0, np.uint8)
    state = np.zeros(len(data), np.uint16)
    state[1:] = STEP[data[:-1]]
    first = off[:-1]
    state[first[first < len(data)]] = GAP
    return ACT[(state << 8) | data]


def spans_of(act: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of the words that the actions mark; a word
    still open at the end of its text ends there."""
    starts = np.flatnonzero(act & BEGIN)
    ends = np.flatnonzero(act & END)
    last = off[1:][off[1:] > off[:-1]]
    ends = np.sort(np.concatenate([ends, last[~SPACE[data[last - 1]]]]))
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def eight(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number (zeros after the end)."""
    pad = np.zeros(len(data) + 8, U)
    pad[:len(data)] = data
    out = np.zeros(len(data) + 1, U)
    for i in range(8):
        out |= pad[i:i + len(out)] << U(8 * i)
    return out


def same_bytes(a: np.ndarray, b: np.ndarray, length: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Whether the spans of equal ``length`` at ``a`` and ``b`` hold the same
    bytes, 8 at a time."""
    same = np.ones(len(a), bool)
    live = np.arange(len(a))
    done = 0
    while len(live):
        left = length[live] - done
        mask = np.where(left >= 8, ~U(0), (U(1) << (U(8) * np.minimum(left, 7).astype(U))) - U(1))
        ok = ((window[a[live] + done] ^ window[b[live] + done]) & mask) == 0
        same[live[~ok]] = False
        live = live[ok & (left > 8)]
        done += 8
    return same


class SpanTable:
    """Open addressing over the words of a block.  A slot holds the word that
    took it first; a later word joins it if document, length and bytes
    agree, and tries the next slot if not."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray):
        n = len(starts)
        self.owner = np.arange(n)
        if not n:
            return
        length = ends - starts
        slots = 1 << max(4, (2 * n - 1).bit_length())
        key = mix(Rolling(data).spans(starts, ends) + mix(doc.astype(U) + U(1)))
        slot = (key & U(slots - 1)).astype(np.int64)
        held = np.full(slots, -1, np.int64)
        window = eight(data)
        todo = np.arange(n)
        while len(todo):
            at = slot[todo]
            free = held[at] < 0
            # of several claims the one written last stays: the first word
            held[at[free][::-1]] = todo[free][::-1]
            own = held[at]
            like = (key[own] == key[todo]) & (doc[own] == doc[todo]) & (length[own] == length[todo])
            m = np.flatnonzero(like & (own != todo))
            like[m] = same_bytes(starts[own[m]], starts[todo[m]], length[todo[m]], window)
            self.owner[todo[like]] = own[like]
            todo = todo[~like]
            slot[todo] = (slot[todo] + 1) & (slots - 1)

    def first(self) -> np.ndarray:
        """Whether a word is the first of its kind in its document."""
        return self.owner == np.arange(len(self.owner))


def measure(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """:data:`COUNTS` of each text of a block."""
    act = transduce(data, off)
    starts, ends, doc = spans_of(act, data, off)
    woff = np.searchsorted(starts, off)
    return {"n_words": np.diff(woff), "n_distinct": per_doc(SpanTable(data, starts, ends, doc).first(), woff),
            "n_capitals": per_doc((act & CAPITAL) > 0, off), "n_points": per_doc((act & POINT) > 0, off),
            "n_symbols": per_doc((act & SYMBOL) > 0, off)}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per document: id, part, text digest and :data:`COUNTS`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frugal(batches):
            for a, b, data, off in text_blocks(batch.column(3)):
                got = measure(data, off)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(3)), *(pa.array(got[c], pa.int64()) for c in COUNTS)],
                    ["doc_id", "part", "digest", *COUNTS])

    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    return d.mapInArrow(run, SCANNED.format(id=d.schema["doc_id"].dataType.simpleString()))


def text_failures() -> dict[str, Column]:
    """Failures of the filters that one text decides, over :data:`COUNTS`."""
    c = {n: F.col(n) for n in COUNTS}
    return {"A": c["n_words"] < MIN_WORDS, "B": 100 * c["n_distinct"] < MIN_DISTINCT_PERCENT * c["n_words"],
            "C": 100 * c["n_capitals"] > MAX_CAPITAL_PERCENT * c["n_points"], "D": c["n_symbols"] > 0}


def failures(scanned: DataFrame) -> DataFrame:
    """(doc_id, part, mask): bit i is set where filter i fails.  The smallest
    id of a text is one aggregate; a row is a copy if it is not that row,
    found by a join on text and id, so a text that a third of all rows share
    is spread over its ids."""
    s = saved(scanned)
    mask = sum((F.when(bad, 1 << FILTERS.index(f)).otherwise(0) for f, bad in text_failures().items()), F.lit(0))
    s = s.select("doc_id", "part", "digest", mask.alias("mask"))
    first = s.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    d = s.join(first, ["digest", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return d.select("doc_id", "part", (F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def cells(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents by part and failed set."""
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    lab = (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id"))
           .agg(flag("quality").alias("good"), flag("toxic").alias("toxic")))
    return (failed.join(lab, "doc_id", "left").groupBy("part", "mask")
            .agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("n_good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("n_toxic")))


def orders(filters: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """(order, step, bit of its filter, bits of the filters before)."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    return [("".join(p), k + 1, bit[f], sum(bit[e] for e in p[:k])) for p in permutations(filters) for k, f in enumerate(p)]


def audit(cell: DataFrame) -> DataFrame:
    """One row per part, order and step with the counts of that step."""
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(f).alias("f"), F.lit(e).alias("earlier"))
                      for o, k, f, e in orders()])
    x = cell.select("*", F.explode(steps).alias("s")).select("part", "mask", "n", "n_good", "n_toxic", "s.*")
    fails = F.col("mask").bitwiseAND(F.col("f")) != 0
    alive = F.col("mask").bitwiseAND(F.col("earlier")) == 0
    turns = F.lit(len(list(permutations(FILTERS))))
    total = lambda cond, of: F.sum(F.when(cond, F.col(of)).otherwise(0)).cast("long")
    # a document counts for the first of its failed filters: each of them is
    # first in an equal share of the orders
    share = F.when(fails, F.col("n") * (turns / F.greatest(F.bit_count("mask"), F.lit(1))).cast("long")).otherwise(0)
    return (x.groupBy("part", "filter_order", "step")
            .agg(total(alive & ~fails, "n").alias("kept"), total(alive & fails, "n").alias("removed"),
                 total(~alive & fails, "n").alias("redundant"), total(F.col("mask") == F.col("f"), "n").alias("unique_fails"),
                 total(alive & fails, "n_good").alias("good_lost"), total(alive & fails, "n_toxic").alias("toxic_lost"),
                 F.sum(share).cast("long").alias("shapley")))


def interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of all filter orders over whole documents."""
    return audit(saved(cells(failures(scan(docs, id_col, text_col, part_col)), labels, id_col)))
