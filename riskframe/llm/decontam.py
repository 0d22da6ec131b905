"""Benchmark decontamination on templates.

A text becomes a sequence of words in which numbers, names and units are
replaced by typed placeholders, their slots.  Windows of eight words of every
item form a table by hash, of three kinds:

* literal windows (words in lower case, numbers and names as they are), with
  any words; an item under eight words is one window;
* template windows, with at least ``LITERALS`` words that are no slots;
* template windows with one word left out, whatever it is, so that a name is
  found replaced whether or not capitals tell it from other words.

Documents emit their windows whose hash may be in that table (a Bloom filter
of fixed size travels to the tasks; it only saves rows), and the two tables
meet in a join by hash.  Equal windows on one alignment of a document and an
item are followed as long as the slots are consistent: one value of the item
always stands for one value of the document.  A document leaks an item when
consistent windows cover ``COVER`` of the item's words, or all of a shorter
item.  Neither table is collected; hits of a window that many documents share
are narrow rows, dealt by hash, and a hash that holds very many is split by
the skew join.

Words are runs of letters or of digits (with a point or comma between
digits); other characters separate.  A unit is a unit word after a number; a
name is a capitalised word of two letters or more.

Defined results: a null, empty or blank text leaks nothing and is never
leaked, nor is an item without words; repeated rows and repeated items each
give their pairs; texts are taken whole; an empty table on either side gives
an empty result; item ids are cast to long; other columns are ignored or
passed through.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import BLOOM_BITS, U, Rolling, bloom, frugal, grams, mix, row_key, saved, text_blocks

WINDOW = 8
LITERALS = 4
COVER = 13

# fixed values: unit words
UNITS = ("mm cm m km in inch inches ft feet foot yd yard yards mile miles mg g kg gram grams kilogram kilograms ton tons oz lb lbs "
         "pound pounds ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours "
         "day days week weeks month months year years percent degree degrees dollar dollars cent cents euro euros mph kmh hz khz mhz ghz "
         "w kw watt watts v volt volts j joule joules kb mb gb tb byte bytes c f k").split()

_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


NUMBER, UNIT, NAME, ANY = (mix(np.array([v], U))[0] for v in (101, 102, 103, 104))
LITERAL, TEMPLATE, SKIP = 1, 2, 3
_UNIT_HASHES: np.ndarray | None = None


def _unit_hashes() -> np.ndarray:
    global _UNIT_HASHES
    if _UNIT_HASHES is None:
        raw = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
        ends = np.append(np.flatnonzero(raw == 0x20), len(raw))
        starts = np.concatenate([[0], ends[:-1] + 1])
        _UNIT_HASHES = np.sort(Rolling(raw).spans(starts, ends))
    return _UNIT_HASHES


def template(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template words, literal words, is a slot, document bounds) of a
    block."""
    n = len(data)
    if n == 0:
        return np.zeros(0, U), np.zeros(0, U), np.zeros(0, bool), np.zeros(len(off), np.int64)
    digit, letter = _DIGIT[data], _LETTER[data]
    point = (data == 0x2E) | (data == 0x2C)
    inner = np.zeros(n, bool)
    inner[1:-1] = point[1:-1] & digit[:-2] & digit[2:]
    kind = np.where(digit | inner, 1, np.where(letter, 2, 0)).astype(np.int8)
    first = kind > 0
    first[1:] &= kind[1:] != kind[:-1]
    edge = off[1:-1]
    edge = edge[edge < n]
    first[edge] = kind[edge] > 0
    starts = np.flatnonzero(first)
    last = kind > 0
    last[:-1] &= kind[1:] != kind[:-1]
    cut = edge[edge > 0] - 1
    last[cut] = kind[cut] > 0
    ends = np.flatnonzero(last) + 1
    bounds = np.searchsorted(starts, off)
    h = Rolling(_LOWER[data]).spans(starts, ends)
    number = kind[starts] == 1
    new_doc = np.zeros(len(starts) + 1, bool)
    new_doc[bounds] = True
    new_doc = new_doc[:-1]
    unit = np.zeros(len(h), bool)
    after = np.flatnonzero(number[:-1] & ~number[1:] & ~new_doc[1:]) + 1
    u = _unit_hashes()
    unit[after] = u[np.minimum(np.searchsorted(u, h[after]), len(u) - 1)] == h[after]
    c0 = data[starts]
    c1 = data[np.minimum(starts + 1, n - 1)]
    ascii_cap = (c0 >= 0x41) & (c0 <= 0x5A)
    latin_cap = (c0 == 0xC3) & (c1 >= 0x80) & (c1 <= 0x9E)
    name = (ascii_cap | latin_cap) & (ends - starts > 1) & ~unit & ~number
    slot = number | unit | name
    return np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, h))), h, slot, bounds


def window_hashes(words: np.ndarray, literal: np.ndarray, slot: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(word left out, -1 for none, -2 for a literal window; places; hashes)
    for each kind of window of ``k`` words; a hash tells kind and length
    apart."""
    m = len(words) - k + 1
    if m <= 0:
        return
    tag = lambda g, kind: mix(g ^ mix(np.array([kind * 64 + k], U))[0])
    yield -2, np.arange(m), tag(grams(literal, k), LITERAL)
    plain = np.concatenate([[0], np.cumsum(~slot)])
    plain = plain[k:] - plain[:-k]
    at = np.flatnonzero(plain >= LITERALS)
    yield -1, at, tag(grams(words, k), TEMPLATE)[at]
    if k < WINDOW:
        return
    masked = np.array(words)
    for out in range(k):
        # windows that differ from a template window: the word is no number or unit
        at = np.flatnonzero((plain - ~slot[out:out + m] >= LITERALS) & ((words[out:out + m] == NAME) | ~slot[out:out + m]))
        h = np.zeros(len(at), U)
        for j in range(k):
            h *= U(0x2545F4914F6CDD1D)
            h += ANY if j == out else masked[at + j]
        yield out, at, tag(mix(h), SKIP + out)


def slot_values(literal: np.ndarray, slot: np.ndarray, at: np.ndarray, k: int, out: int) -> np.ndarray:
    """The values of a window's slots, 0 for words that must be equal."""
    if out == -2:
        return np.zeros((len(at), k), U)
    place = at[:, None] + np.arange(k)
    v = np.where(slot[place], literal[place], U(0))
    if out >= 0:
        v[:, out] = literal[at + out]
    return v


WINDOWS = "k_row long, k_text long, hash long, place int, k int, words int, slots binary"


def windows(sizes: list[int] | None, bits):
    """Rows of :data:`WINDOWS` for the windows of texts (columns k_row,
    k_text, text).  Without ``sizes`` the texts are items: a window of eight
    words or of the whole item; with them, the windows of documents whose
    hash passes the filter ``bits``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(bits.value, np.uint8) if bits is not None else None
        for batch in frugal(batches):
            for r0, _, data, off in text_blocks(batch.column(2)):
                words, literal, slot, bounds = template(data, off)
                length = np.diff(bounds)
                for k in (sizes if sizes is not None else np.unique(np.minimum(length, WINDOW))):
                    for out, at, h in (window_hashes(words, literal, slot, int(k)) if k else ()):
                        doc = np.searchsorted(bounds, at, "right") - 1
                        ok = at + k <= bounds[doc + 1]
                        if sizes is None:
                            ok &= np.minimum(length[doc], WINDOW) == k
                        else:
                            # two places of the filter
                            x, y = h >> U(64 - BLOOM_BITS), (h >> U(8)) & U((1 << BLOOM_BITS) - 1)
                            ok &= ((seen[x >> U(3)] >> (x & U(7)).astype(np.uint8)) & (seen[y >> U(3)] >> (y & U(7)).astype(np.uint8)) & 1).astype(bool)
                        at, h, doc = at[ok], h[ok], doc[ok]
                        if not len(at):
                            continue
                        v = np.ascontiguousarray(slot_values(literal, slot, at, int(k), out))
                        take = pa.array(r0 + doc)
                        yield pa.RecordBatch.from_arrays([
                            batch.column(0).take(take), batch.column(1).take(take), pa.array(h.view(np.int64)), pa.array((at - bounds[doc]).astype(np.int32)),
                            pa.array(np.full(len(at), k, np.int32)), pa.array(length[doc].astype(np.int32)),
                            pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * int(k)), len(at), [None, pa.py_buffer(v.tobytes())]).cast(pa.binary())],
                            ["k_row", "k_text", "hash", "place", "k", "words", "slots"])
    return run


def consistent_cover(windows_: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, bool]:
    """Most item words covered by windows (place in the item, slot values of
    item and document) of one alignment whose slots agree throughout, and
    whether all those slots are equal.  A window that contradicts the run
    before it begins a new one."""
    best, exact = 0, False
    to: dict[int, int] = {}
    covered, upto, same = 0, -1, True
    for a, item, doc in windows_:
        pairs = [(p, q) for p, q in zip(item.tolist(), doc.tolist(), strict=True) if p or q]
        own: dict[int, int] = {}
        if not all(own.setdefault(p, q) == q for p, q in pairs):
            continue
        if not all(to.get(p, q) == q for p, q in pairs):
            to, covered, upto, same = {}, 0, -1, True
        to.update(own)
        same = same and all(p == q for p, q in pairs)
        covered += max(0, a + len(item) - max(upto, a))
        upto = max(upto, a + len(item))
        if (covered, same) > (best, exact):
            best, exact = covered, same
    return best, exact


def aligned(hits: str):
    """:func:`consistent_cover` of each list of (place, item's slots,
    document's slots)."""
    @F.arrow_udf("struct<covered:int,exact:boolean>")
    def cover(groups: pa.Array) -> pa.Array:
        out = []
        for group in groups.to_pylist():
            rows = sorted({(x["place"], x["item"], x["doc"]) for x in group}, key=lambda r: (r[0], r[1] != r[2]))
            out.append(consistent_cover([(a, np.frombuffer(i, U), np.frombuffer(d, U)) for a, i, d in rows]))
        return pa.array([{"covered": c, "exact": e} for c, e in out], pa.struct([("covered", pa.int32()), ("exact", pa.bool_())]))
    return cover(F.col(hits))


def leaking_keys(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                 item_text: str = "text", cover: int = COVER) -> DataFrame:
    """``k_row, k_text, item_id, covered, item_words, exact``: a row per
    document key and item (as often as the item is repeated)."""
    # the item's id and text make its key, a document's id and text its own
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    items = items.select("item_id", *row_key("text", "item_id"), "text")
    win = saved(items.drop("item_id").distinct().mapInArrow(windows(None, None), WINDOWS))
    sizes = sorted(r.k for r in win.select("k").distinct().collect())
    bits = docs.sparkSession.sparkContext.broadcast(bloom(win, "hash"))
    d = docs.select(*row_key(text_col, id_col), F.col(text_col).cast("string").alias("text"))
    seen = d.mapInArrow(windows(sizes, bits), WINDOWS)
    w = win.select("hash", F.col("k_row").alias("i_row"), F.col("k_text").alias("i_text"), F.col("place").alias("at"), "words", F.col("slots").alias("item"))
    hits = seen.select("k_row", "k_text", "hash", "place", F.col("slots").alias("doc")).join(w, "hash")
    lines = (hits.groupBy("k_row", "k_text", "i_row", "i_text", "words", (F.col("place") - F.col("at")).alias("shift"))
             .agg(F.collect_list(F.struct(F.col("at").alias("place"), "item", "doc")).alias("hits")))
    lines = lines.select("k_row", "k_text", "i_row", "i_text", "words", aligned("hits").alias("a"))
    best = lines.groupBy("k_row", "k_text", "i_row", "i_text", "words").agg(F.max("a").alias("a"))
    best = best.where(F.col("a.covered") >= F.least(F.lit(cover), F.col("words")))
    each = items.select(F.col("k_row").alias("i_row"), F.col("k_text").alias("i_text"), "item_id")
    return best.join(each, ["i_row", "i_text"]).select("k_row", "k_text", "item_id", "a.covered", F.col("words").alias("item_words"), "a.exact")


def leaked_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document and item it leaks."""
    found = saved(leaking_keys(docs, benchmark, id_col, text_col, **options))
    d = docs.select(F.col(id_col).alias("doc_id"), *row_key(text_col, id_col))
    return d.join(found, ["k_row", "k_text"]).select("doc_id", "item_id", "covered", "item_words", "exact")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that leak nothing, all columns kept."""
    found = saved(leaking_keys(docs, benchmark, id_col, text_col, **options).select("k_row", "k_text").distinct())
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key(text_col, id_col))
    return d.join(found, ["k_row", "k_text"], "left_anti").select("row.*")
