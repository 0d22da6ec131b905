"""Repetition coverage: which part of a text lies in repeated n-grams and
lines.

Words are maximal runs outside space, \\t, \\n, \\v, \\f, \\r.  Rolling
hashes of word n-grams (64 bits, salted with the document) are compared
inside each document by sorting; a word is covered by length n when it lies
in an n-gram found at least twice, the first occurrence included.  Longer
n-grams are looked up only where the shorter one repeats, which loses
nothing: a repeated n-gram starts with a repeated shorter one.

Defined results: a null or empty text has zero words and fails the base
rule; repeated rows are judged one by one and alike; very long texts are
judged whole; an empty table gives an empty result; other columns pass
through untouched (the verdict is one struct column).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import U, Rolling, frugal, grams, mix, per_doc, repeated, text_blocks, word_spans

# fixed values: n-gram length -> largest share of word characters that may
# lie in repeated n-grams of that length
COVERAGE_LIMITS = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
# largest share of line characters in lines that repeat an earlier line
LINE_LIMIT = 0.30
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"

FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"),
          ("n_repeat_words", "long"), ("dup_line_chars", "long"), ("line_chars", "long"),
          *((f"cover_{n}", "long") for n in COVERAGE_LIMITS)]
SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n, _ in FIELDS])


def measure(data: np.ndarray, off: np.ndarray, sizes: tuple[int, ...] = tuple(COVERAGE_LIMITS)) -> dict[str, np.ndarray]:
    """Counts of :data:`FIELDS` for each document of a block."""
    docs = len(off) - 1
    starts, ends, doc = word_spans(data, off)
    letter = (data & 0xC0) != 0x80  # first byte of a code point
    upto = np.zeros(len(data) + 1, np.int64)
    np.cumsum(letter, out=upto[1:])
    chars = upto[ends] - upto[starts]
    woff = np.searchsorted(starts, off)
    sym = np.zeros(256, bool)
    sym[list(SYMBOLS.encode())] = True
    out = {"n_words": np.diff(woff), "word_chars": per_doc(chars, woff), "n_symbols": per_doc(sym[data], off)}
    roll = Rolling(data)
    salt = mix(np.arange(1, docs + 1, dtype=U))

    # lines: [begin, stop) between newlines and document ends
    nl = np.flatnonzero(data == 0x0A)
    begin = np.concatenate([off[:-1], nl + 1])
    stop = np.concatenate([off[1:], nl])
    begin.sort()
    stop.sort()
    ldoc = np.searchsorted(off, begin, "right") - 1
    # an empty document begins where the next one does
    filled = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop, ldoc = begin[filled], stop[filled], ldoc[filled]
    _, again = repeated(roll.spans(begin, stop) ^ salt[ldoc])
    length = upto[stop] - upto[begin]
    out["n_dup_lines"] = np.bincount(ldoc[again], minlength=docs)
    out["dup_line_chars"] = np.bincount(ldoc[again], weights=length[again], minlength=docs).astype(np.int64)
    out["line_chars"] = np.bincount(ldoc, weights=length, minlength=docs).astype(np.int64)

    wh = roll.spans(starts, ends)
    at = np.arange(len(wh))
    for n in sizes:
        g = grams(wh, n)
        at = at[at < len(g)]
        at = at[doc[at] == doc[at + n - 1]]
        twice, _ = repeated(g[at] ^ salt[doc[at]])
        at = at[twice]
        edge = np.zeros(len(wh) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + n, -1)
        covered = np.cumsum(edge)[:-1] > 0
        if n == sizes[0]:
            out["n_repeat_words"] = per_doc(covered, woff)
        out[f"cover_{n}"] = per_doc(chars * covered, woff)
    return out


def _measured(text: pa.Array) -> pa.Array:
    parts: list[dict[str, np.ndarray]] = [measure(data, off) for _, _, data, off in text_blocks(text)]
    cols = [pa.array(np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for n, _ in FIELDS]
    return pa.StructArray.from_arrays(cols, [n for n, _ in FIELDS])


def repetition(text_col: str = "text"):
    """Struct column with the counts of :data:`FIELDS`."""
    @F.arrow_udf(SCHEMA)
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in frugal(batches):
            yield _measured(text)
    return measured(F.col(text_col).cast("string"))


def verdict(m: str) -> tuple:
    """(base_failed, kept) expressions over the struct column ``m``."""
    c = lambda n: F.col(f"{m}.{n}")
    base = (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))
    bad = c("dup_line_chars") > LINE_LIMIT * c("line_chars")
    for n, most in COVERAGE_LIMITS.items():
        bad = bad | (c(f"cover_{n}") > most * c("word_chars"))
    return base, ~base & ~bad


def quality_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts, ``base_failed`` and ``kept``."""
    d = docs.select(F.col(id_col).alias("doc_id"), repetition(text_col).alias("m"))
    base, kept = verdict("m")
    return d.select("doc_id", "m.*", base.alias("base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents whose repetition verdict is good, all columns kept."""
    names = docs.columns
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), repetition(text_col).alias("m"))
    return d.where(verdict("m")[1]).select("row.*")
