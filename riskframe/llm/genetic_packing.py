"""Packing token ids into few sequences with a grouping genetic algorithm.

A document's ids plus one end id are one piece, or, if longer than a
sequence, a first piece with the remainder and whole sequences after it.
Pieces that fill a sequence are done.  The others are dealt into shards of
bounded size; every shard is worked on by several islands, populations of
complete packings that differ in the order they were first built in.

A packing is changed bin by bin.  Crossover takes well-filled bins of one
parent whole, removes from the other parent every bin that shares a piece
with them, and puts the pieces so displaced back by best fit, longest first.
Mutation dissolves some bins, the emptiest among them, in the same way.
After each epoch an island sends its best packing to the next island of its
shard (one shuffle of assignments, a few bytes a piece); the best packing of
a shard after the last epoch stands.  The emptiest bin of every shard is
then emptied, and these pieces are packed together the same way, until one
shard is left, so the loss does not grow with the number of shards.

Random numbers follow from shard, island and epoch, so a recomputed task
gives the same packings.

Defined results: a null or empty text is one piece holding the end id;
repeated rows are packed one by one; equal lengths are placed by document
id, start and salt; a text of any length is cut whole; an empty table gives
an empty result; other columns are ignored; ids are cast to long.
"""
from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import tokens
from riskframe.llm.common import U, frugal, mix, saved

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
SEQUENCE = 1024
SHARD_PIECES = 4096
ISLANDS = 3
POPULATION = 4
EPOCHS = 3
BIRTHS = 30
ENCODE_ROWS = 256

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long, salt long"
STATE = "g long, island int, elite boolean, lengths binary, genes binary"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long, salt long, sequence_id long, offset long, loose boolean"


# -- ids ------------------------------------------------------------------

def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary
    files of byte-level BPE."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteEncoder:
    """Ids of a vocabulary file.  A plain byte-level BPE whose merges are
    numbered in order is run by its ranks; any other file by its library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.fast = None
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        cut, model = j.get("pre_tokenizer") or {}, j["model"]
        merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", [])]
        in_order = all(model["vocab"].get(m.replace(" ", "", 1)) == 256 + i for i, m in enumerate(merges))
        if (model["type"] == "BPE" and in_order and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
                and not j.get("normalizer") and not model.get("dropout") and all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in j["added_tokens"])):
            import public_tokenizers
            import tiktoken
            special = {t["content"]: t["id"] for t in j["added_tokens"]}
            alphabet = byte_alphabet()
            ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
            self.fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self.special = set(special)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast is None:
            return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        return [self.fast.encode_to_numpy(t, allowed_special=self.special) for t in texts]


_HELD: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    if path not in _HELD:
        _HELD[path] = ByteEncoder(path)
    return _HELD[path]


def cuts(n: np.ndarray, sequence: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of the pieces of documents with
    ``n`` ids: the remainder first, then whole sequences."""
    per = -(-n // sequence)
    doc = np.repeat(np.arange(len(n)), per)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    head = n - (per - 1) * sequence
    start = np.where(piece == 0, 0, head[doc] + (piece - 1) * sequence)
    return doc, piece, start, np.where(piece == 0, head[doc], sequence)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
           sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: its place in its document's ids and the checksum
    of its ids."""
    path = tokenizer or tokens.tokenizer_path(TOKENIZER)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        seen = TaskContext.get().partitionId() << 36
        for whole in frugal(batches):
            for at in range(0, whole.num_rows, ENCODE_ROWS):
                batch = whole.slice(at, ENCODE_ROWS)
                got = enc.ids(pc.fill_null(batch.column(1), "").to_pylist())
                n = np.array([len(x) + 1 for x in got], np.int64)
                doc, piece, start, length = cuts(n, sequence)
                raw = [memoryview(np.append(x, np.uint32(end_id)).astype("<u4").tobytes()) for x in got]
                crc = np.array([zlib.crc32(raw[d][4 * s:4 * (s + k)]) for d, s, k in zip(doc, start, length, strict=True)], np.int64)
                salt = mix(mix(crc[piece == 0].astype(U) + U(1)) + np.arange(seen, seen + len(got)).astype(U)) >> U(1)
                seen += len(got)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc),
                    pa.array(n[doc]), pa.array(salt[doc].astype(np.int64))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens", "salt"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, PIECES)


# -- packings of one shard ------------------------------------------------

class BestFit:
    """Open bins by the room they have left; the rooms in use are the bits
    of one number, so the tightest bin that fits is a shift and a lowest
    bit."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0
        self.bins = 0

    def open(self, rooms: list[int]) -> None:
        for r in rooms:
            self.by_room[r].append(self.bins)
            self.rooms |= 1 << r
            self.bins += 1

    def place(self, sizes: list[int]) -> list[int]:
        by_room, rooms, capacity, out = self.by_room, self.rooms, self.capacity, []
        for s in sizes:
            fits = rooms >> s
            if fits:
                r = s + (fits & -fits).bit_length() - 1
                here = by_room[r]
                b = here.pop()
                if not here:
                    rooms ^= 1 << r
            else:
                b, r = self.bins, capacity
                self.bins += 1
            out.append(b)
            by_room[r - s].append(b)
            rooms |= 1 << (r - s)
        self.rooms = rooms
        return out


def fills(genes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.bincount(genes, weights=lengths).astype(np.int64)


def worth(genes: np.ndarray, lengths: np.ndarray) -> tuple[int, int]:
    """Fewer bins first, then bins as unequally filled as possible: full
    bins beside an empty one leave room for a bin less."""
    f = fills(genes, lengths)
    return -len(f), int((f * f).sum())


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the total length, and for every cut the
    pieces too long to share a bin with each other."""
    best = -(-int(lengths.sum()) // capacity)
    asc = np.sort(lengths)
    total = np.concatenate([[0], np.cumsum(asc)])
    n = len(asc)
    half = np.searchsorted(asc, capacity // 2, "right")
    for k in np.unique(np.concatenate([[0], asc[:half]])):
        big = np.searchsorted(asc, capacity - k, "right")
        low = np.searchsorted(asc, k, "left")
        room = (half_count := big - half) * capacity - int(total[big] - total[half])
        best = max(best, n - big + half_count + max(0, -(-(int(total[half] - total[low]) - room) // capacity)))
    return int(best)


def refit(kept: np.ndarray, genes: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Renumbers the bins of the pieces in ``kept`` and puts all others back
    by best fit.  Pieces are in descending order of length."""
    out = np.empty(len(genes), np.int64)
    _, out[kept] = np.unique(genes[kept], return_inverse=True)
    fit = BestFit(capacity)
    if kept.any():
        fit.open((capacity - fills(out[kept], lengths[kept])).tolist())
    away = np.flatnonzero(~kept)
    out[away] = fit.place(lengths[away].tolist())
    return out


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Whole well-filled bins of ``b`` go into ``a``."""
    f = fills(b, lengths)
    well = np.argsort(-(f + rng.random(len(f)) * capacity / 8), kind="stable")[:max(1, len(f) // 2)]
    inject = np.zeros(len(f), bool)
    inject[rng.choice(well, max(1, len(f) // 12), replace=False) if len(well) > 1 else well] = True
    brought = inject[b]
    hit = np.zeros(int(a.max()) + 1, bool)
    hit[a[brought]] = True
    genes = np.where(brought, b + len(hit), a)
    return refit(brought | ~hit[a], genes, lengths, capacity)


def mutation(a: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Dissolves the emptiest bin and some others, emptier ones rather."""
    f = fills(a, lengths)
    k = min(len(f), max(2, len(f) // 20))
    gone = np.zeros(len(f), bool)
    gone[np.argsort(f * (0.5 + rng.random(len(f))), kind="stable")[:k]] = True
    gone[np.argmin(f)] = True
    return refit(~gone[a], a, lengths, capacity)


def founders(lengths: np.ndarray, capacity: int, size: int, rng: np.random.Generator, plain: bool) -> list[np.ndarray]:
    """Best-fit packings of the pieces, longest first and in orders blurred
    more and more."""
    out = []
    for i in range(size):
        blur = 0.0 if plain and i == 0 else 0.1 * (i + 1)
        order = np.argsort(-lengths * (1 + blur * (rng.random(len(lengths)) - 0.5)), kind="stable")
        genes = np.empty(len(lengths), np.int64)
        genes[order] = BestFit(capacity).place(lengths[order].tolist())
        out.append(genes)
    return out


def evolve(lengths: np.ndarray, people: list[np.ndarray], capacity: int, births: int, least: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Births one by one; a child takes the place of the worst packing if it
    is better than that one.  Ends early at a packing with ``least`` bins."""
    score = [worth(p, lengths) for p in people]
    for i in range(births):
        if -max(score)[0] <= least:
            break
        a, b = rng.permutation(len(people))[:2] if len(people) > 1 else (0, 0)
        if score[a] < score[b]:
            a, b = b, a
        child = mutation(people[a], lengths, capacity, rng) if i % 3 == 2 or a == b else crossover(people[a], people[b], lengths, capacity, rng)
        value = worth(child, lengths)
        worst = min(range(len(score)), key=score.__getitem__)
        if value > score[worst] and value not in score:
            people[worst], score[worst] = child, value
    return [people[i] for i in sorted(range(len(people)), key=score.__getitem__, reverse=True)]


# -- islands over the cluster ---------------------------------------------

def _rng(*key: int) -> np.random.Generator:
    return np.random.default_rng([k & 0xFFFFFFFF for k in key])


def epoch(number: int, capacity: int, islands: int, population: int, births: int) -> Callable:
    """One epoch of one island: its people, and the packings that came in,
    evolve; the best goes on to the next island as well."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        g, island = int(key[0]), int(key[1])
        lengths = np.frombuffer(rows["lengths"].iloc[0], np.int32).astype(np.int64)
        rng = _rng(g, island, number)
        if number == 0:
            people = founders(lengths, capacity, population, rng, island == 0)
        else:
            rows = rows.sort_values("elite", kind="stable")
            people = [p for x in rows["genes"] for p in np.frombuffer(x, np.int32).astype(np.int64).reshape(-1, len(lengths))]
        people = evolve(lengths, people, capacity, births, least_bins(lengths, capacity), rng)[:population]
        packed = [np.concatenate(people).astype(np.int32).tobytes(), people[0].astype(np.int32).tobytes()]
        return pd.DataFrame({"g": [g, g], "island": [island, (island + 1) % islands], "elite": [False, True],
                             "lengths": [rows["lengths"].iloc[0]] * 2, "genes": packed})
    return run


def place(level: int, capacity: int, last: bool) -> Callable:
    """Writes the best packing of a shard onto its pieces."""
    def run(key: tuple, group: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["length", "doc_id", "start", "salt"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = g["length"].to_numpy()
        genes = max((np.frombuffer(x, np.int32).astype(np.int64) for x in sorted(best["genes"])), key=lambda p: worth(p, lengths))
        f = fills(genes, lengths)
        order = np.argsort(genes, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        offset = np.empty(len(g), np.int64)
        offset[order] = before - (np.cumsum(f) - f)[genes[order]]
        loose = (genes == np.argmin(f)) if not last and f.min() < capacity else np.zeros(len(g), bool)
        return g.assign(sequence_id=(level << 56) + (int(key[0]) << 24) + genes, offset=offset, loose=loose).drop(columns=["g"])
    return run


def pack_shards(part: DataFrame, shards: int, level: int, capacity: int, islands: int, population: int, epochs: int, births: int) -> DataFrame:
    """The pieces of one level with their places; ``loose`` ones belong to
    the emptiest bin of their shard and go to the next level."""
    part = part.withColumn("g", F.pmod(F.xxhash64("salt", F.lit(level)), F.lit(shards)))

    def pack_lengths(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(rows["length"].to_numpy())[::-1].astype(np.int32).tobytes()
        return pd.DataFrame({"g": [int(key[0])] * islands, "island": range(islands), "elite": False, "lengths": [x] * islands, "genes": b""})

    state = part.select("g", "length").groupBy("g").applyInPandas(pack_lengths, STATE)
    for i in range(epochs):
        state = state.groupBy("g", "island").applyInPandas(epoch(i, capacity, islands, population, births), STATE)
    best = state.where("elite").select("g", "genes")
    return part.groupBy("g").cogroup(best.groupBy("g")).applyInPandas(place(level, capacity, shards == 1), PLACED)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, sequence: int = SEQUENCE,
         end_id: int = END_ID, shard_pieces: int = SHARD_PIECES, islands: int = ISLANDS, population: int = POPULATION,
         epochs: int = EPOCHS, births: int = BIRTHS) -> DataFrame:
    """Pieces of all documents with their sequence and offset.  Sequence ids
    are any numbers; offsets in a sequence run from 0 gapless."""
    p = saved(pieces(docs, id_col, text_col, tokenizer, sequence, end_id))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out = (p.where(F.col("length") == sequence)
           .select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).select(names))
    part, level = p.where(F.col("length") < sequence), 0
    while True:
        shards = max(1, -(-part.count() // shard_pieces))
        placed = saved(pack_shards(part, shards, level, sequence, islands, population, epochs, births))
        out = out.unionByName(placed.where("not loose").select(names))
        if shards == 1:
            return out
        part, level = placed.where("loose").select(p.columns), level + 1
