"""Token ids of whole texts with a public tokenizer, word by word.

The default tokenizer drops white space and never merges across it, so a
text's ids are the ids of its space-separated chunks in order.  Each task
encodes a chunk once and gathers ids by index; chunks are split at ASCII
white space only, other white space stays inside a chunk and is the
tokenizer's affair.  A vocabulary file that does not declare this behaviour
encodes whole texts.
"""
from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from riskframe.llm.common import text_blocks

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
# chunks kept per task; a full store is emptied, never consulted partly
STORE_CHUNKS = 700_000
ENCODE_BYTES = 4 << 20
# chunks of these letters only are one word to the tokenizer, whatever their case
ONE_WORD = re.compile(r"[a-zA-Zà-öø-ÿÀ-ÖØ-Þß]+").fullmatch
JOINED = 2_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _loosened(text: pa.Array) -> pa.Array:
    """Texts with the same ids but fewer different chunks: the tokenizer cuts
    between a letter and a following stop or comma anyway, and lowers ASCII
    letters anyway (not inside the strings of its special tokens, so texts
    that may hold one keep their case)."""
    text = pc.replace_substring_regex(text, r"([A-Za-z])([.,])", r"\1 \2")
    if not pc.any(pc.match_substring(text, "<|")).as_py():
        text = pc.ascii_lower(text)
    return text


def drops_space(path: str) -> bool:
    """Whether a vocabulary file lowers letters, folds white space, cuts at
    it and ends words with ``</w>``, which encoding by chunks relies on."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    steps = (j.get("normalizer") or {}).get("normalizers") or []
    cuts = (j.get("pre_tokenizer") or {}).get("pretokenizers") or []
    return (j["model"].get("end_of_word_suffix") == "</w>" and [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]
            and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"].get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"))


class ChunkEncoder:
    """Encodes string columns; holds one tokenizer and its chunk store."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.by_chunk = drops_space(path)
        vocab = self.tok.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._empty()

    def _empty(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.start = np.zeros(1, np.int64)

    def _known(self, words: list[str]) -> np.ndarray:
        get = self.index.get
        at = [get(w, -1) for w in words]
        new = [w for w, i in zip(words, at, strict=True) if i < 0]
        if new:
            if len(self.index) + len(new) > STORE_CHUNKS and self.index:
                self._empty()
                return self._known(words)
            plain = [w for w in new if ONE_WORD(w)]
            rest = [w for w in new if not ONE_WORD(w)]
            flat, lens = [self.flat], [np.zeros(0, np.int64)]
            for i in range(0, len(plain), JOINED):
                part = plain[i:i + JOINED]
                ids = np.array(self.tok.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
                ends = np.flatnonzero(self.closes[ids]) + 1
                if len(ends) == len(part):  # every word ends in one closing token
                    flat.append(ids)
                    lens.append(np.diff(ends, prepend=0))
                else:
                    rest = part + rest
                    plain[i:i + JOINED] = [None] * len(part)
            order = [w for w in plain if w is not None] + rest
            if rest:
                got = [e.ids for e in self.tok.encode_batch(rest, add_special_tokens=False)]
                flat.append(np.array([i for ids in got for i in ids], np.uint32))
                lens.append(np.array([len(ids) for ids in got], np.int64))
            base = len(self.index)
            self.index.update(zip(order, range(base, base + len(order)), strict=True))
            self.flat = np.concatenate(flat)
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.concatenate(lens))])
            at = [self.index[w] for w in words]
        return np.array(at, np.int64)

    def blocks(self, text: pa.Array):
        """Yields ``(first row, end row, ids, offsets)`` for blocks of rows."""
        if text.null_count:
            text = pc.fill_null(text, "")
        for a, b, _, _ in text_blocks(text, ENCODE_BYTES):
            if not self.by_chunk:
                got = [e.ids for e in self.tok.encode_batch(text.slice(a, b - a).to_pylist(), add_special_tokens=False)]
                bounds = np.cumsum([0, *map(len, got)], dtype=np.int64)
                yield a, b, np.array([i for ids in got for i in ids], np.uint32), bounds
                continue
            lists = pc.ascii_split_whitespace(_loosened(text.slice(a, b - a)))
            chunks = lists.flatten()
            coded = chunks.dictionary_encode()
            words = coded.dictionary.to_pylist()
            known = self._known(words)
            at = known[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)] if len(chunks) else np.zeros(0, np.int64)
            size = self.start[at + 1] - self.start[at]
            per = np.asarray(pc.list_value_length(lists).to_numpy(zero_copy_only=False), np.int64)
            ends = np.zeros(len(at) + 1, np.int64)
            np.cumsum(size, out=ends[1:])
            where = np.arange(ends[-1]) - np.repeat(ends[:-1] - self.start[at], size)
            bounds = np.zeros(b - a + 1, np.int64)
            np.cumsum(per, out=bounds[1:])
            yield a, b, self.flat[where], ends[bounds]


_HELD: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _HELD:
        _HELD[path] = ChunkEncoder(path)
    return _HELD[path]
