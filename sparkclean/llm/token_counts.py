"""Token counts by rank-synchronous merging: all new words of a batch at once, as ragged arrays of symbols."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sparkclean.llm.bpe import byte_names, pieces
from sparkclean.llm.common import byte_slices, texts_of

#: Fixed value: the pieces of a lower-cased word that are encoded by themselves.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Fixed value: the white space that the tokenizer drops. Python's own adds four control characters.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Lower cases of Unicode 16 and 17 that Python does not have yet.
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B,
             **{0x10D50 + k: 0x10D70 + k for k in range(22)}, **{0x16EA0 + k: 0x16EBB + k for k in range(25)}}
_controls = re.compile("[\x1c-\x1f]")
#: Distinct words whose counts a Python worker keeps; others are counted anew in each batch.
KEPT = 1_000_000
NONE = np.iinfo(np.int32).max


def lowered(text: str) -> str:
    """NFC, then each character's own lower case (no final sigma)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text).translate(NEW_LOWER)
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


class RaggedMerges:
    """Counts what is left of symbol sequences after all merges."""

    def __init__(self, rules: list[tuple[int, int, int]], base: int):
        self.base = base
        keys = np.array([a * base + b for a, b, _ in rules], np.int64)
        order = np.argsort(keys, kind="stable")
        first = np.concatenate([[True], np.diff(keys[order]) > 0]) if len(order) else np.zeros(0, bool)
        self.keys, self.ranks = keys[order][first], order[first].astype(np.int32)
        self.merged = np.array([m for _, _, m in rules], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        wanted = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE)

    def counts(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols left of each sequence. `symbols` holds the sequences one after the other, none of them empty."""
        left = lengths.copy()
        if not len(symbols) or not len(self.keys):
            return left
        owner = np.repeat(np.arange(len(lengths)), lengths)
        rank = np.full(len(symbols), NONE, np.int32)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self.rank(symbols[inner], symbols[inner + 1])
        while True:
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(starts, append=len(owner))
            live = lowest < NONE
            if not live.all():
                left[owner[starts[~live]]] = sizes[~live]
                if not live.any():
                    return left
                stay = np.repeat(live, sizes)
                symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
                lowest, sizes = lowest[live], sizes[live]
            at = np.flatnonzero(rank == np.repeat(lowest, sizes))
            run = np.cumsum(np.diff(at, prepend=-2) > 1)  # in a run of one symbol, every second pair merges
            first = np.flatnonzero(np.diff(run, prepend=0))
            at = at[(np.arange(len(at)) - first[run - 1]) % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            at -= np.arange(len(at))
            rank[at] = NONE
            fresh = np.unique(np.concatenate([at, at[at > 0] - 1]))
            fresh = fresh[fresh + 1 < len(symbols)]
            fresh = fresh[owner[fresh] == owner[fresh + 1]]
            rank[fresh] = self.rank(symbols[fresh], symbols[fresh + 1])


class WordCounter:
    """Token counts of texts for one tokenizer file (lower-casing BPE with a word-end suffix)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        names = byte_names()
        self.plain = np.array([vocab[c] for c in names], np.int64)
        self.last = np.array([vocab[c + end] for c in names], np.int64)
        pairs = (pair.split(" ") if isinstance(pair, str) else pair for pair in spec["model"]["merges"])
        self.merges = RaggedMerges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], 1 + max(vocab.values()))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special)))
        self.piece = regex.compile(PIECE)
        self.kept: dict[str, int] = {}

    def _words(self, text: str) -> list[str]:
        return text.split() if not _controls.search(text) else [w for w in SPACE.split(text) if w]

    def _new(self, words: list[str]) -> dict[str, int]:
        fixed, found, owners = [], [], []
        for k, word in enumerate(words):
            parts = self.special.split(word)
            fixed.append(len(parts) - 1)
            for part in parts:
                own = pieces(self.piece, lowered(part))
                found += own
                owners += [k] * len(own)
        total = np.array(fixed, np.int64)
        if found:
            of, back = {}, []
            for x in found:
                back.append(of.setdefault(x, len(of)))
            coded = [x.encode() for x in of]
            lengths = np.array([len(x) for x in coded])
            flat = np.frombuffer(b"".join(coded), np.uint8)
            symbols, ends = self.plain[flat], np.cumsum(lengths) - 1
            symbols[ends] = self.last[flat[ends]]
            np.add.at(total, owners, self.merges.counts(symbols, lengths)[back])
        return dict(zip(words, total.tolist()))

    def __call__(self, texts: list[str]) -> list[int]:
        words = [self._words(x) for x in texts]
        kept = self.kept
        new = set().union(*words).difference(kept)
        if new:
            found = self._new(list(new))
            if len(kept) + len(found) <= KEPT:
                kept.update(found)
            else:
                kept = _Both(kept, found)
        get = kept.__getitem__
        return [sum(map(get, x)) for x in words]


class _Both(dict):
    """`found` for this batch, the kept words behind it."""

    def __init__(self, kept: dict, found: dict):
        super().__init__(found)
        self.kept = kept

    def __missing__(self, key):
        return self.kept[key]


@lru_cache(2)
def _counter(path: str) -> WordCounter:
    return WordCounter(path)


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Tokens of every whole text: `id_col`, n_bytes long (UTF-8), n_tokens long, over_limit boolean (above `limit`).

    Strings of special tokens count as one token each. Null and empty texts count 0. Every input row gives one row,
    repeated rows and null keys too; an empty table gives none; other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in byte_slices(batches, text_col):
            texts = texts_of(batch, text_col)
            counts = counter(texts)
            sizes = pa.array([len(x.encode()) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
