"""Byte-level BPE: encoding by a priority queue of merge ranks over a linked symbol list, and decoding."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sparkclean.llm.common import byte_slices, ragged, texts_of

#: Fixed value: how the byte-level pre-tokenizer cuts words.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points that newer tables call letters or numbers and the tokenizer libraries (Unicode 16) don't.
NEWER = (
    (0x0558, 0x0558), (0x058B, 0x058C), (0x088F, 0x088F), (0x0C5C, 0x0C5C), (0x0CDC, 0x0CDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F))
#: Distinct words and word parts whose ids a Python worker keeps; others are encoded anew each time.
KEPT = 450_000


_newer = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]")


def pieces(pattern: regex.Pattern, text: str) -> list[str]:
    """Matches of a pre-tokenizer's pattern; NEWER code points count as neither letters nor numbers, whatever the tables say."""
    if text.isascii() or not _newer.search(text):
        return pattern.findall(text)
    return [text[m.start() : m.end()] for m in pattern.finditer(_newer.sub("\ue000", text))]


def byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """Merge rules by rank: the pair's symbols and the merged one; `rank_of` finds a rank by left * base + right."""

    def __init__(self, rules: list[tuple[int, int, int]], base: int):
        self.base, self.rank_of = base, {}
        self.left, self.right, self.merged = map(list, zip(*rules)) if rules else ([], [], [])
        for rank, (a, b, _) in enumerate(rules):
            self.rank_of.setdefault(a * base + b, rank)


def merge_by_heap(symbols: list[int], merges: Merges) -> list[int]:
    """Apply merges in rank order, leftmost first. The queue holds rank and place as one number."""
    n, base, rank_of = len(symbols), merges.base, merges.rank_of.get
    bits = n.bit_length()
    places = (1 << bits) - 1
    queue = [r << bits | i for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank_of(a * base + b)) is not None]
    if not queue:
        return symbols
    heapify(queue)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    left, right, into = merges.left, merges.right, merges.merged
    while queue:
        entry = heappop(queue)
        rank, i = entry >> bits, entry & places
        j = after[i]
        if symbols[i] != left[rank] or j >= n or symbols[j] != right[rank]:
            continue  # stale: one of the two has been merged since
        symbols[i] = s = into[rank]
        symbols[j] = -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := rank_of(s * base + symbols[k])) is not None:
                heappush(queue, r << bits | i)
        if (h := before[i]) >= 0 and (r := rank_of(symbols[h] * base + s)) is not None:
            heappush(queue, r << bits | h)
    return [s for s in symbols if s >= 0]


class Kept(dict):
    """A dict that computes what is missing and keeps up to `limit` of it."""

    def __init__(self, compute, limit: int = KEPT):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) < self.limit:
            self[key] = value
        return value


_two_spaces = re.compile(r"\s\s")


class WordSplit:
    """Ids of a text, joined from those of its space-separated words, which are kept.

    A cut before a space that follows a non-space never runs through a pre-token, and a lone line break is a pre-token
    of its own, so words can be encoded by themselves. Texts with two white-space characters in a row go whole.
    """

    def __init__(self, encode, limit: int = KEPT):
        self.encode = encode  # text -> bytes of little-endian unsigned 32-bit ids
        self.words = Kept(lambda w: encode(w if w[:1] == "\n" else " " + w), limit)

    def __call__(self, text: str) -> bytes:
        if _two_spaces.search(text):
            return self.encode(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.encode(first) + b"".join(map(self.words.__getitem__, rest))


class Vocabulary:
    """Decoder of one tokenizer file (model BPE, byte-level pre-tokenizer, no normalizer)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names, vocab = byte_names(), spec["model"]["vocab"]
        of_name = {c: b for b, c in enumerate(names)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            strings[i] = bytes(of_name[c] for c in token) if all(c in of_name for c in token) else token.encode()
        self.lengths = np.array([len(x) for x in strings])
        self.starts, self.strings = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(strings), np.uint8)
        self._read(names, vocab, spec["model"]["merges"])

    def _read(self, names: list[str], vocab: dict[str, int], merges: list) -> None:
        """What only an encoder needs; a worker that decodes has no memory for it."""

    def decode(self, ids: list[bytes]) -> list[str]:
        """Vocabulary strings put together; bytes that are no UTF-8 become replacement characters."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        sizes = self.lengths[flat]
        data = self.strings[ragged(self.starts[flat], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0] + [len(x) // 4 for x in ids])].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]

class ByteBpe(Vocabulary):
    """Encoder and decoder of one tokenizer file."""

    def _read(self, names: list[str], vocab: dict[str, int], merges: list) -> None:
        self.ids = [vocab[c] for c in names]
        pairs = (pair.split(" ") if isinstance(pair, str) else pair for pair in merges)
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], 1 + max(vocab.values()))
        self.word = regex.compile(WORD)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.parts = Kept(self._part)
        self.encode = WordSplit(self._whole)

    def _part(self, part: str) -> bytes:
        ids = self.ids
        return array("I", merge_by_heap([ids[b] for b in part.encode()], self.merges)).tobytes()

    def _whole(self, text: str) -> bytes:
        if not any(token in text for token in self.special):
            found = pieces(self.word, text)
            if len(found) == 1:  # kept as a word already
                return self.parts.get(text) or self._part(text)
            return b"".join(map(self.parts.__getitem__, found))
        out = []
        for k, piece in enumerate(self.cut.split(text)):
            if k % 2:
                out.append(array("I", [self.special[piece]]).tobytes())
            else:
                out += map(self.parts.__getitem__, pieces(self.word, piece))
        return b"".join(out)


@lru_cache(2)
def _model(path: str) -> ByteBpe:
    return ByteBpe(path)


@lru_cache(2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text: `id_col`, ids (binary: little-endian unsigned 32-bit), n_tokens long.

    Strings of special tokens inside texts become those tokens. Null and empty texts have no ids. Every input row gives
    one row, repeated rows and null keys too; an empty table gives none; other columns are not read. `path` names a tokenizer file that is
    installed on every executor.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in byte_slices(batches, text_col):
            ids = [model.encode(x) for x in texts_of(batch, text_col)]
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), counts], [id_col, "ids", "n_tokens"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary, n_tokens long")


def decode_ids(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode every id list: `id_col`, ids, n_tokens long, text. Null ids give the empty text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _vocabulary(path)
        for batch in byte_slices(batches, ids_col):
            ids = [x or b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array(model.decode(ids), pa.string())], [id_col, "ids", "n_tokens", "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary, n_tokens long, text string")
