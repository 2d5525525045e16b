"""Packing of token sequences: bounded-space online best-fit over a bitset of free spaces."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from sparkclean.llm.bpe import WORD, ByteBpe, WordSplit
from sparkclean.llm.common import byte_slices, mapped, texts_of

#: Open bins of a packer, and bytes of token ids that it gathers and sorts by length before placing them.
OPEN_BINS, GATHERED = 8192, 32 << 20
#: Pre-tokens of more characters are merged by the priority queue, which takes n log n steps for any text.
LONG_WORD = 400
#: Words whose ids a Python worker keeps. The library is fast, so few are enough, and they share the executor's memory.
KEPT_WORDS = 150_000


class LibraryIds:
    """Ids as a tokenizer library gives them, word by word, from the vocabulary of one tokenizer file."""

    def __init__(self, path: str):
        own = ByteBpe(path)
        names = np.split(own.strings, np.cumsum(own.lengths)[:-1])
        special = set(own.special.values())
        ranks = {x.tobytes(): i for i, x in enumerate(names) if i not in special}
        self.library = tiktoken.Encoding("words", pat_str=WORD, mergeable_ranks=ranks, special_tokens={})
        self.own, self.long = own, regex.compile(r"\S{%d}" % LONG_WORD)
        self.encode = WordSplit(self._whole, KEPT_WORDS)

    def _whole(self, text: str) -> bytes:
        if self.long.search(text) or any(x in text for x in self.own.special):
            return self.own._whole(text)
        return np.array(self.library.encode_ordinary(text), "<u4").tobytes()


@lru_cache(2)
def _ids(path: str) -> LibraryIds:
    return LibraryIds(path)


class BestFit:
    """Places sizes 1..capacity online into the open bin with the least free space that holds them.

    `spaces` is a bitset: bit f is set while some open bin has f free. With `open_bins` bins open, a size that fits
    none of them closes the fullest before it opens its own. Full bins close at once.
    """

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.spaces, self.bins, self.opened, self.open = 0, [deque() for _ in range(capacity + 1)], 0, 0

    def _take(self, space: int) -> int:
        found = self.bins[space].popleft()
        if not self.bins[space]:
            self.spaces ^= 1 << space
        self.open -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        """Number of the bin and the offset in it."""
        fitting = self.spaces >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            found = self._take(space)
        else:
            if self.open >= self.open_bins:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            space, found = self.capacity, self.opened
            self.opened += 1
        if left := space - size:
            self.bins[left].append(found)
            self.spaces |= 1 << left
            self.open += 1
        return found, self.capacity - space


def cut_points(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only one longer than `capacity` is cut, its first piece is shorter."""
    first = tokens % capacity or min(tokens, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, tokens, capacity)]


def pack_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024,
                   end_id: int = 2, open_bins: int = OPEN_BINS) -> DataFrame:
    """Tokenize whole texts, end each with `end_id`, and pack the pieces into sequences of at most `capacity` tokens.

    Returns a row per piece: `id_col`, piece int, start long, length long, ids binary (little-endian unsigned 32-bit),
    sequence_id long, offset long. Null and empty texts are the one token `end_id`. Repeated rows and null keys are
    packed like others; other columns are not read; an empty table gives no rows.

    Each task packs the rows it reads, so no text or id is shuffled and a lost task is packed anew by itself. It gathers
    a bounded number of pieces, places them longest first, and goes on with the bins still open. The fixed number of
    open bins bounds the memory; bins open at the end of a task are left with their space unused.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long"
    key_type = df.select(id_col).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer = _ids(path).encode, BestFit(capacity, open_bins)
        base, end = TaskContext.get().partitionId() << 40, np.array([end_id], "<u4").tobytes()
        rows, held = [], 0

        def placed() -> pa.RecordBatch:
            rows.sort(key=lambda r: -r[3])  # a stable sort: the same rows give the same bins again
            spots = [packer.place(r[3]) for r in rows]
            key, piece, start, length, ids = zip(*rows)
            arrow_key = pa.array(key, keys.type)
            return pa.RecordBatch.from_arrays(
                [arrow_key, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(ids, pa.binary()), pa.array([base + s for s, _ in spots], pa.int64()),
                 pa.array([o for _, o in spots], pa.int64())], schema_names)

        schema_names = [id_col, "piece", "start", "length", "ids", "sequence_id", "offset"]
        keys = None
        for batch in byte_slices(batches, text_col):
            keys = batch.column(0)
            for key, text in zip(keys.to_pylist(), texts_of(batch, text_col)):
                ids = encode(text) + end
                for piece, (start, length) in enumerate(cut_points(len(ids) // 4, capacity)):
                    rows.append((key, piece, start, length, ids[4 * start : 4 * (start + length)]))
                held += len(ids)
                if held >= GATHERED:
                    yield placed()
                    rows, held = [], 0
        if rows:
            yield placed()

    return mapped(df.select(id_col, text_col), run, schema)
