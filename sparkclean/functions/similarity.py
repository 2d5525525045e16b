"""Similarity of two strings, 0-100, scored for whole batches of candidate pairs at once.

The scores follow the published definitions of the token-set, partial and weighted ratios over the
normalized insert/delete distance, and of Jaro-Winkler. No text preprocessing; case matters.

A batch is a flat array of code points. Common subsequences are counted bit-parallel: a machine word (or
several, with a carry between them) of each pair is one entry of a numpy column, and one step for each
character of the shorter texts advances all pairs of a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

# Bytes of one comparison matrix, windows that are compared at a time, pairs of a batch and bytes of it.
CHUNK_BYTES, WINDOWS, BATCH_PAIRS, BATCH_BYTES = 1 << 20, 1 << 17, 1 << 17, 32 << 20
# Code points that no text has: they fill up texts and equal neither a character nor each other.
FILL_A, FILL_B = np.uint32(0xFFFFFFFE), np.uint32(0xFFFFFFFF)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of every range, one range after the other."""
    total = int(lengths.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


@dataclass(frozen=True)
class Texts:
    """Texts as code points: one flat array, and the start and length of each in it."""

    codes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Texts:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        return cls(codes, np.cumsum(lengths) - lengths, lengths)

    def take(self, rows: np.ndarray) -> Texts:
        return Texts(self.codes, self.starts[rows], self.lengths[rows])

    def part(self, starts: np.ndarray, lengths: np.ndarray) -> Texts:
        return Texts(self.codes, self.starts + starts, lengths)

    def padded(self, width: int, fill: np.uint32) -> np.ndarray:
        """A row of `width` code points for each text."""
        if not len(self.codes):
            return np.full((len(self.starts), width), fill)
        places = np.arange(width)
        at = np.minimum(self.starts[:, None] + places, len(self.codes) - 1)
        return np.where(places < self.lengths[:, None], self.codes[at], fill)


def _where(condition: np.ndarray, a: Texts, b: Texts) -> tuple[Texts, Texts]:
    """(a, b) where the condition holds, else (b, a)."""
    codes, shift = np.concatenate([a.codes, b.codes]), len(a.codes)
    b = Texts(codes, b.starts + shift, b.lengths)
    pick = lambda x, y: Texts(codes, np.where(condition, x.starts, y.starts), np.where(condition, x.lengths, y.lengths))
    a = Texts(codes, a.starts, a.lengths)
    return pick(a, b), pick(b, a)


def _chunks(wide: np.ndarray, narrow: np.ndarray) -> list[np.ndarray]:
    """Row numbers of pairs of similar lengths, so many that a comparison matrix of the chunk stays small."""
    order = np.lexsort((narrow, wide))
    out, end = [], len(order)
    while end:
        begin = max(0, end - max(1, CHUNK_BYTES // max(64, int(wide[order[end - 1]]))))
        out.append(order[begin:end])
        end = begin
    return out


def _words_of(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as machine words; the first column is the lowest bit."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    words = np.zeros((len(bits), -(-bits.shape[1] // 64) * 8), np.uint8)
    words[:, : packed.shape[1]] = packed
    return words.view(np.uint64)


def common_lengths(a: Texts, b: Texts) -> np.ndarray:
    """Length of the longest common subsequence of each pair."""
    longer, shorter = _where(a.lengths >= b.lengths, a, b)
    out = np.zeros(len(a.lengths), np.int64)
    for rows in _chunks(longer.lengths, shorter.lengths):
        x, y = longer.take(rows), shorter.take(rows)
        steps = int(y.lengths.max())
        if not steps:
            continue
        pattern = x.padded(int(x.lengths.max()), FILL_A)
        text = np.ascontiguousarray(y.padded(steps, FILL_B).T)
        state = [np.full(len(rows), ~np.uint64(0)) for _ in range(-(-pattern.shape[1] // 64))]
        for column in text:
            hits = _words_of(pattern == column[:, None])
            carry = None
            for w, open_bits in enumerate(state):
                hit = open_bits & hits[:, w]
                total = open_bits + hit
                over = total < open_bits
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64) if w + 1 < len(state) else None
                state[w] = total | (open_bits - hit)
        out[rows] = sum(64 - np.bitwise_count(s).astype(np.int64) for s in state)
    return out


def ratios(a: Texts, b: Texts) -> np.ndarray:
    total = a.lengths + b.lengths
    return np.where(total > 0, 200.0 * common_lengths(a, b) / np.maximum(total, 1), 100.0)


# --- parts ----------------------------------------------------------------------------------------

def _best_of_windows(short: Texts, long: Texts, n: np.ndarray, starts: Callable, lengths: Callable) -> np.ndarray:
    """Highest ratio of each short text and n windows of the long one, WINDOWS at a time."""
    best, ends = np.zeros(len(n)), np.cumsum(n)
    begin = 0
    while begin < len(n):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + WINDOWS, "right")))
        rows = np.repeat(np.arange(begin, end), n[begin:end])
        if len(rows):
            k = ragged(np.zeros(end - begin, np.int64), n[begin:end])
            x, window = short.take(rows), long.take(rows).part(starts(rows, k), lengths(rows, k))
            found = 200.0 * common_lengths(x, window) / (x.lengths + window.lengths)
            np.maximum.at(best, rows, found)
        begin = end
    return best


def _window_ratios(short: Texts, long: Texts) -> np.ndarray:
    """Best ratio of the short text with a window of its length, or a shorter one at either end, of the long one."""
    m, n = short.lengths, long.lengths
    best = _best_of_windows(short, long, n - m + 1, lambda rows, k: k, lambda rows, k: m[rows])
    # A window of w characters at either end scores 200 * w / (m + w) at most: only so long ones can be better.
    least = np.floor(best * m / (200.0 - best)).astype(np.int64)
    width = np.maximum(m - 1 - least, 0)
    size = lambda rows, k: least[rows] + 1 + k // 2
    ends = _best_of_windows(short, long, 2 * width, lambda rows, k: np.where(k % 2, n[rows] - size(rows, k), 0), size)
    return np.maximum(best, ends)


def partial_ratios(a: Texts, b: Texts) -> np.ndarray:
    out = np.where((a.lengths == 0) & (b.lengths == 0), 100.0, 0.0)
    rows = np.flatnonzero((a.lengths > 0) & (b.lengths > 0))
    short, long = _where(a.lengths[rows] <= b.lengths[rows], a.take(rows), b.take(rows))
    best = _window_ratios(short, long)
    same = np.flatnonzero((short.lengths == long.lengths) & (best < 100))
    best[same] = np.maximum(best[same], _window_ratios(long.take(same), short.take(same)))
    out[rows] = best
    return out


# --- words ----------------------------------------------------------------------------------------

class Words:
    """The words of different texts: numbers in the words' order, those of each text in a row."""

    def __init__(self, texts: list[str], distinct: bool):
        lists = [sorted(set(t.split()) if distinct else t.split()) for t in texts]
        names = sorted({w for words in lists for w in words})
        number = {w: i for i, w in enumerate(names)}
        self.counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.starts = np.cumsum(self.counts) - self.counts
        self.ids = np.fromiter((number[w] for words in lists for w in words), np.int64, int(self.counts.sum()))
        self.names = Texts.of([w + " " for w in names])

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position in `rows` and number of every word of the texts `rows`."""
        return np.repeat(np.arange(len(rows)), self.counts[rows]), self.ids[ragged(self.starts[rows], self.counts[rows])]

    def joined(self, n: int, owner: np.ndarray, ids: np.ndarray) -> Texts:
        """The words of n texts, one space between them."""
        sizes = self.names.lengths[ids]
        lengths = np.bincount(owner, sizes, n).astype(np.int64)
        return Texts(self.names.codes[ragged(self.names.starts[ids], sizes)], np.cumsum(lengths) - lengths, np.maximum(lengths - 1, 0))

    def texts(self) -> Texts:
        return self.joined(len(self.counts), *self.of(np.arange(len(self.counts))))


def _token_set(words: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n, many = len(a), len(words.names.lengths) + 1
    (own_a, ids_a), (own_b, ids_b) = words.of(a), words.of(b)
    keys_a, keys_b = own_a * many + ids_a, own_b * many + ids_b  # both rise
    in_b, in_a = (np.isin(x, y, assume_unique=True) for x, y in ((keys_a, keys_b), (keys_b, keys_a)))
    x = words.joined(n, own_a[~in_b], ids_a[~in_b])
    y = words.joined(n, own_b[~in_a], ids_b[~in_a])
    shared = np.bincount(own_a[in_b], minlength=n)
    base = np.maximum(np.bincount(own_a[in_b], words.names.lengths[ids_a[in_b]], n).astype(np.int64) - 1, 0)
    gap = np.minimum(shared, 1)
    total = 2 * (base + gap) + x.lengths + y.lengths
    both = np.flatnonzero((x.lengths > 0) & (y.lengths > 0))
    common = np.zeros(n, np.int64)
    common[both] = common_lengths(x.take(both), y.take(both))
    best = 100.0 * (total - (x.lengths + y.lengths - 2 * common)) / np.maximum(total, 1)
    rest = np.minimum(x.lengths, y.lengths)
    best = np.where(shared > 0, np.maximum(best, 200.0 * base / np.maximum(2 * base + gap + rest, 1)), best)
    best = np.where((shared > 0) & (rest == 0), 100.0, best)
    return np.where((words.counts[a] == 0) | (words.counts[b] == 0), 0.0, best)


def _shares_word(words: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    many = len(words.names.lengths) + 1
    (own_a, ids_a), (own_b, ids_b) = words.of(a), words.of(b)
    return np.bincount(own_a[np.isin(own_a * many + ids_a, own_b * many + ids_b)], minlength=len(a)) > 0


# --- Jaro-Winkler ---------------------------------------------------------------------------------

# Jaro-Winkler prefix weight, longest prefix, and the Jaro score the prefix needs.
PREFIX_WEIGHT, PREFIX_MAX, PREFIX_FROM = 0.1, 4, 0.7


def _leading(codes: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """The marked entries of each row, moved to its front in their order."""
    return np.take_along_axis(codes, np.argsort(~marked, axis=1, kind="stable"), 1)


def _jaro_matches(x: np.ndarray, y: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matched places of each row of x and y: each character of x takes the first free equal one of y within reach."""
    words = -(-y.shape[1] // 64)
    free = [np.full(len(x), ~np.uint64(0)) for _ in range(words)]
    marked_x, places = np.zeros(x.shape, bool), np.arange(y.shape[1])
    for i in range(x.shape[1]):
        near = (y == x[:, i : i + 1]) & (np.abs(places - i) <= reach[:, None])
        hits, found = _words_of(near), np.zeros(len(x), bool)
        for w in range(words):
            able = np.where(found, np.uint64(0), hits[:, w] & free[w])
            free[w] &= ~(able & (~able + np.uint64(1)))
            found |= able > 0
        marked_x[:, i] = found
    taken = np.unpackbits(np.stack([~f for f in free], axis=1).view(np.uint8), axis=1, bitorder="little").astype(bool)
    return marked_x, taken[:, : y.shape[1]]


def jaro_winklers(a: Texts, b: Texts) -> np.ndarray:
    out = np.where((a.lengths == 0) & (b.lengths == 0), 100.0, 0.0)
    able = np.flatnonzero((a.lengths > 0) & (b.lengths > 0))
    for rows in _chunks(np.maximum(a.lengths[able], b.lengths[able]), a.lengths[able]):
        rows = able[rows]
        m, n = a.lengths[rows], b.lengths[rows]
        x = a.take(rows).padded(int(m.max()), FILL_A)
        y = b.take(rows).padded(int(n.max()), FILL_B)
        marked_x, marked_y = _jaro_matches(x, y, np.maximum(np.maximum(m, n) // 2 - 1, 0))
        hits = marked_x.sum(axis=1)
        width = max(int(hits.max()), 1)
        order = np.arange(width) < hits[:, None]
        swaps = ((_leading(x, marked_x)[:, :width] != _leading(y, marked_y)[:, :width]) & order).sum(axis=1) // 2
        some = np.maximum(hits, 1)
        jaro = np.where(hits > 0, (hits / m + hits / n + (hits - swaps) / some) / 3, 0.0)
        same = np.zeros(len(rows), np.int64)
        alike = np.ones(len(rows), bool)
        for k in range(min(PREFIX_MAX, x.shape[1], y.shape[1])):
            alike &= x[:, k] == y[:, k]
            same += alike
        out[rows] = 100.0 * np.where(jaro > PREFIX_FROM, jaro + PREFIX_WEIGHT * same * (1 - jaro), jaro)
    return out


# --- weighted ratio -------------------------------------------------------------------------------

# Weights of the weighted ratio.
TOKEN_SCALE = 0.95
PARTIAL_SCALE, FAR_PARTIAL_SCALE = 0.9, 0.6
PARTIAL_FROM, FAR_FROM = 1.5, 8.0


def _weighted(texts: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    whole, every, sets = Texts.of(texts), Words(texts, False), Words(texts, True)
    x, y, sorted_text, set_text = whole.take(a), whole.take(b), every.texts(), sets.texts()
    out, some = np.zeros(len(a)), np.flatnonzero((x.lengths > 0) & (y.lengths > 0))
    a, b, x, y = a[some], b[some], x.take(some), y.take(some)
    stretch = np.maximum(x.lengths, y.lengths) / np.minimum(x.lengths, y.lengths)
    best = ratios(x, y)
    near, far = np.flatnonzero(stretch < PARTIAL_FROM), np.flatnonzero(stretch >= PARTIAL_FROM)
    best[near] = np.maximum(best[near], TOKEN_SCALE * np.maximum(
        ratios(sorted_text.take(a[near]), sorted_text.take(b[near])), _token_set(sets, a[near], b[near])))
    scale = np.where(stretch[far] <= FAR_FROM, PARTIAL_SCALE, FAR_PARTIAL_SCALE)
    words = np.maximum(*(partial_ratios(t.take(a[far]), t.take(b[far])) for t in (sorted_text, set_text)))
    words = np.where(_shares_word(sets, a[far], b[far]), 100.0, words)
    best[far] = np.maximum(best[far], np.maximum(scale * partial_ratios(x.take(far), y.take(far)), scale * TOKEN_SCALE * words))
    out[some] = best
    return out


# Scores of the pairs (a[i], b[i]) of numbers of different texts.
SCORERS: dict[str, Callable[[list[str], np.ndarray, np.ndarray], np.ndarray]] = {
    "token_set_ratio": lambda texts, a, b: _token_set(Words(texts, True), a, b),
    "partial_ratio": lambda texts, a, b: partial_ratios(*(Texts.of(texts).take(x) for x in (a, b))),
    "jaro_winkler": lambda texts, a, b: jaro_winklers(*(Texts.of(texts).take(x) for x in (a, b))),
    "wratio": _weighted,
}


def score_pairs(algorithm: str, a: list[str], b: list[str]) -> np.ndarray:
    """Scores of the pairs of two lists of texts; each different text is read once."""
    numbers, texts = pd.factorize(np.concatenate([np.asarray(a, object), np.asarray(b, object)]))
    return SCORERS[algorithm](list(texts), numbers[: len(a)], numbers[len(a) :])


def reaching(pairs: DataFrame, algorithm: str, floor: float) -> DataFrame:
    """Those of the pairs a, b, key_a, key_b whose keys score `floor` or more, with their score.

    A task scores BATCH_PAIRS pairs at a time, or fewer of long keys.
    """
    names = ["a", "b", "key_a", "key_b", "score"]

    def scored(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        keys = pa.chunked_array([*table.column("key_a").chunks, *table.column("key_b").chunks]).combine_chunks().dictionary_encode()
        numbers = keys.indices.to_numpy()
        score = SCORERS[algorithm](keys.dictionary.to_pylist(), numbers[: len(table)], numbers[len(table) :])
        table = table.append_column("score", pa.array(score)).filter(pa.array(score >= floor))
        return pa.RecordBatch.from_arrays([table.column(n).combine_chunks() for n in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= BATCH_PAIRS or size >= BATCH_BYTES:
                yield scored(held)
                held, rows, size = [], 0, 0
        if rows:
            yield scored(held)

    return pairs.select(*names[:4]).mapInArrow(run, "a long, b long, key_a string, key_b string, score double")
