"""Hashed word shingles of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

from sparkclean.llm.common import ragged

#: Odd multiplier of the hashes, and the longest word in bytes that is hashed in numpy, eight bytes a step.
FACTOR, LONG_WORD = np.uint64(0x9E3779B97F4A7C15), 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_kept = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that lie one after the other in `data`, A-Z like a-z, and the numbers of words of the texts.

    A word's hash takes in eight bytes after the other, each time mixed through a bijection of all bits, so that no words
    collide for the sake of their structure, as they do under polynomials modulo 2^64. Words beyond LONG_WORD bytes go
    through blake2b. Hashes of different seeds are independent.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    lower = np.zeros(len(data) + 8, np.uint8)
    np.take(_lower, data, out=lower[: len(data)])
    inside = ~_space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = offsets[(offsets > 0) & (offsets < len(data))]
    first[bounds] = inside[bounds]  # texts end words
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[bounds - 1] = inside[bounds - 1]
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sizes = ends - begins
    pieces = np.ndarray((len(data) + 1,), np.uint64, buffer=lower, strides=(1,))  # the eight bytes from each place on
    hashes = mix(sizes.astype(np.uint64) + (np.uint64(seed) << np.uint64(48)))
    rows = np.arange(len(sizes))
    for k in range(0, LONG_WORD, 8):
        if k:
            rows = rows[sizes[rows] > k]
        if not len(rows):
            break
        piece = pieces[begins[rows] + k] & _kept[np.minimum(sizes[rows] - k, 8)]
        hashes[rows] = mix(hashes[rows] * FACTOR ^ piece)
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        digest = blake2b(lower[begins[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        hashes[i] = int.from_bytes(digest, "little")
    return hashes, np.diff(np.searchsorted(begins, offsets))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of `width` words of each text, sorted, one text after the other; and their numbers.

    A text of fewer words has its whole sequence as the one shingle; a text without words has none. Two texts of fewer
    words, of different numbers of words, have different shingles.
    """
    words, counts = word_hashes(data, offsets, seed)
    starts = np.cumsum(counts) - counts
    each = np.maximum(counts - width + 1, np.minimum(counts, 1))
    at = ragged(starts, each)
    texts = np.repeat(np.arange(len(counts)), each)
    short = np.minimum(counts, width)[texts]
    hashed = np.zeros(len(at), np.uint64)
    for k in range(width):
        there = k < short
        step = words[np.minimum(at + k, len(words) - 1)] if len(words) else words
        hashed = np.where(there, mix(hashed * FACTOR + step + np.uint64(k + 1)), hashed)
    return distinct_by_text(hashed, each)


def distinct_by_text(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort the values of each text in place and drop repeats; `sizes` are the numbers of values of the texts."""
    ends = np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[(ends - sizes)[sizes > 0]] = True
    return values[new], np.diff(np.concatenate([[0], np.cumsum(new)])[np.concatenate([[0], ends])])
