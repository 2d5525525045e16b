"""Periodic runs of words: a suffix automaton whose link tree keeps last occurrences on link-cut paths.

Each appended word makes the path from its state to the root the last occurrence of all suffixes of what was read. Before
that, the path is cut into segments, each with one earlier end of occurrence. Where the distance d of the two ends is a
length that the segment spells, the last d words stand twice side by side: a square with a primitive root. Squares of one
period that end at neighbouring words make a run.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkclean.llm.common import byte_slices, ragged
from sparkclean.llm.shingles import FACTOR, mix

#: Bytes of text read at a time.
SLICE = 2 << 20


class Squares:
    """Suffix automaton of a growing word list; `append` tells the periods of the primitive squares that end there.

    State 1 is the root, 0 none. A state keeps its first transition in two arrays, further ones in a dictionary. Preferred
    paths of the link tree are splay trees (`left` towards the root), so that all states of one tree have the same last
    occurrence, kept at the tree's own root.
    """

    def __init__(self, words: int):
        size = 2 * words + 2
        self.length, self.link, self.letter, self.to = (array("i", bytes(4 * size)) for _ in range(4))
        self.left, self.right, self.up, self.seen = (array("i", bytes(4 * size)) for _ in range(4))
        self.more: dict[int, dict[int, int]] = {1: {}}
        self.states = self.whole = 1
        self.read = 0

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        p = up[x]
        g = up[p]
        if left[g] == p and g:
            left[g] = x
        elif right[g] == p and g:
            right[g] = x
        else:
            self.seen[x] = self.seen[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner:
            up[inner] = p
        up[p] = x
        up[x] = g

    def _splay(self, x: int) -> None:
        left, right, up, rotate = self.left, self.right, self.up, self._rotate
        while (p := up[x]) and (left[p] == x or right[p] == x):
            if (g := up[p]) and (left[g] == p or right[g] == p):
                rotate(p if (left[g] == p) == (left[p] == x) else x)
            rotate(x)

    def _access(self, x: int) -> list[int]:
        """Recolour the path from x to the root; periods of the primitive squares that the old segments show."""
        length, right, up, seen, now = self.length, self.right, self.up, self.seen, self.read
        found, below, y = [], 0, x
        reach = earlier = 0  # of the segment below: the longest suffix it spells, and where that ended before
        while y:
            self._splay(y)
            if cut := right[y]:
                seen[cut] = seen[y]
            if earlier and length[y] < now - earlier <= reach:
                found.append(now - earlier)
            reach, earlier = length[y], seen[y]
            right[y] = below
            below = y
            y = up[y]
        if earlier and now - earlier <= reach:  # the segment that ends in the root
            found.append(now - earlier)
        self._splay(x)
        seen[x] = now
        return found

    def append(self, word: int) -> list[int]:
        """Periods of the primitive squares that end with `word`, a number from 1."""
        length, link, letter, to, more = self.length, self.link, self.letter, self.to, self.more
        self.read += 1
        self.states += 1
        new, p = self.states, self.whole
        length[new] = length[p] + 1
        q = 0
        while p:
            if letter[p] == word:
                q = to[p]
                break
            own = more.get(p)
            if own is not None and word in own:
                q = own[word]
                break
            if own is not None:
                own[word] = new
            elif letter[p]:
                more[p] = {word: new}
            else:
                letter[p], to[p] = word, new
            p = link[p]
        if not p:
            link[new] = 1
        elif length[p] + 1 == length[q]:
            link[new] = q
        else:
            self.states += 1
            clone = self.states
            length[clone], link[clone] = length[p] + 1, link[q]
            letter[clone], to[clone] = letter[q], to[q]
            if q in more:
                more[clone] = more[q].copy()
            link[q] = link[new] = clone
            while p:
                if letter[p] == word:
                    if to[p] != q:
                        break
                    to[p] = clone
                else:
                    own = more.get(p)
                    if own is None or own.get(word) != q:
                        break
                    own[word] = clone
                p = link[p]
            # The clone's words ended where q's did, so it joins q's path, right above q.
            self._splay(q)
            above = self.left[q]
            self.left[clone], self.left[q], self.up[clone] = above, clone, q
            if above:
                self.up[above] = clone
        self.up[new] = link[new]
        self.whole = new
        return self._access(new)


def maximal_runs(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least twice their smallest period. Words are numbers from 1."""
    squares, running, out = Squares(len(words)), {}, []
    for i, word in enumerate(words):
        for period in squares.append(word):
            first, last = running.get(period, (i, i - 1))
            if last != i - 1:
                out.append((first - 2 * period + 1, last - first + 2 * period, period))
                first = i
            running[period] = first, i
    return out + [(first - 2 * period + 1, last - first + 2 * period, period) for period, (first, last) in running.items()]


def stretches(words: np.ndarray, owner: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Begin and end of the stretches outside of which no run of `least` words can have a word.

    A run of length m and period q consists of two copies, q words apart, of m - q >= m / 2 words. So each of its words
    lies in a piece of ceil(least / 2) words that stands twice in the run. Words in no piece that repeats within their
    text part it; then the same holds within each part. Pieces are compared by hash: a collision only keeps more.
    """
    width, keep = max(1, -(-least // 2)), np.arange(len(words))
    part = owner.astype(np.uint64)
    while len(keep) >= least:
        value = words[keep]
        n = len(keep) - width + 1
        hashed = mix(part[:n] + np.uint64(1))
        for k in range(width):
            hashed = hashed * FACTOR + value[k : n + k]
        inside = part[:n] == part[width - 1 :]
        hashed = mix(hashed)
        order = np.argsort(hashed[inside])
        at, ordered = np.flatnonzero(inside)[order], hashed[inside][order]
        same = ordered[1:] == ordered[:-1]
        again = np.zeros(len(ordered), bool)
        again[1:] |= same
        again[:-1] |= same
        change = np.zeros(len(keep) + 1, np.int64)
        np.add.at(change, at[again], 1)
        np.add.at(change, at[again] + width, -1)
        covered = np.cumsum(change[:-1]) > 0
        held, before = keep[covered], part[covered]
        fresh = np.ones(len(held), bool)
        fresh[1:] = (np.diff(held) != 1) | (before[1:] != before[:-1])
        number = np.cumsum(fresh) - 1
        sizes = np.bincount(number) if len(held) else np.zeros(0, np.int64)
        long = sizes[number] >= least if len(held) else np.zeros(0, bool)
        held, number = held[long], number[long]
        if len(held) == len(keep):
            break
        keep, part = held, number.astype(np.uint64)
    else:
        return []
    cuts = np.flatnonzero(np.diff(part, prepend=part[:1] + np.uint64(1)))
    ends = np.append(cuts[1:], len(keep)) - 1
    return list(zip(keep[cuts].tolist(), (keep[ends] + 1).tolist()))


def runs_of(texts: list[list[bytes]], least: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of at least `least` words of each text, by start, then period."""
    number: dict[bytes, int] = defaultdict(count(1).__next__)
    sizes = np.array([len(x) for x in texts], np.int64)
    words = np.fromiter((number[w] for text in texts for w in text), np.uint64, int(sizes.sum()))
    owner, starts = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for begin, end in stretches(words, owner, least):
        text = int(owner[begin])
        shift = begin - int(starts[text])
        local: dict[int, int] = defaultdict(count(1).__next__)
        found = maximal_runs([local[w] for w in words[begin:end].tolist()])
        out[text] += [(start + shift, length, period) for start, length, period in found if length >= least]
    for own in out:
        own.sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run contains behind its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """Periodic runs of every whole text: `id_col`, n_words long, runs array<struct<start, length, period: long>>, collapsed.

    Words are runs of other characters than ASCII white space, numbered from 0. A run is a stretch of words with the
    smallest period q, at least max(least, 2 * q) long, that no neighbouring word extends. Runs come by start, then
    period. `collapsed` holds the words that no run contains behind its first q words, joined by one space. A text of
    one word over and over is one run of period 1.

    Null, empty and wordless texts have no runs and the empty text. Every input row gives one row, repeated rows and null
    ids too; an empty table gives none; other columns are not read. A text is read as a whole, in memory in proportion to
    its number of words; nothing is shuffled.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "n_words", "runs", "collapsed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, text_col, SLICE):
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            words = [(x or b"").split() for x in texts]
            runs = runs_of(words, least)
            collapsed = [b" ".join(kept_words(w, r) if r else w) for w, r in zip(words, runs)]
            flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            offsets = np.cumsum([0] + [len(x) for x in runs]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in words], pa.int64()), pa.ListArray.from_arrays(offsets, structs),
                 pa.array(collapsed, pa.large_binary()).cast(pa.large_string()).cast(pa.string())], names)

    schema = f"`{id_col}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return df.select(id_col, text_col).mapInArrow(run, schema)
