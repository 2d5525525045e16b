"""Fuzzy duplicates: similar keys, found without comparing all rows with all rows.

The result is defined by a scan in row order: a kept row removes every later row whose key scores at
least the threshold. Three things make that a Spark job:

1. Equal keys collapse to one representative before anything is compared.
2. Candidate pairs come from joins on signatures. A score at or above the threshold forces two keys to
   share a known minimum of elements (words, letter pairs or letters). With elements ordered rare-first,
   such keys must share one element, or one combination of elements, among the first few of each. Those
   combinations are the signatures. They are complete: no pair at or above the threshold is missed, and
   frequent elements hardly ever become signatures.
3. Only kept rows can remove others. When a set has more candidate pairs than its budget (many mutually
   similar rows), its first part is resolved alone, the kept rows of that part clear the rest, and only
   the survivors go on. A large group of near-copies shrinks to its few kept rows before it is expanded.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field, replace
from functools import reduce
from math import ceil, comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkclean.functions.keys import composite_key, token_set_key, tokens_of
from sparkclean.functions.missing import col, nan_to_null
from sparkclean.functions.names import free_prefix
from sparkclean.functions.similarity import (
    PARTIAL_SCALE, PREFIX_FROM, PREFIX_MAX, PREFIX_WEIGHT, SCORERS, TOKEN_SCALE, reaching,
)
from sparkclean.sources.scratch import written

# Candidate pairs worked on at once: so many per row, but at least the floor.
PAIRS_PER_ROW = 500
MIN_PAIR_BUDGET = 10_000_000
# Candidate pairs that one task compares.
PAIRS_PER_TASK = 500_000
# A signature shared by more pairs than this is spread over a grid of tasks.
CELL_ROWS = 5_000
# The element order uses the counts of this many most frequent elements (the broadcast is bounded).
FREQUENT_ELEMENTS = 50_000
# Edges among the rows of one prefix of the row order, which one task resolves.
PREFIX_EDGES = 500_000
# Sets of this many rows are never split further.
MIN_SPLIT_ROWS = 200
EPSILON = 1e-9
# Scorers of which a call costs more than counting shared elements; the others score every candidate.
COSTLY = ("partial_ratio", "wratio")


@dataclass(frozen=True)
class Overlap:
    """Elements two keys must share, and how the signatures are drawn from that.

    `elements` names the element kind. The smaller key (n elements) shares at least small(n) of them, the
    larger at least large(n); their sizes satisfy small >= reach * large. `prefix` letters must be equal.
    With `contains`, only the smaller (contained) key has a bound; the other may be of any size.
    """

    name: str
    elements: str
    small: tuple[float, float]
    large: tuple[float, float] = (0.0, 1.0)
    reach: float = 0.0
    prefix: int = 0
    contains: bool = False
    min_length: int = 0
    max_length: int | None = None
    above: int = 0  # pairs whose larger key has no more elements are found by other rules


@dataclass(frozen=True)
class WordCover:
    """The smaller key's words, weighted by length + 1, must be covered to this share by the other's."""

    name: str
    share: float


@dataclass(frozen=True)
class Remainder:
    """Keys of these lengths, less `dropped` letters, must be equal: as they stand, or as a bag (letters in any order)."""

    prefix: int
    bag: bool
    dropped: int
    lengths: tuple[int, ...]


@dataclass(frozen=True)
class WordRemainder:
    """Keys of these lengths, less `dropped` letters or spaces, must consist of the same words."""

    dropped: int
    lengths: tuple[int, ...]


@dataclass
class FuzzyResult:
    df: DataFrame
    rows_removed: int
    warnings: list[str] = field(default_factory=list)


# --- what a threshold implies ---------------------------------------------------------------------
#
# With L = total length of both texts and t the threshold, a ratio >= t leaves at most (1-t)*L characters
# out of the common subsequence. Each such character breaks at most one adjacent pair of that
# subsequence, so at least L*(1.5t - 1) letter pairs (plus a constant from the padding) are common. For
# low thresholds that bound is weak and single letters are used: at least t*L/2 are common.

PAIRS_FROM = 0.75  # letter pairs are used from this threshold on


def _similar(name: str, pairs: str, letters: str, t: float) -> Overlap:
    ratio_of_lengths = t / (2 - t)
    if t >= PAIRS_FROM:
        slope = 1.5 * t - 1
        both = slope * (1 + ratio_of_lengths)
        return Overlap(name, pairs, (2 * slope, 1 - 2 * slope), (both, 1 - both), 0.99 * ratio_of_lengths)
    return Overlap(name, letters, (t, 0.0), (t / (2 - t), 0.0), ratio_of_lengths)


def _substring(name: str, pairs: str, letters: str, t: float) -> list[Overlap]:
    """The shorter text is similar to a window of the longer one."""
    split = None
    out = []
    if t >= PAIRS_FROM:
        slope = (3 * t - 2) / (2 - t)
        split = int(3 / slope) + 1  # from this length on at least two letter pairs are common
        # n letter pairs stand for n + 1 letters
        out.append(Overlap(f"{name}-pairs", pairs, (slope, slope - 1), contains=True, min_length=split))
    out.append(Overlap(f"{name}-letters", letters, (t / (2 - t), 0.0), contains=True,
                       max_length=None if split is None else split - 1))
    return out


def _jaro_needed(t: float, k: int) -> float:
    """The Jaro score that a pair with k leading letters in common needs."""
    return min(t, max((t - PREFIX_WEIGHT * k) / (1 - PREFIX_WEIGHT * k), PREFIX_FROM)) if k else t


def _jaro_rules(t: float) -> list[Overlap]:
    """One rule per length of the common prefix: the longer it is, the lower the Jaro score may be."""
    out = []
    for k in range(PREFIX_MAX + 1):
        j = _jaro_needed(t, k)
        reach = max(3 * j - 2, 0.0)
        out.append(Overlap(f"jaro-{k}", "letters", (max(3 * j - 1, 0) / 2, 0.0), (reach, 0.0), 0.99 * reach, prefix=k))
    return out


# Signatures of one key, and letters left out, up to which keys are met by what is left of them.
MAX_REMAINDERS, MAX_DROPPED = 300, 3
# Lengths that are looked at, from the shortest on.
REMAINDER_LENGTHS = 64


def _remainders_of(t: float, small: int, large: int) -> set[tuple[int, bool, int]]:
    """(prefix, bag, letters left): what keys of two lengths must have in common to reach the threshold.

    Jaro is the mean of m / small, m / large and (m - swaps) / m for m matched letters. Without swaps the matched letters stand
    in the same order in both keys, so both keys leave the same text of m letters; with swaps they leave the same bag.
    """
    out, fewest, fewest_in_bag = set(), small + 1, small + 1
    for k in range(PREFIX_MAX + 1):
        least = 3 * _jaro_needed(t, k) - 1e-7
        able = [m for m in range(1, small + 1) if m / small + m / large + 1 >= least]
        swapped = [m for m in able if m > 1 and m / small + m / large + (m - 1) / m >= least]
        if swapped and swapped[0] < fewest_in_bag:  # a shorter prefix that leaves no more finds these pairs as well
            fewest_in_bag = swapped[0]
            out.add((k, True, swapped[0]))
        # All letters of two keys of one length in the same order: the same key.
        if able and able[0] < min(fewest, fewest_in_bag) and not able[0] == small == large:
            fewest = able[0]
            out.add((k, False, able[0]))
    return out


def remainder_rules(t: float, lengths: list[int]) -> tuple[list[Remainder], int]:
    """Rules for all pairs of the shortest lengths, and the last length for which a key's signatures are few."""
    own: dict[int, set[tuple[int, bool, int]]] = {}
    last = 0
    for n in sorted(x for x in lengths if x > 0):
        more = {x: set(found) for x, found in own.items()} | {n: set()}
        for x in list(more):
            found = _remainders_of(t, x, n)
            more[x] |= found
            more[n] |= found
        if any(x - m > MAX_DROPPED for x, found in more.items() for _, _, m in found) or any(
                sum(comb(x, m) for _, _, m in found) > MAX_REMAINDERS for x, found in more.items()):
            break
        own, last = more, n
    groups: dict[tuple[int, bool, int], list[int]] = {}
    for n, found in own.items():
        for k, bag, m in found:
            groups.setdefault((k, bag, n - m), []).append(n)
    return [Remainder(*g, tuple(ns)) for g, ns in groups.items()], last


# Shapes (letters in alphabetical order, any digit as 0) up to which keys are told apart by shape, not by length alone.
MAX_SHAPES = 200


def _shapes(keys: DataFrame) -> DataFrame:
    alike = keys.select(F.translate("key", "123456789", "0" * 9).alias("text")).distinct()
    return alike.select(F.array_join(F.array_sort(_pieces(F.col("text"), 1)), "").alias("shape")).distinct()


def _apart(a: str, b: str) -> int:
    """Letters that one of two shapes has more often than the other."""
    x, y = Counter(a), Counter(b)
    return (x - y).total() + (y - x).total()


def word_remainder_rules(t: float, shapes: dict[int, list[str]], words: dict[int, int]) -> tuple[list[WordRemainder], int]:
    """Rules for all pairs of the shortest lengths, and the last length for which a key's signatures are few.

    A pair scores by its texts (not by its common words alone) if at most 1 - t of both lengths stand outside a common
    subsequence of what their different words spell. Less these letters and spaces, both keys consist of the same words:
    the common ones, and the pieces of that subsequence. `shapes` and `words` give the shapes and the most words of the
    keys of each length; no shapes: any.
    """
    own: dict[int, set[int]] = {}
    last = 0
    for n in sorted(words):
        more = {x: set(found) for x, found in own.items()} | {n: set()}
        for x in more:
            outside = int((1 - t) * (n + x) + 1e-6)
            # Two keys of one length less nothing: the same key.
            if outside >= (n - x or 2) and (not shapes or any(_apart(a, b) <= outside for a in shapes[x] for b in shapes[n])):
                from_shorter = (outside - (n - x)) // 2
                more[x].add(from_shorter)
                more[n].add(from_shorter + n - x)
        steps = {x: x - (w - 1) + comb(w, 2) for x, w in words.items()}
        if any(sum(comb(steps[x], d) for d in found) > MAX_REMAINDERS or max(found, default=0) > MAX_DROPPED for x, found in more.items()):
            break
        own, last = more, n
    groups: dict[int, list[int]] = {}
    for n, found in own.items():
        for d in found:
            groups.setdefault(d, []).append(n)
    return [WordRemainder(d, tuple(ns)) for d, ns in groups.items()], last


def _word_remainders(keys: DataFrame, t: float) -> tuple[list[WordRemainder], int, int]:
    """The rules for these keys, the last length that they cover, and the largest length."""
    size = F.length("key")
    longest = keys.agg(F.max(size)).first()[0] or 0
    if not PAIRS_FROM <= t < 1:
        return [], 0, longest
    # Beyond this length two keys of one length may lack more letters than are ever dropped.
    short = keys.where((size > 0) & (size < (MAX_DROPPED + 1) / (1 - t)))
    words = {r["n"]: r["w"] for r in short.groupBy(size.alias("n")).agg(F.max(F.size(tokens_of(F.col("key")))).alias("w")).collect()}
    found = [r["shape"] for r in _shapes(short).limit(MAX_SHAPES + 1).collect()]
    shapes: dict[int, list[str]] = {}
    if len(found) <= MAX_SHAPES:
        for shape in found:
            shapes.setdefault(len(shape), []).append(shape)
    return *word_remainder_rules(t, shapes, words), longest


def rules_for(algorithm: str, t: float) -> list[Overlap | WordCover]:
    if algorithm == "token_set_ratio":
        # At 1 the texts of the different words would have to be equal, so only common words can reach it.
        return [WordCover("words", t / (2 - t)), *([_similar("word-text", "word_pairs", "letters", t)] if t < 1 else [])]
    if algorithm == "partial_ratio":
        return _substring("part", "inner_pairs", "letters", t)
    if algorithm == "jaro_winkler":
        return _jaro_rules(t)
    rules: list[Overlap | WordCover] = [_similar("whole", "padded_pairs", "letters", t)]
    token = t / TOKEN_SCALE
    if token <= 1:
        rules += [WordCover("words", token / (2 - token)),
                  _similar("sorted-text", "all_word_pairs", "all_word_letters", token),
                  _similar("set-text", "word_pairs", "word_letters", token)]
    part = t / PARTIAL_SCALE
    if part <= 1:
        rules += _substring("part", "inner_pairs", "letters", part)
    words = t / (TOKEN_SCALE * PARTIAL_SCALE)
    if words <= 1:
        rules += [WordCover("one-word", 0.0),
                  *_substring("part-sorted", "sorted_inner_pairs", "all_word_letters", words),
                  *_substring("part-set", "set_inner_pairs", "word_letters", words)]
    return rules


# --- elements of a key ----------------------------------------------------------------------------

def _pieces(text: Column, size: int) -> Column:
    """All substrings of `size` characters; empty for shorter text."""
    last = F.length(text) - (size - 1)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(size)))
    return F.when(last >= 1, cut).otherwise(F.array().cast("array<string>"))


def _word_pairs(words: Column) -> Column:
    return F.flatten(F.transform(words, lambda w: _pieces(F.concat(F.lit(" "), w, F.lit(" ")), 2)))


def _elements(kind: str, key: Column) -> Column:
    words = tokens_of(key)
    distinct = F.array_distinct(words)
    sorted_text = F.array_join(F.array_sort(words), " ")
    set_text = F.array_join(F.array_sort(distinct), " ")
    return {
        "words": lambda: distinct,
        "letters": lambda: _pieces(key, 1),
        "inner_pairs": lambda: _pieces(key, 2),
        "padded_pairs": lambda: _pieces(F.concat(F.lit(" "), key, F.lit(" ")), 2),
        "word_pairs": lambda: _word_pairs(distinct),
        "all_word_pairs": lambda: _word_pairs(words),
        "word_letters": lambda: _pieces(set_text, 1),
        "all_word_letters": lambda: _pieces(sorted_text, 1),
        "sorted_inner_pairs": lambda: _pieces(sorted_text, 2),
        "set_inner_pairs": lambda: _pieces(set_text, 2),
    }[kind]()


def _remainder_signatures(rule: Remainder) -> str:
    letters = "transform(sequence(1, length(key)), i -> substring(key, i, 1))"
    left = f"array({f'array_join(array_sort({letters}), {chr(39) * 2})' if rule.bag else 'key'})"
    for _ in range(rule.dropped):
        left = (f"array_distinct(flatten(transform({left}, s -> transform(sequence(1, length(s)), "
                "i -> concat(substring(s, 1, i - 1), substring(s, i + 1))))))")
    tag = f"concat('left/{rule.prefix}/{rule.bag}/', substring(key, 1, {rule.prefix}), '/', block)"
    mine = f"transform({left}, s -> xxhash64({tag}, s))"
    return f"CASE WHEN length(key) IN ({', '.join(map(str, rule.lengths))}) AND length(key) >= {rule.prefix} THEN {mine} ELSE {NO_SIGNATURES} END"


def _word_remainder_signatures(rule: WordRemainder) -> str:
    """A hash of the words that are left, in any order. A dropped space joins any two words: others may stand between them."""
    texts, parts = "array(key)", []
    for spaces in range(rule.dropped + 1):
        left = texts
        for _ in range(rule.dropped - spaces):
            left = (f"array_distinct(flatten(transform({left}, s -> transform(filter(sequence(1, length(s)), i -> substring(s, i, 1) <> ' '), "
                    "i -> concat(substring(s, 1, i - 1), substring(s, i + 1))))))")
        parts.append(left)
        joined = ("transform(sequence(1, size(w) - 1), i -> transform(sequence(i + 1, size(w)), j -> array_join(concat("
                  "slice(w, 1, i - 1), array(concat(w[i - 1], w[j - 1])), slice(w, i + 1, j - i - 1), slice(w, j + 1, size(w))), ' ')))")
        one = _let("w", "split(s, ' ')", f"CASE WHEN size(w) > 1 THEN flatten({joined}) ELSE cast(array() AS array<string>) END")
        texts = f"array_distinct(flatten(transform({texts}, s -> {one})))"
    mine = f"transform(concat({', '.join(parts)}), s -> aggregate(split(s, ' '), xxhash64('left', block), (h, w) -> h ^ xxhash64(w)))"
    return f"CASE WHEN length(key) IN ({', '.join(map(str, rule.lengths))}) THEN array_distinct({mine}) ELSE {NO_SIGNATURES} END"


def _kind(rule: Overlap | WordCover) -> str:
    return "words" if isinstance(rule, WordCover) else rule.elements


def element_table(keys: DataFrame, kinds: list[str]) -> DataFrame:
    """(rank, key, block, one array per kind): the elements of every key, rarest first.

    A repeated element becomes element#1, element#2 ..., so sharing counts with multiplicity. Any fixed
    total order is correct; the counts of the most frequent elements only make the signatures rare.
    """
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), _elements(k, F.col("key")).alias("all")) for k in kinds])
    # Partitioned by rank before the elements are spelled out: the groupings below need no other shuffle.
    # The number is fixed because a key turns into hundreds of signatures: small input is much work.
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spelled = keys.repartition(n, "rank").select("rank", F.inline(cells))
    exploded = spelled.select("rank", "kind", F.explode("all").alias("element"))
    counted = (
        exploded.groupBy("rank", "kind", "element").agg(F.count(F.lit(1)).alias("times"))
        .select("rank", "kind", "element", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("no"))
        .withColumn("element", F.concat("element", F.lit("#"), "no"))
    )
    # Counting before the limit: a letter pair found in every row is one row per task in the shuffle.
    frequent = (
        counted.groupBy("kind", "element").agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.col("rows").desc(), "kind", "element").limit(FREQUENT_ELEMENTS)
    )
    placed = counted.join(F.broadcast(frequent), ["kind", "element"], "left")
    entry = F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "element")
    lists = placed.groupBy("rank").agg(*[
        F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, entry))), lambda e: e["element"]).alias(k)
        for k in kinds])
    return keys.join(lists, "rank").select("rank", "key", "block", *kinds)


# --- signatures -----------------------------------------------------------------------------------

# Number of elements of the smaller key -> elements per signature. Longer combinations are rarer, but
# their number grows with the key; both sides of a pair agree on the class of the smaller key.
SIZE_CLASSES = ((0, 4, 1), (4, 12, 3), (12, 20, 3), (20, 32, 3), (32, 64, 2), (64, 128, 2), (128, 2**31 - 1, 1))
MAX_COMBINATIONS = 5_000
SHORT_COVER, SHORT_OTHER = 12, 24


def _signature_size(rule: Overlap, low: int, high: int, wanted: int) -> int:
    """Elements per signature in a size class: not more than the smallest key must share, and not so many
    that the largest key that can be paired with the class has too many combinations."""
    size = min(wanted, max(1, ceil(rule.small[0] * (low + 1) + rule.small[1] - EPSILON)))
    while size > 1:
        largest = high / rule.reach if rule.reach else float("inf")
        kept = largest - rule.large[0] * largest - rule.large[1] + size
        if rule.reach and comb(int(kept) + 1, size) <= MAX_COMBINATIONS:
            break
        size -= 1
    return size


# The expressions below are SQL text: they nest deeply, and text is parsed in one step.

NO_SIGNATURES = "cast(array() AS array<bigint>)"


def _number(x: float) -> str:
    return f"({float(x)!r}D)"


def _let(name: str, value: str, body: str) -> str:
    """`body` with `name` standing for `value`, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _combinations(items: str, size: int, tag: str) -> str:
    """64-bit hashes of all combinations of `size` elements, in list order. A hash collision only adds a
    candidate, which the score then rejects."""
    if size == 1:
        return f"transform({items}, a -> xxhash64({tag}, a))"
    if size == 2:
        body = f"flatten(transform(p, (a, i) -> transform(slice(p, i + 2, size(p)), b -> xxhash64({tag}, a, b))))"
    else:
        body = (f"flatten(flatten(transform(p, (a, i) -> transform(slice(p, i + 2, size(p)), (b, j) -> "
                f"transform(slice(p, i + j + 3, size(p)), c -> xxhash64({tag}, a, b, c))))))")
    return _let("p", items, body)


def _at_least(bound: tuple[float, float], n: str) -> str:
    return f"greatest(cast(ceil({_number(bound[0])} * {n} + {_number(bound[1] - EPSILON)}) AS int), 1)"


def _first(items: str, needed: str, size: int) -> str:
    """The leading elements among which a key must share `size` if it shares `needed` in all."""
    return (f"CASE WHEN size({items}) >= {needed} THEN slice({items}, 1, size({items}) - {needed} + {size}) "
            f"ELSE cast(array() AS array<string>) END")


def _overlap_signatures(rule: Overlap, largest: int) -> tuple[str, str]:
    """`largest` is the largest number of elements of any key: size classes above it are left out."""
    items = rule.elements
    n = f"size({items})"
    start = f"substring(key, 1, {rule.prefix})" if rule.prefix else "''"
    if rule.contains:
        tag = f"concat('{rule.name}/', block)"
        length = n if items.endswith("letters") else f"({n} + 1)"
        most = 2**31 - 1 if rule.max_length is None else rule.max_length
        index = _combinations(_first(items, _at_least(rule.small, n), 1), 1, tag)
        small = f"{length} BETWEEN {rule.min_length} AND {most}"
        return f"CASE WHEN {small} THEN {index} ELSE {NO_SIGNATURES} END", _combinations(items, 1, tag)
    indexes, probes = [], []
    for low, high, wanted in SIZE_CLASSES:
        if low >= max(largest, 1):
            break
        high = min(high, largest)
        fewest = max(1, ceil(rule.small[0] * (low + 1) + rule.small[1] - EPSILON))
        size = _signature_size(rule, low, high, wanted)
        tag = f"concat('{rule.name}/{low}/', {start}, block)"
        if high <= rule.reach * rule.above:
            continue
        fits = f"length(key) >= {rule.prefix} AND {n} > {low}"
        mine = _combinations(_first(items, _at_least(rule.small, n), size), size, tag)
        near = f" AND {n} >= {_number(rule.reach * rule.above)}" if rule.above else ""
        indexes.append(f"CASE WHEN {fits}{near} AND {n} <= {high} THEN {mine} ELSE {NO_SIGNATURES} END")
        needed = f"greatest({_at_least(rule.large, n)}, {fewest})"
        theirs = _combinations(_first(items, needed, size), size, tag)
        probes.append(f"CASE WHEN {fits} AND {n} > {rule.above} AND floor({n} * {_number(rule.reach)}) <= {high} THEN {theirs} "
                      f"ELSE {NO_SIGNATURES} END")
    return f"concat({', '.join(indexes)})", f"concat({', '.join(probes)})"


def _total_weight(words: str) -> str:
    """Length + 1 of each word (the words carry '#1'), summed."""
    return f"aggregate({words}, 0, (s, w) -> s + length(w) - 1)"


def _cover_needed(rule: WordCover, total: str) -> str:
    return f"({_number(rule.share)} * ({total} - 1) + {_number(1 - EPSILON)})"


def _word_columns(table: DataFrame) -> DataFrame:
    """Add the words' weights, their sum, and what stands from each word to the end of the list."""
    return table.withColumn("weights", F.expr("transform(words, w -> length(w) - 1)")).withColumns({
        "total": F.expr(_total_weight("words")),
        "rest": F.expr("aggregate(reverse(weights), cast(array() AS array<int>), "
                       "(done, w) -> concat(array(w + coalesce(get(done, 0), 0)), done))"),
    })


def _word_signatures(rule: WordCover) -> tuple[str, str]:
    """Signatures for weighted word cover.

    Let the covered key's words stand rarest first. Its first shared word must leave enough weight behind
    it to reach the share; if that word alone does not reach it, there is a second shared word. So the
    covered key emits single words that suffice alone and pairs otherwise; the other key emits all its
    words and pairs. Keys of many words use single words only, to keep the number of pairs small.
    """
    need = _cover_needed(rule, "total")
    short, to_long, from_long = (f"concat('{rule.name}/{x}/', block)" for x in ("short", "to-long", "from-long"))
    after = ("transform(slice(words, i + 2, size(words)), (v, j) -> named_struct("
             "'word', v, 'reaches', get(weights, i) + get(rest, i + j + 1)))")
    second = f"transform(filter({after}, r -> r.reaches >= {need}), r -> xxhash64({short}, w, r.word))"
    paired = (f"flatten(transform(leading, (w, i) -> CASE WHEN get(weights, i) < {need} THEN {second} "
              f"ELSE {NO_SIGNATURES} END))")
    alone = f"filter(leading, (w, i) -> get(weights, i) >= {need})"
    leading = f"filter(words, (w, i) -> get(rest, i) >= {need})"
    index = _let("leading", leading, (
        f"CASE WHEN size(words) <= {SHORT_COVER} THEN "
        f"concat({_combinations(alone, 1, short)}, {paired}, {_combinations('leading', 1, to_long)}) "
        f"ELSE concat({_combinations('leading', 1, to_long)}, {_combinations('leading', 1, from_long)}) END"))
    probe = (
        f"CASE WHEN size(words) <= {SHORT_OTHER} THEN concat({_combinations('words', 1, short)}, "
        f"{_combinations('words', 2, short)}, {_combinations('words', 1, from_long)}) "
        f"ELSE {_combinations('words', 1, to_long)} END")
    return index, probe


# --- candidate pairs ------------------------------------------------------------------------------

def _pair_counts(index: DataFrame, probe: DataFrame) -> DataFrame:
    """Signatures with the number of rows on each side; counted before the shuffle."""
    both = index.select("sig", F.lit(1).alias("i"), F.lit(0).alias("p")).union(
        probe.select("sig", F.lit(0), F.lit(1)))
    return both.groupBy("sig").agg(F.sum("i").alias("i"), F.sum("p").alias("p")).where("i > 0 AND p > 0")


def _is_hot() -> Column:
    return F.col("i").cast("double") * F.col("p") > CELL_ROWS * CELL_ROWS


def _workload(index: DataFrame, probe: DataFrame) -> tuple[float, int]:
    """Number of candidate pairs, and number of hot signatures."""
    row = _pair_counts(index, probe).agg(
        F.coalesce(F.sum(F.col("i").cast("double") * F.col("p")), F.lit(0.0)).alias("total"),
        F.count_if(_is_hot()).alias("hot")).first()
    return row["total"], row["hot"]


def _pair_up(index: DataFrame, probe: DataFrame, n_hot: int) -> DataFrame:
    """(a, b) rank pairs, a < b, that share a signature and whose sizes fit; pairs may repeat."""
    left = index.withColumnRenamed("rank", "ri")
    right = probe.withColumnRenamed("rank", "rp")
    on = ["sig"]
    if n_hot:
        # A hot signature is cut into a grid: each side falls into chunks, each chunk meets each chunk.
        grid = _pair_counts(index, probe).where(_is_hot()).select(
            "sig", F.ceil(F.col("i") / CELL_ROWS).cast("int").alias("across"),
            F.ceil(F.col("p") / CELL_ROWS).cast("int").alias("down"))
        if n_hot <= FREQUENT_ELEMENTS:
            grid = F.broadcast(grid)

        def spread(side: DataFrame, rank: str, own: str, other: str) -> DataFrame:
            sized = side.join(grid, "sig", "left").withColumns(
                {"across": F.coalesce("across", F.lit(1)), "down": F.coalesce("down", F.lit(1))})
            chunk = F.pmod(F.xxhash64(rank), F.col(own)).cast("int")
            return (sized.withColumn(f"at_{own}", chunk)
                    .withColumn(f"at_{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
                    .drop("across", "down"))

        left, right = spread(left, "ri", "across", "down"), spread(right, "rp", "down", "across")
        on = ["sig", "at_across", "at_down"]
    # Both sides are many times larger than the scan they come from, so a size estimate must not make one
    # of them a broadcast.
    joined = left.join(right.hint("merge"), on).where("ri <> rp AND n BETWEEN low AND high")
    return joined.select(F.least("ri", "rp").alias("a"), F.greatest("ri", "rp").alias("b"))


def _enough(rule: Overlap | WordCover) -> str:
    """Does a pair share as many elements as the rule asks for? Tested before any text is scored."""
    a, b = f"{_kind(rule)}_a", f"{_kind(rule)}_b"
    shared = f"array_intersect({a}, {b})"
    if isinstance(rule, WordCover):
        smaller = f"least({_total_weight(a)}, {_total_weight(b)})"
        return f"{_total_weight(shared)} >= {_cover_needed(rule, smaller)}"
    needed = _at_least(rule.small, f"least(size({a}), size({b}))")
    if not rule.contains:
        needed = f"greatest({needed}, {_at_least(rule.large, f'greatest(size({a}), size({b}))')})"
    return f"size({shared}) >= {needed}"


class Matcher:
    """Finds pairs of representatives that reach the threshold, within a set or between two sets."""

    def __init__(self, keys: DataFrame, algorithm: str, threshold: float):
        rules = rules_for(algorithm, threshold)
        word_remainders: list[WordRemainder] = []
        if algorithm == "token_set_ratio":
            word_remainders, last, longest = _word_remainders(keys, threshold)
            # A key has one letter pair more than letters. Where no key is longer, its letter pairs are not spelled out.
            rules = [replace(r, above=last + (r.elements == "word_pairs")) if isinstance(r, Overlap) else r
                     for r in rules if isinstance(r, WordCover) or longest > last]
        self.floor = 100 * threshold - EPSILON
        self.algorithm = algorithm
        kinds = sorted({_kind(r) for r in rules})
        self.table = written(element_table(keys, kinds), "fuzzy-elements")
        largest = self.table.agg(*[F.max(F.size(k)).alias(k) for k in kinds]).first()
        self.rules = [r for r in rules if largest[_kind(r)]]
        # Built once; every set of keys goes through the same expressions.
        index, probe = [], []
        if algorithm == "jaro_winkler":
            lengths = self.table.select(F.length("key").alias("n")).distinct().orderBy("n").limit(REMAINDER_LENGTHS).collect()
            remainders, last = remainder_rules(threshold, [r["n"] for r in lengths])
            alike = [_remainder_signatures(rule) for rule in remainders]
            self.rules = [replace(r, above=last) for r in self.rules if largest["letters"] > last]
        else:
            alike = [_word_remainder_signatures(rule) for rule in word_remainders]
        self.able = bool(alike or self.rules)
        for rule in self.rules:
            if isinstance(rule, WordCover):
                (smaller, larger), n, low = _word_signatures(rule), "0L", "0L"
            else:
                smaller, larger = _overlap_signatures(rule, largest[rule.elements])
                n = f"cast(size({rule.elements}) AS bigint)"
                low = f"cast(floor({n} * {_number(rule.reach)}) AS bigint)"
            index.append(f"transform({smaller}, s -> named_struct('sig', s, 'n', {n}))")
            probe.append(f"transform({larger}, s -> named_struct('sig', s, 'low', {low}, 'high', {n}))")
        tests = [f"({_enough(rule)})" for rule in self.rules] if algorithm in COSTLY else []
        self.enough, self.compared = F.expr(" OR ".join(tests) or "true"), ["rank", "key", "block", *(kinds if tests else [])]
        # Written once: loads, grids and pairs of every set of keys read the signatures again.
        part = _word_columns(self.table) if any(isinstance(r, WordCover) for r in self.rules) else self.table
        sides = [[written(part.select("rank", F.expr(f"inline(concat({', '.join(cells)}))")), "fuzzy-signatures")] if cells else []
                 for cells in (index, probe)]
        if alike:
            # Both keys of a pair have the same signatures: the later one is the index.
            both = written(part.select("rank", F.expr(f"explode(concat({', '.join(alike)}))").alias("sig")), "fuzzy-signatures")
            sides[0].append(both.select("rank", "sig", F.col("rank").alias("n")))
            sides[1].append(both.select("rank", "sig", (F.col("rank") + 1).alias("low"), F.lit(2**63 - 1).alias("high")))
        self.index, self.probe = (reduce(DataFrame.union, side) if side else None for side in sides)

    def _signed(self, ranks: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """(rank, sig, n) of the smaller and (rank, sig, low, high) of the larger key of a pair."""
        if ranks is None:
            return self.index, self.probe
        own = ranks.select("rank")
        return self.index.join(own, "rank", "left_semi"), self.probe.join(own, "rank", "left_semi")

    def within(self, ranks: DataFrame | None = None) -> list[tuple[DataFrame, DataFrame]]:
        return [self._signed(ranks)] if self.able else []

    def between(self, first: DataFrame, second: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
        if not self.able:
            return []
        (index_one, probe_one), (index_two, probe_two) = self._signed(first), self._signed(second)
        return [(index_one, probe_two), (index_two, probe_one)]

    def matches(self, work: list[tuple[DataFrame, DataFrame]], loads: list[tuple[float, int]]) -> DataFrame:
        """(a, b, key_a, key_b, score) of the candidate pairs that reach the threshold.

        Pairs are few bytes but much work, so their number of partitions follows their number, not their size.
        """
        pairs = reduce(DataFrame.union, [_pair_up(i, p, hot) for (i, p), (_, hot) in zip(work, loads)])
        default = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = max(default, ceil(sum(total for total, _ in loads) / PAIRS_PER_TASK))
        pairs = pairs.repartition(parts, "a", "b").distinct()
        left, right = (self.table.select(*[F.col(c).alias(f"{c}_{side}") for c in self.compared]) for side in ("a", "b"))
        both = pairs.join(left, F.col("a") == F.col("rank_a")).join(right, F.col("b") == F.col("rank_b"))
        fitting = both.where((F.col("block_a") == F.col("block_b")) & self.enough).select("a", "b", "key_a", "key_b")
        return reaching(fitting, self.algorithm, self.floor)


# --- resolution in row order ----------------------------------------------------------------------

def _scan(edges: DataFrame) -> DataFrame:
    """Rows removed by a scan of the edges in row order, in one task: distinct `rank`. Edges are streamed, sorted by b."""
    def scan(batches):
        gone: set[int] = set()
        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
                if a not in gone:
                    gone.add(b)
        yield pd.DataFrame({"rank": np.fromiter(gone, dtype="int64", count=len(gone))})

    return edges.select("a", "b").coalesce(1).sortWithinPartitions("b", "a").mapInPandas(scan, "rank long")


def _removed_by(edges: DataFrame, n_edges: int) -> DataFrame:
    """Rows removed when the edges (a earlier than b) are resolved in row order: distinct `rank`.

    This is the lexicographically first maximal independent set, taken prefix by prefix: the rows up to a cut below which
    PREFIX_EDGES edges lie are decided by one scan; their kept rows then remove later neighbours, wherever these are, and
    only edges between rows that are still undecided go on. In random row order the undecided rows lose most of their
    edges each time, so prefixes grow and their number grows with the logarithm; a chain takes one prefix for each
    PREFIX_EDGES of its links, not a round for each.
    """
    decided = []
    while n_edges > PREFIX_EDGES:
        accuracy = int(min(max(10_000, 4 * n_edges // PREFIX_EDGES), 1_000_000))
        cut = edges.agg(F.percentile_approx("b", PREFIX_EDGES / n_edges, accuracy)).first()[0]
        gone = written(_scan(edges.where(F.col("b") <= cut)), "fuzzy-removed")
        across = edges.where((F.col("a") <= cut) & (F.col("b") > cut)).join(gone.withColumnRenamed("rank", "a"), "a", "left_anti")
        hit = written(across.select(F.col("b").alias("rank")).distinct(), "fuzzy-removed")
        decided += [gone, hit]
        left = edges.where(F.col("a") > cut)
        for end in ("a", "b"):
            left = left.join(hit.withColumnRenamed("rank", end), end, "left_anti")
        edges = written(left.select("a", "b"), "fuzzy-edges")
        n_edges = edges.count()
    return reduce(DataFrame.union, [*decided, _scan(edges)])


def _kept(matcher: Matcher, ranks: DataFrame, budget: int | None, min_rows: int) -> DataFrame:
    """The kept rows of a set that no earlier kept row outside the set touches."""
    kept: list[DataFrame] = []
    todo, before = ranks, float("inf")
    while True:
        n = todo.count()
        if n <= 1:
            kept.append(todo)
            break
        work = matcher.within(todo)
        loads = _loads(work, n, n, always=n > min_rows)
        total = sum(load[0] for load in loads)
        limit = budget or max(MIN_PAIR_BUDGET, PAIRS_PER_ROW * n)
        if total <= limit or n <= min_rows:
            if work:
                edges = written(matcher.matches(work, loads).select("a", "b"), "fuzzy-edges")
                gone = _removed_by(edges, edges.count())
                todo = written(todo.join(gone, "rank", "left_anti"), "fuzzy-kept")
            kept.append(todo)
            break
        # A few rows clear a group of near-copies, so the first part is small. Where that did not lower the
        # number of pairs by much, the part is as large as the budget allows (pairs grow with its square).
        share = limit / total if total < before / 2 else (limit / total) ** 0.5
        before = total
        cut = todo.agg(F.percentile_approx("rank", min(0.5, max(share, min_rows / n)), 10_000)).first()[0]
        head = written(todo.where(F.col("rank") <= cut), "fuzzy-head")
        tail = todo.where(F.col("rank") > cut)
        if tail.isEmpty():
            cut = todo.agg(F.max("rank")).first()[0]
            head, tail = todo.where(F.col("rank") < cut), todo.where(F.col("rank") == cut)
        first = _kept(matcher, head, budget, min_rows)
        kept.append(first)
        across = matcher.between(first, tail)
        loads = _loads(across, first.count(), n)
        # All rows of the tail come later, so b is always the one to go.
        hit = matcher.matches(across, loads).select(F.col("b").alias("rank")).distinct()
        todo = written(tail.join(hit, "rank", "left_anti"), "fuzzy-tail")
    return reduce(DataFrame.union, kept)


def _loads(work: list[tuple[DataFrame, DataFrame]], n: int, m: int, always: bool = False) -> list[tuple[float, int]]:
    """Workload of each join. Sets too small to have a hot signature are counted only if asked for."""
    if always or n * m > CELL_ROWS * CELL_ROWS:
        return [_workload(index, probe) for index, probe in work]
    return [(0.0, 0) for _ in work]


# --- operators ------------------------------------------------------------------------------------

def check_arguments(df: DataFrame, columns: list[str], algorithm: str, threshold: float,
                    block_by: list[str] | None = None) -> None:
    missing = [c for c in [*columns, *(block_by or [])] if c not in df.columns]
    if missing:
        raise ValueError(f"there are no columns {missing} to compare")
    if algorithm not in SCORERS:
        raise ValueError(f"{algorithm!r} is no scorer; there are {', '.join(SCORERS)}")
    if threshold < 0:
        raise ValueError("fuzzy_threshold must not be negative")


def _key(df: DataFrame, columns: list[str], algorithm: str) -> Column:
    return token_set_key(df, columns) if algorithm == "token_set_ratio" else composite_key(df, columns)


def _never_matches(algorithm: str, key: Column) -> Column:
    """Blank keys score 0 against everything under the word-based scorers, also against each other."""
    if algorithm == "token_set_ratio":
        return key == ""
    return key == "" if algorithm == "wratio" else F.lit(False)


def fuzzy_dedup(
    df: DataFrame, columns: list[str], threshold: float = 0.85, algorithm: str = "token_set_ratio",
    keep: str = "first", order_by: list[str] | None = None, block_by: list[str] | None = None,
    exact_first: bool = False, pair_budget: int | None = None, min_rows: int = MIN_SPLIT_ROWS,
) -> FuzzyResult:
    """Greedy fuzzy deduplication in row order; the result equals the scan over all row pairs."""
    check_arguments(df, columns, algorithm, threshold, block_by)
    df = nan_to_null(df)
    names = df.columns
    # Range partitions in order, rows sorted inside: the generated id rises with the row order. Rows of equal order
    # values, and all rows where no order is given, follow a hash of the row: the result then never depends on files.
    own = free_prefix("_fuzzy", names)
    rank, tie = f"{own}rank", f"{own}tie"
    cells = [F.to_json(col(f.name)) if isinstance(f.dataType, T.MapType) else col(f.name) for f in df.schema]
    order = [*map(col, order_by or []), F.col(tie)]
    placed = df.withColumn(tie, F.xxhash64(*cells)).repartitionByRange(*order).sortWithinPartitions(*order)
    sign = 1 if keep == "first" else -1
    placed = placed.withColumn(rank, sign * F.monotonically_increasing_id()).drop(tie)
    if exact_first:
        placed = placed.groupBy(*map(col, names)).agg(F.min(rank).alias(rank))
    block = F.to_json(F.struct(*map(col, block_by))) if block_by else F.lit("")
    placed = placed.withColumns({f"{own}key": _key(df, columns, algorithm), f"{own}block": block})
    rows = written(placed, "fuzzy-rows")
    total = df.count()

    if threshold > 1:
        survivors = rows
    elif threshold <= 0:
        first = rows.agg(F.min(rank)).first()[0]
        survivors = rows.where(F.col(rank) == first) if first is not None else rows
    else:
        blank = _never_matches(algorithm, F.col(f"{own}key"))
        keys = rows.where(~blank).groupBy(F.col(f"{own}key").alias("key"), F.col(f"{own}block").alias("block"))
        keys = written(keys.agg(F.min(rank).alias("rank")), "fuzzy-keys")
        kept = _kept(Matcher(keys, algorithm, threshold), keys.select("rank"), pair_budget, min_rows)
        survivors = rows.join(kept.withColumnRenamed("rank", rank), rank, "left_semi").unionByName(
            rows.where(blank))
    survivors = written(survivors.select(*map(col, names)), "fuzzy-result")
    return FuzzyResult(survivors, total - survivors.count())


def fuzzy_pairs(
    df: DataFrame, columns: list[str], threshold: float = 0.85, algorithm: str = "token_set_ratio",
) -> DataFrame:
    """(key_a, key_b, score): all pairs of distinct keys that reach the threshold, key_a < key_b."""
    check_arguments(df, columns, algorithm, threshold)
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    df = nan_to_null(df)
    key = _key(df, columns, algorithm)
    distinct = df.select(key.alias("key"), F.lit("").alias("block")).where(~_never_matches(algorithm, F.col("key"))).distinct()
    keys = written(distinct.withColumn("rank", F.monotonically_increasing_id()), "fuzzy-keys")
    matcher = Matcher(keys, algorithm, threshold)
    work = matcher.within()
    if not work:
        return df.sparkSession.createDataFrame([], "key_a string, key_b string, score double")
    n = keys.count()
    found = matcher.matches(work, _loads(work, n, n))
    return found.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"), "score")
