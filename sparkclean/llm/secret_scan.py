"""Secret scans: all rules in one minimal automaton that reads the UTF-8 bytes of a text once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from sparkclean.llm.common import byte_slices, mapped


@dataclass(frozen=True)
class Rule:
    """A pattern of bytes and the least length of its group `group` (0: the whole match); shorter matches are dropped.

    Patterns are written with literals, classes, groups, |, ?, * and +. A match is leftmost and as long as possible, and
    matches of one rule don't overlap; dropped ones count for that, too. Once a match can end, it must be able to end at
    each further byte up to its longest end, as it does when its last part is a class with +.
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: The base rules, then well-known token formats.
RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]" * 5 + "[0-9a-f]+", 24),  # runs below six can't count and need not be looked at
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]+", 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)


class Nfa:
    """Thompson's construction for patterns of bytes."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.empty) - 1

    def add(self, pattern: str, backward: bool) -> tuple[int, int]:
        """First and last state of the pattern, or of its mirror image."""
        self.text, self.at, self.backward = pattern, 0, backward
        return self.alternatives()

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self) -> tuple[int, int]:
        begin, end = self.state(), self.state()
        while True:
            a, b = self.sequence()
            self.empty[begin].append(a)
            self.empty[b].append(end)
            if self.peek() != "|":
                return begin, end
            self.take()

    def sequence(self) -> tuple[int, int]:
        begin = end = self.state()
        while self.peek() not in ("", "|", ")"):
            a, b = self.repeated()
            if self.backward:
                self.empty[b].append(begin)
                begin = a
            else:
                self.empty[end].append(a)
                end = b
        return begin, end

    def repeated(self) -> tuple[int, int]:
        a, b = self.single()
        if self.peek() in ("?", "*", "+"):
            mark, begin, end = self.take(), self.state(), self.state()
            self.empty[begin].append(a)
            self.empty[b].append(end)
            if mark != "+":
                self.empty[begin].append(end)
            if mark != "?":
                self.empty[b].append(a)
            return begin, end
        return a, b

    def single(self) -> tuple[int, int]:
        if self.peek() == "(":
            self.take()
            found = self.alternatives()
            self.take()
            return found
        values = {self.byte()} if self.peek() != "[" else self.members()
        a, b = self.state(), self.state()
        self.step[a] = (frozenset(values), b)
        return a, b

    def byte(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c != "x":
            return ord(c)
        self.at += 2
        return int(self.text[self.at - 2 : self.at], 16)

    def members(self) -> set[int]:
        self.take()
        found: set[int] = set()
        while self.peek() != "]":
            low = high = self.byte()
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                high = self.byte()
            found |= set(range(low, high + 1))
        self.take()
        return found

    def closure(self, states) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)


@dataclass
class Automaton:
    """Minimal deterministic automaton. `table[state * classes + class_of[byte]]` is the next state times `classes`.

    `accepts[state]` has a bit for each pattern that ends in the state; `start` is a state times `classes`.
    """

    table: np.ndarray
    class_of: np.ndarray
    accepts: np.ndarray
    start: int
    classes: int

    @property
    def resets(self) -> np.ndarray:
        """Which bytes lead to the start from every state: texts may be cut behind them."""
        return (self.table.reshape(-1, self.classes) == self.start).all(axis=0)[self.class_of]


def compile_patterns(patterns: list[str], anywhere: bool, backward: bool = False) -> Automaton:
    """Subset construction over byte classes, then refinement of the partition by what states accept and lead to.

    With `anywhere`, a match may begin at any byte; else only at the first one.
    """
    nfa = Nfa()
    spans = [nfa.add(p, backward) for p in patterns]
    start = nfa.closure([a for a, _ in spans])
    final = {b: 1 << k for k, (_, b) in enumerate(spans)}
    sets = list({s[0] for s in nfa.step if s})
    marks = [tuple(b in x for x in sets) for b in range(256)]
    kinds = {m: k for k, m in enumerate(dict.fromkeys(marks))}
    class_of = np.array([kinds[m] for m in marks], np.uint8)
    sample = {k: marks.index(m) for m, k in kinds.items()}
    numbers, rows, todo = {start: 0}, [], [start]
    for states in todo:
        row = []
        for k in range(len(kinds)):
            after = {nfa.step[s][1] for s in states if nfa.step[s] and sample[k] in nfa.step[s][0]}
            after = nfa.closure(after) | start if anywhere else nfa.closure(after)
            if after not in numbers:
                numbers[after] = len(numbers)
                todo.append(after)
            row.append(numbers[after])
        rows.append(row)
    rows = np.array(rows)
    accepts = np.array([sum(bit for s, bit in final.items() if s in states) for states in todo])
    block = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([block, block[rows]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    first = np.unique(block, return_index=True)[1]
    table = (block[rows[first]] * len(kinds)).astype(np.int32).ravel()
    return Automaton(table, class_of, accepts[first], int(block[0]) * len(kinds), len(kinds))


#: Bytes that a lane of the scan reads, about. One that finds no byte to be cut behind in LONG bytes is read by itself.
LANE, LONG = 2048, 16384
#: Not a byte of UTF-8; it stands behind every text and leads to the start.
BREAK = 0xFF


class Scanner:
    """Runs the combined automaton over many places of the data at the same time, each byte once."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.forward = compile_patterns([r.pattern for r in rules], True)
        self.back = [Backward(r) for r in rules]
        self.exact = [re.compile(r.pattern.encode()) for r in rules]
        self.resets = self.forward.resets
        if not self.resets[BREAK]:
            raise ValueError("a rule reads the byte 0xFF, which is no part of a text")

    def accepted(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `data`, which ends with a break, behind whose byte a match can end, and the rules as bits."""
        auto = self.forward
        cuts = np.flatnonzero(self.resets[data]) + 1
        wanted = np.arange(LANE, len(data), LANE)
        starts = np.unique(np.concatenate([[0], cuts[np.searchsorted(cuts, wanted)]]))
        starts = starts[starts < len(data)]
        sizes = np.diff(starts, append=len(data))
        classes = auto.class_of[data]
        hot = np.repeat(auto.accepts != 0, auto.classes)
        places, bits = [], []
        for a, n in zip(starts[sizes > LONG].tolist(), sizes[sizes > LONG].tolist()):
            states = np.fromiter(self._states(classes[a : a + n]), np.int32, n)
            found = np.flatnonzero(hot[states])
            places.append(found + a)
            bits.append(auto.accepts[states[found] // auto.classes])
        starts, sizes = starts[sizes <= LONG], sizes[sizes <= LONG]
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        longest = int(sizes[0]) if len(sizes) else 0
        live = np.searchsorted(-sizes, -np.arange(longest), "left")  # lanes that have a byte k
        state = np.full(len(starts), auto.start, np.int32)
        for k in range(longest):
            n = live[k]
            if n < len(state):
                state, starts = state[:n], starts[:n]
            state = auto.table[state + classes[starts + k]]
            found = np.flatnonzero(hot[state])
            if len(found):
                places.append(starts[found] + k)
                bits.append(auto.accepts[state[found] // auto.classes])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, bits = np.concatenate(places), np.concatenate(bits)
        order = np.argsort(at, kind="stable")
        return at[order], bits[order]

    def _states(self, classes: np.ndarray) -> Iterator[int]:
        table, state = self.forward.table.tolist(), self.forward.start
        for c in classes.tolist():
            state = table[state + c]
            yield state

    def matches(self, data: np.ndarray) -> list[list[tuple[int, int]]]:
        """Spans (begin, end) in bytes of each rule, in order, over texts that are each followed by a break."""
        at, bits = self.accepted(data)
        raw, out = data.tobytes(), []
        for k, rule in enumerate(self.rules):
            mine = at[(bits >> k) & 1 == 1]
            ends = mine[np.diff(mine, append=-2) != 1] + 1
            found, last = [], 0
            for end in ends.tolist():
                begin = self.back[k].begin(raw, last, end)
                if begin >= 0:
                    last = end
                    match = self.exact[k].fullmatch(raw, begin, end)
                    if match and match.end(rule.group) - match.start(rule.group) >= rule.least:
                        found.append((begin, end))
            out.append(found)
        return out

    def scan(self, texts: list[bytes]) -> list[list[tuple[str, int, int]]]:
        """Spans (kind, start, end) in code points of each text, by start and then in the order of the rules."""
        out: list[list] = [[] for _ in texts]
        data = np.frombuffer(b"".join(x + b"\xff" for x in texts), np.uint8)
        if not len(data):
            return out
        found = self.matches(data)
        if any(found):
            ends = np.cumsum([len(x) + 1 for x in texts])
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            for order, spans in enumerate(found):
                for begin, end in spans:
                    row = int(np.searchsorted(ends, begin, "right"))
                    zero = points[ends[row - 1]] if row else 0
                    out[row].append((int(points[begin] - zero), order, int(points[end] - zero)))
        return [[(self.rules[k].kind, a, b) for a, k, b in sorted(x)] for x in out]


class Backward:
    """The mirror image of one rule, read from the end of a match to its smallest begin."""

    def __init__(self, rule: Rule):
        auto = compile_patterns([rule.pattern], False, True)
        rows = auto.table.reshape(-1, auto.classes) // auto.classes
        self.rows = rows[:, auto.class_of].tolist()
        self.ends = auto.accepts.tolist()
        self.dead = [not e and all(x == k for x in row) for k, (e, row) in enumerate(zip(self.ends, rows.tolist()))]
        self.start = auto.start // auto.classes

    def begin(self, raw: bytes, last: int, end: int) -> int:
        """Smallest begin from `last` on of a match that ends at `end`; -1 if there is none."""
        state, found = self.start, -1
        for i in range(end - 1, last - 1, -1):
            state = self.rows[state][raw[i]]
            if self.ends[state]:
                found = i
            elif self.dead[state]:
                break
        return found


@lru_cache(4)
def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def _shared(df: DataFrame, rules: tuple[Rule, ...]) -> Broadcast:
    """The compiled rules, a few MB that depend on the rules alone."""
    return df.sparkSession.sparkContext.broadcast(_scanner(rules))


def _bytes_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


SPANS = "array<struct<kind:string,start:long,end:long>>"


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Secrets of every whole text: `id_col`, spans (kind, start, end in code points; by start, then rule order).

    Null and empty texts have no spans. Every input row gives one row, repeated rows and null keys too; other columns
    are not read. Spans of different kinds may overlap.
    """
    kind, shared = df.schema[id_col].dataType.simpleString(), _shared(df, rules)
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in byte_slices(batches, text_col):
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in scanner.scan(_bytes_of(batch, text_col))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, spans_type)], [id_col, "spans"])

    return mapped(df.select(id_col, text_col), run, f"`{id_col}` {kind}, spans {SPANS}")


def redact_secrets(df: DataFrame, text_col: str = "text", mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The table with `mask` in place of each secret in `text_col`; spans that overlap or touch become one mask.

    All rows and columns stay. Null texts stay null, texts without secrets stay as they are.
    """
    names, shared = df.columns, _shared(df, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in byte_slices(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            for row, spans in enumerate(scanner.scan(_bytes_of(batch, text_col))):
                if spans:
                    texts[row] = masked(texts[row], spans, mask)
            columns = [pa.array(texts, pa.string()) if n == text_col else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return mapped(df, run, df.schema)


def masked(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    out, end = [], 0
    for _, a, b in spans:
        if not out or a > end:
            out += [text[end:a], mask]
        end = max(end, b)
    return "".join(out) + text[end:]
