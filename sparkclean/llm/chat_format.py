"""Chat formatting: roles of transcript lines by a hidden Markov model, then turns in one canonical form."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkclean.llm.common import byte_slices, texts_of

#: Hidden states: a line that begins a turn of a role, or one that goes on with it.
ROLES = ("system", "user", "assistant")
STATES = tuple((role, begins) for role in ROLES for begins in (True, False))
#: Names of speakers that tell the role.
NAMES = {
    "system": {"system", "sys", "instruction", "instructions", "context"},
    "user": {"user", "human", "customer", "client", "question", "q", "prompt", "prompter", "me"},
    "assistant": {"assistant", "ai", "bot", "agent", "answer", "a", "model", "gpt", "chatbot", "response"},
}
_role_of = {name: role for role, names in NAMES.items() for name in names}
MARKER = re.compile(
    r"\s*(?:<\|(?:im_start\|>)?\s*(?P<tag>\w+)\s*(?:\|>)?|\[(?P<box>\w+)\]:?|(?:#{1,4}\s*|\*\*)?(?P<name>[A-Za-z][\w.'-]*(?: [A-Z][\w.'-]*){0,2})\s*(?:\*\*)?:(?:\*\*)?)(?:\s+|$)")
#: Observed kinds of markers: none, one for each role, the first and the second speaker named in the text, further names.
MARKERS = ("none", *ROLES, "first", "second", "other")
LENGTHS = (60, 120, 200, 280, 360, 500, 800, 1200)
#: Bounds of the training sample: turns with the smallest hash of their conversation, and characters of each.
SAMPLE_TURNS, SAMPLE_CHARS = 20_000, 4000
#: Turns of a conversation that make one transcript; a longer conversation has several.
PART = 64


@dataclass(frozen=True)
class Line:
    """A line that isn't blank: what stands before its text, and what the model sees of it."""

    text: str
    rest: str
    marker: int
    after_blank: int
    length: int


def lines_of(transcript: str) -> list[Line]:
    """Lines that aren't blank. Their length is that of the block they stand in, up to a blank line or a marker."""
    out, blank, speakers = [], False, {}
    block, size = 0, 0

    def close() -> None:
        length = int(np.searchsorted(LENGTHS, size, "right"))
        out[block:] = [Line(x.text, x.rest, x.marker, x.after_blank, length) for x in out[block:]]

    for raw in transcript.split("\n"):
        if not raw.strip():
            blank = True
            continue
        found = MARKER.match(raw)
        name = (found["tag"] or found["box"] or found["name"]) if found else None
        role = _role_of.get(name.lower()) if name else None
        if found and not role and not found["name"]:
            found = None  # brackets around a word that is no speaker
        if role:
            marker = MARKERS.index(role)
        elif found:
            place = speakers.setdefault(name, len(speakers))
            marker = MARKERS.index(("first", "second")[place] if place < 2 else "other")
        else:
            marker = 0
        rest = raw[found.end():] if found else raw
        if marker or blank:
            close()
            block, size = len(out), 0
        size += len(rest)
        out.append(Line(raw, rest, marker, int(blank), 0))
        blank = False
    close()
    return out


@dataclass(frozen=True)
class ChatModel:
    """Logarithms of the probabilities of the first state, of the next state, and of what is seen in a state."""

    first: np.ndarray
    following: np.ndarray
    marker: np.ndarray
    after_blank: np.ndarray
    length: np.ndarray

    @classmethod
    def counted(cls, counts: Counter, smooth: float = 0.5) -> ChatModel:
        def table(name: str, rows: int, columns: int) -> np.ndarray:
            out = np.full((rows, columns), smooth)
            for (what, i, j), n in counts.items():
                if what == name:
                    out[i, j] += n
            return np.log(out / out.sum(axis=1, keepdims=True))

        n = len(STATES)
        first, following = table("first", 1, n)[0].copy(), table("following", n, n).copy()
        for j, (role, begins) in enumerate(STATES):  # only a turn of the same role goes on
            if not begins:
                first[j] = -np.inf
                following[[i for i, (r, _) in enumerate(STATES) if r != role], j] = -np.inf
        return cls(first, following, table("marker", n, len(MARKERS)), table("after_blank", n, 2), table("length", n, len(LENGTHS) + 1))

    def states(self, lines: list[Line]) -> list[int]:
        """Most likely states by the Viterbi algorithm; of equally likely ones the first in the order of STATES."""
        if not lines:
            return []
        seen = np.array([(x.marker, x.after_blank, x.length) for x in lines])
        emitted = self.marker[:, seen[:, 0]].T + self.after_blank[:, seen[:, 1]].T + self.length[:, seen[:, 2]].T
        best, back = self.first + emitted[0], np.zeros((len(lines), len(STATES)), np.int8)
        for k in range(1, len(lines)):
            steps = best[:, None] + self.following
            back[k] = steps.argmax(axis=0)
            best = steps.max(axis=0) + emitted[k]
        out = [int(best.argmax())]
        for k in range(len(lines) - 1, 0, -1):
            out.append(int(back[k, out[-1]]))
        return out[::-1]

    def turns(self, transcript: str) -> list[tuple[str, str]]:
        """(role, text) of each turn. A line that begins one gives up its marker; blank lines inside a turn stay one."""
        lines, out = lines_of(transcript), []
        for line, state in zip(lines, self.states(lines)):
            role, begins = STATES[state]
            if begins or not out:
                out.append((role, [line.rest] if line.rest.strip() else []))
            else:
                out[-1][1].append(("\n" if line.after_blank and out[-1][1] else "") + line.text)
        return [(role, "\n".join(text)) for role, text in out]


def rendered(role: str, text: str) -> str:
    """Canonical form of a turn."""
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def marked(style: Column, role: Column, text: Column) -> Column:
    """A turn as it stands in a transcript of one of six styles, the last without markers."""
    name = F.lower(F.trim(role))

    def by_role(system: str, user: str, assistant: str) -> Column:
        known = F.when(name == "system", system).when(name == "user", user).when(name == "assistant", assistant)
        return known.otherwise(F.concat(F.initcap(name), F.lit(": ")))

    forms = [by_role("System: ", "User: ", "Assistant: "), by_role("### Instruction: ", "### Human: ", "### Assistant: "),
             by_role("<|system|> ", "<|user|> ", "<|assistant|> "), by_role("Context: ", "Q: ", "A: "), by_role("Host: ", "Maria: ", "Tom: ")]
    marker = F.when(role.isNull(), "")
    for k, form in enumerate(forms):
        marker = marker.when(style == k, form)
    return F.concat(F.when(style == len(forms), "\n").otherwise(""), marker.otherwise(""), F.coalesce(text, F.lit("")))


def _styled(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    style = F.pmod(F.xxhash64(id_col, F.lit("style")), F.lit(6))
    return df.select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), F.lower(F.trim(F.col(role_col))).alias("role"),
                     marked(style, F.col(role_col), F.col(text_col)).alias("text"))


def transcripts(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Raw transcripts of a table of turns: id, part long, transcript; each conversation in one style of markers.

    Turns stand in the order of their numbers, then roles and texts; null numbers first; repeated rows count once. Every
    PART numbers make a transcript, so a long conversation is never in one row. A row with a null id is a conversation
    of its own.
    """
    rows = _styled(df, id_col, turn_col, role_col, text_col).distinct()
    alone = F.when(F.col("id").isNull(), F.xxhash64("turn", "role", "text"))
    part = F.coalesce(F.floor(F.col("turn") / PART), F.lit(0))
    grouped = rows.groupBy("id", part.alias("part"), alone.alias("alone")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return grouped.select("id", "part", F.array_join("turns.text", "\n").alias("transcript"))


def fit_chat(df: DataFrame, use: Column | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text", sample: int = SAMPLE_TURNS) -> ChatModel:
    """Count states, steps and what is seen in labelled turns: at most `sample`, of SAMPLE_CHARS characters each.

    `use` is a condition on `id_col` that turns must meet. Turns of a role not in ROLES are left out. Without turns the
    model has no preference among what it allows.
    """
    chosen = df if use is None else df.where(use)
    rows = _styled(chosen, id_col, turn_col, role_col, text_col).where(F.col("role").isin(*ROLES) & F.col("id").isNotNull())
    rows = rows.withColumn("text", F.substring("text", 1, SAMPLE_CHARS)).orderBy(F.xxhash64("id"), "id", "turn", "role", "text").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        conversation, last, texts = None, None, []

        def close() -> None:
            lines = lines_of("\n".join(texts))  # names are told apart over the whole conversation
            for line, state in zip(lines, states):
                counts["marker", state, line.marker] += 1
                counts["after_blank", state, line.after_blank] += 1
                counts["length", state, line.length] += 1

        states: list[int] = []
        for batch in batches:  # one sorted partition of at most `sample` rows
            for key, role, text in zip(*(batch.column(n).to_pylist() for n in ("id", "role", "text"))):
                if key != conversation:
                    close()
                    conversation, last, texts, states = key, None, [], []
                texts.append(text)
                for k, _ in enumerate(lines_of(text)):
                    state = STATES.index((role, k == 0))
                    counts[("first", 0, state) if last is None else ("following", last, state)] += 1
                    states.append(state)
                    last = state
        close()
        if counts:
            keys, numbers = zip(*counts.items())
            what, i, j = zip(*keys)
            yield pa.RecordBatch.from_arrays([pa.array(what), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(numbers, pa.int64())], ["what", "i", "j", "n"])

    found = rows.select("id", "role", "text").mapInArrow(run, "what string, i int, j int, n long").groupBy("what", "i", "j").agg(F.sum("n").alias("n"))
    return ChatModel.counted(Counter({(r["what"], r["i"], r["j"]): r["n"] for r in found.collect()}))


def parse_transcripts(df: DataFrame, model: ChatModel, id_col: str = "id", part_col: str = "part", text_col: str = "transcript") -> DataFrame:
    """Turns of every whole transcript: `id_col`, `part_col`, turn int from 0, role, text, rendered.

    Null, empty and blank transcripts have no turns. Repeated rows each give their turns; an empty table gives none; other
    columns are not read.
    """
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (id_col, part_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, text_col):
            found = [model.turns(x) for x in texts_of(batch, text_col)]
            take = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            flat = [(k, role, text) for x in found for k, (role, text) in enumerate(x)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array([k for k, _, _ in flat], pa.int32()),
                 pa.array([r for _, r, _ in flat], pa.string()), pa.array([t for _, _, t in flat], pa.string()),
                 pa.array([rendered(r, t) for _, r, t in flat], pa.string())], [id_col, part_col, "turn", "role", "text", "rendered"])

    return df.select(id_col, part_col, text_col).mapInArrow(run, f"{kinds}, turn int, role string, text string, rendered string")
