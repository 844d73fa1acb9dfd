"""Transcript parsing by a hidden Markov model, and canonical chat rendering (operator 9).

The states are the first and the further lines of a turn of each role; a line shows a speaker marker or
none, whether it follows a blank line, its length and its last sign. Viterbi finds the likeliest states;
turns are then rendered in one canonical form, without the markers they came with.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROLES = ("system", "user", "assistant")
#: States 2k and 2k + 1: first and further lines of role k.
STATES = 2 * len(ROLES)

# Names by which transcripts call the speakers.
NAMES = {"system": 0, "s": 0, "instruction": 0, "instructions": 0, "context": 0, "user": 1, "human": 1, "q": 1, "question": 1, "prompter": 1, "customer": 1, "me": 1, "assistant": 2, "a": 2, "answer": 2, "ai": 2, "bot": 2, "model": 2, "gpt": 2, "agent": 2}
MARKER = re.compile(r"\s*(?:#{1,4}\s*|<\|?|\[|\*\*|\()?(" + "|".join(sorted(NAMES, key=len, reverse=True)) + r")(?:\|?>|\]|\*\*|\))?\s*(:|(?<=>)|(?<=\]))\s*", re.IGNORECASE)
#: Marker of a line: none, or the role it names; blank line before; length; last sign.
MARKERS, BLANK, LENGTHS, ENDS = 4, 2, 7, 4


def observed(lines: list[str]) -> np.ndarray:
    """The four features of each line, as small numbers."""
    out = np.zeros((len(lines), 4), np.int64)
    before = False
    for i, line in enumerate(lines):
        m = MARKER.match(line)
        s = line.rstrip()
        out[i] = (1 + NAMES[m.group(1).lower()] if m else 0, before, 0 if not s else min(LENGTHS - 1, max(1, len(s).bit_length() - 3)), 0 if not s else 1 if s[-1] == "?" else 2 if s[-1] in ".!" else 3)
        before = not s
    return out


SIZES = (MARKERS, BLANK, LENGTHS, ENDS)


class Model:
    """Log probabilities from counts: counts[0] of first states, then transitions, then each feature."""

    def __init__(self, counts: np.ndarray):
        first, moves, *feats = split_counts(counts + 0.1)
        own = lambda c: np.log(c / c.sum(-1, keepdims=True))
        # what counting can't have seen: a turn's further lines follow lines of its role
        allowed = np.ones((STATES, STATES), bool)
        for s in range(STATES):
            for t in range(1, STATES, 2):
                allowed[s, t] = s // 2 == t // 2
        self.first = np.where(np.arange(STATES) % 2 == 0, own(first), -np.inf)
        self.moves = np.where(allowed, own(moves), -np.inf)
        self.feats = [own(f) for f in feats]

    def viterbi(self, obs: np.ndarray) -> np.ndarray:
        if not len(obs):
            return np.zeros(0, np.int64)
        e = sum(f[:, obs[:, k]] for k, f in enumerate(self.feats)).T
        score, back = self.first + e[0], np.zeros((len(obs), STATES), np.int64)
        for i in range(1, len(obs)):
            x = score[:, None] + self.moves
            back[i] = x.argmax(0)
            score = x.max(0) + e[i]
        out = np.zeros(len(obs), np.int64)
        out[-1] = score.argmax()
        for i in range(len(obs) - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out


def split_counts(flat: np.ndarray) -> list[np.ndarray]:
    shapes = [(STATES,), (STATES, STATES), *((STATES, n) for n in SIZES)]
    cuts = np.cumsum([int(np.prod(s)) for s in shapes])
    return [x.reshape(s) for x, s in zip(np.split(flat, cuts[:-1]), shapes, strict=True)]


N_COUNTS = STATES + STATES * STATES + STATES * sum(SIZES)


def count(lines: list[str], states: list[int], into: np.ndarray) -> None:
    if not lines:
        return
    first, moves, *feats = split_counts(into)  # views
    s, obs = np.array(states), observed(lines)
    first[s[0]] += 1
    np.add.at(moves, (s[:-1], s[1:]), 1)
    for k, f in enumerate(feats):
        np.add.at(f, (s, obs[:, k]), 1)


def render(lines: list[str], states: np.ndarray) -> tuple[list[str], str]:
    """Roles of the turns, and the turns as <|role|> newline text newline <|end|> newline."""
    roles: list[str] = []
    out: list[list[str]] = []
    for line, s in zip(lines, states.tolist(), strict=True):
        if s % 2 == 0 or not out:
            m = MARKER.match(line)
            roles.append(ROLES[s // 2])
            out.append([line[m.end() :] if m and NAMES[m.group(1).lower()] == s // 2 else line])
        else:
            out[-1].append(line)
    return roles, "".join(f"<|{r}|>\n" + "\n".join(x).strip("\n") + "\n<|end|>\n" for r, x in zip(roles, out, strict=True))


def style(conv_id: Column) -> Column:
    """How a conversation's transcript marks the speakers, by the hash of its id; 4 has no markers, but a blank
    line after each turn."""
    return F.pmod(F.xxhash64(conv_id), F.lit(5))


def transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, lines, states: the turns of each conversation written as a plain transcript, and the true
    state of each line. One conversation is one row, and must fit in one like any text.

    Turns without number come first; turns of one number are in order of role and text. A null text is an
    empty turn; an unknown role counts as user. A turn without conv_id is a conversation of its own (turns
    without it that are alike in all are one), so that such rows never meet in one group.
    """
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lower(F.col("role").cast("string")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    c = c.withColumn("role", F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("user"))
    c = c.withColumn("own", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")))
    title, kind = F.initcap("role"), style(F.col("conv_id"))
    human = F.when(F.col("role") == "user", "Human").otherwise(title)
    mark = F.when(kind == 0, F.concat(title, F.lit(": "))).when(kind == 1, F.concat(F.lit("### "), human, F.lit(": "))).when(kind == 2, F.concat(F.lit("<|"), "role", F.lit("|>"))).when(kind == 3, F.concat(F.lit("["), F.upper("role"), F.lit("] "))).otherwise("")
    text = F.concat(mark, "text", F.when(F.coalesce(kind == 4, F.lit(False)), "\n").otherwise(""))
    turns = c.withColumn("text", text).groupBy("conv_id", "own").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    state = lambda t: F.when(t["role"] == "system", 0).when(t["role"] == "user", 2).otherwise(4)
    lines = F.flatten(F.transform("turns", lambda t: F.transform(F.split(t["text"], "\n"), lambda x, i: F.struct(x.alias("line"), (state(t) + (i > 0).cast("int")).alias("state")))))
    return turns.withColumn("x", lines).select("conv_id", F.col("x.line").alias("lines"), F.col("x.state").alias("states"))


def held_out(conv_id: Column) -> Column:
    return F.coalesce(F.crc32(conv_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(known: DataFrame) -> Model:
    """Counts over all transcripts with known states but the held-out fifth; partial counts are summed by
    key, so the driver gets one number for each parameter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_COUNTS)
        for batch in batches:
            for lines, states in zip(batch.column("lines"), batch.column("states"), strict=True):
                count([x or "" for x in lines.as_py() or []], states.as_py() or [], total)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["k", "n"])

    flat = np.zeros(N_COUNTS)
    rows = known.where(~held_out(F.col("conv_id"))).select("lines", "states").mapInArrow(run, "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).collect()
    for r in rows:
        flat[r.k] = r.n
    return Model(flat)


def parse(plain: DataFrame, model: Model) -> DataFrame:
    """Parses conv_id, lines (and states where known) into conv_id, n_turns, roles, n_lines, n_right (lines
    whose state is the known one; null if unknown), rendered and rendered_sha256: a row for each row of
    plain, read whole.

    A transcript without lines has no turns and renders empty; null lines count as blank; null and repeated
    conv_ids are kept. An empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lines, states in zip(batch.column("lines"), batch.column("states"), strict=True):
                lines = [x or "" for x in lines.as_py() or []]
                got, true = model.viterbi(observed(lines)), states.as_py()
                roles, text = render(lines, got)
                rows.append((len(roles), ",".join(roles), len(lines), None if true is None else int((got == np.array(true, np.int64)).sum()), text, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["conv_id", "n_turns", "roles", "n_lines", "n_right", "rendered", "rendered_sha256"])

    own = plain.select(F.col("conv_id").cast("long").alias("conv_id"), "lines", F.col("states") if "states" in plain.columns else F.lit(None).cast("array<int>").alias("states"))
    return own.mapInArrow(run, "conv_id long, n_turns long, roles string, n_lines long, n_right long, rendered string, rendered_sha256 string")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = transcripts(table(spark, sf_dir, "conversations"))
    return parse(known, train(known)).withColumn("held_out", held_out(F.col("conv_id"))).withColumn("style", style(F.col("conv_id")))
