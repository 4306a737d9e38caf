"""Chat formatting: a hidden Markov model recovers roles before turns are rendered in one form.

A transcript is lines in order. Hidden states are the three roles, each as the first line of a turn or a later one.
A line's features are its speaker marker, if any ("User:", "### Response", "<|im_start|>system" and the like), whether
it begins a row, its length, whether it asks, and whether it is blank; they are independent given the state. Viterbi
finds the most likely states, turns begin where a first-line state does, and a turn is rendered as
``<|role|>``, its lines without markers, ``<|end|>``.

Start, transition and feature probabilities are smoothed counts over all labelled rows whose crc32(conv_id) mod 5 is
not 0: a table of fixed size, whatever the input. What a marker says is set by hand, since labelled rows have none.

Long transcripts: a transcript is worked on in chunks of ``CHUNK`` turn numbers. Each chunk gives its best score from
every state to every state, those of a transcript are chained, and each chunk is then decoded between the states that
the chain fixed. The result is the best path of the whole, and no task holds more than a chunk.

Nulls and edges: a null text is one blank line; a row with a null conv_id or a null turn has no place in a transcript and is one by
itself (chunk null); equal turn numbers are ordered by text; without labelled rows every probability is uniform and markers decide;
an empty table gives no rows; extra columns are ignored. The role column is never read except to learn.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorevane.scratch import Scratch

from .common import fold

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # role r begins in state 2r and goes on in 2r + 1
CHUNK = 256
SMOOTH = 0.5
MARKS = {
    "system": r"system|instructions?|sys",
    "user": r"user|human|q(?:uestion)?|prompter|customer|me|instruction",
    "assistant": r"assistant|ai|bot|a(?:nswer)?|gpt|model|response|agent",
}
_MARK = {r: re.compile(rf"^\s*(?:<\|(?:im_start\|>)?\s*(?:{p})(?:\|>)?\s*:?|#{{1,4}}\s*(?:{p})\s*:?|\[(?:{p})\]\s*:?|\**(?:{p})\**\s*:)\s*", re.I) for r, p in MARKS.items()}
#: Log-odds that a marker adds to the first line of its role, and that other lines lose by having one.
MARK_WEIGHT = 6.0
BUCKETS = (0, 20, 60, 120, 240, 480, 960)
N_FEATURES = 2 * (len(BUCKETS) + 1) * 2


def marker(line: str) -> tuple[int, str]:
    """Role of the line's marker (-1: none), and the line without it."""
    for i, r in enumerate(ROLES):
        if m := _MARK[r].match(line):
            return i, line[m.end() :]
    return -1, line


def feature(line: str, starts: bool) -> int:
    """One number for what else a line shows: length class, a question mark, the begin of a row."""
    n = sum(len(line) > b for b in BUCKETS)
    return (n * 2 + ("?" in line)) * 2 + starts


def emissions(lines: list[tuple[str, bool]], table: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Log-score of each line in each state, and the lines without markers."""
    out, bare = np.zeros((len(lines), STATES)), []
    for i, (line, starts) in enumerate(lines):
        role, rest = marker(line)
        out[i] = table[:, feature(rest, starts)]
        if role >= 0:
            out[i] -= MARK_WEIGHT
            out[i, 2 * role] += 2 * MARK_WEIGHT
        elif not starts:
            out[i, ::2] -= MARK_WEIGHT / 2  # within a row, a turn begins with a marker
        if starts:
            out[i, 1::2] -= MARK_WEIGHT
        bare.append(rest)
    return out, bare


def transfer(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best score of the lines' path into each state (columns) from each state before them (rows)."""
    m = trans + e[0]
    for x in e[1:]:
        m = (m[:, :, None] + trans[None]).max(axis=1) + x
    return m


def begin(e: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best score of the path into each state when the transcript begins with these lines."""
    v = first + e[0]
    for x in e[1:]:
        v = (v[:, None] + trans).max(axis=0) + x
    return v


def viterbi(e: np.ndarray, first: np.ndarray, trans: np.ndarray, last: int | None = None) -> np.ndarray:
    """Most likely states; first: scores of the states at the first line before its emission."""
    v, back = first + e[0], []
    for x in e[1:]:
        step = v[:, None] + trans
        back.append(step.argmax(axis=0))
        v = step.max(axis=0) + x
    path = [int(v.argmax()) if last is None else last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def _chunk_lines(t: pa.Table) -> list[tuple[str, bool, int]]:
    rows = sorted(zip(t["turn"].to_pylist(), t["text"].to_pylist()), key=lambda r: (r[0], r[1] or ""))
    return [(line, k == 0, turn) for turn, text in rows for k, line in enumerate((text or "").split("\n"))]


def _matrix(model):
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("m", pa.list_(pa.float64()))])

    def task(t: pa.Table) -> pa.Table:
        table, first, trans = model.value
        e, _ = emissions([x[:2] for x in _chunk_lines(t)], table)
        return pa.table([[t["conv_id"][0].as_py()], [t["chunk"][0].as_py()], [transfer(e, trans).ravel().tolist() + begin(e, first, trans).tolist()]], schema=schema)

    return task


def _chain(t: pa.Table) -> pa.Table:
    """Chunks of one transcript to the states that each chunk enters from (-1: begins) and ends in."""
    order = np.argsort(t["chunk"].to_numpy())
    m = [np.array(t["m"][int(i)].as_py()) for i in order]
    step = [x[: STATES * STATES].reshape(STATES, STATES) for x in m]
    v, best = m[0][-STATES:], []
    for s in step[1:]:
        paths = v[:, None] + s
        best.append(paths.argmax(axis=0))
        v = paths.max(axis=0)
    ends = [int(v.argmax())]
    for b in reversed(best):
        ends.append(int(b[ends[-1]]))
    ends = ends[::-1]
    return pa.table({"conv_id": t["conv_id"].take(pa.array(order)), "chunk": t["chunk"].take(pa.array(order)), "enter": pa.array([-1, *ends[:-1]], pa.int32()), "leave": pa.array(ends, pa.int32())})


_TURNS = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("part", pa.int64()), ("first_turn", pa.int64()), ("opens", pa.bool_()), ("role", pa.string()), ("n_lines", pa.int64()), ("body", pa.string())])


def _turns(conv, chunk, lines: list[tuple[str, bool, int]], model, enter: int | None, leave: int | None) -> list[tuple]:
    """Recovered turns of one chunk, as rows."""
    table, first, trans = model
    e, bare = emissions([x[:2] for x in lines], table)
    states = viterbi(e, first if enter is None or enter < 0 else trans[enter], trans, leave)
    cuts = [0, *(i for i in range(1, len(states)) if states[i] % 2 == 0), len(states)]
    return [(conv, chunk, k, lines[a][2], bool(states[a] % 2 == 0), ROLES[states[a] // 2], b - a, "\n".join(bare[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def _lone(model):
    """Rows that are transcripts by themselves."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                rows = []
                for conv, turn, text in zip(*(c.to_pylist() for c in b.slice(at, 1000).columns)):
                    rows += _turns(conv, None, [(line, k == 0, turn) for k, line in enumerate((text or "").split("\n"))], model.value, None, None)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _TURNS.types)], schema=_TURNS)

    return run


def _decode(model):
    def task(t: pa.Table) -> pa.Table:
        rows = _turns(t["conv_id"][0].as_py(), t["chunk"][0].as_py(), _chunk_lines(t), model.value, t["enter"][0].as_py(), t["leave"][0].as_py())
        return pa.table([pa.array(c, x) for c, x in zip(zip(*rows), _TURNS.types)], schema=_TURNS)

    return task


def learn(conversations: DataFrame, mod: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-probabilities from labelled rows: features by state, start states, transitions. Fixed-size counts are collected."""
    from pyspark.sql import Window as W

    own = conversations.where((fold(F.col("conv_id"), mod) != 0) & F.lower("role").isin(*ROLES)).select("conv_id", "turn", F.lower("role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    line = F.split("text", "\n")
    size = sum((F.length("x") > b).cast("int") for b in BUCKETS)
    f = own.select("role", F.posexplode(line).alias("i", "x"))
    f = f.select("role", (F.col("i") > 0).cast("int").alias("later"), ((size * 2 + F.contains("x", F.lit("?")).cast("int")) * 2 + (F.col("i") == 0).cast("int")).alias("f"))
    emit = np.full((STATES, N_FEATURES), SMOOTH)
    for r in f.groupBy("role", "later", "f").count().collect():
        emit[2 * ROLES.index(r["role"]) + r["later"], r["f"]] += r["count"]
    # The turn before is looked up within a chunk, so a long transcript is no single task; a chunk's first turn has the last one of the
    # chunk before it.
    own = own.withColumn("n", F.size(line)).withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    order = W.partitionBy("conv_id", "chunk").orderBy("turn", "text", "role")
    turns = own.where("conv_id is not null and turn is not null").select("conv_id", "chunk", "role", "n", F.lag("role").over(order).alias("before"))
    last = own.where("conv_id is not null and turn is not null").groupBy("conv_id", "chunk").agg(F.max_by("role", F.struct("turn", "text", "role")).alias("last"))
    last = last.select("conv_id", "chunk", F.lag("last").over(W.partitionBy("conv_id").orderBy("chunk")).alias("last")).where("last is not null")
    inner = turns.where("before is not null").select("role", "before", "n")
    outer = turns.where("before is null").join(last, ["conv_id", "chunk"], "left").select("role", F.col("last").alias("before"), "n")
    lone = own.where("conv_id is null or turn is null").select("role", F.lit(None).cast("string").alias("before"), "n")
    pairs = inner.unionByName(outer).unionByName(lone)
    start, go, n_lines = np.full(len(ROLES), SMOOTH), np.full((len(ROLES), len(ROLES)), SMOOTH), np.full((len(ROLES), 2), SMOOTH)
    for r in pairs.groupBy("role", "before").agg(F.count(F.lit(1)).alias("turns"), F.sum("n").alias("lines")).collect():  # 12 rows at most
        i = ROLES.index(r["role"])
        if r["before"] is None:
            start[i] += r["turns"]
        else:
            go[ROLES.index(r["before"]), i] += r["turns"]
        n_lines[i] += r["lines"] - r["turns"], r["turns"]
    stay = n_lines[:, 0] / n_lines.sum(axis=1)
    go /= go.sum(axis=1, keepdims=True)
    trans, first = np.full((STATES, STATES), 1e-9), np.full(STATES, 1e-9)
    for a in range(len(ROLES)):
        first[2 * a] = start[a] / start.sum()
        for s in (2 * a, 2 * a + 1):
            trans[s, 2 * a + 1] = stay[a]
            trans[s, ::2] = (1 - stay[a]) * go[a]
    return np.log(emit / emit.sum(axis=1, keepdims=True)), np.log(first), np.log(trans)


def parse(spark: SparkSession, rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row per recovered turn: conv_id, chunk and part (its order), first_turn, opens, role, n_lines, body, rendered.

    opens is false for a turn that goes on from the chunk before. A row that is a transcript by itself has a null chunk."""
    scratch = Scratch(spark, "chat")
    model = spark.sparkContext.broadcast(learn(labelled))
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text")
    spelled = "conv_id long, chunk long, part long, first_turn long, opens boolean, role string, n_lines long, body string"
    lone = every.where("conv_id is null or turn is null").mapInArrow(_lone(model), spelled)
    d = every.where("conv_id is not null and turn is not null").withColumn("chunk", F.floor(F.col("turn") / CHUNK).cast("long"))
    spans = d.groupBy("conv_id").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a < b").select("conv_id")
    spans = scratch.keep(spans)
    long_ = d.join(spans, "conv_id", "left_semi")
    m = long_.groupBy("conv_id", "chunk").applyInArrow(_matrix(model), "conv_id long, chunk long, m array<double>")
    ends = scratch.keep(m.groupBy("conv_id").applyInArrow(_chain, "conv_id long, chunk long, enter int, leave int"))
    d = d.join(ends, ["conv_id", "chunk"], "left").select("conv_id", "chunk", "turn", "text", "enter", "leave")
    out = d.groupBy("conv_id", "chunk").applyInArrow(_decode(model), spelled).unionByName(lone)
    return out.withColumn("rendered", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>\n")))
