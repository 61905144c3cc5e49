"""Chat formatting with repair of the roles at least cost.

A legal conversation is an optional system turn, then user and assistant turns in turn, the last by the assistant. Each turn as it
is may be kept, merged into the turn before it, given another role, or preceded by an empty turn that was missing; at the end a
missing assistant turn may be added. Dynamic programming over the states of the automaton (nothing yet, or the role of the last
turn) finds a repair of least total cost; of equal repairs, the one whose first different step has the smaller rank wins (keep,
merge, relabel, insert; then the smaller role), so the result is unique.

Turns are sorted by a range partitioning over conversation and turn. A conversation that lies inside a partition is repaired and
rendered there, as its turns stream by. Those that a border between partitions may cut, and those of more than `segment` turns or
`segment_bytes` of text, go a longer way: they are cut into segments by the number and the bytes of the turns before, a segment's
costs from state to state form a matrix, matrices are composed per conversation (min, +) to give the cost-to-go behind each
segment, and segments are repaired on their own after that. So a conversation of any length never lies in one task, and neither
repairs nor rows depend on the partitions. What one task holds of a conversation is a matrix for each of its segments.

A mark such as <|end|> inside a text gets a backslash after the <, and one more where it has some, so that no text can open or close
a turn, and a reader gets it back by taking one backslash away.

Defined results: a null text is an empty turn; null, unknown and differently cased roles are unknown and take any role at a lower
cost; null turns come first; rows of equal turns are ordered by role and text, repeated rows are kept as turns; a null conversation
id is one conversation; a text of any length is in one segment; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of the steps; an unknown role takes a role at the cost of `name`.
COSTS = {"keep": 0, "merge": 1, "name": 1, "relabel": 3, "insert": 2}
KEEP, MERGE, RELABEL, INSERT = range(4)
_LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)}
_FAR = 1 << 40


def _steps() -> dict[int, list[list[tuple[int, int, int, int]]]]:
    """For each role code (0 unknown) and state: (rank, next state, cost, inserted state or 0), by rank."""
    out: dict[int, list] = {}
    for role in range(4):
        rows = []
        for state in range(4):
            found = []
            for q in (SYSTEM, USER, ASSISTANT):
                change = 0 if q == role else COSTS["name"] if role == 0 else COSTS["relabel"]
                rank = KEEP if change == 0 else RELABEL
                if (state, q) in _LEGAL:
                    found.append((rank, q, change, 0))
                elif state == q:
                    found.append((MERGE if change == 0 else RELABEL, q, change + COSTS["merge"], 0))
                for p in (USER, ASSISTANT):
                    if (state, p) in _LEGAL and (p, q) in _LEGAL:
                        found.append((INSERT, q, change + COSTS["insert"], p))
            rows.append(sorted(found))
        out[role] = rows
    return out


STEPS = _steps()
#: Cost of ending in each state: the assistant has the last word, so a lone system turn gets two empty turns.
END = (0, 2 * COSTS["insert"], COSTS["insert"], 0)


def costs_to_go(roles: tuple[int, ...], behind: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Least cost from each state before each turn to the end; the last entry is `behind`."""
    out = [after := tuple(behind)]
    for r in reversed(roles):
        out.append(after := tuple(min((c + after[q] for _, q, c, _ in steps), default=_FAR) for steps in STEPS[r]))
    return out[::-1]


def walk(roles: tuple[int, ...], go: list[tuple[int, ...]], state: int) -> tuple[list[tuple[int, int, int]], int]:
    """(rank, state, inserted) for each turn of the unique least repair from `state`, and the last state."""
    path = []
    for t, r in enumerate(roles):
        rank, state, _, extra = next(x for x in STEPS[r][state] if x[2] + go[t + 1][x[1]] == go[t][state])
        path.append((rank, state, extra))
    return path, state


@functools.lru_cache(4096)
def _repair_short(roles: tuple[int, ...]) -> tuple[list[tuple[int, int, int]], int]:
    go = costs_to_go(roles, END)
    return walk(roles, go, START)[0], go[0][START]


def repair(roles: tuple[int, ...]) -> tuple[list[tuple[int, int, int]], int]:
    """The path and the cost of a whole conversation; short ones are alike in few ways."""
    return _repair_short(roles) if len(roles) <= 32 else _repair_short.__wrapped__(roles)


def _matrix(roles: tuple[int, ...]) -> list[int]:
    return [x for q in range(4) for x in costs_to_go(roles, tuple(0 if k == q else _FAR for k in range(4)))[0]]


def _code(role: str | None) -> int:
    return ROLES.index(role) + 1 if role in ROLES else 0


_MARK = re.compile(r"<(\\*)\|(system|user|assistant|end)\|>")


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|\2|>", text) if "|>" in text else text


def render(path: list[tuple[int, int, int]], texts: list[str], state: int, last: bool) -> tuple[str, int]:
    """The text of a segment that is entered in `state`, and how many turns begin in it.

    A turn is closed where the next one begins, so that a merge can go on in the next segment.
    """
    out, turns = [], 0

    def begin(role: int) -> None:
        nonlocal turns, state
        if state != START:
            out.append("<|end|>\n")
        out.append(f"<|{ROLES[role - 1]}|>\n")
        state, turns = role, turns + 1

    for (_, role, extra), text in zip(path, texts):
        if extra:
            begin(extra)
        if role == state and not extra:
            out.append("\n" + escape(text))
        else:
            begin(role)
            out.append(escape(text))
    if last:
        for role in {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,)}.get(state, ()):
            begin(role)
        if state != START:
            out.append("<|end|>\n")
    return "".join(out), turns


_WHOLE = ("n_turns_in", "n_turns", "cost", "rendered")
_CUT = ("pid", "number", "pos", "before", "role", "text")
_TYPES = dict(zip((*_WHOLE, *_CUT), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())))


def _stream(batches: Iterator[pa.RecordBatch], segment: int, segment_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns (conv, role, text) to whole conversations, or to numbered turns of those that are cut or too long."""
    pid = TaskContext.get().partitionId()
    rows: list[tuple] = []
    held = 0  # characters in rows
    now, turns, number, pos, before, cut = None, [], -1, 0, 0, True

    def hand_over() -> None:
        """The turns that are held go the longer way."""
        nonlocal held, pos, before, turns
        for role, text in turns:
            rows.append((now, None, None, None, None, pid, number, pos, before, role, text))
            held += len(text)
            pos += 1
            before += len(text.encode())
        turns = []

    def finish() -> None:
        nonlocal held, turns
        if cut:
            hand_over()
        elif turns:
            path, cost = repair(tuple(_code(r) for r, _ in turns))
            text, n = render(path, [t for _, t in turns], START, True)
            rows.append((now, len(turns), n, cost, text, *[None] * len(_CUT)))
            held += len(text)
            turns = []

    def batch(kind: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, t) for c, t in zip(cols[1:], _TYPES.values()))], ["conv", *_TYPES])

    kind, size = None, 0
    for b in batches:
        kind = b.column(0).type
        for conv, role, text in zip(*(c.to_pylist() for c in b.columns)):
            if number < 0 or not (conv == now or conv != conv and now != now):
                finish()
                now, number, pos, before, size = conv, number + 1, 0, 0, 0
                cut = number == 0  # the first may have begun in the partition before
            elif not cut and (len(turns) == segment or size >= segment_bytes):
                cut = True
            turns.append((role, text))
            size += len(text.encode())
            if cut:
                hand_over()
            if len(rows) >= 4096 or held >= 4_000_000:
                yield batch(kind)
                rows, held = [], 0
    if number >= 0:
        cut = True  # the last may go on in the next partition
        finish()
        if rows:
            yield batch(kind)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 segment: int = 2048, segment_bytes: int = 4_000_000) -> DataFrame:
    """One row a conversation: its id, part (0), n_turns_in, n_turns, cost, rendered.

    One with more than `segment` turns, or with turns after `segment_bytes` of text, has a row for each of its segments; the rendered
    parts, joined in order, are the whole conversation, and the other columns are sums over them.
    """
    kind = turns.schema[conv_col].dataType.simpleString()
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["conv", "turn", "role"]
    # the bounds of ranges are sampled by the driver, so of a text only its first characters are in them; they sort as the texts do
    ordered = rows.repartitionByRange(n, *keys, F.substring("text", 1, 64)).sortWithinPartitions(*keys, "text").select("conv", "role", "text")
    sql = {pa.int64(): "long", pa.string(): "string"}
    seen = materialize(ordered.mapInArrow(lambda batches: _stream(batches, segment, segment_bytes),
                                          f"conv {kind}, " + ", ".join(f"{c} {sql[t]}" for c, t in _TYPES.items())))
    whole = seen.where("pid is null").select("conv", F.lit(0).cast("long").alias("part"), *_WHOLE)

    # what is cut: turns are numbered over all partitions, and a segment is known by the turns and the bytes before it
    cut = seen.where("pid is not null")
    own = Window.partitionBy("conv").orderBy("pid")
    bases = cut.groupBy("conv", "pid", "number").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).select(
        F.col("conv").alias("c"), F.col("pid").alias("p"), (F.sum("n").over(own) - F.col("n")).alias("n0"), (F.sum("b").over(own) - F.col("b")).alias("b0"),
        (F.first("pid").over(own) * (1 << 32) + F.first("number").over(own)).alias("cid"))
    part = F.floor((F.col("n0") + F.col("pos")) / segment) + F.floor((F.col("b0") + F.col("before")) / segment_bytes)
    placed = materialize(cut.join(bases, F.col("conv").eqNullSafe(F.col("c")) & (F.col("pid") == F.col("p"))).select(
        "conv", "cid", part.alias("seg"), (F.col("n0") + F.col("pos")).alias("pos"), "role", "text"))
    roles = placed.select("cid", "seg", "pos", "role")

    def codes(t: pa.Table) -> tuple[int, ...]:
        return tuple(map(_code, t.sort_by("pos").column("role").to_pylist()))

    def table_of(t: pa.Table, **more) -> pa.Table:
        return pa.table({"cid": t.column("cid")[:1], "seg": t.column("seg")[:1], **more})

    def matrices(t: pa.Table) -> pa.Table:
        return table_of(t, m=pa.array([_matrix(codes(t))], pa.list_(pa.int64())))

    def behind(t: pa.Table) -> pa.Table:
        t = t.sort_by([("seg", "descending")])
        go, out = END, []
        for m in t.column("m").to_pylist():
            out.append(list(go))
            go = tuple(min(m[4 * end + s] + go[end] for end in range(4)) for s in range(4))
        k = len(out)
        return pa.table({"cid": t.column("cid"), "seg": t.column("seg"), "go": pa.array(out, pa.list_(pa.int64())),
                         "last": pa.array([i == 0 for i in range(k)]), "part": pa.array(range(k - 1, -1, -1), pa.int64())})

    def exits(t: pa.Table) -> pa.Table:
        r = codes(t)
        go = costs_to_go(r, tuple(t.column("go")[0].as_py()))
        return table_of(t, to=pa.array([[walk(r, go, s)[1] if go[0][s] < _FAR else 0 for s in range(4)]], pa.list_(pa.int32())))

    def forward(t: pa.Table) -> pa.Table:
        t = t.sort_by("seg")
        state, out = START, []
        for to in t.column("to").to_pylist():
            out.append(state)
            state = to[state]
        return pa.table({"cid": t.column("cid"), "seg": t.column("seg"), "entry": pa.array(out, pa.int32())})

    def mend(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        r, last = codes(t), t.column("last")[0].as_py()
        state = t.column("entry")[0].as_py()
        go = costs_to_go(r, tuple(t.column("go")[0].as_py()))
        path, end = walk(r, go, state)
        text, n_turns = render(path, t.column("text").to_pylist(), state, last)
        cost = go[0][state] - (0 if last else go[-1][end])
        return pa.table({"conv": t.column("conv")[:1], "part": t.column("part")[:1], "n_turns_in": pa.array([len(r)], pa.int64()),
                         "n_turns": pa.array([n_turns], pa.int64()), "cost": pa.array([cost], pa.int64()), "rendered": pa.array([text], pa.string())})

    key = ["cid", "seg"]
    mats = roles.groupBy(*key).applyInArrow(matrices, "cid long, seg long, m array<long>")
    go = materialize(mats.groupBy("cid").applyInArrow(behind, "cid long, seg long, go array<long>, last boolean, part long"))
    outs = roles.join(go, key).groupBy(*key).applyInArrow(exits, "cid long, seg long, to array<int>")
    entry = outs.groupBy("cid").applyInArrow(forward, "cid long, seg long, entry int")
    known = materialize(go.join(entry, key))
    mended = placed.join(known, key).groupBy(*key).applyInArrow(mend, f"conv {kind}, part long, n_turns_in long, n_turns long, cost long, rendered string")
    return whole.unionByName(mended).withColumnRenamed("conv", conv_col)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
