"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, from user to assistant. Every row of a
conversation takes one action: it keeps its role, is relabelled, is merged into the turn before, and empty turns may be inserted
before it (or after the last row). Dynamic programming over the states of the automaton finds the cheapest choice.

The cost of a run of rows is a matrix over (state before, state after), and runs join by the (min, +) product. So conversations are
not gathered: rows are range-partitioned by (conversation, turn), every run of at most ``RUN`` rows gives one small matrix, the
matrices of a conversation are chained, and each run is then solved on its own between the two states it was given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.texts import Key
from cohortloom.session import cut_lineage

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = ("", "system", "user", "assistant")
# Legal next turns of each state.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, INSERT = 2, 3, 4  # costs; keeping costs nothing, merging a row of another role costs MERGE + RELABEL
RUN = 2048
OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"


def inserted(a: int, b: int) -> tuple[int, ...] | None:
    """Shortest legal chain of empty turns between state ``a`` and a turn of role ``b``."""
    paths = [(a, ())]
    for state, chain in paths:
        if b in NEXT[state]:
            return chain
        if len(chain) < 3:
            paths += [(s, (*chain, s)) for s in NEXT[state]]
    return None


# Per role of a row (unknown roles: START): the moves (state before, state after, cost, action, inserted turns), cheapest first per pair.
def moves_of(role: int) -> dict[tuple[int, int], tuple[int, str, tuple[int, ...]]]:
    out: dict[tuple[int, int], tuple[int, str, tuple[int, ...]]] = {}
    for a in range(4):
        for b in (SYSTEM, USER, ASSISTANT):
            choices = []
            chain = inserted(a, b)
            if chain is not None:
                choices.append(((0 if b == role else RELABEL) + INSERT * len(chain), "keep" if b == role else "relabel", chain))
            if a == b:
                choices.append((MERGE + (0 if b == role else RELABEL), "merge", ()))
            if choices:
                out[a, b] = min(choices, key=lambda c: c[0])
    return out


MOVES = {role: moves_of(role) for role in range(4)}
FAR = 1 << 40
STEP = np.full((4, 4, 4), FAR, np.int64)
for _role, _moves in MOVES.items():
    for (_a, _b), _move in _moves.items():
        STEP[_role, _a, _b] = _move[0]
# What it takes to end in each state: nothing after assistant, else empty turns up to assistant.
END = {s: (*(inserted(s, ASSISTANT) or ()), ASSISTANT) if s != ASSISTANT else () for s in range(4)}
END_COST = np.array([INSERT * len(END[s]) for s in range(4)])


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def run_cost(roles: np.ndarray) -> np.ndarray:
    """Matrix of a run of rows, by halving: neighbours are joined all at once."""
    each = STEP[roles]
    while len(each) > 1:
        if len(each) % 2:
            each = np.concatenate([each, np.where(np.eye(4), 0, FAR).astype(np.int64)[None]])
        each = np.minimum((each[::2, :, :, None] + each[1::2, None, :, :]).min(axis=2), FAR)
    return each[0]


def solve(roles: list[int], begin: int, end: int) -> list[tuple[int, str, tuple[int, ...]]]:
    """Cheapest (state, action, inserted turns) of every row from state ``begin`` to state ``end``; ties go to the smaller state."""
    cost, back = [FAR] * 4, []
    cost[begin] = 0
    for r in roles:
        after, came = [FAR] * 4, [0] * 4
        for (a, b), move in MOVES[r].items():
            if cost[a] + move[0] < after[b]:
                after[b], came[b] = cost[a] + move[0], a
        cost = after
        back.append(came)
    out, state = [], end
    for r, came in zip(reversed(roles), reversed(back)):
        before = came[state]
        _, action, chain = MOVES[r][before, state]
        out.append((state, action, chain))
        state = before
    return out[::-1]


def chain_states(matrices: list[np.ndarray]) -> list[int]:
    """States at the ends of the runs of one conversation, cheapest in total; the first run begins at START."""
    cost, backs = np.where(np.arange(4) == START, 0, FAR), []
    for m in matrices:
        total = cost[:, None] + m
        backs.append(total.argmin(axis=0))
        cost = np.minimum(total.min(axis=0), FAR)
    states = [int((cost + END_COST).argmin())]
    for back in reversed(backs):
        states.append(int(back[states[-1]]))
    return states[::-1]


def empty_turns(chain: tuple[int, ...]) -> str:
    return "".join(OPEN.format(role=STATES[s]) + CLOSE for s in chain)


ROW = "_conv {conv}, _turn {turn}, _role string, _text string, _block long, _place int"
OUT = "conv_id {conv}, turn {turn}, role string, new_role string, action string, inserted int, opened int, rendered string"


def numbered(rows: DataFrame, conv: str, turn: str) -> DataFrame:
    """Rows in order of (conversation, turn, role, text), each with the number of its block: at most ``RUN`` rows of one partition."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, at = TaskContext.get().partitionId() << 40, 0
        for b in batches:
            place = np.arange(at, at + b.num_rows)
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base + place // RUN), pa.array(place % RUN, pa.int32())], [*b.schema.names, "_block", "_place"])

    order = ["_conv", "_turn", "_role", "_text"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, ROW.format(conv=conv, turn=turn))


def conversations_in(table: pa.Table) -> list[tuple[int, int]]:
    """(begin, end) of every conversation in a sorted block."""
    ids = table.column("_conv").to_pylist()
    cuts = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)]
    return list(zip(cuts, cuts[1:]))


def render_run(codes: list[int], texts: list[str | None], begin: int, end: int, last: bool) -> list[tuple[str, str, int, int, str]]:
    """(new role, action, inserted turns, opened turns, rendered part) of every row of a run."""
    out, state = [], begin
    for i, ((to, action, chain), text) in enumerate(zip(solve(codes, begin, end), texts)):
        merged = action == "merge"
        head = "\n" if merged else (CLOSE if state != START else "") + empty_turns(chain) + OPEN.format(role=STATES[to])
        closes = last and i == len(codes) - 1
        tail = END[to] if closes else ()
        out.append((STATES[to], action, len(chain) + len(tail), (0 if merged else 1 + len(chain)) + len(tail),
                    head + (text or "") + (CLOSE + empty_turns(tail) if closes else "")))
        state = to
    return out


def repair(conversations: DataFrame) -> DataFrame:
    """One row per input row, in the repaired conversation: conv_id, turn, role, new_role, action (keep, relabel or merge),
    inserted (number of empty turns put in around it), opened (turns that begin with it, inserted ones included) and rendered.

    ``rendered`` is the row's part of the formatted conversation: the parts of a conversation in order of (turn, role, text) give the
    whole. A null or unknown role has no legal place and is relabelled or merged; a null text renders as empty; rows that share a
    turn follow in order of role and text (nulls first); rows with a null conv_id form one conversation. A repeated row is
    a row of its own. An empty table gives no rows. Other columns are not read.
    """
    conv, turn = (conversations.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    rows = conversations.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("role").cast("string").alias("_role"), F.col("text").cast("string").alias("_text"))
    stored = cut_lineage(numbered(rows, conv, turn))
    coded = stored.withColumn("_code", F.coalesce(*[F.when(F.col("_role") == s, F.lit(k)) for k, s in enumerate(STATES) if s], F.lit(START)))

    def cost(key: Key, table: pa.Table) -> pa.Table:
        """Only the first and the last conversation of a block can go on in another block."""
        table = table.sort_by("_place")
        codes, runs = table.column("_code").to_numpy(), conversations_in(table)
        edge = runs[:1] + runs[1:][-1:]
        return pa.table([pa.chunked_array([table.column("_conv").slice(a, 1).combine_chunks() for a, _ in edge], table.schema.field("_conv").type), pa.array([key[0].as_py()] * len(edge)),
                         pa.array(range(len(edge)), pa.int32()), pa.array([run_cost(codes[a:b]).ravel().tolist() for a, b in edge], pa.list_(pa.int64()))],
                        names=["_conv", "_block", "_edge", "_cost"])

    def chained(key: Key, table: pa.Table) -> pa.Table:
        table = table.sort_by("_block")
        states = chain_states([np.array(m).reshape(4, 4) for m in table.column("_cost").to_pylist()])
        return pa.table([table.column("_block"), table.column("_edge"), pa.array(states[:-1], pa.int32()), pa.array(states[1:], pa.int32()),
                         pa.array([k == len(states) - 2 for k in range(len(states) - 1)])], names=["_block", "_edge", "_begin", "_end", "_last"])

    def render(key: Key, table: pa.Table) -> pa.Table:
        table = table.sort_by("_place")
        codes, texts, runs = table.column("_code").to_pylist(), table.column("_text").to_pylist(), conversations_in(table)
        edges = {e["_edge"]: e for e in table.column("_edges")[0].as_py()}
        out = []
        for k, (a, b) in enumerate(runs):
            e = edges[0] if k == 0 else edges[1] if k == len(runs) - 1 else None
            if e is None:
                begin, end = chain_states([run_cost(np.array(codes[a:b]))])
                e = {"_begin": begin, "_end": end, "_last": True}
            out += render_run(codes[a:b], texts[a:b], e["_begin"], e["_end"], e["_last"])
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
        return pa.table([*(table.column(c) for c in ("_conv", "_turn", "_role")), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))],
                        names=["conv_id", "turn", "role", "new_role", "action", "inserted", "opened", "rendered"])

    costs = coded.select("_conv", "_block", "_place", "_code").groupBy("_block").applyInArrow(cost, f"_conv {conv}, _block long, _edge int, _cost array<long>")
    ends = costs.groupBy("_conv").applyInArrow(chained, "_block long, _edge int, _begin int, _end int, _last boolean")  # at most two rows per block
    edges = ends.groupBy("_block").agg(F.collect_list(F.struct("_edge", "_begin", "_end", "_last")).alias("_edges"))
    return coded.join(edges, "_block").groupBy("_block").applyInArrow(render, OUT.format(conv=conv, turn=turn))


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    """Repair and format every conversation."""
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
