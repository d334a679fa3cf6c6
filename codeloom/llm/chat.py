"""Operator 10, chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, ending with the assistant.
Dynamic programming over the automaton of legal turns chooses, for each given turn, to keep it, to merge it into the turn
before it, to relabel it, or to insert empty turns before it, so that the sum of costs is least. No text is lost.

A step of the program is a 4 x 4 matrix over (min, +), and such matrices can be multiplied in any grouping. A conversation
of any length is therefore cut into chunks of consecutive turns. Going forward, each chunk's part is reduced to one matrix, and chaining
these gives the cost of every state at the start of each part. Going back, each part maps the state at its end to that at its
start, by the same choices between equal costs as in one piece, and chaining the maps gives each part its end. So every part is
traced on its own, and the result doesn't depend on where a conversation was cut. The two chains run over one row a part, by conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the turn that is open.
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
MERGE, INSERT, RELABEL, NAME = 2.0, 3.0, 4.0, 1.0
CHUNK_ROWS, CHUNK_BYTES = 4096, 1 << 24
OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """The shortest run of states to insert between two states so that each step is legal."""
    found: dict[tuple[int, int], tuple[int, ...]] = {}
    for s in range(4):
        frontier = [(s, ())]
        for _ in range(4):
            nxt = []
            for at, via in frontier:
                for a, b in sorted(LEGAL):
                    if a == at and (s, b) not in found:
                        found[s, b] = via
                        nxt.append((b, (*via, b)))
            frontier = nxt
    return found


PATHS = _paths()


def options(role: int | None) -> list[tuple[int, int, float, str, tuple[int, ...]]]:
    """(from, to, cost, action, inserted) of every way to place a turn; role None: unknown."""
    out = []
    for to in (SYSTEM, USER, ASSISTANT):
        name = 0.0 if role == to else NAME if role is None else RELABEL
        for s in range(4):
            if (s, to) in PATHS:
                put = PATHS[s, to]
                out.append((s, to, name + INSERT * len(put), "keep" if role == to else "relabel", put))
            if s == to:
                out.append((s, to, name + MERGE, "merge" if role == to else "relabel+merge", ()))
    return sorted(out, key=lambda o: (o[2], len(o[4]), "merge" in o[3], o[0], o[1]))


OPTIONS = {r: options(r) for r in (None, SYSTEM, USER, ASSISTANT)}
STEPS = {r: np.full((4, 4), np.inf) for r in OPTIONS}
for _r, _m in STEPS.items():
    for _s, _t, _c, _, _ in OPTIONS[_r]:
        _m[_s, _t] = min(_m[_s, _t], _c)
ENDING = {START: (), ASSISTANT: (), USER: PATHS[USER, ASSISTANT] + (ASSISTANT,), SYSTEM: PATHS[SYSTEM, ASSISTANT] + (ASSISTANT,)}
END_COST = np.array([INSERT * len(ENDING[s]) for s in range(4)])


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product over (min, +)."""
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


IDENTITY = np.where(np.eye(4, dtype=bool), 0.0, np.inf)


def reduce_turns(roles: list[int | None]) -> np.ndarray:
    m = IDENTITY
    for r in roles:
        m = times(m, STEPS[r])
    return m


def reached(roles: list[int | None], start: np.ndarray) -> list[np.ndarray]:
    """The least cost of each state before and after each turn, from those at the start."""
    out = [start]
    for r in roles:
        out.append((out[-1][:, None] + STEPS[r]).min(axis=0))
    return out


def trace(roles: list[int | None], costs: list[np.ndarray], at: int) -> list[tuple[int, int, float, str, tuple[int, ...]]]:
    """The cheapest options for the turns that end in a state; of equal ones the first of OPTIONS."""
    out = []
    for k in range(len(roles) - 1, -1, -1):
        best = min((o for o in OPTIONS[roles[k]] if o[1] == at), key=lambda o: costs[k][o[0]] + o[2])
        out.append(best)
        at = best[0]
    return out[::-1]


FIRST = np.array([0.0, np.inf, np.inf, np.inf])


def _code(role: str | None) -> int | None:
    r = (role or "").strip().lower()
    return ROLES.index(r) + 1 if r in ROLES else None


def _segments(part: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame]]:
    part = part.sort_values("i", kind="stable").reset_index(drop=True)
    starts = np.flatnonzero(np.r_[True, part["ck"].to_numpy()[1:] != part["ck"].to_numpy()[:-1]]) if len(part) else []
    for a, b in zip(starts, [*starts[1:], len(part)], strict=True):
        yield part["ck"].iloc[a], part.iloc[a:b]


def _forward(parts: pd.DataFrame) -> pd.DataFrame:
    """The parts of one conversation, in order: costs at the start, turns before, whether last."""
    parts = parts.sort_values("chunk")
    costs = [FIRST]
    for m in parts["matrix"]:
        costs.append((costs[-1][:, None] + np.asarray(m).reshape(4, 4)).min(axis=0))
    n = parts["n"].to_numpy()
    return pd.DataFrame({"chunk": parts["chunk"], "ck": parts["ck"], "start": [c.tolist() for c in costs[:-1]], "before": np.cumsum(n) - n, "last": np.arange(len(parts)) == len(parts) - 1})


def _back(parts: pd.DataFrame) -> pd.DataFrame:
    """The state at the end of each part of one conversation."""
    parts = parts.sort_values("chunk", ascending=False)
    at, ends = None, []
    for to in parts["back"]:
        at = int(to[4]) if at is None else at  # only the last part tells the best end
        ends.append(at)
        at = int(to[at])
    return pd.DataFrame({"chunk": parts["chunk"], "ck": parts["ck"], "end": ends})


def repaired(
    turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """A row per given turn: conv_id, turn, seq (from 0 in its conversation), role, new_role, action, inserted, cost and rendered.

    The rendered pieces of a conversation, joined in the order of seq, are the repaired conversation. Turns are taken by turn
    (null last), then role (null first), then a hash of the text. Roles are matched without regard to case; any other or null role is unknown
    and is named at a low cost. Defined results: a null text is an empty one; null conv_ids form one conversation; repeated
    rows are turns of their own, one after the other; of equally cheap repairs the one counts whose last turn, then the one before it and so
    on, has the first of ``OPTIONS`` that fits, wherever chunks end; an empty table gives an empty result; other columns make no
    difference. A chunk has about chunk_rows turns, or fewer where their texts are long, so that it has about chunk_bytes.
    """
    kinds = {c: turns.schema[x].dataType.simpleString() for c, x in (("conv_id", conv_id), ("turn", turn))}
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit("")).alias("ck"),
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n = max(1, -(-size.n // chunk_rows), -(-(size.bytes or 0) // chunk_bytes))
    # the text's hash stands for it in the order, so that no long text is compared; equal rows are spread by a number
    order = ["ck", F.col("turn").asc_nulls_last(), "role", "d"]
    cut = rows.withColumn("d", F.xxhash64("text")).withColumn("at", F.monotonically_increasing_id()).repartitionByRange(n, *order, "at")
    cut = cut.sortWithinPartitions(*order, "at").withColumn("chunk", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id()).drop("at", "d")
    chunks = written(cut, "chat-chunks")
    light = chunks.select("chunk", "ck", "role", "i")

    def reduced(part: pd.DataFrame) -> pd.DataFrame:
        found = [(int(part["chunk"].iloc[0]), ck, len(p), reduce_turns([_code(r) for r in p["role"]]).ravel().tolist()) for ck, p in _segments(part)]
        return pd.DataFrame(found[:1] + found[1:][-1:], columns=["chunk", "ck", "n", "matrix"])  # only the first and the last may go on in other chunks

    def mapped(part: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        start = dict(zip(starts["ck"], starts["start"], strict=True))
        out = []
        for ck, p in _segments(part) if len(part) else ():
            if ck in start:
                roles = [_code(r) for r in p["role"]]
                costs = reached(roles, np.asarray(start[ck]))
                back = [trace(roles, costs, s)[0][0] if np.isfinite(costs[-1][s]) else 0 for s in range(4)]
                out.append((int(p["chunk"].iloc[0]), ck, [*back, int(np.argmin(costs[-1] + END_COST))]))
        return pd.DataFrame(out, columns=["chunk", "ck", "back"])

    edge = light.groupBy("chunk").applyInPandas(reduced, "chunk int, ck string, n bigint, matrix array<double>")
    forward = written(edge.groupBy("ck").applyInPandas(_forward, "chunk int, ck string, start array<double>, before bigint, last boolean"), "chat-starts")
    maps = light.groupBy("chunk").cogroup(forward.groupBy("chunk")).applyInPandas(mapped, "chunk int, ck string, back array<int>")
    ends = maps.groupBy("ck").applyInPandas(_back, "chunk int, ck string, end int")
    known = written(forward.join(ends, ["chunk", "ck"]), "chat-bounds")

    def place(part: pd.DataFrame, bounds: pd.DataFrame) -> pd.DataFrame:
        known = {b.ck: b for b in bounds.itertuples()}
        out = []
        for ck, p in _segments(part) if len(part) else ():
            roles = [_code(r) for r in p["role"]]
            b = known.get(ck)
            costs = reached(roles, FIRST if b is None else np.asarray(b.start))
            end, before, last = (int(np.argmin(costs[-1] + END_COST)), 0, True) if b is None else (int(b.end), int(b.before), bool(b.last))
            steps = trace(roles, costs, end)
            for k, ((s, to, cost, action, put), t) in enumerate(zip(steps, p["text"], strict=True)):
                if "merge" in action:
                    piece = "\n" + t
                else:
                    piece = (CLOSE if s != START else "") + "".join(OPEN.format(ROLES[x - 1]) + CLOSE for x in put) + OPEN.format(ROLES[to - 1]) + t
                added = put
                if last and k == len(steps) - 1:
                    piece += CLOSE + "".join(OPEN.format(ROLES[x - 1]) + CLOSE for x in ENDING[to])
                    added, cost = put + ENDING[to], cost + END_COST[to]
                out.append((before + k, ROLES[to - 1], action, [ROLES[x - 1] for x in added], float(cost), piece))
        p = part.sort_values("i", kind="stable")
        made = pd.DataFrame(out, columns=["seq", "new_role", "action", "inserted", "cost", "rendered"])
        for k, c in enumerate(["conv_id", "turn"]):
            made.insert(k, c, p[c].to_numpy())
        made.insert(3, "role", p["role"].to_numpy())
        return made

    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, seq bigint, role string, new_role string, action string, inserted array<string>, cost double, rendered string"
    return chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(place, schema)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))
