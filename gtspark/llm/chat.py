"""Chat formatting with a minimum-cost repair of the roles.

Legal sequences are: at most one system message first, then user and
assistant in turn, the assistant last.  Each turn is kept, merged into the
message before (same role), relabelled, or preceded by one inserted empty
message; a conversation may also end with inserted ones.  Dynamic programming
over the states (last role: none, system, user, assistant) finds the cheapest
repair.  Ties go to the first of keep, merge, relabel, insert, then to the
smaller state.

A step is a 4 x 4 matrix under (min, +), so a conversation of any length is
split: turns are sorted by range (conversation, turn, role, text hash) into
parts of about ``PART_ROWS`` rows, each part multiplies the matrices of its
first and last conversation, the driver joins these at most two rows per part,
and every part then backtracks alone between its known end states.

The result has one row per turn.  ``rendered`` closes the message before,
adds inserted messages, opens the turn's own message if it is not merged, and
after a conversation's last turn closes what is open, so the rendered
conversation is the concatenation in order of ``position``.

Roles are matched without case and surrounding white space through ``ROLES``;
any other or null role must be relabelled or merged.  A null text is empty; a
null conv_id is a conversation like any other; a null turn comes first; rows
that repeat a turn are turns of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

PART_ROWS = 20_000
NAMES = ("", "system", "user", "assistant")
ROLES = {"system": 1, "developer": 1, "user": 2, "human": 2, "assistant": 3, "gpt": 3, "model": 3, "bot": 3}
LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
MERGE, INSERT, RELABEL, UNKNOWN = 1, 2, 3, 2         # UNKNOWN: merge or relabel of a role that is none of the three
ACTIONS = ("keep", "merge", "relabel", "insert")
END = (0, 2 * INSERT, INSERT, 0)                     # cost of ending in each state
FAR = 1 << 40


def moves(role: int):
    """{(state, next state): (cost, action, inserted roles)} of one turn."""
    best: dict = {}

    def offer(s, t, cost, action, inserted=()):
        if (s, t) not in best or (cost, action) < best[s, t][:2]:
            best[s, t] = (cost, action, inserted)

    for s, after in LEGAL.items():
        for t in after:
            if t == role:
                offer(s, t, 0, 0)
            else:
                offer(s, t, RELABEL if role else UNKNOWN, 2)
            if role in LEGAL[t]:
                offer(s, role, INSERT, 3, (t,))
        if s and s == role:
            offer(s, s, MERGE, 1)
        if s and not role:
            offer(s, s, UNKNOWN, 1)
    return best


MOVES = [moves(r) for r in range(4)]
MATRIX = np.full((4, 4, 4), FAR, np.int64)
for _r, _m in enumerate(MOVES):
    for (_s, _t), _v in _m.items():
        MATRIX[_r, _s, _t] = _v[0]


def role_code(role) -> int:
    return ROLES.get(role.strip().lower(), 0) if isinstance(role, str) else 0


def product(codes) -> np.ndarray:
    """(min, +) product of the turns' matrices."""
    out = np.where(np.eye(4, dtype=bool), 0, FAR)
    for c in codes:
        out = np.minimum((out[:, :, None] + MATRIX[c][None]).min(1), FAR)
    return out


def path(codes, entry: int, end: int | None):
    """States after each turn on the cheapest way from ``entry`` (to ``end``, or to any legal end)."""
    cost = np.full(4, FAR, np.int64)
    cost[entry] = 0
    back = []
    for c in codes:
        way = cost[:, None] + MATRIX[c]
        rank = np.full((4, 4), 9)
        for (s, t), v in MOVES[c].items():
            rank[s, t] = v[1]
        from_ = np.array([min(range(4), key=lambda s: (way[s, t], rank[s, t], s)) for t in range(4)])
        cost = np.minimum(way[from_, np.arange(4)], FAR)
        back.append(from_)
    state = end if end is not None else int(np.argmin(cost + np.array(END)))
    states = []
    for from_ in reversed(back):
        states.append(state)
        state = int(from_[state])
    return states[::-1]


def join_parts(rows) -> dict:
    """{(part, which): (entry, end or None, position, is last)} from the parts' summaries.

    ``rows``: (part, which, conv, n, matrix) in order; ``which`` is 0 for a
    part's first conversation and 1 for its last, if that is another one.
    """
    out, chain = {}, []

    def settle():
        costs = [np.array([0, FAR, FAR, FAR])]
        for *_, m in chain:
            costs.append(np.minimum((costs[-1][:, None] + m).min(0), FAR))
        state = int(np.argmin(costs[-1] + np.array(END)))
        ends = []
        for (*_, m), before in zip(reversed(chain), reversed(costs[:-1])):
            ends.append(state)
            state = int(np.argmin(before + m[:, state]))
        ends.reverse()
        at, entry = 0, 0
        for i, ((part, which, _, n, _), end) in enumerate(zip(chain, ends)):
            out[part, which] = (entry, end, at, i == len(chain) - 1)
            at, entry = at + n, end

    for r in rows:
        if chain and (r[2] != chain[-1][2] or r[0] == chain[-1][0]):
            settle()
            chain = []
        chain.append(r)
    if chain:
        settle()
    return out


def message(role: int, text: str = "") -> str:
    return f"<|im_start|>{NAMES[role]}\n{text}"


CLOSE = "<|im_end|>\n"


def render(codes, texts, states, entry: int, last: bool):
    """(role, action, rendered) of each turn."""
    out, s = [], entry
    for i, (c, text, t) in enumerate(zip(codes, texts, states)):
        _, action, inserted = MOVES[c][s, t]
        if action == 1:
            own = "\n" + text
        else:
            own = (CLOSE if s else "") + "".join(message(r) + CLOSE for r in inserted) + message(t, text)
        if last and i == len(codes) - 1:
            tail = {1: (2, 3), 2: (3,), 3: ()}[t]
            own += CLOSE + "".join(message(r) + CLOSE for r in tail)
        out.append((NAMES[t], ACTIONS[action], own))
        s = t
    return out


def _runs(pdf):
    """Start and end of each conversation in a part, in stored order."""
    conv = pdf["conv"].to_numpy()
    cut = np.flatnonzero(conv[1:] != conv[:-1]) + 1
    return list(zip([0, *cut], [*cut, len(conv)]))


def _summary(pdf):
    pdf = pdf.sort_values("ord", ignore_index=True)
    runs = _runs(pdf)
    rows = []
    for which, (a, b) in enumerate(runs[:1] + runs[-1:][:len(runs) - 1]):
        m = product(map(role_code, pdf["role"][a:b]))
        rows.append((pdf["part"][0], which, pdf["conv"][a], b - a, m.ravel().tolist()))
    return pd.DataFrame(rows, columns=["part", "which", "conv", "n", "m"])


RESULT = "conv_id long, turn long, position long, role string, action string, rendered string"


def _repair(shared):
    def run(pdf):
        pdf = pdf.sort_values("ord", ignore_index=True)
        part, runs, out = pdf["part"][0], _runs(pdf), []
        for i, (a, b) in enumerate(runs):
            which = 0 if i == 0 else 1 if i == len(runs) - 1 else None
            entry, end, at, last = shared.value[part, which] if which is not None else (0, None, 0, True)
            codes = [role_code(r) for r in pdf["role"][a:b]]
            texts = [t if isinstance(t, str) else "" for t in pdf["text"][a:b]]
            out += [(at + j, *x) for j, x in enumerate(render(codes, texts, path(codes, entry, end), entry, last))]
        new = pd.DataFrame(out, columns=["position", "role", "action", "rendered"])
        ids = {c: pdf[c].astype("Int64") for c in ("conv_id", "turn")}
        return pd.DataFrame(ids).join(new)
    return run


def format_chats(turns: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """conv_id, turn, position, role, action and rendered text of every turn."""
    spark = turns.sparkSession
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                     F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    t = t.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")))
    t = t.withColumn("__h", F.xxhash64("text")).withColumn("__u", F.monotonically_increasing_id())
    parts = max(1, -(-t.count() // part_rows))
    keys = ["conv", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "__h", "__u"]
    t = t.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    t = store(t.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("ord"),
                       "conv", "conv_id", "turn", "role", "text"), "turns")
    ends = (t.select("part", "ord", "conv", "role").groupBy("part")
            .applyInPandas(_summary, "part int, which int, conv string, n long, m array<long>").collect())
    rows = [(r["part"], r["which"], r["conv"], r["n"], np.array(r["m"], np.int64).reshape(4, 4))
            for r in sorted(ends, key=lambda r: (r["part"], r["which"]))]
    shared = spark.sparkContext.broadcast(join_parts(rows))          # at most two rows a part
    return t.groupBy("part").applyInPandas(_repair(shared), RESULT)
