"""Repair of damaged conversations by iterative-deepening A*.

A conversation's rows, ordered by turn (nulls first; rows of one turn by role,
then text), are edited until their role initials read ``(s?(ua)+)?``:

=======  ====  =========================================================
edit     cost  meaning
=======  ====  =========================================================
Delete   2     the row goes; the only edit of a blank or repeated row
Insert   5     an empty user or assistant message comes before the row
Keep     0     the row stays
Rerole   1     the row becomes a user's or assistant's
=======  ====  =========================================================

A truncated row that stays adds 5.  Depth-first search tries the edits in that
(ASCII) order under a cost bound; a node is (rows consumed, last role).  What a
node's failure proved about the cost still ahead of it goes into a
transposition table, which starts from the cost no repair can avoid (2 for each
row that must go or is truncated, 1 for each strange role) and gives the next
bound.  The first accepting path under the first bound that has one is the
cheapest and the ASCII-least among the cheapest.

A long conversation is no long search and no long row: rows are sorted by range
and numbered, each stretch of ``SEGMENT`` of them is searched by itself for
every pair of last roles before and after it, and the stretches' costs are
joined in groups of ``FAN`` up a tree and decided down again.  An edit string
of given rows never starts another of the same rows (both end with the last
row's edit), so comparing stretch by stretch compares the whole strings.

Nulls read as one blank (in conv_id only for the damage; a null conv_id is a
conversation like any other); an empty text is blank; equal rows of one turn
are repeats of each other; a conversation without rows has an empty repair; an
empty table gives an empty result; columns beyond conv_id, turn, role and text
are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

SEGMENT, FAN = 128, 64
SIGN = r"[^\x20\x09-\x0D]"                 # a character that is no white space
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5
FAR = 1 << 50
START, S, U, A = range(4)                  # last role so far
NEXT = (U, U, A, U)                        # what may be inserted (or made of a row) after each
FOLLOWS = {"s": (S, None, None, None), "u": (U, U, None, U), "a": (None, None, A, None)}
NAME = {U: "user", A: "assistant"}
GONE = "-"                                 # code of a row that must go; others: initial, upper case if truncated


def least(code: str) -> int:
    """Cost that no edit of the row avoids."""
    if code == GONE or code.isupper():
        return DELETE
    return 0 if code in "sua" else REROLE


@lru_cache(maxsize=200_000)
def search(codes: str, entry: int, goal: int | None):
    """(cost, edits) of the cheapest way through the rows, or None where there is none.

    ``entry`` and ``goal`` are the last roles before and after; goal None means
    the conversation's end: an accepting one, messages may be put behind the
    last row.
    """
    n, last = len(codes), goal is None
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + least(codes[i])
    saved = DELETE if any(c in "sS" for c in codes) else FAR

    def unavoidable(i, s):
        if last or goal in (U, A):
            return ahead[i]
        if goal == s:                                  # from START to START, or S to S: every row goes
            return DELETE * (n - i)
        return max(0, DELETE * (n - i) - saved) if (s, goal) == (START, S) and saved < FAR else FAR

    proved: dict[int, int] = {}                        # transposition table: least cost still ahead, by node

    def bound_of(i, s):
        known = proved.get(i * 4 + s)
        return unavoidable(i, s) if known is None else known

    def moves(i, s):
        out = []
        if i < n:
            out.append(("D", i + 1, s, DELETE))
        if i < n or last:
            out.append(("I", i, NEXT[s], INSERT))
        if i < n and codes[i] != GONE:
            cut = TRUNCATED if codes[i].isupper() else 0
            after = FOLLOWS.get(codes[i].lower())
            if after and after[s] is not None:
                out.append(("K", i + 1, after[s], KEEP + cut))
            out.append(("R", i + 1, NEXT[s], REROLE + cut))
        return out

    while True:
        bound = bound_of(0, entry)
        if bound >= FAR:
            return None
        path = [(0, entry, bound, iter(moves(0, entry)))]
        edits: list[str] = []
        while path:
            i, s, budget, left = path[-1]
            if i == n and (s in (START, A) if last else s == goal):
                return bound - budget, "".join(edits)
            for edit, j, t, cost in left:
                if cost + bound_of(j, t) <= budget:
                    path.append((j, t, budget - cost, iter(moves(j, t))))
                    edits.append(edit)
                    break
            else:
                proved[i * 4 + s] = max(bound_of(i, s), min((c + bound_of(j, t) for _, j, t, c in moves(i, s)),
                                                            default=FAR))
                path.pop()
                if edits:
                    edits.pop()


def replay(codes: str, entry: int, edits: str):
    """What the edits do, row by row: roles put before it, then D, K, or the new role's initial."""
    out, now, s, i = [], "", entry, 0
    for e in edits:
        if e == "I":
            s = NEXT[s]
            now += "ua"[s - U]
            continue
        if e == "D":
            now += "D"
        elif e == "K":
            s = FOLLOWS[codes[i].lower()][s]
            now += "K"
        else:
            s = NEXT[s]
            now += "UA"[s - U]
        out.append(now)
        now, i = "", i + 1
    return out, now


# -- stretches of one conversation joined up and down a tree ------------------------------------

def table_of(codes: str, first: bool, last: bool):
    """cost[entry * 4 + exit] and edits of a stretch; a conversation's last one exits in slot 0."""
    costs, edits = [FAR] * 16, [None] * 16
    for entry in (START,) if first else range(4):
        for slot in (0,) if last else range(4):
            got = search(codes, entry, None if last else slot)
            if got:
                costs[entry * 4 + slot], edits[entry * 4 + slot] = got
    return costs, edits


def ranks(edits):
    """Order of the edit strings of each entry."""
    out = []
    for entry in range(4):
        own = edits[entry * 4:entry * 4 + 4]
        order = sorted(x for x in own if x is not None)
        out += [order.index(x) if x is not None else 9 for x in own]
    return out


def compose(a, b):
    """(costs, ranks) of two neighbours as one."""
    costs, keys = [FAR] * 16, [None] * 16
    for entry in range(4):
        for slot in range(4):
            ways = [(a[0][entry * 4 + m] + b[0][m * 4 + slot], a[1][entry * 4 + m], b[1][m * 4 + slot])
                    for m in range(4)]
            best = min(ways)
            if best[0] < FAR:
                costs[entry * 4 + slot], keys[entry * 4 + slot] = best[0], best[1:]
    return costs, ranks(keys)


def decide(parts, entry: int, slot: int):
    """(entry, exit) of each part on the best way from ``entry`` to the last part's ``slot``."""
    ahead = [[0 if s == slot else FAR for s in range(4)]]
    for costs, _ in reversed(parts):
        ahead.append([min(costs[s * 4 + t] + ahead[-1][t] for t in range(4)) for s in range(4)])
    out = []
    for (costs, rank), after in zip(parts, reversed(ahead[:-1])):
        t = min(range(4), key=lambda t: (costs[entry * 4 + t] + after[t], rank[entry * 4 + t]))
        out.append((entry, t))
        entry = t
    return out


SEARCHED = "conv string, seg long, node long, first long, codes string, costs array<long>, edits array<string>, ranks array<int>"


def _search(batches):
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            costs, edits = table_of(r.codes, r.is_first, r.is_last)
            rows.append((r.conv, r.seg, r.node, r.first, r.codes, costs, edits, ranks(edits)))
        yield pd.DataFrame(rows, columns=["conv", "seg", "node", "first", "codes", "costs", "edits", "ranks"])


def _parts(pdf):
    return [(list(c), list(r)) for c, r in zip(pdf["costs"], pdf["ranks"])]


def _up(key, pdf):
    pdf = pdf.sort_values("node")
    total, *rest = _parts(pdf)
    for p in rest:
        total = compose(total, p)
    return pd.DataFrame([(key[0], key[1], *total)], columns=["conv", "node", "costs", "ranks"])


def _down(key, pdf):
    pdf = pdf.sort_values("node")
    ways = decide(_parts(pdf), int(pdf["entry"].iloc[0]), int(pdf["slot"].iloc[0]))
    return pd.DataFrame([(key[0], n, *w) for n, w in zip(pdf["node"], ways)], columns=["conv", "node", "entry", "slot"])


def _ways(found: DataFrame, reach: int) -> DataFrame:
    """conv, node, entry and slot of every stretch of the conversations that have several."""
    levels, up = [found.select("conv", "node", "costs", "ranks")], 1
    while up <= reach:
        grouped = levels[-1].withColumn("over", F.expr(f"node div {FAN}"))
        levels.append(store(grouped.groupBy("conv", "over").applyInPandas(
            _up, "conv string, node long, costs array<long>, ranks array<int>"), "repair_up"))
        up *= FAN
    way = levels[-1].select("conv", "node", F.lit(START).alias("entry"), F.lit(0).alias("slot"))
    for below in reversed(levels[:-1]):
        above = way.select(F.col("conv").alias("c"), F.col("node").alias("over"), "entry", "slot")
        both = below.withColumn("over", F.expr(f"node div {FAN}"))
        both = both.join(above.withColumnRenamed("over", "o"), (F.col("conv") == F.col("c")) & (F.col("over") == F.col("o")))
        way = store(both.groupBy("conv", "over").applyInPandas(
            _down, "conv string, node long, entry int, slot int"), "repair_down")
    return way


TOLD = "conv string, seg long, first long, cost long, audit string, ops array<string>, tail string"


def _tell(batches):
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            at = r.entry * 4 + r.slot
            ops, tail = replay(r.codes, r.entry, r.edits[at])
            rows.append((r.conv, r.seg, r.first, r.costs[at], r.edits[at], ops, tail))
        yield pd.DataFrame(rows, columns=["conv", "seg", "first", "cost", "audit", "ops", "tail"])


# -- rows, faults and stretches ---------------------------------------------------------------

def _named(turns: DataFrame) -> DataFrame:
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))


def damage(turns: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given to the user, by crc32(conv_id:turn) modulo 20."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = _named(turns).withColumn("rest", F.crc32(F.concat_ws(":", *part).cast("binary")) % 20)
    rows = rows.filter("rest <> 0").withColumn("copy", F.expr("explode(sequence(1, if(rest = 3, 2, 1)))"))
    return rows.select("conv_id", "turn", F.expr("if(rest = 4, 'user', role)").alias("role"),
                       F.expr(r"CASE rest WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, r'[.!?]', '') ELSE text END")
                       .alias("text"))


def ordered_rows(turns: DataFrame) -> DataFrame:
    """The rows in order with a dense place in their part (``pos``), their code and their fault; stored."""
    rows = _named(turns).withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")))
    by_range = ["conv", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64)]
    spread = by_range + [F.xxhash64("text"), F.rand(7)]            # equal rows may lie in either part
    rows = rows.repartitionByRange(*spread).sortWithinPartitions(*by_range, "text")
    seen = F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", "")
    rows = rows.withColumn("blank", ~F.col("text").rlike(SIGN)).withColumn("cut", ~seen.rlike(r"[.!?]\z"))
    rows = store(rows.select(F.monotonically_increasing_id().alias("pos"), "conv", "conv_id", "turn", "role", "text",
                             "blank", "cut"), "repair_rows")
    new = (rows.filter("NOT blank").groupBy("conv", "role", F.md5("text").alias("h"))
           .agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new")))
    slim = rows.select("pos", "conv", "conv_id", "turn", F.substring("role", 1, 1).alias("i"), "blank", "cut")
    slim = slim.join(new, "pos", "left").withColumn("twice", F.col("new").isNull() & ~F.col("blank"))
    slim = slim.withColumn("i", F.expr("if(i IN ('s', 'u', 'a'), i, 'x')"))
    code = F.expr(f"CASE WHEN blank OR twice THEN '{GONE}' WHEN cut THEN upper(i) ELSE i END")
    return rows, store(slim.select("pos", "conv", "conv_id", "turn", "i", code.alias("code"), "blank", "twice",
                                   F.expr("cut AND NOT blank AND NOT twice").alias("truncated")), "repair_codes")


def repair(turns: DataFrame, segment: int = SEGMENT):
    """(edits per stretch, rows, codes): the searched conversations, before anything is rendered."""
    rows, slim = ordered_rows(turns)
    part = 1 << 33                                     # pos: part * 2^33 + place in the part
    slim_seg = slim.withColumn("seg", F.expr(f"pos div {segment}"))
    row = F.array_sort(F.collect_list(F.struct("pos", "code")))    # at most ``segment`` rows
    segs = (slim_seg.groupBy("conv", "seg").agg(row.alias("r"))
            .select("conv", "seg", F.col("r")[0]["pos"].alias("first"),
                    F.array_join(F.transform("r", lambda x: x["code"]), "").alias("codes")))
    ends = segs.groupBy("conv").agg(F.min("seg").alias("lo"), F.max("seg").alias("hi"))
    per = part // segment
    most = slim.agg((F.max(F.col("pos") % part) / segment).cast("long") + 1).first()[0] or 1     # one number
    # dense numbers along a conversation: parts apart, then stretches inside the part
    node = F.expr(f"((seg div {per}) - (lo div {per})) * {most} + seg % {per} - lo % {per}")
    segs = segs.join(ends, "conv").select("conv", "seg", "first", "codes", node.alias("node"),
                                          (F.col("seg") == F.col("lo")).alias("is_first"),
                                          (F.col("seg") == F.col("hi")).alias("is_last"))
    found = store(segs.mapInPandas(_search, SEARCHED), "repair_found")
    split = found.groupBy("conv").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    split = split.filter("n > 1").select("conv", "lo", "hi")
    reach = split.agg(F.max(F.col("hi") - F.col("lo"))).first()[0]
    alone = found.withColumn("entry", F.lit(START)).withColumn("slot", F.lit(0))
    if reach is not None:
        several = found.join(split, "conv").withColumn("node", F.col("node") - F.col("lo")).drop("lo", "hi")
        alone = alone.join(split.select("conv"), "conv", "left_anti")
        way = _ways(several, reach)
        alone = alone.unionByName(several.join(way, ["conv", "node"]).select(alone.columns))
    told = store(alone.mapInPandas(_tell, TOLD), "repair_told")
    return told, rows, slim


def messages(told: DataFrame, rows: DataFrame) -> DataFrame:
    """conv, pos, and the messages (role, text) that each row became, in order: none where it went."""
    put = "transform(filter(split({0}, ''), c -> c <> ''), c -> struct(if(c = 'u', 'user', 'assistant') AS role, '' AS text))"
    one = told.select("conv", F.posexplode(
        F.expr("transform(ops, (o, k) -> struct(o, if(k = size(ops) - 1, tail, '') AS tail))")).alias("k", "x"),
        "first").select((F.col("first") + F.col("k")).alias("pos"), F.col("x.o").alias("op"), "x.tail")
    one = rows.join(one, "pos").withColumn("act", F.expr("right(op, 1)"))
    own = ("CASE act WHEN 'D' THEN array() WHEN 'K' THEN array(struct(role, text)) "
           "WHEN 'U' THEN array(struct('user' AS role, text)) ELSE array(struct('assistant' AS role, text)) END")
    return one.select("conv", "conv_id", "pos", "turn", F.expr(
        f"concat({put.format('left(op, length(op) - 1)')}, {own}, {put.format('tail')})").alias("messages"))


def _digest(batches):
    """SHA-256 of each conversation's lines, which arrive in order; nothing is kept but the running hash."""
    conv, h, empty = None, None, True

    def told():
        return pa.RecordBatch.from_pydict({"conv": [conv], "repaired_sha256": [h.hexdigest()]},
                                          schema=pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())]))

    for batch in batches:
        for c, lines in zip(batch.column("conv").to_pylist(), batch.column("lines").to_pylist()):
            if c != conv:
                if h is not None:
                    yield told()
                conv, h, empty = c, hashlib.sha256(), True
            if lines is not None:
                h.update((lines if empty else "\n" + lines).encode("utf-8"))
                empty = False
    if h is not None:
        yield told()


def report(turns: DataFrame, original: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """One row per conversation of ``original`` (default: of ``turns``): faults, cost, edits, digest.

    The digest is one running hash per conversation, so a conversation's lines
    pass one task in order; only the hash is held.
    """
    told, rows, slim = repair(turns, segment)
    n = lambda c: F.sum(F.col(c).cast("long"))
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    stats = slim.groupBy("conv").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), n("blank").alias("blank"),
                                     n("twice").alias("duplicate"), n("truncated").alias("truncated"))
    initials = (slim.withColumn("seg", F.expr(f"pos div {segment}")).groupBy("conv", "seg")
                .agg(F.array_sort(F.collect_list(F.struct("pos", "i"))).alias("r"))
                .select("conv", "seg", F.array_join(F.transform("r", lambda x: x["i"]), "").alias("i")))
    edits = (told.join(initials, ["conv", "seg"]).groupBy("conv")
             .agg(F.sum("cost").alias("cost"), F.array_sort(F.collect_list(F.struct("seg", "audit", "i"))).alias("r"))
             .select("conv", "cost", F.array_join(F.transform("r", lambda x: x["audit"]), "").alias("audit"),
                     F.array_join(F.transform("r", lambda x: x["i"]), "").alias("i")))
    edits = edits.withColumn("illegal", F.expr("length(i) - 1 - regexp_count(i, r'(?=su|ua|au).')").cast("long"))
    lines = F.expr("if(size(messages) = 0, NULL, array_join(transform(messages, m -> concat(m.role, ':', m.text)), '\n'))")
    text = (messages(told, rows).select("conv", "pos", lines.alias("lines")).repartition("conv")
            .sortWithinPartitions("conv", "pos").select("conv", "lines")
            .mapInArrow(_digest, "conv string, repaired_sha256 string"))
    every = (turns if original is None else original).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    every = every.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")))
    out = every.join(stats, "conv", "left").join(edits, "conv", "left").join(text, "conv", "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c)
                                   for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def damaged_report(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The report on the conversations after ``damage``."""
    return report(damage(turns), turns, segment)
