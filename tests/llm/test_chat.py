import itertools
import random
import re

import numpy as np
from helpers import words

from gtspark.llm import chat as C

TURNS = "conv_id long, turn long, role string, text string"
LEGAL = re.compile("(1?(23)+)?")


def brute(codes):
    """Cheapest repair cost by trying everything."""
    best = 10**9
    for plan in itertools.product(range(-1, 8), repeat=len(codes)):   # -1 merge, role 1-3, or role 1-3 after 1-3
        seq, cost = "", 0
        for c, p in zip(codes, plan):
            if p == -1:
                if not seq or (c and int(seq[-1]) != c):
                    cost = 10**9
                    break
                cost += C.MERGE if c else C.UNKNOWN
            elif 1 <= p <= 3:
                cost += 0 if p == c else (C.RELABEL if c else C.UNKNOWN)
                seq += str(p)
            elif 4 <= p <= 6 and c:
                cost += C.INSERT
                seq += str(p - 3) + str(c)
            else:
                cost = 10**9
                break
        for tail, extra in (("", 0), ("3", C.INSERT), ("23", 2 * C.INSERT)):
            if cost < 10**9 and LEGAL.fullmatch(seq + tail):
                best = min(best, cost + extra)
    return best


def cost_of(codes, states):
    s, total = 0, 0
    for c, t in zip(codes, states):
        total, s = total + C.MOVES[c][s, t][0], t
    return total + C.END[s]


def test_path_is_cheapest():
    for n in range(1, 5):
        for codes in itertools.product(range(4), repeat=n):
            want = brute(codes)
            assert cost_of(codes, C.path(codes, 0, None)) == want
            assert int((C.product(codes)[0] + np.array(C.END)).min()) == want


def parse(text):
    got = re.findall(r"<\|im_start\|>(system|user|assistant)\n(.*?)<\|im_end\|>\n", text, re.S)
    assert "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in got) == text
    return got


def sample():
    rng, rows = random.Random(5), []
    kinds = ["system", "user", "assistant", "User ", "GPT", "human", "tool", None, ""]
    for c in range(40):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(kinds), " ".join(words(rng, 3))))
    rows += [(777, t, rng.choice(kinds[:3]), f"hot {t}") for t in range(150)]       # one long conversation
    rows += [(888, 0, "user", "same")] * 40 + [(None, 0, "user", None), (None, None, "assistant", ""), (999, 3, "system", "x" * 50_000)]
    rng.shuffle(rows)
    return rows


def check(spark, rows, part_rows):
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as part", "'z' as ord", "2 as conv").repartition(4)
    got = C.format_chats(df, part_rows).collect()
    assert len(got) == len(rows)
    by, src = {}, {}
    for r in got:
        by.setdefault(r.conv_id, []).append(r)
    for r in rows:
        src.setdefault(r[0], []).append(r)
    total = 0
    for conv, own in by.items():
        own.sort(key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own)))
        assert [r.turn for r in own] == sorted((r[1] for r in src[conv]), key=lambda t: (t is not None, t or 0))
        seq = parse("".join(r.rendered for r in own))
        assert LEGAL.fullmatch("".join(str(C.NAMES.index(r)) for r, _ in seq)) and seq
        said = sorted((r[3] or "") for r in src[conv] if r[3])
        assert sorted(x for _, t in seq for x in t.split("\n") if x) == said
        inserted = len(seq) - sum(r.action != "merge" for r in own)
        total += inserted
    return got, total


def test_splitting_changes_nothing_but_place(spark):
    rows = sample()
    whole, a = check(spark, rows, 10**6)
    parts, b = check(spark, rows, 7)
    key = lambda r: (str(r.conv_id), r.position)
    states = {}
    for got in (whole, parts):
        own = {}
        for r in sorted(got, key=key):
            own.setdefault(r.conv_id, []).append(r)
        states[id(got)] = {c: (len(x), sum({"keep": 0, "merge": C.MERGE, "relabel": C.RELABEL, "insert": C.INSERT}[r.action]
                                           for r in x)) for c, x in own.items()}
    legal = {r[0] for r in rows if r[0] == 777}
    assert {c: states[id(whole)][c] for c in legal} == {c: states[id(parts)][c] for c in legal}


def test_empty_table(spark):
    assert C.format_chats(spark.createDataFrame([], TURNS)).count() == 0
