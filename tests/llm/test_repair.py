import hashlib
import heapq
import itertools
import random
import re
import zlib

from gtspark.llm import repair as R

COLS = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"
ACCEPT = re.compile(r"(s?(ua)+)?")


def brute_edits(rows):
    """Uniform-cost search over whole edit strings: (cost, audit, repaired lines)."""
    seen, kinds = set(), []
    for role, text in rows:
        body = text.rstrip(BLANKS)
        kind = "blank" if not body else "dup" if (role, text) in seen else "cut" if body[-1] not in ".!?" else "ok"
        seen.add((role, text))
        kinds.append(kind)
    heap, best = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, i, shape, lines = heapq.heappop(heap)
        if i == len(rows) and ACCEPT.fullmatch(shape):
            return kinds, cost, audit, list(lines)
        state = (i, shape[-1:], len(shape) > 1)
        if state in best and best[state] < (cost, audit):
            continue
        best[state] = (cost, audit)

        def step(c, a, j, role, line):
            new = shape + (role[:1] if line is not None else "")
            if line is None or re.fullmatch(r"s|s?(ua)*u?", new):
                heapq.heappush(heap, (cost + c, audit + a, j, new, lines + ((line,) if line is not None else ())))

        for role in ("user", "assistant"):
            step(5, "I", i, role, f"{role}:")
        if i < len(rows):
            role, text = rows[i]
            step(2, "D", i + 1, "", None)
            if kinds[i] in ("ok", "cut"):
                add = 5 * (kinds[i] == "cut")
                if role[:1] in ("s", "u", "a"):
                    step(add, "K", i + 1, role, f"{role}:{text}")
                for new in ("user", "assistant"):
                    step(1 + add, "R", i + 1, new, f"{new}:{text}")


def brute(rows):
    """Report of every conversation of (conv_id, turn, role, text) rows, as the contract words it."""
    after = {}
    for conv, turn, role, text in rows:
        after.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        rest = zlib.crc32(key.encode()) % 20
        text = "" if rest == 1 else re.sub("[.!?]", "", text) if rest == 2 else text
        role = "user" if rest == 4 else role
        after[conv] += [(turn, role, text)] * (0 if rest == 0 else 2 if rest == 3 else 1)
    out = {}
    for conv, own in after.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        kinds, cost, audit, lines = brute_edits([r[1:] for r in own])
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((x[1][:1] + y[1][:1]) not in ("su", "ua", "au") for x, y in zip(own, own[1:]))
        out[conv] = (gaps, kinds.count("blank"), kinds.count("dup"), kinds.count("cut"), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def conversations(seed=5, n=60, longest=9):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "Well. \n", "", " \t", None, "é日本.", "end.x", "a" * 300 + "."]
    rows = []
    for conv in range(n):
        role = itertools.cycle(["user", "assistant"])
        if conv % 3 == 0:
            rows.append((conv, 0, "system", "Be kind."))
        for turn in range(1, rng.randrange(2, longest)):
            r = next(role) if rng.random() < 0.85 else rng.choice(["system", "user", "assistant", "tool", "", None, "User"])
            t = f"Line {turn}." if rng.random() < 0.6 else rng.choice(texts)
            rows.append((conv, turn if rng.random() < 0.95 else None, r, t))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (900, None, "user", "x"), (900, None, "user", "x"),
             (901, None, None, None)]
    return rows


def test_search_equals_uniform_cost_search():
    rng = random.Random(2)
    text = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    for _ in range(400):
        codes = "".join(rng.choice("suauauauaxSUAX-") for _ in range(rng.randrange(0, 8)))
        rows = [(text[c.lower()], f"t{i}" + ("" if c.isupper() else ".")) if c != "-" else ("user", "")
                for i, c in enumerate(codes)]
        _, cost, audit, lines = brute_edits(rows)
        assert R.search(codes, R.START, None) == (cost, audit), codes
        ops, tail = R.replay(codes, R.START, audit)
        assert len(ops) == len(codes) and len(lines) == sum(len(o) - o.endswith("D") for o in ops) + len(tail)


def test_stretches_joined_equal_one_search():
    rng = random.Random(3)
    for _ in range(150):
        codes = "".join(rng.choice("suauauauaxUA--") for _ in range(rng.randrange(3, 16)))
        size = rng.randrange(1, 5)
        cuts = [codes[i:i + size] for i in range(0, len(codes), size)]
        tables = [R.table_of(c, i == 0, i == len(cuts) - 1) for i, c in enumerate(cuts)]
        parts = [(c, R.ranks(e)) for c, e in tables]
        want = R.search(codes, R.START, None)
        ways = R.decide(parts, R.START, 0)
        assert "".join(e[a * 4 + b] for (_, e), (a, b) in zip(tables, ways)) == want[1]
        half = len(parts) // 2
        if half:
            total = [parts[0]]
            two = []
            for group in (parts[:half], parts[half:]):
                total = group[0]
                for p in group[1:]:
                    total = R.compose(total, p)
                two.append(total)
            upper = R.decide(two, R.START, 0)
            assert sum(two[i][0][a * 4 + b] for i, (a, b) in enumerate(upper)) == want[0]
            assert R.decide(parts[:half], *upper[0]) + R.decide(parts[half:], *upper[1]) == ways


def test_long_stretch_is_quick():
    rng = random.Random(4)
    codes = "".join(rng.choice("-UAxuauauauauauau") for _ in range(128))
    assert R.search(codes, R.START, None)[0] > 0
    R.table_of(codes, False, False)


def test_report_equals_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, COLS).repartition(5)
    want = brute(rows)
    assert got(R.damaged_report(df)) == want
    assert got(R.damaged_report(df.selectExpr("*", "'x' AS pos", "1 AS seg", "2 AS conv"), segment=4)) == want


def test_long_conversation_over_many_parts_and_levels(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"T{rng.randrange(60)}" + rng.choice([".", ".", "!", ""]))
            for t in range(300)]
    rows += [(2, None, "user", "same")] * 40 + [(3, 7, "system", "A."), (3, 9, "user", "B."), (3, 9, "assistant", "C.")]
    monkeypatch.setattr(R, "FAN", 4)
    df = spark.createDataFrame(rows, COLS).repartition(3)
    assert got(R.damaged_report(df, segment=8)) == brute(rows)


def test_empty_tables(spark):
    assert got(R.damaged_report(spark.createDataFrame([], COLS))) == {}
    gone = [(c, t, "user", "x.") for c in range(40) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:2]
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in gone}
    assert got(R.damaged_report(spark.createDataFrame(gone, COLS))) == want


def test_messages_are_the_repaired_conversation(spark):
    rows = [(1, 0, "system", "A."), (1, 1, "assistant", "B."), (1, 2, "assistant", "C."), (1, 3, "user", "D.")]
    told, stored, _ = R.repair(spark.createDataFrame(rows, COLS))
    text = [(m["role"], m["text"]) for r in R.messages(told, stored).orderBy("pos").collect() for m in r["messages"]]
    assert "".join(r[0] for r, _ in text) in ("sua", "suaua", "ua") and all(t in ("A.", "B.", "C.", "D.", "") for _, t in text)
