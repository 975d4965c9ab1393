import hashlib
import math
import random

import numpy as np

from gtspark.llm import codes as C

COLS = "vec_id long, embedding array<float>, label int"


def vectors(seed=1, n=700, width=16, clusters=12):
    rng = random.Random(seed)
    centre = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(clusters)]
    rows = []
    for i in range(n):
        c = rng.choice(centre)
        s = rng.choice([0.0, 0.0, 0.001, 0.05, 0.4])
        rows.append((i, [float(np.float32(x + rng.gauss(0, s))) for x in c], rng.choice([None, 0, 0, 0, 1, 2])))
    rows += [(n, None, 1), (n + 1, [float("nan")] * width, 1), (n + 2, [float("inf")] * width, 1),
             (n + 3, [None] + [0.0] * (width - 1), 1), (n + 4, [0.0] * width, None), (5, [0.25] * width, 7),
             (None, [1.0] * width, 7)]
    rng.shuffle(rows)
    return rows


def brute(rows):
    """Plain Lloyd rounds on Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in kept), default=0)
    kept = [(i, v + [0] * (width - len(v)), lab) for i, v, lab in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    cut = [width * p // 4 for p in range(5)]
    part = lambda v, p: v[cut[p]:cut[p + 1]]
    books = [[part(v, p) for _, v, _ in first] for p in range(4)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(4):
        for p in range(4):
            members = {}
            for _, v, _ in kept:
                members.setdefault(nearest(part(v, p), books[p])[1], []).append(part(v, p))
            books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k])] if k in members else e
                        for k, e in enumerate(books[p])]
    out, total = [], {}
    for i, v, lab in kept:
        got = [nearest(part(v, p), books[p]) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), lab))
        total[lab] = total.get(lab, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, total[lab], digest) for i, c, e, lab in out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_tree_is_a_cover_tree():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(-900, 900, (300, 4)), np.repeat(rng.integers(-900, 900, (5, 4)), 60, axis=0),
                             rng.integers(0, 12, (300, 4))])
    t = C._unpack(C._pack(C.Tree.build(points)))
    assert sorted(t.order) == list(range(len(points)))
    for k in range(len(t.start)):
        own = points[t.order[t.start[k]:t.end[k]]]
        assert np.sqrt(((own - own[0]) ** 2).sum(1)).max(initial=0) <= t.radius[k] + 1e-9
        if t.children[k]:
            kids = range(t.child[k], t.child[k] + t.children[k])
            assert t.start[kids[0]] == t.start[k] and t.end[kids[-1]] == t.end[k]
            assert all(t.end[a] == t.start[a + 1] for a in list(kids)[:-1])


def test_assign_equals_argmin_with_ties_and_decides_whole_subtrees():
    rng = np.random.default_rng(4)
    for scale in (3, 900, 1 << 24):
        centre = rng.integers(-scale, scale + 1, (20, 5))
        points = np.concatenate([centre[rng.integers(0, 20, 500)] + rng.integers(-1, 2, (500, 5)), np.repeat(centre[:2], 200, 0)])
        book = np.concatenate([centre, centre[:3], rng.integers(-scale, scale + 1, (30, 5))])
        t = C.Tree.build(points)
        entry, counts, sums = t.assign(points, book)
        exact = ((points[t.order][:, None, :] - book[None]) ** 2).sum(2).argmin(1)
        assert (entry == exact).all()
        for e in range(len(book)):
            assert counts[e] == (exact == e).sum() and (sums[e] == points[t.order][exact == e].sum(0)).all()


def test_report_equals_plain_lloyd(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 64)
    rows = vectors()
    df = spark.createDataFrame(rows, COLS).repartition(4).selectExpr("*", "1 AS code", "2 AS error", "3 AS v")
    assert got(C.report(df)) == brute(rows)


def test_few_short_and_odd_vectors(spark):
    rows = [(1, [0.5, 0.25, 0.125], 1), (2, [0.5], 1), (2, [], None), (3, [0.1, -0.1, 0.3, 2.0, 9.0, 0.0], None)]
    assert got(C.report(spark.createDataFrame(rows, COLS))) == brute(rows)
    assert got(C.report(spark.createDataFrame([(1, [], 1), (2, [], 1)], COLS))) == brute([(1, [], 1), (2, [], 1)])


def test_all_equal_and_empty(spark):
    rows = [(i, [0.5] * 8, 0) for i in range(600)]
    assert got(C.report(spark.createDataFrame(rows, COLS))) == brute(rows)
    assert C.report(spark.createDataFrame([], COLS)).count() == 0
    assert C.report(spark.createDataFrame([(1, None, 1)], COLS)).count() == 0


def test_huge_components_are_clamped(spark):
    rows = [(1, [1e30, -1e30, 0.0, 1.0], 1), (2, [3.0, 1.0, 0.0, 1.0], 1)]
    out = got(C.report(spark.createDataFrame(rows, COLS)))
    assert [r[0] for r in out] == [1, 2] and all(r[2] == 0 for r in out)
