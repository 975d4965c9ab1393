import numpy as np
import pytest
from helpers import smallest

from gtspark.llm import graph_dedup as G

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.9):
    """(n_links, component_id) of each row, in order."""
    ok = []
    for k, (i, v) in enumerate(rows):
        x = np.array([np.nan if c is None else c for c in v or []], float)
        if i is not None and len(x) and np.isfinite(x).all() and x.any():
            ok.append((k, x))
    common = max({len(x) for _, x in ok}, key=lambda d: (sum(len(x) == d for _, x in ok), -d), default=0)
    ok = [(k, x / np.linalg.norm(x)) for k, x in ok if len(x) == common]
    n, links = [0] * len(rows), []
    for a, (k, x) in enumerate(ok):
        for j, y in ok[:a]:
            if x @ y >= threshold:
                n[k] += 1
                n[j] += 1
                links.append((k, j))
    comp = smallest(range(len(rows)), links)
    low = {}
    for k, c in comp.items():
        if rows[k][0] is not None:
            low[c] = min(low.get(c, rows[k][0]), rows[k][0])
    return [(i, n[k], low[comp[k]] if i is not None else None) for k, (i, _) in enumerate(rows)]


def sample(n=600, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    rows = [(i, (centres[rng.integers(40)] + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.25, 2.0])).tolist())
            for i in range(n)]
    hot = rng.normal(size=dim)
    rows += [(n + i, (hot + rng.normal(size=dim) * 0.05).tolist()) for i in range(n // 2)]      # a third
    step = rng.normal(size=dim)
    for i in range(30):                                   # a chain
        step = step + rng.normal(size=dim) * 0.25
        rows.append((2 * n + i, step.tolist()))
    odd = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1),
           [1.0, 2.0], [1e30] * dim, [1e-30] * dim, rows[0][1], rows[0][1]]
    rows += [(3 * n + i, v) for i, v in enumerate(odd)]
    return rows + [(None, rows[0][1]), (5, rows[9][1]), rows[3]]


@pytest.mark.parametrize("params", [{}, {"shard": 60, "block": 50}])
def test_matches_brute_force(spark, params):
    rows = sample()
    as_float = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).selectExpr("*", "1 as key", "'x' as v", "2 as m")
    got = G.near_duplicates(df.repartition(3), **params).collect()
    want = brute(as_float)
    assert len(got) == len(rows)
    total, found = sum(n for _, n, _ in want), sum(r.n_links for r in got)
    assert 0.98 * total <= found <= total
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    if found == total:
        assert sorted(map(str, ((r.vec_id, r.n_links, r.component_id) for r in got))) == sorted(map(str, want))


def test_audit_and_empty_table(spark):
    df = spark.createDataFrame([(i, v, 0) for i, v in sample(300)], SCHEMA)
    out = G.near_duplicates(df, shard=60)
    assert G.audit_recall(df, out, every=5, block=40) >= 0.98
    assert G.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    lone = G.near_duplicates(spark.createDataFrame([(1, None, 0), (2, [0.0, 0.0], 0)], SCHEMA)).collect()
    assert sorted(tuple(r) for r in lone) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_search_on_graph_reaches_dense_groups():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(300, 24)), rng.normal(size=24) + 0.05 * rng.normal(size=(400, 24))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = G.Search(x, G.build(x), [G.medoid(x)], 0.9)
    u, v, found, true = s.audited(beam=8)
    a, b = s.all_links(np.arange(len(x)))
    assert len(u) >= 0.99 * len(a) and found >= 0.98 * true
    assert (np.einsum("ij,ij->i", x[u], x[v]) >= 0.9).all()
    label = G.spanning(len(x), u, v)
    assert len(set(label[300:].tolist())) == 1


def test_a_pair_of_blocks_searches_one_in_the_graph_of_the_other(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(150, 16))
    x = centres[np.arange(1500) % 150] + rng.normal(size=(1500, 16)) * 0.12
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    block = rng.integers(0, 2, 1500)
    near, medoids = [None] * 1500, [[] for _ in range(1500)]
    for b in (0, 1):
        own = np.flatnonzero(block == b)
        for i, a in zip(own, G.build(x[own])):
            near[i] = own[np.unique(a)].tolist()
        medoids[own[G.medoid(x[own])]] = [0]
    passes, calls, one = [], [], G.Search.links

    def counted(self, queries, beam, slack):
        passes.append(beam)
        calls.append(queries)
        return one(self, queries, beam, slack)

    monkeypatch.setattr(G.Search, "links", counted)
    n = pa.array(np.arange(1500))
    batch = pa.RecordBatch.from_pydict({
        "shard": pa.array(np.zeros(1500, np.int64)), "i": pa.array(np.zeros(1500, np.int64)),
        "j": pa.array(np.ones(1500, np.int64)), "block": pa.array(block), "key": n, "m": pa.array(np.ones(1500, np.int64)),
        "v": pa.array(x.tolist()), "shards": pa.array([[0]] * 1500), "near": pa.array(near, pa.list_(pa.int64())),
        "medoids": pa.array(medoids, pa.list_(pa.int64()))})
    out = [r for b in G._search(0.9)(iter([batch])) for r in b.to_pylist()]
    true = ((x @ x.T >= 0.9) & (block[:, None] != block)).sum(1)
    got = np.zeros(1500, np.int64)
    for r in out:
        if r["key"] is not None:
            got[r["key"]] = r["links"]
    assert (got <= true).all() and got.sum() >= 0.98 * true.sum() > 5000
    assert sum(map(len, calls)) == (block == 0).sum() and set(passes) == {G.BEAM}
