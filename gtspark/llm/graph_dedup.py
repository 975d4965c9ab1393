"""Embedding near-duplicates by search in a robust-pruned flat graph.

1. Equal vectors collapse to one node with a count.
2. Spherical k-means, fitted on at most ``SAMPLE`` nodes, gives the shards;
   every node joins its ``OVERLAP`` nearest ones.  A shard above ``BLOCK`` nodes
   is dealt into blocks by hash, and every pair of its blocks is one task.
3. Build: in each block, robust pruning (a candidate goes when a chosen
   neighbour is ``ALPHA`` times nearer to it than the node is) leaves at most
   ``DEGREE`` neighbours, to which ``RANDOM`` pseudo-random ones are added so
   that a dense group is not cut off.  A node's adjacency lists from all its
   shards are united.
4. Search: in each pair of blocks, every node of the one is searched greedily
   over the united graph of the other from its medoid (in a block with itself
   every node over its own); once the beam settles, the search goes on through
   every node found within the threshold less ``SLACK``.
5. Audit and verify: links are pairs whose cosine in double precision reaches
   the threshold.  In every task ``AUDIT`` nodes are compared with all others;
   below ``RECALL`` the search is repeated with twice the beam and slack, and
   at last all pairs of the two blocks are compared.

A pair that shares several shards is counted in the smallest of them.  Tasks
return counts and spanning links per node, never pairs.  Vectors are told
apart by a 64-bit hash of their doubles.  Vectors that are null, zero, hold a
null or non-finite component, have no id, or have another dimension than most
rows link with nothing (a null id has a null component and is not kept).
Rows that repeat an id are vectors of their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store
from .linking import components

THRESHOLD, SHARD, BLOCK, OVERLAP, SAMPLE = 0.9, 1000, 3000, 3, 16384
DEGREE, CANDIDATES, RANDOM, ALPHA, BEAM, SLACK = 20, 48, 4, 1.2, 16, 0.04
AUDIT, RECALL, MOST_SHARDS = 24, 0.98, 2048


def unit_rows(col, dim: int | None = None):
    """(row numbers, unit vectors) of the usable rows of an Arrow list column."""
    good, out = [], []
    for i, v in enumerate(col.to_pylist()):
        if v is None or not v or any(x is None for x in v) or (dim and len(v) != dim):
            continue
        x = np.array(v, np.float64)
        if not np.isfinite(x).all():
            continue
        top = np.abs(x).max()
        if top > 0:
            x = x / top
            good.append(i)
            out.append(x / np.sqrt(x @ x))
    return good, np.array(out).reshape(len(good), len(out[0]) if out else 0)


def _clean(dim: int):
    def run(batches):
        for batch in batches:
            good, x = unit_rows(batch.column("embedding"), dim)
            raw = batch.column("embedding").take(pa.array(good, pa.int64()))
            keys = [int.from_bytes(hashlib.blake2b(np.array(v, np.float64).tobytes(), digest_size=8).digest(),
                                   "little", signed=True) for v in raw.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(good, pa.int64())), pa.array(keys, pa.int64()),
                 pa.array(list(x), pa.list_(pa.float64()))], ["vec_id", "key", "v"])
    return run


def _matrix(col) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def kmeans(x, k: int, rounds: int = 8):
    """Spherical k-means centres; deterministic."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        own = np.concatenate([(x[i:i + 2048] @ centres.T).argmax(1) for i in range(0, len(x), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
    return centres


def _assign(shared, overlap: int):
    def run(batches):
        for batch in batches:
            near = []
            x = _matrix(batch.column("v")) if batch.num_rows else np.zeros((0, 1))
            for i in range(0, len(x), 1024):
                s = x[i:i + 1024] @ shared.value.T
                m = min(overlap, s.shape[1])
                near += np.sort(np.argpartition(-s, m - 1, axis=1)[:, :m], axis=1).tolist()
            yield pa.RecordBatch.from_arrays(
                list(batch.columns) + [pa.array(near, pa.list_(pa.int64()))], list(batch.schema.names) + ["shards"])
    return run


def build(x, degree=DEGREE, candidates=CANDIDATES, extra=RANDOM, alpha=ALPHA):
    """Neighbour numbers of each row of ``x``, padded with the row itself."""
    n = len(x)
    c = min(candidates, n - 1)
    if c < 1:
        return np.zeros((n, 1), np.int64)
    out = []
    for lo in range(0, n, 256):
        own = np.arange(lo, min(lo + 256, n))
        s = x[own] @ x.T
        s[np.arange(len(own)), own] = -2
        cand = np.argpartition(-s, c - 1, axis=1)[:, :c]
        sim = np.take_along_axis(s, cand, 1)
        order = np.argsort(-sim, axis=1, kind="stable")
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        vec = x[cand]
        far = np.sqrt(np.maximum(2 - 2 * sim, 0))
        between = np.sqrt(np.maximum(2 - 2 * (vec @ vec.transpose(0, 2, 1)), 0))
        alive = np.ones(cand.shape, bool)
        pick = np.repeat(own[:, None], degree, 1)
        rows = np.arange(len(own))
        for j in range(min(degree, c)):
            first = alive.argmax(1)
            some = alive[rows, first]
            pick[some, j] = cand[rows, first][some]
            alive &= ~(alpha * between[rows, first] <= far)
            alive[rows, first] = False
        out.append(pick)
    adj = np.concatenate(out)
    rng = np.random.default_rng(n)
    return np.concatenate([adj, rng.integers(0, n, (n, extra))], 1)


def medoid(x) -> int:
    return int((x @ x.mean(0)).argmax())


class Search:
    """Links from nodes ``x`` over the neighbour matrix ``adj`` (padded with own numbers).

    ``own`` are the numbers searched for, ``others`` those that ``entries`` and
    their lists lead to (all nodes where not given).
    """

    def __init__(self, x, adj, entries, threshold, own=None, others=None):
        self.x, self.adj, self.entries, self.threshold = x, adj, np.unique(entries), threshold
        self.own = np.arange(len(x)) if own is None else own
        self.others = np.arange(len(x)) if others is None else others

    def _sims(self, q, node):
        out = np.empty(len(q))
        for i in range(0, len(q), 65536):
            out[i:i + 65536] = np.einsum("ij,ij->i", self.x[q[i:i + 65536]], self.x[node[i:i + 65536]])
        return out

    def links(self, queries, beam: int, slack: float):
        """(query, node) pairs found at or above the threshold."""
        n, q = len(self.x), len(queries)
        seen = np.zeros((q, n), bool)
        e = np.tile(self.entries, q)
        at = np.repeat(np.arange(q), len(self.entries))
        seen[at, e] = True
        sims = self._sims(queries[at], e)
        found = [(at, e, sims)]
        width = max(beam, len(self.entries))
        ids = np.full((q, width), -1, np.int64)
        val = np.full((q, width), -3.0)
        ids[:, :len(self.entries)] = e.reshape(q, -1)
        val[:, :len(self.entries)] = sims.reshape(q, -1)
        done = ids < 0
        rows = np.arange(q)
        while not done.all():
            nxt = np.where(done, -4.0, val).argmax(1)
            live = np.flatnonzero(~done[rows, nxt])
            node = ids[live, nxt[live]]
            done[live, nxt[live]] = True
            at, new = self._expand(seen, live, node)
            if len(at) == 0:
                continue
            sims = self._sims(queries[at], new)
            near = sims >= self.threshold - slack
            found.append((at[near], new[near], sims[near]))
            count = np.bincount(at, minlength=q)
            most = int(count.max())
            slot = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            more_id, more_val = np.full((q, most), -1, np.int64), np.full((q, most), -3.0)
            more_id[at, slot], more_val[at, slot] = new, sims
            ids, val = np.concatenate([ids, more_id], 1), np.concatenate([val, more_val], 1)
            done = np.concatenate([done, more_id < 0], 1)
            best = np.argpartition(-val, width - 1, axis=1)[:, :width]
            ids, val, done = (np.take_along_axis(a, best, 1) for a in (ids, val, done))
        at, node, sims = (np.concatenate(a) for a in zip(*found))
        keep = sims >= self.threshold - slack
        front, out = (at[keep], node[keep]), [(at[keep], node[keep], sims[keep])]
        while len(front[0]):                                   # range expansion
            later = []
            for i in range(0, len(front[0]), 4096):
                a, new = self._expand(seen, front[0][i:i + 4096], front[1][i:i + 4096])
                s = self._sims(queries[a], new)
                near = s >= self.threshold - slack
                later.append((a[near], new[near], s[near]))
            out += later
            front = tuple(np.concatenate(z) for z in list(zip(*later))[:2])
        at, node, sims = (np.concatenate(a) for a in zip(*out))
        keep = (sims >= self.threshold) & (queries[at] != node)
        return queries[at[keep]], node[keep]

    def _expand(self, seen, at, node):
        """Unseen (row, neighbour) pairs, sorted by row."""
        n = seen.shape[1]
        key = np.unique((at[:, None] * n + self.adj[node]).ravel())
        a, new = key // n, key % n
        fresh = ~seen[a, new]
        a, new = a[fresh], new[fresh]
        seen[a, new] = True
        return a, new

    def all_links(self, queries):
        """The same by comparing with every node."""
        y = self.x[self.others]
        out = [np.nonzero(self.x[queries[i:i + 256]] @ y.T >= self.threshold)
               for i in range(0, len(queries), 256)]
        q = np.concatenate([queries[i * 256:][a] for i, (a, _) in enumerate(out)])
        v = self.others[np.concatenate([b for _, b in out])]
        return q[q != v], v[q != v]

    def audited(self, beam: int = BEAM, slack: float = SLACK, audit: int = AUDIT, recall: float = RECALL):
        """Symmetric links of the nodes, and the (found, true) counts of the last audit."""
        n, own, most = len(self.x), self.own, len(self.others)
        probe = own[np.unique(np.linspace(0, len(own) - 1, min(audit, len(own))).astype(int))]
        true = set(zip(*(z.tolist() for z in self.all_links(probe))))
        while True:
            if beam >= most:
                parts = [self.all_links(own)]
            else:
                parts = [self.links(own[i:i + 256], beam, slack) for i in range(0, len(own), 256)]
            u, v = (np.concatenate(z) for z in zip(*parts))
            key = np.unique(np.concatenate([u * n + v, v * n + u]))
            u, v = key // n, key % n
            mine = np.isin(u, probe)
            found = len(true & set(zip(u[mine].tolist(), v[mine].tolist())))
            if found >= recall * len(true) or beam >= most:
                return u, v, found, len(true)
            beam, slack = 2 * beam, 2 * slack


def spanning(n: int, u, v):
    """Smallest number reachable from each node."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _groups(batches, keys):
    """Yield (key, table) of runs of rows with equal keys, across batches."""
    held, key = [], None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            own = tuple(int(c[a]) for c in cols)
            if own != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = own
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def _build(batches):
    for _, t in _groups(batches, ("shard", "block")):
        t = t.combine_chunks()
        x, keys = _matrix(t.column("v").chunk(0)), t.column("key").to_numpy()
        adj = build(x)
        own = [keys[np.unique(a)].tolist() for a in adj]
        start = np.zeros(len(keys), bool)
        start[medoid(x)] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys), t.column("shard").chunk(0), pa.array(start), pa.array(own, pa.list_(pa.int64()))],
            ["key", "shard", "medoid", "near"])


def _search(threshold: float):
    def run(batches):
        for (shard, i, j), t in _groups(batches, ("shard", "i", "j")):
            t = t.combine_chunks()
            x, keys = _matrix(t.column("v").chunk(0)), t.column("key").to_numpy()
            block, m = t.column("block").to_numpy(), t.column("m").to_numpy()
            lists = t.column("near").chunk(0)
            size = np.diff(lists.offsets.to_numpy())
            row, near = np.repeat(np.arange(len(keys)), size), lists.flatten().to_numpy()
            order = np.argsort(keys)
            pos = np.minimum(np.searchsorted(keys[order], near), len(keys) - 1)
            here = keys[order][pos] == near
            row, near = row[here], order[pos[here]]
            here = block[row] == block[near]            # a search stays in the block that it entered
            row, near = row[here], near[here]
            size = np.bincount(row, minlength=len(keys))
            adj = np.repeat(np.arange(len(keys))[:, None], max(1, int(size.max())), 1)
            adj[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = near
            own, others = np.flatnonzero(block == i), np.flatnonzero(block == j)
            if len(own) == 0 or len(others) == 0:
                continue
            entries = others[[shard in s for s in t.column("medoids").take(pa.array(others)).to_pylist()]]
            s = Search(x, adj, entries if len(entries) else others[:1], threshold, own, others)
            u, v, found, true = s.audited()
            shards = _matrix(t.column("shards").chunk(0))
            common = np.full(len(u), np.iinfo(np.int64).max)
            for a in range(shards.shape[1]):
                for b in range(shards.shape[1]):
                    same = shards[u, a] == shards[v, b]
                    common[same] = np.minimum(common[same], shards[u, a][same])
            counted = (common == shard) & ((i == j) | (block[u] != block[v]))
            links = np.bincount(u[counted], m[v[counted]], len(keys)).astype(np.int64)
            root = keys[spanning(len(keys), u, v)]
            some = np.flatnonzero((links > 0) | (root != keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array([*keys[some].tolist(), None], pa.int64()), pa.array([*links[some].tolist(), found]),
                 pa.array([*root[some].tolist(), true])], ["key", "links", "root"])
    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD, block: int = BLOCK,
                    overlap: int = OVERLAP, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("embedding"))
    size = (rows.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).count()
            .orderBy(F.desc("count"), "d").limit(1).collect())
    dim = size[0]["d"] if size else 1
    clean = store(rows.where(F.col("vec_id").isNotNull())
                  .mapInArrow(_clean(dim), "vec_id long, key long, v array<double>"), "vectors")
    nodes = store(clean.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.first("v").alias("v")), "nodes")
    n = nodes.count()
    some = nodes.orderBy(F.xxhash64("key"), "key").limit(sample).select("v").collect()
    k = max(1, min(-(-n // shard), MOST_SHARDS, len(some) // 8))
    x = np.array([r["v"] for r in some], np.float64).reshape(-1, dim)
    centres = kmeans(x, k) if len(x) else np.zeros((1, dim))
    near = nodes.mapInArrow(_assign(spark.sparkContext.broadcast(centres), overlap),
                            "key long, m long, v array<double>, shards array<long>")
    member = near.withColumn("shard", F.explode("shards"))
    sizes = member.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    member = store(member.join(F.broadcast(sizes), "shard")            # at most MOST_SHARDS rows
                   .withColumn("block", F.pmod(F.xxhash64("key"), "blocks")), "members")
    lists = (member.select("shard", "block", "key", "v").repartition("shard", "block")
             .sortWithinPartitions("shard", "block", "key")
             .mapInArrow(_build, "key long, shard long, medoid boolean, near array<long>"))
    lists = store(lists.groupBy("key").agg(
        F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"),
        F.collect_set(F.when(F.col("medoid"), F.col("shard"))).alias("medoids")), "adjacency")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pairs = (member.join(lists, "key").withColumn("__x", other)
             .select("shard", F.least("block", "__x").alias("i"), F.greatest("block", "__x").alias("j"),
                     "block", "key", "m", "v", "shards", "near", "medoids"))
    found = store(pairs.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j", "key")
                  .mapInArrow(_search(threshold), "key long, links long, root long"), "graph_links")
    links = found.where(F.col("key").isNotNull())
    linked = components(links.where(F.col("key") != F.col("root"))
                        .select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "key")
    count = links.groupBy("key").agg(F.sum("links").alias("links"))
    per_key = (nodes.select("key", "m").join(count, "key", "left").join(linked, "key", "left")
               .select("key", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"),
                       F.coalesce("component", "key").alias("component")))
    own = store(clean.select("vec_id", "key").join(per_key, "key"), "vector_links")
    first = own.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    own = own.join(first, "component").select("vec_id", "n_links", "component_id")
    rest = _unlinked(rows, dim)
    return own.unionByName(rest).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _unlinked(rows: DataFrame, dim: int) -> DataFrame:
    """The rows that take no part."""
    def run(batches):
        for batch in batches:
            good, _ = unit_rows(batch.column("embedding"), dim)
            usable = np.zeros(batch.num_rows, bool)
            usable[good] = True
            usable &= np.asarray(batch.column("vec_id").is_valid())
            yield batch.select(["vec_id"]).filter(pa.array(~usable))

    return rows.mapInArrow(run, "vec_id long").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))


def audit_recall(vectors: DataFrame, result: DataFrame, threshold: float = THRESHOLD, every: int = 50,
                 block: int = 2000) -> float:
    """Share of true links found for the vectors whose id is divisible by ``every``, against all rows in blocks."""
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                         F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")
    query = ids.where(F.col("vec_id") % every == 0)
    parts = max(1, -(-query.count() // block))
    true = []
    for p in range(parts):
        own = query.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == p).collect()
        good, x = unit_rows(pa.array([r["embedding"] for r in own], pa.list_(pa.float64())))
        names = np.array([own[i]["vec_id"] for i in good], np.int64)

        def run(batches, x=x, names=names):
            for batch in batches:
                _, y = unit_rows(batch.column("embedding"), x.shape[1] or None)
                n = (x @ y.T >= threshold).sum(1) if len(x) and len(y) else np.zeros(len(x), int)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n, pa.int64())], ["vec_id", "n"])

        true.append(ids.mapInArrow(run, "vec_id long, n long"))
    total = true[0]
    for t in true[1:]:
        total = total.union(t)
    total = total.groupBy("vec_id").agg((F.sum("n") - 1).alias("n"))
    r = total.join(result, "vec_id").agg(F.sum(F.least("n", "n_links")), F.sum("n")).first()
    return 1.0 if not r[1] else r[0] / r[1]
