"""Vector compression by codebooks, trained by Lloyd rounds over cover trees.

Each component becomes the integer ``floor(1024 * x)``, a vector is cut into
four consecutive parts, and every part position has a codebook of at most 256
entries.  All arithmetic that decides anything is on integers.

Every task cuts its rows into blocks of ``BLOCK`` vectors and builds one cover
tree per block and part position, once: a node has a centre, a radius that
covers its points, and children of half the radius whose centres lie farther
apart than that; a child holds its parent's centre as well.  Points are kept in
tree order, so a subtree is a range and its sum a difference of two cumulative
sums.  A round walks down the levels.  If the second-nearest entry of a node's
centre is farther than the nearest by more than twice the radius, the triangle
inequality gives the whole subtree to the nearest; other nodes go on to their
children, and only points of undecided leaves are compared one by one.  Tasks
hand back a count and a sum for each entry; they are added up by Spark, and the
codebooks, whose size depends on the vectors' length alone, pass the driver.

Rows whose vector is null or holds null or non-finite components are dropped.
Shorter vectors are read as padded with zeros to the longest; lengths that four
does not divide are cut at ``length * part // 4``; components are clamped to
+-2**27 (131,072 before scaling), so that distances stay in 64 bits.  Equal
vec_ids are rows of their own, a null vec_id sorts last; with no rows the
result is empty; with fewer than 256 the codebooks are as small.  Columns
beyond vec_id, embedding and label are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK = 2048                 # vectors per tree
LEAF = 8                     # a node of at most so many points is not split
CLAMP = 1 << 27
FAST = 1 << 20               # below this, sums of squares are exact in double precision
SALTS = 32                   # a label's total is met by rows in so many groups


def bounds(width: int) -> list[int]:
    return [width * p // PARTS for p in range(PARTS + 1)]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of y."""
    if max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) < FAST and x.shape[1] <= 1024:
        x, y = x.astype(float), y.astype(float)
        return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    out = np.zeros((len(x), len(y)), np.int64)
    for j in range(x.shape[1]):
        out += (x[:, j, None] - y[None, :, j]) ** 2
    return out


class Tree:
    """Cover tree of a block's parts: point order and nodes with range, radius and children."""

    FIELDS = (("order", np.int32), ("start", np.int32), ("end", np.int32), ("radius", np.float64),
              ("child", np.int32), ("children", np.int32))

    def __init__(self, arrays):
        self.order, self.start, self.end, self.radius, self.child, self.children = arrays

    @classmethod
    def build(cls, points: np.ndarray) -> "Tree":
        order = np.arange(len(points), dtype=np.int32)
        start, end, radius, child, children = [0], [len(points)], [0.0], [0], [0]
        at = 0
        while at < len(start):                          # nodes are numbered level by level
            lo, hi = start[at], end[at]
            own = order[lo:hi]
            far = np.sqrt(distances(points[own[:1]], points[own])[0]) if hi > lo else np.zeros(1)
            radius[at] = float(far.max())
            if radius[at] > 0 and hi - lo > LEAF:
                groups = cls._net(points[own], radius[at] / 2)
                order[lo:hi] = own[np.concatenate(groups)]
                child[at], children[at] = len(start), len(groups)
                for g in groups:
                    start.append(lo)
                    lo += len(g)
                    end.append(lo)
                    radius.append(0.0)
                    child.append(0)
                    children.append(0)
            at += 1
        return cls([np.array(x, t) for x, (_, t) in zip((order, start, end, radius, child, children), cls.FIELDS)])

    @staticmethod
    def _net(points: np.ndarray, reach: float) -> list[np.ndarray]:
        """Groups of places: each centre first, followed by what it covers; the first place is a centre.

        Centres that cover nothing else come as one last group of loose points.
        """
        near = distances(points, points) <= reach * reach
        free = np.ones(len(points), bool)
        groups, loose = [], []
        for c in range(len(points)):
            if free[c]:
                got = np.flatnonzero(near[c] & free)
                free[got] = False
                if len(got) > 1 or c == 0:
                    groups.append(np.concatenate([[c], got[got != c]]))
                else:
                    loose.append(c)
        return groups + ([np.array(loose)] if loose else [])

    def assign(self, points: np.ndarray, book: np.ndarray):
        """(entry of every point in tree order, count and sum of every entry)."""
        inside = points[self.order]
        running = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(inside, axis=0, dtype=np.int64)])
        entry = np.zeros(len(points), np.int64)
        counts, sums = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
        exact, level = [], np.zeros(1 if len(points) else 0, np.int64)
        while len(level):
            d = np.sqrt(distances(inside[self.start[level]], book))
            best = d.argmin(1)
            nearest = d[np.arange(len(level)), best]
            d[np.arange(len(level)), best] = np.inf
            room = 2 * self.radius[level] * (1 + 1e-9) + 1e-6
            sure = (d.min(1) - nearest > room) | (self.radius[level] == 0)
            done, chosen = level[sure], best[sure]
            a, b = self.start[done], self.end[done]
            entry[spread(a, b)] = np.repeat(chosen, b - a)
            np.add.at(counts, chosen, b - a)
            np.add.at(sums, chosen, running[b] - running[a])
            open_ = level[~sure]
            leaf = self.children[open_] == 0
            exact.append(spread(self.start[open_[leaf]], self.end[open_[leaf]]))
            inner = open_[~leaf]
            level = spread(self.child[inner], self.child[inner] + self.children[inner])
        rest = np.concatenate(exact) if exact else np.zeros(0, np.int64)
        if len(rest):
            entry[rest] = distances(inside[rest], book).argmin(1)
            by = rest[np.argsort(entry[rest], kind="stable")]
            first = np.flatnonzero(np.diff(entry[by], prepend=-1))
            counts[entry[by][first]] += np.diff(np.append(first, len(by)))
            sums[entry[by][first]] += np.add.reduceat(inside[by], first, axis=0)
        return entry, counts, sums


def spread(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [a, b), in order."""
    n = (b - a).astype(np.int64)
    if not n.sum():
        return np.zeros(0, np.int64)
    return np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n)


BLOCKS = "ids array<long>, labels array<string>, points binary, " + ", ".join(f"tree{p} binary" for p in range(PARTS))


def _pack(tree: Tree) -> bytes:
    arrays = [np.asarray(getattr(tree, name), t) for name, t in Tree.FIELDS]
    return np.array([len(arrays[0]), len(arrays[1])], np.int64).tobytes() + b"".join(x.tobytes() for x in arrays)


def _unpack(raw: bytes) -> Tree:
    n, m = np.frombuffer(raw, np.int64, 2)
    at, out = 16, []
    for i, (_, t) in enumerate(Tree.FIELDS):
        out.append(np.frombuffer(raw, t, n if i == 0 else m, at))
        at += out[-1].nbytes
    return Tree(out)


def _build(width: int):
    cut = bounds(width)

    def run(batches):
        ids, labels, held = [], [], []

        def block(ids, labels, points):
            trees = [_pack(Tree.build(points[:, cut[p]:cut[p + 1]].astype(np.int64))) for p in range(PARTS)]
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string())),
                 pa.array([points.astype(np.int32).tobytes()], pa.binary()), *[pa.array([t], pa.binary()) for t in trees]],
                names=["ids", "labels", "points", *[f"tree{p}" for p in range(PARTS)]])

        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            labels += batch.column("label").to_pylist()
            v = batch.column("v")
            held.append(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), width))
            if len(ids) >= BLOCK:
                points = np.concatenate(held)
                full = len(ids) // BLOCK * BLOCK
                for i in range(0, full, BLOCK):
                    yield block(ids[i:i + BLOCK], labels[i:i + BLOCK], points[i:i + BLOCK])
                ids, labels, held = ids[full:], labels[full:], [points[full:]]
        if ids:
            yield block(ids, labels, np.concatenate(held))
    return run


def _blocks(batches, width: int):
    """(ids, labels, points, trees) of each stored block."""
    for batch in batches:
        for i in range(batch.num_rows):
            points = np.frombuffer(batch.column("points")[i].as_py(), np.int32).astype(np.int64)
            n = len(batch.column("ids")[i])
            yield (batch.column("ids")[i].as_py(), batch.column("labels")[i].as_py(), points.reshape(n, width),
                   [_unpack(batch.column(f"tree{p}")[i].as_py()) for p in range(PARTS)])


SUMS = "part int, entry int, n long, total array<long>"


def _round(books, width: int):
    cut = bounds(width)

    def run(batches):
        now = books.value
        counts = [np.zeros(len(b), np.int64) for b in now]
        sums = [np.zeros(b.shape, np.int64) for b in now]
        for _, _, points, trees in _blocks(batches, width):
            for p, (tree, book) in enumerate(zip(trees, now)):
                _, n, total = tree.assign(points[:, cut[p]:cut[p + 1]], book)
                counts[p] += n
                sums[p] += total
        rows = [(p, int(e), int(counts[p][e]), sums[p][e].tolist()) for p in range(PARTS) for e in np.flatnonzero(counts[p])]
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(
            columns, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], names=["part", "entry", "n", "total"])
    return run


CODED = "vec_id long, label string, code string, error long"


def _code(books, width: int):
    cut = bounds(width)

    def run(batches):
        for ids, labels, points, trees in _blocks(batches, width):
            error = np.zeros(len(ids), np.int64)
            codes = np.zeros((len(ids), PARTS), np.uint8)
            for p, (tree, book) in enumerate(zip(trees, books.value)):
                own = points[:, cut[p]:cut[p + 1]]
                entry, _, _ = tree.assign(own, book)
                codes[tree.order, p] = entry
                error += ((own - book[codes[:, p]]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array([c.tobytes().hex() for c in codes]),
                 pa.array(error)], names=["vec_id", "label", "code", "error"])
    return run


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label and integer components of the rows that count."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.greatest(F.least(F.floor(x * SCALE), F.lit(CLAMP)), F.lit(-CLAMP)).cast("long"))
    return (vectors.filter(v.isNotNull() & ~bad)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                    whole.alias("v")))


def compress(vectors: DataFrame, rounds: int = ROUNDS):
    """(vec_id, label, code and error of every kept row, the trained codebooks)."""
    spark = vectors.sparkSession
    kept = integers(vectors)
    width = kept.agg(F.max(F.size("v"))).first()[0] or 0
    kept = kept.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()    # the rule's own 256
    start = np.array([r["v"] for r in first], np.int64).reshape(len(first), width)
    cut = bounds(width)
    books = [start[:, cut[p]:cut[p + 1]].copy() for p in range(PARTS)]
    blocks = store(kept.mapInArrow(_build(width), BLOCKS), "code_blocks")
    for _ in range(rounds if len(first) else 0):
        shared = spark.sparkContext.broadcast(books)                # at most 256 vectors
        sums = blocks.mapInArrow(_round(shared, width), SUMS)
        flat = sums.select("part", "entry", "n", F.posexplode_outer("total").alias("at", "x"))
        new = flat.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
        books = [b.copy() for b in books]                           # one number per codebook component came back
        for r in new:
            if r["at"] is not None:
                books[r["part"]][r["entry"], r["at"]] = r["x"] // r["n"]
    return blocks.mapInArrow(_code(spark.sparkContext.broadcast(books), width), CODED), books


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, the error of all rows with the same label, and the codebooks' digest."""
    coded, books = compress(vectors)
    coded = store(coded, "codes")
    text = ",".join(str(int(x)) for b in books for x in b.ravel())
    key = F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit("")).alias("label"))
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS))
    rows = coded.select("vec_id", "code", "error", key.alias("key"), salt.alias("salt"))
    total = rows.groupBy("key").agg(F.sum("error").alias("label_error"))
    total = total.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.join(total, ["key", "salt"]).select(
        "vec_id", "code", "error", "label_error",
        F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))
