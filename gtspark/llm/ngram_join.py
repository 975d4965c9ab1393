"""N-gram Jaccard join by prefix trees.

Every document becomes the set of its distinct word n-grams under one global
order, rarest first.  Two sets of Jaccard similarity ``t`` share a token among
their rarest ``n - ceil(t n) + 1``, which yields the candidates; bounds on
length, position and, for the set whose prefix ends first in the order, the
number of tokens that no other document's prefix holds thin them (the other set's
unshared tokens may lie beyond that prefix).  Candidates of one probe are stored in a prefix
tree (their sets, most frequent token first, so copies share long paths) that
the probe walks once: the overlap up to a branching point is counted once for
all sets below it, and a subtree is left as soon as overlap plus remaining
length cannot reach the threshold.

Rarity comes from counts over all documents, folded into ``count_buckets``
cells by hash (4 bytes each: the one broadcast, of fixed size); a shared cell
changes the order and so the speed, never the result.  Sets are compared by
64-bit hashes of their n-grams.

Equal sets are one class, represented by its smallest doc_id.  Links inside
one component are not all verified (see ``linking``), the components are those
of all links.  Null and empty texts have an empty set and link with nothing; a
null doc_id takes part in nothing; rows that repeat a doc_id are one node,
which holds the links of each of its texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as T
from .common import store
from .linking import components, link
from .sketch import sketch, thinned

NGRAM, PERCENT = 4, 85
COUNT_BUCKETS = 1 << 20
CHUNK = 512                      # sets in one prefix tree
_CELLS = 4096                    # count cells per row while they are summed


def _sets(data, offs, k: int):
    """Sorted distinct k-word shingles of each row; fewer words are one shingle."""
    h, rows = T.words(data, offs, T.SPACED)
    s, at = T.shingles(h, rows, k)
    parts = [(s, at)]
    n = np.diff(rows)
    for short in range(1, k):
        few = np.flatnonzero(n == short)
        if len(few):
            x = np.zeros(len(few), np.uint64)
            with np.errstate(over="ignore"):
                for j in range(short):
                    x += h[rows[few] + j] * T._COEF[j]
            parts.append((T.mix(x + np.uint64(short)), rows[few]))
    s, at = (np.concatenate(x) for x in zip(*parts))
    return T.sorted_sets(s, at, rows)


def _count(k: int, buckets: int):
    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offs in T.slices(batch.column(0)):
                s, _ = _sets(data, offs, k)
                sums += np.bincount((s % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        cells = min(_CELLS, buckets)
        some = [i for i in range(buckets // cells) if sums[i * cells:(i + 1) * cells].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()),
             pa.array([sums[i * cells:(i + 1) * cells].tobytes() for i in some], pa.binary())],
            ["cell", "sums"])
    return run


def _add(pdf):
    total = sum(np.frombuffer(x, np.int64) for x in pdf["sums"])
    return pdf.iloc[:1].assign(sums=[np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()])


def count_cells(docs: DataFrame, k: int, buckets: int) -> np.ndarray:
    """Folded document counts of all n-grams: ``buckets`` int32."""
    cells = min(_CELLS, buckets)
    rows = (docs.select("text").mapInArrow(_count(k, buckets), "cell int, sums binary")
            .groupBy("cell").applyInPandas(_add, "cell int, sums binary").collect())
    out = np.zeros(buckets, np.int32)
    for r in rows:
        out[r["cell"] * cells:(r["cell"] + 1) * cells] = np.frombuffer(r["sums"], np.int32)
    return out


def _ranked(s, first, counts):
    """Each row's set ordered by (count, hash)."""
    r = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return s[np.lexsort((s, counts[(s % np.uint64(len(counts))).astype(np.int64)], r))]


def _lists(values, first):
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64)))


def need_all(n, percent: int):
    """ceil(percent * n / 100)."""
    return (percent * n + 99) // 100


def _prefixes(shared, k: int, percent: int):
    """doc_id, set size, fingerprint and prefix tokens (rarest first)."""
    def run(batches):
        counts = shared.value
        for batch in batches:
            for lo, data, offs in T.slices(batch.column("text")):
                s, first = _sets(data, offs, k)
                n = np.diff(first)
                prints = []
                for seed in (21, 22):
                    acc = np.concatenate([[np.uint64(0)], np.cumsum(T.mix(s + T.stream(seed, 1)[0]))])
                    prints.append(pa.array((acc[first[1:]] - acc[first[:-1]]).view(np.int64)))
                s = _ranked(s, first, counts)
                p = np.where(n > 0, n - need_all(n, percent) + 1, 0)
                ends = np.concatenate([[0], np.cumsum(p)])
                take = np.arange(ends[-1]) + np.repeat(first[:-1] - ends[:-1], p)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, len(n)), pa.array(n), *prints, _lists(s[take], ends)],
                    ["doc_id", "n", "f1", "f2", "prefix"])
    return run


def _ordered(col, counts, k: int):
    """Each row's whole set, most frequent token first."""
    for _, data, offs in T.slices(col):
        s, first = _sets(data, offs, k)
        s = _ranked(s, first, counts)
        r = np.repeat(np.arange(len(first) - 1), np.diff(first))
        s = s[(first[:-1] + first[1:] - 1)[r] - np.arange(len(s))]
        yield from np.split(s, first[1:-1])


class PrefixTree:
    """Token sequences sorted so that shared prefixes are adjacent paths."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())
        self.sets = [sets[i] for i in self.order]
        self.shared = [0]
        for x, y in zip(self.sets, self.sets[1:]):
            m = min(len(x), len(y))
            diff = x[:m] != y[:m]
            self.shared.append(int(diff.argmax()) if diff.any() else m)

    def walk(self, probe: np.ndarray, percent: int, step: int = 128) -> list[int]:
        """Numbers of the sets with 100 * overlap >= percent * union."""
        probe = np.sort(probe)
        na, found = len(probe), []
        path = np.zeros(1, np.int64)         # overlap of the current path by depth, as far as walked
        for number, x, same in zip(self.order, self.sets, self.shared):
            path = path[:min(same, len(path) - 1) + 1]
            need = -(-percent * (na + len(x)) // (100 + percent))
            parts, depth, have = [path], len(path) - 1, int(path[-1])
            while depth < len(x) and have + min(len(x) - depth, na - have) >= need:
                more = x[depth:depth + step]
                at = np.searchsorted(probe, more)
                at[at == na] = na - 1
                parts.append(have + np.cumsum(probe[at] == more))
                depth, have = depth + len(more), int(parts[-1][-1])
            path = np.concatenate(parts)
            if depth == len(x) and have >= need:
                found.append(number)
        return found


def _walk(shared, k: int, percent: int):
    """Walk one tree per (a, chunk); rows arrive sorted, the probes' own rows first."""
    def run(batches):
        key, probes, ids, sets = None, [], [], []

        def flush():
            if not ids:
                return []
            tree = PrefixTree(sets)
            return [(key[0], ids[i]) for probe in probes for i in tree.walk(probe, percent)]

        for batch in batches:
            out = []
            a, c, b = (batch.column(x).to_pylist() for x in ("a", "chunk", "b"))
            for i, own in enumerate(_ordered(batch.column("text"), shared.value, k)):
                if (a[i], c[i]) != key or len(ids) >= 2 * CHUNK:
                    out += flush()
                    ids, sets = [], []
                    if (a[i], c[i]) != key:
                        key, probes = (a[i], c[i]), []
                if b[i] is None:
                    probes.append(own.copy())
                else:
                    ids.append(b[i])
                    sets.append(own.copy())
            yield _pairs(out)
        yield _pairs(flush())
    return run


def _send(batches):
    """One row per place that needs a document's text."""
    for batch in batches:
        to = batch.column("to")
        n = np.diff(to.offsets.to_numpy())
        flat = to.flatten()
        yield pa.RecordBatch.from_arrays(
            [flat.field("a"), flat.field("chunk"), flat.field("b"),
             batch.column("text").take(pa.array(np.repeat(np.arange(len(n)), n)))], ["a", "chunk", "b", "text"])


def _pairs(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])


def verifier(docs: DataFrame, shared, k: int, percent: int):
    """Pairs (a, b) -> those whose n-gram sets are similar enough.

    Only the texts of paired documents are moved: to their document's row of
    places (thinned by a sketch of the ids first), then to their trees.
    """
    def verify(pairs: DataFrame) -> DataFrame:
        size = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
        chunked = pairs.join(size, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), "chunks"))
        places = (chunked.select(F.col("b").alias("doc_id"), "a", "chunk", "b")
                  .union(chunked.select(F.col("a").alias("doc_id"), "a", "chunk", F.lit(None).cast("long")).distinct()))
        places = store(places.groupBy("doc_id").agg(F.collect_list(F.struct("a", "chunk", "b")).alias("to")), "places")
        own = thinned(docs, "doc_id", sketch(places.select("doc_id")))
        rows = (own.join(places.hint("shuffle_hash"), "doc_id").select("text", "to")
                .mapInArrow(_send, "a long, chunk long, b long, text string")
                .repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first()))
        return rows.mapInArrow(_walk(shared, k, percent), "a long, b long").distinct()
    return verify


def _postings(keys, shared):
    """Prefix tokens that may be shared, one row each.

    ``live`` counts the row's shared tokens before this one and ``most`` is the
    set's size less its unshared prefix tokens: no overlap with a set whose
    prefix ends later can be larger.  ``last`` is the place of the prefix's end
    in the global order, coarsened (equal values do not tell which ends first).
    """
    def run(batches):
        counts = shared.value
        for batch in batches:
            prefix = batch.column("prefix")
            first = prefix.offsets.to_numpy()
            own = prefix.values.to_numpy(zero_copy_only=False)[first[0]:first[-1]]
            first = first - first[0]
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            ok = keys.value.has(own)
            upto = np.concatenate([[0], np.cumsum(ok)])
            n = batch.column("n").to_numpy()
            most = n - np.diff(first) + (upto[first[1:]] - upto[first[:-1]])
            end = own[first[1:] - 1].view(np.uint64)
            last = (counts[(end % np.uint64(len(counts))).astype(np.int64)].astype(np.int64) << 32) | (
                end >> np.uint64(32)).astype(np.int64)
            at = np.flatnonzero(ok)
            r = row[at]
            ids = batch.column("doc_id").take(pa.array(r))
            weight = (most[r] << 20) // n[r] * 1024 + (T.mix(ids.to_numpy().view(np.uint64)) >> np.uint64(54)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[at]), ids, pa.array(weight), pa.array(n[r]), pa.array(at - first[r], pa.int32()),
                 pa.array(upto[at] - upto[first[r]], pa.int32()), pa.array(most[r], pa.int64()), pa.array(last[r])],
                ["key", "id", "w", "n", "pos", "live", "most", "last"])
    return run


def similarity_components(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT,
                          count_buckets: int = COUNT_BUCKETS) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(count_cells(docs, ngram, count_buckets))
    sets = store(docs.mapInArrow(_prefixes(shared, ngram, percent),
                                 "doc_id long, n long, f1 long, f2 long, prefix array<long>"), "ngram_sets")
    full = sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = full.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("__m"))
    reps = full.join(classes.select("n", "f1", "f2", F.col("rep").alias("doc_id")),
                     ["n", "f1", "f2", "doc_id"], "leftsemi").dropDuplicates(["n", "f1", "f2", "doc_id"])
    reps = store(reps.select("doc_id", "n", "prefix"), "ngram_reps")
    keys = (reps.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("__n"))
            .where(F.col("__n") > 1).select("key"))
    postings = reps.mapInArrow(_postings(sketch(keys), shared),
                               "key long, id long, w long, n long, pos int, live int, most long, last long")

    def bound(x, y):
        c = {(s, v): F.col(f"{s}.{v}") for s in (x, y) for v in ("n", "pos", "live", "most", "last")}
        need = F.ceil(percent * (c[x, "n"] + c[y, "n"]) / (100 + percent))
        least = {s: F.ceil(percent * c[s, "n"] / 100) for s in (x, y)}
        ahead = F.least(c[x, "n"] - c[x, "pos"], c[y, "n"] - c[y, "pos"])

        def of_first(vx, vy):
            """The value of the set whose prefix ends first, the larger one where that is open."""
            return (F.when(c[x, "last"] < c[y, "last"], vx).when(c[x, "last"] > c[y, "last"], vy)
                    .otherwise(F.greatest(vx, vy)))

        most = F.least(F.least(c[x, "live"], c[y, "live"]) + ahead, of_first(c[x, "most"], c[y, "most"]))
        # the rest of the overlap lies after the end that comes first, in that set's tail; so both prefixes
        # share at least this many tokens, and the first of them has as many live ones from it on
        shared_least = need - of_first(least[x], least[y]) + 1
        left = F.least(*[c[s, "most"] - least[s] + 1 - c[s, "live"] for s in (x, y)])
        return ((100 * F.least(c[x, "n"], c[y, "n"]) >= percent * F.greatest(c[x, "n"], c[y, "n"]))
                & (most >= need) & (left >= shared_least))

    links = link(postings, verifier(docs, shared, ngram, percent), bound)
    copies = (full.join(classes.where(F.col("__m") > 1), ["n", "f1", "f2"])
              .select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = components(copies.union(links)).withColumnRenamed("id", "doc_id")
    return (sets.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """The first document (smallest id) of each component, with its own columns."""
    found = (similarity_components(docs, **params).where(F.col("doc_id") != F.col("component_id"))
             .select("doc_id").distinct())
    return docs.join(found, "doc_id", "leftanti").select(*docs.columns)
