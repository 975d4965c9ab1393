"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``window`` consecutive words (a shorter
item is one window).  A window can only occur where all its shingles of
``shingle`` words do, so its rarest shingle in the corpus is a necessary
prefix token.  Document shingles are joined with these tokens; the token's
offset gives the one place where the window could lie, the row's ends bound
it, and the window is verified word by word.

Pass 1 counts the benchmark's shingles over all documents (sums per task,
then a grouped sum); pass 2 joins and verifies.  The benchmark is the stated
query set: it is taken in blocks of at most ``block_words`` words, one
broadcast each, and every block sees every document.

Words are compared by 64-bit hashes, position by position over the window.
A null text has no words; a null item id marks words as hit but is not
listed; rows with equal ids stay separate documents, equal items count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import textbytes as T

WINDOW, SHINGLE, BLOCK_WORDS = 13, 5, 2_000_000
FILTER_BITS = 20


def _item_blocks(items: DataFrame, block_words: int):
    """Yield lists of (item id, word hashes), each of at most about ``block_words`` words."""
    block, size = [], 0
    for r in items.select("item_id", "text").distinct().toLocalIterator():
        if r["text"] is None:
            continue
        h, _ = T.words(*T.buffers(pa.array([r["text"]])), T.ALNUM)
        if len(h) == 0:
            continue
        block.append((r["item_id"], h))
        size += len(h)
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def item_windows(block, window: int, shingle: int):
    """Distinct windows: (hash matrix padded with 0, lengths, item number lists by CSR)."""
    found: dict[bytes, tuple] = {}
    for number, (_, h) in enumerate(block):
        n = min(window, len(h))
        for i in range(len(h) - n + 1):
            w = h[i:i + n]
            found.setdefault(w.tobytes(), (w, set()))[1].add(number)
    rows = list(found.values())
    mat = np.zeros((len(rows), window), np.uint64)
    for i, (w, _) in enumerate(rows):
        mat[i, :len(w)] = w
    lens = np.array([len(w) for w, _ in rows], np.int64)
    owners = [sorted(s) for _, s in rows]
    return mat, lens, owners


def window_shingles(mat, lens, shingle: int):
    """All (window, offset, k, token) of the windows' shingles, k = min(shingle, length)."""
    out = []
    for i in range(len(mat)):
        k = int(min(shingle, lens[i]))
        h, at = T.shingles(mat[i, :lens[i]], np.array([0, lens[i]]), k)
        out += [(i, int(a), k, int(x)) for a, x in zip(at, h)]
    return out


class Probe:
    """Finds which shingles of a batch are in a fixed token set."""

    def __init__(self, tokens):
        self.tokens = np.unique(np.asarray(tokens, np.uint64))
        self.mask = np.uint64((1 << FILTER_BITS) - 1)
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[self.tokens & self.mask] = True

    def find(self, h):
        """(index into h, index into tokens) of the members."""
        at = np.flatnonzero(self.bits[h & self.mask])
        pos = np.searchsorted(self.tokens, h[at])
        pos[pos == len(self.tokens)] = 0
        ok = self.tokens[pos] == h[at] if len(self.tokens) else np.zeros(len(at), bool)
        return at[ok], pos[ok]


def _count(shared):
    def run(batches):
        by_k = {k: Probe(t) for k, t in shared.value.items()}
        sums = {k: np.zeros(len(p.tokens), np.int64) for k, p in by_k.items()}
        for batch in batches:
            for _, data, offs in T.slices(batch.column(0)):
                h, rows = T.words(data, offs, T.ALNUM)
                for k, p in by_k.items():
                    _, pos = p.find(T.shingles(h, rows, k)[0])
                    sums[k] += np.bincount(pos, minlength=len(p.tokens))
        for k, p in by_k.items():
            some = np.flatnonzero(sums[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(p.tokens[some].view(np.int64)), pa.array(sums[k][some])], ["token", "n"])
    return run


def rarest(shingles, counts: dict[int, int], n_windows: int):
    """The rarest shingle of each window (ties: the smaller hash), as {k: [(token, window, offset)]}."""
    best: list = [None] * n_windows
    for w, off, k, tok in shingles:
        key = (counts.get(tok, 0), tok, off)
        if best[w] is None or key < best[w][0]:
            best[w] = (key, k)
    out: dict[int, list] = {}
    for w, ((_, tok, off), k) in enumerate(best):
        out.setdefault(k, []).append((tok, w, off))
    return out


def verify(h, rows, plan, mat, lens):
    """(document row, first word, window) of every occurrence in a slice of documents."""
    found = []
    for k, (probe, win, off, first) in plan.items():
        sh, at = T.shingles(h, rows, k)
        i, tok = probe.find(sh)
        if len(i) == 0:
            continue
        reps = first[tok + 1] - first[tok]
        pos = np.repeat(at[i], reps)
        e = np.arange(len(pos)) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(first[tok], reps)
        w, start = win[e], pos - off[e]
        row = T.row_of(rows, pos)
        ok = (start >= rows[row]) & (start + lens[w] <= rows[row + 1])     # positional and length bounds
        w, start, row = w[ok], start[ok], row[ok]
        for j in range(mat.shape[1]):
            ok = (j >= lens[w]) | (h[np.minimum(start + j, len(h) - 1)] == mat[w, j])
            w, start, row = w[ok], start[ok], row[ok]
        found.append((row, start, w))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z
    return tuple(np.concatenate(x) for x in zip(*found))


def _join(blocks):
    """Hit words and items of each row, over all blocks."""
    def run(batches):
        loaded = []
        for shared in blocks:
            ids, mat, lens, owners, prefix = shared.value
            plan = {}
            for k, rows in prefix.items():
                rows = sorted(rows)
                tok = np.array([r[0] for r in rows], np.uint64)
                probe = Probe(tok)
                plan[k] = (probe, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]),
                           np.append(np.searchsorted(tok, probe.tokens), len(tok)))
            loaded.append((ids, mat, lens, owners, plan))
        for batch in batches:
            n_words, n_hit, items = [], [], []
            for _, data, offs in T.slices(batch.column("text")):
                h, rows = T.words(data, offs, T.ALNUM)
                edge = np.zeros(len(h) + 1, np.int64)
                got: dict[int, set] = {}
                for ids, mat, lens, owners, plan in loaded:
                    row, start, w = verify(h, rows, plan, mat, lens)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + lens[w], -1)
                    for r, x in set(zip(row.tolist(), w.tolist())):
                        got.setdefault(r, set()).update(ids[o] for o in owners[x] if ids[o] is not None)
                hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
                n_words += np.diff(rows).tolist()
                n_hit += np.diff(hit[rows]).tolist()
                items += [sorted(got.get(r, ()), key=str) for r in range(len(rows) - 1)]
            keep = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                keep + [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                        pa.array(items, pa.list_(pa.int64()))],
                list(batch.schema.names) + ["__n_words", "__n_hit", "__items"])
    return run


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                       block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` (column ``text``) with __n_words, __n_hit and __items (sorted as strings)."""
    sc, blocks = docs.sparkSession.sparkContext, []
    for block in _item_blocks(items.select(F.col("item_id").cast("long"), "text"), block_words):
        mat, lens, owners = item_windows(block, window, shingle)
        sh = window_shingles(mat, lens, shingle)
        tokens: dict[int, list] = {}
        for _, _, k, tok in sh:
            tokens.setdefault(k, []).append(tok)
        counted = (docs.select("text").mapInArrow(_count(sc.broadcast(
            {k: np.unique(np.array(t, np.uint64)) for k, t in tokens.items()})), "token long, n long")
            .groupBy("token").agg(F.sum("n").alias("n")).collect())       # at most the block's shingles
        counts = {r["token"] % (1 << 64): r["n"] for r in counted}
        blocks.append(sc.broadcast(([i for i, _ in block], mat, lens, owners,
                                    rarest(sh, counts, len(mat)))))
    schema = StructType(docs.schema.fields + [StructField("__n_words", LongType()),
                                              StructField("__n_hit", LongType()),
                                              StructField("__items", ArrayType(LongType()))])
    return docs.mapInArrow(_join(blocks), schema)


def contaminated():
    """At least a twentieth of the words lie in benchmark windows."""
    return (F.col("__n_hit") > 0) & (20 * F.col("__n_hit") >= F.col("__n_words"))


def report(docs: DataFrame, items: DataFrame, **params) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    found = find_contamination(docs.select("doc_id", "text"), items, **params)
    joined = F.concat_ws(",", F.transform("__items", lambda x: x.cast("string")))
    return found.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"),
                        F.size("__items").cast("long").alias("n_items"),
                        F.sha2(joined, 256).alias("items_sha256"), contaminated().alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **params) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    found = find_contamination(docs, items, **params)
    return found.where(~contaminated()).select(*docs.columns)

