"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from the whole text's bytes, vectorised over a batch.
The trees are grown level by level on binned statistics (at most ``BINS``
quantile bins) with logistic loss; each is a full binary tree, so the model is
three flat arrays and scoring is ``depth`` gathers for all rows and trees.

The fit uses a bounded sample: at most ``FIT_ROWS`` labelled rows, those with
the smallest hash of their doc_id, of the rows that are not held out
(crc32(doc_id as text) mod 4 is not 2).  Rows whose labels contradict each
other or are null teach nothing; at most twice as many document rows are used where
ids repeat.  Only the sample's statistics reach the
driver; scores are computed for every row.

Null and empty texts have all-zero statistics and get a score too.  A null
doc_id is scored and not held out; repeated rows get equal scores; without any
label every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import textbytes as T
from .common import crc_rest

FIT_ROWS, BINS, TREES, DEPTH, RATE, THRESHOLD = 20_000, 64, 150, 4, 0.1, 0.7
_CLASS = np.zeros(256, np.int64)                 # 0 sign, 1 lower, 2 upper, 3 digit, 4 space, 5 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 5
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
NAMES = ("bytes words mean_word max_word signs upper digits spaces foreign sign_ends stops sign_words short_words "
         "distinct_words top_word twin_words distinct_pairs lines distinct_lines line_words entropy").split()


def _sums(values, rows):
    """Sum of each row's values under CSR offsets."""
    acc = np.concatenate([[0], np.cumsum(values)])
    return acc[rows[1:]] - acc[rows[:-1]]


def _distinct(hashes, rows):
    """(number of distinct hashes, largest count) of each row."""
    r = T.row_of(rows, np.arange(len(hashes)))
    order = np.lexsort((hashes, r))
    h, r = hashes[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(len(rows) - 1, np.int64)
    np.maximum.at(top, r[at], np.diff(np.append(at, len(h))))
    return np.bincount(r[at], minlength=len(rows) - 1), top


def statistics(data, offs):
    """(rows, len(NAMES)) statistics of a slice of texts."""
    n, size = len(offs) - 1, np.diff(offs)
    starts, ends = T.runs(T.SPACED[data], offs)
    rows = np.searchsorted(starts, offs)
    h = T.span_hashes(data, starts, ends)
    length = ends - starts
    words = np.diff(rows)
    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * 6 + _CLASS[data], minlength=n * 6).reshape(n, 6)
    counts = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256)
    per = np.maximum(size, 1)
    share = counts / per[:, None]
    entropy = -(share * np.log(np.where(share > 0, share, 1))).sum(1)
    letters = np.maximum(kinds[:, 1] + kinds[:, 2], 1)
    last = _CLASS[data[ends - 1]] if len(ends) else np.zeros(0, np.int64)
    stop = np.isin(data[ends - 1], [44, 46]) if len(ends) else np.zeros(0, bool)
    solid = np.concatenate([[0], np.cumsum(np.isin(_CLASS[data], [1, 2, 3, 5]))])
    w = np.maximum(words, 1)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, T.row_of(rows, np.arange(len(h))), length)
    distinct, top = _distinct(h, rows)
    twin = np.zeros(len(h), np.int64)
    twin[1:] = h[1:] == h[:-1]
    twin[rows[:-1][rows[:-1] < len(h)]] = 0
    pairs, at = T.shingles(h, rows, 2)
    pair_rows = np.searchsorted(at, rows)
    d_pairs, _ = _distinct(pairs, pair_rows)
    ls, le = T.runs(data != 10, offs)
    line_rows = np.searchsorted(ls, offs)
    lines = np.diff(line_rows)
    d_lines, _ = _distinct(T.span_hashes(data, ls, le), line_rows)
    return np.column_stack([
        np.log1p(size), np.log1p(words), _sums(length, rows) / w, np.log1p(longest),
        kinds[:, 0] / per, kinds[:, 2] / letters, kinds[:, 3] / per, kinds[:, 4] / per, kinds[:, 5] / per,
        _sums((last == 0) & ~stop, rows) / w, _sums(stop, rows) / w,
        _sums(solid[ends] == solid[starts], rows) / w, _sums(length <= 3, rows) / w,
        distinct / w, top / w, _sums(twin, rows) / w, d_pairs / np.maximum(np.diff(pair_rows), 1),
        np.log1p(lines), d_lines / np.maximum(lines, 1), words / np.maximum(lines, 1), entropy]).astype(np.float64)


def _table(batch_col):
    """Statistics of a whole Arrow column."""
    own = [statistics(data, offs) for _, data, offs in T.slices(batch_col)]
    return np.concatenate(own) if own else np.zeros((0, len(NAMES)))


class Trees:
    """Boosted full binary trees as flat arrays: feature and threshold by node, value by leaf."""

    def __init__(self, depth: int, base: float):
        self.depth, self.base = depth, base
        self.feature = np.zeros((0, 2 ** depth - 1), np.int64)
        self.limit = np.zeros((0, 2 ** depth - 1))
        self.value = np.zeros((0, 2 ** depth))

    def margin(self, x):
        out = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))
        for lo in range(0, len(x), 4096):
            own = x[lo:lo + 4096]
            node = np.zeros((len(own), len(trees)), np.int64)
            for _ in range(self.depth):
                f, t = self.feature[trees, node], self.limit[trees, node]
                node = 2 * node + 1 + (np.take_along_axis(own, f, 1) > t)
            out[lo:lo + 4096] += self.value[trees, node - (2 ** self.depth - 1)].sum(1)
        return out

    def score(self, x):
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x, y, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS,
        ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Grow ``trees`` trees; deterministic."""
    mean = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(depth, float(np.log(mean / (1 - mean))))
    if len(y) == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)])   # c <= e[i] -> code <= i
    p, inner = x.shape[1], 2 ** depth - 1
    margin = np.full(len(y), model.base)
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        node = np.zeros(len(y), np.int64)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            key = (node - first) * bins
            best_gain, best = np.full(width, 1e-9), np.full((width, 2), -1)
            for j in range(p):
                cell = key + code[:, j]
                sg = np.bincount(cell, g, width * bins).reshape(width, bins).cumsum(1)
                sh = np.bincount(cell, h, width * bins).reshape(width, bins).cumsum(1)
                tg, th = sg[:, -1:], sh[:, -1:]
                gain = sg**2 / (sh + ridge) + (tg - sg)**2 / (th - sh + ridge) - tg**2 / (th + ridge)
                gain[(sh < least) | (th - sh < least)] = 0
                gain = gain[:, :len(edges[j])]
                if gain.shape[1] == 0:
                    continue
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best_gain
                best_gain[better] = top[better]
                best[better] = np.column_stack([np.full(width, j), at])[better]
            for i in np.flatnonzero(best[:, 0] >= 0):
                feature[first + i], limit[first + i] = best[i, 0], edges[best[i, 0]][best[i, 1]]
            f = feature[node]
            node = 2 * node + 1 + (x[np.arange(len(y)), f] > limit[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += value[leaf]
        model.feature = np.vstack([model.feature, feature])
        model.limit = np.vstack([model.limit, limit])
        model.value = np.vstack([model.value, value])
    return model


def held_out():
    return F.coalesce(crc_rest("doc_id") == 2, F.lit(False))


def _rows(batches):
    for batch in batches:
        x = _table(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"),
             pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES), pa.array(x.ravel()))],
            ["doc_id", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, **params) -> Trees:
    """Fit on at most ``fit_rows`` labelled, not held-out rows."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("__top"))
             .where(F.col("quality") == F.col("__top")).drop("__top")
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    rows = (own.select("doc_id", "quality", "text").mapInArrow(_rows, "doc_id long, quality int, x array<double>")
            .orderBy("doc_id", "x").limit(2 * fit_rows).collect())
    x = np.array([r["x"] for r in rows], np.float64).reshape(-1, len(NAMES))
    return fit(x, np.array([r["quality"] for r in rows], np.float64), **params)


def scored(docs: DataFrame, model: Trees) -> DataFrame:
    """``docs`` with __score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = shared.value.score(_table(batch.column("text")))
            yield pa.RecordBatch.from_arrays(list(batch.columns) + [pa.array(s)], list(batch.schema.names) + ["__score"])

    return docs.mapInArrow(run, StructType(docs.schema.fields + [StructField("__score", DoubleType())]))


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **params) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels, **params))
    return out.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"),
                      (F.col("__score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **params) -> DataFrame:
    """The documents that the classifier accepts, with their own columns."""
    return scored(docs, train(docs, labels, **params)).where(F.col("__score") >= threshold).select(*docs.columns)
