"""Chunking, hashed vectors, top-k search, rerank and extractive answers.

T4-T14 J7 J9 W4 W5 U3 A15 E21 SNK5.

Vectors are sparse rows ``(id, bucket, w)`` with unit L2 norm.  Exact top-k
search scores every (query, chunk) pair -- the operator's definition -- but
never as rows: each pair of a query block and an item block, both of bounded
size, is one matrix product in one task, of which the k best per query leave.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gtspark import config as C
from gtspark.functions import text as X
from gtspark.session import materialise, shuffled

RANK_DIGITS = 9  # scores are ranked after rounding, so summation order cannot flip ties


# ---------------------------------------------------------------------------
# T4 chunking
# ---------------------------------------------------------------------------

def chunk_docs(docs: DataFrame, size=C.CHUNK_SIZE, overlap=C.CHUNK_OVERLAP,
               id_col: str = "doc_id", text_col: str = "text", keep: tuple = (), words_col: str | None = None) -> DataFrame:
    """Word windows of ``size`` words stepping by max(1, size - overlap).

    Output (doc_id, *keep, chunk_id = 'doc::i', ordinal, text).  A window
    reaching the last word ends the document; empty text gives no chunk.
    ``size`` and ``overlap`` are numbers or columns of ``docs``.  The words
    array is produced by a generator so the per-chunk slices read a
    materialised column instead of re-running the regex per chunk; documents
    whose words are cut already name them in ``words_col``.
    """
    size = size if isinstance(size, Column) else F.lit(size or C.CHUNK_SIZE)
    overlap = overlap if isinstance(overlap, Column) else F.lit(C.CHUNK_OVERLAP if overlap is None else overlap)
    w = docs.select(F.col(id_col).cast("string").alias("doc_id"), *keep, size.cast("int").alias("_size"),
                    F.greatest(F.lit(1), size - overlap).cast("int").alias("_step"),
                    F.col(words_col).alias("_w") if words_col else F.explode(F.array(X.words(text_col))).alias("_w"))
    n = F.size("_w")
    last = F.least(F.greatest(F.lit(0), F.ceil((n - F.col("_size")) / F.col("_step"))).cast("int"),
                   (F.ceil(n / F.col("_step")) - 1).cast("int"))
    texts = F.transform(F.sequence(F.lit(0), last),
                        lambda i: F.array_join(F.slice(F.col("_w"), i * F.col("_step") + 1, F.col("_size")), " "))
    out = w.filter(n > 0).select("doc_id", *keep, F.posexplode(texts).alias("ordinal", "text"))
    return out.select("doc_id", *keep, F.concat(F.col("doc_id"), F.lit("::"), F.col("ordinal").cast("string"))
                      .alias("chunk_id"), "ordinal", "text")


# ---------------------------------------------------------------------------
# T5 hashed sparse vectors
# ---------------------------------------------------------------------------

HELD_COUNTS = 500_000     # most counts of texts that are counted at once
HELD_BYTES = 1_000_000    # and most bytes of such texts; one text is never cut
TOKEN_BYTES = np.zeros(256, dtype=bool)
TOKEN_BYTES[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True
MD5_ROWS = 8192           # grams hashed at once: they fit a processor's cache
MD5_TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().astype(np.uint32)
MD5_ADDED = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0 ** 32).astype(np.uint32)
MD5_WORDS = np.concatenate([np.arange(16) * m + a & 15 for m, a in ((1, 0), (5, 1), (3, 5), (7, 0))])
MD5_MIX = (lambda x, y, z: z ^ (x & (y ^ z)), lambda x, y, z: y ^ (z & (x ^ y)), lambda x, y, z: x ^ y ^ z, lambda x, y, z: y ^ (x | ~z))


def _count_table(rows, names, kinds):
    cols = list(zip(*rows))
    types = [*kinds, pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [*names, "n", "b", "c", "norm"])


def _count_rows(key, group):
    return [(key, *kept, n, list(c), list(c.values()), math.sqrt(sum(v * v for v in c.values())))
            for kept, (n, c) in group.items()]


def _slices(texts, dim: int):
    """Bounds of runs of texts that are counted at once."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    most, lo = max(1, HELD_COUNTS // dim), 0
    while lo < len(ends):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + HELD_BYTES, side="right"))
        hi = max(lo + 1, min(hi, lo + most))
        yield lo, hi
        lo = hi


def _token_runs(texts):
    """Row and code of each token of lower-case texts, in order, and the different tokens."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    at = at - at[0]
    inside = TOKEN_BYTES[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]              # no token runs on into the next text
    first[cut], last[cut - 1] = inside[cut], inside[cut - 1]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    places = np.concatenate([[0], np.cumsum(last - first + 1)]).astype(np.int64)
    tokens = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(places), pa.py_buffer(data[inside])])
    coded = tokens.dictionary_encode()
    return np.searchsorted(at[1:], first, side="right"), coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _short_md5(data, at, size):
    """md5 of byte strings of at most 55 bytes, all at once: (strings, 2) big-endian halves."""
    n = np.arange(len(size))
    row = np.repeat(n, size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    block = np.zeros((len(size), 64), dtype=np.uint8)
    block[row, place] = data[at[row] + place]
    block[n, size] = 0x80
    words = np.ascontiguousarray(block.view("<u4").T.astype(np.uint32))
    words[14] = size * 8
    start = [np.full(len(size), x, dtype=np.uint32) for x in (0x67452301, 0xefcdab89, 0x98badcfe, 0x10325476)]
    a, b, c, d = start
    for i in range(64):
        mix = MD5_MIX[i // 16](b, c, d)
        mix += a
        mix += words[MD5_WORDS[i]]
        mix += MD5_ADDED[i]
        left = mix << MD5_TURNS[i]
        mix >>= np.uint32(32) - MD5_TURNS[i]
        left |= mix
        left += b
        a, d, c, b = d, c, b, left
    parts = [(x + y).byteswap().astype(np.uint64) for x, y in zip(start, (a, b, c, d))]
    return np.stack([parts[0] << np.uint64(32) | parts[1], parts[2] << np.uint64(32) | parts[3]], axis=1)


def _buckets(grams, dim: int):
    """md5 mod ``dim`` of each gram of an array of bytes."""
    at = np.frombuffer(grams.buffers()[1], np.int64)[grams.offset:grams.offset + len(grams) + 1]
    data = np.frombuffer(grams.buffers()[2] or b"", np.uint8)
    size = np.diff(at)
    halves = np.empty((len(grams), 2), dtype=np.uint64)
    short = np.flatnonzero(size <= 55)
    for lo in range(0, len(short), MD5_ROWS):
        some = short[lo:lo + MD5_ROWS]
        halves[some] = _short_md5(data, at[some], size[some])
    for i in np.flatnonzero(size > 55):
        halves[i] = np.frombuffer(hashlib.md5(data[at[i]:at[i + 1]].tobytes()).digest(), ">u8")
    d = np.uint64(dim)
    return ((halves[:, 0] % d * np.uint64(2 ** 64 % dim) + halves[:, 1] % d) % d).astype(np.int64)


def _gram_counts(texts, group, groups: int, dim: int):
    """(group, bucket, count) of the uni- and bigrams of lower-case texts, in order; ``group`` is each text's."""
    row, code, words = _token_runs(texts)
    near = np.flatnonzero(row[1:] == row[:-1])
    pair, pairs = pd.factorize(code[near] * len(words) + code[near + 1])
    left, right = np.divmod(pairs, max(1, len(words)))
    bigrams = pc.binary_join_element_wise(words.take(pa.array(left)), words.take(pa.array(right)), pa.scalar(b"_", pa.large_binary()))
    cell = np.concatenate([group[row] * dim + _buckets(words, dim)[code], group[row[near]] * dim + _buckets(bigrams, dim)[pair]])
    if groups * dim <= 2 * HELD_COUNTS:
        counts = np.bincount(cell, minlength=groups * dim)
        cell = np.flatnonzero(counts)
        counts = counts[cell]
    else:                                                                   # few of very many buckets
        cell, counts = np.unique(cell, return_counts=True)
    return cell // dim, cell % dim, counts


def _groups(columns):
    """First row of each different combination of values, and each row's combination."""
    code = np.zeros(len(columns[0]), dtype=np.int64)
    for col in columns:
        coded = col.dictionary_encode(null_encoding="encode")
        code = pd.factorize(code * (len(coded.dictionary) + 1) + coded.indices.to_numpy(zero_copy_only=False))[0]
    return np.unique(code, return_index=True)[1], code


def _count_grams(names: tuple, dim: int, bits: bool = False):
    """Map function over lower-case texts: (id, *keep, n, b, c, norm), or (id, *keep, n, v) with the counts as ``_to_bits``.

    Rows of an id and keep values that are counted at once are joined.
    """
    def table(part, texts):
        first, group = _groups(part.columns)
        g, b, c = _gram_counts(texts, group, len(first), dim)
        cols = [*[col.take(pa.array(first)) for col in part.columns], pa.array(np.bincount(group, minlength=len(first)), pa.int64())]
        if bits:
            counts = np.zeros((len(first), dim), dtype=np.int64)
            counts[g, b] = c
            return pa.RecordBatch.from_arrays([*cols, pa.array(_to_bits(counts), pa.binary())], [*names, "n", "v"])
        at = pa.array(np.searchsorted(g, np.arange(len(first) + 1)), pa.int32())
        norm = np.sqrt(np.bincount(g, weights=(c * c).astype(np.float64), minlength=len(first)))
        return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(at, pa.array(b, pa.int32())),
                                           pa.ListArray.from_arrays(at, pa.array(c, pa.int64())), pa.array(norm)], [*names, "n", "b", "c", "norm"])

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.columns[-1].cast(pa.large_string()), "")
            for lo, hi in _slices(texts, dim):
                part = batch.slice(lo, hi - lo)
                yield table(part.select(batch.schema.names[:-1]), texts.slice(lo, hi - lo))

    return run


def _to_bits(counts) -> list:
    """Each row of counts in about two bits a bucket and, where they are large, the bits of their mean.

    A byte says how many low bits are kept as they are, bucket by bucket; what is
    above them follows as so many zeros before a one.
    """
    n, dim = counts.shape
    low = np.log2(np.maximum(1, counts.sum(axis=1) // dim)).astype(np.int64)
    rows = [b""] * n
    for s in np.unique(low):
        idx = np.flatnonzero(low == s)
        part = counts[idx]
        kept = np.packbits((part[:, :, None] >> np.arange(s) & 1).astype(np.uint8).reshape(len(idx), -1), axis=1)
        ones = np.cumsum(part >> s, axis=1) + np.arange(dim)
        at = np.concatenate([[0], np.cumsum((ones[:, -1] + 8) // 8)])
        bits = np.zeros(8 * at[-1], dtype=np.uint8)
        bits[8 * at[:-1, None] + ones] = 1
        packed, head = np.packbits(bits).tobytes(), bytes([s])
        for i, k, lo, hi in zip(idx.tolist(), kept, at.tolist(), at[1:].tolist()):
            rows[i] = head + k.tobytes() + packed[lo:hi]
    return rows


def _from_bits(rows: list, dim: int) -> np.ndarray:
    """The counts of ``_to_bits``; none for a null."""
    counts = np.zeros((len(rows), dim), dtype=np.int64)
    low = np.array([-1 if r is None else r[0] for r in rows], dtype=np.int64)
    for s in np.unique(low[low >= 0]):
        idx = np.flatnonzero(low == s)
        size = 1 + (dim * int(s) + 7) // 8
        at = np.concatenate([[0], np.cumsum([len(rows[i]) - size for i in idx])])
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(b"".join([rows[i][size:] for i in idx]), np.uint8))).reshape(-1, dim)
        high = np.diff(ones - 8 * at[:-1, None], axis=1, prepend=-1) - 1
        if s:
            kept = np.frombuffer(b"".join([rows[i][1:size] for i in idx]), np.uint8).reshape(len(idx), -1)
            bits = np.unpackbits(kept, axis=1)[:, :dim * s].reshape(len(idx), dim, s).astype(np.int64)
            high = (high << s) + (bits << np.arange(s)).sum(axis=2)
        counts[idx] = high
    return counts


def _bits_of_counts(names: tuple, dim: int):
    """Map function: rows (*names, b, c) with their counts as ``_to_bits``."""
    def run(batches):
        most = max(1, HELD_COUNTS // dim)
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                part = batch.slice(lo, most)
                b, c = part.column("b"), part.column("c")
                counts = np.zeros((part.num_rows, dim), dtype=np.int64)
                counts[pc.list_parent_indices(b).to_numpy(), b.flatten().to_numpy()] = c.flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([*[part.column(x) for x in names], pa.array(_to_bits(counts), pa.binary())], [*names, "v"])

    return run


def _join_counts(names: tuple):
    """Map function over rows of ``_count_grams`` sorted by id: one row per id and keep values."""
    def add(group, rows):
        for row in zip(*[col.to_pylist() for col in rows.columns[1:]]):
            *kept, n, b, c, _ = row
            m, counts = group.get(tuple(kept), (0, {}))
            for x, y in zip(b, c):
                counts[x] = counts.get(x, 0) + y
            group[tuple(kept)] = (m + n, counts)

    def run(batches):
        key, group, kinds = None, {}, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            kinds = kinds or [f.type for f in batch.schema][:-4]
            ids = batch.column(0).to_pylist()
            cuts = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
            alone, joined = [], []
            for lo, hi in zip(cuts, cuts[1:]):
                if group and ids[lo] != key:
                    joined += _count_rows(key, group)
                    group = {}
                if not group and hi - lo == 1 and hi < len(ids):       # an id with one row stays as it is
                    alone.append(lo)
                else:
                    key = ids[lo]
                    add(group, batch.slice(lo, hi - lo))
            if alone:
                yield batch.take(pa.array(alone))
            if joined:
                yield _count_table(joined, names, kinds)
        if group:
            yield _count_table(_count_rows(key, group), names, kinds)

    return run


PART_BYTES = 32_000_000   # most bytes of counts a partition is meant to sort


def _parts(rows: int, dim: int) -> int:
    """Partitions of ``rows`` count rows, 12 bytes an entry and at most ``dim`` entries each."""
    return max(1, math.ceil(rows * (12 * dim + 100) / PART_BYTES))


def embed_packed(df: DataFrame, id_col: str = "id", text_col: str = "text",
                 dim: int = C.EMBEDDING_DIM, keep: tuple = (), bits: bool = False) -> DataFrame:
    """Hashed uni+bigram counts, one row per text: (id, *keep, n, b buckets, c counts, norm).

    Texts are dealt by id, unsorted, to as many partitions as keep small the
    sort of their counts, by which rows that share an id are joined; texts
    counted at once give an id one row however many it has there.  Such rows are
    one text of ``n`` rows.  A text with no tokens has empty arrays and norm 0.

    With ``bits`` the texts are counted where they are and no text is moved:
    (id, *keep, n, v) with the counts as ``_to_bits``, about a tenth of a long
    text, and the rows of an id are left for ``topk_counted`` to join.
    """
    names = ("id", *keep)
    if bits:
        t = df.select(F.col(id_col).alias("id"), *keep, F.lower(text_col).alias("_txt"))
        fields = [f"`{n}` {t.schema[n].dataType.simpleString()}" for n in names]
        return t.mapInArrow(_count_grams(names, dim, bits=True), ", ".join([*fields, "n bigint, v binary"]))
    t = df.select(F.col(id_col).alias("id"), *keep, F.array_join(X.tokens(text_col), " ").alias("_txt"))
    fields = [f"`{n}` {t.schema[n].dataType.simpleString()}" for n in names]
    schema = ", ".join([*fields, "n bigint, b array<int>, c array<bigint>, norm double"])
    parts = max(df.sparkSession.sparkContext.defaultParallelism, _parts(df.count(), dim))
    return (t.repartition(parts, "id").mapInArrow(_count_grams(names, dim), schema)
            .sortWithinPartitions("id").mapInArrow(_join_counts(names), schema))


def embed(df: DataFrame, id_col: str = "id", text_col: str = "text",
          dim: int = C.EMBEDDING_DIM, keep: tuple = ()) -> DataFrame:
    """Hashed uni+bigram counts per text, L2-normalised: (id, *keep, bucket, w).

    A text with no tokens has no rows (the zero vector).  ``keep`` columns
    (functions of the id) ride along.
    """
    p = embed_packed(df, id_col, text_col, dim, keep)
    return (p.select("id", *keep, "norm", F.explode(F.arrays_zip("b", "c")).alias("_e"))
            .select("id", *keep, F.col("_e.b").alias("bucket"), (F.col("_e.c") / F.col("norm")).alias("w")))


# ---------------------------------------------------------------------------
# T7 exact top-k search (dense scoring of sparse vectors)
# ---------------------------------------------------------------------------

def _to_packed(vec: DataFrame) -> DataFrame:
    """(id, bucket, w) -> (id, b array, w array); at most dim entries per id."""
    return vec.groupBy("id").agg(F.collect_list("bucket").alias("b"), F.collect_list("w").alias("w"))


def _sparse_matrix(pdf, dim: int) -> np.ndarray:
    m = np.zeros((len(pdf), dim), dtype=np.float64)
    for r, (b, w) in enumerate(zip(pdf["b"], pdf["w"])):
        if b is not None and len(b):
            m[r, np.asarray(b, dtype=np.int64)] = np.asarray(w, dtype=np.float64)
    return m


def _counted_matrix(pdf, dim: int) -> np.ndarray:
    m = np.empty((len(pdf), dim), dtype=np.float64)
    for lo in range(0, len(pdf), TILE_ROWS):
        c = _from_bits(pdf["v"].iloc[lo:lo + TILE_ROWS].tolist(), dim)
        norm = np.sqrt((c * c).sum(axis=1).astype(np.float64))
        np.divide(c, np.where(norm == 0, 1.0, norm)[:, None], out=m[lo:lo + len(c)])
    return m


def _joined(pdf, dim: int, copies: int):
    """Rows of a block sorted by id with an id's counts added up, each id up to ``copies`` times as it had texts."""
    ids = pdf["id"]
    again = (ids.eq(ids.shift()) | ids.isna() & ids.shift().isna()).to_numpy()
    again[:1] = False
    if again.any():
        at = np.flatnonzero(~again)
        counts = np.add.reduceat(_from_bits(pdf["v"].tolist(), dim), at, axis=0)
        pdf = pdf.iloc[at].assign(v=_to_bits(counts), n=np.add.reduceat(pdf["n"].to_numpy(), at))
    return pdf.iloc[np.repeat(np.arange(len(pdf)), np.minimum(pdf["n"].to_numpy(), copies))]


def _array_matrix(pdf, dim: int) -> np.ndarray:
    m = np.zeros((len(pdf), dim), dtype=np.float64)
    for r, v in enumerate(pdf["vec"]):
        if v is not None and len(v):
            m[r, :len(v)] = np.asarray(v, dtype=np.float64)
    return m


TILE_ROWS = 2048   # vectors of a side in one matrix product: bounds the score matrix of a task


def _local_topk(qids, qmat, cids, cmat, k, digits, unit):
    """k best items of each query in one block pair; ``cids`` ascending, so ties go to the smaller id.

    Scored tile by tile; after the first few items only those above a query's
    k-th best score are looked at.
    """
    if not unit:  # unit (or zero) vectors need no norms: cosine = dot / (1 + 1e-9)
        qn, cn = (np.sqrt((m * m).sum(axis=1)) for m in (qmat, cmat))
    cuts = [0, *range(min(256, len(cids)), len(cids), TILE_ROWS), len(cids)]
    parts = []
    for at in range(0, len(qids), TILE_ROWS):
        q = qmat[at:at + TILE_ROWS]
        rows, cols, vals = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        kth = np.full(len(q), -np.inf)
        for lo, hi in zip(cuts, cuts[1:]):
            sims = q @ cmat[lo:hi].T
            sims /= 1.0 + 1e-9 if unit else np.outer(qn[at:at + TILE_ROWS], cn[lo:hi]) + 1e-9
            if lo == 0 or np.isinf(kth).any():               # not k scores yet: undefined ones come last
                sims = np.where(np.isnan(sims), -np.inf, np.round(sims, digits))
                best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                r, c = np.repeat(np.arange(len(q)), best.shape[1]), best.ravel()
                v = sims[r, c]
            else:
                r, c = np.nonzero(sims > kth[:, None] + 0.25 * 10.0 ** -digits)
                v = np.round(sims[r, c], digits)
            rows, cols, vals = np.concatenate([rows, r]), np.concatenate([cols, c + lo]), np.concatenate([vals, v])
            order = np.lexsort((cols, -vals, rows))
            rows, cols, vals = rows[order], cols[order], vals[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            rows, cols, vals = rows[place < k], cols[place < k], vals[place < k]
            full = np.bincount(rows, minlength=len(q)) >= k
            last = np.searchsorted(rows, np.arange(len(q)), side="right") - 1
            kth = np.where(full, vals[last], -np.inf)
        parts.append(pd.DataFrame({"query_id": qids[at + rows], "item_id": cids[cols],
                                   "score": np.where(np.isinf(vals), np.nan, vals)}))
    return pd.concat(parts, ignore_index=True)


BLOCK_ROWS = 2048          # least vectors of a side in one block
MOST_BLOCK_ROWS = 16_384   # and most: bounds the vectors of a task
MOST_PARTS = 20_000        # partitions of pairs of blocks
COPIES = 16                # blocks grow before a vector is copied more often than this


def _block_rows(n: int) -> int:
    return min(MOST_BLOCK_ROWS, max(BLOCK_ROWS, math.ceil(n / COPIES)))


def _topk_blocks(packed_q: DataFrame, packed_items: DataFrame, k: int, dim: int,
                 to_matrix, unit: bool, block_rows: int | None, digits: int) -> DataFrame:
    """Every query block meets every item block in a task of its own.

    The vectors are written once (so counts and blocks see the same rows) and
    dealt by hash of their id; each side is copied to the other side's blocks
    by a shuffle, nothing passes through the driver.  Items may have a ``grp``
    (a few indexes side by side, E12): every query is then searched in every
    group by itself.  Without ``block_rows`` a block's size follows from the
    number of vectors, between fixed bounds.  Where rows have ``n``, an id may
    have several, which meet in its block: they are one vector of ``n`` texts.
    """
    grouped = "grp" in packed_items.columns
    items = packed_items if grouped else packed_items.withColumn("grp", F.lit(""))
    q, items = materialise(packed_q, "queries"), materialise(items, "items")

    def blocks(n, most=False):
        return math.ceil(n / (block_rows or (MOST_BLOCK_ROWS if most else _block_rows(n))))

    counted = "n" in items.columns
    sizes = {r["grp"]: blocks(r["n"]) for r in
             items.groupBy("grp").agg((F.sum("n") if counted else F.count(F.lit(1))).alias("n")).collect()}
    n_q = max(1, blocks(q.count(), most=sum(sizes.values()) >= COPIES))   # items are copied n_q times
    groups = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(n).cast("bigint").alias("n")) for g, n in sizes.items()]
                     or [F.struct(F.lit("").alias("grp"), F.lit(1).cast("bigint").alias("n"))])
    n_of = F.element_at(F.map_from_entries(groups), F.col("grp"))

    def upto(n):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))

    def block(n):
        return F.pmod(F.xxhash64("id"), n)

    q_side = (q.select("*", F.explode(groups).alias("_g"))
              .select("*", block(F.lit(n_q)).alias("_qb"), F.col("_g.grp").alias("grp"), upto(F.col("_g.n")).alias("_ib"))
              .drop("_g").withColumn("_kind", F.lit(0)))
    i_side = items.select("*", block(n_of).alias("_ib"), upto(F.lit(n_q).cast("bigint")).alias("_qb")).withColumn("_kind", F.lit(1))
    both = q_side.unionByName(i_side)
    schema = "query_id string, item_id string, score double, grp string"

    def score(key, pdf):
        qs, its = pdf[pdf["_kind"] == 0], pdf[pdf["_kind"] == 1].sort_values("id")
        if len(qs) == 0 or len(its) == 0:
            return pd.DataFrame({"query_id": [], "item_id": [], "score": [], "grp": []})
        if counted:                                        # more than k copies of an item never leave
            qs, its = _joined(qs.sort_values("id"), dim, 1), _joined(its, dim, k)
        out = _local_topk(qs["id"].to_numpy(), to_matrix(qs, dim), its["id"].to_numpy(),
                          to_matrix(its, dim), k, digits, unit)
        return out.assign(grp=key[1])

    pairs = n_q * sum(sizes.values())                       # a task's sort holds one pair of blocks, seldom a few
    results = (both.repartition(min(MOST_PARTS, max(1, 2 * pairs)), "_qb", "grp", "_ib")
               .groupBy("_qb", "grp", "_ib").applyInPandas(score, schema))
    w = Window.partitionBy("query_id", "grp").orderBy(F.col("score").desc(), F.col("item_id"))
    best = results.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best if grouped else best.drop("grp")


def topk_dense(query_vec: DataFrame, item_vec: DataFrame, k: int = C.TOP_K,
               dim: int = C.EMBEDDING_DIM, block_rows: int | None = None,
               digits: int = RANK_DIGITS, item_ids: DataFrame | None = None,
               query_ids: DataFrame | None = None) -> DataFrame:
    """Exact cosine top-k of every query over every item.

    Inputs are sparse unit vectors (id, bucket, w); output (query_id,
    item_id, score, rank).  ``item_ids`` and ``query_ids`` list texts that may
    have no token: those are zero vectors, score 0 and still take part.  Each
    block pair keeps k candidates per query.  ``digits`` is a parameter of the
    ranking: scores are rounded to it before they are compared, so that the
    summation order cannot flip ties; ties go to the smaller item id.  A
    ``grp`` column of ``item_ids`` keeps several indexes apart.
    """
    def packed(vec, ids):
        v = _to_packed(vec)
        keep = []
        if ids is not None:
            keep = [c for c in ids.columns if c == "grp"]
            v = ids.select(F.col(ids.columns[0]).alias("id"), *keep).join(v, "id", "left")
        return v.select(F.col("id").cast("string").alias("id"), *keep, "b", "w")

    return _topk_blocks(packed(query_vec, query_ids), packed(item_vec, item_ids), k, dim,
                        _sparse_matrix, True, block_rows, digits)


def topk_counted(queries: DataFrame, items: DataFrame, k: int = C.TOP_K, dim: int = C.EMBEDDING_DIM,
                 block_rows: int | None = None, digits: int = RANK_DIGITS) -> DataFrame:
    """T7 on ``embed_packed`` rows: as ``topk_dense`` with all ids listed, the vectors counts and norms.

    Every row of an item's id takes part, a query's id once; a null id is a
    zero vector.  Counts are stored and dealt as bits.
    """
    def packed(p):
        keep = ["grp"] if "grp" in p.columns else []
        if "v" not in p.columns:
            t = p.select("id", *keep, "n", "b", "c")
            fields = [f"`{x}` {t.schema[x].dataType.simpleString()}" for x in ("id", *keep, "n")]
            p = t.mapInArrow(_bits_of_counts(("id", *keep, "n"), dim), ", ".join([*fields, "v binary"]))
        return p.select(F.col("id").cast("string").alias("id"), *keep, "n", F.when(F.col("id").isNotNull(), F.col("v")).alias("v"))

    return _topk_blocks(packed(queries), packed(items), k, dim, _counted_matrix, True, block_rows, digits)


def topk_arrays(queries: DataFrame, items: DataFrame, k: int = C.TOP_K, dim: int | None = None,
                id_col: str = "id", vec_col: str = "vec", block_rows: int | None = None,
                digits: int = RANK_DIGITS) -> DataFrame:
    """T6 + T7 on dense array columns: cosine = dot / (|a||b| + 1e-9)."""
    def vectors(d):                                        # single precision travels as it is, products are double
        kind = d.schema[vec_col].dataType.simpleString()
        return d.select(F.col(id_col).cast("string").alias("id"),
                        F.col(vec_col).cast(kind if kind == "array<float>" else "array<double>").alias("vec"))

    q, it = vectors(queries), vectors(items)
    if dim is None:
        dim = it.agg(F.max(F.size("vec"))).first()[0] or 0
    return _topk_blocks(q, it, k, int(dim), _array_matrix, False, block_rows, digits)


# ---------------------------------------------------------------------------
# T8 rerank, T9 retrieve
# ---------------------------------------------------------------------------

def rerank(hits: DataFrame, queries: DataFrame, items: DataFrame, strategy: str = "lexical",
           digits: int = RANK_DIGITS) -> DataFrame:
    """score = 0.5*score + 0.5*overlap(query, text) over the same candidates.

    ``hits`` (query_id, item_id, score, rank); ``queries`` (query_id, query);
    ``items`` (item_id, text).  'none' keeps the order.
    """
    wanted = hits.select("item_id").distinct().hint("shuffle_hash")     # texts stream past the ids, unsorted
    h = (hits.join(shuffled(queries.select("query_id", "query")), "query_id")
         .join(shuffled(items.join(wanted, "item_id", "leftsemi")), "item_id"))
    if strategy == "none":
        return h
    if strategy != "lexical":
        raise ValueError(f"strategy must be lexical or none, not {strategy!r}")
    s = F.round(0.5 * F.col("score") + 0.5 * X.overlap(X.tokens("query"), X.tokens("text")), digits)
    h = h.withColumn("score", s)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("rank"))
    return h.withColumn("rank", F.row_number().over(w))


def retrieve(queries: DataFrame, chunks: DataFrame, chunk_vec: DataFrame | None = None,
             k: int = C.TOP_K, top_k: int = C.TOP_K, strategy: str = "lexical",
             dim: int = C.EMBEDDING_DIM) -> DataFrame:
    """Embed queries, search max(k, top_k), rerank, cut to k.

    ``queries`` (query_id, query); ``chunks`` (chunk_id, doc_id, text);
    ``chunk_vec`` a persisted index (SNK5) if one exists.
    Returns (query_id, rank, chunk_id, doc_id, text, score).
    """
    n = max(k, top_k)
    if chunk_vec is None:                                  # ids, vectors and texts come from one stored cut
        chunks = materialise(chunks, "chunks")
        hits = topk_counted(embed_packed(queries, "query_id", "query", dim),
                            embed_packed(chunks, "chunk_id", "text", dim), n, dim)
    else:
        hits = topk_dense(embed(queries, "query_id", "query", dim), chunk_vec, n, dim,
                          item_ids=chunks.select("chunk_id"), query_ids=queries.select("query_id").distinct())
    items = chunks.select(F.col("chunk_id").alias("item_id"), "doc_id", "text")
    r = rerank(hits, queries, items, strategy).filter(F.col("rank") <= k)
    r = r.select("query_id", "rank", F.col("item_id").alias("chunk_id"), "doc_id", "text", "score")
    return materialise(r, "hits")  # at most k rows a query; answers and metrics read it many times


# ---------------------------------------------------------------------------
# SNK5 persisted index
# ---------------------------------------------------------------------------

def save_index(chunks: DataFrame, path: str, dim: int = C.EMBEDDING_DIM) -> None:
    """Write the chunk table and its vectors under ``path``; a rerun writes the same index."""
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    stored = chunks.sparkSession.read.parquet(f"{path}/chunks")
    embed(stored, "chunk_id", "text", dim).write.mode("overwrite").parquet(f"{path}/vectors")


def load_index(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, vectors) of a saved index, for ``retrieve(..., chunk_vec=...)``."""
    return spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/vectors")


# ---------------------------------------------------------------------------
# T10-T12 answers
# ---------------------------------------------------------------------------

def _landfall_bonus(query, sentence):
    ql = F.lower(query)
    asks = None
    for wd in C.LANDFALL_QUERY_WORDS:
        c = ql.contains(wd)
        asks = c if asks is None else asks | c
    sl = F.lower(sentence)
    has = None
    for wd in C.LANDFALL_SENTENCE_WORDS:
        c = sl.contains(wd)
        has = c if has is None else has | c
    return F.when(asks & has, F.lit(0.5)).otherwise(F.lit(0.0))


def _contexts(hits: DataFrame) -> DataFrame:
    """Per query: hit texts in rank order (k of them) and their space join."""
    g = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_h"))
    return g.select("query_id", F.transform("_h", lambda x: x["text"]).alias("contexts"))


def extractive_answer(queries: DataFrame, hits: DataFrame, bonus: bool = True) -> DataFrame:
    """T10 core: best context sentence per query (first maximum wins).

    score = overlap(query, sentence) (+0.5 landfall bonus when ``bonus``).
    Returns (query_id, query, contexts, context, answer).
    """
    ctx = _contexts(hits)
    q = (queries.join(shuffled(ctx), "query_id", "left")
         .withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
         .withColumn("context", F.array_join("contexts", " ")))
    s = q.select("query_id", "query", F.posexplode(X.raw_sentences("context")).alias("_pos", "_s"))
    score = X.overlap(X.tokens("query"), X.tokens("_s"))
    if bonus:
        score = score + _landfall_bonus(F.col("query"), F.col("_s"))
    best = (s.withColumn("_score", score).groupBy("query_id")
            .agg(F.max_by("_s", F.struct(F.col("_score"), -F.col("_pos"))).alias("_best")))
    out = q.join(shuffled(best), "query_id", "left")
    ans = F.when(F.coalesce(F.length("_best"), F.lit(0)) > 0, F.col("_best")).otherwise(F.lit(C.NO_ANSWER_TEXT))
    return out.select("query_id", "query", "contexts", "context", ans.alias("answer"))


def grounded_answer(queries: DataFrame, hits: DataFrame, model: str = "mock-grounded") -> DataFrame:
    """T10 + T12: answers strictly from the retrieved context."""
    a = extractive_answer(queries, hits, bonus=True)
    return a.select("query_id", "query", F.lit(model).alias("model"), "answer",
                    X.approx_tokens(F.concat("query", "context")).alias("prompt_tokens"),
                    X.approx_tokens("answer").alias("completion_tokens"), "contexts")


def prior_answer(queries: DataFrame, hits: DataFrame, prior=C.NAIVE_PRIOR,
                 model: str = "mock-naive") -> DataFrame:
    """T11 + J9 + T12: first prior key found in the question wins, else the
    extractive answer without the landfall bonus.  The prior is a fixed
    small table, applied as an ordered CASE (no join)."""
    a = extractive_answer(queries, hits, bonus=False)
    ql = F.lower("query")
    pick = None
    for key, text in prior:
        pick = (F.when(ql.contains(key), F.lit(text)) if pick is None
                else pick.when(ql.contains(key), F.lit(text)))
    ans = pick.otherwise(F.col("answer")) if pick is not None else F.col("answer")
    return a.select("query_id", "query", F.lit(model).alias("model"), ans.alias("answer"),
                    X.approx_tokens("query").alias("prompt_tokens"),
                    X.approx_tokens(ans).alias("completion_tokens"), "contexts")


# ---------------------------------------------------------------------------
# P18 + P19 prompt rendering
# ---------------------------------------------------------------------------

def render_prompts(queries: DataFrame, hits: DataFrame, templates=None) -> DataFrame:
    """P19 numbered context ('[i] text' blocks, blank line between) and P18
    rendering of every template for every query.  Templates are a fixed,
    small literal set, attached with a generator (no join)."""
    templates = templates or C.PROMPT_TEMPLATES
    ctx = _contexts(hits)
    q = (queries.join(shuffled(ctx), "query_id", "left")
         .withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
         .withColumn("context", X.numbered_context("contexts")))
    t = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("body"))
                            for k, v in templates.items()])).alias("t")
    r = q.select("query_id", "query", "context", t)
    prompt = F.replace(F.replace(F.col("t.body"), F.lit("{{ query }}"), F.col("query")),
                       F.lit("{{ context }}"), F.col("context"))
    return r.select("query_id", F.col("t.name").alias("template_name"), prompt.alias("prompt"))
