"""Fuzzy line deduplication by MinHash.

Lines are compared after trimming ASCII white space and lowering A-Z; blank
lines are never touched.  Equal lines collapse first.  A distinct line's
signature is one minimum per bin over its character shingles (one-permutation
MinHash, empty bins filled from the next full one); ``bands`` keys of ``rows``
minima each give candidates: 1 - (1 - s^5)^12 is 0.99 at similarity 0.8 and
0.9999 at 0.9.  A key is its band and 32 bits, which keeps the stored lines small;
the few pairs that meet by chance are rejected like other candidates.  Every line that
may share a key has its text read once more and marks its shingles in ``CELLS`` cells; a cell that
only one line of a pair marks holds a shingle the other has not, which bounds
the overlap from above without error; lines that reach the second pass are
marked in ``MORE_CELLS`` cells instead.  Candidates within the bound are verified
by the exact Jaccard similarity of their shingle sets, and distributed union-find (see ``linking``) makes the
components, of which one line stays: the first occurrence (smallest doc_id,
then line number) of the line whose id is the component's.

A line id is a 64-bit hash; a second hash finds the rare pair of different
lines with equal ids, which then stay in the text.  Lines shorter than a
shingle are one shingle.  A null text stays null; documents that had lines and
lose all of them are dropped by ``dedup_lines`` (``keep_empty`` keeps them
with an empty text); rows that repeat a doc_id count as copies after the
first occurrence only by line, never within the same id and line number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import textbytes as T
from .common import store
from .linking import components, link
from .sketch import sketch, thinned

SHINGLE, BANDS, ROWS, PERCENT = 9, 12, 5, 80
BINS = 64                # at least BANDS * ROWS, a power of two
CELLS = 512              # marks of a line's shingles, 64 to a word
MARKS = [f"m{i}" for i in range(CELLS // 64)]
MORE_CELLS = 4096        # marks of the lines that reach the second pass
MORE = [f"w{i}" for i in range(MORE_CELLS // 64)]
_SPAN = 1 << 15          # characters whose shingles are hashed at once: what a core's cache holds
_U = np.uint64
_CHARS = T.stream(31, 2 * 0x110000).reshape(2, -1)
_CHARS[:, 65:91] = _CHARS[:, 97:123]


class Chars:
    """Code points of some texts, laid end to end, and prefix sums for span hashes."""

    def __init__(self, texts: list[str], families: int = 2):
        self.code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        self.offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        f, self.inv = T._power(len(self.code) + 1)
        self.sums = []
        at = self.code.astype(np.intp)
        for t in _CHARS[:families]:
            acc = np.zeros(len(self.code) + 1, _U)
            own = t[at]
            own *= f[:len(at)]
            np.cumsum(own, out=acc[1:])
            self.sums.append(acc)

    def hash(self, starts, ends, which: int = 0):
        acc = self.sums[which]
        return T.mix((acc[ends] - acc[starts]) * self.inv[starts] + (ends - starts).astype(_U))

    def lines(self):
        """(text number, line number, start, end) of the trimmed non-blank lines."""
        if len(self.code) == 0:
            z = np.zeros(0, np.int64)
            return z, z, z, z
        cut = self.code == 10
        starts, ends = T.runs(~cut, self.offs)
        solid = np.flatnonzero((self.code - np.uint32(9) > 4) & (self.code != 32))        # not 9 to 13, not a blank
        lo, hi = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
        some = lo < hi
        starts, ends = solid[lo[some]], solid[hi[some] - 1] + 1
        text = T.row_of(self.offs, starts)
        breaks = np.flatnonzero(cut)
        return text, np.searchsorted(breaks, starts) - np.searchsorted(breaks, self.offs)[text], starts, ends

    def shingles(self, starts, ends, k: int):
        """(hash, span number) of every k-character shingle of the spans."""
        n = np.maximum(ends - starts - k + 1, 1)
        upto = np.concatenate([[0], np.cumsum(n)])
        span = np.repeat(np.arange(len(n)), n)
        if not len(n):
            return np.zeros(0, _U), span
        # the k characters from every position between the spans' borders, then the spans' own positions
        lo, hi = int(starts.min()), int(ends.max())
        hi = max(hi - k + 1, lo)
        acc, out = self.sums[0], np.zeros(upto[-1], _U)
        if hi > lo:
            every = acc[lo + k:hi + k] - acc[lo:hi]
            every *= self.inv[lo:hi]
            every += _U(k)
            at = np.arange(upto[-1]) + np.repeat(starts - lo - upto[:-1], n)
            out = T.mix(every).take(at, mode="clip")
        short = np.flatnonzero(ends - starts < k)
        out[upto[short]] = self.hash(starts[short], ends[short])
        return out, span


def band_keys(hashes, span, n: int, bands: int, rows: int):
    """(n, bands) keys from one-permutation signatures of ``BINS`` bins."""
    none = _U(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n * BINS, none, _U)
    cell = span * BINS + (hashes & _U(BINS - 1)).view(np.int64)
    np.minimum.at(sig, cell, T.mix(hashes))
    sig = sig.reshape(n, BINS)
    some = np.flatnonzero((sig == none).any(axis=1))
    if len(some):                                              # an empty bin: the next full one's minimum, plus its distance
        bins, part = np.arange(BINS), sig[some]
        full = np.where(part != none, bins, 2 * BINS)
        after = np.concatenate([full, full + BINS], axis=1)[:, ::-1]
        after = np.minimum.accumulate(after, axis=1)[:, ::-1][:, :BINS]
        sig[some] = np.take_along_axis(part, after % BINS, axis=1) + (after - bins).astype(_U)
    keys = np.zeros((n, bands), _U)
    own = sig[:, :bands * rows].reshape(n, bands, rows)
    for j in range(rows):
        keys = T.mix(keys + own[:, :, j] + _U(j))
    return T.mix(keys + T.stream(33, bands)[None, :])


def marks(hashes, span, n: int, cells: int = CELLS):
    """n set sizes and (n, cells / 64) words of the cells that hold a shingle, for at most 1,024 spans."""
    key = np.sort((span.astype(_U) << _U(54)) | (hashes >> _U(10)))
    key = key[np.append(True, key[1:] != key[:-1])]
    size = np.bincount((key >> _U(54)).astype(np.int64), minlength=n)
    held = np.zeros(n * cells, bool)
    held[((key >> _U(54)) * _U(cells) + ((key >> _U(8)) & _U(cells - 1))).astype(np.int64)] = True
    return size, np.packbits(held.reshape(n, cells), axis=1, bitorder="little").view(_U)


def _texts(col, size: int = 1 << 19):
    """Yield (first row, texts) of whole rows, about ``size`` characters."""
    lo, own, n = 0, [], 0
    for i, t in enumerate(col):
        own.append(t.as_py() or "")
        n += len(own[-1])
        if n >= size:
            yield lo, own
            lo, own, n = i + 1, [], 0
    if own:
        yield lo, own


LINES = "id long, check long, doc_id long, line_no int, n int, bands array<int>"


def _lines(k: int, bands: int, rows: int):
    """The distinct lines of each document: first line number, count and band keys."""
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, own in _texts(batch.column("text")):
                c = Chars(own)
                text, number, starts, ends = c.lines()
                h = c.hash(starts, ends)
                order = np.lexsort((number, h, text))
                first = np.ones(len(h), bool)
                first[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
                at = np.flatnonzero(first)
                n = np.diff(np.append(at, len(h)))
                text, number, starts, ends, h = (x[order][at] for x in (text, number, starts, ends, h))
                near = np.argsort(starts, kind="stable")
                text, number, n, starts, ends, h = (x[near] for x in (text, number, n, starts, ends, h))
                keys = np.zeros((len(at), bands), _U)
                cuts = np.flatnonzero(np.diff(starts // _SPAN, prepend=-1)).tolist() + [len(at)]
                for i, j in zip(cuts, cuts[1:]):
                    keys[i:j] = band_keys(*c.shingles(starts[i:j], ends[i:j], k), j - i, bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(c.hash(starts, ends, 1).view(np.int64)),
                     ids.take(pa.array(lo + text)), pa.array(number, pa.int32()), pa.array(n, pa.int32()),
                     pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * bands,
                                              pa.array((keys.ravel() >> _U(32)).astype(np.uint32).view(np.int32)))],
                    [x.split()[0] for x in LINES.split(", ")])
    return run


def _posted(reps: DataFrame) -> DataFrame:
    """The keys of all bands: the band's number above its 32 stored bits."""
    band = reps.select(F.posexplode("bands").alias("band", "bits"))
    low = F.col("bits").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return band.select(F.shiftleft(F.col("band").cast("long"), 32).bitwiseOR(low).alias("key"))


def _turned(keys):
    """Longs with their halves swapped; a key's 32 bits come first."""
    keys = keys.view(_U)
    return keys << _U(32) | keys >> _U(32)


def _dealt(parts: int, size: int = 1 << 20):
    """Keys in ``parts`` ranges of their 32 bits, a row for each range of about ``size`` keys: sorted, none more than twice."""
    bounds = np.array([-(-(i << 64) // parts) for i in range(1, parts)], _U)

    def rows(own):
        key = np.sort(_turned(np.concatenate(own)))
        key = key[np.append([True, True], key[2:] != key[:-2])[:len(key)]]
        cuts = np.concatenate([[0], np.searchsorted(key, bounds), [len(key)]])
        some = np.flatnonzero(np.diff(cuts))
        offsets = np.append(cuts[some], len(key)).astype(np.int32) * np.int32(8)
        held = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(key)])
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), held], ["part", "keys"])

    def run(batches):
        own, n = [], 0
        for batch in batches:
            own.append(batch.column("key").to_numpy())
            n += len(own[-1])
            if n >= size:
                yield rows(own)
                own, n = [], 0
        if n:
            yield rows(own)
    return run


def _repeated(batches):
    """The keys that come more than once; all rows of a range are in one task."""
    own = [np.frombuffer(x, _U) for batch in batches for x in batch.column("keys").to_pylist()]
    if own:
        key = np.sort(np.concatenate(own))
        key = np.unique(key[1:][key[1:] == key[:-1]])
        yield pa.RecordBatch.from_arrays([pa.array(_turned(key).view(np.int64))], ["key"])


def _postings(keys):
    """Band keys that may be shared, one row each."""
    def run(batches):
        for batch in batches:
            bands = batch.column("bands")
            first = bands.offsets.to_numpy()
            bits = bands.values.to_numpy(zero_copy_only=False)[first[0]:first[-1]]
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            own = (np.arange(len(bits)) - (first[:-1] - first[0])[row]) << 32 | bits.view(np.uint32).astype(np.int64)
            at = np.flatnonzero(keys.value.has(own))
            row = row[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[at]), *(batch.column(c).take(pa.array(row)) for c in ("id", "w", "doc_id", "line_no"))],
                ["key", "id", "w", "doc_id", "line_no"])
    return run


def _extract(batches):
    """Texts of the wanted lines of each document."""
    for batch in batches:
        out_id, out = [], []
        for text, want in zip(batch.column("text"), batch.column("want")):
            own = (text.as_py() or "").split("\n")
            for w in want.as_py():
                if w["line_no"] < len(own):
                    out_id.append(w["id"])
                    out.append(own[w["line_no"]].strip(" \t\r\x0b\x0c\n"))
        yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out, pa.string())], ["id", "line"])


def _marked(k: int):
    """Lines with their number of shingles and their marks."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                c = Chars(part.column("line").to_pylist(), 1)
                size, held = marks(*c.shingles(c.offs[:-1], c.offs[1:], k), part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("line"), pa.array(size, pa.int32()),
                     *(pa.array(x.view(np.int64)) for x in np.ascontiguousarray(held.T))], ["id", "line", "size", *MARKS])
    return run


def _more_marks(k: int):
    """Marks in ``MORE_CELLS`` cells of each line, and how many there are."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                c = Chars(part.column("line").to_pylist(), 1)
                held = marks(*c.shingles(c.offs[:-1], c.offs[1:], k), part.num_rows, MORE_CELLS)[1]
                set_ = np.unpackbits(held.view(np.uint8), axis=1).sum(1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(set_), *(pa.array(x.view(np.int64)) for x in np.ascontiguousarray(held.T))],
                    ["id", "marked", *MORE])
    return run


def _exact(k: int, percent: int):
    """Pairs whose shingle sets have 100 * overlap >= percent * union."""
    def run(batches):
        for batch in batches:
            left, right = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            keep = np.zeros(len(left), bool)
            for lo in range(0, len(left), 512):
                both = [t for p in zip(left[lo:lo + 512], right[lo:lo + 512]) for t in p]
                c = Chars(both, 1)
                h, span = c.shingles(c.offs[:-1], c.offs[1:], k)
                # 54 bits of the shingle, then pair and side: one sort makes sets and overlaps
                key = np.sort((h & ~_U(1023)) | span.astype(_U))
                key = key[np.append(True, key[1:] != key[:-1])]
                pair = ((key & _U(1023)) >> _U(1)).astype(np.int64)
                total = np.bincount(pair, minlength=len(both) // 2)
                same = (key[1:] ^ key[:-1]) == _U(1)
                shared = np.bincount(pair[1:][same & (key[1:] & _U(1) == _U(1))], minlength=len(both) // 2)
                keep[lo:lo + 512] = 100 * shared >= percent * (total - shared)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])
    return run


def line_components(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS,
                    percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(occurrences of lines, lines that are not the only one of their component).

    The first has one row per document and distinct line; the second
    (id, keep_doc, keep_line) says which occurrence stays.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src.where(F.col("doc_id").isNotNull())
    lines = store(src.mapInArrow(_lines(shingle, bands, rows), LINES), "lines")
    # two bands to a long: equal lines have equal bands, and longs are aggregated by hash
    pairs = [F.shiftleft(F.col("bands")[i].cast("long"), 32).bitwiseOR(
        F.col("bands")[min(i + 1, bands - 1)].cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"b{i}")
        for i in range(0, bands, 2)]
    halves = [F.shiftright(x, 32).cast("int") for i in range(0, bands, 2) for x in (F.col(f"b{i}"), F.shiftleft(f"b{i}", 32))]
    classes = store(lines.select("id", "check", "doc_id", "line_no", "n", *pairs).groupBy("id").agg(
        F.min("doc_id").alias("doc_id"), F.min_by("line_no", "doc_id").alias("line_no"),
        F.sum("n").alias("n"), (F.min("check") != F.max("check")).alias("clash"),
        *(F.max(f"b{i}").alias(f"b{i}") for i in range(0, bands, 2))), "line_classes")
    sound = classes.where(~F.col("clash"))
    often = F.col("n") * (1 << 20) + F.pmod(F.xxhash64("id"), F.lit(1 << 20))       # the most frequent line leads
    reps = sound.select("id", often.alias("w"), "doc_id", "line_no", F.array(*halves[:bands]).alias("bands"))
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = (_posted(reps).mapInArrow(_dealt(parts), "part int, keys binary").repartition("part")
            .mapInArrow(_repeated, "key long"))
    places = store(reps.mapInArrow(_postings(sketch(keys)), "key long, id long, w long, doc_id long, line_no int"),
                   "line_postings")

    def enough(overlap, x, y):
        return (100 + percent) * overlap.cast("long") >= percent * (F.col(f"{x}.size") + F.col(f"{y}.size"))

    def bound(x, y):
        def most(s, o):
            """No overlap is larger than the shingles of ``s`` less its cells that ``o`` does not mark."""
            alone = [F.bit_count(F.col(f"{s}.{m}").bitwiseAND(F.bitwise_not(f"{o}.{m}"))) for m in MARKS]
            return F.col(f"{s}.size") - sum(alone[1:], alone[0])
        return enough(F.least(most(x, y), most(y, x)), x, y)

    # the lines that may share a key: their texts, numbers of shingles and marks
    want = (places.select("id", "doc_id", "line_no").distinct().groupBy("doc_id")
            .agg(F.collect_list(F.struct("id", "line_no")).alias("want")))
    want = store(want, "line_places")
    own = thinned(src, "doc_id", sketch(want.select("doc_id")))
    text = store(own.join(want.hint("shuffle_hash"), "doc_id").select("text", "want")
                 .mapInArrow(_extract, "id long, line string").dropDuplicates(["id"])
                 .mapInArrow(_marked(shingle), "id long, line string, size int, " + ", ".join(f"{m} long" for m in MARKS)),
                 "line_texts")
    postings = places.select("key", "id", "w").join(text.drop("line"), "id")

    def verify(pairs: DataFrame) -> DataFrame:
        both = (pairs.join(text.select(F.col("id").alias("a"), F.col("line").alias("x")), "a")
                .join(text.select(F.col("id").alias("b"), F.col("line").alias("y")), "b"))
        return both.select("a", "b", "x", "y").mapInArrow(_exact(shingle, percent), "a long, b long")

    def detail(ids: DataFrame):
        """More marks of the lines that reach the second pass: the same bound, from the cells that both mark."""
        more = store(text.select("id", "line").join(ids, "id", "leftsemi").mapInArrow(
            _more_marks(shingle), "id long, marked int, " + ", ".join(f"{m} long" for m in MORE)), "line_marks")

        def closer(x, y):
            both = [F.bit_count(F.col(f"{x}.{m}").bitwiseAND(F.col(f"{y}.{m}"))) for m in MORE]
            alone = F.least(F.col(f"{x}.size") - F.col(f"{x}.marked"), F.col(f"{y}.size") - F.col(f"{y}.marked"))
            return enough(alone + sum(both[1:], both[0]), x, y)

        return more, closer, verify

    found = store(components(link(postings, verify, bound, detail)), "line_components")
    kept = (found.where(F.col("id") == F.col("component")).select("component")
            .join(sound.select(F.col("id").alias("component"), F.col("doc_id").alias("keep_doc"),
                               F.col("line_no").alias("keep_line")), "component"))
    fuzzy = found.join(kept, "component").select("id", "keep_doc", "keep_line")
    equal = (sound.where(F.col("n") > 1).join(found, "id", "leftanti")
             .select("id", F.col("doc_id").alias("keep_doc"), F.col("line_no").alias("keep_line")))
    return lines, fuzzy.union(equal)


def _strip(batches):
    """Remove the lines whose ids are listed, but for those at a kept place."""
    for batch in batches:
        text, drop, keep = (batch.column(x).to_pylist() for x in ("text", "__drop", "__keep"))
        bad = {}                                               # numbers of the lines to remove, by row
        hit = np.array([i for i, d in enumerate(drop) if d], np.int64)
        for lo, own in _texts(batch.column("text").take(pa.array(hit))):
            c = Chars(own, 1)
            which, number, starts, ends = c.lines()
            rows = hit[lo + which].tolist()
            gone = {i: set(drop[i]) for i in hit[lo:lo + len(own)].tolist()}
            for i, at, h in zip(rows, number.tolist(), c.hash(starts, ends).view(np.int64).tolist()):
                if h in gone[i] and at not in (keep[i] or ()):
                    bad.setdefault(i, set()).add(at)
        out, removed, total = [], [], []
        for i, t in enumerate(text):
            own = (t or "").split("\n")
            total.append(sum(1 for x in own if x.strip(" \t\r\x0b\x0c")))
            gone = bad.get(i, ())
            out.append("\n".join(x for j, x in enumerate(own) if j not in gone) if gone else t)
            removed.append(len(gone))
        cols = {n: batch.column(n) for n in batch.schema.names}
        cols |= {"text": pa.array(out, pa.string()), "__lines": pa.array(total, pa.int64()),
                 "__removed": pa.array(removed, pa.int64())}
        names = [n for n in cols if n not in ("__drop", "__keep", "__id")]
        yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)


def strip_lines(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with repeated lines removed from ``text``, plus __lines and __removed."""
    lines, extra = line_components(docs, **params)
    hit = lines.join(extra, "id")
    here = (F.col("doc_id") == F.col("keep_doc")) & (F.col("line_no") == F.col("keep_line"))
    per_doc = (hit.where(~here | (F.col("n") > 1)).groupBy(F.col("doc_id").alias("__id"))
               .agg(F.collect_set("id").alias("__drop"),
                    F.collect_set(F.when(here, F.col("keep_line"))).alias("__keep")))
    joined = docs.join(per_doc.hint("shuffle_hash"), docs["doc_id"].cast("long") == per_doc["__id"], "left")
    fields = [StructField("text", StringType()) if f.name == "text" else f for f in docs.schema.fields]
    schema = StructType(fields + [StructField("__lines", LongType()), StructField("__removed", LongType())])
    return joined.mapInArrow(_strip, schema)


def dedup_lines(docs: DataFrame, keep_empty: bool = False, **params) -> DataFrame:
    """``docs`` with one line per component left, and its own columns."""
    out = strip_lines(docs, **params)
    if not keep_empty:
        out = out.where((F.col("__removed") == 0) | (F.col("__removed") < F.col("__lines")))
    return out.select(*docs.columns)


def report(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n_lines (non-blank), n_removed and the text that is left, for every document."""
    return strip_lines(docs.select("doc_id", "text"), **params).select(
        "doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), "text")
