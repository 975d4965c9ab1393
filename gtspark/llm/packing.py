"""Harmonic packing of tokenised documents into fixed-capacity sequences.

A document's ids are cut into full sequences and a rest; the rest is cut
greedily at the reciprocal capacities ``floor(capacity / k)``, two or three
cuts for most lengths.  Pieces of one length form a class whose bins hold
exactly ``k = capacity // length`` of them, so a class is filled by counting
alone:

1. every task fills its own bins while it tokenises, holding fewer than ``k``
   open pieces per class, and stores pieces and places;
2. pieces left open are counted again per class over groups of
   ``group`` tasks, then groups of groups, until one group is left (a row
   number over a group holds fewer than ``group * k`` rows);
3. what is then left, fewer than ``k`` pieces a class whatever the input,
   goes through first-fit decreasing in one small group.

Nulls are empty texts, an empty text is the end id alone, equal rows are
packed each by itself, and an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as T
from .common import store

CAPACITY, END_ID = 2048, 1
CACHE_UNITS = 1_000_000      # distinct word parts whose ids a worker keeps; a full cache is emptied
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

#: Bytes that lie outside printable ASCII, ASCII white space and the letters up
#: to U+023F.  Beyond those, Unicode versions and case rules could differ
#: between libraries, so a row that holds one is encoded whole.
_RARE = np.ones(256, bool)
_RARE[9:14] = _RARE[32:127] = _RARE[0x80:0xC0] = _RARE[0xC2:0xC9] = False
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_SIGN = T.SPACED & ~_ALPHA
_SIGN[128:] = False


def rare_rows(data, offs):
    """Rows that must be encoded whole."""
    bad = _RARE[data]
    if len(data) > 1:
        a, b = data[:-1], data[1:]
        bad[:-1] |= ((a == 0xC2) & (b < 0xA1)) | ((a == 0xC4) & (b == 0xB0)) | ((a == 60) & (b == 124))
    return np.unique(T.row_of(offs, np.flatnonzero(bad))) if bad.any() else np.zeros(0, np.int64)


def units(data, offs):
    """Spans cut at white space and after an ASCII letter that a sign or digit follows."""
    starts, ends = T.runs(T.SPACED[data], offs)
    inner = np.flatnonzero(_ALPHA[data[:-1]] & _SIGN[data[1:]]) + 1 if len(data) > 1 else starts[:0]
    inner = inner[~np.isin(inner, offs)]
    return np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))


class WordEncoder:
    """Ids of whole texts, encoding each distinct word part once.

    The vocabulary splits at white space and between letters, digits and
    other signs before any merge, so a text's ids are those of its parts in
    turn.  Parts are told apart by 64-bit hashes of their lowered bytes.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.reset()

    def reset(self):
        self.keys = np.zeros(0, np.uint64)                  # sorted
        self.place = np.zeros(0, np.int64)                  # of each key in ``at``
        self.flat, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _ids(self, parts: list[str]):
        """(flat ids, count of each part)."""
        groups = [parts[i:i + 256] for i in range(0, len(parts), 256)]
        flat, sizes = [], []
        for some, e in zip(groups, self.tok.encode_batch_fast([" ".join(g) for g in groups],
                                                              add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            pieces = [1 if p.isalpha() else len(PIECES.findall(p.lower())) for p in some]
            ends, want = np.flatnonzero(self.last[ids]) + 1, np.cumsum(pieces)
            if len(ends) != want[-1]:
                own = [self.tok.encode(p, add_special_tokens=False).ids for p in some]
                ids, n = np.array([i for x in own for i in x], np.uint32), [len(x) for x in own]
            else:
                n = np.diff(ends[want - 1], prepend=0).tolist()
            flat.append(ids)
            sizes += n
        return np.concatenate(flat), np.array(sizes, np.int64)

    def _places(self, hashes, data, starts, ends):
        """Place of each part's ids, learning the new ones."""
        if len(self.keys) > CACHE_UNITS:
            self.reset()
        own, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        pos = np.searchsorted(self.keys, own)
        known = pos < len(self.keys)
        known[known] = self.keys[pos[known]] == own[known]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            flat, n = self._ids([raw[starts[i]:ends[i]].decode() for i in first[new]])
            place = len(self.at) - 1 + np.arange(len(new))
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(n)])
            self.flat = np.concatenate([self.flat, flat])
            keys = np.concatenate([self.keys, own[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.place = keys[order], np.concatenate([self.place, place])[order]
        return self.place[np.searchsorted(self.keys, own)][back]

    def encode(self, col, end_id: int):
        """Yield (first row, flat ids, CSR offsets), each row closed by the end id."""
        for first, data, offs in T.slices(col):
            starts, ends = units(data, offs)
            rows = np.searchsorted(starts, offs)
            slow = rare_rows(data, offs)
            if len(slow):
                skip = np.isin(T.row_of(rows, np.arange(len(starts))), slow)
                starts, ends = starts[~skip], ends[~skip]
                rows = np.searchsorted(starts, offs)
            w = self._places(T.span_hashes(data, starts, ends), data, starts, ends)
            n = self.at[w + 1] - self.at[w]
            upto = np.concatenate([[0], np.cumsum(n)])
            ids = self.flat[np.arange(upto[-1]) + np.repeat(self.at[w] - upto[:-1], n)]
            bounds = upto[rows]
            out = np.insert(ids, bounds[1:], np.uint32(end_id)).astype("<u4")
            bounds = bounds + np.arange(len(bounds))
            if len(slow):
                own = np.split(out, bounds[1:-1])
                for r in slow:
                    text = data[offs[r]:offs[r + 1]].tobytes().decode()
                    own[r] = np.array(self.tok.encode(text, add_special_tokens=False).ids + [end_id], "<u4")
                out, bounds = np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
            yield first, out, bounds


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def class_lengths(capacity: int) -> list[int]:
    """The reciprocal capacities, longest first."""
    return sorted({capacity // k for k in range(1, capacity + 1)}, reverse=True)


def cuts(n: int, capacity: int, grid: list[int]) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    for g in grid[1:]:
        while rest >= g:
            out.append(g)
            rest -= g
    return out


PLACED = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "part long, sequence_id long, offset long")


def _fill(path: str, capacity: int, end_id: int):
    """Tokenise, cut and fill the task's own bins."""
    def run(batches):
        grid = class_lengths(capacity)
        part = TaskContext.get().partitionId()
        enc, made = encoder(path), 0
        held = defaultdict(list)
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

        def frame(rows):
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            arrays = dict(zip(names, (pa.array(list(c), pa.int64()) for c in cols)))
            arrays["part"] = pa.array([part] * len(rows), pa.int64())
            order = [x.split()[0] for x in PLACED.split(", ")]
            return pa.RecordBatch.from_arrays([arrays[n] for n in order], order)

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, flat, bounds in enc.encode(batch.column("text"), end_id):
                rows = []
                for i in range(len(bounds) - 1):
                    at, size = int(bounds[i]), int(bounds[i + 1] - bounds[i])
                    start = 0
                    for n in cuts(size, capacity, grid):
                        crc = zlib.crc32(flat[at + start:at + start + n].tobytes())
                        held[n].append((ids[first + i], start, n, crc, size))
                        start += n
                        if len(held[n]) == capacity // n:
                            seq = ((part + 1) << 33) + made
                            made += 1
                            rows += [r + (seq, j * n) for j, r in enumerate(held.pop(n))]
                yield frame(rows)
        yield frame([r + (None, None) for n in held for r in held[n]])
    return run


def _first_fit(capacity: int):
    """First-fit decreasing over the last few open pieces."""
    def run(batches):
        free: list[int] = []
        seqs, offs = [], []
        pdf = pd.concat([pd.DataFrame(columns=[c.split()[0] for c in PLACED.split(", ")]), *batches])
        pdf = pdf.sort_values(["length", "part", "doc_id", "start"], ascending=[False, True, True, True])
        for n in pdf["length"]:
            b = next((i for i, f in enumerate(free) if f >= n), None)
            if b is None:
                b = len(free)
                free.append(capacity)
            seqs.append((1 << 62) + b)
            offs.append(capacity - free[b])
            free[b] -= n
        yield pdf.assign(sequence_id=seqs, offset=offs)
    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
         group: int = 256) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    placed = store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
                   .mapInArrow(_fill(tokenizer_path, capacity, end_id), PLACED), "pack")
    done = [placed.where(F.col("sequence_id").isNotNull())]
    left = placed.where(F.col("sequence_id").isNull())
    tasks = (left.agg(F.max("part")).first()[0] or 0) + 1
    level, per = 0, F.lit(capacity).cast("long")
    span = 1
    while span < tasks:
        level, span = level + 1, span * group
        keys = ["length", F.floor(F.col("part") / span)]
        own = Window.partitionBy(*keys)
        k = F.floor(per / F.col("length"))
        n, rank = F.count(F.lit(1)).over(own), F.row_number().over(
            own.orderBy("part", "doc_id", "start", "ids_crc32"))
        left = left.withColumn("__n", n).withColumn("__r", (rank - 1).cast("long"))
        full = F.col("__r") < F.col("__n") - F.col("__n") % k
        bin_no = F.floor(F.col("__r") / k)
        base = (1 << 61) + (level << 53)
        seq = (F.lit(base) + F.floor(F.col("part") / span) * (1 << 22)
               + F.col("length") * 512 + bin_no)
        left = (left.withColumn("sequence_id", F.when(full, seq.cast("long")))
                .withColumn("offset", F.when(full, (F.col("__r") % k) * F.col("length")))
                .drop("__n", "__r"))
        left = store(left, "pack_left")
        done.append(left.where(F.col("sequence_id").isNotNull()))
        left = left.where(F.col("sequence_id").isNull())
    done.append(left.repartition(1).mapInPandas(_first_fit(capacity), PLACED))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("part")
