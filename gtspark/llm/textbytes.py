"""Vectorised word and shingle hashing over the UTF-8 bytes of Arrow columns.

One task sees one Arrow batch at a time and works through it in slices of
whole rows of about ``SLICE`` bytes, so its memory does not depend on the size
of the table (a single text longer than a slice is one slice of its own).
Every hash is 64 bits: a polynomial over the bytes of the word, then a
finaliser.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_U = np.uint64


def mix(x):
    """64-bit finaliser (splitmix64), elementwise."""
    x = np.asarray(x, _U).copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def stream(seed: int, n: int):
    """``n`` fixed pseudo-random 64-bit values for a seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TABLE = stream(11, 256)[LOWER]
_BASE = int(stream(12, 1)[0]) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_COEF = stream(13, 64) | _U(1)
_powers = {"f": np.ones(1, _U), "i": np.ones(1, _U)}


def _power(n: int):
    """``base**k`` and its inverse for k < n, kept and doubled on demand."""
    for key, b in (("f", _BASE), ("i", _INVERSE)):
        p = _powers[key]
        while len(p) < n:
            p = np.concatenate([p, p * _U(pow(b, len(p), 1 << 64))])
        _powers[key] = p
    return _powers["f"], _powers["i"]


#: Bytes that belong to a word.  ``SPACED``: all but ASCII white space;
#: ``ALNUM``: ASCII digits and letters (upper case is lowered first) and every
#: byte of a non-ASCII character.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True


def buffers(col):
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    big = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64 if big else np.int32)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offs.astype(np.int64)


def slices(col, size: int | None = None):
    """Yield (first row, bytes, offsets) of runs of whole rows of about ``size`` bytes."""
    size = size or SLICE
    if len(col) == 0:
        return
    data, offs = buffers(col)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        j = min(j, n, i + 65536)
        yield i, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def runs(flag, offs):
    """Starts and ends (exclusive) of the runs of True that do not cross a row's border."""
    n = len(flag)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z
    first = flag.copy()
    first[1:] &= ~flag[:-1]
    at = offs[:-1][offs[:-1] < n]
    first[at] = flag[at]
    last = flag.copy()
    last[:-1] &= ~flag[1:]
    at = offs[1:] - 1
    at = at[at >= 0]
    last[at] = flag[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data, starts, ends):
    """Hash of each byte span (A-Z lowered)."""
    if len(starts) == 0:
        return np.zeros(0, _U)
    f, inv = _power(len(data) + 1)
    acc = np.zeros(len(data) + 1, _U)
    np.cumsum(_TABLE[data] * f[:len(data)], out=acc[1:])
    return mix((acc[ends] - acc[starts]) * inv[starts] + (ends - starts).astype(_U))


def words(data, offs, kind):
    """(hash of each word, CSR offsets of rows into the words)."""
    starts, ends = runs(kind[data], offs)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offs)


def shingles(hashes, rows, k: int):
    """Hashes of each row's k-word shingles, and the index of their first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = hashes[:n] * _COEF[0]
    for j in range(1, k):
        h += hashes[j:n + j] * _COEF[j]
    keep = np.ones(n, bool)
    for j in range(1, k):                       # shingles that would cross a row's border
        at = rows[1:-1] - j
        keep[at[(at >= 0) & (at < n)]] = False
    at = np.flatnonzero(keep)
    return mix(h[at] + _U(k)), at


def row_of(rows, at):
    """Row of each index under CSR offsets."""
    return np.searchsorted(rows, at, "right") - 1


def sorted_sets(hashes, at, rows):
    """Distinct hashes of each row, ascending: (values, CSR offsets)."""
    r = row_of(rows, at)
    order = np.lexsort((hashes, r))
    h, r = hashes[order], r[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[keep], r[keep]
    return h, np.searchsorted(r, np.arange(len(rows)))
