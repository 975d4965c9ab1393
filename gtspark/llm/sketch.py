"""Fixed-size membership sketches that thin a table before a join.

A sketch is one bit array of ``2**bits`` bits whatever the number of keys (the
only thing broadcast).  A row whose key was added always passes; some others
pass too, so the exact join still follows.  At sizes beyond its bits a sketch
thins less, and nothing else changes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbytes as T

BITS = 26
_CELL = 1 << 16                      # bytes of the bit array per row while parts are united


def _cells(keys, bits: int):
    return (T.mix(keys.view(np.uint64) + np.uint64(0x51)) >> np.uint64(64 - bits)).astype(np.int64)


def _add(bits: int):
    def run(batches):
        own = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            c = _cells(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64), bits)
            np.bitwise_or.at(own, c >> 3, (1 << (c & 7)).astype(np.uint8))
        size = min(_CELL, len(own))
        some = [i for i in range(len(own) // size) if own[i * size:(i + 1) * size].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array([own[i * size:(i + 1) * size].tobytes() for i in some], pa.binary())],
            ["cell", "part"])
    return run


def _unite(pdf):
    out = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in pdf["part"]])
    return pdf.iloc[:1].assign(part=[out.tobytes()])


class Sketch:
    def __init__(self, array: np.ndarray, bits: int):
        self.array, self.bits = array, bits

    def has(self, keys):
        c = _cells(np.ascontiguousarray(keys, np.int64), self.bits)
        return (self.array[c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1


def sketch(keys: DataFrame, bits: int = BITS):
    """Broadcast sketch of the one long column of ``keys``."""
    rows = (keys.mapInArrow(_add(bits), "cell int, part binary").groupBy("cell")
            .applyInPandas(_unite, "cell int, part binary").collect())           # 2**bits bits at most
    array = np.zeros(1 << (bits - 3), np.uint8)
    size = min(_CELL, len(array))
    for r in rows:
        array[r["cell"] * size:(r["cell"] + 1) * size] = np.frombuffer(r["part"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(Sketch(array, bits))


def thinned(df: DataFrame, column: str, keys) -> DataFrame:
    """Rows of ``df`` whose key may be in the sketch (a null key is not)."""
    def run(batches):
        for batch in batches:
            col = batch.column(column)
            ok = np.asarray(col.is_valid())
            ok &= keys.value.has(col.fill_null(0).to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(ok))

    return df.mapInArrow(run, df.schema)
