"""Exact encoding with a merge-type piece vocabulary by backtracking, and decoding.

The vocabulary's own rule starts from single characters and joins, again and
again, the adjacent pair whose piece has the highest score (leftmost first).
Its outcome is found here without replaying it over the text: a sequence of
pieces is that outcome exactly when each two neighbours, taken alone, are
rebuilt by the merges as they stand, since the first merge that crossed a
border in the text would cross it in the pair as well.  So

1. an Aho-Corasick automaton marks, for every position, the lengths of the
   pieces that start there;
2. from left to right the longest piece that is compatible with the one before
   is taken; compatibility is a re-merge of the two pieces, kept per pair;
3. where none fits the last piece is given up for the next shorter one.  A
   prefix has one encoding only, so a position that failed once can never
   succeed: it is set in a bitfield and not entered again.

A character that is no piece becomes the ids of its UTF-8 bytes.  Texts are cut
beforehand only at borders that no piece of the vocabulary spans (before white
space and between letters and other signs, which is verified on the loaded
vocabulary; else a text is one unit), and each distinct unit is encoded once per
worker and cache filling.

Null and empty texts hold no pieces, only the begin and end id; white space is
encoded like any other character; equal rows are encoded each for itself; a
null doc_id stays null; an empty table gives an empty result; other columns are
not read, so their names do not matter.
"""

from __future__ import annotations

import gc
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"             # stands for a blank inside pieces
BORDER = "\udfff"            # between the two pieces of a kept pair; no text holds a lone surrogate
CACHE_UNITS = 800_000        # distinct units whose ids a worker keeps; a full cache is emptied
CACHE_PAIRS = 1_000_000      # distinct neighbours whose compatibility a worker keeps
LONG_UNIT = 64               # longer units are encoded without entering the cache
SLICE_CHARS = 2_000_000      # text per result batch
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6          # piece types of the model file


class Vocabulary:
    """Pieces, scores and automaton of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        known = {NORMAL, UNKNOWN, CONTROL, BYTE}
        if (model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback
                or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix
                or model.trainer_spec.treat_whitespace_as_suffix or {p.type for p in model.pieces} - known):
            raise ValueError("needs a merge-type model with byte fallback, a blank put in front and no normaliser")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        by_name = {p.piece: i for i, p in enumerate(model.pieces) if p.type == CONTROL}
        self.begin, self.end = by_name["<s>"], by_name["</s>"]
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.units = self._unit_pattern()

    def _unit_pattern(self):
        """Cuts only where no piece spans the border."""
        pairs = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        letters = {c for p in self.ids for c in p if c.isalpha()}
        spanned = any(a != SPACE and (b == SPACE or (a in letters) != (b in letters)) for a, b in pairs)
        if spanned or not letters:
            return re.compile("(?s).+")
        own = "".join(map(re.escape, sorted(letters)))
        return re.compile(f"{SPACE}*[{own}]+|{SPACE}*[^{own}{SPACE}]+|{SPACE}+")

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by the vocabulary's own merges."""
        parts, score = list(text), self.scores.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts


class _Units(dict):
    """Ids of units, found on first use; long units are not kept."""

    def __init__(self, find):
        self.find = find

    def __missing__(self, unit: str) -> bytes:
        ids = self.find(unit)
        if len(unit) <= LONG_UNIT:
            self[unit] = ids
        return ids


class Encoder:
    """Ids of units and texts; one per worker and model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.vocab = Vocabulary(path)
        self.library = SentencePieceProcessor(model_file=path)       # for decode alone
        self.begin, self.end = (struct.pack("<I", i) for i in (self.vocab.begin, self.vocab.end))
        self.fits: dict[str, bool] = {}
        self.kept = _Units(self.unit)

    def compatible(self, a: str, b: str) -> bool:
        """Whether re-merging the text of both pieces gives both again (``a`` empty: ``b`` alone)."""
        if len(self.fits) >= CACHE_PAIRS:
            self.fits.clear()
        fits = self.fits[a + BORDER + b] = self.vocab.merge(a + b) == ([a, b] if a else [b])
        return fits

    def pieces(self, unit: str) -> list[str]:
        """Backtracking search from the left, longest piece first."""
        n, known, compatible = len(unit), self.fits.get, self.compatible
        lengths = [2] * n                              # bit k: a piece of k characters starts here; one always may
        for last, size in self.vocab.automaton.iter(unit):
            lengths[last - size + 1] |= 1 << size
        failed = bytearray(n // 8 + 1)
        out: list[str] = []
        at, before = 0, ""
        while at < n:
            left = lengths[at]
            while left:
                size = left.bit_length() - 1
                left ^= 1 << size
                end = at + size
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                piece = unit[at:end]
                fits = known(before + BORDER + piece)
                if fits is None:
                    fits = compatible(before, piece)
                if fits:
                    lengths[at] = left
                    out.append(piece)
                    at, before = end, piece
                    break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(out.pop())                   # never empty: the merges' own outcome is among the paths
                before = out[-1] if out else ""
        return out

    def unit(self, unit: str) -> bytes:
        """Little-endian 32-bit ids of a unit."""
        ids: list[int] = []
        known = self.vocab.ids.get
        for p in self.pieces(unit):
            i = known(p)
            if i is None:
                ids += [self.vocab.byte_ids[b] for b in p.encode("utf-8")]
            else:
                ids.append(i)
        return struct.pack(f"<{len(ids)}I", *ids)

    def text(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids of a whole text, begin and end included."""
        if not text:
            return self.begin + self.end
        if len(self.kept) >= CACHE_UNITS:
            self.kept.clear()
        units = self.vocab.units.findall(SPACE + text.replace(" ", SPACE))
        return self.begin + b"".join(map(self.kept.__getitem__, units)) + self.end

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


ENCODED = "doc_id long, n_tokens long, ids_le binary, decoded string"


def _encode(path: str):
    def run(batches):
        enc = encoder(path)

        def out(ids, coded, decoded):
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(c) // 4 for c in coded], pa.int64()),
                 pa.array(coded, pa.binary()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_le", "decoded"])

        gc.disable()                   # nothing here is cyclic, and the collector would walk the caches
        try:
            for batch in batches:
                ids, coded, decoded, held = [], [], [], 0
                for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                    text = text.as_py()
                    ids.append(doc_id.as_py())
                    coded.append(enc.text(text))
                    decoded.append(enc.decode(coded[-1]))
                    held += len(text or "")
                    if held >= SLICE_CHARS:
                        yield out(ids, coded, decoded)
                        ids, coded, decoded, held = [], [], [], 0
                if ids:
                    yield out(ids, coded, decoded)
        finally:
            gc.enable()
    return run


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_le (ids as little-endian 32-bit integers) and the decoded text.

    ``model_path`` is the model file's place on every executor.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encode(model_path), ENCODED)


def id_array(ids_le: str = "ids_le"):
    """The ids of ``encode`` as array<int>."""
    word = F.expr(f"transform(sequence(0, cast(length({ids_le}) / 4 as int) - 1), i -> cast(conv(hex(reverse("
                  f"substring({ids_le}, 4 * i + 1, 4))), 16, 10) as int))")
    return F.when(F.length(ids_le) > 0, word).otherwise(F.array().cast("array<int>"))


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    return encode(docs, model_path).select(
        "doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
