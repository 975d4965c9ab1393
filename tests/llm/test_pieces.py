import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from gtspark.llm import pieces as P
from helpers import documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def enc():
    return P.Encoder(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


ODD = ["", " ", "   ", "a", " a ", "a  b", "\n\n", "\t", "x\x00y", "▁", "▁▁a ▁", "<s>", "</s> <unk> <0x0A>", "日本語", "é é",
       "😀👍🏽", "a​b", "ﬁ", "Ⅷ", "  b", "שלום", "x" * 3000, "ab" * 700, "﻿q", "1234567890", "A.B,c!d?e"]


def test_equal_to_the_library_on_odd_texts(enc, library):
    for t in ODD:
        assert ids(enc.text(t)) == library.encode(t, add_bos=True, add_eos=True), t[:40]


def test_equal_to_the_library_on_random_texts(enc, library):
    rng, own = random.Random(5), list(enc.vocab.ids)
    signs = list("ab the. ,\n1▁éшя日") + ["  ", "ing", "́", "😀", "tion"]
    for k in range(6000):
        if k % 2:
            t = "".join(rng.choices(signs, k=rng.randrange(1, 20)))
        else:
            t = "".join(rng.choices(own, k=rng.randrange(1, 9))).replace("▁", " ")
        assert ids(enc.text(t)) == library.encode(t, add_bos=True, add_eos=True), t


def test_search_gives_up_and_fails_positions(enc):
    """Units whose longest first piece is wrong, so the search must go back."""
    back = 0
    for t in list(enc.vocab.ids)[3000:9000]:
        unit = t + "ing"
        got = enc.pieces(unit)
        assert got == enc.vocab.merge(unit)
        longest = max(size for last, size in enc.vocab.automaton.iter(unit) if last - size + 1 == 0)
        back += len(got[0]) < longest
    assert back > 100


def test_units_are_cut_only_where_no_piece_spans(enc):
    for t in ODD + ["Hello wörld.Next", "a1b2 c3", "x_y-z"]:
        s = P.SPACE + t.replace(" ", P.SPACE)
        units = enc.vocab.units.findall(s)
        assert "".join(units) == s
        whole = [p for u in units for p in enc.pieces(u)]
        assert whole == enc.pieces(s) if s else not whole


def test_cache_does_not_change_results(enc, library, monkeypatch):
    monkeypatch.setattr(P, "CACHE_UNITS", 5)
    monkeypatch.setattr(P, "CACHE_PAIRS", 5)
    small = P.Encoder(MODEL)
    for t in ["one two three four five six", "seven one two eight", "one"] * 3:
        assert ids(small.text(t)) == library.encode(t, add_bos=True, add_eos=True)


def test_digests(spark, library):
    texts = ODD + [None, "Some text here.", "Some text here.", " ".join(f"word{i}" for i in range(60_000))]
    df = documents(spark, texts, extra="n_tokens ids_le decoded")
    out = {r["doc_id"]: r for r in P.digests(df, MODEL).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_bos=True, add_eos=True)
        assert out[i]["n_tokens"] == len(want)
        assert out[i]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256(library.decode(want).encode()).hexdigest()


def test_encoded_texts_come_back(spark):
    df = spark.createDataFrame([(None, "A b  c.", "x"), (2, None, "y"), (2, "é", "z")], "doc_id long, text string, lang string")
    out = P.encode(df, MODEL)
    assert sorted(r["decoded"] for r in out.collect()) == ["", "A b  c.", "é"]
    rows = out.select("doc_id", "n_tokens", P.id_array().alias("ids")).collect()
    assert all(len(r["ids"]) == r["n_tokens"] and r["ids"][0] == 1 and r["ids"][-1] == 2 for r in rows)
    assert {r["doc_id"] for r in rows} == {None, 2}
    assert P.digests(df.limit(0), MODEL).count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    with open(MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.byte_fallback = False
    path = tmp_path / "other.model"
    path.write_bytes(m.SerializeToString())
    with pytest.raises(ValueError):
        P.Encoder(str(path))
