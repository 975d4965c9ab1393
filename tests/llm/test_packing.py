import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import corpus, documents

from gtspark.llm import packing as K
from gtspark.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


ODD = ["don't STOP's <|endoftext|> x", "Σίσυφος ΟΔΟΣ", "ab\x85cd\x1cgh", "x²y ½ «hé», ¿qué? l'été 12a3 c--d's'''s",
       "İstanbul", "áb é'S !!'s 'll", "tab\tnew\nline\r\x0b\x0c  z", None, "", "  ", "café é"]


def test_word_encoder_equals_whole_text_encoding(tok):
    import pyarrow as pa

    texts = [t or "" for t in corpus() + ODD]
    got = []
    for _, flat, at in K.WordEncoder(tokenizer_path()).encode(pa.array(texts), 1):
        got += [flat[a:b].tolist() for a, b in zip(at, at[1:])]
    assert got == [tok.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def check(rows, texts, tok, capacity):
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for d, own in pieces.items():
        ids = np.array(tok.encode(texts[d] or "", add_special_tokens=False).ids + [1], "<u4")
        own.sort(key=lambda r: r.start)
        at = 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    used = 0
    for own in seqs.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= capacity
        used += at
    return 1 - used / (len(seqs) * capacity)


@pytest.mark.parametrize("capacity,group", [(2048, 256), (64, 2)])
def test_pieces_and_sequences(spark, tok, capacity, group):
    texts = corpus(per=20) + ODD
    df = documents(spark, texts, extra="start length part").repartition(7)
    rows = K.pack(df, tokenizer_path(), capacity=capacity, group=group).collect()
    waste = check(rows, dict(enumerate(texts)), tok, capacity)
    assert waste < 0.03


def test_empty_table_repeated_rows_and_null_ids(spark, tok):
    assert K.pack(documents(spark, []), tokenizer_path()).count() == 0
    rows = K.pack(documents(spark, ["a b", "a b", None], [3, 3, None]), tokenizer_path()).collect()
    assert sum(r.length for r in rows) == 3 + 3 + 1
    places = [(r.sequence_id, r.offset) for r in rows]
    assert len(set(places)) == len(places)


def test_cuts():
    grid = K.class_lengths(2048)
    for n in range(1, 5000, 7):
        own = K.cuts(n, 2048, grid)
        assert sum(own) == n and set(own) <= set(grid)
        assert len(own) <= n // 2048 + 4
