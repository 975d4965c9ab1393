import random
import re

import pytest
from helpers import documents, near, smallest, words
from pyspark.sql import functions as F

from gtspark.llm import ngram_join as J


def shingle_set(text, k=4):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)])


def brute(rows, percent=85):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingle_set(t))
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1:]
             if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b])]
    return smallest(ids, links)


def check(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute(rows)
    got = J.similarity_components(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles) for r in got) == sorted(
        (i is None, i or 0, len(shingle_set(t))) for i, t in rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)
    return want


def test_matches_brute_force(spark):
    want = check(documents(spark))
    assert len(set(want.values())) < len(want)


def test_hot_group_chains_and_small_cell_count(spark, monkeypatch):
    """A third of all rows are near copies; many links exist only through others."""
    rng = random.Random(5)
    base, texts = words(rng, 60), []
    for _ in range(60):
        texts.append(" ".join(near(rng, base, rng.randrange(0, 3))))
    step = words(rng, 50)
    for _ in range(40):                                # a chain: neighbours link, ends do not
        step = near(rng, step, 1)
        texts.append(" ".join(step))
    texts += [" ".join(words(rng, 40)) for _ in range(60)]
    monkeypatch.setattr(J, "CHUNK", 7)
    df = documents(spark, texts)
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    got = J.similarity_components(df, count_buckets=64)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_repeated_ids_null_ids_and_extra_columns(spark):
    rng = random.Random(8)
    a, b = words(rng, 30), words(rng, 30)
    texts = [" ".join(a), " ".join(a), " ".join(b), " ".join(b), None, "tail of its own here"]
    check(documents(spark, texts, [5, 7, 7, 9, None, 3], extra="n key id component"))


def test_empty_table_and_keep_one(spark):
    assert J.similarity_components(documents(spark, [])).count() == 0
    df = documents(spark, ["a b c d e f", "a b c d e f", None, None, "", "z"], extra="rep")
    out = J.keep_one(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 2, 3, 4, 5]


@pytest.mark.parametrize("percent", [60, 85, 100])
def test_tree_walk(percent):
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.permutation(500).astype(np.int64)
    sets = [base[:rng.integers(1, 300)] if rng.random() < .5 else np.sort(rng.choice(base, rng.integers(1, 300), False))
            for _ in range(80)]
    probe = base[:200]
    want = [i for i, s in enumerate(sets)
            if 100 * len(np.intersect1d(s, probe)) >= percent * len(np.union1d(s, probe))]
    assert sorted(J.PrefixTree(sets).walk(probe, percent, step=16)) == want


def test_result_type(spark):
    got = J.similarity_components(documents(spark, ["a b c d", None]))
    assert got.select(F.count("component_id")).first()[0] == 2
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 3


def grown(rng, n, way):
    """A text of n words and the same with words appended, inserted or put in front, or a passage cut."""
    w = [f"u{rng.randrange(10**9)}" for _ in range(n)]
    extra = [f"v{rng.randrange(10**9)}" for _ in range(rng.randrange(n // 18, n // 9))]
    at = {"append": n, "insert": rng.randrange(4, n - 4), "front": 0, "cut": rng.randrange(4, n // 2)}[way]
    other = w[:at] + w[at + len(extra):] if way == "cut" else w[:at] + extra + w[at:]
    return " ".join(w), " ".join(other)


@pytest.mark.parametrize("buckets", [J.COUNT_BUCKETS, 64])
def test_one_document_is_the_other_plus_or_less_a_passage(spark, buckets):
    """Unshared prefix tokens of one set may lie beyond the other's prefix."""
    rng = random.Random(17)
    x = [f"c{i}" for i in range(95)]                   # 92 shingles, and 100 with 8 more words: J = 0.92
    texts = [" ".join(x), " ".join(x + [f"d{i}" for i in range(8)])]
    for way in ("append", "insert", "front", "cut"):
        for _ in range(25):
            texts += grown(rng, rng.randrange(60, 160), way)
    df = documents(spark, texts)
    want = brute(list(enumerate(texts)))
    assert len(set(want.values())) <= len(texts) - 80
    got = J.similarity_components(df, count_buckets=buckets)
    assert {r.doc_id: r.component_id for r in got.collect()} == want
