import hashlib
import random
import re

import pytest
from helpers import corpus, documents, words

from gtspark.llm import decontaminate as D


def split(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)


def brute(texts, items):
    wins = {}
    for i, t in items:
        w = split(t)
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[j:j + n]), set()).add(i)
    out = {}
    for d, t in texts.items():
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in wins}:
            for j in range(len(w) - n + 1):
                own = wins.get(tuple(w[j:j + n]))
                if own is not None:
                    hit |= set(range(j, j + n))
                    found |= own
        found = sorted(str(x) for x in found if x is not None)
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(),
                  len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def sample():
    rng = random.Random(6)
    items = [(i * 7, " ".join(words(rng, rng.randrange(10, 40), 60))) for i in range(30)]
    items += [(1000, "short one"), (1001, "Solo"), (1002, None), (1003, "..."), (1004, items[0][1]), (None, items[3][1]),
              (1005, "é ü ñ ß"), (0, "the same id again with another text of more than thirteen words in all of it"),
              (7, items[1][1])]
    texts = corpus(groups=4)
    for i in range(60):
        w = words(rng, rng.randrange(0, 400), 60)
        src = (rng.choice(items)[1] or "").split()
        cut = src[rng.randrange(3):len(src) - rng.randrange(3)]
        at = rng.randrange(len(w) + 1)
        texts.append(", ".join(w[:at] + cut + w[at:]) if i % 3 else " ".join(cut).upper())
    texts += ["solo", "short-one!", "short two one", "É Ü ñ ß", " ".join(["same"] * 30)]
    return texts, items


@pytest.mark.parametrize("block", [2_000_000, 60])
def test_matches_brute_force(spark, block):
    texts, items = sample()
    ben = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as token")
    got = D.report(documents(spark, texts, extra="token n items"), ben, block_words=block).collect()
    want = brute(dict(enumerate(texts)), items)
    assert {r.doc_id: tuple(r)[1:] for r in got} == want
    assert any(w[4] for w in want.values()) and not all(w[4] for w in want.values())


def test_empty_tables_and_filter(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    df = documents(spark, ["a b c", None], extra="__y")
    got = D.report(df, none).collect()
    assert sorted((r.n_words, r.n_hit, r.contaminated) for r in got) == [(0, 0, False), (3, 0, False)]
    assert D.report(documents(spark, []), none).count() == 0
    ben = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    out = D.drop_contaminated(df, ben)
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [1]


def test_twice_the_same_row(spark):
    ben = spark.createDataFrame([(1, "a b c")] * 2, "item_id long, text string")
    got = D.report(documents(spark, ["a b c", "a b c"], [4, 4]), ben).collect()
    assert [tuple(r)[:4] for r in got] == [(4, 3, 3, 1)] * 2
