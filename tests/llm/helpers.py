"""Inputs of the subpackage's tests: small tables that hold every awkward case."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def near(rng, w, edits):
    w = list(w)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return w


def corpus(seed=3, groups=12, per=6):
    """Texts with exact and near copies, null, empty, blank, short, long and odd ones."""
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = words(rng, rng.randrange(30, 160))
        texts += [" ".join(near(rng, base, rng.randrange(0, 6))) for _ in range(per)]
        texts.append(" ".join(base))
        texts.append(" ".join(base).upper())
    texts += [None, "", "   \n\t ", "one", "one", "one two three", "ONE TWO three", "é É ü日本", "a\x0bb\x0cc d",
              " ".join(words(rng, 30_000, 50_000)), "same same same same same same", "\n\n", "x" * 5000]
    texts += texts[:3]
    rng.shuffle(texts)
    return texts


def documents(spark, texts=None, ids=None, extra=""):
    texts = corpus() if texts is None else texts
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "src0", len(t) if t else 0) for i, t in zip(ids, texts)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return df.selectExpr("*", *[f"'own' as `{c}`" for c in extra.split()])


def smallest(ids, links):
    """Component (smallest id) of each id under the links."""
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
