import random
import zlib

import numpy as np
import pyarrow as pa
from helpers import documents, words

from gtspark.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_on_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    got = Q.report(docs, labels)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "boolean", "double", "int"]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    held = [(rows[r.doc_id].predicted, r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    assert len(held) > 50 and np.mean([p == q for p, q in held]) >= 0.95


def test_held_out_labels_teach_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2,"
                                          " 1 - quality, quality) as quality", "toxic")
    a, b = ({r.doc_id: r.score for r in Q.report(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def junk(spark, n=160):
    rng = random.Random(1)
    texts = [" ".join(words(rng, 50)) if i % 3 else " ".join(w + "$$$" for w in words(rng, 50)) for i in range(n)]
    return texts, [(i, int(i % 3 > 0), 0) for i in range(n)]


def test_awkward_rows(spark):
    texts, labels = junk(spark)
    extra = [None, "", "   ", "x" * 200_000, "ü", "a\x0bb", "\n\n\n"]
    df = documents(spark, texts + extra, extra="quality x score held_out __s")
    lab = spark.createDataFrame(labels + [(0, 0, 0), (0, 1, 0), (1, None, 0), (None, 1, 0), (2, 1, 0), (2, 1, 1), (5, 7, 0)],
                                "doc_id long, quality int, toxic int").selectExpr("*", "'t' as text")
    rows = Q.report(df, lab).collect()
    assert len(rows) == len(texts) + len(extra) and all(0 <= r.score <= 1 for r in rows)
    good = {r.doc_id: r.predicted for r in rows}
    assert all(good[i] == (i % 3 > 0) for i in range(len(texts)))
    kept = Q.keep_good(df, lab)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, p in good.items() if p}


def test_no_labels_no_rows_null_and_repeated_ids(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = Q.report(documents(spark, ["a", None, "a"], [3, None, 3]), lab).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.5, 0)] * 3
    assert sorted((r.doc_id or -1, r.held_out) for r in got)[0] == (-1, False)
    assert Q.report(documents(spark, []), lab).count() == 0


def test_statistics_match_plain_python():
    text = "The the CAT!! 12 é a.\n\nThe the CAT!! 12 é a.\nlast"
    x = dict(zip(Q.NAMES, Q._table(pa.array(["zz zz", text, ""]))[1]))
    w, raw = text.lower().split(), text.encode()
    assert np.isclose(x["bytes"], np.log1p(len(raw))) and np.isclose(x["words"], np.log1p(len(w)))
    assert np.isclose(x["distinct_words"], len(set(w)) / len(w)) and np.isclose(x["top_word"], 4 / len(w))
    assert np.isclose(x["twin_words"], 2 / len(w)) and np.isclose(x["stops"], 2 / len(w))
    assert np.isclose(x["sign_ends"], 2 / len(w)) and np.isclose(x["short_words"], 10 / len(w))
    assert np.isclose(x["lines"], np.log1p(3)) and np.isclose(x["distinct_lines"], 2 / 3)
    assert np.isclose(x["distinct_pairs"], len(set(zip(w, w[1:]))) / (len(w) - 1))
    assert np.isclose(x["digits"], 4 / len(raw)) and np.isclose(x["foreign"], 4 / len(raw))


def test_trees_separate_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    m = Q.fit(x[:2000], y[:2000], trees=60)
    assert np.mean((m.score(x[2000:]) > 0.5) == y[2000:]) > 0.95

    def plain(row):
        out = m.base
        for f, t, v in zip(m.feature, m.limit, m.value):
            n = 0
            while n < len(f):
                n = 2 * n + 1 + (row[f[n]] > t[n])
            out += v[n - len(f)]
        return out
    assert np.allclose([plain(r) for r in x[:20]], m.margin(x[:20]))
