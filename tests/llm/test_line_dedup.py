import random

import numpy as np
from helpers import documents, smallest, words

from gtspark.llm import line_dedup as L

TRIM = " \t\r\x0b\x0c\n"


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(TRIM))


def sim(a, b, k=L.SHINGLE):
    x, y = ({t[i:i + k] for i in range(max(1, len(t) - k + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def lines(text):
    return [(i, low(x)) for i, x in enumerate((text or "").split("\n")) if x.strip(TRIM)]


def components(texts):
    all_lines = sorted({x for t in texts for _, x in lines(t)})
    links = [(i, j) for i, a in enumerate(all_lines) for j in range(i)
             if sim(a, b := all_lines[j]) >= 0.8 and b]
    got = smallest(range(len(all_lines)), links)
    return {x: got[i] for i, x in enumerate(all_lines)}


def sample(seed=4):
    rng = random.Random(seed)
    base = [" ".join(words(rng, 40)) for _ in range(6)]
    texts = []
    for _ in range(40):
        own = [" ".join(words(rng, rng.randrange(1, 40), 10**6)) for _ in range(3)]
        w = rng.choice(base).split()
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        own.insert(rng.randrange(4), " ".join(w))
        own.append(rng.choice(["Licensed.", "", "  ", "licensed.  ", base[0]]))
        texts.append("\n".join(own))
    return texts + [None, "", "\n\n", "Licensed.\nLicensed.\nnew", "日本語の行です\n日本語の行です", "x" * 4000, "\ttabs \r\n"]


def test_one_line_per_component(spark):
    texts = sample()
    comp = components(texts)
    got = {r.doc_id: r for r in L.report(documents(spark, texts, extra="id n line_no __x")).collect()}
    assert len(got) == len(texts)
    left = [comp[x] for r in got.values() for _, x in lines(r.text)]
    assert sorted(left) == sorted(set(comp.values()))            # exactly one of each
    for i, t in enumerate(texts):
        assert got[i].n_lines == len(lines(t))
        assert got[i].n_lines - got[i].n_removed == len(lines(got[i].text))
        assert (t is None) == (got[i].text is None)
        kept = (got[i].text or "").split("\n")
        it = iter((t or "").split("\n"))
        assert all(any(x == y for y in it) for x in kept)        # order and content stay
    assert got[texts.index("\n\n")].text == "\n\n"


def test_bands_recall():
    """Lines of similarity 0.8 to 0.9 nearly always share a band key."""
    import numpy as np

    rng, hit, total = random.Random(2), 0, 0
    for _ in range(400):
        a = " ".join(words(rng, 45, 10**6))
        w = a.split()
        for _ in range(2):
            w[rng.randrange(len(w))] = f"q{rng.randrange(10**6)}"
        b = " ".join(w)
        if 0.8 <= sim(a, b) < 0.9:
            c = L.Chars([a, b])
            k = L.band_keys(*c.shingles(c.offs[:-1], c.offs[1:], L.SHINGLE), 2, L.BANDS, L.ROWS)
            total += 1
            hit += bool(np.any(k[0] == k[1]))
    assert total > 100 and hit / total >= 0.97


def test_pipeline_form(spark):
    texts = ["alpha beta gamma delta", "alpha beta gamma delta", None, "", "alpha beta gamma delta\nown line here"]
    df = documents(spark, texts, extra="id")
    out = L.dedup_lines(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {0: texts[0], 2: None, 3: "", 4: "own line here"}
    assert L.dedup_lines(df, keep_empty=True).count() == 5
    assert L.report(documents(spark, [])).count() == 0
    twice = documents(spark, ["one line", "one line", "one line"], [4, 4, 6])
    assert sorted((r.doc_id, r.text) for r in L.report(twice).collect()) == [(4, "one line"), (4, "one line"), (6, "")]
    assert L.report(documents(spark, ["a line", None], [None, None])).count() == 2


def test_short_lines_that_share_a_band_are_linked(spark):
    """Lines of 10 to 60 shingles and similarity 0.8 or more: none that the bands find is lost."""
    import numpy as np

    rng, pairs, met = random.Random(6), [], 0
    for _ in range(1500):
        n = rng.randrange(10, 61)
        a = "".join(rng.choice("bcdfghjklmnp") for _ in range(n + L.SHINGLE - 1))
        b = a + "".join(rng.choice("qrstvwxz") for _ in range(n // 4))
        assert sim(a, b) >= 0.8
        c = L.Chars([a, b])
        own = c.shingles(c.offs[:-1], c.offs[1:], L.SHINGLE)
        keys = L.band_keys(*own, 2, L.BANDS, L.ROWS)
        assert L.marks(*own, 2)[0].tolist() == [n, n + n // 4]
        met += bool(np.any(keys[0] == keys[1]))
        pairs.append(a + "\n" + b)
    got = L.report(documents(spark, pairs)).collect()
    assert sum(r.n_removed for r in got) == met >= 0.97 * len(pairs)


def test_marks_bound_the_overlap(spark, monkeypatch):
    """No linked pair is rejected by the second pass' bound, with many cells and with so few that all are marked."""
    rng = random.Random(8)
    base = " ".join(words(rng, 70, 10**6))
    lines = [base]
    for i in range(150):
        w = base.split()
        for _ in range(1 + i % 9):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        lines.append(" ".join(w))
    links = [(i, j) for i in range(len(lines)) for j in range(i) if sim(lines[i], lines[j]) >= 0.8]
    groups = set(smallest(range(len(lines)), links).values())
    for cells in (4096, 64):
        monkeypatch.setattr(L, "MORE_CELLS", cells)
        monkeypatch.setattr(L, "MORE", [f"w{i}" for i in range(cells // 64)])
        got = L.report(documents(spark, lines)).collect()
        assert sum(r.n_removed for r in got) == len(lines) - len(groups)


def test_band_keys_are_stored_in_32_bits_beside_their_band(spark):
    import pyarrow as pa

    class Every:
        value = type("All", (), {"has": staticmethod(lambda keys: np.ones(len(keys), bool))})

    texts = [("a line of some length, number %d" % i) + "\nand another, %d" % (7 * i) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = docs.mapInArrow(L._lines(L.SHINGLE, L.BANDS, L.ROWS), L.LINES)
    assert dict(lines.dtypes)["bands"] == "array<int>"
    posted = sorted(r.key for r in L._posted(lines).collect())
    batch = pa.Table.from_batches(lines.withColumn("w", lines.n.cast("long")).toArrow().to_batches()).combine_chunks().to_batches()[0]
    got = pa.Table.from_batches(L._postings(Every)(iter([batch.slice(3)])))
    kept = [r for b in batch.slice(3).column("bands").to_pylist() for r in b]
    assert [k & 0xFFFFFFFF for k in got["key"].to_pylist()] == [r & 0xFFFFFFFF for r in kept]
    assert {k >> 32 for k in posted} == set(range(L.BANDS)) and not set(got["key"].to_pylist()) - set(posted)
    assert len(posted) == 60 * L.BANDS


def test_keys_that_repeat_are_found_by_ranges(spark):
    """Keys are dealt by ranges, sorted; those that come more than once are found wherever their rows were, once each."""
    rng = random.Random(3)
    keys = [rng.randrange(12) << 32 | rng.randrange(1 << 32) for _ in range(500)] + [5, 0xFFFFFFFF, 3 << 32]
    keys += rng.sample(keys, 60) + [keys[-1]] * 40
    posted = spark.createDataFrame([(k,) for k in keys], "key long").repartition(5)
    dealt = posted.mapInArrow(L._dealt(7, 50), "part int, keys binary")
    rows = dealt.collect()
    assert max(r.part for r in rows) == 6 and len(rows) > 7
    assert all(len(r["keys"]) <= 8 * 102 for r in rows)
    got = [r.key for r in dealt.repartition(4, "part").mapInArrow(L._repeated, "key long").collect()]
    assert sorted(got) == sorted(k for k in set(keys) if keys.count(k) > 1)
    assert spark.createDataFrame([], "key long").mapInArrow(L._dealt(7), "part int, keys binary").count() == 0


def test_lines_are_stored_without_marks_and_hashed_like_single_ones(spark):
    """Only lines that may share a key are marked; blocks of lines hash as each line does alone."""
    rng = random.Random(5)
    own = ["x", "", " \t", "日本語の行です", "A" * 9, "b" * 8] + ["".join(rng.choice("abcXYZ é") for _ in range(rng.randrange(1, 900)))
                                                           for _ in range(200)]
    docs = spark.createDataFrame([(1, "\n".join(own + own[:5])), (2, "\r\n".join(own[:40])), (3, None)], "doc_id long, text string")
    lines = docs.mapInArrow(L._lines(L.SHINGLE, L.BANDS, L.ROWS), L.LINES)
    assert lines.columns == ["id", "check", "doc_id", "line_no", "n", "bands"]
    got = [r for r in lines.collect() if r.doc_id == 1]
    assert len(got) == len({low(x) for x in own} - {""})
    for r in got:
        c = L.Chars([low(own[r.line_no])])
        sh, span = c.shingles(c.offs[:-1], c.offs[1:], L.SHINGLE)
        assert len(set(sh.tolist())) == len({low(own[r.line_no])[i:i + 9] for i in range(max(1, len(low(own[r.line_no])) - 8))})
        key = L.band_keys(sh, span, 1, L.BANDS, L.ROWS)[0] >> np.uint64(32)
        assert [b & 0xFFFFFFFF for b in r.bands] == key.tolist()
        assert r.id == int(c.hash(c.offs[:-1], c.offs[1:]).view(np.int64)[0])
