"""The pipeline against its stages' brute-force versions on a small corpus."""

import random

import pytest
from helpers import near, words

import test_decontaminate
import test_line_dedup
import test_ngram_join
import test_packing

import corpus_pipeline as P

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng, path = random.Random(9), str(tmp_path_factory.mktemp("sf"))
    items = [(i, " ".join(words(rng, 20, 10**6))) for i in range(5)]
    base = words(rng, 80, 10**6)
    texts = []
    for i in range(120):
        w = words(rng, 40, 10**6)
        if i % 4 == 0:
            w = [x + "###" for x in w]                   # poor
        elif i % 7 == 0:
            w = w[:20] + items[i % 5][1].split() + w[20:]
        elif i % 5 == 0:
            w = near(rng, base, 1)
            w[40:40] = ["\n" + " ".join(words(rng, 3, 10**6)) + "\n"]
        texts.append(" ".join(w) + ("\nAll rights are reserved here." if i % 3 == 0 else ""))
    texts += [None, "", texts[1], texts[1]]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(120)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_each_stage_against_brute_force(spark, sf_dir, tmp_path):
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "ngram_join", "decontamination", "packing"]
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in P.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before
        if name != "packing":
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.collect()}
            assert set(after) <= set(before)
        if name == "quality":
            assert all(i % 4 for i in after if i < 120) and len([i for i in after if i < 120]) == 90
        if name == "line_dedup":
            comp = test_line_dedup.components(before.values())
            left = [comp[x] for t in after.values() for _, x in test_line_dedup.lines(t)]
            assert sorted(left) == sorted(set(comp.values()))
            gone = set(before) - set(after)
            assert gone and all(test_line_dedup.lines(before[i]) for i in gone)
            assert all(r.n_chars == len(r.text or "") for r in docs.collect())
        if name == "ngram_join":
            comp = test_ngram_join.brute(before.items())
            assert set(after) == set(comp.values())
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            bad = {d for d, x in test_decontaminate.brute(before, items).items() if x[4]}
            assert bad and set(after) == set(before) - bad
        if name == "packing":
            from tokenizers import Tokenizer

            from gtspark.llm.queries import tokenizer_path
            tok = Tokenizer.from_file(tokenizer_path())
            test_packing.check(docs.collect(), before, tok, 2048)


def test_run_is_the_stages_in_turn(spark, sf_dir):
    import __spark_entry__

    got = __spark_entry__.queries()["pipeline"](spark, sf_dir)
    assert "pipeline" not in __spark_entry__.oracle_sql()
    assert got.count() > 0 and "sequence_id" in got.columns
