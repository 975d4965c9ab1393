import pytest
from pyspark.sql import functions as F

from gtspark import config as C
from gtspark.operators import evaluate, retrieval
from gtspark.operators import sweep as S

REPORTS = [("r1", "Hurricane Florence weakened. It made landfall near the coast as a Category 1 hurricane. Rain was heavy."),
           ("r2", "Hurricane Dorian passed the capes. It came ashore as a Category 1 hurricane. Roads were closed."),
           ("r3", "Hurricane Irene was large. Landfall came near the inlet as a Category 1 hurricane. Trees fell."),
           ("r4", "The winter was quiet. Boats stayed in port.")]
CASES = [("q1", "s1", "What category was Hurricane Florence at landfall?"), ("q2", "s2", "What category was Dorian when it came ashore?"),
         ("q3", "s3", "What category was Irene at landfall?"), ("q4", None, "How was the winter for boats?")]
TRUTH = [("s1", 1), ("s2", 1), ("s3", 1)]


@pytest.fixture(scope="module")
def asked(spark):
    docs = spark.createDataFrame(REPORTS, "doc_id string, text string")
    cases = spark.createDataFrame(CASES, "query_id string, storm_id string, query string")
    hits = retrieval.retrieve(cases.select("query_id", "query"), retrieval.chunk_docs(docs))
    return cases, hits


def run(spark, cases, answers):
    truth = spark.createDataFrame(TRUTH, "storm_id string, landfall_category int")
    g = answers.join(cases.select("query_id", "storm_id"), "query_id").withColumnsRenamed(
        {"query_id": "question_id", "query": "question"})
    return {r["question_id"]: r for r in evaluate.evaluation_rows(g, truth).collect()}


def test_grounded_answers_never_and_prior_answers_always_contradict_the_truth(spark, asked):
    cases, hits = asked
    grounded = run(spark, cases, retrieval.grounded_answer(cases, hits))
    prior = run(spark, cases, retrieval.prior_answer(cases, hits))
    assert [grounded[q]["hallucinated"] for q in ("q1", "q2", "q3", "q4")] == [False, False, False, None]
    assert [prior[q]["hallucinated"] for q in ("q1", "q2", "q3", "q4")] == [True, True, True, None]
    assert all(r["groundedness"] == 1.0 and r["reward"] == 1.0 for r in grounded.values())
    assert prior["q1"]["answer"] == C.NAIVE_PRIOR[0][1] and prior["q1"]["reward"] == prior["q1"]["groundedness"] - 1.0
    assert prior["q4"]["answer"] == grounded["q4"]["answer"] == "The winter was quiet."


def test_landfall_bonus_picks_the_landfall_sentence(spark):
    q = spark.createDataFrame([("q", "Did the big red storm landfall?")], "query_id string, query string")
    hits = spark.createDataFrame([("q", 1, "The big red storm did grow. Ashore it came.")], "query_id string, rank int, text string")
    assert retrieval.grounded_answer(q, hits).first()["answer"] == "The big red storm did grow."
    q2 = spark.createDataFrame([("q", "Landfall?")], "query_id string, query string")
    assert retrieval.grounded_answer(q2, hits).first()["answer"] == "Ashore it came."
    assert retrieval.prior_answer(q2, hits).first()["answer"] == "The big red storm did grow."          # no bonus, first wins


def test_prices_by_model(spark):
    df = spark.createDataFrame([("openai:gpt-4o", 2000, 500), ("other", 2000, 500), ("openai:gpt-4o-mini", 1000, 1000)],
                               "model string, p int, c int")
    assert [r[0] for r in df.select(evaluate.cost_usd("model", "p", "c")).collect()] == [0.01, 0.0, 0.00075]


def test_verdicts(spark):
    texts = ['{"grounded": true}', '{"grounded": false, "reason": "x"}', '{"reason": "x"}', "no", '{"grounded": tr', "", None,
             '{"grounded": "yes"}', '{"grounded": 0}', '{"grounded": null}', ' {"grounded": true} ', '[true]', '{"grounded": []}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    got = [r[0] for r in df.select(evaluate.verdict_score("v").alias("s"), "i").orderBy("i").collect()]
    assert got == [1.0, 0.0, 0.0, None, None, None, None, 1.0, 0.0, 0.0, 1.0, None, 0.0]
    rows = spark.createDataFrame([("a", 0.25, 0.25), ("b", 0.5, 0.5), ("c", 0.75, 0.75)], "aid string, groundedness double, judge_score double")
    given = spark.createDataFrame([("a", texts[0]), ("a", texts[1]), ("b", "nonsense"), ("z", texts[0])], "aid string, verdict string")
    assert {r["aid"]: r["judge_score"] for r in evaluate.judged(rows, given).collect()} == {"a": 0.5, "b": 0.5, "c": 0.75}


def test_judge_prompt(spark):
    df = spark.createDataFrame([("a", "An answer {{ context }}", ["one", "two"]), ("b", None, None)],
                               "aid string, answer string, contexts array<string>")
    got = {r["aid"]: r["prompt"] for r in evaluate.judge_prompts(df).collect()}
    assert got["a"].endswith("\n\nContext:\none\n\ntwo\n\nAnswer to grade:\nAn answer one\n\ntwo") or \
        "Context:\none\n\ntwo\n\nAnswer to grade:\nAn answer" in got["a"]
    assert got["b"].endswith("Context:\n\n\nAnswer to grade:\n")


def test_given_answers(spark):
    rows = [("a", "Was it strong?", "It was a Category 2 storm.", ["It was a Category 2 storm. Rain."], 2),
            ("b", "Was it strong?", "It was a Category 3 storm.", [], 2), ("c", None, None, None, 1),
            ("d", "x", "Category four it was.", ["Category four it was."], None)]
    df = spark.createDataFrame(rows, "aid string, question string, answer string, contexts array<string>, expected int")
    got = {r["aid"]: r for r in evaluate.evaluate_given(df).collect()}
    assert (got["a"]["groundedness"], got["a"]["hallucinated"]) == (1.0, False) and got["a"]["faithfulness"] > 0.99
    assert (got["b"]["groundedness"], got["b"]["hallucinated"]) == (0.0, True)
    assert (got["c"]["groundedness"], got["c"]["answer_relevance"], got["c"]["hallucinated"]) == (0.0, 0.0, None)
    assert got["d"]["hallucinated"] is None and got["d"]["groundedness"] == 1.0


def test_sweep_cells_equal_single_runs(spark):
    docs = spark.createDataFrame([(f"d{i}", " ".join(f"w{(i * 7 + j * j) % 50}" for j in range(40 + 30 * i)) + ".") for i in range(8)],
                                 "doc_id string, text string")
    q = spark.createDataFrame([(f"q{i}", " ".join(f"w{(i + 3 * j) % 50}" for j in range(6))) for i in range(5)], "query_id string, query string")
    cells = [S.Cell("a", 30, 10, "lexical", top_k=2), S.Cell("b", 50, 5, "none", "rag_v2", 3), S.Cell("c", 30, 10, "none", top_k=3)]
    hits = S.cell_hits(q, docs, cells)
    for c in cells:
        want = retrieval.retrieve(q, retrieval.chunk_docs(docs, c.chunk_size, c.overlap), k=c.top_k, top_k=c.top_k, strategy=c.strategy)
        key = lambda r: (r["query_id"], r["rank"])
        a = sorted(((r["query_id"], r["rank"], r["chunk_id"].split("|")[1], r["score"])
                    for r in hits.filter(F.col("cell") == c.label).collect()))
        b = sorted((*key(r), r["chunk_id"], r["score"]) for r in want.collect())
        assert a == b, c.label
    rows, prompts = S.run_cells(q, docs, cells)
    assert rows.groupBy("run_id").count().collect().__len__() == 3 and rows.count() == 15 == prompts.count()
    p = prompts.filter("cell = 'b'").first()["prompt"]
    assert p.startswith("Use the retrieved") and "[1] " in p
    assert len(S.chunk_cells(docs, cells).select("chunking").distinct().collect()) == 2


def test_sweep_grid_and_bad_cells(spark):
    g = S.grid("chunk_size", (160, 320, 640))
    assert [(c.label, c.chunk_size, c.overlap) for c in g] == [(f"chunk_size={v}", v, C.CHUNK_OVERLAP) for v in (160, 320, 640)]
    for bad in ([], [S.Cell("a"), S.Cell("a")], [S.Cell("a", strategy="best")], [S.Cell("a", template="none")], [S.Cell("a", top_k=0)]):
        with pytest.raises(ValueError):
            S.cell_rows(spark, bad)


def test_embedding_of_odd_texts(spark):
    df = spark.createDataFrame([("a", "x x y"), ("b", ""), ("c", None), ("d", "é!"), ("e", "one")], "id string, text string")
    got = {}
    for r in retrieval.embed(df).collect():
        got.setdefault(r["id"], []).append(r["w"])
    assert set(got) == {"a", "e"} and got["e"] == [1.0]
    assert abs(sum(w * w for w in got["a"]) - 1) < 1e-12 and len(got["a"]) <= 4          # x, y, x_x, x_y; x counts twice
