"""Answer-evaluation queries: support metrics, relevance, truth check, benchmark run."""

from __future__ import annotations

from pyspark.sql import functions as F

from gtspark import config as C
from gtspark.operators import evaluate, marts, medallion, retrieval
from gtspark.plans.q_retrieval import answer_ctes, answers_from_hits, hits_df, retrieve_sql
from gtspark.plans.q_text import hashed_sql, sents_sql
from gtspark.plans.q_truth import TRUTH_BODY, truth_df
from gtspark.plans.registry import register
from gtspark.plans.views import v_cases, v_claims, v_given, v_queries, v_reports, with_views
from gtspark.session import materialise, shuffled


def grounded_answers(spark, sf_dir):
    """(aid, query, answer, contexts) of the grounded answerer on the benchmark questions."""
    a = retrieval.grounded_answer(v_queries(spark, sf_dir), hits_df(spark, sf_dir))
    return materialise(a.select(F.col("query_id").alias("aid"), "query", "answer", "contexts"), "answers")


_CLAIMS_SQL = f""",
claims AS (SELECT aid, unnest(s) AS claim, CAST(unnest(generate_series(0, len(s) - 1)) AS INTEGER) AS cpos
           FROM (SELECT query_id AS aid, {sents_sql('answer')} AS s FROM ans)),
ctexts AS (SELECT query_id AS aid, unnest(contexts) AS ctext,
                  CAST(unnest(generate_series(0, len(contexts) - 1)) AS INTEGER) AS ci FROM ans),
csent AS (SELECT aid, ci, unnest(s) AS sent, CAST(unnest(generate_series(0, len(s) - 1)) AS INTEGER) AS spos
          FROM (SELECT aid, ci, {sents_sql('ctext')} AS s FROM ctexts)),
claim_src AS (SELECT aid || '|' || cpos AS cid, aid, cpos, claim FROM claims),
sent_src AS (SELECT aid || '|' || ci || '|' || spos AS sid, aid, sent FROM csent),
{hashed_sql('cv', 'claim_src', 'cid', 'claim')},
{hashed_sql('sv', 'sent_src', 'sid', 'sent')},
cdots AS (SELECT c.aid, c.cpos, s.sid, SUM(v1.w * v2.w) AS dot
         FROM cv v1 JOIN claim_src c ON c.cid = v1.id
         JOIN sv v2 ON v2.bucket = v1.bucket JOIN sent_src s ON s.sid = v2.id AND s.aid = c.aid
         GROUP BY ALL),
best AS (SELECT aid, cpos, max(dot) AS best FROM cdots GROUP BY ALL),
sup AS (SELECT cl.aid, cl.cpos, greatest(coalesce(b.best, 0.0), 0.0) / (1 + 1e-9) AS support
        FROM claims cl LEFT JOIN best b ON b.aid = cl.aid AND b.cpos = cl.cpos),
g AS (SELECT aid, avg(CASE WHEN support >= {C.SUPPORT_THRESHOLD} THEN 1.0 ELSE 0.0 END)::DOUBLE AS groundedness,
             min(support) AS faithfulness FROM sup GROUP BY aid)"""


@register("groundedness", answer_ctes() + _CLAIMS_SQL + """
SELECT a.query_id AS aid, round(coalesce(g.groundedness, 0.0), 6) AS groundedness,
       round(coalesce(g.faithfulness, 0.0), 6) AS faithfulness,
       round(coalesce(g.groundedness, 0.0), 6) AS judge_score
FROM ans a LEFT JOIN g ON g.aid = a.query_id""")
def groundedness(spark, sf_dir):
    """Support metrics of the grounded answers."""
    g = evaluate.grounding(grounded_answers(spark, sf_dir))
    return g.select("aid", *[F.round(c, 6).alias(c) for c in ("groundedness", "faithfulness", "judge_score")])


_REL_SQL = f""",
qsrc AS (SELECT query_id AS id, query FROM ans),
asrc AS (SELECT query_id AS id, answer FROM ans),
csrc AS (SELECT aid || '|' || ci AS id, aid, ctext FROM ctexts),
{hashed_sql('qv', 'qsrc', 'id', 'query')},
{hashed_sql('av', 'asrc', 'id', 'answer')},
{hashed_sql('cxv', 'csrc', 'id', 'ctext')},
adot AS (SELECT q.id AS aid, SUM(q.w * a.w) AS d FROM qv q JOIN av a ON a.id = q.id AND a.bucket = q.bucket GROUP BY 1),
cdot AS (SELECT q.id AS aid, SUM(q.w * c.w) AS d FROM qv q JOIN csrc s ON s.aid = q.id
         JOIN cxv c ON c.id = s.id AND c.bucket = q.bucket GROUP BY 1)"""


@register("relevance", answer_ctes() + """,
ctexts AS (SELECT query_id AS aid, unnest(contexts) AS ctext,
                  CAST(unnest(generate_series(0, len(contexts) - 1)) AS INTEGER) AS ci FROM ans)""" + _REL_SQL + """
SELECT a.query_id AS aid,
       round(CASE WHEN len(a.contexts) > 0 THEN coalesce(c.d, 0.0) / (1 + 1e-9) / len(a.contexts) ELSE 0.0 END, 6)
         AS context_relevance,
       round(coalesce(d.d, 0.0) / (1 + 1e-9), 6) AS answer_relevance
FROM ans a LEFT JOIN adot d ON d.aid = a.query_id LEFT JOIN cdot c ON c.aid = a.query_id""")
def relevance(spark, sf_dir):
    """Context and answer relevance of the grounded answers."""
    r = evaluate.relevance(grounded_answers(spark, sf_dir))
    return r.select("aid", F.round("context_relevance", 6).alias("context_relevance"),
                    F.round("answer_relevance", 6).alias("answer_relevance"))


_FOUND_SQL = """coalesce(
  CAST(nullif(regexp_extract(answer, '(?i)categor(?:y|ies)\\s*([1-5])', 1), '') AS INTEGER),
  CASE lower(regexp_extract(answer, '(?i)categor(?:y|ies)\\s+(one|two|three|four|five)', 1))
    WHEN 'one' THEN 1 WHEN 'two' THEN 2 WHEN 'three' THEN 3 WHEN 'four' THEN 4 WHEN 'five' THEN 5 END)"""


@register("halluc_flag", with_views("", "v_points", "v_storms", "v_claims").rstrip() + "," + TRUTH_BODY + f"""
SELECT c.event_id, c.storm_id, t.landfall_category AS expected, t.landfall_category IS NOT NULL AS checkable,
       coalesce((CASE WHEN t.landfall_category IS NOT NULL THEN {_FOUND_SQL} END) <> t.landfall_category, FALSE) AS contradicted,
       CASE WHEN t.landfall_category IS NOT NULL THEN {_FOUND_SQL} END AS found,
       (CASE WHEN t.landfall_category IS NOT NULL THEN {_FOUND_SQL} END) <> t.landfall_category AS hallucinated
FROM v_claims c LEFT JOIN storm_truth t ON t.storm_id = c.storm_id""")
def halluc_flag(spark, sf_dir):
    """Claimed category against the ground-truth table."""
    chk = evaluate.truth_check(v_claims(spark, sf_dir), truth_df(spark, sf_dir))
    return chk.select("event_id", "storm_id", "expected", "found", "checkable", "contradicted", "hallucinated")


PRICED = "openai:gpt-4o-mini"


def generations(spark, sf_dir):
    """Two answerers, one of them also under a priced model's name, over the storm cases (E11: more models = more rows)."""
    cases = v_cases(spark, sf_dir)
    docs = medallion.event_corpus(v_reports(spark, sf_dir), id_col="doc_id", text_col="text")
    q = cases.select("query_id", "query")
    hits = retrieval.retrieve(q, materialise(retrieval.chunk_docs(docs), "chunks"), k=C.TOP_K, top_k=C.TOP_K)
    g = retrieval.grounded_answer(q, hits)
    g = g.unionByName(g.withColumn("model", F.lit(PRICED))).unionByName(retrieval.prior_answer(q, hits))
    g = g.join(shuffled(cases.select("query_id", "storm_id")), "query_id")
    return materialise(
        g.select(F.col("query_id").alias("question_id"), "storm_id", F.col("query").alias("question"), "model", "answer",
                 "prompt_tokens", "completion_tokens", "contexts"), "generations")


_PRICE = " ".join(f"WHEN '{m}' THEN prompt_tokens / 1000.0 * {a} + completion_tokens / 1000.0 * {b}"
                  for m, (a, b) in C.PRICING.items())
_RUN_SQL = (retrieve_sql("v_reports", "v_cases").replace("\nWITH ", "WITH ") + answers_from_hits("v_cases", True, False, "_g")
            + answers_from_hits("v_cases", False, True, "_n") + f""",
gen AS (SELECT m.model, g.*, greatest(1, length(g.query || g.context) // 4) AS prompt_tokens
        FROM ans_g g, (VALUES ('mock-grounded'), ('{PRICED}')) m(model)
        UNION ALL SELECT 'mock-naive', n.*, greatest(1, length(n.query) // 4) FROM ans_n n),
ans AS (SELECT model || '|' || query_id AS query_id, query, contexts, answer FROM gen)""" + _CLAIMS_SQL + _REL_SQL
            + f""",
truth AS ({{truth}}),
rows_ AS (SELECT gen.model, gen.query_id AS question_id, c.storm_id, gen.answer, gen.prompt_tokens,
                 greatest(1, length(gen.answer) // 4) AS completion_tokens, len(gen.contexts) AS n_ctx,
                 coalesce(g.groundedness, 0.0) AS groundedness, coalesce(g.faithfulness, 0.0) AS faithfulness,
                 CASE WHEN len(gen.contexts) > 0 THEN coalesce(cd.d, 0.0) / (1 + 1e-9) / len(gen.contexts) ELSE 0.0 END AS context_relevance,
                 coalesce(ad.d, 0.0) / (1 + 1e-9) AS answer_relevance,
                 CASE WHEN t.landfall_category IS NOT NULL THEN {_FOUND_SQL.replace('answer', 'gen.answer')} END <> t.landfall_category
                   AS hallucinated
          FROM gen JOIN v_cases c ON c.query_id = gen.query_id
          LEFT JOIN truth t ON t.storm_id = c.storm_id
          LEFT JOIN g ON g.aid = gen.model || '|' || gen.query_id
          LEFT JOIN cdot cd ON cd.aid = gen.model || '|' || gen.query_id
          LEFT JOIN adot ad ON ad.aid = gen.model || '|' || gen.query_id)
SELECT 'run-' || model AS run_id, model, question_id, storm_id, answer, round(groundedness, 6) AS groundedness,
       round(faithfulness, 6) AS faithfulness, round(context_relevance, 6) AS context_relevance,
       round(answer_relevance, 6) AS answer_relevance, round(groundedness, 6) AS judge_score, hallucinated,
       round(CASE model {_PRICE} ELSE 0.0 END, 6)::DOUBLE AS cost_usd, prompt_tokens, completion_tokens,
       round(groundedness - CASE WHEN hallucinated THEN 1.0 ELSE 0.0 END, 6) AS reward
FROM rows_""")


def _run_sql() -> str:
    body = _RUN_SQL.replace("{truth}", "SELECT * FROM storm_truth")
    views = with_views("", "v_points", "v_storms").rstrip() + "," + TRUTH_BODY
    return views + ",\n" + body[len("WITH "):]


def run_rows(spark, sf_dir):
    return evaluate.evaluation_rows(generations(spark, sf_dir), truth_df(spark, sf_dir))


@register("benchmark_run", _run_sql())
def benchmark_run(spark, sf_dir):
    """The evaluation rows of three models over the storm cases."""
    rows = run_rows(spark, sf_dir)
    rounded = ("groundedness", "faithfulness", "context_relevance", "answer_relevance", "judge_score", "reward")
    return rows.select("run_id", "model", "question_id", "storm_id", "answer", "hallucinated", "cost_usd", "prompt_tokens",
                       "completion_tokens", *[F.round(c, 6).alias(c) for c in rounded])


_SUMMARY = ("groundedness", "faithfulness", "context_relevance", "answer_relevance", "judge_score")


@register("benchmark_summary", f"""
WITH evaluated AS ({_run_sql()})
SELECT run_id, {', '.join(f'round(avg({c}), 4) AS mean_{c}' for c in _SUMMARY)},
       round(coalesce(avg(CASE WHEN hallucinated THEN 1.0 WHEN NOT hallucinated THEN 0.0 END), 0.0), 4)::DOUBLE AS hallucination_rate,
       round(sum(cost_usd), 6) AS total_cost_usd, NULL::DOUBLE AS p50_latency_ms
FROM evaluated GROUP BY 1""")
def benchmark_summary(spark, sf_dir):
    """Every mean of each model's run, its checked hallucination rate and cost."""
    s = marts.run_summary(materialise(run_rows(spark, sf_dir), "evaluations"))
    return s.select("run_id", *[F.round(f"mean_{c}", 4).alias(f"mean_{c}") for c in _SUMMARY],
                    F.round("hallucination_rate", 4).alias("hallucination_rate"),
                    F.round("total_cost_usd", 6).alias("total_cost_usd"), "p50_latency_ms")


_GIVEN_SQL = with_views(f""", ans AS (SELECT aid AS query_id, question AS query, answer, contexts, expected, verdict FROM v_given)
{_CLAIMS_SQL}{_REL_SQL}""", "v_pairs", "v_given")


@register("given_answers", _GIVEN_SQL + f"""
SELECT a.query_id AS aid, round(coalesce(g.groundedness, 0.0), 6) AS groundedness,
       round(coalesce(g.faithfulness, 0.0), 6) AS faithfulness, round(coalesce(d.d, 0.0) / (1 + 1e-9), 6) AS answer_relevance,
       {_FOUND_SQL} <> expected AS hallucinated
FROM ans a LEFT JOIN g ON g.aid = a.query_id LEFT JOIN adot d ON d.aid = a.query_id""")
def given_answers(spark, sf_dir):
    """Metrics of given answers with their contexts and expected categories."""
    r = evaluate.evaluate_given(v_given(spark, sf_dir))
    return r.select("aid", *[F.round(c, 6).alias(c) for c in ("groundedness", "faithfulness", "answer_relevance")], "hallucinated")


@register("judge_scores", _GIVEN_SQL + """
SELECT a.query_id AS aid, round(coalesce(g.groundedness, 0.0), 6) AS groundedness,
       round(coalesce(a.verdict, g.groundedness, 0.0), 6) AS judge_score
FROM ans a LEFT JOIN g ON g.aid = a.query_id""")
def judge_scores(spark, sf_dir):
    """Supplied verdicts where they can be read, else the heuristic judge."""
    given = v_given(spark, sf_dir)
    a = given.select("aid", F.col("question").alias("query"), "answer",
                     F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"))
    r = evaluate.judged(evaluate.grounding(a), given.filter(F.col("verdict").isNotNull()).select("aid", "verdict"))
    return r.select("aid", F.round("groundedness", 6).alias("groundedness"), F.round("judge_score", 6).alias("judge_score"))


@register("judge_prompts", with_views(f"""
SELECT aid, replace(replace('{C.JUDGE_TEMPLATE}', '{{{{ answer }}}}', answer), '{{{{ context }}}}',
                    array_to_string(contexts, chr(10) || chr(10))) AS prompt FROM v_given""", "v_pairs", "v_given"))
def judge_prompts(spark, sf_dir):
    """The judge's prompt for every given answer."""
    return evaluate.judge_prompts(v_given(spark, sf_dir))
