"""Retrieval and answer queries: vector top-k, retrieve + rerank, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gtspark import config as C
from gtspark.operators import retrieval
from gtspark.plans.q_text import CHUNKS_SQL, CORPUS_SQL, corpus, hashed_sql, tokens_sql
from gtspark.plans.registry import register
from gtspark.session import scratch_path
from gtspark.plans.views import table, v_queries, with_views

K = C.TOP_K


def overlap_sql(a: str, b: str) -> str:
    qa = f"list_distinct({tokens_sql(a)})"
    return (f"(len(list_filter({qa}, lambda x: list_contains({tokens_sql(b)}, x))) "
            f"/ (len({qa}) + 1e-9))")


def strip_sql(s: str) -> str:
    return f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"


def raw_sents_sql(t: str) -> str:
    found = f"list_transform(regexp_extract_all({t}, '[^.!?]+[.!?]'), lambda s: {strip_sql('s')})"
    return f"CASE WHEN len({found}) > 0 THEN {found} ELSE [{t}] END"


@register("vector_topk", """
WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS nv FROM e),
s AS (SELECT q.id AS query_id, i.id AS item_id,
             round(list_dot_product(q.v, i.v) / (q.nv * i.nv + 1e-9), 9) AS score
      FROM n q, n i)
SELECT query_id, item_id, round(score, 6) AS score, rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s)
WHERE rank <= 4""")
def vector_topk(spark, sf_dir):
    """4 nearest neighbours (cosine) of every embedding."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    r = retrieval.topk_arrays(e, e, k=K, dim=64)
    return r.select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


def chunk_table(spark, sf_dir):
    return retrieval.chunk_docs(corpus(spark, sf_dir))


def hits_df(spark, sf_dir):
    return retrieval.retrieve(v_queries(spark, sf_dir), chunk_table(spark, sf_dir), k=K, top_k=K)


def retrieve_sql(docs: str = "v_docs", queries: str = "v_queries") -> str:
    """CTEs ending in ``hits`` (query_id, rank, chunk_id, doc_id, text, score) over the named views."""
    return with_views(f", {CORPUS_SQL}, {CHUNKS_SQL}, ".replace("v_docs", docs)
                      + hashed_sql("qvec", queries, "query_id", "query") + ", "
                      + hashed_sql("cvec", "chunks", "chunk_id", "text") + f""",
dots AS (SELECT q.id AS query_id, c.id AS chunk_id, SUM(q.w * c.w) AS dot
         FROM qvec q JOIN cvec c ON c.bucket = q.bucket GROUP BY 1, 2),
scored AS (SELECT q.query_id, c.chunk_id, round(coalesce(d.dot, 0.0) / (1 + 1e-9), 9) AS score
           FROM {queries} q CROSS JOIN chunks c
           LEFT JOIN dots d ON d.query_id = q.query_id AND d.chunk_id = c.chunk_id),
top AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank0
                       FROM scored) WHERE rank0 <= {K}),
rr AS (SELECT t.query_id, t.chunk_id, c.doc_id, c.text, t.rank0,
              round(0.5 * t.score + 0.5 * {overlap_sql('q.query', 'c.text')}, 9) AS score
       FROM top t JOIN chunks c ON c.chunk_id = t.chunk_id JOIN {queries} q ON q.query_id = t.query_id),
hits AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, rank0) AS rank
                        FROM rr) WHERE rank <= {K})""", docs, queries)


RETRIEVE_SQL = retrieve_sql()


@register("retrieve_rerank", RETRIEVE_SQL + """
SELECT query_id, rank, chunk_id, doc_id, text, round(score, 6) AS score FROM hits""")
def retrieve_rerank(spark, sf_dir):
    """Top-4 chunks per benchmark question, lexically reranked."""
    h = hits_df(spark, sf_dir)
    return h.select("query_id", "rank", "chunk_id", "doc_id", "text", F.round("score", 6).alias("score"))


@register("index_roundtrip", RETRIEVE_SQL + """
SELECT query_id, rank, chunk_id, doc_id, round(score, 6) AS score FROM hits""")
def index_roundtrip(spark, sf_dir):
    """SNK5 E21: the corpus index saved, loaded and searched."""
    path = scratch_path(spark, "index")
    retrieval.save_index(chunk_table(spark, sf_dir), path)
    chunks, vectors = retrieval.load_index(spark, path)
    h = retrieval.retrieve(v_queries(spark, sf_dir), chunks, vectors, k=K, top_k=K)
    return h.select("query_id", "rank", "chunk_id", "doc_id", F.round("score", 6).alias("score"))


def answer_ctes(bonus: bool = True, prior: bool = False) -> str:
    """RETRIEVE_SQL plus CTEs ending in ``ans`` (query_id, query, context, contexts, answer)."""
    full = _answer_sql(bonus, "", prior)
    return full[:full.rindex("\nSELECT qa.query_id")]


def answers_from_hits(queries: str, bonus: bool, prior: bool, tag: str = "") -> str:
    """CTEs from ``hits`` to ``ans`` (query_id, query, context, contexts, answer) of one answerer."""
    bonus_sql = ("+ CASE WHEN (lower(query) LIKE '%landfall%' OR lower(query) LIKE '%ashore%') "
                 "AND (lower(sent) LIKE '%landfall%' OR lower(sent) LIKE '%ashore%') THEN 0.5 ELSE 0.0 END"
                 if bonus else "")
    answer = "CASE WHEN length(b.sent) > 0 THEN b.sent ELSE '" + C.NO_ANSWER_TEXT + "' END"
    if prior:
        cases = " ".join(f"WHEN lower(qa.query) LIKE '%{k}%' THEN '{v}'" for k, v in C.NAIVE_PRIOR)
        answer = f"CASE {cases} ELSE {answer} END"
    return f""",
ctx{tag} AS (SELECT query_id, string_agg(text, ' ' ORDER BY rank) AS context, list(text ORDER BY rank) AS contexts
        FROM hits GROUP BY 1),
qa{tag} AS (SELECT q.query_id, q.query, coalesce(c.context, '') AS context, coalesce(c.contexts, []::VARCHAR[]) AS contexts
       FROM {queries} q LEFT JOIN ctx{tag} c ON c.query_id = q.query_id),
ex{tag} AS (SELECT query_id, query, unnest(s) AS sent, unnest(generate_series(0, len(s) - 1)) AS pos
       FROM (SELECT query_id, query, {raw_sents_sql('context')} AS s FROM qa{tag})),
sc{tag} AS (SELECT *, {overlap_sql('query', 'sent')} {bonus_sql} AS score FROM ex{tag}),
b{tag} AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rn
                     FROM sc{tag}) WHERE rn = 1),
ans{tag} AS (SELECT qa.query_id, qa.query, qa.context, qa.contexts, {answer} AS answer
        FROM qa{tag} qa LEFT JOIN b{tag} b ON b.query_id = qa.query_id)"""


def _answer_sql(bonus: bool, model: str, prior: bool) -> str:
    prompt = ("greatest(1, length(qa.query) // 4)" if prior
              else "greatest(1, length(qa.query || qa.context) // 4)")
    return RETRIEVE_SQL + answers_from_hits("v_queries", bonus, prior) + f"""
SELECT qa.query_id, '{model}' AS model, ans.answer,
       {prompt} AS prompt_tokens, greatest(1, length(ans.answer) // 4) AS completion_tokens
FROM qa JOIN ans ON ans.query_id = qa.query_id"""


@register("grounded_answer", _answer_sql(True, "mock-grounded", False))
def grounded_answer(spark, sf_dir):
    """Extractive answer from the reranked context."""
    a = retrieval.grounded_answer(v_queries(spark, sf_dir), hits_df(spark, sf_dir))
    return a.select("query_id", "model", "answer", "prompt_tokens", "completion_tokens")


@register("prior_answer", _answer_sql(False, "mock-naive", True))
def prior_answer(spark, sf_dir):
    """Prior-first answer, extractive fallback."""
    a = retrieval.prior_answer(v_queries(spark, sf_dir), hits_df(spark, sf_dir))
    return a.select("query_id", "model", "answer", "prompt_tokens", "completion_tokens")


def _templates_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in C.PROMPT_TEMPLATES.items())
    return f"tpl AS (SELECT * FROM (VALUES {rows}) t(name, body))"


@register("prompt_render", RETRIEVE_SQL + f""",
{_templates_sql()},
pctx AS (SELECT query_id, string_agg('[' || CAST(rank AS VARCHAR) || '] ' || text, chr(10) || chr(10) ORDER BY rank)
           AS context FROM hits GROUP BY 1),
qc AS (SELECT q.query_id, q.query, coalesce(c.context, '') AS context
       FROM v_queries q LEFT JOIN pctx c ON c.query_id = q.query_id)
SELECT qc.query_id, tpl.name AS template_name,
       replace(replace(tpl.body, '{{{{ query }}}}', qc.query), '{{{{ context }}}}', qc.context) AS prompt
FROM qc, tpl""")
def prompt_render(spark, sf_dir):
    """Both RAG templates rendered with each question's numbered context."""
    return retrieval.render_prompts(v_queries(spark, sf_dir), hits_df(spark, sf_dir))
