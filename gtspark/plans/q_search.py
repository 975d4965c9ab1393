"""Sentence search and question routing over the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from gtspark import config as C
from gtspark.operators import search
from gtspark.plans.q_text import CORPUS_SQL, corpus, sents_sql, tokens_sql
from gtspark.plans.registry import register
from gtspark.plans.views import table, v_queries, with_views


def _list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_SEARCH_SQL = f"""
sent AS (SELECT doc_id, CAST(unnest(generate_series(0, len(s) - 1)) AS INTEGER) AS pos, unnest(s) AS sentence
         FROM (SELECT doc_id, {sents_sql('text')} AS s FROM corpus)),
post AS (SELECT doc_id, pos, t AS token FROM (
           SELECT doc_id, pos, unnest(list_distinct({tokens_sql('sentence')})) AS t FROM sent)
         WHERE t NOT IN {_list(C.SEARCH_STOP_WORDS)}),
idf AS (SELECT token, COUNT(*) AS df, ln(((SELECT COUNT(*) FROM sent) + 1) / (COUNT(*) + 0.5)) AS idf FROM post GROUP BY 1),
qt AS (SELECT query_id, query, t AS token FROM (
         SELECT query_id, query, unnest(list_distinct({tokens_sql('query')})) AS t FROM v_queries)
       WHERE t NOT IN {_list(C.SEARCH_STOP_WORDS + C.SEARCH_GENERIC_WORDS)}),
base AS (SELECT query_id, query, doc_id, pos, SUM(idf) AS base
         FROM qt JOIN idf USING (token) JOIN post USING (token) GROUP BY ALL HAVING SUM(idf) > 0),
scored AS (SELECT query_id, doc_id, pos, sentence, round(base + CASE WHEN regexp_matches(lower(query), 'landfall|ashore')
             AND regexp_matches(lower(sentence), 'landfall|ashore') THEN 0.4 ELSE 0.0 END, 9) AS score
           FROM base JOIN sent USING (doc_id, pos))"""


@register("idf_search", with_views("", "v_docs", "v_queries").rstrip() + ",\n" + CORPUS_SQL + "," + _SEARCH_SQL + """
SELECT query_id, doc_id, pos, sentence, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, pos) AS rn FROM scored)
WHERE rn = 1""")
def idf_search(spark, sf_dir):
    """The best corpus sentence of each benchmark question."""
    r = search.idf_search(v_queries(spark, sf_dir), corpus(spark, sf_dir))
    return r.withColumn("score", F.round("score", 6))


_ASKED_SQL = """
SELECT conv_id || ':' || turn AS query_id, CASE turn % 6 WHEN 0 THEN text WHEN 1 THEN 'Hello ' || text
         WHEN 2 THEN 'hurricane ' || text WHEN 3 THEN 'storm damage ' || text WHEN 4 THEN '  '
         ELSE 'Hugo x' || conv_id || 'x' || turn || CASE WHEN conv_id % 2 = 0 THEN ' ' || text ELSE '' END END AS query
FROM conversations"""


@register("route_question", with_views(f", {CORPUS_SQL}, asked AS ({_ASKED_SQL}),".rstrip() + _SEARCH_SQL.replace("v_queries", "asked") + f""",
q AS (SELECT *, trim(query) AS t, query_id IN (SELECT query_id FROM scored) AS hit FROM asked)
SELECT query_id, CASE WHEN t = '' THEN 'none' WHEN regexp_matches(t, '{C.GREETING_RE}') THEN 'greet'
  WHEN NOT (regexp_matches(t, '{C.HURRICANE_RE}')
            OR list_has_any({tokens_sql('t')}, [{', '.join(f"'{n}'" for n in C.SEARCH_STORM_NAMES)}])) THEN 'refuse'
  WHEN regexp_matches(t, '{C.IMPACT_RE}') THEN 'external' WHEN hit THEN 'corpus' ELSE 'external' END AS route
FROM q""", "v_docs"))
def route_question(spark, sf_dir):
    """The route of every conversation turn, asked in six forms, by the hits of the sentence search."""
    c, t = table(spark, sf_dir, "conversations"), F.col("turn") % 6
    text = F.col("text")
    named = F.concat(F.lit("Hugo x"), F.col("conv_id").cast("string"), F.lit("x"), F.col("turn").cast("string"),
                     F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(" "), text)).otherwise(""))
    query = (F.when(t == 0, text).when(t == 1, F.concat(F.lit("Hello "), text)).when(t == 2, F.concat(F.lit("hurricane "), text))
             .when(t == 3, F.concat(F.lit("storm damage "), text)).when(t == 4, "  ").otherwise(named))
    q = c.select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), query.alias("query"))
    return search.route_questions(q, search.answerable(q, corpus(spark, sf_dir)))
