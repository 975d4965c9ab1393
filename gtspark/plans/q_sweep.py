"""Parameter sweep over the benchmark questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gtspark import config as C
from gtspark.operators import marts
from gtspark.operators import sweep as S
from gtspark.plans.q_evaluate import _CLAIMS_SQL, _REL_SQL
from gtspark.plans.q_retrieval import answers_from_hits, overlap_sql
from gtspark.plans.q_text import CORPUS_SQL, corpus, hashed_sql
from gtspark.plans.registry import register
from gtspark.plans.views import v_queries, with_views

CELLS = [*S.grid("chunk_size", (160, 320)), S.Cell("strategy=none", strategy="none", template="rag_v2"),
         S.Cell("overlap=96,top_k=2", overlap=96, top_k=2)]


def _chunks(name: str, size: int, overlap: int) -> str:
    step = max(1, size - overlap)
    return f"""
  SELECT '{name}' AS chunking, doc_id, '{name}|' || doc_id || '::' || ordinal AS chunk_id,
         array_to_string(w[ordinal * {step} + 1 : ordinal * {step} + {size}], ' ') AS text
  FROM (SELECT doc_id, w, unnest(generate_series(0, CAST(least(greatest(0, ceil((len(w) - {size}) / {step})),
                                                        ceil(len(w) / {step}) - 1) AS BIGINT))) AS ordinal
        FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM corpus) WHERE len(w) > 0)"""


def _sweep_sql() -> str:
    ways = sorted({(c.chunking, c.chunk_size, c.overlap) for c in CELLS})
    cells = ", ".join(f"('{c.label}', '{c.chunking}', '{c.strategy}', '{c.template}', {c.top_k})" for c in CELLS)
    bodies = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in C.PROMPT_TEMPLATES.items())
    return with_views(f""", {CORPUS_SQL},
cells AS (SELECT * FROM (VALUES {cells}) t(cell, chunking, strategy, template, top_k)),
tpl AS (SELECT * FROM (VALUES {bodies}) t(name, body)),
chunks AS MATERIALIZED ({' UNION ALL '.join(_chunks(*w) for w in ways)}),
{hashed_sql('qvec', 'v_queries', 'query_id', 'query')},
{hashed_sql('cvec', 'chunks', 'chunk_id', 'text')},
dots AS (SELECT q.id AS query_id, c.id AS chunk_id, SUM(q.w * c.w) AS dot
         FROM qvec q JOIN cvec c ON c.bucket = q.bucket GROUP BY 1, 2),
scored AS (SELECT q.query_id, c.chunking, c.chunk_id, round(coalesce(d.dot, 0.0) / (1 + 1e-9), 9) AS score
           FROM v_queries q CROSS JOIN chunks c LEFT JOIN dots d ON d.query_id = q.query_id AND d.chunk_id = c.chunk_id),
top AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id, chunking ORDER BY score DESC, chunk_id) AS rank0 FROM scored
        QUALIFY rank0 <= {max(c.top_k for c in CELLS)}),
rr AS (SELECT cells.cell, t.query_id, c.text, t.rank0,
              CASE WHEN strategy = 'none' THEN t.score
                   ELSE round(0.5 * t.score + 0.5 * {overlap_sql('q.query', 'c.text')}, 9) END AS score, strategy
       FROM top t JOIN cells ON cells.chunking = t.chunking AND t.rank0 <= cells.top_k
       JOIN chunks c ON c.chunk_id = t.chunk_id JOIN v_queries q ON q.query_id = t.query_id),
hits AS (SELECT cell || '|' || query_id AS query_id, text,
                CASE WHEN strategy = 'none' THEN rank0
                     ELSE ROW_NUMBER() OVER (PARTITION BY cell, query_id ORDER BY score DESC, rank0) END AS rank FROM rr),
asked AS (SELECT cell || '|' || query_id AS query_id, query, cell, template FROM v_queries, cells)"""
                      + answers_from_hits("asked", True, False) + _CLAIMS_SQL + _REL_SQL + """,
numbered AS (SELECT query_id, string_agg('[' || rank || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY 1),
each AS (SELECT asked.cell, coalesce(g.groundedness, 0.0) AS groundedness, coalesce(d.d, 0.0) / (1 + 1e-9) AS answer_relevance,
                length(replace(replace(tpl.body, '{{ query }}', asked.query), '{{ context }}', coalesce(n.context, ''))) AS chars
         FROM asked JOIN tpl ON tpl.name = asked.template LEFT JOIN g ON g.aid = asked.query_id
         LEFT JOIN adot d ON d.aid = asked.query_id LEFT JOIN numbered n ON n.query_id = asked.query_id)
SELECT cell AS run_id, round(avg(groundedness), 6) AS groundedness, round(avg(answer_relevance), 6) AS answer_relevance,
       round(avg(groundedness), 6) AS reward, NULL::DOUBLE AS latency_ms, sum(chars)::BIGINT AS prompt_chars
FROM each GROUP BY 1""", "v_docs", "v_queries")


@register("param_sweep", _sweep_sql())
def param_sweep(spark, sf_dir):
    """Four cells of chunk size, overlap, strategy and template; two share a chunking."""
    rows, prompts = S.run_cells(v_queries(spark, sf_dir), corpus(spark, sf_dir), CELLS)
    s = marts.sweep_summary(rows)
    size = prompts.groupBy(F.col("cell").alias("run_id")).agg(F.sum(F.length("prompt")).cast("long").alias("prompt_chars"))
    means = ("groundedness", "answer_relevance", "reward", "latency_ms")
    return s.join(size, "run_id").select("run_id", *[F.round(c, 6).alias(c) for c in means], "prompt_chars")
