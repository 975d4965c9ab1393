"""Text-core queries: corpus, chunks, tokens, sentences, overlap, hashed vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from gtspark import config as C
from gtspark.functions import text as X
from gtspark.operators import medallion, retrieval
from gtspark.plans.registry import register
from gtspark.plans.views import v_docs, v_pairs, with_views

STEP = max(1, C.CHUNK_SIZE - C.CHUNK_OVERLAP)

# DuckDB spellings of the text expressions.
SENTS_SQL = ("list_filter(list_transform(regexp_extract_all({t}, '[^.!?]+[.!?]'), "
             "lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 0)")
TOKENS_SQL = "regexp_extract_all(lower({t}), '[a-z0-9]+')"


def sents_sql(t: str) -> str:
    """T3 (metrics variant) in DuckDB."""
    found = SENTS_SQL.format(t=t)
    st = f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"
    return (f"CASE WHEN len({found}) > 0 THEN {found} WHEN length({st}) > 0 THEN [{st}] "
            f"ELSE []::VARCHAR[] END")


def tokens_sql(t: str) -> str:
    return TOKENS_SQL.format(t=t)


def corpus(spark, sf_dir):
    """U1 + F4: documents and assistant turns, empty texts dropped."""
    d = v_docs(spark, sf_dir)
    return medallion.event_corpus(d, id_col="doc_id", text_col="text")


CORPUS_SQL = "corpus AS (SELECT doc_id, text FROM v_docs WHERE text IS NOT NULL AND length(text) > 0)"


def _docs_sql(body: str) -> str:
    return with_views(f", {CORPUS_SQL}\n{body}", "v_docs")


CHUNKS_SQL = f"""chunks AS (
  SELECT doc_id, doc_id || '::' || CAST(ordinal AS VARCHAR) AS chunk_id, CAST(ordinal AS INTEGER) AS ordinal,
         array_to_string(w[ordinal * {STEP} + 1 : ordinal * {STEP} + {C.CHUNK_SIZE}], ' ') AS text
  FROM (SELECT doc_id, w, unnest(generate_series(0, CAST(least(greatest(0, ceil((len(w) - {C.CHUNK_SIZE}) / {STEP})),
                                                        ceil(len(w) / {STEP}) - 1) AS BIGINT))) AS ordinal
        FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM corpus) WHERE len(w) > 0))"""


@register("corpus_union", _docs_sql("SELECT doc_id, text FROM corpus"))
def corpus_union(spark, sf_dir):
    """U1 + F4 + E21 input."""
    return corpus(spark, sf_dir)


@register("chunks", _docs_sql(f", {CHUNKS_SQL}\nSELECT * FROM chunks"))
def chunks(spark, sf_dir):
    """T4: 320-word windows with 48 words of overlap."""
    return retrieval.chunk_docs(corpus(spark, sf_dir))


@register("tokens", _docs_sql(f"""
SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct,
       md5(array_to_string(t, ' ')) AS tokens_md5,
       greatest(1, length(text) // 4) AS approx_tokens
FROM (SELECT doc_id, text, {tokens_sql('text')} AS t FROM corpus)"""))
def tokens(spark, sf_dir):
    """T1 + P13: full token sequence per document (count, distinct, digest)."""
    c = corpus(spark, sf_dir).withColumn("_t", X.tokens("text"))
    return c.select("doc_id", F.size("_t").alias("n_tokens"),
                    F.size(F.array_distinct("_t")).alias("n_distinct"),
                    F.md5(F.array_join("_t", " ")).alias("tokens_md5"),
                    X.approx_tokens("text").alias("approx_tokens"))


@register("sentences", _docs_sql(f"""
SELECT doc_id, CAST(unnest(generate_series(0, len(s) - 1)) AS INTEGER) AS pos, unnest(s) AS sentence
FROM (SELECT doc_id, {sents_sql('text')} AS s FROM corpus)"""))
def sentences(spark, sf_dir):
    """Every sentence of every document, in order."""
    return corpus(spark, sf_dir).select("doc_id", F.posexplode(X.sentences("text")).alias("pos", "sentence"))


@register("token_overlap", with_views(f"""
SELECT pair_id, CAST(n_common AS INTEGER) AS n_common,
       n_common / (len(qd) + 1e-9) AS overlap
FROM (SELECT pair_id, qd, len(list_filter(qd, lambda x: list_contains(ans_t, x))) AS n_common
      FROM (SELECT pair_id, list_distinct({tokens_sql('question')}) AS qd, {tokens_sql('answer')} AS ans_t
            FROM v_pairs))""", "v_pairs"))
def token_overlap(spark, sf_dir):
    """T2 + U3: question/answer token overlap for each conversation pair."""
    p = v_pairs(spark, sf_dir).select("pair_id", X.tokens("question").alias("q"), X.tokens("answer").alias("a"))
    return p.select("pair_id", F.size(F.array_intersect(F.array_distinct("q"), "a")).alias("n_common"),
                    X.overlap("q", "a").alias("overlap"))


HASHED_SQL = """{name}_grams AS (
  SELECT id, unnest(t || list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || '_' || t[i + 1])) AS g
  FROM (SELECT {id} AS id, {tok} AS t FROM {src})),
{name}_counts AS (
  SELECT id, CAST(CAST(('0x' || right(md5(g), 2)) AS INTEGER) % 256 AS INTEGER) AS bucket, COUNT(*) AS c
  FROM {name}_grams GROUP BY 1, 2),
{name} AS (SELECT id, bucket, c / sqrt(SUM(c * c) OVER (PARTITION BY id)) AS w FROM {name}_counts)"""


def hashed_sql(name: str, src: str, id_expr: str, text_expr: str) -> str:
    return HASHED_SQL.format(name=name, src=src, id=id_expr, tok=tokens_sql(text_expr))


@register("hashed_vectors", _docs_sql(", " + hashed_sql("vecs", "corpus", "doc_id", "text")
                                      + "\nSELECT id, bucket, w FROM vecs"))
def hashed_vectors(spark, sf_dir):
    """T5: hashed uni+bigram vectors (dim 256) of every corpus document."""
    return retrieval.embed(corpus(spark, sf_dir), "doc_id", "text", C.EMBEDDING_DIM)
