"""Parameter sweeps, with the configuration as rows.

A cell is one setting of chunk size, overlap, rerank strategy, prompt template
and top k.  All cells run in one plan: every document is cut once for each
different chunking, all chunks are embedded and indexed together under their
chunking, every question is searched once per chunking, and cells that share a
chunking share its hits.  Answers, metrics and summaries carry the cell's label
as their run id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gtspark import config as C
from gtspark.functions import text as X
from gtspark.operators import evaluate, retrieval
from gtspark.session import materialise

STRATEGIES = ("none", "lexical")
PART_CHARS = 32_000_000      # of texts, most that a partition gets where they are dealt out
MOST_CELLS = 1000            # a sweep's cells are configuration: they are written into the plan


@dataclass(frozen=True)
class Cell:
    label: str
    chunk_size: int = C.CHUNK_SIZE
    overlap: int = C.CHUNK_OVERLAP
    strategy: str = "lexical"
    template: str = "rag_v1"
    top_k: int = C.TOP_K

    @property
    def chunking(self) -> str:
        return f"{self.chunk_size}/{self.overlap}"


def grid(param: str, values, base: Cell = Cell("base")) -> list[Cell]:
    """A one-dimensional sweep: the base cell with ``param`` set to each value, labelled 'param=value'."""
    return [replace(base, **{param: v}, label=f"{param}={v}") for v in values]


def checked(cells: list[Cell], templates: dict) -> list[Cell]:
    if not cells or len(cells) > MOST_CELLS or len({c.label for c in cells}) < len(cells):
        raise ValueError(f"between 1 and {MOST_CELLS} cells with labels of their own are needed")
    for c in cells:
        if c.strategy not in STRATEGIES or c.template not in templates or c.chunk_size < 1 or c.top_k < 1:
            raise ValueError(f"cell {c.label!r}: strategy in {STRATEGIES}, template in {sorted(templates)}, sizes above 0")
    return cells


def cell_rows(spark: SparkSession, cells: list[Cell], templates: dict | None = None) -> DataFrame:
    """The cells as a table."""
    templates = templates or C.PROMPT_TEMPLATES
    return spark.createDataFrame(
        [(c.label, c.chunking, c.strategy, c.template, templates[c.template], c.top_k) for c in checked(cells, templates)],
        "cell string, chunking string, strategy string, template string, body string, top_k int")


def chunk_cells(docs: DataFrame, cells: list[Cell], keep: tuple = ()) -> DataFrame:
    """(chunking, doc_id, chunk_id, ordinal, text) of every different chunking; chunk ids start with it."""
    ways = sorted({(c.chunking, c.chunk_size, c.overlap) for c in cells})
    way = F.array(*[F.struct(F.lit(n).alias("chunking"), F.lit(s).alias("size"), F.lit(o).alias("overlap")) for n, s, o in ways])
    words = docs.select("doc_id", *keep, F.explode(F.array(X.words("text"))).alias("_words"))      # once for all chunkings
    each = words.select("*", F.explode(way).alias("w")).select("doc_id", *keep, "_words", "w.*")
    chunks = retrieval.chunk_docs(each, F.col("size"), F.col("overlap"), keep=("chunking", *keep), words_col="_words")
    return chunks.withColumn("chunk_id", F.concat_ws("|", "chunking", "chunk_id"))


def spread(docs: DataFrame) -> DataFrame:
    """The documents as they are read or, where one task would read much more than its share (a file in one piece), dealt out."""
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    most, total = (docs.groupBy(F.spark_partition_id().alias("_p")).agg(F.sum(F.length("text")).alias("_n"))
                   .agg(F.max("_n"), F.sum("_n")).first())
    if tasks * (most or 0) <= 2 * (total or 0):
        return docs
    return docs.repartition(max(2 * tasks, math.ceil(total / PART_CHARS)), "doc_id", "text")


def hit_chunks(docs: DataFrame, cells: list[Cell], hits: DataFrame) -> DataFrame:
    """The chunks that ``hits`` (item_id, grp) names, cut again from their documents: no other text is kept or moved."""
    doc = F.regexp_replace(F.expr("substring(item_id, length(grp) + 2)"), r"::[0-9]+\z", "")
    wanted = (hits.select("item_id", F.when(F.col("item_id") != F.col("grp"), doc).alias("_doc"))     # no document id: the chunking alone
              .groupBy("_doc").agg(F.collect_set("item_id").alias("_ids")))
    own = docs.join(wanted, F.col("doc_id").cast("string").eqNullSafe(F.col("_doc"))).drop("_doc")
    return chunk_cells(own, cells, keep=("_ids",)).filter(F.array_contains("_ids", F.col("chunk_id"))).drop("_ids")


def cell_hits(queries: DataFrame, docs: DataFrame, cells: list[Cell], dim: int = C.EMBEDDING_DIM) -> DataFrame:
    """(cell, query_id, rank, chunk_id, doc_id, text, score): T9 for every cell.

    All chunkings together are several times the corpus, so their texts are
    never stored or dealt out: they are counted as they are cut, and the texts
    of the hits are cut a second time.
    """
    table = cell_rows(docs.sparkSession, cells)
    most = max(c.top_k for c in cells)
    grouped = chunk_cells(spread(docs), cells).withColumnRenamed("chunking", "grp")
    hits = retrieval.topk_counted(retrieval.embed_packed(queries, "query_id", "query", dim, bits=True),
                                  retrieval.embed_packed(grouped, "chunk_id", "text", dim, keep=("grp",), bits=True), most, dim)
    hits = materialise(hits, "hits")                                   # at most k rows a query and chunking
    found = (hits.select("query_id", F.col("item_id").alias("chunk_id"), "score", "rank")
             .join(hit_chunks(docs, cells, hits).select("chunk_id", "chunking", "doc_id", "text"), "chunk_id")
             .join(queries.select("query_id", "query"), "query_id")
             .join(table.select("cell", "chunking", "strategy", "top_k"), "chunking")
             .filter(F.col("rank") <= F.col("top_k")))
    blend = F.round(0.5 * F.col("score") + 0.5 * X.overlap(X.tokens("query"), X.tokens("text")), retrieval.RANK_DIGITS)
    lexical = F.col("strategy") == "lexical"
    w = Window.partitionBy("cell", "query_id").orderBy(F.col("score").desc(), F.col("rank"))
    found = found.withColumn("score", F.when(lexical, blend).otherwise(F.col("score")))
    found = found.withColumn("rank", F.when(lexical, F.row_number().over(w)).otherwise(F.col("rank")).cast("int"))
    return materialise(found.select("cell", "query_id", "rank", "chunk_id", "doc_id", "text", "score"), "cell_hits")


def run_cells(queries: DataFrame, docs: DataFrame, cells: list[Cell], model: str = "mock-grounded",
              dim: int = C.EMBEDDING_DIM) -> tuple[DataFrame, DataFrame]:
    """(evaluation rows with the cell as run id, prompts (cell, query_id, template, prompt)).

    ``queries`` has query_id and query; every cell answers every question.
    """
    hits = cell_hits(queries, docs, cells, dim)
    table = cell_rows(docs.sparkSession, cells)
    labels = F.array(*[F.lit(c.label) for c in cells])
    key = F.concat_ws("|", "cell", "query_id")
    asked = queries.select("query_id", "query", F.explode(labels).alias("cell")).withColumn("_key", key)
    keyed = hits.withColumn("_key", key).drop("query_id").withColumnRenamed("_key", "query_id")
    answer = {"mock-grounded": retrieval.grounded_answer, "mock-naive": retrieval.prior_answer}[model]
    got = answer(asked.select(F.col("_key").alias("query_id"), "query"), keyed).withColumnRenamed("query_id", "_key")
    got = got.drop("query").join(asked, "_key")
    rows = materialise(got.select(F.col("cell").alias("run_id"), F.col("query_id").alias("question_id"),
                                  F.lit(None).cast("string").alias("storm_id"), F.col("query").alias("question"), "model",
                                  "answer", "prompt_tokens", "completion_tokens", "contexts"), "generations")
    shown = rows.select(F.col("run_id").alias("cell"), F.col("question_id").alias("query_id"), F.col("question").alias("query"),
                        X.numbered_context("contexts").alias("context")).join(table, "cell")
    prompt = F.replace(F.replace(F.col("body"), F.lit("{{ query }}"), F.col("query")), F.lit("{{ context }}"), F.col("context"))
    return evaluate.evaluation_rows(rows, dim=dim), shown.select("cell", "query_id", "template", prompt.alias("prompt"))
