"""Sentence search by inverse document frequency and question routing.

A15 T13 T14.  Sentences and questions meet only through shared tokens.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from gtspark import config as C
from gtspark.functions import text as X
from gtspark.session import materialise

QUESTION_ROWS = 4096      # questions in a block
SENTENCE_ROWS = 100_000   # sentences in a block
TILE_CELLS = 2_000_000    # pairs of question and sentence scored at a time


def _tokens(c):
    return F.filter(F.array_distinct(X.tokens(c)), lambda t: ~t.isin(*C.SEARCH_STOP_WORDS))


def sentence_table(docs: DataFrame) -> DataFrame:
    """doc_id, pos, sentence, toks: the non-blank sentences of each document, in order."""
    s = docs.select("doc_id", F.posexplode(X.sentences("text")).alias("pos", "sentence"))
    return s.withColumn("toks", _tokens("sentence"))


def sentence_idf(sentences: DataFrame) -> DataFrame:
    """(token, df, idf) with idf = ln((N + 1) / (df + 0.5)) over N sentences."""
    n = sentences.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    df = (sentences.select(F.explode("toks").alias("token")).groupBy("token")
          .agg(F.count(F.lit(1)).alias("df")))
    return df.crossJoin(F.broadcast(n)).select(                       # one row
        "token", "df", F.log((F.col("n") + 1) / (F.col("df") + 0.5)).alias("idf"))


def _landfall(c):
    return F.lower(c).rlike("landfall|ashore")


def idf_search(queries: DataFrame, docs: DataFrame, digits: int = 9) -> DataFrame:
    """The best sentence per question: sum of idf over shared specific tokens (> 0), plus the landfall bonus.

    Tokens of a question that no sentence holds add nothing.  Scores are
    compared after rounding to ``digits``; ties go to the first sentence by
    (doc_id, pos).
    """
    s = materialise(sentence_table(docs), "sentences")
    idf = materialise(sentence_idf(s), "idf")
    q = (queries.select("query_id", "query", F.explode(F.filter(
        _tokens("query"), lambda t: ~t.isin(*C.SEARCH_GENERIC_WORDS))).alias("token")).join(idf, "token")
         .groupBy("query_id", "query").agg(F.collect_list("token").alias("toks"), F.collect_list("idf").alias("idf"))
         .select("query_id", _landfall(F.col("query")).alias("lf"), "toks", "idf"))
    q = materialise(q, "asked")
    best = _best_of_blocks(q, s, digits)
    pick = best.groupBy("query_id").agg(F.min_by(
        F.struct("doc_id", "pos", "lf", "score"), F.struct(-F.col("score"), "doc_id", "pos")).alias("b"))
    pick = pick.select("query_id", "b.*")
    found = (s.select("doc_id", "pos", "sentence", _landfall(F.col("sentence")).alias("lf"))
             .join(pick, ["doc_id", "pos", "lf"]))
    return (found.groupBy("query_id").agg(F.first(F.struct("doc_id", "pos", "sentence", "score")).alias("b"))
            .select("query_id", "b.doc_id", "b.pos", "b.sentence", "b.score"))


def _best_of_blocks(q: DataFrame, s: DataFrame, digits: int) -> DataFrame:
    """The best sentence of each question in each block of sentences: (query_id, doc_id, pos, lf, score).

    Every block of questions meets every block of sentences in a task of its
    own, so matches are counted there and only one a question leaves it.
    Rows of one (doc_id, pos) fall into one block and add up.
    """
    n_q = max(1, math.ceil(q.count() / QUESTION_ROWS))
    n_s = max(1, math.ceil(s.count() / SENTENCE_ROWS))

    def upto(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    kind = s.schema["doc_id"].dataType
    nothing = {"doc_id": F.lit(None).cast(kind), "pos": F.lit(None).cast("int"), "query_id": F.lit(None).cast(q.schema["query_id"].dataType),
               "idf": F.lit(None).cast("array<double>")}
    q_side = q.select(F.lit(0).alias("_kind"), "query_id", "lf", F.array_join("toks", " ").alias("toks"), "idf",
                      nothing["doc_id"].alias("doc_id"), nothing["pos"].alias("pos"),
                      F.pmod(F.xxhash64("query_id"), F.lit(n_q)).alias("_qb"), upto(n_s).alias("_sb"))
    s_side = s.filter(F.col("doc_id").isNotNull() & (F.size("toks") > 0)).select(
        F.lit(1).alias("_kind"), nothing["query_id"].alias("query_id"), _landfall(F.col("sentence")).alias("lf"),
        F.array_join("toks", " ").alias("toks"), nothing["idf"].alias("idf"), "doc_id", "pos",
        upto(n_q).alias("_qb"), F.pmod(F.xxhash64("doc_id", "pos"), F.lit(n_s)).alias("_sb"))
    out = StructType([StructField("query_id", q.schema["query_id"].dataType), StructField("doc_id", kind),
                      StructField("pos", IntegerType()), StructField("lf", BooleanType()), StructField("score", DoubleType())])

    def score(pdf):
        asked, held = pdf[pdf["_kind"] == 0], pdf[pdf["_kind"] == 1].sort_values(["doc_id", "pos"], kind="stable")
        rows = []
        if len(asked) and len(held):
            rows = _best_sentences(asked, held, digits)
        return pd.DataFrame(rows, columns=out.names)

    return q_side.unionByName(s_side).groupBy("_qb", "_sb").applyInPandas(score, out)


def _best_sentences(asked: pd.DataFrame, held: pd.DataFrame, digits: int) -> list:
    """Best (query_id, doc_id, pos, lf, score) of each question over the sentences, sorted by (doc_id, pos).

    Sums of shared tokens' idf are counted for at most ``TILE_CELLS`` pairs of
    question and sentence at a time.
    """
    col, at, who, idf = {}, [], [], []
    for i, (toks, w) in enumerate(zip(asked["toks"], asked["idf"])):
        for t, v in zip(toks.split(" "), w):
            at.append(col.setdefault(t, len(col)))
            who.append(i)
            idf.append(v)
    at, who, idf = np.array(at, dtype=np.int64), np.array(who, dtype=np.int64), np.array(idf)
    order = np.argsort(at, kind="stable")
    who, idf = who[order], idf[order]
    start = np.searchsorted(at[order], np.arange(len(col) + 1))

    doc, pos = held["doc_id"].to_numpy(), held["pos"].to_numpy()
    new = np.ones(len(held), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])
    place = np.cumsum(new) - 1                                    # rows of one (doc_id, pos) share a place
    head = np.flatnonzero(new)
    n, m = len(asked), len(head)
    s_lf = np.zeros((2, m), dtype=bool)                           # whether a place has a row without and with a landfall word
    lf = held["lf"].to_numpy().astype(bool)
    s_lf[0][place[~lf]] = True
    s_lf[1][place[lf]] = True
    q_lf = asked["lf"].fillna(False).to_numpy().astype(bool)
    seen = [(p, c) for p, toks in zip(place, held["toks"]) for c in map(col.get, toks.split(" ")) if c is not None]
    if not seen:
        return []
    p_of, c_of = (np.array(x, dtype=np.int64) for x in zip(*seen))
    top, best = np.full(n, -np.inf), np.zeros(n, dtype=np.int64)
    step = max(1, TILE_CELLS // n)
    for lo in range(0, m, step):
        a, b = np.searchsorted(p_of, (lo, lo + step))
        width = min(step, m - lo)
        base = np.zeros(n * width)
        c, p = c_of[a:b], p_of[a:b] - lo
        ends = np.cumsum(start[c + 1] - start[c])
        cuts = [0, *np.searchsorted(ends, np.arange(TILE_CELLS, ends[-1] if len(ends) else 0, TILE_CELLS)), len(c)]
        for x, y in zip(cuts, cuts[1:]):                          # a bounded number of shared tokens at a time
            reps = start[c[x:y] + 1] - start[c[x:y]]
            into = np.arange(reps.sum()) + np.repeat(start[c[x:y]] - (np.cumsum(reps) - reps), reps)
            base += np.bincount(who[into] * width + np.repeat(p[x:y], reps), weights=idf[into], minlength=n * width)
        base = base.reshape(n, width)
        bonus = 0.4 * (q_lf[:, None] & s_lf[1][None, lo:lo + width])
        sims = np.where(base > 0, np.round(base + bonus, digits), -np.inf)
        i = sims.argmax(axis=1)
        v = sims[np.arange(n), i]
        better = v > top
        top[better], best[better] = v[better], i[better] + lo
    got = np.flatnonzero(top > -np.inf)
    ids = asked["query_id"].to_numpy()
    # a question without landfall words takes either row of a place, one with them the row that earns the bonus
    flag = np.where(q_lf, s_lf[1][best], ~s_lf[0][best])
    return [(ids[i], doc[head[best[i]]], int(pos[head[best[i]]]), bool(flag[i]), float(top[i])) for i in got]


def answerable(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """The query_ids that ``idf_search`` finds a sentence for.

    An idf is always above 0, so one shared specific token is enough: questions
    meet the corpus' distinct tokens, not its sentences.
    """
    held = docs.select(F.explode(F.array_distinct(X.tokens("text"))).alias("token")).distinct()
    asked = queries.select("query_id", F.explode(F.filter(
        _tokens("query"), lambda t: ~t.isin(*C.SEARCH_GENERIC_WORDS))).alias("token"))
    return asked.join(held, "token", "leftsemi").select("query_id").distinct()


def route_questions(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """None, greet, refuse, external or corpus per question; ``hits`` has the query_ids the corpus can answer."""
    q = X.strip(F.coalesce(F.col("query"), F.lit("")))
    named = F.arrays_overlap(X.tokens(q), F.array(*[F.lit(n) for n in C.SEARCH_STORM_NAMES]))
    found = hits.select("query_id", F.lit(True).alias("_hit")).distinct()
    route = (F.when(F.length(q) == 0, "none").when(q.rlike(C.GREETING_RE), "greet")
             .when(~(q.rlike(C.HURRICANE_RE) | named), "refuse").when(q.rlike(C.IMPACT_RE), "external")
             .when(F.col("_hit"), "corpus").otherwise("external"))
    return queries.join(found, "query_id", "left").select("query_id", route.alias("route"))
