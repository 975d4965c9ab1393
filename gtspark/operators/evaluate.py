"""Answer evaluation: support, groundedness, faithfulness, relevance, truth check.

E1-E12 E20 J3 J8 P14 P15.  Input answers are rows
``(aid, query, answer, contexts array<string>)``.  Every text (claim,
context sentence, query, answer, context) is embedded once; similarities are
sparse dot products joined on (aid, bucket), so a claim only meets the
sentences of its own answer's contexts (k contexts: a bounded group).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gtspark import config as C
from gtspark.functions import text as X
from gtspark.functions.scalar import claimed_category, reward
from gtspark.operators.retrieval import embed
from gtspark.session import shuffled

_EPS = 1.0 + 1e-9


def _sid(*parts):
    out = []
    for p in parts:
        out += [F.lit("|"), F.col(p).cast("string")] if out else [F.col(p).cast("string")]
    return F.concat(*out)


def claim_support(answers: DataFrame, dim: int = C.EMBEDDING_DIM) -> DataFrame:
    """E1 + J8: (aid, cpos, claim, support) = best cosine of each answer sentence
    over all sentences of the answer's contexts; none -> 0."""
    claims = answers.select("aid", F.posexplode(X.sentences("answer")).alias("cpos", "claim"))
    ctx = (answers.select("aid", F.posexplode("contexts").alias("ci", "ctext"))
           .select("aid", "ci", F.posexplode(X.sentences("ctext")).alias("spos", "sent")))
    cv = embed(claims.withColumn("_id", _sid("aid", "cpos")), "_id", "claim", dim, keep=("aid", "cpos"))
    sv = embed(ctx.withColumn("_id", _sid("aid", "ci", "spos")), "_id", "sent", dim, keep=("aid",))
    dots = (cv.select("aid", "cpos", "bucket", F.col("w").alias("wa"))
            .join(shuffled(sv.select("aid", F.col("id").alias("sid"), "bucket", F.col("w").alias("wb"))),
                  ["aid", "bucket"])
            .groupBy("aid", "cpos", "sid").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
            .groupBy("aid", "cpos").agg(F.max("dot").alias("best")))
    return (claims.join(shuffled(dots), ["aid", "cpos"], "left")
            .select("aid", "cpos", "claim",
                    (F.greatest(F.coalesce("best", F.lit(0.0)), F.lit(0.0)) / F.lit(_EPS)).alias("support")))


def grounding(answers: DataFrame, threshold: float = C.SUPPORT_THRESHOLD,
              dim: int = C.EMBEDDING_DIM) -> DataFrame:
    """E2 + E3 (+E6 heuristic judge = E2): per answer, share of claims with
    support >= threshold and the weakest claim's support; no claims -> 0."""
    s = claim_support(answers, dim)
    g = s.groupBy("aid").agg(
        F.avg(F.when(F.col("support") >= threshold, 1.0).otherwise(0.0)).alias("groundedness"),
        F.min("support").alias("faithfulness"))
    return (answers.select("aid").join(shuffled(g), "aid", "left")
            .select("aid", F.coalesce("groundedness", F.lit(0.0)).alias("groundedness"),
                    F.coalesce("faithfulness", F.lit(0.0)).alias("faithfulness"),
                    F.coalesce("groundedness", F.lit(0.0)).alias("judge_score")))


def verdict_score(verdict) -> Column:
    """1 if the judge's JSON says grounded, 0 if not, NULL where it is no JSON object.

    As in any JSON reader's truth test, false, null, 0, "" and an empty list or
    object are no; a missing key is no as well.
    """
    v = F.trim(F.col(verdict) if isinstance(verdict, str) else verdict)
    parsed = F.from_json(v, "grounded string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    no = F.coalesce(parsed["grounded"], F.lit("")).isin("", "false", "0", "0.0", "null", "[]", "{}")
    readable = v.startswith("{") & parsed["_bad"].isNull()
    return F.when(readable, F.when(no, 0.0).otherwise(1.0))


def judged(grounding_rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """judge_score from the supplied (aid, verdict) rows, else the heuristic one.

    Several readable verdicts of one answer are averaged; unreadable ones are
    as if they had not come.
    """
    own = (verdicts.select("aid", verdict_score("verdict").alias("_v")).groupBy("aid").agg(F.avg("_v").alias("_v")))
    return (grounding_rows.join(own, "aid", "left")
            .withColumn("judge_score", F.coalesce("_v", "judge_score")).drop("_v"))


def judge_prompts(answers: DataFrame, template: str = C.JUDGE_TEMPLATE) -> DataFrame:
    """(aid, prompt) that asks a judge about every answer; contexts stand a blank line apart."""
    context = F.array_join(F.coalesce("contexts", F.array()), "\n\n")
    prompt = F.lit(template)
    for name, value in (("answer", F.coalesce("answer", F.lit(""))), ("context", context)):
        prompt = F.replace(prompt, F.lit("{{ " + name + " }}"), value)
    return answers.select("aid", prompt.alias("prompt"))


def evaluate_given(answers: DataFrame, threshold: float = C.SUPPORT_THRESHOLD, dim: int = C.EMBEDDING_DIM) -> DataFrame:
    """Metrics of given answers, a batch of (aid, question, answer, contexts, expected category or NULL).

    Null contexts are none, a null answer is empty; ``hallucinated`` is NULL
    where no category is expected or claimed.
    """
    a = answers.select("aid", F.coalesce("question", F.lit("")).alias("query"), F.coalesce("answer", F.lit("")).alias("answer"),
                       F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"), "expected")
    flag = a.select("aid", (claimed_category(F.col("answer")) != F.col("expected")).alias("hallucinated"))
    text = a.drop("expected")
    return (grounding(text, threshold, dim).drop("judge_score")
            .join(shuffled(relevance(text, dim).select("aid", "answer_relevance")), "aid").join(shuffled(flag), "aid"))


def relevance(answers: DataFrame, dim: int = C.EMBEDDING_DIM) -> DataFrame:
    """E4 + E5: mean cosine(query, context) (none -> 0) and cosine(query, answer)."""
    qv = embed(answers.withColumn("_id", _sid("aid")), "_id", "query", dim, keep=("aid",))
    av = embed(answers.withColumn("_id", _sid("aid")), "_id", "answer", dim, keep=("aid",))
    ctx = answers.select("aid", F.posexplode("contexts").alias("ci", "ctext"))
    cv = embed(ctx.withColumn("_id", _sid("aid", "ci")), "_id", "ctext", dim, keep=("aid", "ci"))
    q = qv.select("aid", "bucket", F.col("w").alias("wq"))
    ans_dot = (q.join(shuffled(av.select("aid", "bucket", F.col("w").alias("wa"))), ["aid", "bucket"])
               .groupBy("aid").agg(F.sum(F.col("wq") * F.col("wa")).alias("_ad")))
    ctx_dot = (q.join(shuffled(cv.select("aid", "ci", "bucket", F.col("w").alias("wc"))), ["aid", "bucket"])
               .groupBy("aid").agg(F.sum(F.col("wq") * F.col("wc")).alias("_cd")))
    n = F.size("contexts")
    return (answers.select("aid", "contexts").join(shuffled(ans_dot), "aid", "left").join(shuffled(ctx_dot), "aid", "left")
            .select("aid",
                    F.when(n > 0, F.coalesce("_cd", F.lit(0.0)) / F.lit(_EPS) / n)
                     .otherwise(F.lit(0.0)).alias("context_relevance"),
                    (F.coalesce("_ad", F.lit(0.0)) / F.lit(_EPS)).alias("answer_relevance")))


def truth_check(answers: DataFrame, truth: DataFrame, field: str = "landfall_category") -> DataFrame:
    """E7 E8 E9 + J3: claimed category vs the truth table.

    ``answers`` needs (storm_id nullable, answer).  Adds expected, found,
    checkable, contradicted and the three-valued ``hallucinated``.  The truth
    side is one row per storm, joined on the nullable key (no storm -> no
    check).
    """
    t = truth.select(F.col("storm_id").alias("_tsid"), F.col(field).alias("expected"))
    j = answers.join(t, answers.storm_id == t._tsid, "left").drop("_tsid")
    found = claimed_category(F.col("answer"))
    expected = F.when(F.col("storm_id").isNotNull(), F.col("expected"))
    return (j.withColumn("expected", expected)
            .withColumn("found", F.when(F.col("expected").isNotNull(), found))
            .withColumn("checkable", F.col("expected").isNotNull())
            .withColumn("contradicted", F.coalesce(F.col("found") != F.col("expected"), F.lit(False)))
            .withColumn("hallucinated", F.col("found") != F.col("expected")))


def cost_usd(model_col, prompt_tokens, completion_tokens, pricing=C.PRICING):
    """Price per 1K tokens by model (unknown -> 0), rounded to 6."""
    m = F.col(model_col) if isinstance(model_col, str) else model_col
    p = F.create_map(*[x for k, (a, _) in pricing.items() for x in (F.lit(k), F.lit(float(a)))])
    c = F.create_map(*[x for k, (_, b) in pricing.items() for x in (F.lit(k), F.lit(float(b)))])
    pp = F.coalesce(F.try_element_at(p, m), F.lit(0.0))
    cc = F.coalesce(F.try_element_at(c, m), F.lit(0.0))
    return F.round(F.col(prompt_tokens) / 1000.0 * pp + F.col(completion_tokens) / 1000.0 * cc, 6)


def evaluation_rows(generations: DataFrame, truth: DataFrame | None = None,
                    run_id=None, run_ts=None, threshold: float = C.SUPPORT_THRESHOLD,
                    dim: int = C.EMBEDDING_DIM, verdicts: DataFrame | None = None) -> DataFrame:
    """E10 + E11: generations -> the 18-column ``evaluations`` rows.

    ``generations`` has (question_id, storm_id, question, model, answer,
    prompt_tokens, completion_tokens, contexts[, latency_ms, run_id]);
    several models or runs are simply more rows -- one plan for all of them.
    ``verdicts`` (aid, verdict) are a judge's own words (E6).
    """
    key = [c for c in ("run_id", "model", "question_id") if c in generations.columns]
    g = generations.withColumn("aid", F.concat_ws("|", *key))
    a = g.select("aid", F.col("question").alias("query"), "answer", "contexts")
    gr = grounding(a, threshold, dim)
    if verdicts is not None:
        gr = judged(gr, verdicts)
    rel = relevance(a, dim)
    out = g.join(shuffled(gr), "aid").join(shuffled(rel), "aid")
    if truth is not None:
        out = truth_check(out, truth).drop("expected", "found", "checkable", "contradicted")
    else:
        out = out.withColumn("hallucinated", F.lit(None).cast("boolean"))
    lat = F.col("latency_ms") if "latency_ms" in g.columns else F.lit(None).cast("double")
    own_run = F.col("run_id") if "run_id" in key else F.concat_ws("-", F.lit("run"), F.col("model"))
    return out.select(
        (F.lit(run_id) if run_id is not None else own_run).alias("run_id"),
        (F.lit(run_ts) if run_ts is not None else F.lit(None)).cast("timestamp").alias("run_ts"),
        "model", "question_id", "storm_id", "question", "answer",
        "groundedness", "faithfulness", "context_relevance", "answer_relevance", "judge_score",
        "hallucinated", lat.alias("latency_ms"),
        cost_usd("model", "prompt_tokens", "completion_tokens").alias("cost_usd"),
        "prompt_tokens", "completion_tokens",
        reward(F.col("groundedness"), F.col("hallucinated")).alias("reward"))
