"""Paired A/B test, preference pairs, best-of-N.

E13-E17 J5 U2 W6.  Per-question work is partial-aggregated (max_by/min_by);
the bootstrap draws are generated from a range and resolved by an
equi-join on the drawn index, so no group is ever collected.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gtspark import config as C
from gtspark.operators.marts import global_row_number, range_prefix


def latest_scores(evals: DataFrame, model: str, metric: str,
                  order_cols=("run_ts", "run_id", "event_id")) -> DataFrame:
    """H8: one score per question for a model -- the latest row wins."""
    cols = [c for c in order_cols if c in evals.columns]
    return (evals.filter(F.col("model") == model).groupBy("question_id")
            .agg(F.max_by(F.col(metric), F.struct(*cols)).alias("score")))


def paired_diffs(evals: DataFrame, metric: str, model_a: str, model_b: str) -> DataFrame:
    """J5 + U2: questions both models answered, numbered 0..n-1 in key order."""
    a = latest_scores(evals, model_a, metric).withColumnRenamed("score", "a")
    b = latest_scores(evals, model_b, metric).withColumnRenamed("score", "b")
    j = a.join(b, "question_id").withColumn("d", F.col("b") - F.col("a"))
    return global_row_number(j, ["question_id"], "seq").withColumn("idx", F.col("seq") - 1).drop("seq")


def _draw_index(seed, b, i, n):
    key = F.concat_ws(":", F.lit(str(seed)), b.cast("string"), i.cast("string"))
    return (F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint") % n).cast("bigint")


def paired_ab(evals: DataFrame, metric: str, model_a: str, model_b: str,
              alpha: float = C.ALPHA, n_boot: int = C.N_BOOT, seed: int = C.BOOT_SEED) -> DataFrame:
    """Means, mean difference, percentile bootstrap CI and the paired t statistic.

    Draw ``i`` of resample ``b`` picks question md5('seed:b:i')[:15] mod n
    (reproducible, and the same in any SQL engine).  The n_boot x n draws
    come from ``range``; each resample's mean is a partial + final
    aggregate by b, and the CI is an exact percentile over the n_boot means.
    """
    spark = evals.sparkSession
    d = paired_diffs(evals, metric, model_a, model_b)
    stats = d.agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"),
                  F.avg("d").alias("diff"), F.stddev_samp("d").alias("sd"),
                  F.max(F.abs("d")).alias("max_abs"))
    n = d.count()
    if n == 0:
        ci = spark.createDataFrame([(1, None, None)], "_k int, ci_low double, ci_high double")
    else:
        draws = spark.range(0, n_boot * n).select(
            (F.col("id") / n).cast("bigint").alias("b"), (F.col("id") % n).alias("i"))
        draws = draws.select("b", _draw_index(seed, F.col("b"), F.col("i"), F.lit(n)).alias("idx"))
        means = draws.join(d.select("idx", "d"), "idx").groupBy("b").agg(F.avg("d").alias("m"))
        ci = means.agg(F.lit(1).alias("_k"), F.percentile("m", F.lit(alpha / 2)).alias("ci_low"),
                       F.percentile("m", F.lit(1 - alpha / 2)).alias("ci_high"))
    out = stats.withColumn("_k", F.lit(1)).join(ci, "_k")  # both sides are single rows
    t = F.try_divide(F.col("diff"), F.col("sd") / F.sqrt(F.col("n")))
    return out.select(F.lit(metric).alias("metric"), F.lit(model_a).alias("model_a"),
                      F.lit(model_b).alias("model_b"), "n", "mean_a", "mean_b", "diff",
                      "ci_low", "ci_high", t.alias("t_stat"), "max_abs")


def _betacf(a, b, x):
    # continued fraction for the regularised incomplete beta (modified Lentz)
    tiny, eps = 1e-300, 3e-16
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1.0 - x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, df: float) -> float:
    """Two-sided Student-t tail probability."""
    if t is None or df is None or df <= 0 or math.isnan(t):
        return float("nan")
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def _p_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(float(a), float(b)) if pd.notna(a) and pd.notna(b) else float("nan")
                      for a, b in zip(t, df)])


def paired_ab_test(evals: DataFrame, metric: str, model_a: str, model_b: str,
                   alpha: float = C.ALPHA, n_boot: int = C.N_BOOT, seed: int = C.BOOT_SEED) -> DataFrame:
    """E13 + E14: adds the paired t-test p-value (1 when all differences are
    within 1e-8 of 0), ``significant`` and the summary line."""
    r = paired_ab(evals, metric, model_a, model_b, alpha, n_boot, seed)
    p = F.when(F.col("max_abs") <= 1e-8, F.lit(1.0)).otherwise(_p_udf(F.col("t_stat"), F.col("n") - 1.0))
    r = r.withColumn("p_value", p)
    sig = (F.col("p_value") < alpha) & (F.col("ci_low") * F.col("ci_high") > 0)
    verdict = F.when(sig, F.lit("significant")).otherwise(F.lit("not significant"))
    line = F.format_string("%s: %s - %s = %+.3f (95%% CI [%+.3f, %+.3f], p=%.4f, %s)",
                           "metric", "model_b", "model_a", "diff", "ci_low", "ci_high", "p_value", verdict)
    return r.withColumn("significant", sig).withColumn("summary", line)


def preference_pairs(evals: DataFrame, answer_col: str = "event_id", order_col: str = "event_id",
                     question_col: str | None = None, created_ts=None) -> DataFrame:
    """E15 + W6: per question with >= 2 answers, best vs worst by reward, margin > 0.

    ``question_col`` names the question's text; ``created_ts`` stamps the pairs
    (default: now).  Ties follow a stable descending sort in ``order_col`` order: the best is
    the first of the tied top, the worst the last of the tied bottom.  Both
    are partial-aggregated picks (max_by / min_by), never a sorted group.
    """
    neg = -F.col(order_col)
    row = F.struct(F.col("model"), F.col(answer_col).alias("answer"), F.col("reward"))
    asked = [F.min_by(F.col(question_col), F.col(order_col)).alias("question")] if question_col else []
    g = evals.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n"), *asked,
        F.max_by(row, F.struct(F.col("reward"), neg)).alias("best"),
        F.min_by(row, F.struct(F.col("reward"), neg)).alias("worst"))
    stamp = F.current_timestamp() if created_ts is None else F.lit(created_ts)
    return (g.filter(F.col("n") >= 2)
            .withColumn("margin", F.col("best.reward") - F.col("worst.reward"))
            .filter(F.col("margin") > 0)
            .select(F.sha2(F.col("question_id"), 256).alias("pair_id"), "question_id",
                    *(["question"] if question_col else []),
                    F.col("best.answer").alias("chosen"), F.col("worst.answer").alias("rejected"),
                    F.col("best.model").alias("chosen_model"), F.col("worst.model").alias("rejected_model"),
                    "margin", stamp.cast("timestamp").alias("created_ts")))


def best_of_n(pool: DataFrame, value_col: str = "reward", schedule=C.BEST_OF_N_SCHEDULE) -> DataFrame:
    """Exact expected max of N draws with replacement from the pool.

    E[max] = sum over distinct values v of v * ((c1/m)^N - (c0/m)^N), with
    c0 < c1 the cumulative counts below / up to v.  The pool collapses to
    (value, count) rows first; the running count is a distributed prefix sum.
    """
    vc = pool.groupBy(F.col(value_col).alias("v")).agg(F.count(F.lit(1)).alias("c")).filter(F.col("v").isNotNull())
    cum = range_prefix(vc, ["v"], sums={"c": "c1"}).withColumn("c0", F.col("c1") - F.col("c"))
    m = vc.agg(F.sum("c")).first()[0] or 0
    ns = F.explode(F.array(*[F.lit(int(x)) for x in schedule])).alias("n_candidates")
    terms = cum.select("v", "c0", "c1", ns).select(
        "n_candidates",
        (F.col("v") * (F.pow(F.col("c1") / m, F.col("n_candidates"))
                       - F.pow(F.col("c0") / m, F.col("n_candidates")))).alias("t"))
    return terms.groupBy("n_candidates").agg(F.sum("t").alias("mean_reward"))
