"""A/B, preference and best-of-N queries over v_evals."""

from __future__ import annotations

from pyspark.sql import functions as F

from gtspark import config as C
from gtspark.operators import stats
from gtspark.plans.registry import register
from gtspark.plans.views import v_claims, v_evals, with_views

METRIC, MODEL_A, MODEL_B = "groundedness", "m0", "m1"

_PAIRED_SQL = f""",
la AS (SELECT question_id, arg_max({METRIC}, (run_ts, run_id, event_id)) AS a FROM v_evals
       WHERE model = '{MODEL_A}' GROUP BY 1),
lb AS (SELECT question_id, arg_max({METRIC}, (run_ts, run_id, event_id)) AS b FROM v_evals
       WHERE model = '{MODEL_B}' GROUP BY 1),
d AS (SELECT question_id, a, b, b - a AS d, ROW_NUMBER() OVER (ORDER BY question_id) - 1 AS idx
      FROM la JOIN lb USING (question_id)),
nn AS (SELECT COUNT(*) AS n FROM d),
draws AS (SELECT r // n AS b, CAST(('0x' || substr(md5('{C.BOOT_SEED}:' || CAST(r // n AS VARCHAR) || ':'
                                  || CAST(r % n AS VARCHAR)), 1, 15)) AS BIGINT) % n AS idx
          FROM nn, range(0, {C.N_BOOT} * (SELECT n FROM nn)) t(r)),
means AS (SELECT draws.b, AVG(d.d) AS m FROM draws JOIN d ON d.idx = draws.idx GROUP BY 1)"""


_AB_SQL = f"""
SELECT '{METRIC}' AS metric, '{MODEL_A}' AS model_a, '{MODEL_B}' AS model_b, s.n, s.mean_a, s.mean_b, s.diff,
       c.ci_low, c.ci_high, s.diff / (s.sd / sqrt(s.n)) AS t_stat, s.max_abs
FROM (SELECT COUNT(*) AS n, AVG(a) AS mean_a, AVG(b) AS mean_b, AVG(d) AS diff, stddev_samp(d) AS sd,
             MAX(abs(d)) AS max_abs FROM d) s,
     (SELECT quantile_cont(m, {C.ALPHA / 2}) AS ci_low, quantile_cont(m, {1 - C.ALPHA / 2}) AS ci_high
      FROM means) c"""


@register("paired_ab", with_views(_PAIRED_SQL + _AB_SQL, "v_evals"))
def paired_ab(spark, sf_dir):
    """m1 vs m0 on groundedness, 10,000 hashed bootstrap resamples."""
    return stats.paired_ab(v_evals(spark, sf_dir), METRIC, MODEL_A, MODEL_B)


# two-sided tail of Student's t: the density integrated by Simpson's rule in 4,000 steps
_P_SQL = """area AS (
  SELECT sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
             * pow(1 + pow(i * abs(t_stat) / 4000, 2) / (n - 1), -n / 2.0)) * abs(any_value(t_stat)) / 12000
         * exp(lgamma(any_value(n) / 2.0) - lgamma((any_value(n) - 1) / 2.0)) / sqrt((any_value(n) - 1) * pi()) AS half
  FROM ab, range(0, 4001) r(i)),
tested AS (SELECT ab.*, CASE WHEN max_abs <= 1e-8 THEN 1.0 ELSE 1 - 2 * half END AS p FROM ab, area),
judged AS (SELECT *, p < {alpha} AND ci_low * ci_high > 0 AS significant FROM tested)
SELECT metric, model_a, model_b, n, diff, ci_low, ci_high, t_stat, round(p, 6) AS p_value, significant,
       printf('%s: %s - %s = %+.3f (95%% CI [%+.3f, %+.3f], p=%.4f, %s)', metric, model_b, model_a, diff, ci_low, ci_high, p,
              CASE WHEN significant THEN 'significant' ELSE 'not significant' END) AS summary
FROM judged"""


@register("paired_ab_test", with_views(_PAIRED_SQL + ",\nab AS (" + _AB_SQL + "),\n" + _P_SQL.format(alpha=C.ALPHA), "v_evals"))
def paired_ab_test(spark, sf_dir):
    """The same plus the t-test p-value, significance and summary line."""
    r = stats.paired_ab_test(v_evals(spark, sf_dir), METRIC, MODEL_A, MODEL_B)
    return r.select("metric", "model_a", "model_b", "n", "diff", "ci_low", "ci_high", "t_stat",
                    F.round("p_value", 6).alias("p_value"), "significant", "summary")


@register("preference_pairs", with_views("""
SELECT sha256(question_id) AS pair_id, question_id, question, chosen, rejected, chosen_model, rejected_model,
       margin, TRUE AS stamped FROM (
  SELECT question_id, COUNT(*) AS n, arg_min('What of ' || question_id || '?', event_id) AS question,
         arg_max(answer, (reward, -event_id)) AS chosen, arg_min(answer, (reward, -event_id)) AS rejected,
         arg_max(model, (reward, -event_id)) AS chosen_model, arg_min(model, (reward, -event_id)) AS rejected_model,
         MAX(reward) - MIN(reward) AS margin
  FROM v_evals JOIN v_claims USING (event_id, storm_id) GROUP BY question_id)
WHERE n >= 2 AND margin > 0""", "v_evals", "v_claims"))
def preference_pairs(spark, sf_dir):
    """Best vs worst answer text per question, with the question and a time."""
    e = v_evals(spark, sf_dir).join(v_claims(spark, sf_dir), ["event_id", "storm_id"])
    e = e.withColumn("question", F.concat(F.lit("What of "), "question_id", F.lit("?")))
    p = stats.preference_pairs(e, "answer", question_col="question")
    return p.withColumn("stamped", F.col("created_ts").isNotNull()).drop("created_ts")


@register("best_of_n", with_views(f""",
vc AS (SELECT reward AS v, COUNT(*) AS c FROM v_evals WHERE reward IS NOT NULL GROUP BY 1),
cum AS (SELECT v, c, SUM(c) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c1 FROM vc),
m AS (SELECT SUM(c) AS m FROM vc)
SELECT n AS n_candidates, SUM(v * (pow(c1 / m, n) - pow((c1 - c) / m, n))) AS mean_reward
FROM cum, m, (SELECT unnest([{', '.join(str(x) for x in C.BEST_OF_N_SCHEDULE)}]) AS n) ns
GROUP BY n""", "v_evals"))
def best_of_n(spark, sf_dir):
    """Exact best-of-N expectation over the reward pool."""
    r = stats.best_of_n(v_evals(spark, sf_dir))
    return r.select(F.col("n_candidates").cast("int").alias("n_candidates"), "mean_reward")
