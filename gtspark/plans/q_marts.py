"""Evaluation-mart queries over v_evals (events seen as evaluation rows)."""

from __future__ import annotations

from gtspark.operators import marts
from gtspark.plans.q_truth import truth_df
from gtspark.plans.registry import register
from gtspark.plans.views import v_evals, with_views

RATE_SQL = "round(count(*) FILTER (hallucinated)::DOUBLE / nullif(count(hallucinated), 0), 3)"

LATEST_SQL = """newest AS (SELECT model AS of_model, max(run_ts) AS at FROM v_evals GROUP BY model),
latest AS (SELECT v.* FROM v_evals v JOIN newest n ON n.of_model IS NOT DISTINCT FROM v.model AND n.at = v.run_ts)"""


def _mean(c: str, digits: int) -> str:
    return f"round(avg({c}::DECIMAL(38,12)), {digits})"


def _board(prefix: str, latency: str) -> str:
    scores = ", ".join(f"{_mean(c, 3)} AS {prefix}{c}" for c in ("groundedness", "answer_relevance", "reward"))
    return (f"SELECT model, count(*) AS n_questions, {scores}, {RATE_SQL} AS hallucination_rate, "
            f"{_mean('latency_ms', 1)} AS {latency}, round(sum(cost_usd::DECIMAL(38,12))::DOUBLE, 4) AS total_cost_usd "
            "FROM latest GROUP BY model")


def _ev(body: str, *extra: str) -> str:
    return with_views(body, "v_evals", *extra)


@register("leaderboard", _ev(f", {LATEST_SQL} {_board('', 'latency_ms')}"))
def leaderboard(spark, sf_dir):
    """A2 + W2 + O2: latest run per model."""
    return marts.leaderboard(v_evals(spark, sf_dir))


@register("leaderboard_mart", _ev(f", {LATEST_SQL} {_board('mean_', 'mean_latency_ms')}"))
def leaderboard_mart(spark, sf_dir):
    """A2, staged-model variant: the mart table with mean_* names."""
    return marts.leaderboard(v_evals(spark, sf_dir), dbt_names=True)


@register("leaderboard_dashboard", _ev(f""", {LATEST_SQL}
SELECT model, count(question_id) AS questions, avg(groundedness) AS groundedness, avg(answer_relevance) AS answer_relevance,
       avg(reward) AS reward, coalesce(avg(hallucinated::INTEGER), 0.0)::DOUBLE AS hallucination_rate, avg(latency_ms) AS latency_ms
FROM latest GROUP BY model"""))
def leaderboard_dashboard(spark, sf_dir):
    """A3: unrounded, rate 0.0 when nothing checked."""
    return marts.leaderboard_dashboard(v_evals(spark, sf_dir))


@register("cost_latency", _ev(f"""
SELECT model, {_mean('reward', 3)} AS mean_reward, {_mean('latency_ms', 1)} AS mean_latency_ms,
       {_mean('cost_usd', 6)} AS mean_cost_per_query
FROM v_evals GROUP BY model"""))
def cost_latency(spark, sf_dir):
    """A4."""
    return marts.cost_latency(v_evals(spark, sf_dir))


@register("halluc_by_storm", _ev("""
SELECT p.storm_id, s.name, p.model, p.checked_questions, p.hallucinations
FROM (SELECT storm_id, model, count(hallucinated) AS checked_questions, count(*) FILTER (hallucinated) AS hallucinations
      FROM v_evals GROUP BY ALL) p LEFT JOIN v_storms s USING (storm_id)
WHERE p.checked_questions > 0""", "v_storms"))
def halluc_by_storm(spark, sf_dir):
    """A5 + J4 + F5."""
    return marts.halluc_by_storm(v_evals(spark, sf_dir), truth_df(spark, sf_dir))


@register("run_summary", _ev("""
SELECT run_id, avg(groundedness) AS mean_groundedness, avg(answer_relevance) AS mean_answer_relevance,
       coalesce(count(*) FILTER (hallucinated)::DOUBLE / nullif(count(hallucinated), 0), 0.0) AS hallucination_rate,
       sum(cost_usd) AS total_cost_usd, list_sort(list(latency_ms))[count(*) // 2 + 1] AS p50_latency_ms
FROM v_evals GROUP BY run_id"""))
def run_summary(spark, sf_dir):
    """Per-run summary with the upper-median latency."""
    return marts.run_summary(v_evals(spark, sf_dir))


@register("run_history", _ev("""
SELECT *, ROW_NUMBER() OVER (ORDER BY run_ts, run_id, model) AS run FROM (
  SELECT run_id, model, MIN(run_ts) AS run_ts, AVG(groundedness) AS groundedness,
         AVG(answer_relevance) AS answer_relevance, AVG(reward) AS reward,
         AVG(latency_ms) AS latency_ms, COUNT(*) AS n
  FROM v_evals GROUP BY run_id, model)"""))
def run_history(spark, sf_dir):
    """A7 + W7."""
    return marts.run_history(v_evals(spark, sf_dir))


@register("checked_summary", _ev("""
SELECT model, avg(groundedness) FILTER (hallucinated IS NOT NULL) AS checked_groundedness,
       avg(answer_relevance) FILTER (hallucinated IS NOT NULL) AS checked_answer_relevance,
       avg(hallucinated::INTEGER)::DOUBLE AS hallucination_rate, avg(groundedness) AS groundedness
FROM v_evals GROUP BY model"""))
def checked_summary(spark, sf_dir):
    """A8."""
    return marts.checked_summary(v_evals(spark, sf_dir))


@register("sweep_summary", _ev("""
SELECT run_id, AVG(groundedness) AS groundedness, AVG(answer_relevance) AS answer_relevance,
       AVG(reward) AS reward, AVG(latency_ms) AS latency_ms
FROM v_evals GROUP BY run_id"""))
def sweep_summary(spark, sf_dir):
    """Each run is a sweep cell."""
    return marts.sweep_summary(v_evals(spark, sf_dir))


@register("eval_gate", _ev("""
SELECT *, rate <= threshold AS passed
FROM (SELECT model, coalesce(avg(hallucinated::INTEGER), 0.0)::DOUBLE AS rate, 0.1::DOUBLE AS threshold
      FROM v_evals GROUP BY model)"""))
def eval_gate(spark, sf_dir):
    """A16 + E18 with the default 0.10 threshold."""
    return marts.eval_gate(v_evals(spark, sf_dir))


@register("quality_tests", _ev(f""", {LATEST_SQL},
boards AS (SELECT model FROM latest GROUP BY model),
found AS (
  SELECT unnest([
    {{'test': 'fct_evaluations.model.not_null', 'failures': (SELECT count(*) - count(model) FROM latest)}},
    {{'test': 'fct_evaluations.reward.not_null', 'failures': (SELECT count(*) - count(reward) FROM latest)}},
    {{'test': 'agg_model_performance.model.not_null', 'failures': (SELECT count(*) - count(model) FROM boards)}},
    {{'test': 'agg_model_performance.model.unique', 'failures': (SELECT count(model) - count(DISTINCT model) FROM boards)}}
  ]) AS f)
SELECT f.test AS test, f.failures AS failures, f.failures = 0 AS passed FROM found"""))
def quality_tests(spark, sf_dir):
    """The staged-model tests as a violations table."""
    ev = v_evals(spark, sf_dir)
    fct = marts.latest_runs(ev)
    return marts.quality_tests(fct, marts.leaderboard(ev, dbt_names=True))
