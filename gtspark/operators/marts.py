"""Evaluation marts: leaderboards, trade-offs, run history, gate, quality tests.

A2-A9 A16 W2 W7 J4 F5 E18 E19.  Input is an ``evaluations`` frame with the
D13 columns (extra columns are ignored).  Every mart is one or two hash
aggregates; nothing needs a sort of a whole model's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gtspark import config as C
from gtspark.session import materialise

def _h():
    return F.col("hallucinated")


def _hall():
    return F.when(_h(), 1).otherwise(0)


def _checked():
    return F.when(_h().isNotNull(), 1).otherwise(0)


def latest_runs(evals: DataFrame, part: str = "model", order: str = "run_ts") -> DataFrame:
    """Rows of the latest run_ts per model (DENSE_RANK ... = 1).

    Computed as max(run_ts) per model (partial aggregate) joined back, so a
    model with most of the rows is never sorted in a single task.
    """
    last = evals.groupBy(F.col(part).alias("_last_of")).agg(F.max(order).alias("_last_ts"))
    return (evals.join(last, F.col(part).eqNullSafe(F.col("_last_of")))
            .filter(F.col(order) == F.col("_last_ts")).drop("_last_of", "_last_ts"))


def _xavg(c):
    """Average over exact decimals: the rounded mean must not depend on the
    order in which partitions are summed (a mean sitting on a rounding
    boundary, e.g. .4815, otherwise flips with the summation order)."""
    return F.avg(F.col(c).cast("decimal(38,12)"))


def _xsum(c):
    return F.sum(F.col(c).cast("decimal(38,12)"))


def _xround(e, digits):
    return F.round(e, digits).cast("double")


def _rate(null_value=None):
    num = F.sum(F.when(_h(), 1.0).otherwise(0.0))
    den = F.nullif(F.sum(_checked()), F.lit(0))
    r = num / den
    return r if null_value is None else F.coalesce(r, F.lit(float(null_value)))


def leaderboard(evals: DataFrame, dbt_names: bool = False) -> DataFrame:
    """A2: latest run per model; NULL rate when nothing was checked; reward desc.

    ``dbt_names`` gives the mart-table column names (mean_* prefixes).
    """
    n = (lambda s: f"mean_{s}") if dbt_names else (lambda s: s)
    lat = "mean_latency_ms" if dbt_names else "latency_ms"
    out = (latest_runs(evals).groupBy("model").agg(
        F.count(F.lit(1)).alias("n_questions"),
        _xround(_xavg("groundedness"), 3).alias(n("groundedness")),
        _xround(_xavg("answer_relevance"), 3).alias(n("answer_relevance")),
        _xround(_xavg("reward"), 3).alias(n("reward")),
        F.round(_rate(), 3).alias("hallucination_rate"),
        _xround(_xavg("latency_ms"), 1).alias(lat),
        _xround(_xsum("cost_usd"), 4).alias("total_cost_usd")))
    return out.orderBy(F.col(n("reward")).desc(), "model")


def leaderboard_dashboard(evals: DataFrame) -> DataFrame:
    """A3: same rows, unrounded, rate 0.0 when nothing was checked."""
    return (latest_runs(evals).groupBy("model").agg(
        F.count("question_id").alias("questions"),
        F.avg("groundedness").alias("groundedness"),
        F.avg("answer_relevance").alias("answer_relevance"),
        F.avg("reward").alias("reward"),
        F.coalesce(F.avg(F.when(_h().isNotNull(), F.when(_h(), 1.0).otherwise(0.0))), F.lit(0.0))
         .alias("hallucination_rate"),
        F.avg("latency_ms").alias("latency_ms"))
        .orderBy(F.col("reward").desc(), "model"))


def cost_latency(evals: DataFrame) -> DataFrame:
    """A4: means over all runs per model."""
    return (evals.groupBy("model").agg(
        _xround(_xavg("reward"), 3).alias("mean_reward"),
        _xround(_xavg("latency_ms"), 1).alias("mean_latency_ms"),
        _xround(_xavg("cost_usd"), 6).alias("mean_cost_per_query"))
        .orderBy(F.col("mean_reward").desc(), "model"))


def halluc_by_storm(evals: DataFrame, truth: DataFrame) -> DataFrame:
    """A5 + J4 + F5: checked questions and hallucinations by storm, name, model.

    Aggregate first (partial + final on storm_id, model), then attach the
    name: the join sees one row per (storm, model), not one per evaluation.
    """
    agg = (evals.filter(_h().isNotNull()).groupBy("storm_id", "model").agg(
        F.count(F.lit(1)).alias("checked_questions"),
        F.sum(_hall()).alias("hallucinations")))
    names = truth.select("storm_id", "name")
    return (agg.join(names, "storm_id", "left")
            .select("storm_id", "name", "model", "checked_questions", "hallucinations")
            .orderBy(F.col("hallucinations").desc(), "storm_id", "model"))


MEDIAN_ROWS = 100_000        # different values of one group that a window may sort at once
MEDIAN_CELLS = 1024


def upper_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """sorted(values)[n div 2] per group, exactly.

    Each round counts a group's values in ``MEDIAN_CELLS`` equal cells of their
    range and goes on with the cell that holds the middle, until no group has
    more than ``MEDIAN_ROWS`` values left there; those are collapsed to (value,
    count) and counted up in order.  Small groups need no round at all, and a
    group with most of the rows is never sorted.
    """
    same = lambda d: [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]
    gk = [f"_g_{k}" for k in keys]
    rows = df.select(*keys, F.col(value).cast("double").alias("_x"), F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    state = materialise(rows.groupBy(*[F.col(k).alias(f"_g_{k}") for k in keys]).agg(
        F.count(F.lit(1)).alias("_n"), (F.floor(F.count(F.lit(1)) / 2) + 1).alias("_rank"),
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi")), "median")
    while (state.filter(F.col("_lo") < F.col("_hi")).agg(F.max("_n")).first()[0] or 0) > MEDIAN_ROWS:
        part = F.try_divide(F.col("_x") - F.col("_lo"), F.col("_hi") - F.col("_lo"))       # NULL: one value is left
        cell = F.least(F.floor(part * MEDIAN_CELLS), F.lit(MEDIAN_CELLS - 1))
        cells = (rows.join(state, same(rows)).filter(F.col("_x").between(F.col("_lo"), F.col("_hi")))
                 .withColumn("_cell", F.coalesce(cell, F.lit(0))).groupBy(*gk, "_rank", "_cell")
                 .agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")))
        upto = Window.partitionBy(*gk).orderBy("_cell")                      # at most MEDIAN_CELLS rows a group
        cells = cells.withColumn("_cum", F.sum("_n").over(upto))
        here = (F.col("_cum") >= F.col("_rank")) & (F.col("_cum") - F.col("_n") < F.col("_rank"))
        state = materialise(cells.filter(here).select(
            *gk, "_n", (F.col("_rank") - F.col("_cum") + F.col("_n")).alias("_rank"), "_lo", "_hi"), "median")
    near = rows.join(state.drop("_n"), same(rows)).filter(F.col("_x").between(F.col("_lo"), F.col("_hi")))
    counts = near.groupBy(*keys, "_rank", "_v").agg(F.count(F.lit(1)).alias("_c"))
    cum = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v"))
    return (counts.withColumn("_cum", cum).filter(F.col("_cum") >= F.col("_rank"))
            .groupBy(*keys).agg(F.min("_v").alias(out)))


def run_summary(evals: DataFrame, key: str = "run_id") -> DataFrame:
    """Means, rate over checked rows else 0.0, upper-median latency, total cost."""
    means = [c for c in ("groundedness", "faithfulness", "context_relevance",
                         "answer_relevance", "judge_score") if c in evals.columns]
    agg = evals.groupBy(key).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in means],
        _rate(0.0).alias("hallucination_rate"),
        F.sum("cost_usd").alias("total_cost_usd"))
    p50 = upper_median(evals, [key], "latency_ms", "p50_latency_ms")
    p50 = p50.withColumnRenamed(key, "_of")
    return agg.join(p50, F.col(key).eqNullSafe(F.col("_of")), "left").drop("_of")      # no latency at all: NULL


def range_prefix(df: DataFrame, order_cols: list, seq: str | None = None, sums: dict | None = None) -> DataFrame:
    """Running totals over a total order without moving all rows into one task.

    ``seq`` names the row number 1..n, ``sums`` maps columns to the names of
    their running sums (this row included).  The range-sorted frame is written
    once with each row's partition and place, so the totals per partition (one
    row each, a bounded table) and the rows they offset are the same rows.
    """
    s = materialise(df.orderBy(*order_cols).withColumn("_pid", F.spark_partition_id())
                    .withColumn("_mid", F.monotonically_increasing_id()), "sorted")
    sums = sums or {}
    total = {"_n": F.count(F.lit(1))} | {f"_s_{c}": F.sum(c) for c in sums}
    parts = s.groupBy("_pid").agg(*[e.alias(n) for n, e in total.items()])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = parts.select("_pid", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_off{n}") for n in total])
    local = Window.partitionBy("_pid").orderBy("_mid")
    out = s.join(F.broadcast(offs), "_pid")
    if seq:
        out = out.withColumn(seq, (F.col("_off_n") + F.row_number().over(local)).cast("bigint"))
    for c, name in sums.items():
        own = F.sum(c).over(local.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn(name, F.col(f"_off_s_{c}") + own)
    return out.drop("_pid", "_mid", *[f"_off{n}" for n in total])


def global_row_number(df: DataFrame, order_cols: list, name: str = "seq") -> DataFrame:
    """1..n over a total order."""
    return range_prefix(df, order_cols, seq=name)


def run_history(evals: DataFrame) -> DataFrame:
    """A7 + W7: per run and model, first run_ts, means and count, numbered in time order."""
    runs = evals.groupBy("run_id", "model").agg(
        F.min("run_ts").alias("run_ts"),
        F.avg("groundedness").alias("groundedness"),
        F.avg("answer_relevance").alias("answer_relevance"),
        F.avg("reward").alias("reward"),
        F.avg("latency_ms").alias("latency_ms"),
        F.count(F.lit(1)).alias("n"))
    return global_row_number(runs, ["run_ts", "run_id", "model"], "run")


def checked_summary(evals: DataFrame) -> DataFrame:
    """Per model, means over checked rows plus groundedness over all rows."""
    chk = _h().isNotNull()
    return evals.groupBy("model").agg(
        F.avg(F.when(chk, F.col("groundedness"))).alias("checked_groundedness"),
        F.avg(F.when(chk, F.col("answer_relevance"))).alias("checked_answer_relevance"),
        F.avg(F.when(chk, F.when(_h(), 1.0).otherwise(0.0))).alias("hallucination_rate"),
        F.avg("groundedness").alias("groundedness"))


def sweep_summary(evals: DataFrame, key: str = "run_id") -> DataFrame:
    """Four means per sweep cell (run)."""
    return evals.groupBy(key).agg(
        F.avg("groundedness").alias("groundedness"),
        F.avg("answer_relevance").alias("answer_relevance"),
        F.avg("reward").alias("reward"),
        F.avg("latency_ms").alias("latency_ms"))


def eval_gate(evals: DataFrame, threshold: float = C.GATE_THRESHOLD, model: str | None = None) -> DataFrame:
    """A16 + E18: per model, rate over checked rows (none -> 0.0) and pass/fail."""
    e = evals if model is None else evals.filter(F.col("model") == model)
    g = e.groupBy("model").agg(F.coalesce(
        F.avg(F.when(_h().isNotNull(), F.when(_h(), 1.0).otherwise(0.0))), F.lit(0.0)).alias("rate"))
    return g.select("model", "rate", F.lit(float(threshold)).alias("threshold"),
                    (F.col("rate") <= F.lit(float(threshold))).alias("passed"))


def quality_tests(fact: DataFrame, board: DataFrame) -> DataFrame:
    """not_null(model), not_null(reward) on the fact table, not_null and unique(model) on the board.

    One row per test with its failure count (0 = pass).
    """
    def one(df, name, failures):
        return df.agg(failures.alias("failures")).select(F.lit(name).alias("test"), "failures")

    dup = board.filter(F.col("model").isNotNull()).groupBy("model").count().filter(F.col("count") > 1)
    parts = [
        one(fact, "fct_evaluations.model.not_null", F.count_if(F.col("model").isNull())),
        one(fact, "fct_evaluations.reward.not_null", F.count_if(F.col("reward").isNull())),
        one(board, "agg_model_performance.model.not_null", F.count_if(F.col("model").isNull())),
        one(dup, "agg_model_performance.model.unique", F.count(F.lit(1))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("passed", F.col("failures") == 0)
