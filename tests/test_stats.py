import math

from gtspark.operators import stats


def _evals(spark, pairs):
    rows = []
    for i, (a, b) in enumerate(pairs):
        rows.append(("ma", f"q{i}", a, "2024-01-01", "r1", i))
        rows.append(("mb", f"q{i}", b, "2024-01-01", "r1", 100 + i))
    return spark.createDataFrame(rows, "model string, question_id string, groundedness double, "
                                       "run_ts string, run_id string, event_id long")


def test_ab_separated_is_significant(spark):
    pairs = [(0.1, 0.9), (0.2, 0.8), (0.15, 0.95), (0.3, 0.85), (0.05, 0.9), (0.2, 0.99)]
    r = stats.paired_ab_test(_evals(spark, pairs), "groundedness", "ma", "mb", n_boot=2000).first()
    assert r.significant and r.diff > 0 and r.ci_low > 0


def test_ab_identical_is_not(spark):
    pairs = [(0.5, 0.5), (0.6, 0.6), (0.7, 0.7)]
    r = stats.paired_ab_test(_evals(spark, pairs), "groundedness", "ma", "mb", n_boot=500).first()
    assert r.p_value == 1.0 and not r.significant


def test_t_pvalue_known_values():
    # two-sided p for t=2.0, df=10 is 0.0734; t=0 gives 1
    assert abs(stats.t_two_sided_p(2.0, 10) - 0.07339) < 1e-4
    assert abs(stats.t_two_sided_p(0.0, 5) - 1.0) < 1e-12
    # against a midpoint-rule integral of the t density
    t, df = 3.0, 30
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    n, hi = 200000, 60.0
    tail = sum(c * (1 + ((t + (i + 0.5) * (hi - t) / n) ** 2) / df) ** (-(df + 1) / 2)
               for i in range(n)) * (hi - t) / n
    assert abs(stats.t_two_sided_p(-t, df) - 2 * tail) < 1e-7


def test_best_of_n_exact(spark):
    pool = [0.1, 0.5, 0.5, 0.9, -1.0]
    df = spark.createDataFrame([(v,) for v in pool], "reward double")
    got = {r.n_candidates: r.mean_reward for r in stats.best_of_n(df).collect()}
    vals = sorted(pool)
    m = len(vals)
    for n in (1, 2, 4, 8, 16):
        exp = sum(v * ((i / m) ** n - ((i - 1) / m) ** n) for i, v in enumerate(vals, start=1))
        assert math.isclose(got[n], exp, rel_tol=1e-9, abs_tol=1e-12)


def test_preference_pairs_ties(spark):
    rows = [("m1", "q1", 0.5, 1), ("m2", "q1", 0.5, 2), ("m3", "q1", 0.1, 3), ("m4", "q1", 0.1, 4),
            ("m1", "q2", 0.3, 5), ("m2", "q2", 0.3, 6), ("m1", "q3", 0.9, 7)]
    df = spark.createDataFrame(rows, "model string, question_id string, reward double, event_id long")
    out = {r.question_id: r for r in stats.preference_pairs(df).collect()}
    assert set(out) == {"q1"}
    assert out["q1"].chosen_model == "m1" and out["q1"].rejected_model == "m4"
    assert abs(out["q1"].margin - 0.4) < 1e-12
