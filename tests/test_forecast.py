from pyspark.sql import functions as F

from gtspark.operators import forecast


def test_live_features_short_and_long(spark):
    rows = [("s1", i, 30 + 10 * i, 1000 - i if i != 4 else 0, 20.0 + i, -70.0 - i) for i in range(5)]
    rows += [("s2", 0, 50, 990, 25.0, -75.0)]
    df = spark.createDataFrame(rows, "storm_id string, line_no long, max_wind_kt int, min_pressure_mb int, "
                                     "lat double, lon double")
    f = {r.storm_id: r for r in forecast.live_features(df).collect()}
    assert set(f) == {"s1"}
    r = f["s1"]
    assert r.wind_pre == 70 and r.pres_pre == 1010 and r.peak_wind == 70
    assert r.intens_24h == 40 and r.lat_pre == 24.0 and abs(r.fwd_speed - 2.0) < 1e-12


def test_report_and_confusion(spark):
    df = spark.createDataFrame([(1, 1), (2, 3), (0, 0), (5, 1)], "actual int, predicted int")
    rep = forecast.report(df).first()
    assert rep.accuracy == 0.5 and rep.within_one == 0.75
    # labels seen: 0,1,2,3,5 -> f1: 1, 2/3, 0, 0, 0
    assert abs(rep.macro_f1 - (1 + 2 / 3) / 5) < 1e-12
    cm = forecast.confusion(df)
    assert cm.count() == 36 and cm.agg(F.sum("n")).first()[0] == 4


def test_fit_beats_the_majority_class(spark):
    import random

    from gtspark.operators import forecast

    rng = random.Random(4)
    rows = []
    for i in range(400):
        x = [rng.uniform(0, 100) for _ in forecast.FEATURES]
        rows.append((str(i), 1980 + i % 40, min(5, int(x[0] // 17)), *x))
    feats = spark.createDataFrame(rows, ["storm_id", "year", "label", *forecast.FEATURES])
    rep, confusion, _ = forecast.evaluate(feats, rounds=10)
    share = forecast.majority_share(feats).first()[0]
    r = rep.first()
    assert r.accuracy > share + 0.2 and r.n_train + r.n_test == 400 and r.n_test == r.n
    assert confusion.agg({"n": "sum"}).first()[0] == r.n


def test_persisted_predictions_cover_all_rows_with_their_split(spark, tmp_path):
    rows = [(str(i), 1980 + i % 8, i % 2, *[float(i % 2) * 40 + i % 5] * 6) for i in range(40)]
    feats = spark.createDataFrame(rows, ["storm_id", "year", "label", *forecast.FEATURES])
    t = forecast.persist_predictions(feats, f"{tmp_path}/p", rounds=2)
    got = t.collect()
    assert len(got) == 40 and {r.split for r in got} == {"train", "test"}
    assert all(r.correct == (r.predicted_category == r.actual_category) and r.run_ts for r in got)
    assert sum(r.split == "test" for r in got) == 10                             # two of eight years


def test_run_summary_without_latency(spark):
    from gtspark.operators import marts

    df = spark.createDataFrame([("a", 0.5, True, 0.1, None), ("a", 1.0, None, 0.2, None), ("b", 0.0, None, 0.0, 5.0)],
                               "run_id string, groundedness double, hallucinated boolean, cost_usd double, latency_ms double")
    got = {r.run_id: r for r in marts.run_summary(df).collect()}
    assert got["a"].p50_latency_ms is None and got["a"].hallucination_rate == 1.0 and got["a"].mean_groundedness == 0.75
    assert got["b"].p50_latency_ms == 5.0 and got["b"].hallucination_rate == 0.0
