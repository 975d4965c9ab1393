import json

import pytest
from pyspark.sql import functions as F

from gtspark.functions import scalar
from gtspark.functions.sql import FUNCTIONS, register_functions
from gtspark.operators import catalogue, spatial, stats
from gtspark.sources import schema, sinks


def test_sql_functions_equal_the_column_expressions(spark):
    assert register_functions(spark, "t_") == [f"t_{n}" for n in FUNCTIONS]
    winds = spark.createDataFrame([(w,) for w in (None, 0.0, 63.9, 64.0, 83.0, 96.0, 113.0, 137.0, 200.0)], "w double")
    assert all(r[0] == r[1] for r in winds.select(scalar.saffir_simpson("w"), F.expr("t_saffir_simpson(w)")).collect())
    tok = spark.createDataFrame([(t,) for t in ("29.1N", "90.2W", " 12.0s", "x", "", None, "7E")], "t string")
    assert [r[0] for r in tok.selectExpr("t_signed_coord(t)").collect()] == [29.1, -90.2, -12.0, None, None, None, 7.0]
    txt = ["Category 1", "CATEGORIES three", "category 6", None, "cat 2", "It's 'category   two'", r"back\slash category 4"]
    ans = spark.createDataFrame([(t,) for t in txt], "a string")
    assert [r[0] for r in ans.selectExpr("t_claimed_category(a)").collect()] == [1, 3, None, None, None, 2, 4]
    one = spark.range(1).selectExpr("round(t_haversine_km(35.0, -77.0, 36.0, -76.0), 6) AS a", "t_status_label(' hu ') AS b",
                                    "t_hallucination_flag(1, 2) AS c", "t_hallucination_flag(null, 2) AS d")
    r = one.first()
    want = spark.range(1).select(F.round(scalar.haversine_km(F.lit(35.0), F.lit(-77.0), F.lit(36.0), F.lit(-76.0)), 6)).first()[0]
    assert (r.a, r.b, r.c, r.d) == (want, "hurricane", True, None)
    assert "Python" not in one._jdf.queryExecution().executedPlan().toString()
    register_functions(spark, "t_")                                              # again: no error


def test_schema_twice_then_appended(spark, tmp_path):
    db = "schema_test"
    try:
        for n in (1, 2):
            assert schema.init_schema(spark, db, str(tmp_path)) == sorted(schema.TABLES)
            schema.append(spark.createDataFrame([("r", f"m{n}", 0.5)], "run_id string, model string, reward double"), db, "evaluations")
        rows = spark.table(f"{db}.evaluations").select("model", "run_id", "reward", "answer").orderBy("model").collect()
        assert [tuple(r) for r in rows] == [("m1", "r", 0.5, None), ("m2", "r", 0.5, None)]
        with pytest.raises(schema.SchemaMismatch, match="nonsense"):
            schema.append(spark.createDataFrame([(1,)], "nonsense int"), db, "evaluations")
        other = dict(schema.TABLES, prompts=("template_name string, version int, added string", ()))
        with pytest.raises(schema.SchemaMismatch) as e:
            schema.init_schema(spark, db, str(tmp_path), other)
        assert "prompts" in str(e.value) and "version: string in place of int" in str(e.value)
        assert "added: missing" in str(e.value) and "body: not in the schema" in str(e.value)
        # an empty catalogue over the same folder finds the rows again
        for t in schema.TABLES:
            spark.sql(f"DROP TABLE {db}.{t}")
        schema.init_schema(spark, db, str(tmp_path))
        assert spark.table(f"{db}.evaluations").count() == 2
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")


def test_cards_with_long_tracks_are_split_and_whole_again(spark, tmp_path):
    cards = spark.createDataFrame([("a", "Ann", 2000, 90, None, 2, None, 25), ("b", "Bob", 2001, 40, 990, 0, 0, 0)],
                                  "id string, name string, year int, peak_wind int, min_pres int, peak_cat int, landfall_cat int, n_track long")
    tracks = spark.createDataFrame([("a", i, 20.0 + i, -70.0, 30 + i, 990, 0, "t", i == 3) for i in range(25)],
                                   "storm_id string, seq int, lat double, lon double, wind int, pres int, cat int, time string, landfall boolean")
    catalogue.export_cards(cards, tracks, f"{tmp_path}/cards", fixes=10)
    lines = [json.loads(x) for f in (tmp_path / "cards").glob("part-*") for x in f.read_text().splitlines()]
    assert sorted((x["id"], x["part"], len(x["track"])) for x in lines) == [("a", 0, 10), ("a", 1, 10), ("a", 2, 5), ("b", 0, 0)]
    assert all(x["track"] == sorted(x["track"], key=lambda t: t["seq"]) for x in lines)
    back = catalogue.whole_tracks(catalogue.read_cards(spark, f"{tmp_path}/cards"))
    assert sorted(back.collect()) == sorted(tracks.select(back.columns).collect())


def test_swap_leaves_a_whole_table_or_one_to_recover(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.parquet(path)
    sinks.replace_rows(spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), path, ("id",))
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(path).collect())
    assert read() == [(1, "a"), (2, "c"), (3, "d")]
    (tmp_path / "t").rename(tmp_path / "t.before")                               # as after a crash between the renames
    sinks.replace_rows(spark.createDataFrame([(3, "e")], "id int, v string"), path, ("id",))
    assert read() == [(1, "a"), (2, "c"), (3, "e")]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_nearest_station_plan_does_not_grow_with_the_levels(spark):
    st = spark.createDataFrame([(1, 10.0, 10.0), (2, -40.0, 170.0)], "station_id int, lat double, lon double")
    pl = spark.createDataFrame([(1, 10.1, 10.1), (2, 80.0, -100.0), (3, -40.0, -179.0)], "place_id int, lat double, lon double")
    out = spatial.nearest_station(pl, st)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 2
    assert sorted((r.place_id, r.station_id) for r in out.collect()) == [(1, 1), (2, 1), (3, 2)]


def test_upper_median_refines_large_groups(spark, monkeypatch):
    import random

    from gtspark.operators import marts

    monkeypatch.setattr(marts, "MEDIAN_ROWS", 20)
    monkeypatch.setattr(marts, "MEDIAN_CELLS", 8)
    rng = random.Random(1)
    rows = [("big", rng.choice([1.0, 5.0, rng.uniform(0, 1e6), rng.gauss(0, 1)])) for _ in range(3000)]
    rows += [("same", 7.0)] * 500 + [("one", -3.5)] + [(None, float(i)) for i in range(100)]
    got = {r["k"]: r["m"] for r in marts.upper_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", "m").collect()}
    for k in ("big", "same", "one", None):
        own = sorted(v for kk, v in rows if kk == k)
        assert got[k] == own[len(own) // 2], k


def test_preference_pairs_hold_texts_question_and_time(spark):
    df = spark.createDataFrame([("q", 1, "m0", "good", 0.9, "Why?"), ("q", 2, "m1", "bad", 0.1, "Why?"), ("p", 3, "m0", "x", 0.5, "How?")],
                               "question_id string, event_id int, model string, answer string, reward double, question string")
    r = stats.preference_pairs(df, "answer", question_col="question", created_ts="2024-01-01 00:00:00").collect()
    assert len(r) == 1 and (r[0].question, r[0].chosen, r[0].rejected) == ("Why?", "good", "bad")
    assert str(r[0].created_ts) == "2024-01-01 00:00:00"
