import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from gtspark import config as C
from gtspark.operators import forecast
from gtspark.sources import feeds
from gtspark.streaming import advisories, estimates

STORM = "fetched_at string, id string, name string, classification string, intensity_kt string, lat string, lon string, movement string, pressure_mb string"


def storm_rows(n_hours=30, storms=("a", "b", "c"), seed=2):
    rng, out = random.Random(seed), []
    t0 = dt.datetime(2024, 9, 1)
    for h in range(n_hours):
        for s in storms:
            if s == "c" and h > 1:
                continue
            wind = None if rng.random() < 0.1 else str(rng.randrange(20, 140))
            out.append(((t0 + dt.timedelta(hours=h)).isoformat(), s, "", "TS", wind, str(20 + h / 10), str(-70 - h / 5), None,
                        rng.choice(["0", "990", None])))
    return out


def features_by_hand(rows):
    out = {}
    for s in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == s and r[4] is not None), key=lambda r: r[0])
        if len(own) < 4:
            out[s] = (len(own),) + (None,) * 6
            continue
        w, last, prev = [int(r[4]) for r in own], own[-1], own[-2]
        pres = 1010.0 if last[8] in (None, "0") else float(last[8])
        out[s] = (len(own), float(w[-1]), pres, float(max(w)), float(w[-1] - (w[-5] if len(w) >= 5 else w[0])), float(last[5]),
                  abs(float(last[5]) - float(prev[5])) + abs(float(last[6]) - float(prev[6])))
    return out


def got(df):
    return {r["storm_id"]: (r["n_fixes"],) + tuple(r[c] for c in forecast.FEATURES) for r in df.collect()}


def land(spark, rows, path):
    advisories.write_snapshots(spark.createDataFrame(rows, STORM), path, parts=2)


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-9), k


def test_three_batches_with_restarts_equal_one(spark, tmp_path):
    rows = storm_rows()
    cut = [rows[:20], rows[20:41], rows[41:]]
    for i, some in enumerate(cut):
        land(spark, some, f"{tmp_path}/many/{i}")
        estimates.estimate_stream(spark, f"{tmp_path}/many/*", f"{tmp_path}/live3")
    land(spark, rows, f"{tmp_path}/one/0")
    estimates.estimate_stream(spark, f"{tmp_path}/one/*", f"{tmp_path}/live1")
    three, one = (got(estimates.current_estimates(spark, f"{tmp_path}/live{n}")) for n in (3, 1))
    close(three, one)
    close(one, features_by_hand(rows))
    basis = {r["storm_id"]: r["basis"] for r in estimates.current_estimates(spark, f"{tmp_path}/live1").collect()}
    assert basis["c"] == C.INSUFFICIENT_TRACK_TEXT and basis["a"].startswith("wind_pre=")


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    rows = storm_rows(12)
    fixes = advisories.snapshot_rows(spark.createDataFrame(
        [(r[0], [dict(zip(("id", "name", "classification", "intensity_kt", "lat", "lon", "movement", "pressure_mb"), r[1:]))])
         for r in rows], f"fetched_at string, storms array<{advisories.STORM.simpleString()}>")).withColumn(
        "event_time", F.to_timestamp("fetched_at"))
    half = fixes.filter("fetched_at < '2024-09-01T06'"), fixes.filter("fetched_at >= '2024-09-01T06'")
    root = str(tmp_path)
    for batch, some in ((0, half[0]), (1, half[1]), (1, half[1])):              # batch 1 came twice
        estimates.update(spark, some, batch, root, None)
    close(got(estimates.current_estimates(spark, root)), features_by_hand(rows))
    # a version without its success mark does not count
    (tmp_path / "state" / "batch=1" / "_SUCCESS").unlink()
    estimates.update(spark, half[1], 2, root, None)
    close(got(estimates.current_estimates(spark, root)), features_by_hand(rows))


def test_fold_does_not_depend_on_order(spark):
    rows = storm_rows(25)
    df = spark.createDataFrame([(r[1], r[0], r[4], r[8], r[5], r[6]) for r in rows],
                               "storm_id string, t string, w string, p string, lat string, lon string").selectExpr(
        "storm_id", "to_timestamp(t) AS event_time", "cast(w AS int) AS intensity_kt", "cast(p AS int) AS pressure_mb",
        "cast(lat AS double) AS lat", "cast(lon AS double) AS lon")
    parts = [df.filter(F.pmod(F.hash("event_time"), F.lit(3)) == i) for i in range(3)]
    s = [estimates.batch_state(p) for p in parts]
    a = estimates.state_features(estimates.fold(estimates.fold(s[0], s[1]), s[2]))
    b = estimates.state_features(estimates.fold(s[2], estimates.fold(s[1], s[0])))
    c = estimates.state_features(estimates.batch_state(df))
    assert sorted(a.collect()) == sorted(b.collect()) == sorted(c.collect())


def test_late_rows_are_dropped_and_repeats_once(spark, tmp_path):
    rows = storm_rows(40, ("a",))
    late = rows[3]
    land(spark, rows[:3] + rows[4:], f"{tmp_path}/in/0")
    advisories.advisory_stream(spark, f"{tmp_path}/in/*", f"{tmp_path}/t", f"{tmp_path}/c")
    land(spark, [late, rows[-1]], f"{tmp_path}/in/1")                           # 36 hours late, and a repeat
    advisories.advisory_stream(spark, f"{tmp_path}/in/*", f"{tmp_path}/t", f"{tmp_path}/c")
    seen = [r[0] for r in spark.read.parquet(f"{tmp_path}/t").select("fetched_at").collect()]
    assert sorted(seen) == sorted(r[0] for r in rows if r is not late)


def test_snapshot_files_are_json_with_every_storm(spark, tmp_path):
    rows = storm_rows(6) + [('2024-09-09T00:00:00', None, 'q"uote', None, None, None, None, None, None)] * 2
    land(spark, rows, f"{tmp_path}/s")
    lines = [json.loads(x) for f in (tmp_path / "s").glob("part-*") for x in f.read_text().splitlines() if x.strip()]
    assert len(lines) == 7 and all(x["active_storm_count"] == len(x["storms"]) for x in lines)
    assert sum(len(x["storms"]) for x in lines) == len(rows)
    back = {r["fetched_at"]: r["active_storm_count"] for r in advisories.read_snapshots(spark, f"{tmp_path}/s").collect()}
    assert back["2024-09-09T00:00:00"] == 2 and len(back) == 7
    advisories.write_snapshots(spark.createDataFrame([], STORM), f"{tmp_path}/none")
    assert advisories.read_snapshots(spark, f"{tmp_path}/none").count() == 0


def test_saved_model_scores_the_same_in_a_reload(spark, tmp_path):
    rng = random.Random(3)
    feats = spark.createDataFrame([(str(i), 1990 + i % 20, int(i % 3), *[rng.uniform(0, 50) + 40 * (i % 3)] * 2,
                                    *[rng.uniform(0, 9) for _ in range(4)]) for i in range(60)],
                                  ["storm_id", "year", "label", *forecast.FEATURES])
    model = forecast.train(feats, rounds=4)
    forecast.save_model(model, f"{tmp_path}/m")
    a, b = (forecast.predict(m, feats).select("storm_id", "predicted", "confidence", "basis").orderBy("storm_id").collect()
            for m in (model, forecast.load_model(f"{tmp_path}/m")))
    assert a == b and all(1 / 3 < r["confidence"] <= 1 for r in a)
    assert sum(int(r["storm_id"]) % 3 == r["predicted"] for r in a) > 50


def test_live_estimate_short_track_has_no_category(spark):
    rows = [("long", i, 30 + 10 * i, 990, 20.0 + i, -70.0 - i) for i in range(5)] + [("short", 0, 50, 990, 25.0, -75.0)]
    pts = spark.createDataFrame(rows, "storm_id string, line_no long, max_wind_kt int, min_pressure_mb int, lat double, lon double")
    feats = spark.createDataFrame([(str(i), i % 2, *[float(i % 2) * 50] * 6) for i in range(20)],
                                  ["storm_id", "label", *forecast.FEATURES])
    out = {r["storm_id"]: r for r in forecast.live_estimate(forecast.train(feats, rounds=2), pts).collect()}
    assert out["short"]["predicted"] is None and out["short"]["basis"] == C.INSUFFICIENT_TRACK_TEXT
    assert out["long"]["predicted"] in range(6) and 0 < out["long"]["confidence"] <= 1
    assert all(r["disclaimer"] == C.LIVE_DISCLAIMER for r in out.values())


def test_feed_readers_take_odd_records(spark, tmp_path):
    feed = {"activeStorms": [{"id": "al01", "intensity": "65.7", "pressure": None, "latitudeNumeric": "x", "longitudeNumeric": -70,
                              "movementDir": 310, "movementSpeed": 12, "publicAdvisory": {"url": "https://e.org/a"}},
                             {"name": "BOB", "publicAdvisory": "none"}]}
    (tmp_path / "2024-09-01.json").write_text(json.dumps(feed, indent=1))
    (tmp_path / "2024-09-02.json").write_text("{ no json")
    (tmp_path / "2024-09-03.json").write_text('{"activeStorms": []}')
    rows = {r["storm_id"]: r for r in feeds.read_active_storms(spark, f"{tmp_path}/*.json").collect()}
    assert set(rows) == {"al01", ""} and rows["al01"]["fetched_at"] == "2024-09-01"
    assert rows["al01"]["intensity_kt"] == 65 and rows["al01"]["lat"] is None and rows["al01"]["lon"] == -70.0
    assert rows["al01"]["movement"] == "310 12 kt" and rows["al01"]["advisory_url"] == "https://e.org/a"
    assert rows["al01"]["name"] == "UNNAMED" and rows[""]["movement"] == "kt" and rows[""]["advisory_url"] == ""

    fc = tmp_path / "fc.jsonl"
    fc.write_text('{"lat": 35.126, "lon": -77, "properties": {}}\nnot json\n'
                  '{"lat": 1, "lon": 2, "properties": {"cwa": "MHX", "relativeLocation": {"properties": {"city": "X", "state": "NC"}}},'
                  ' "forecast": {"properties": {"periods": [{"name": "Tonight", "temperature": 72, "temperatureUnit": "F",'
                  ' "shortForecast": "Clear", "windSpeed": "5 mph", "windDirection": "N"}]}}}\n')
    out = {r["location"]: r for r in feeds.read_forecasts(spark, str(fc)).collect()}
    assert set(out) == {"35.13,-77.00", "X, NC"} and out["35.13,-77.00"]["periods"] == []
    p = out["X, NC"]["periods"][0]
    assert (p["temp"], p["wind"], p["icon"]) == ("72°F", "5 mph N", "")

    st = tmp_path / "st.xml"
    st.write_text('<?xml version="1.0"?><stations><station id="41001" lat="34.7" lon="-72.7" name="East &amp; Hatteras"/>'
                  '<station id="x" lat="abc" lon="1"/><station lat="1" lon="1"/><station id="y" lat="91" lon="1"/></stations>')
    got_ = [tuple(r) for r in feeds.read_buoy_stations(spark, str(st)).collect()]
    assert got_ == [("buoy", "41001", "East & Hatteras", 34.7, -72.7)]
    js = tmp_path / "st.json"
    js.write_text(json.dumps({"stations": [{"id": "41001", "name": "T", "lat": 34.0, "lng": "-72"}, {"id": "z", "lat": 1}]}))
    both = feeds.station_catalogue(feeds.read_tide_stations(spark, str(js)), feeds.read_buoy_stations(spark, str(st))).collect()
    assert [(r["station_id"], r["kind"], r["lat"]) for r in both] == [("41001", "tide", 34.0)]
