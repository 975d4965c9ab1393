"""Stream queries: snapshots built from v_points, landed and streamed."""

from __future__ import annotations

from pyspark.sql import functions as F

from gtspark import config as C
from gtspark.operators import forecast
from gtspark.plans.q_forecast import _features_sql, features_df
from gtspark.plans.registry import register
from gtspark.plans.views import v_points, with_views
from gtspark.session import materialise, scratch_path
from gtspark.streaming import advisories, estimates


def hourly_storms(spark, sf_dir):
    """The storms of every hour of v_points, as a snapshot holds them."""
    p = v_points(spark, sf_dir).withColumn(
        "fetched_at", F.date_format(F.date_trunc("hour", "obs_time"), "yyyy-MM-dd'T'HH:mm:ss"))
    per = p.groupBy("fetched_at", "storm_id").agg(
        F.max("max_wind_kt").alias("w"), F.min("min_pressure_mb").alias("pr"),
        F.max_by(F.struct("lat", "lon", "status"), "line_no").alias("last"))
    return per.select("fetched_at", F.col("storm_id").alias("id"), F.lit("").alias("name"),
                      F.col("last.status").alias("classification"), F.col("w").cast("string").alias("intensity_kt"),
                      F.col("last.lat").cast("string").alias("lat"), F.col("last.lon").cast("string").alias("lon"),
                      F.lit(None).cast("string").alias("movement"), F.col("pr").cast("string").alias("pressure_mb"))


_HOURS_SQL = """
hours AS (SELECT storm_id, strftime(date_trunc('hour', obs_time), '%Y-%m-%dT%H:%M:%S') AS fetched_at,
                 MAX(max_wind_kt) AS max_wind_kt, MIN(min_pressure_mb) AS min_pressure_mb,
                 arg_max(lat, line_no) AS lat, arg_max(lon, line_no) AS lon
          FROM v_points GROUP BY storm_id, date_trunc('hour', obs_time))"""


@register("advisory_stream", with_views(f""", {_HOURS_SQL}
SELECT storm_id, 'UNNAMED' AS name, fetched_at, max_wind_kt AS intensity_kt, min_pressure_mb AS pressure_mb, lat, lon
FROM hours""", "v_points"))
def advisory_stream(spark, sf_dir):
    """ST1 SRC7: deduplicated advisory rows drained from snapshots that landed twice."""
    root = scratch_path(spark, "advisories")
    storms = materialise(hourly_storms(spark, sf_dir), "storms")
    for copy in "ab":                                                       # redelivered
        advisories.write_snapshots(storms, f"{root}/landing/{copy}")
    advisories.advisory_stream(spark, root + "/landing/*", root + "/table", root + "/checkpoint")
    t = spark.read.parquet(root + "/table")
    return t.select("storm_id", "name", "fetched_at", "intensity_kt", "pressure_mb", "lat", "lon")


@register("snapshot_counts", with_views(f""", {_HOURS_SQL}
SELECT fetched_at, count(*) AS active_storm_count, count(*) AS storms,
       string_agg(storm_id, ',' ORDER BY storm_id) AS ids
FROM hours GROUP BY 1""", "v_points"))
def snapshot_counts(spark, sf_dir):
    """SNK8 A17: every landed snapshot's count beside the storms it holds."""
    path = scratch_path(spark, "snapshots")
    advisories.write_snapshots(hourly_storms(spark, sf_dir), path)
    s = advisories.read_snapshots(spark, path)
    return s.select("fetched_at", "active_storm_count", F.size("storms").cast("long").alias("storms"),
                    F.array_join(F.transform("storms", lambda x: x["id"]), ",").alias("ids"))


def _drained(spark, sf_dir, batches, model=None):
    """Folder of the live tables after snapshots that land in ``batches`` runs of the stream, each a restart."""
    root = scratch_path(spark, "estimates")
    storms = materialise(hourly_storms(spark, sf_dir), "storms")
    at = F.unix_seconds(F.to_timestamp("fetched_at"))
    lo, hi = storms.agg(F.min(at), F.max(at)).first()
    step = ((hi or 0) - (lo or 0)) // batches + 1
    for i in range(batches):
        some = storms.filter(F.floor((at - F.lit(lo)) / step) == i)
        advisories.write_snapshots(some, f"{root}/landing/{i}", parts=4)
        estimates.estimate_stream(spark, root + "/landing/*", root + "/live", model)
    return root + "/live"


_LIVE_SQL = with_views(f""", {_HOURS_SQL},
usable AS (SELECT *, row_number() OVER (ORDER BY fetched_at, storm_id) AS line_no FROM hours WHERE max_wind_kt IS NOT NULL),
{_features_sql('usable', 'nullif(min_pressure_mb, 0)')},
seen AS (SELECT storm_id, count(*) AS n_fixes FROM usable GROUP BY 1),
basis AS (SELECT storm_id, concat_ws(', ', {', '.join(f"'{c}=' || round_even({c}, 0)::BIGINT" for c in forecast.FEATURES)}) AS basis
          FROM feats)
SELECT seen.storm_id, seen.n_fixes, {', '.join(forecast.FEATURES)},
       coalesce(basis, '{C.INSUFFICIENT_TRACK_TEXT}') AS basis
FROM seen LEFT JOIN feats USING (storm_id) LEFT JOIN basis USING (storm_id)""", "v_points")


@register("recent_track_estimate", _LIVE_SQL)
def recent_track_estimate(spark, sf_dir):
    """ST2 M2 M6: features and basis of every storm's recent track after three runs of the stream."""
    live = estimates.current_estimates(spark, _drained(spark, sf_dir, 3))
    return live.select("storm_id", "n_fixes", *forecast.FEATURES, "basis")


@register("live_estimate", _LIVE_SQL.replace(f"SELECT seen.storm_id, seen.n_fixes, {', '.join(forecast.FEATURES)},",
                                             "SELECT seen.storm_id, feats.storm_id IS NOT NULL AS estimated, TRUE AS same_after_reload,"))
def live_estimate(spark, sf_dir):
    """ST2 M4-M6 SNK7: the saved model scores the stream's state; a reloaded copy gives the same."""
    path = scratch_path(spark, "model")
    forecast.save_model(forecast.train(features_df(spark, sf_dir), rounds=20), path)
    root = _drained(spark, sf_dir, 2, forecast.load_model(path))
    live = estimates.current_estimates(spark, root)
    again = estimates.estimates(estimates.current_state(spark, root), forecast.load_model(path))
    again = again.select("storm_id", F.col("predicted").alias("p"), F.col("confidence").alias("c"))
    sure = F.col("confidence").isNull() | F.col("confidence").between(1e-9, 1.0)
    same = F.col("p").eqNullSafe(F.col("predicted")) & F.col("c").eqNullSafe(F.col("confidence")) & sure
    return live.join(again, "storm_id").select(
        "storm_id", F.col("predicted").isNotNull().alias("estimated"), same.alias("same_after_reload"), "basis")
