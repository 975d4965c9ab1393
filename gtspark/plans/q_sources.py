"""Source round trips: rows of the driver's tables are written in the source
format to the shared folder, then read back by the package's readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gtspark.plans.registry import register
from gtspark.plans.views import table, v_points, v_storms, with_views
from gtspark.session import scratch_path
from gtspark.sources import hurdat2


def _code(storm_id_col="storm_id"):
    sid = F.col(storm_id_col).cast("bigint")
    return F.concat(F.lit("AL"), F.lpad((sid % 100).cast("string"), 2, "0"),
                    (F.lit(1980) + sid % 44).cast("string"))


def _radii_points(spark, sf_dir):
    p = v_points(spark, sf_dir)
    return (p.withColumn("r34_ne", (F.col("line_no") % 50).cast("int"))
            .withColumn("rmw_nm", F.when(F.col("line_no") % 3 == 0, (F.col("line_no") % 40).cast("int"))))


@register("hurdat_parse", with_views("""
SELECT 'AL' || lpad(CAST(CAST(p.storm_id AS BIGINT) % 100 AS VARCHAR), 2, '0')
         || CAST(1980 + CAST(p.storm_id AS BIGINT) % 44 AS VARCHAR) AS storm_id,
       date_trunc('minute', p.obs_time) AS obs_time, p.record_id, p.status,
       round(p.lat, 1) AS lat, round(p.lon, 1) AS lon, p.max_wind_kt, p.min_pressure_mb,
       CAST(p.line_no % 50 AS INTEGER) AS r34_ne, CAST(NULL AS INTEGER) AS r50_ne,
       CASE WHEN p.line_no % 3 = 0 THEN CAST(p.line_no % 40 AS INTEGER) END AS rmw_nm,
       CAST(c.n AS INTEGER) AS n_declared, coalesce(nullif(s.name, ''), 'UNNAMED') AS name
FROM v_points p JOIN (SELECT storm_id, COUNT(*) AS n FROM v_points GROUP BY 1) c ON c.storm_id = p.storm_id
JOIN v_storms s ON s.storm_id = p.storm_id""", "v_points", "v_storms"))
def hurdat_parse(spark, sf_dir):
    """SRC1 P2 P3 P5 P9 W8: best-track text written from v_points, parsed back."""
    path = scratch_path(spark, "hurdat2")
    pts = _radii_points(spark, sf_dir)
    storms = v_storms(spark, sf_dir).withColumn("code", _code())
    hurdat2.write_hurdat2(storms, pts, path)
    st, pp = hurdat2.read_hurdat2(spark, path, continued=True)
    return (pp.join(st.select("storm_key", "name", F.col("n_track_points").alias("n_declared")), "storm_key")
            .select("storm_id", "obs_time", "record_id", "status", "lat", "lon", "max_wind_kt",
                    "min_pressure_mb", "r34_ne", "r50_ne", "rmw_nm", "n_declared", "name"))


@register("hurdat_counts", with_views("""
SELECT 'AL' || lpad(CAST(CAST(storm_id AS BIGINT) % 100 AS VARCHAR), 2, '0')
         || CAST(1980 + CAST(storm_id AS BIGINT) % 44 AS VARCHAR) AS storm_id,
       CAST(COUNT(*) AS INTEGER) AS n_track_points, COUNT(*) AS n_found, TRUE AS ok
FROM v_points GROUP BY v_points.storm_id""", "v_points"))
def hurdat_counts(spark, sf_dir):
    """SRC1 quality check: detail lines found = declared count, per storm."""
    path = scratch_path(spark, "hurdat2")
    storms = v_storms(spark, sf_dir).withColumn("code", _code())
    hurdat2.write_hurdat2(storms, v_points(spark, sf_dir), path)
    st, pp = hurdat2.read_hurdat2(spark, path, continued=True)
    return hurdat2.count_check(st, pp).select("storm_id", "n_track_points", "n_found", "ok")
