"""Forecast-feature and model queries over v_points / v_forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gtspark.operators import forecast
from gtspark.plans.q_truth import cat_sql
from gtspark.plans.registry import register
from gtspark.plans.views import v_forecasts, v_points, v_storms, with_views
from gtspark.session import scratch_path


def _features_sql(src: str, pres: str) -> str:
    return f"""
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY storm_id ORDER BY line_no DESC) AS rn,
             COUNT(*) OVER (PARTITION BY storm_id) AS n_pre,
             MAX(max_wind_kt) OVER (PARTITION BY storm_id) AS pk,
             FIRST_VALUE(max_wind_kt) OVER (PARTITION BY storm_id ORDER BY line_no) AS wf
      FROM {src}),
f AS (SELECT storm_id, MAX(n_pre) AS n_pre, MAX(pk) AS pk, MAX(wf) AS wf,
             MAX(CASE WHEN rn = 1 THEN max_wind_kt END) AS w1, MAX(CASE WHEN rn = 1 THEN {pres} END) AS p1,
             MAX(CASE WHEN rn = 1 THEN lat END) AS lat1, MAX(CASE WHEN rn = 1 THEN lon END) AS lon1,
             MAX(CASE WHEN rn = 2 THEN lat END) AS lat2, MAX(CASE WHEN rn = 2 THEN lon END) AS lon2,
             MAX(CASE WHEN rn = 5 THEN max_wind_kt END) AS w5
      FROM r GROUP BY storm_id HAVING MAX(n_pre) >= 4),
feats AS (SELECT storm_id, CAST(w1 AS DOUBLE) AS wind_pre, CAST(coalesce(p1, 1010) AS DOUBLE) AS pres_pre,
                 CAST(pk AS DOUBLE) AS peak_wind,
                 CAST(w1 - CASE WHEN n_pre >= 5 THEN w5 ELSE wf END AS DOUBLE) AS intens_24h,
                 lat1 AS lat_pre, abs(lat1 - lat2) + abs(lon1 - lon2) AS fwd_speed, n_pre FROM f)"""


TRACK_SQL = with_views(f""",
lf AS (SELECT storm_id, obs_time AS lf_time, max_wind_kt AS lf_wind FROM (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY storm_id ORDER BY line_no) AS k
         FROM v_points WHERE record_id = 'L') WHERE k = 1),
pre AS (SELECT p.* FROM v_points p JOIN lf ON lf.storm_id = p.storm_id
        WHERE p.obs_time < lf.lf_time AND p.max_wind_kt IS NOT NULL),""" + _features_sql("pre", "min_pressure_mb") + f""",
tf AS (SELECT feats.*, {cat_sql('lf.lf_wind')} AS label, s.year
       FROM feats JOIN lf ON lf.storm_id = feats.storm_id LEFT JOIN v_storms s ON s.storm_id = feats.storm_id
       WHERE lf.lf_wind IS NOT NULL)""", "v_points", "v_storms")


def features_df(spark, sf_dir):
    return forecast.track_features(v_points(spark, sf_dir), v_storms(spark, sf_dir))


@register("track_features", TRACK_SQL + "\nSELECT * FROM tf")
def track_features(spark, sf_dir):
    """Pre-landfall features and label per storm."""
    return features_df(spark, sf_dir)


@register("live_features", with_views(", usable AS (SELECT * FROM v_points WHERE max_wind_kt IS NOT NULL),"
                                      + _features_sql("usable", "nullif(min_pressure_mb, 0)")
                                      + "\nSELECT * FROM feats", "v_points"))
def live_features(spark, sf_dir):
    """M2: the same features over each storm's whole track."""
    return forecast.live_features(v_points(spark, sf_dir))


@register("year_split", TRACK_SQL + """,
yrs AS (SELECT DISTINCT year FROM tf),
picked AS (SELECT year FROM yrs ORDER BY md5('3:' || CAST(year AS VARCHAR)), year
           LIMIT (SELECT greatest(1, CAST(floor(COUNT(*) * 0.25) AS BIGINT)) FROM yrs))
SELECT tf.storm_id, tf.year, CASE WHEN p.year IS NOT NULL THEN 'test' ELSE 'train' END AS split
FROM tf LEFT JOIN picked p ON p.year = tf.year""")
def year_split(spark, sf_dir):
    """M3: train/test assignment by year."""
    return forecast.year_split(features_df(spark, sf_dir)).select("storm_id", "year", "split")


@register("majority_share", TRACK_SQL + """
SELECT max(n) / sum(n) AS majority_share FROM (SELECT label, count(*) AS n FROM tf GROUP BY label)""")
def majority_share(spark, sf_dir):
    """Share of the largest class among the track rows."""
    return forecast.majority_share(features_df(spark, sf_dir))


@register("fit_counts", TRACK_SQL + """,
yrs AS (SELECT DISTINCT year FROM tf),
held AS (SELECT year FROM yrs ORDER BY md5('3:' || CAST(year AS VARCHAR)), year
         LIMIT (SELECT greatest(1, CAST(floor(COUNT(*) * 0.25) AS BIGINT)) FROM yrs))
SELECT count(*) FILTER (year NOT IN (SELECT year FROM held)) AS n_train,
       count(*) FILTER (year IN (SELECT year FROM held)) AS n_test FROM tf""")
def fit_counts(spark, sf_dir):
    """M7: rows that the fit trains on and holds out, by year."""
    split = forecast.year_split(features_df(spark, sf_dir))
    return split.groupBy().agg(F.count_if(F.col("split") == "train").alias("n_train"),
                               F.count_if(F.col("split") == "test").alias("n_test"))


@register("confusion", with_views("""
SELECT g.actual, g.predicted, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT a.x AS actual, p.x AS predicted FROM (SELECT unnest([0,1,2,3,4,5]) AS x) a,
                                                   (SELECT unnest([0,1,2,3,4,5]) AS x) p) g
LEFT JOIN (SELECT actual, predicted, COUNT(*) AS n FROM v_forecasts GROUP BY 1, 2) c
  ON c.actual = g.actual AND c.predicted = g.predicted""", "v_forecasts"))
def confusion(spark, sf_dir):
    """6 x 6 confusion counts with zero cells."""
    return forecast.confusion(v_forecasts(spark, sf_dir))


@register("forecast_report", with_views(""",
per AS (SELECT label, SUM(tp) AS tp, SUM(fp) AS fp, SUM(fn) AS fn FROM (
          SELECT actual AS label, CAST(actual = predicted AS INTEGER) AS tp, 0 AS fp,
                 CAST(actual <> predicted AS INTEGER) AS fn FROM v_forecasts
          UNION ALL
          SELECT predicted, 0, CAST(actual <> predicted AS INTEGER), 0 FROM v_forecasts) GROUP BY label)
SELECT o.n, o.accuracy, o.within_one, f.macro_f1 FROM
  (SELECT COUNT(*) AS n, AVG(CAST(actual = predicted AS DOUBLE)) AS accuracy,
          AVG(CAST(abs(actual - predicted) <= 1 AS DOUBLE)) AS within_one FROM v_forecasts) o,
  (SELECT AVG(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END)::DOUBLE AS macro_f1
   FROM per) f""", "v_forecasts"))
def forecast_report(spark, sf_dir):
    """Accuracy, within-one and macro F1 of predicted vs actual classes."""
    return forecast.report(v_forecasts(spark, sf_dir))


@register("forecast_fit")
def forecast_fit(spark, sf_dir):
    """M4 M5 M7: fit on train years, report on held-out years (+ majority share)."""
    feats = features_df(spark, sf_dir)
    rep, _, _ = forecast.evaluate(feats)
    maj = forecast.majority_share(feats)
    return rep.withColumn("_k", F.lit(1)).join(maj.withColumn("_k", F.lit(1)), "_k").drop("_k")


@register("persisted_predictions", TRACK_SQL + """,
yrs AS (SELECT DISTINCT year FROM tf),
held AS (SELECT year FROM yrs ORDER BY md5('3:' || CAST(year AS VARCHAR)), year
         LIMIT (SELECT greatest(1, CAST(floor(COUNT(*) * 0.25) AS BIGINT)) FROM yrs))
SELECT year AS storm_year, CASE WHEN year IN (SELECT year FROM held) THEN 'test' ELSE 'train' END AS split,
       label AS actual_category, count(*) AS n, TRUE AS sound
FROM tf GROUP BY ALL""")
def persisted_predictions(spark, sf_dir):
    """M8 SNK4: predictions of all rows written with their split and read back, totals by year and class."""
    t = forecast.persist_predictions(features_df(spark, sf_dir), scratch_path(spark, "predictions"), rounds=10)
    ok = F.col("predicted_category").between(0, 5) & (
        F.col("correct") == (F.col("predicted_category") == F.col("actual_category"))) & F.col("run_ts").isNotNull()
    return t.groupBy("storm_year", "split", "actual_category").agg(F.count(F.lit(1)).alias("n"), F.bool_and(ok).alias("sound"))
