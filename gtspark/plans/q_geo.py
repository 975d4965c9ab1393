"""Spatial and linking queries: nearest station, proximity, narrative links."""

from __future__ import annotations

from pyspark.sql import functions as F

from gtspark.operators import medallion, spatial
from gtspark.plans.registry import register
from gtspark.plans.views import table, v_places, v_points, v_stations, with_views

_HAV = ("2 * 6371.0 * asin(sqrt(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + "
        "cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2)))")


def hav_sql(a: str, b: str) -> str:
    return _HAV.format(a=a, b=b)


@register("nearest_station", with_views(f"""
SELECT place_id, station_id, round(d, 6) AS distance_km FROM (
  SELECT p.place_id, s.station_id, {hav_sql('p', 's')} AS d,
         ROW_NUMBER() OVER (PARTITION BY p.place_id ORDER BY round({hav_sql('p', 's')}, 9), s.station_id) AS rn
  FROM v_places p, v_stations s) WHERE rn = 1""", "v_places", "v_stations"))
def nearest_station(spark, sf_dir):
    """Nearest supplier 'station' for every customer 'place'."""
    r = spatial.nearest_station(v_places(spark, sf_dir), v_stations(spark, sf_dir))
    return r.select("place_id", "station_id", F.round("distance_km", 6).alias("distance_km"))


@register("track_buoy_proximity", with_views(f""",
fx AS (SELECT line_no AS fix_id, obs_time, lat, lon FROM v_points WHERE status = 'click'),
ob AS (SELECT line_no AS obs_id, obs_time, lat, lon FROM v_points WHERE status = 'view'),
c AS (SELECT fx.fix_id, ob.obs_id, {hav_sql('fx', 'ob')} AS d FROM fx JOIN ob
        ON abs(epoch_us(fx.obs_time) - epoch_us(ob.obs_time)) <= 10800000000),
b AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY fix_id ORDER BY round(d, 9), obs_id) AS rn
                     FROM c WHERE d <= 150.0) WHERE rn = 1)
SELECT fx.fix_id, b.obs_id, round(b.d, 6) AS distance_km FROM fx LEFT JOIN b ON b.fix_id = fx.fix_id""",
                                             "v_points"))
def track_buoy_proximity(spark, sf_dir):
    """Nearest 'view' observation within 3 h and 150 km of each 'click' fix."""
    p = v_points(spark, sf_dir)
    fixes = p.filter(F.col("status") == "click").select(F.col("line_no").alias("fix_id"), "obs_time", "lat", "lon")
    obs = p.filter(F.col("status") == "view").select(F.col("line_no").alias("obs_id"), "obs_time", "lat", "lon")
    r = spatial.nearest_within(fixes, obs, 3.0, 150.0)
    return r.select("fix_id", "obs_id", F.round("distance_km", 6).alias("distance_km"))


@register("narrative_link", """
SELECT d.doc_id, CAST(b.item_id AS VARCHAR) AS linked_storm_id
FROM documents d LEFT JOIN benchmark b
  ON b.item_id % 4 = d.doc_id % 4 AND contains(upper(d.text), upper(b.text))""")
def narrative_link(spark, sf_dir):
    """Documents as event narratives, benchmark passages as storm names, id % 4 as the year."""
    ev = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("event_narrative"), (F.col("doc_id") % 4).alias("year"))
    st = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("storm_id"), F.upper("text").alias("name"),
        (F.col("item_id") % 4).alias("year"))
    return medallion.link_narratives(ev, st).select("doc_id", "linked_storm_id")
