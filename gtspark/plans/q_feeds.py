"""Live feeds: rows of the driver's tables landed in each feed's own form and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gtspark.operators import spatial
from gtspark.plans.q_geo import hav_sql
from gtspark.plans.registry import register
from gtspark.plans.views import table, v_places, v_points, v_stations, with_views
from gtspark.session import scratch_path
from gtspark.sources import feeds

# -- SRC10: suppliers as stations, odd keys in the JSON catalogue, even ones in the XML one --------


def _land_stations(spark, sf_dir, path):
    """Every 7th station has no readable latitude, every 11th one out of range, every 13th no longitude."""
    k = F.col("station_id")
    st = v_stations(spark, sf_dir).select(
        k, F.concat(F.lit("St. <"), k.cast("string"), F.lit('> & "Co"')).alias("name"),
        F.when(k % 7 == 0, "n/a").when(k % 11 == 0, "95.5").otherwise(F.col("lat").cast("string")).alias("lat"),
        F.when(k % 13 != 0, F.col("lon").cast("string")).alias("lon"))
    both = st.withColumn("id", F.concat(F.lit("s"), k.cast("string")))
    tide = both.filter((k % 2 == 1) | (k % 10 == 0))            # every 10th station is in both
    # one catalogue file per task's rows: a JSON object whose array is written as lines of text
    one = F.to_json(F.struct("id", "name", "lat", F.col("lon").alias("lng")))
    files = tide.repartition(4, "id").select(F.spark_partition_id().alias("f"), one.alias("line"), "id")
    head = files.select("f").distinct()
    rows = (files.select("f", F.lit(1).alias("o"), "id", "line").unionByName(
        head.select("f", F.lit(0).alias("o"), F.lit("").alias("id"), F.lit('{"stations": [').alias("line"))).unionByName(
        head.select("f", F.lit(2).alias("o"), F.lit("").alias("id"), F.lit("]}").alias("line"))))
    last = rows.filter("o = 1").groupBy("f").agg(F.max("id").alias("last"))
    rows = rows.join(last, "f").withColumn("line", F.when((F.col("o") == 1) & (F.col("id") < F.col("last")),
                                                          F.concat("line", F.lit(","))).otherwise(F.col("line")))
    rows = rows.repartition(4, "f").sortWithinPartitions("f", "o", "id")
    rows.select("line", "f").write.partitionBy("f").text(path + "/tide")
    xml = both.filter(k % 2 == 0).select(F.col("id").alias("_id"), F.col("name").alias("_name"),
                                         F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    xml.write.format("xml").options(rootTag="stations", rowTag="station", attributePrefix="_").save(path + "/buoy")


def stations_read(spark, sf_dir):
    path = scratch_path(spark, "stations")
    _land_stations(spark, sf_dir, path)
    return feeds.station_catalogue(feeds.read_tide_stations(spark, path + "/tide"),
                                   feeds.read_buoy_stations(spark, path + "/buoy"))


_STATIONS_SQL = """
cat AS (SELECT 's' || station_id AS station_id, 'St. <' || station_id || '> & "Co"' AS name, lat, lon,
               CASE WHEN station_id % 2 = 1 OR station_id % 10 = 0 THEN 'tide' ELSE 'buoy' END AS kind
        FROM v_stations WHERE station_id % 7 <> 0 AND station_id % 11 <> 0 AND station_id % 13 <> 0)"""


@register("station_catalogue", with_views(f", {_STATIONS_SQL} SELECT * FROM cat", "v_stations"))
def station_catalogue(spark, sf_dir):
    """SRC10: JSON and XML catalogues united, rows with bad coordinates skipped."""
    return stations_read(spark, sf_dir).select("station_id", "name", "lat", "lon", "kind")


@register("catalogue_nearest", with_views(f""", {_STATIONS_SQL}
SELECT place_id, station_id, round(d, 6) AS distance_km FROM (
  SELECT p.place_id, s.station_id, {hav_sql('p', 's')} AS d,
         ROW_NUMBER() OVER (PARTITION BY p.place_id ORDER BY round({hav_sql('p', 's')}, 9), s.station_id) AS rn
  FROM v_places p, cat s) WHERE rn = 1""", "v_places", "v_stations"))
def catalogue_nearest(spark, sf_dir):
    """SRC10 J6: nearest station of the catalogues read."""
    r = spatial.nearest_station(v_places(spark, sf_dir), stations_read(spark, sf_dir))
    return r.select("place_id", "station_id", F.round("distance_km", 6).alias("distance_km"))


# -- SRC7: the feed's own form -------------------------------------------------------------------

FEED_ROWS = 20_000  # storms in one landed file: a file is one record, so one task reads it whole


def _land_feed(spark, sf_dir, path):
    """A day's fixes as feed records: snapshots of the storms seen that day, a file a snapshot."""
    p, n = v_points(spark, sf_dir), F.col("line_no")
    s = p.select(
        F.date_format("obs_time", "yyyy-MM-dd").alias("day"), n, F.concat(F.lit("al"), n.cast("string")).alias("id"),
        F.when(n % 5 > 0, F.concat(F.lit("S"), F.col("storm_id"))).alias("name"), F.col("status").alias("classification"),
        F.when(n % 6 == 0, "strong").otherwise(F.concat(F.col("max_wind_kt").cast("string"), F.lit(".9"))).alias("intensity"),
        F.col("min_pressure_mb").cast("string").alias("pressure"), F.col("lat").cast("string").alias("latitudeNumeric"),
        F.when(n % 9 == 0, "west").otherwise(F.col("lon").cast("string")).alias("longitudeNumeric"),
        F.when(n % 4 > 0, (n % 360).cast("string")).alias("movementDir"),
        F.when(n % 4 > 1, (n % 30).cast("string")).alias("movementSpeed"),
        F.when(n % 3 > 0, F.struct(F.concat(F.lit("https://example.org/"), n.cast("string")).alias("url"))).alias("publicAdvisory"))
    # a plain text in place of the object: written as JSON text, so both forms stand in one column
    one = F.to_json(F.struct(*[c for c in s.columns if c not in ("day", "line_no")]))
    one = F.when(n % 3 == 0, F.concat(F.substring(one, F.lit(1), F.length(one) - 1), F.lit(',"publicAdvisory":"none"}'))).otherwise(one)
    lines = s.select("day", n, one.alias("line"))
    # a day's storms stand in as many files as they need, at most about FEED_ROWS in each
    files = s.groupBy("day").agg(F.ceil(F.count(F.lit(1)) / FEED_ROWS).alias("files"))
    lines = lines.join(files, "day").withColumn("part", F.pmod(F.xxhash64("line_no"), F.col("files"))).drop("files")
    in_file = Window.partitionBy("day", "part")
    rows = lines.select("day", "part", n, "line", F.max("line_no").over(in_file).alias("last"), F.count(F.lit(1)).over(in_file).alias("rows"),
                        F.row_number().over(in_file.orderBy("line_no")).alias("at"))
    rows = rows.select("day", "part", n, F.concat(
        F.when(F.col("at") == 1, F.lit('{"activeStorms": [\n')).otherwise(""), F.col("line"), F.when(n < F.col("last"), F.lit(",")).otherwise(""),
        F.when(F.col("at") == F.col("rows"), F.lit("\n]}")).otherwise("")).alias("line")).sortWithinPartitions("day", "part", "line_no")
    rows.select("line", "day", "part").write.partitionBy("day", "part").text(path)


@register("active_storm_feed", with_views("""
SELECT 'al' || line_no AS storm_id, CASE WHEN line_no % 5 > 0 THEN 'S' || storm_id ELSE 'UNNAMED' END AS name,
       status AS classification, strftime(obs_time, '%Y-%m-%d') AS fetched_at,
       CASE WHEN line_no % 6 > 0 THEN max_wind_kt END AS intensity_kt, min_pressure_mb AS pressure_mb, lat,
       CASE WHEN line_no % 9 > 0 THEN lon END AS lon,
       trim(CASE WHEN line_no % 4 > 0 THEN (line_no % 360)::VARCHAR ELSE '' END || ' ' ||
            CASE WHEN line_no % 4 > 1 THEN (line_no % 30)::VARCHAR ELSE '' END || ' kt') AS movement,
       CASE WHEN line_no % 3 > 0 THEN 'https://example.org/' || line_no ELSE '' END AS advisory_url
FROM v_points""", "v_points"))
def active_storm_feed(spark, sf_dir):
    """SRC7: active storms read from the feed's own form, files by day."""
    path = scratch_path(spark, "feed")
    _land_feed(spark, sf_dir, path)
    return feeds.read_active_storms(spark, path, fetched_at=r"day=([0-9-]+)/")


# -- SRC8, SRC9: forecasts of customers' places, tides of suppliers' stations -----------------------

@register("forecast_periods", with_views("""
, f AS (SELECT place_id, lat, lon, place_id % 9 AS n,
               CASE WHEN place_id % 5 = 0 THEN printf('%.2f,%.2f', lat, lon) WHEN place_id % 5 = 1 THEN 'Town ' || place_id
                    ELSE 'Town ' || place_id || ', NC' END AS location,
               CASE WHEN place_id % 4 > 0 THEN 'O' || (place_id % 10) ELSE '' END AS office FROM v_places)
SELECT lat, lon, location, office, CAST(k AS INTEGER) AS "at", 'P' || k AS name, (60 + (place_id + k) % 30) || '°F' AS temp,
       'Sky ' || (k % 3) AS short, ((place_id + k) % 20) || ' mph ' || CASE WHEN k % 2 = 0 THEN 'NE' ELSE 'W' END AS wind,
       CASE WHEN k % 2 = 0 THEN 'i' || k ELSE '' END AS icon
FROM f, (SELECT unnest(range(9)) AS k) WHERE k < least(n, 6)""", "v_places"))
def forecast_periods(spark, sf_dir):
    """SRC8: the first six periods of every landed point forecast."""
    path, k = scratch_path(spark, "forecasts"), F.col("place_id")
    s = k.cast("string")

    def period(i):
        t = i.cast("string")
        return F.struct(F.concat(F.lit("P"), t).alias("name"), (F.lit(60) + (k + i) % 30).alias("temperature"),
                        F.lit("F").alias("temperatureUnit"), F.concat(F.lit("Sky "), (i % 3).cast("string")).alias("shortForecast"),
                        F.concat(((k + i) % 20).cast("string"), F.lit(" mph")).alias("windSpeed"),
                        F.when(i % 2 == 0, "NE").otherwise("W").alias("windDirection"),
                        F.when(i % 2 == 0, F.concat(F.lit("i"), t)).alias("icon"))

    periods = F.when(k % 9 > 0, F.transform(F.sequence(F.lit(0).cast("long"), k % 9 - 1), period))
    place = F.when(k % 5 > 0, F.struct(F.struct(F.concat(F.lit("Town "), s).alias("city"),
                                                F.when(k % 5 > 1, "NC").alias("state")).alias("properties")))
    answers = v_places(spark, sf_dir).select(
        "lat", "lon", F.struct(F.when(k % 4 > 0, F.concat(F.lit("O"), (k % 10).cast("string"))).alias("cwa"),
                               place.alias("relativeLocation")).alias("properties"),
        F.struct(F.struct(periods.alias("periods")).alias("properties")).alias("forecast"))
    answers.write.json(path)
    return feeds.forecast_periods(feeds.read_forecasts(spark, path))


@register("tide_predictions", with_views("""
SELECT 's' || station_id AS station, CAST(k AS INTEGER) AS "at", '2024-01-01 ' || lpad((6 * k)::VARCHAR, 2, '0') || ':00' AS time,
       CASE WHEN k % 2 = 0 THEN 'High' ELSE 'Low' END AS type,
       CASE WHEN (station_id + k) % 17 > 0 THEN round((station_id * 7 % 500 + k) / 100.0::DOUBLE, 1) END AS height_ft
FROM v_stations, (SELECT unnest(range(4)) AS k)""", "v_stations"))
def tide_predictions(spark, sf_dir):
    """SRC9: tide predictions of every station, unreadable heights as NULL."""
    path, k = scratch_path(spark, "tides"), F.col("station_id")

    def tide(i):
        v = F.when((k + i) % 17 == 0, "n/a").otherwise(((k * 7 % 500 + i) / F.lit(100.0)).cast("string"))
        return F.struct(F.concat(F.lit("2024-01-01 "), F.lpad((i * 6).cast("string"), 2, "0"), F.lit(":00")).alias("t"),
                        F.when(i % 2 == 0, "H").otherwise("L").alias("type"), v.alias("v"))

    v_stations(spark, sf_dir).select(
        F.concat(F.lit("s"), k.cast("string")).alias("station"),
        F.transform(F.sequence(F.lit(0), F.lit(3)), tide).alias("predictions")).write.json(path)
    return feeds.read_tides(spark, path)
