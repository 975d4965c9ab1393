"""Landed copies of the live feeds: active storms, forecasts, tides, station catalogues.

SRC7-SRC10.  Each reader takes a path Spark can list and declares its schema;
optional objects and wrong types give NULL or the stated default, never an
error.  Records that are no JSON or XML at all come back in ``_corrupt`` of the
``*_raw`` frames and in no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt string"
FORECAST_PERIODS = 6


def _text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def whole_number(c) -> Column:
    """int(float(v)): cut towards zero, unreadable -> NULL."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("double").try_cast("int")


# -- SRC7 active storms ------------------------------------------------------------------------

FEED_STORM = ("id string, name string, classification string, intensity string, pressure string, "
              "latitudeNumeric string, longitudeNumeric string, movementDir string, movementSpeed string, "
              "publicAdvisory variant")


def read_active_storms(spark: SparkSession, path, fetched_at: str = r"([^/]+)\.json$") -> DataFrame:
    """One row per active storm of each landed feed file, in the snapshot's fields.

    ``fetched_at`` takes the fetch time from the file's path.  ``movement`` is
    "direction speed kt"; ``advisory_url`` is the advisory's url if that is an
    object, else empty (read as a variant: for an object asked for as a string
    the JSON reader goes back to the file and reads its place again).
    """
    raw = (spark.read.schema(f"activeStorms array<struct<{_typed(FEED_STORM)}>>, {CORRUPT}")
           .option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path))
    when = F.regexp_extract(F.col("_metadata.file_path"), fetched_at, 1)
    s = raw.select(when.alias("fetched_at"), F.explode("activeStorms").alias("s")).filter("s IS NOT NULL")
    advisory = F.try_variant_get(F.col("s.publicAdvisory"), "$", "string")
    url = F.when(F.ltrim(advisory).startswith("{"), F.get_json_object(advisory, "$.url"))
    return s.select(
        _text("s.id").alias("storm_id"), F.coalesce("s.name", F.lit("UNNAMED")).alias("name"),
        _text("s.classification").alias("classification"), "fetched_at",
        whole_number("s.intensity").alias("intensity_kt"), whole_number("s.pressure").alias("pressure_mb"),
        F.col("s.latitudeNumeric").try_cast("double").alias("lat"),
        F.col("s.longitudeNumeric").try_cast("double").alias("lon"),
        F.trim(F.concat(_text("s.movementDir"), F.lit(" "), _text("s.movementSpeed"), F.lit(" kt"))).alias("movement"),
        _text(url).alias("advisory_url"))


def _typed(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (f.split() for f in ddl.split(", ")))


# -- SRC8 point forecast -----------------------------------------------------------------------

_PERIOD = ("name string, temperature string, temperatureUnit string, shortForecast string, windSpeed string, "
           "windDirection string, icon string")


def read_forecasts(spark: SparkSession, path, periods: int = FORECAST_PERIODS) -> DataFrame:
    """lat, lon, location, office and the first ``periods`` forecast periods of each landed answer.

    An answer holds the point (its metadata) and the forecast's properties; the
    label falls back to "lat,lon" with two decimals.
    """
    raw = (spark.read.schema(
        "lat double, lon double, properties struct<cwa: string, relativeLocation: struct<properties: "
        f"struct<city: string, state: string>>>, forecast struct<properties: struct<periods: array<struct<{_typed(_PERIOD)}>>>>, "
        f"{CORRUPT}").option("columnNameOfCorruptRecord", "_corrupt").json(path))
    rel = "properties.relativeLocation.properties."
    city = F.regexp_replace(F.concat(_text(rel + "city"), F.lit(", "), _text(rel + "state")), r"^[, ]+|[, ]+$", "")
    first = F.slice(F.coalesce("forecast.properties.periods", F.array()), 1, periods)
    shown = F.transform(first, lambda p: F.struct(
        p["name"].alias("name"), F.concat(p["temperature"], F.lit("°"), p["temperatureUnit"]).alias("temp"),
        p["shortForecast"].alias("short"), F.concat(p["windSpeed"], F.lit(" "), p["windDirection"]).alias("wind"),
        _text(p["icon"]).alias("icon")))
    label = F.when(city != "", city).otherwise(F.format_string("%.2f,%.2f", "lat", "lon"))
    return raw.filter("_corrupt IS NULL").select("lat", "lon", label.alias("location"),
                                                 _text("properties.cwa").alias("office"), shown.alias("periods"))


def forecast_periods(forecasts: DataFrame) -> DataFrame:
    """One row per shown period."""
    return forecasts.select("lat", "lon", "location", "office", F.posexplode("periods").alias("at", "p")).select(
        "lat", "lon", "location", "office", "at", "p.*")


# -- SRC9 tide predictions ---------------------------------------------------------------------

def read_tides(spark: SparkSession, path) -> DataFrame:
    """One row per predicted tide: station, time, High or Low, height to one decimal."""
    raw = (spark.read.schema(f"station string, predictions array<struct<t: string, type: string, v: string>>, {CORRUPT}")
           .option("columnNameOfCorruptRecord", "_corrupt").json(path))
    p = raw.select("station", F.posexplode("predictions").alias("at", "p"))
    return p.select("station", "at", F.col("p.t").alias("time"),
                    F.when(F.col("p.type") == "H", "High").otherwise("Low").alias("type"),
                    F.round(F.col("p.v").try_cast("double"), 1).alias("height_ft"))


# -- SRC10 station catalogues ------------------------------------------------------------------

def _stations(df: DataFrame, lat: str, lon: str, kind: str) -> DataFrame:
    """Rows with usable coordinates."""
    la, lo = F.col(lat).try_cast("double"), F.col(lon).try_cast("double")
    ok = la.between(-90, 90) & lo.between(-180, 180)
    return df.filter(F.col("id").isNotNull() & ok).select(
        F.lit(kind).alias("kind"), F.col("id").alias("station_id"), "name", la.alias("lat"), lo.alias("lon"))


def tide_stations_raw(spark: SparkSession, path) -> DataFrame:
    return (spark.read.schema(f"stations array<struct<id: string, name: string, lat: string, lng: string>>, {CORRUPT}")
            .option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path))


def read_tide_stations(spark: SparkSession, path) -> DataFrame:
    """A JSON catalogue: {"stations": [{id, name, lat, lng}, ...]} per file."""
    return _stations(tide_stations_raw(spark, path).select(F.explode("stations").alias("s")).select("s.*"), "lat", "lng", "tide")


def buoy_stations_raw(spark: SparkSession, path) -> DataFrame:
    """One row per <station .../> element, its attributes as columns."""
    return (spark.read.format("xml").schema(f"_id string, _name string, _lat string, _lon string, {CORRUPT}")
            .options(rowTag="station", attributePrefix="_", columnNameOfCorruptRecord="_corrupt", mode="PERMISSIVE").load(path))


def read_buoy_stations(spark: SparkSession, path) -> DataFrame:
    """An XML catalogue of station elements with id, name, lat and lon attributes."""
    raw = buoy_stations_raw(spark, path).filter("_corrupt IS NULL")
    return _stations(raw.select(F.col("_id").alias("id"), F.col("_name").alias("name"), F.col("_lat").alias("lat"),
                                F.col("_lon").alias("lon")), "lat", "lon", "buoy")


def station_catalogue(tides: DataFrame, buoys: DataFrame) -> DataFrame:
    """Both catalogues in one table; an id that both hold stays once, as the tide station."""
    both = tides.unionByName(buoys)
    best = both.groupBy("station_id").agg(F.min_by(F.struct("kind", "name", "lat", "lon"),
                                                   F.struct(F.col("kind") != "tide", "lat", "lon")).alias("s"))
    return best.select("station_id", "s.*")
