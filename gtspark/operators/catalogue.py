"""Storm catalogue: region filter, cards, notable-first quota, track fields.

A14 O1 O2 F2 F3 P16 P17 SNK9.  Cards are one aggregation per storm; the
track stays a long table keyed by (storm_id, seq) and is only nested into an
array on export, where a storm's track is written as its own record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gtspark import config as C
from gtspark.functions.scalar import in_box, saffir_simpson, title_name
from gtspark.operators.marts import range_prefix


def region_storms(storms: DataFrame, points: DataFrame, box=C.CAROLINA_BOX) -> DataFrame:
    """storms with any fix inside the box (left-semi on the distinct hit keys)."""
    hits = points.filter(in_box("lat", "lon", box)).select("storm_id").distinct()
    return storms.join(hits, "storm_id", "left_semi")


def track_rows(points: DataFrame) -> DataFrame:
    """Card track fields for fixes with wind, numbered in time order.

    lat/lon rounded to 1, time as 'yyyy-MM-dd HHZ', landfall flag, category,
    label (TS or C1..C5) and hours since the first fix (index x 6).  Fixes are
    numbered over range-sorted parts and counted from their storm's first
    number, so a storm of any length is many tasks.
    """
    p = points.filter(F.col("max_wind_kt").isNotNull())
    p = range_prefix(p, ["storm_id", "obs_time", "line_no"], seq="_seq")
    first = p.groupBy(F.col("storm_id").alias("_of")).agg(F.min("_seq").alias("_first"))
    p = p.join(first, F.col("storm_id").eqNullSafe(F.col("_of")))
    seq = (F.col("_seq") - F.col("_first")).cast("int")
    cat = saffir_simpson("max_wind_kt")
    return p.select(
        "storm_id",
        seq.alias("seq"),
        F.round("lat", 1).alias("lat"), F.round("lon", 1).alias("lon"),
        F.col("max_wind_kt").alias("wind"), F.col("min_pressure_mb").alias("pres"),
        cat.alias("cat"),
        F.date_format("obs_time", "yyyy-MM-dd HH'Z'").alias("time"),
        F.coalesce(F.col("record_id") == "L", F.lit(False)).alias("landfall"),
        F.when(cat == 0, F.lit("TS")).otherwise(F.concat(F.lit("C"), cat.cast("string"))).alias("label"),
        (seq * 6).alias("hours"),
    )


def storm_cards(storms: DataFrame, points: DataFrame, nc_box=C.NC_BOX) -> DataFrame:
    """One card per storm that has at least one fix with wind.

    peak wind and category, lowest non-NULL pressure, category of the first
    landfall inside the NC box (tested on the rounded card coordinates) and
    the number of track fixes.  One partial+final aggregate per storm.
    """
    p = points.filter(F.col("max_wind_kt").isNotNull())
    lf = (F.col("record_id") == "L") & in_box(F.round("lat", 1), F.round("lon", 1), nc_box)
    cat = saffir_simpson("max_wind_kt")
    agg = p.groupBy("storm_id").agg(
        F.max("max_wind_kt").alias("peak_wind"),
        F.min("min_pressure_mb").alias("min_pres"),
        F.max(cat).alias("peak_cat"),
        F.min_by(cat, F.when(lf, F.struct("obs_time", "line_no"))).alias("landfall_cat"),
        F.count(F.lit(1)).alias("n_track"))
    return (storms.join(agg, "storm_id")
            .select(F.col("storm_id").alias("id"), title_name("name").alias("name"), "year",
                    "peak_wind", "min_pres", "peak_cat", "landfall_cat", "n_track"))


def notable_quota(storms: DataFrame, max_storms: int = C.CATALOGUE_MAX,
                  notable=C.NOTABLE_NAMES) -> DataFrame:
    """O1: notable names always kept; the newest others fill up to ``max_storms``.

    The quota left for the others depends on how many notables there are:
    one scalar count, then a top-N (``orderBy().limit()`` plans a
    per-partition top-N and a small merge).  Result is year desc.
    """
    is_notable = F.upper(F.col("name")).isin(*notable)
    keep = storms.filter(is_notable)
    n_notable = keep.count()
    rest = (storms.filter(~is_notable | F.col("name").isNull())
            .orderBy(F.col("year").desc(), F.col("storm_id"))
            .limit(max(0, max_storms - n_notable)))
    return keep.unionByName(rest).orderBy(F.col("year").desc(), "storm_id")


def filter_catalogue(cards: DataFrame, year_min=None, year_max=None, min_cat=0,
                     name_contains: str | None = None) -> DataFrame:
    """optional year bounds, minimum peak category, case-insensitive name match."""
    cond = F.col("peak_cat") >= F.lit(min_cat)
    if year_min is not None:
        cond &= F.col("year") >= F.lit(year_min)
    if year_max is not None:
        cond &= F.col("year") <= F.lit(year_max)
    if name_contains:
        cond &= F.lower("name").contains(name_contains.strip().lower())
    return cards.filter(cond)


TRACK_FIELDS = ("seq", "lat", "lon", "wind", "pres", "cat", "time", "landfall")
CARD_FIXES = 1000        # fixes in one exported record; a longer track goes on in further records


def export_cards(cards: DataFrame, tracks: DataFrame, path: str, mode: str = "overwrite", fixes: int = CARD_FIXES) -> None:
    """SNK9: JSON cards with nested tracks, partitioned by nothing, one record per storm and ``fixes`` fixes.

    ``part`` numbers a storm's records; ``seq`` is dense (``track_rows``), so a
    record's fixes are found by division and no storm is ever one row.  A storm
    without fixes has one record with an empty track.
    """
    fix = F.struct(*TRACK_FIELDS)
    nested = (tracks.withColumn("part", F.floor(F.col("seq") / fixes).cast("int")).groupBy("storm_id", "part")
              .agg(F.array_sort(F.collect_list(fix)).alias("track")))
    out = (cards.join(nested, cards.id == nested.storm_id, "left").drop("storm_id")
           .withColumn("part", F.coalesce("part", F.lit(0))).withColumn("track", F.coalesce("track", F.array())))
    out.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_cards(spark, path: str) -> DataFrame:
    """Exported records, all types as exported."""
    return spark.read.schema(
        "id string, name string, year int, peak_wind int, min_pres int, peak_cat int, landfall_cat int, n_track long, part int, "
        "track array<struct<seq: int, lat: double, lon: double, wind: int, pres: int, cat: int, time: string, landfall: boolean>>"
    ).json(path)


def whole_tracks(records: DataFrame) -> DataFrame:
    """The long table behind exported records, for tracks of any length."""
    return records.select(F.col("id").alias("storm_id"), F.inline("track"))
