"""SRC1: best-track text files (header line + detail lines) -> storms and fixes.

The parse is distributed: each input split keeps its own line order
(file, split start, monotonically increasing id); a header is carried to the
following detail lines by a forward fill inside the split plus a small
per-split table that hands the last header of one split to the next.  No
global sort and no driver loop.  The writer (for landed copies and tests)
renders storms back into the same text layout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gtspark.functions.scalar import fix_time, missing_int, signed_coord

HEADER_RE = r"^[A-Z]{2}[0-9]{6},"
RADII = ["r34_ne", "r34_se", "r34_sw", "r34_nw", "r50_ne", "r50_se", "r50_sw", "r50_nw",
         "r64_ne", "r64_se", "r64_sw", "r64_nw"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"))
    return raw.filter(F.length(F.trim("value")) > 0)


def _owned(spark: SparkSession, path: str, continued: bool) -> DataFrame:
    """Lines with the header in force (_owner), by forward fill within a file.

    ``continued`` lets a file go on with the last storm of the file before, as
    the parts of one range-sorted write do.
    """
    ln = _lines(spark, path)
    is_hdr = F.col("value").rlike(HEADER_RE)
    key = F.struct("file", "block", "pos", F.trim(F.split("value", ",")[0]).alias("id"))
    ln = ln.withColumn("_hdr", F.when(is_hdr, key))
    # per split: its last header; then the header in force at each split start
    last_per_block = ln.groupBy("file", "block").agg(F.max("_hdr").alias("_last"))
    files = Window.orderBy("file", "block") if continued else Window.partitionBy("file").orderBy("block")
    carry_w = files.rowsBetween(Window.unboundedPreceding, -1)
    carry = last_per_block.select("file", "block",
                                  F.last("_last", ignorenulls=True).over(carry_w).alias("_carry"))
    fill_w = (Window.partitionBy("file", "block").orderBy("pos")
              .rowsBetween(Window.unboundedPreceding, 0))
    return (ln.join(carry, ["file", "block"])  # one row per split
            .withColumn("_owner", F.coalesce(F.last("_hdr", ignorenulls=True).over(fill_w), F.col("_carry"))))


def orphan_lines(spark: SparkSession, path: str, continued: bool = False) -> DataFrame:
    """Detail lines that no header owns: (file, value)."""
    ln = _owned(spark, path, continued)
    return ln.filter(F.col("_owner").isNull()).select("file", "value")


def read_hurdat2(spark: SparkSession, path: str, continued: bool = False) -> tuple[DataFrame, DataFrame]:
    """Return (storms, points).

    storms: storm_key (position of the header line), storm_id, basin,
    cyclone_number, year, name (empty -> UNNAMED), n_track_points.
    points: storm_key, storm_id, line_no (sortable file position), obs_time, record_id,
    status, lat, lon, max_wind_kt, min_pressure_mb, 12 radii, rmw_nm.
    """
    filled = _owned(spark, path, continued)
    f = F.split(F.col("value"), ",")
    tok = lambda i: F.trim(F.try_element_at(f, F.lit(i + 1)))
    storm_key = F.concat_ws(":", F.col("_owner.file"), F.col("_owner.block").cast("string"),
                            F.col("_owner.pos").cast("string"))
    headers = filled.filter(F.col("_hdr").isNotNull())
    storms = headers.select(
        storm_key.alias("storm_key"),
        tok(0).alias("storm_id"),
        F.substring(tok(0), 1, 2).alias("basin"),
        F.substring(tok(0), 3, 2).try_cast("int").alias("cyclone_number"),
        F.substring(tok(0), 5, 4).try_cast("int").alias("year"),
        F.coalesce(F.nullif(tok(1), F.lit("")), F.lit("UNNAMED")).alias("name"),
        tok(2).try_cast("int").alias("n_track_points"))
    details = filled.filter(F.col("_hdr").isNull() & F.col("_owner").isNotNull())
    line_no = F.concat_ws(":", F.col("file"), F.col("block").cast("string"), F.col("pos").cast("string"))
    points = details.select(
        storm_key.alias("storm_key"), F.col("_owner.id").alias("storm_id"),
        line_no.alias("line_key"), F.struct("file", "block", "pos").alias("line_no"),
        fix_time(tok(0), tok(1)).alias("obs_time"),
        F.nullif(tok(2), F.lit("")).alias("record_id"),
        tok(3).alias("status"),
        signed_coord(tok(4)).alias("lat"),
        signed_coord(tok(5)).alias("lon"),
        missing_int(tok(6)).alias("max_wind_kt"),
        missing_int(tok(7)).alias("min_pressure_mb"),
        *[missing_int(tok(8 + i)).alias(r) for i, r in enumerate(RADII)],
        missing_int(tok(20)).alias("rmw_nm"))
    return storms, points


def count_check(storms: DataFrame, points: DataFrame) -> DataFrame:
    """Quality check: detail lines found vs the count each header declares."""
    n = points.groupBy("storm_key").agg(F.count(F.lit(1)).alias("n_found"))
    return (storms.join(n, "storm_key", "left")
            .select("storm_key", "storm_id", "n_track_points",
                    F.coalesce("n_found", F.lit(0)).alias("n_found"))
            .withColumn("ok", F.col("n_found") == F.col("n_track_points")))


def _fmt_coord(c, pos: str, neg: str):
    return F.when(c < 0, F.format_string(f"%.1f{neg}", -c)).otherwise(F.format_string(f"%.1f{pos}", c))


def _fmt_int(c, missing="-999"):
    return F.coalesce(c.cast("string"), F.lit(missing))


def write_hurdat2(storms: DataFrame, points: DataFrame, path: str) -> None:
    """Render storms (storm_id, name, sort key) and their fixes as best-track text.

    ``points`` needs storm_id, line_no, obs_time, record_id, status, lat,
    lon, max_wind_kt, min_pressure_mb and optionally the radii and rmw.
    The output is range-sorted by (storm, line), so a storm's header
    precedes its fixes even when the storm spans two files.
    """
    cnt = points.groupBy("storm_id").agg(F.count(F.lit(1)).alias("_n"))
    hdr = (storms.join(cnt, "storm_id")
           .select("storm_id", F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_ln"),
                   F.format_string("%s, %s, %d,", F.col("code"), F.coalesce("name", F.lit("")),
                                   F.col("_n")).alias("value")))
    radii = [_fmt_int(F.col(r)) if r in points.columns else F.lit("-999") for r in RADII]
    rmw = _fmt_int(F.col("rmw_nm"), "") if "rmw_nm" in points.columns else F.lit("")
    det = points.select(
        "storm_id", F.lit(1).alias("_kind"), F.col("line_no").cast("bigint").alias("_ln"),
        F.concat_ws(", ", F.date_format("obs_time", "yyyyMMdd"), F.date_format("obs_time", "HHmm"),
                    F.coalesce("record_id", F.lit("")), F.col("status"),
                    _fmt_coord(F.col("lat"), "N", "S"), _fmt_coord(F.col("lon"), "E", "W"),
                    _fmt_int(F.col("max_wind_kt"), "-99"), _fmt_int(F.col("min_pressure_mb")),
                    *radii, rmw).alias("value"))
    (hdr.unionByName(det).orderBy("storm_id", "_kind", "_ln").select("value")
     .write.mode("overwrite").text(path))
