"""ST1 / ST2: active-storm snapshots as a file stream.

Snapshot files land in a folder (one JSON object per snapshot); the stream
explodes each snapshot's storm list, keys rows by event time ``fetched_at``,
drops redelivered (storm, fetched_at) rows within the watermark and appends
to a parquet table.  ``availableNow`` drains what has landed and stops, so
the same job serves scheduled batch runs; checkpoints live in the shared
folder, so a restarted job resumes exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

STORM = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("classification", T.StringType()), T.StructField("intensity_kt", T.StringType()),
    T.StructField("lat", T.StringType()), T.StructField("lon", T.StringType()),
    T.StructField("movement", T.StringType()), T.StructField("pressure_mb", T.StringType()),
])
SNAPSHOT = T.StructType([
    T.StructField("fetched_at", T.StringType()),
    T.StructField("active_storm_count", T.LongType()),
    T.StructField("storms", T.ArrayType(STORM)),
])


def snapshot_rows(snapshots: DataFrame) -> DataFrame:
    """SRC7: one row per storm of each snapshot, safe numeric casts, UNNAMED default."""
    s = snapshots.select("fetched_at", F.explode("storms").alias("s"))
    to_int = lambda c: F.col(c).try_cast("double").try_cast("int")  # noqa: E731  int(float(v))
    return s.select(
        F.col("s.id").alias("storm_id"),
        F.coalesce(F.nullif(F.col("s.name"), F.lit("")), F.lit("UNNAMED")).alias("name"),
        F.col("s.classification").alias("classification"),
        "fetched_at",
        to_int("s.intensity_kt").alias("intensity_kt"),
        to_int("s.pressure_mb").alias("pressure_mb"),
        F.col("s.lat").try_cast("double").alias("lat"),
        F.col("s.lon").try_cast("double").alias("lon"),
        F.col("s.movement").alias("movement"))


def deduplicated(snapshots: DataFrame, watermark: str) -> DataFrame:
    """Storm rows with their event time, once each; rows later than the watermark go."""
    return (snapshot_rows(snapshots)
            .withColumn("event_time", F.to_timestamp("fetched_at"))
            .withWatermark("event_time", watermark)
            .dropDuplicatesWithinWatermark(["storm_id", "fetched_at"]))


def advisory_stream(spark: SparkSession, landing: str, sink: str, checkpoint: str,
                    watermark: str = "6 hours") -> None:
    """ST1: drain landed snapshots into the deduplicated advisory table."""
    rows = deduplicated(spark.readStream.schema(SNAPSHOT).json(landing), watermark)
    q = (rows.writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def write_snapshots(storms: DataFrame, path: str, parts: int | None = None) -> None:
    """SNK8: one JSON record per ``fetched_at`` with its storm count and storms.

    ``storms`` has fetched_at and the fields of ``STORM``.  A record is never
    one row: its opening, storms and closing are rows sorted by range, which the
    text writer lays end to end with a blank between (JSON ignores it), so a
    snapshot with very many storms only makes a long line.  Storms are ordered by id, then by their text.
    """
    line = F.to_json(F.struct(*[f.name for f in STORM.fields]))
    body = storms.select("fetched_at", F.coalesce("id", F.lit("")).alias("id"), line.alias("line"))
    per = body.groupBy("fetched_at").agg(F.count(F.lit(1)).alias("n"))
    opening = F.concat(F.regexp_replace(F.to_json(F.struct("fetched_at")), r"\}\z", ""), F.lit(',"active_storm_count":'),
                       F.col("n").cast("string"), F.lit(',"storms":['))
    blank = F.lit("")
    rows = (body.select("fetched_at", F.lit(1).alias("o"), "id", F.concat(F.lit(","), "line").alias("line"))
            .unionByName(per.select("fetched_at", F.lit(0).alias("o"), blank.alias("id"), opening.alias("line")))
            .unionByName(per.select("fetched_at", F.lit(2).alias("o"), blank.alias("id"), F.lit("]}\n").alias("line"))))
    rows = rows.repartitionByRange(parts, "fetched_at") if parts else rows.repartitionByRange("fetched_at")
    rows = rows.sortWithinPartitions("fetched_at", "o", "id", "line")
    # the comma before a record's first storm goes: it follows the opening
    before = F.lag("o").over(Window.partitionBy("fetched_at").orderBy("o", "id", "line"))
    rows = rows.withColumn("line", F.when((F.col("o") == 1) & (before == 0), F.substring("line", 2, 1 << 30)).otherwise(F.col("line")))
    rows.select("line").write.mode("overwrite").option("lineSep", " ").text(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The landed snapshots, their counts as written."""
    return spark.read.schema(SNAPSHOT).json(path)


def recent_tracks(history: DataFrame) -> DataFrame:
    """ST2 input: the advisory history as track fixes (wind, pressure, position)."""
    return history.select("storm_id", F.col("event_time").alias("obs_time"),
                          F.unix_micros("event_time").alias("line_no"),
                          F.col("intensity_kt").alias("max_wind_kt"),
                          F.col("pressure_mb").alias("min_pressure_mb"), "lat", "lon")
