"""Readers of the flat sources: event CSV, product JSON, buoy files, eval cases, run logs.

SRC2-SRC6 SRC11 SRC12 P7 P8 W9.  Every reader takes a path (or list of paths)
that Spark can list, declares its schema and infers nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gtspark import config as C
from gtspark.functions import text as X
from gtspark.functions.scalar import celsius_to_fahrenheit, metres_to_feet, missing_double
from gtspark.sources.sinks import PACK_END

EVENT_FIELDS = ("EVENT_ID", "EPISODE_ID", "STORM_ID", "STATE", "YEAR", "EVENT_TYPE", "BEGIN_DATE_TIME", "CZ_NAME",
                "DAMAGE_PROPERTY", "DEATHS_DIRECT", "EPISODE_NARRATIVE", "EVENT_NARRATIVE")
BUOY_VALUES = ("wind_speed_ms", "gust_ms", "pressure_mb", "air_temp_c", "water_temp_c", "wave_height_m")
PRODUCT_FIELDS = ("product_id", "product_type", "office", "issuance_time", "text")
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "enforceSchema": False,
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
REALTIME_VALUES = {"wave_height_ft": (8, metres_to_feet), "dominant_period_s": (9, lambda c: c),
                   "water_temp_f": (14, celsius_to_fahrenheit)}


def _strings(names) -> str:
    return ", ".join(f"`{n}` string" for n in names)


def event_document(df: DataFrame):
    """P7: "type in zone, state (when)." and the stripped narratives on lines of their own; empty parts drop."""
    e = [F.coalesce(F.col(c), F.lit("")) for c in ("event_type", "cz_name", "state", "begin_datetime")]
    first = F.format_string("%s in %s, %s (%s).", *e)
    rest = [F.nullif(X.strip(F.coalesce(F.col(c), F.lit(""))), F.lit("")) for c in ("episode_narrative", "event_narrative")]
    return F.concat_ws("\n", first, *rest)


def read_storm_events(spark: SparkSession, path) -> DataFrame:
    """SRC2: event rows with their document; empty optional ids are NULL, deaths only if all digits."""
    raw = spark.read.schema(_strings(EVENT_FIELDS)).options(**CSV_OPTIONS).csv(path)
    optional = {"EPISODE_ID", "STORM_ID", "DAMAGE_PROPERTY"}
    names = {"BEGIN_DATE_TIME": "begin_datetime"}
    cols = []
    for f in EVENT_FIELDS:
        c = F.col(f)
        if f == "YEAR":
            c = F.trim(c).try_cast("int")
        elif f == "DEATHS_DIRECT":
            c = F.when(F.trim(c).rlike("^[0-9]+$"), F.trim(c).try_cast("int"))
        elif f in optional:
            c = F.nullif(c, F.lit(""))
        else:
            c = F.coalesce(c, F.lit(""))
        cols.append(c.alias(names.get(f, f.lower())))
    out = raw.select(*cols, F.col("_metadata.file_path").alias("_file"))
    return out.withColumn("document", event_document(out))


def read_bulk_events(spark: SparkSession, paths) -> DataFrame:
    """SRC3: yearly files (compressed or not) with source file and ingest time."""
    return (read_storm_events(spark, paths).withColumnRenamed("_file", "_source_file")
            .withColumn("_ingest_ts", F.current_timestamp()))


def read_text_products(spark: SparkSession, path) -> DataFrame:
    """SRC4 + P8: a JSON array of products per file; the document is the stripped text."""
    raw = spark.read.schema(_strings(PRODUCT_FIELDS)).option("multiLine", True).json(path)
    return raw.withColumn("document", X.strip(F.coalesce(F.col("text"), F.lit(""))))


def read_buoys(spark: SparkSession, path) -> DataFrame:
    """SRC5: observations, sentinel codes and unreadable numbers as NULL."""
    raw = spark.read.schema(_strings(("station", "obs_time", *BUOY_VALUES))).options(**CSV_OPTIONS).csv(path)
    return raw.select("station", "obs_time", *[missing_double(c).alias(c) for c in BUOY_VALUES])


def _file_lines(spark: SparkSession, path) -> DataFrame:
    """(file, block, pos, value): the lines of text files, in order within a file."""
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"))


def _packed_lines(spark: SparkSession, path) -> DataFrame:
    """The same of the files in packs (``sinks.pack_files``)."""
    files = spark.read.option("lineSep", PACK_END).text(path)
    lines = files.select(F.posexplode(F.split("value", "\r\n|\r|\n")).alias("pos", "line"),
                         F.substring_index("value", "\n", 1).alias("file")).filter(F.col("pos") > 0)
    return lines.select(F.col("line").alias("value"), "file", F.lit(0).alias("block"), "pos")


def read_buoy_realtime(spark: SparkSession, path, station: str = r"/([^/.]+)\.[^/]*$", packed: bool = False) -> DataFrame:
    """SRC6 + W9 + P12: the newest observation of each station's file, in feet, seconds and Fahrenheit.

    ``station`` takes the station from the file's path (its name up to the
    dot); the newest line is the first that is neither blank nor a comment.
    ``packed``: the stations' files lie in packs, many to a stored file.
    """
    lines = ((_packed_lines if packed else _file_lines)(spark, path)
             .filter((F.length("value") > 0) & ~F.col("value").startswith("#")))
    newest = lines.groupBy("file").agg(F.min_by("value", F.struct("block", "pos")).alias("value"))
    cols = F.split(F.regexp_replace("value", r"^\s+", ""), r"\s+")

    def value(i, convert):
        token = F.try_element_at(cols, F.lit(i + 1))
        return convert(F.when(~token.isin(*C.REALTIME_MISSING), token.try_cast("double")))

    return newest.select(F.upper(F.regexp_extract("file", station, 1)).alias("station"),
                         *[value(i, f).alias(n) for n, (i, f) in REALTIME_VALUES.items()])


def read_eval_cases(spark: SparkSession, path) -> DataFrame:
    """SRC11: one case per non-blank line."""
    return (spark.read.schema("question_id string, storm_id string, question string").json(path)
            .filter(F.coalesce("question_id", "storm_id", "question").isNotNull()))


def read_run_log(spark: SparkSession, path, params: list[str]) -> DataFrame:
    """SRC12: one row per run, the named parameters as columns and three metrics to three places."""
    raw = spark.read.schema("run_id string, model string, ts string, params map<string,string>, "
                            "metrics map<string,double>").json(path)
    kept = ("mean_groundedness", "hallucination_rate", "p50_latency_ms")
    return raw.filter(F.col("run_id").isNotNull()).select(
        "model", "run_id", *[F.col("params").getItem(p).alias(p) for p in params],
        *[F.round(F.col("metrics").getItem(m), 3).alias(m) for m in kept])
