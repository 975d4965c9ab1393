"""ST2: live landfall estimates from the advisory stream, with state per storm.

Every micro-batch folds its new advisories into one state row per storm (count,
peak, first and last five fixes), which is all that the model's features need;
folding is associative and does not depend on the order of arrival.  A batch
reads the newest complete state below its own id and writes its state and
estimates under that id, so a batch that is run again after a crash or a
restart overwrites its own output and nothing else.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gtspark import config as C
from gtspark.operators import forecast
from gtspark.streaming import advisories

KEPT = 5             # last fixes of a storm
STATE = ("storm_id string, n_pre long, peak_wind int, first struct<at: timestamp, wind: int>, "
         "last array<struct<at: timestamp, wind: int, pres: int, lat: double, lon: double>>")


def batch_state(fixes: DataFrame) -> DataFrame:
    """State of the storms of some advisories; fixes without a wind do not count.

    The last fixes come from a limited row number, so a task forwards at most
    five rows a storm however many it holds.
    """
    use = fixes.filter(F.col("intensity_kt").isNotNull())
    fix = F.struct(F.col("event_time").alias("at"), F.col("intensity_kt").alias("wind"), F.col("pressure_mb").alias("pres"),
                   "lat", "lon")
    rank = F.row_number().over(Window.partitionBy("storm_id").orderBy(
        F.col("event_time").desc(), F.col("intensity_kt").desc(), F.col("lat"), F.col("lon")))
    last = (use.withColumn("_r", rank).filter(F.col("_r") <= KEPT).groupBy("storm_id")
            .agg(F.sort_array(F.collect_list(fix), asc=False).alias("last")))
    total = use.groupBy("storm_id").agg(
        F.count(F.lit(1)).alias("n_pre"), F.max("intensity_kt").alias("peak_wind"),
        F.min(F.struct(F.col("event_time").alias("at"), F.col("intensity_kt").alias("wind"))).alias("first"))
    return total.join(last, "storm_id")


def fold(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both states as one: at most one row a storm on either side."""
    both = old.unionByName(new).groupBy("storm_id").agg(
        F.sum("n_pre").alias("n_pre"), F.max("peak_wind").alias("peak_wind"), F.min("first").alias("first"),
        F.slice(F.sort_array(F.flatten(F.collect_list("last")), asc=False), 1, KEPT).alias("last"))
    return both


def state_features(state: DataFrame, key: str = "storm_id") -> DataFrame:
    """M2 of every storm with four fixes or more, from its state."""
    fix = lambda i: F.col("last")[i]
    ago = F.when(F.col("n_pre") >= KEPT, fix(KEPT - 1)["wind"]).otherwise(F.col("first.wind"))
    return state.filter(F.col("n_pre") >= forecast.LEAST_FIXES).select(
        key, fix(0)["wind"].cast("double").alias("wind_pre"),
        F.coalesce(F.nullif(fix(0)["pres"], F.lit(0)).cast("double"), F.lit(1010.0)).alias("pres_pre"),
        F.col("peak_wind").cast("double").alias("peak_wind"), (fix(0)["wind"] - ago).cast("double").alias("intens_24h"),
        fix(0)["lat"].alias("lat_pre"),
        (F.abs(fix(0)["lat"] - fix(1)["lat"]) + F.abs(fix(0)["lon"] - fix(1)["lon"])).alias("fwd_speed"), "n_pre")


def estimates(state: DataFrame, model: PipelineModel | None = None) -> DataFrame:
    """M5 + M6 of every storm: category and confidence (with a model), basis text and disclaimer."""
    feats = state_features(state)
    scored = forecast.predict(model, feats) if model is not None else feats.withColumn("basis", forecast.basis_text())
    out = state.select("storm_id", F.col("n_pre").alias("n_fixes")).join(scored.drop("n_pre"), "storm_id", "left")
    return (out.withColumn("basis", F.coalesce("basis", F.lit(C.INSUFFICIENT_TRACK_TEXT)))
            .withColumn("disclaimer", F.lit(C.LIVE_DISCLAIMER)))


class BatchTables:
    """Versions of a table by batch id under one folder; a version counts once its write is complete."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> list[int]:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("batch=")]
        return sorted(int(p.getName()[6:]) for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def write(self, df: DataFrame, batch: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/batch={batch}")

    def read(self, schema, below: int | None = None) -> DataFrame:
        """The newest version (below a batch id); empty where there is none."""
        own = [v for v in self.versions() if below is None or v < below]
        if not own:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/batch={own[-1]}")


def update(spark: SparkSession, fixes: DataFrame, batch: int, root: str, model: PipelineModel | None) -> None:
    """One micro-batch: fold its fixes into the state before it, write state and estimates under its id."""
    states, out = BatchTables(spark, f"{root}/state"), BatchTables(spark, f"{root}/estimates")
    state = states.write(fold(states.read(STATE, below=batch), batch_state(fixes)), batch)
    out.write(estimates(state, model), batch)


def estimate_stream(spark: SparkSession, landing: str, root: str, model: PipelineModel | None = None,
                    watermark: str = "6 hours", per_batch: int | None = None) -> None:
    """Drain landed snapshots into the per-storm state and estimates under ``root``; can be stopped and run again."""
    src = spark.readStream.schema(advisories.SNAPSHOT)
    if per_batch:
        src = src.option("maxFilesPerTrigger", per_batch)
    rows = advisories.deduplicated(src.json(landing), watermark)
    q = (rows.writeStream.foreachBatch(lambda df, batch: update(df.sparkSession, df, batch, root, model))
         .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()


def current_estimates(spark: SparkSession, root: str) -> DataFrame:
    """The newest estimates of all storms seen so far."""
    own = BatchTables(spark, f"{root}/estimates").versions()
    if not own:
        raise ValueError(f"no batch was completed under {root}")
    return spark.read.parquet(f"{root}/estimates/batch={own[-1]}")


def current_state(spark: SparkSession, root: str) -> DataFrame:
    return BatchTables(spark, f"{root}/state").read(STATE)
