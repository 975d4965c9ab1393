"""Landfall-category model: features, year split, training, scoring, report.

M1-M8 W3 A10-A13 SNK7.  Per-storm positional features (last, previous and
5th-from-last pre-landfall fix) use a row_number <= 5 filter, which Spark
plans as a partial + final WindowGroupLimit: each map task forwards at most
five fixes per storm, so a storm with a third of all fixes is not sorted in
one task.  Counts, peaks and the first fix are plain partial aggregates.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gtspark import config as C
from gtspark.functions.scalar import saffir_simpson
from gtspark.session import materialise

FEATURES = ["wind_pre", "pres_pre", "peak_wind", "intens_24h", "lat_pre", "fwd_speed"]
LABELS = [0, 1, 2, 3, 4, 5]
LEAST_FIXES = 4      # usable fixes that an estimate needs


def _positional(fixes: DataFrame, key: str, order: str, zero_pressure_missing: bool) -> DataFrame:
    """From usable fixes (wind not NULL): the six features per storm, >= 4 fixes."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    last5 = fixes.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 5)
    pos = last5.groupBy(key).agg(
        F.max_by(F.struct("max_wind_kt", "min_pressure_mb", "lat", "lon"),
                 F.when(F.col("_rn") == 1, F.lit(1))).alias("last"),
        F.max_by(F.struct("lat", "lon"), F.when(F.col("_rn") == 2, F.lit(1))).alias("prev"),
        F.max_by(F.col("max_wind_kt"), F.when(F.col("_rn") == 5, F.lit(1))).alias("w5"))
    agg = fixes.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_pre"), F.max("max_wind_kt").alias("peak_wind"),
        F.min_by("max_wind_kt", F.col(order)).alias("w_first"))
    j = agg.filter(F.col("n_pre") >= LEAST_FIXES).join(pos, key)
    pres = F.col("last.min_pressure_mb")
    if zero_pressure_missing:
        pres = F.nullif(pres, F.lit(0))
    ago = F.when(F.col("n_pre") >= 5, F.col("w5")).otherwise(F.col("w_first"))
    return j.select(
        key,
        F.col("last.max_wind_kt").cast("double").alias("wind_pre"),
        F.coalesce(pres.cast("double"), F.lit(1010.0)).alias("pres_pre"),
        F.col("peak_wind").cast("double").alias("peak_wind"),
        (F.col("last.max_wind_kt") - ago).cast("double").alias("intens_24h"),
        F.col("last.lat").cast("double").alias("lat_pre"),
        (F.abs(F.col("last.lat") - F.col("prev.lat")) + F.abs(F.col("last.lon") - F.col("prev.lon")))
        .cast("double").alias("fwd_speed"),
        "n_pre")


def track_features(points: DataFrame, storms: DataFrame | None = None, key: str = "storm_id",
                   order: str = "line_no") -> DataFrame:
    """M1: features from the fixes before the first 'L' fix (file order, any place).

    label = category of that landfall fix; storms with fewer than four
    usable earlier fixes or a landfall without wind are dropped (H17).
    """
    lf = (points.filter(F.col("record_id") == "L").groupBy(key)
          .agg(F.min_by(F.struct(F.col("obs_time").alias("lf_time"), F.col("max_wind_kt").alias("lf_wind")),
                        F.col(order)).alias("lf")))
    pre = (points.join(lf, key)
           .filter((F.col("obs_time") < F.col("lf.lf_time")) & F.col("max_wind_kt").isNotNull()))
    feats = _positional(pre, key, order, zero_pressure_missing=False)
    lab = lf.select(key, saffir_simpson(F.col("lf.lf_wind")).alias("label")).filter(F.col("label").isNotNull())
    out = feats.join(lab, key)
    if storms is not None:
        out = out.join(storms.select(key, "year"), key, "left")
    return out


def live_features(points: DataFrame, key: str = "storm_id", order: str = "line_no") -> DataFrame:
    """M2: the same features over a storm's whole recent track; NULL or 0 pressure -> 1010."""
    usable = points.filter(F.col("max_wind_kt").isNotNull())
    return _positional(usable, key, order, zero_pressure_missing=True)


def year_split(features: DataFrame, test_frac: float = 0.25, seed: int = 3,
               year_col: str = "year") -> DataFrame:
    """M3: disjoint train/test years; max(1, int(n * test_frac)) test years chosen by
    hashing 'seed:year' (reproducible, engine-independent)."""
    years = features.select(year_col).distinct()
    n = years.count()
    n_test = max(1, int(n * test_frac)) if n else 0
    picked = (years.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(year_col).cast("string"))), year_col)
              .limit(n_test).withColumn("_test", F.lit(True)))
    return (features.join(picked, year_col, "left")
            .withColumn("split", F.when(F.col("_test"), F.lit("test")).otherwise(F.lit("train")))
            .drop("_test"))


def build_model(rounds: int = 200, max_depth: int = 3, rate: float = 0.1, seed: int = 7) -> Pipeline:
    """M4: scale -> gradient-boosted trees, one ensemble per class against the others."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=FEATURES, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True),
        OneVsRest(classifier=GBTClassifier(maxIter=rounds, maxDepth=max_depth, stepSize=rate, seed=seed),
                  featuresCol="features", labelCol="label", parallelism=len(LABELS)),
    ])


def train(features: DataFrame, **kw) -> PipelineModel:
    """Fit on (FEATURES, label).  The rows are dealt anew into a few partitions: a tree level is one small job."""
    rows = features.select(*FEATURES, F.col("label").cast("double").alias("label"))
    rows = materialise(rows, "fit_rows")
    return build_model(**kw).fit(rows)


def class_probabilities(margins: str = "rawPrediction"):
    """Each class's logistic probability from its boosting margin, made to sum to one."""
    own = F.transform(vector_to_array(margins), lambda m: F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * m)))
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    return F.transform(own, lambda x: x / total)


def basis_text():
    """M6: the features a prediction rests on, as whole numbers."""
    return F.concat_ws(", ", *[F.format_string(f"{c}=%d", F.bround(F.col(c), 0).cast("long")) for c in FEATURES])


def predict(model: PipelineModel, features: DataFrame) -> DataFrame:
    """M5 + M6: predicted class, confidence (its probability) and the basis text."""
    p = model.transform(features)
    return (p.withColumn("predicted", F.col("prediction").cast("int"))
            .withColumn("confidence", F.array_max(class_probabilities()))
            .withColumn("basis", basis_text())
            .drop("_raw", "features", "rawPrediction", "prediction"))


def live_estimate(model: PipelineModel, points: DataFrame, key: str = "storm_id") -> DataFrame:
    """M2 + M5 + M6 for every storm; short tracks get NULL and the fixed text."""
    feats = live_features(points, key)
    pred = predict(model, feats).select(key, "predicted", "confidence", "basis")
    storms = points.select(key).distinct()
    return (storms.join(pred, key, "left")
            .withColumn("basis", F.coalesce("basis", F.lit(C.INSUFFICIENT_TRACK_TEXT)))
            .withColumn("disclaimer", F.lit(C.LIVE_DISCLAIMER)))


def confusion(pairs: DataFrame, actual: str = "actual", predicted: str = "predicted",
              labels=LABELS) -> DataFrame:
    """6 x 6 counts including zero cells (grid from a literal, left-joined)."""
    counts = pairs.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    grid = pairs.sparkSession.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted")) for a in labels for p in labels
    ])).alias("g")).select("g.actual", "g.predicted")
    return (grid.join(counts, ["actual", "predicted"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint")))


def report(pairs: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """A10 + A12 + M7: n, accuracy, within-one, macro F1 (labels seen in truth or prediction)."""
    a, p = F.col(actual), F.col(predicted)
    overall = pairs.agg(F.count(F.lit(1)).alias("n"),
                        F.avg((a == p).cast("double")).alias("accuracy"),
                        F.avg((F.abs(a - p) <= 1).cast("double")).alias("within_one"))
    per = (pairs.select(F.explode(F.array(
        F.struct(a.alias("label"), (a == p).cast("int").alias("tp"), F.lit(0).alias("fp"),
                 (a != p).cast("int").alias("fn")),
        F.struct(p.alias("label"), F.lit(0).alias("tp"), (a != p).cast("int").alias("fp"),
                 F.lit(0).alias("fn")))).alias("e"))
        .groupBy("e.label").agg(F.sum("e.tp").alias("tp"), F.sum("e.fp").alias("fp"), F.sum("e.fn").alias("fn")))
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = per.agg(F.avg(F.when(den > 0, 2.0 * F.col("tp") / den).otherwise(0.0)).alias("macro_f1"))
    return (overall.withColumn("_k", F.lit(1)).join(f1.withColumn("_k", F.lit(1)), "_k").drop("_k"))


def majority_share(features: DataFrame, label: str = "label") -> DataFrame:
    """Largest class count / n."""
    c = features.groupBy(label).count()
    return c.agg((F.max("count") / F.sum("count")).alias("majority_share"))


def evaluate(features: DataFrame, test_frac: float = 0.25, seed: int = 3, **kw):
    """M7: year split -> fit on train years -> report on test years.

    Returns (report DataFrame with n_train / n_test, confusion DataFrame, model).
    """
    split = year_split(features, test_frac, seed)
    model = train(split.filter(F.col("split") == "train"), **kw)
    scored = predict(model, split.filter(F.col("split") == "test"))
    pairs = scored.select(F.col("label").alias("actual"), "predicted")
    counts = split.groupBy().agg(F.count_if(F.col("split") == "train").alias("n_train"),
                                 F.count_if(F.col("split") == "test").alias("n_test"))
    rep = report(pairs).withColumn("_k", F.lit(1)).join(counts.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return rep, confusion(pairs), model


def persist_predictions(features: DataFrame, path: str, fmt: str = "parquet", **kw) -> DataFrame:
    """M8 + SNK4: refit on all rows, write predicted / actual / correct with the split."""
    split = year_split(features)
    model = train(split, **kw)
    out = (predict(model, split)
           .select(F.current_timestamp().alias("run_ts"), F.col("year").alias("storm_year"),
                   F.col("predicted").alias("predicted_category"), F.col("label").alias("actual_category"),
                   (F.col("predicted") == F.col("label")).alias("correct"), "split"))
    out.write.mode("overwrite").format(fmt).save(path)
    return out.sparkSession.read.format(fmt).load(path)


def save_model(model: PipelineModel, path: str) -> None:
    """SNK7."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
