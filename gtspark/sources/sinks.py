"""Sinks: overwrite with ingest time, append, replace by key, run log.

SNK1 SNK2 SNK4 SNK6.  ``fmt`` is the table format (Parquet by default).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gtspark.session import materialise

PACK_END = "\f\n"         # ends a file in a pack; a form feed inside a file becomes a blank


def overwrite_table(df: DataFrame, path: str, partition_by: tuple = (), fmt: str = "parquet") -> None:
    """SNK1: the whole table anew, with ``_ingest_ts``; a rerun gives the same rows."""
    out = df if "_ingest_ts" in df.columns else df.withColumn("_ingest_ts", F.current_timestamp())
    out.write.format(fmt).mode("overwrite").partitionBy(*partition_by).save(path)


def append_evaluations(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SNK2: one row per model, question and run, partitioned by model."""
    df.write.format(fmt).mode("append").partitionBy("model").save(path)


def _fs(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def swap_in(spark, new: str, path: str) -> None:
    """Put the complete table at ``new`` in the place of ``path``; the one before lies at ``path.before`` until that is done."""
    fs, target = _fs(spark, path)
    source, before = _fs(spark, new)[1], _fs(spark, path + ".before")[1]
    if fs.exists(target):
        fs.delete(before, True)
        if not fs.rename(target, before):
            raise OSError(f"could not set {path} aside")
    if not fs.rename(source, target):
        raise OSError(f"could not put {new} in the place of {path}")
    fs.delete(before, True)


def recover(spark, path: str) -> None:
    """After a crash between the two renames: the version set aside comes back."""
    fs, target = _fs(spark, path)
    before = _fs(spark, path + ".before")[1]
    if not fs.exists(target) and fs.exists(before):
        fs.rename(before, target)


def replace_rows(df: DataFrame, path: str, keys: tuple, fmt: str = "parquet") -> None:
    """SNK4: rows of the keys in ``df`` are replaced, others stay; a rerun changes nothing.

    The next version is written beside the table and swapped in, so the table
    is whole at every moment or can be recovered (the next call does).
    """
    spark = df.sparkSession
    recover(spark, path)
    new = materialise(df, "replace")
    old = spark.read.format(fmt).schema(df.schema).load(path)
    kept = old.join(new.select(*keys).distinct(), list(keys), "leftanti").select(*df.columns)
    aside = f"{path}.next"
    kept.unionByName(new).write.format(fmt).mode("overwrite").save(aside)
    swap_in(spark, aside, path)


def append_run_log(runs: DataFrame, path: str) -> None:
    """SNK6: one JSON line per run: run_id, model, ts, params, metrics."""
    runs.select("run_id", "model", "ts", "params", "metrics").write.mode("append").json(path)


def pack_files(df: DataFrame, path: str) -> None:
    """The small text files of ``df`` (file, value), many to a stored one: the name, then the lines.

    Making, listing and opening a file costs far more than its few lines, and
    nothing but the number of tasks sets how many packs there are.  Rows of one
    name are one file.
    """
    files = df.groupBy("file").agg(F.concat_ws("\n", F.sort_array(F.collect_list("value"))).alias("value"))
    (files.select(F.concat_ws("\n", "file", F.translate("value", "\f", " ")).alias("value"))
     .write.option("lineSep", PACK_END).text(path))
