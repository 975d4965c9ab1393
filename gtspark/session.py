"""SparkSession defaults and the shared-folder helper.

Every operator in the package is a plain DataFrame -> DataFrame function; the
only session-level concerns are a handful of settings and where lineage cuts
and landed files go (the cluster's ``spark.checkpoint.dir``).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for correctness and for scale.  AQE re-plans joins and
# coalesces/splits shuffle partitions from runtime statistics, which is what
# keeps a skewed storm (one key holding a third of all rows) from becoming a
# straggler task.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "gtspark", conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults and ``conf``.

    Master, memory and the checkpoint folder come from the deployment; a local
    session (tests, bench) gets a private checkpoint folder when none is set.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder for checkpoints and landed files.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir).  A
    local session without either gets a private folder; on a cluster that is
    an error, since executors would write to their own disks.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d.rstrip("/")
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d and not (sc.master.startswith("local") and "cluster" not in sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="gtspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    got = sc.getCheckpointDir() or d
    return got.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:10]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back.

    Cuts the lineage: all later reads see the same rows, a lost executor costs
    a reread, and what a task chose (its partition id, say) stays chosen.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join by shuffle: stored texts that repeat are small on disk, and a side broadcast
    for that size passes through the driver at its full one."""
    return df.hint("merge")
