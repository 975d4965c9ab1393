"""SNK3: the tables' schemas and their idempotent creation in the session's catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: table -> (columns, partition columns)
TABLES = {
    "evaluations": (
        "run_id string, run_ts timestamp, model string, question_id string, storm_id string, question string, answer string, "
        "groundedness double, faithfulness double, context_relevance double, answer_relevance double, judge_score double, "
        "hallucinated boolean, latency_ms double, cost_usd double, prompt_tokens int, completion_tokens int, reward double",
        ("model",)),
    "prompts": ("template_name string, version string, body string, created_ts timestamp", ()),
    "storm_truth": ("storm_id string, name string, year int, landfall_category int, peak_wind_kt int, min_pressure_mb int", ()),
    "preference_pairs": (
        "pair_id string, question_id string, question string, chosen string, rejected string, chosen_model string, "
        "rejected_model string, margin double, created_ts timestamp", ()),
}


class SchemaMismatch(ValueError):
    """An existing table differs from its schema; the message names the columns."""


def _columns(ddl) -> dict[str, str]:
    schema = ddl if isinstance(ddl, T.StructType) else T.StructType.fromDDL(ddl)
    return {f.name.lower(): f.dataType.simpleString() for f in schema.fields}


def differences(want, have) -> list[str]:
    """What an existing schema lacks, has too much, or types otherwise (in any column order)."""
    w, h = _columns(want), _columns(have)
    return ([f"{c}: missing" for c in w if c not in h] + [f"{c}: not in the schema" for c in h if c not in w]
            + [f"{c}: {h[c]} in place of {w[c]}" for c in w if c in h and h[c] != w[c]])


def table_ddl(database: str, name: str, location: str | None = None, tables=None) -> str:
    """CREATE TABLE IF NOT EXISTS of one table."""
    ddl, parts = (tables or TABLES)[name]
    where = f" LOCATION '{location}/{name}'" if location else ""
    by = f" PARTITIONED BY ({', '.join(parts)})" if parts else ""
    return f"CREATE TABLE IF NOT EXISTS {database}.{name} ({ddl}) USING parquet{by}{where}"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def init_schema(spark: SparkSession, database: str, location: str | None = None, tables=None) -> list[str]:
    """Create what does not exist yet and check what does; any number of runs give the same tables.

    ``location`` keeps the files under a folder of its own, so that a new
    session with an empty catalogue finds the rows again.
    """
    tables = tables or TABLES
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{at}")
    for name, (ddl, parts) in sorted(tables.items()):
        fresh = not spark.catalog.tableExists(f"{database}.{name}")
        spark.sql(table_ddl(database, name, location, tables))
        wrong = differences(ddl, spark.table(f"{database}.{name}").schema)
        if wrong:
            raise SchemaMismatch(f"{database}.{name} has another schema: {'; '.join(wrong)}")
        if fresh and parts and location and _exists(spark, f"{location}/{name}"):
            spark.sql(f"ALTER TABLE {database}.{name} RECOVER PARTITIONS")
    return sorted(tables)


def append(df: DataFrame, database: str, name: str, tables=None) -> None:
    """Append rows; columns are taken by name, ones that ``df`` lacks are NULL, others are an error."""
    ddl, _ = (tables or TABLES)[name]
    schema = T.StructType.fromDDL(ddl)
    extra = sorted(set(df.columns) - set(schema.names))
    if extra:
        raise SchemaMismatch(f"{database}.{name} has no column {', '.join(extra)}")
    spark = df.sparkSession
    order = spark.table(f"{database}.{name}").columns              # partition columns come last
    types = {f.name: f.dataType for f in schema.fields}
    df.selectExpr(*[f"cast({c if c in df.columns else 'NULL'} AS {types[c].simpleString()}) AS {c}" for c in order]
                  ).write.insertInto(f"{database}.{name}")
