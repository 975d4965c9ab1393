"""The scalar expressions as SQL functions of a session.

Each function's body is the SQL text of the very column expression that the
DataFrame side uses, so both give the same values and both stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gtspark.functions import scalar

#: name -> (parameters, result type, column expression over the parameters)
FUNCTIONS = {
    "saffir_simpson": ({"wind_kt": "double"}, "int", lambda: scalar.saffir_simpson("wind_kt")),
    "signed_coord": ({"token": "string"}, "double", lambda: scalar.signed_coord("token")),
    "haversine_km": ({"lat1": "double", "lon1": "double", "lat2": "double", "lon2": "double"}, "double",
                     lambda: scalar.haversine_km("lat1", "lon1", "lat2", "lon2")),
    "claimed_category": ({"answer": "string"}, "int", lambda: scalar.claimed_category("answer")),
    "status_label": ({"code": "string"}, "string", lambda: scalar.status_label("code")),
    "hallucination_flag": ({"claimed": "int", "expected": "int"}, "boolean",
                           lambda: scalar.hallucination_flag(F.col("claimed"), F.col("expected"))),
}


def sql_text(spark: SparkSession, column: Column, params: dict[str, str]) -> str:
    """SQL of a column expression over the named parameters."""
    row = spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in params.items()])
    plan = row.select(column.alias("out"))._jdf.queryExecution().analyzed()
    return plan.expressions().head().child().sql()


def register_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create the functions as temporary functions of the session; returns their names."""
    names = []
    for name, (params, result, column) in FUNCTIONS.items():
        args = ", ".join(f"{n} {t.upper()}" for n, t in params.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({args}) RETURNS {result.upper()} "
                  f"RETURN {sql_text(spark, column(), params)}")
        names.append(prefix + name)
    return names
