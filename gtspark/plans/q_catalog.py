"""SQL functions and catalogue tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gtspark import config as C
from gtspark.functions.sql import register_functions
from gtspark.plans.q_evaluate import _FOUND_SQL
from gtspark.plans.q_truth import cat_sql
from gtspark.plans.registry import register
from gtspark.plans.views import v_claims, v_evals, v_points, with_views
from gtspark.session import scratch_path
from gtspark.sources import schema

_STATUS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.STATUS_LABELS.items())


@register("sql_functions", with_views(f"""
SELECT p.line_no, {cat_sql('p.max_wind_kt')} AS category,
       CASE WHEN p.line_no % 2 = 0 THEN -(p.line_no % 900) / 10.0::DOUBLE ELSE (p.line_no % 900) / 10.0::DOUBLE END AS coord,
       round(2 * 6371.0 * asin(sqrt(pow(sin((radians(35.0) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(35.0))
             * pow(sin((radians(-77.0) - radians(p.lon)) / 2), 2))), 6) AS km, {_FOUND_SQL} AS claimed,
       CASE ['td', ' HU ', 'ex', 'ZZ'][(p.line_no % 4 + 1)::INTEGER] WHEN 'td' THEN 'tropical depression' WHEN ' HU ' THEN 'hurricane'
            WHEN 'ex' THEN 'extratropical cyclone' END AS label
FROM v_points p JOIN v_claims c ON c.event_id = p.line_no""", "v_points", "v_claims"))
def sql_functions(spark, sf_dir):
    """2.13 P1 P2 P6 P11 E7: the session's SQL functions on every fix and claim, in SQL alone."""
    tag = f"q{uuid.uuid4().hex[:8]}_"
    register_functions(spark, prefix=tag)
    return spark.sql(f"""
        SELECT p.line_no, {tag}saffir_simpson(p.max_wind_kt) AS category,
               {tag}signed_coord(concat(p.line_no % 900 / 10.0, if(p.line_no % 2 = 0, 'W', 'n'))) AS coord,
               round({tag}haversine_km(p.lat, p.lon, 35.0, -77.0), 6) AS km, {tag}claimed_category(c.answer) AS claimed,
               {tag}status_label(element_at(array('td', ' HU ', 'ex', 'ZZ'), int(p.line_no % 4 + 1))) AS label
        FROM {{points}} p JOIN {{claims}} c ON c.event_id = p.line_no""",
                     points=v_points(spark, sf_dir), claims=v_claims(spark, sf_dir))


@register("schema_init", with_views("""
SELECT model, count(*) * 2 AS n, sum(event_id % 1000) * 2 / 1e6::DOUBLE AS cost_usd, count(hallucinated) * 2 AS checked,
       0::BIGINT AS answered FROM v_evals GROUP BY 1""", "v_evals"))
def schema_init(spark, sf_dir):
    """SNK3 SNK2: the schema applied twice with rows appended after each; nothing is lost."""
    db, path = f"gts_{uuid.uuid4().hex[:8]}", scratch_path(spark, "warehouse")
    rows = v_evals(spark, sf_dir).drop("event_id")
    for _ in range(2):
        schema.init_schema(spark, db, path)
        schema.append(rows, db, "evaluations")
    t = spark.table(f"{db}.evaluations")
    return t.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
                                  F.count("hallucinated").alias("checked"), F.count("answer").alias("answered"))
