"""Binding views: the driver's generic tables seen as storm data.

Each view has a DataFrame builder (used by the registered queries) and the
equivalent DuckDB SQL text (used by the oracles).  The mapping itself is the
test contract written down in FIXTURES.md part C.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _k(props="props"):
    return F.get_json_object(F.col(props), "$.k").try_cast("int")


# ---------------------------------------------------------------------------
# DataFrame builders
# ---------------------------------------------------------------------------

def v_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track fixes: one event = one fix of storm ``user_id``."""
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return ev.select(
        F.col("user_id").cast("string").alias("storm_id"),
        F.col("ts").alias("obs_time"),
        eid.alias("line_no"),
        F.when(eid % 17 == 0, F.lit(None).cast("int"))
         .otherwise(F.floor("value").cast("int")).alias("max_wind_kt"),
        F.when(F.col("event_type") == "purchase", F.lit("L")).alias("record_id"),
        F.col("event_type").alias("status"),
        (F.lit(25.0) + (eid % 150).cast("double") / 10.0).alias("lat"),
        (F.lit(-85.0) + ((eid * 7) % 150).cast("double") / 10.0).alias("lon"),
        (F.lit(900) + _k()).alias("min_pressure_mb"),
    )


def v_storms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storms: distinct user ids, named after the matching customer."""
    ev = table(spark, sf_dir, "events").select("user_id").distinct()
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return (ev.join(cust, ev.user_id == cust.c_custkey, "left")
            .select(F.col("user_id").cast("string").alias("storm_id"),
                    F.upper("c_name").alias("name"),
                    (F.lit(1980) + (F.col("user_id") % 44)).cast("int").alias("year")))


def v_evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows: 3 models, 50 questions, one run per model and day."""
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    model = F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string"))
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    hall = (F.when(F.col("event_type") == "error", F.lit(True))
             .when(F.col("event_type") == "signup", F.lit(None).cast("boolean"))
             .otherwise(F.lit(False)))
    g = ((eid * 37) % 101).cast("double") / 100.0
    return ev.select(
        F.concat(model, F.lit("-"), F.date_format(day, "yyyy-MM-dd")).alias("run_id"),
        day.alias("run_ts"),
        model.alias("model"),
        F.concat(F.lit("q"), (eid % 50).cast("string")).alias("question_id"),
        F.col("user_id").cast("string").alias("storm_id"),
        g.alias("groundedness"),
        (((eid * 53) % 101).cast("double") / 100.0).alias("answer_relevance"),
        hall.alias("hallucinated"),
        (g - F.when(hall, 1.0).otherwise(0.0)).alias("reward"),
        F.col("value").alias("latency_ms"),
        ((eid % 1000).cast("double") / 1e6).alias("cost_usd"),
        eid.alias("event_id"),
    )


def v_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id"),
        F.col("user_id").cast("string").alias("storm_id"),
        F.concat(F.lit("struck as a Category "), (_k() % 7).cast("string")).alias("answer"),
    )


def v_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus: documents plus assistant turns (doc ids 'd<id>' and 'c<conv>:<turn>')."""
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    conv = (table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
            .select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(":"),
                             F.col("turn").cast("string")).alias("doc_id"), "text"))
    return docs.unionByName(conv)


def v_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "benchmark")
            .select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"),
                    F.col("text").alias("query")))


def v_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn joined to the assistant turn right after it (same conversation).

    An equi-join on (conv_id, turn + 1): no pairs are enumerated inside a
    conversation, so a very long conversation costs nothing extra.
    """
    conv = table(spark, sf_dir, "conversations")
    u = conv.filter(F.col("role") == "user").select(
        "conv_id", F.col("turn").alias("u_turn"), F.col("text").alias("question"))
    a = conv.filter(F.col("role") == "assistant").select(
        F.col("conv_id").alias("a_conv"), F.col("turn").alias("a_turn"), F.col("text").alias("answer"))
    j = u.join(a, (u.conv_id == a.a_conv) & (a.a_turn == u.u_turn + 1))
    return j.select(F.concat(F.lit("p"), F.col("conv_id").cast("string"), F.lit(":"),
                             F.col("u_turn").cast("string")).alias("pair_id"),
                    "conv_id", "u_turn", "a_turn", "question", "answer")


def _located(df: DataFrame, key: str) -> DataFrame:
    k = F.col(key)
    return df.select(
        k.alias("key"),
        (F.lit(25.0) + ((k * 13) % 150).cast("double") / 10.0).alias("lat"),
        (F.lit(-85.0) + ((k * 29) % 150).cast("double") / 10.0).alias("lon"))


def v_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(table(spark, sf_dir, "supplier"), "s_suppkey").withColumnRenamed("key", "station_id")


def v_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(table(spark, sf_dir, "customer"), "c_custkey").withColumnRenamed("key", "place_id")


def v_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    k = _k()
    return ev.select(
        F.col("event_id"),
        (k % 6).alias("actual"),
        ((k + F.col("event_id") % 2) % 6).cast("int").alias("predicted"),
        (F.lit(1980) + F.col("user_id") % 44).cast("int").alias("year"))


def _storm_label(key):
    """Names that questions and reports share; some hold a name of the prior table."""
    known = F.element_at(F.array(F.lit("Florence "), F.lit("Dorian "), F.lit("Irene ")), (key % 10 + 1).cast("int"))
    return F.concat(F.lit("Hurricane "), F.when(key % 10 < 3, known).otherwise(""), F.lit("U"), key.cast("string"))


def v_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storm reports: a text per storm that states a landfall category taken from its events."""
    ev = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(_k()).alias("k"), F.count(F.lit(1)).alias("n"))
    u, name = F.col("user_id"), _storm_label(F.col("user_id"))
    text = F.concat(name, F.lit(" formed over open water. "), name, F.lit(" made landfall as a Category "),
                    (F.col("k") % 6).cast("string"), F.lit(" hurricane. "), F.lit("Damage near zone "), (u % 7).cast("string"),
                    F.lit(" was reported by "), F.col("n").cast("string"), F.lit(" observers."))
    return ev.select(F.concat(F.lit("r"), u.cast("string")).alias("doc_id"), text.alias("text"))


def v_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation cases: a question per storm; every fourth has no storm id."""
    u = F.col("user_id")
    ev = table(spark, sf_dir, "events").select("user_id").distinct()
    name = _storm_label(u)
    ask = (F.when(u % 2 == 0, F.concat(F.lit("What category was "), name, F.lit(" when it made landfall?")))
           .otherwise(F.concat(F.lit("Where did "), name, F.lit(" come ashore, and what was the damage?"))))
    return ev.select(F.concat(F.lit("q"), u.cast("string")).alias("query_id"),
                     F.when(u % 4 > 0, u.cast("string")).alias("storm_id"), ask.alias("query"))


def v_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given answers: conversation pairs with a claimed category, an expected one and contexts."""
    p, c, t = v_pairs(spark, sf_dir), F.col("conv_id"), F.col("u_turn")
    claim = F.when(c % 3 > 0, F.concat(F.lit(" It was a Category "), (c % 5 + 1).cast("string"), F.lit("."))).otherwise("")
    ctx = (F.when((c + t) % 4 == 0, F.array("answer")).when((c + t) % 4 == 1, F.array("question", "answer"))
           .when((c + t) % 4 == 2, F.array("question")))
    verdict = (F.when(c % 6 == 0, '{"grounded": true, "reason": "all in the context"}')
               .when(c % 6 == 1, '{"grounded": false, "reason": "a \\"quote\\""}').when(c % 6 == 2, "I think it is fine.")
               .when(c % 6 == 3, '{"reason": "no verdict"}').when(c % 6 == 4, '{"grounded": tr'))
    return p.select(F.col("pair_id").alias("aid"), "question", F.concat("answer", claim).alias("answer"), ctx.alias("contexts"),
                    F.when(t % 4 < 3, (t % 5 + 1).cast("int")).alias("expected"), verdict.alias("verdict"))


# ---------------------------------------------------------------------------
# DuckDB text of the same views, as CTE bodies
# ---------------------------------------------------------------------------

_LABEL = ("('Hurricane ' || CASE user_id % 10 WHEN 0 THEN 'Florence ' WHEN 1 THEN 'Dorian ' WHEN 2 THEN 'Irene ' ELSE '' END "
          "|| 'U' || user_id)")

SQL_VIEWS = {
    "v_points": """
        SELECT CAST(user_id AS VARCHAR) AS storm_id, ts AS obs_time, event_id AS line_no,
               CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(floor(value) AS INTEGER) END AS max_wind_kt,
               CASE WHEN event_type = 'purchase' THEN 'L' END AS record_id,
               event_type AS status,
               25.0::DOUBLE + CAST(event_id % 150 AS DOUBLE) / 10.0 AS lat,
               -85.0::DOUBLE + CAST((event_id * 7) % 150 AS DOUBLE) / 10.0 AS lon,
               900 + CAST(json_extract_string(props, '$.k') AS INTEGER) AS min_pressure_mb
        FROM events""",
    "v_storms": """
        SELECT CAST(u.user_id AS VARCHAR) AS storm_id, upper(c.c_name) AS name,
               CAST(1980 + u.user_id % 44 AS INTEGER) AS year
        FROM (SELECT DISTINCT user_id FROM events) u
        LEFT JOIN customer c ON c.c_custkey = u.user_id""",
    "v_evals": """
        SELECT model || '-' || strftime(run_ts, '%Y-%m-%d') AS run_id, run_ts, model, question_id, storm_id,
               groundedness, answer_relevance, hallucinated,
               groundedness - CASE WHEN hallucinated THEN 1.0 ELSE 0.0 END AS reward,
               latency_ms, cost_usd, event_id
        FROM (
          SELECT 'm' || CAST(user_id % 3 AS VARCHAR) AS model,
                 date_trunc('day', ts) AS run_ts,
                 'q' || CAST(event_id % 50 AS VARCHAR) AS question_id,
                 CAST(user_id AS VARCHAR) AS storm_id,
                 CAST((event_id * 37) % 101 AS DOUBLE) / 100.0 AS groundedness,
                 CAST((event_id * 53) % 101 AS DOUBLE) / 100.0 AS answer_relevance,
                 CASE WHEN event_type = 'error' THEN TRUE WHEN event_type = 'signup' THEN NULL
                      ELSE FALSE END AS hallucinated,
                 value AS latency_ms,
                 CAST(event_id % 1000 AS DOUBLE) / 1e6 AS cost_usd,
                 event_id
          FROM events)""",
    "v_claims": """
        SELECT event_id, CAST(user_id AS VARCHAR) AS storm_id,
               'struck as a Category ' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 AS VARCHAR) AS answer
        FROM events""",
    "v_docs": """
        SELECT 'd' || CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents
        UNION ALL
        SELECT 'c' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS doc_id, text
        FROM conversations WHERE role = 'assistant'""",
    "v_queries": """
        SELECT 'b' || CAST(item_id AS VARCHAR) AS query_id, text AS query FROM benchmark""",
    "v_pairs": """
        SELECT 'p' || CAST(u.conv_id AS VARCHAR) || ':' || CAST(u.turn AS VARCHAR) AS pair_id,
               u.conv_id, u.turn AS u_turn, a.turn AS a_turn, u.text AS question, a.text AS answer
        FROM conversations u JOIN conversations a
          ON a.conv_id = u.conv_id AND a.role = 'assistant' AND a.turn = u.turn + 1
        WHERE u.role = 'user'""",
    "v_stations": """
        SELECT s_suppkey AS station_id,
               25.0::DOUBLE + CAST((s_suppkey * 13) % 150 AS DOUBLE) / 10.0 AS lat,
               -85.0::DOUBLE + CAST((s_suppkey * 29) % 150 AS DOUBLE) / 10.0 AS lon
        FROM supplier""",
    "v_places": """
        SELECT c_custkey AS place_id,
               25.0::DOUBLE + CAST((c_custkey * 13) % 150 AS DOUBLE) / 10.0 AS lat,
               -85.0::DOUBLE + CAST((c_custkey * 29) % 150 AS DOUBLE) / 10.0 AS lon
        FROM customer""",
    "v_forecasts": """
        SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 6 AS actual,
               CAST((CAST(json_extract_string(props, '$.k') AS INTEGER) + event_id % 2) % 6 AS INTEGER) AS predicted,
               CAST(1980 + user_id % 44 AS INTEGER) AS year
        FROM events""",
    "v_reports": f"""
        SELECT 'r' || user_id AS doc_id, {_LABEL} || ' formed over open water. ' || {_LABEL} || ' made landfall as a Category '
               || (k % 6) || ' hurricane. Damage near zone ' || (user_id % 7) || ' was reported by ' || n || ' observers.' AS text
        FROM (SELECT user_id, min(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS k, count(*) AS n FROM events GROUP BY 1)""",
    "v_cases": f"""
        SELECT 'q' || user_id AS query_id, CASE WHEN user_id % 4 > 0 THEN user_id::VARCHAR END AS storm_id,
               CASE WHEN user_id % 2 = 0 THEN 'What category was ' || {_LABEL} || ' when it made landfall?'
                    ELSE 'Where did ' || {_LABEL} || ' come ashore, and what was the damage?' END AS query
        FROM (SELECT DISTINCT user_id FROM events)""",
    "v_given": """
        SELECT pair_id AS aid, question,
               answer || CASE WHEN conv_id % 3 > 0 THEN ' It was a Category ' || (conv_id % 5 + 1) || '.' ELSE '' END AS answer,
               CASE (conv_id + u_turn) % 4 WHEN 0 THEN [answer] WHEN 1 THEN [question, answer] WHEN 2 THEN [question]
                    ELSE [] END AS contexts,
               CASE WHEN u_turn % 4 < 3 THEN (u_turn % 5 + 1)::INTEGER END AS expected,
               CASE conv_id % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 3 THEN 0.0 END::DOUBLE AS verdict
        FROM v_pairs""",
}


def with_views(body: str, *names: str) -> str:
    """Prefix a query body with the CTEs it needs."""
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names)
    return f"WITH {ctes}\n{body}"
