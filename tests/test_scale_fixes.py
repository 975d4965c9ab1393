"""Results that must not depend on size, partitions, nulls or rare characters."""

import pytest
from pyspark.sql import functions as F

from gtspark.functions import text as X
from gtspark.operators import marts, retrieval, spatial, stats


def test_row_numbers_are_exact_at_size(spark):
    df = spark.range(0, 200_000, 1, 16).select(F.xxhash64("id").alias("k"), F.md5(F.col("id").cast("string")).alias("load"))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = marts.global_row_number(df, ["k"], "seq")
        r = got.agg(F.count_distinct("seq"), F.min("seq"), F.max("seq"), F.max(F.length("load"))).first()
        top = got.orderBy("seq").limit(3).select("k").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert tuple(r) == (200_000, 1, 200_000, 32)
    assert top == df.orderBy("k").limit(3).select("k").collect()


def test_paired_questions_are_numbered_without_gaps(spark):
    n = 20_000
    ev = spark.range(0, 2 * n).select(
        F.concat(F.lit("q"), F.floor(F.col("id") / 2).cast("string")).alias("question_id"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("model"), (F.col("id") % 7).alias("reward"),
        F.lit(1).alias("run_ts"))
    d = stats.paired_diffs(ev, "reward", "a", "b")
    assert tuple(d.agg(F.count_distinct("idx"), F.min("idx"), F.max("idx")).first()) == (n, 0, n - 1)


def test_running_sums_and_upper_median(spark):
    rows = [("x", float(v)) for v in (5, 1, 1, 9, 3, 3)] + [("y", 2.0), (None, 4.0), (None, 8.0)]
    df = spark.createDataFrame(rows, "run_id string, latency_ms double").repartition(5)
    got = {r.run_id: r.p50 for r in marts.upper_median(df, ["run_id"], "latency_ms", "p50").collect()}
    assert got == {"x": 3.0, "y": 2.0, None: 8.0}
    cum = marts.range_prefix(df, ["latency_ms"], sums={"latency_ms": "upto"})
    assert cum.agg(F.max("upto")).first()[0] == sum(v for _, v in rows)


def test_null_model_is_a_model(spark):
    ev = spark.createDataFrame([("m", 1), ("m", 2), (None, 1), (None, 3)], "model string, run_ts int")
    got = sorted(marts.latest_runs(ev).collect(), key=str)
    assert [tuple(r) for r in got] == [("m", 2), (None, 3)]
    board = ev.select("model").distinct()
    failed = {r.test: r.failures for r in marts.quality_tests(ev.withColumn("reward", F.lit(0.5)), board).collect()}
    assert failed["fct_evaluations.model.not_null"] == 2 and failed["agg_model_performance.model.not_null"] == 1


@pytest.mark.parametrize("lon", [180.0, -180.0, 179.9])
def test_nearest_station_across_the_date_line(spark, lon):
    st = spark.createDataFrame([("far", 0.0, 150.0), ("near", 0.0, lon)], "station_id string, lat double, lon double")
    pt = spark.createDataFrame([("p", 0.1, 179.5), ("q", -0.1, -179.5)], "place_id string, lat double, lon double")
    got = {r.place_id: r.station_id for r in spatial.nearest_station(pt, st).collect()}
    assert got == {"p": "near", "q": "near"}


def test_unicode_white_space(spark):
    text = "un deux trois quatre\x1fcinq"
    df = spark.createDataFrame([(text, "  Hi there. ")], "t string, s string")
    words, stripped = df.select(X.words("t"), X.strip("s")).first()
    assert words == text.split() and stripped == "Hi there."


def test_questions_without_tokens_get_zero_score_hits(spark):
    chunks = spark.createDataFrame([("c1", "d", "storm surge"), ("c2", "d", "calm sea")],
                                   "chunk_id string, doc_id string, text string")
    q = spark.createDataFrame([("1", "???"), ("2", "storm")], "query_id string, query string")
    for strategy in ("lexical", "none"):
        got = retrieval.retrieve(q, chunks, k=2, top_k=2, strategy=strategy).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.chunk_id) for r in got] == [("1", "c1"), ("1", "c2"), ("2", "c1"), ("2", "c2")]
        assert [r.score for r in got][:2] == [0.0, 0.0] and got[2].score > 0.3


def test_top_k_does_not_depend_on_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (60, 5)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    one, many = (sorted(tuple(r) for r in retrieval.topk_arrays(df, df, k=4, block_rows=b).collect()) for b in (1000, 7))
    assert one == many and len(one) == 240


def test_shared_folder_is_required_on_a_cluster():
    from gtspark import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_proximity_keys_lose_no_pair(spark):
    import datetime as dt
    import random

    import math

    rng, start = random.Random(3), dt.datetime(2030, 1, 1)
    spots = [(0, 179.9), (0, -179.9), (60.2, -180.0), (89.5, 10.0), (89.6, 170.0), (-45.0, 20.0), (-45.3, 21.1)]

    def rows(n):
        out = []
        for i in range(n):
            lat, lon = rng.choice(spots)
            lon = (lon + rng.uniform(-2, 2) + 180) % 360 - 180
            out.append((i, start + dt.timedelta(minutes=rng.randrange(2000)), min(89.99 - i * 1e-4, lat + rng.uniform(-2, 2)), lon))
        return out

    def km(a, b):
        p, q = math.radians(a[2]), math.radians(b[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1, h)))

    fixes, obs = rows(120), rows(300)
    want = {}
    for f in fixes:
        near = [(round(km(f, o), 6), o[0]) for o in obs if abs((f[1] - o[1]).total_seconds()) <= 10800 and km(f, o) <= 149.9]
        want[f[0]] = min(near)[1] if near else None
    f, o = (spark.createDataFrame(r, f"{n} long, obs_time timestamp_ntz, lat double, lon double")
            for r, n in ((fixes, "fix_id"), (obs, "obs_id")))
    got = {r.fix_id: r.obs_id for r in spatial.nearest_within(f, o, km=149.9).collect()}
    assert sum(v is not None for v in want.values()) > 40 and got == want
