from pyspark.sql import functions as F

from gtspark.operators import search
from gtspark.sources import ingest, sinks


def test_events_products_and_buoys(spark, tmp_path):
    head = ",".join(ingest.EVENT_FIELDS)
    (tmp_path / "e.csv").write_text(
        head + '\n9,,,OHIO,2031,Surge,"01-JAN, noon",LAKE,,x3,"  A ""big"" wave.\nThen calm. ",\n8,1,AL1,IOWA,2032,Wind,t,Z,2K, 4 ,,end\n')
    a, b = ingest.read_storm_events(spark, str(tmp_path / "e.csv")).orderBy("year").collect()
    assert (a.episode_id, a.storm_id, a.damage_property, a.deaths_direct) == (None, None, None, None)
    assert a.document == 'Surge in LAKE, OHIO (01-JAN, noon).\nA "big" wave.\nThen calm.'
    assert (b.deaths_direct, b.damage_property, b.document) == (4, "2K", "Wind in Z, IOWA (t).\nend")
    (tmp_path / "p.json").write_text('[{"product_id": "1", "text": " a\\n"}, {"product_id": "2"}]')
    got = ingest.read_text_products(spark, str(tmp_path / "p.json")).orderBy("product_id").collect()
    assert [r.document for r in got] == ["a", ""]
    (tmp_path / "41x.txt").write_text("#h\n\n2030 1 1 0 0 1 2 3 1.0 MM 4 5 6 7 20.0\n2030 1 1 0 0 1 2 3 9.0 9 4 5 6 7 9\n")
    (tmp_path / "42y.txt").write_text("#h\n1 2\n")
    got = ingest.read_buoy_realtime(spark, [str(tmp_path / "41x.txt"), str(tmp_path / "42y.txt")]).orderBy("station").collect()
    assert [tuple(r) for r in got] == [("41X", 3.3, None, 68.0), ("42Y", None, None, None)]


def test_packed_station_files_read_as_single_ones(spark, tmp_path):
    line, old = "2030 1 1 0 0 1 2 3 %s MM 4 5 6 7 20.0", "2030 1 1 0 0 1 2 3 9.0 9 4 5 6 7 9"
    texts = {f"s{i}": "\n".join(["#h", "", line % (i % 9)] + [old] * (i % 3)) + "\n" * (i % 2) for i in range(40)}
    texts |= {"short": "#h\n1 2\n", "none": "#h\n", "feed": f"#h\f\r\n{line % 'MM'}\r\n{old}"}
    single, packs = tmp_path / "single", tmp_path / "packs"
    single.mkdir()
    for n, t in texts.items():
        (single / f"{n}.txt").write_text(t)
    rows = [(f"/{n}.txt", t) for n, t in texts.items()]
    sinks.pack_files(spark.createDataFrame(rows + rows[:1], "file string, value string"), str(packs))
    want, got = (sorted((tuple(r) for r in d.collect()), key=str) for d in (
        ingest.read_buoy_realtime(spark, str(single)), ingest.read_buoy_realtime(spark, str(packs), packed=True)))
    assert got == want and len(got) == 42


def test_stations_do_not_make_a_file_each(spark, tmp_path, monkeypatch):
    from gtspark.plans import q_ingest

    spark.range(300).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(q_ingest, "scratch_path", lambda spark, name: str(tmp_path / "landed"))
    got = {r.station: r for r in q_ingest.buoy_realtime(spark, str(tmp_path)).collect()}
    assert len(got) == 300 and tuple(got["B7"])[1:] == (5.7, 7.0, 38.3) and got["B0"].wave_height_ft is None
    assert len(list((tmp_path / "landed").rglob("part-*"))) < 30


def test_sinks_rerun_to_the_same_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "m"), (2, "b", "m")], "id int, v string, model string")
    p = str(tmp_path / "t")
    for _ in range(2):
        sinks.overwrite_table(df, p, ("model",))
        assert spark.read.parquet(p).count() == 2
    q = str(tmp_path / "r")
    df.write.parquet(q)
    new = spark.createDataFrame([(2, "c", "m"), (3, "d", "n")], "id int, v string, model string")
    for _ in range(2):
        sinks.replace_rows(new, q, ("id",))
        assert sorted(tuple(r) for r in spark.read.parquet(q).collect()) == [(1, "a", "m"), (2, "c", "m"), (3, "d", "n")]
    e = str(tmp_path / "e")
    sinks.append_evaluations(df, e)
    sinks.append_evaluations(new, e)
    assert spark.read.parquet(e).count() == 4


def test_search_and_routes(spark):
    docs = spark.createDataFrame([("d1", "Hugo came ashore at Bulls Bay. The storm was near."), ("d2", "Bay water rose.")],
                                 "doc_id string, text string")
    q = spark.createDataFrame([("1", "Where did Hugo come ashore?"), ("2", "the storm"), ("3", "hi there"), ("4", "football"),
                               ("5", "Hugo damage"), ("6", None)], "query_id string, query string")
    hits = search.idf_search(q, docs)
    got = {r.query_id: (r.doc_id, r.pos) for r in hits.collect()}
    assert got == {"1": ("d1", 0), "5": ("d1", 0)}
    plain = hits.filter("query_id = '5'").first().score
    idf = {r.token: r.idf for r in search.sentence_idf(search.sentence_table(docs)).collect()}
    assert abs(hits.filter("query_id = '1'").first().score - (idf["hugo"] + 0.4)) < 1e-6 and abs(plain - idf["hugo"]) < 1e-6
    routes = {r.query_id: r.route for r in search.route_questions(q, hits.select(F.col("query_id"))).collect()}
    assert routes == {"1": "corpus", "2": "external", "3": "greet", "4": "refuse", "5": "external", "6": "none"}
