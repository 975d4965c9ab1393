from gtspark.operators import medallion

EVENTS = [(1, "The remnants of IDA moved on.", 2021), (2, "Florida saw rain.", 2021), (3, "ida.", 2020), (4, None, 2021),
          (5, "IDAHO and Ida again", 2021), (6, "A.B storm", 2021)]
STORMS = [("s1", "IDA", 2021), ("s2", "A.B", 2021), ("s3", "IDA", 2019)]


def link(spark, **kw):
    ev = spark.createDataFrame(EVENTS, "id int, event_narrative string, year int")
    st = spark.createDataFrame(STORMS, "storm_id string, name string, year int")
    return {(r["id"], r["linked_storm_id"]) for r in medallion.link_narratives(ev, st, **kw).collect()}


def test_names_inside_words_and_whole_words(spark):
    assert link(spark) == {(1, "s1"), (2, "s1"), (3, None), (4, None), (5, "s1"), (6, "s2")}      # as in FlorIDA
    florida = spark.createDataFrame([(2, "FLORIDA saw IDALIA.", 2021)], "id int, event_narrative string, year int")
    st = spark.createDataFrame(STORMS, "storm_id string, name string, year int")
    assert medallion.link_narratives(florida, st).first()["linked_storm_id"] == "s1"
    assert medallion.link_narratives(florida, st, whole_word=True).first()["linked_storm_id"] is None
    assert link(spark, whole_word=True) == {(1, "s1"), (2, None), (3, None), (4, None), (5, "s1"), (6, "s2")}


def test_landfall_fixes_are_those_marked_inside_the_box(spark):
    rows = [(1, "L", 34.5, -77.0), (2, None, 34.5, -77.0), (3, "L", 30.0, -77.0), (4, "L", 33.5, -78.7), (5, "L", None, -77.0)]
    df = spark.createDataFrame(rows, "id int, record_id string, lat double, lon double")
    assert sorted(r["id"] for r in medallion.landfall_fixes(df).collect()) == [1, 4]
