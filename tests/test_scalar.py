from pyspark.sql import functions as F

from gtspark.functions.scalar import (claimed_category, haversine_km, saffir_simpson, signed_coord,
                                      missing_int, missing_double)


def test_saffir_simpson_thresholds(spark):
    df = spark.createDataFrame([(80,), (96,), (137,), (33,), (None,), (64,), (63,), (113,)], "w int")
    got = [r[0] for r in df.select(saffir_simpson("w")).collect()]
    assert got == [1, 3, 5, 0, None, 1, 0, 4]


def test_signed_coordinates(spark):
    df = spark.createDataFrame([("29.1N",), ("90.2W",), ("12.0S",), (" 77.9W",)], "c string")
    got = [r[0] for r in df.select(signed_coord("c")).collect()]
    assert got == [29.1, -90.2, -12.0, -77.9]


def test_missing_codes(spark):
    df = spark.createDataFrame([("-99",), ("-999",), ("",), (" 42 ",), ("x",)], "t string")
    assert [r[0] for r in df.select(missing_int("t")).collect()] == [None, None, None, 42, None]
    df2 = spark.createDataFrame([("MM",), ("999",), ("99.0",), ("9999.0",), ("1.5",)], "t string")
    assert [r[0] for r in df2.select(missing_double("t")).collect()] == [None, None, None, None, 1.5]


def test_claimed_category(spark):
    rows = [("It made landfall as a Category 1 hurricane.",), ("It was a Category Three storm.",),
            ("No category here.",), ("categories 4 and five",), ("Category  2",)]
    df = spark.createDataFrame(rows, "a string")
    assert [r[0] for r in df.select(claimed_category("a")).collect()] == [1, 3, None, 4, 2]


def test_haversine(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0)], "a double, b double, c double, d double")
    d = df.select(haversine_km("a", "b", "c", "d")).first()[0]
    assert abs(d - 111.195) < 0.01
