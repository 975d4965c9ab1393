import hashlib

from pyspark.sql import functions as F

from gtspark.functions import text as X
from gtspark.operators import retrieval


def test_chunking_windows(spark):
    text = " ".join(f"w{i}" for i in range(100))
    df = spark.createDataFrame([("d1", text), ("d2", ""), ("d3", "a b")], "doc_id string, text string")
    rows = retrieval.chunk_docs(df, size=40, overlap=10).orderBy("doc_id", "ordinal").collect()
    d1 = [r for r in rows if r.doc_id == "d1"]
    assert [r.text.split()[0] for r in d1] == ["w0", "w30", "w60"]
    assert [r.chunk_id for r in d1] == ["d1::0", "d1::1", "d1::2"]
    assert d1[-1].text.split()[-1] == "w99"
    assert not [r for r in rows if r.doc_id == "d2"]
    assert [r.text for r in rows if r.doc_id == "d3"] == ["a b"]


def test_sentences(spark):
    df = spark.createDataFrame([("One. Two!  Three? tail",), ("no stop",), ("   ",), ("Wind 4.5 kt.",)], "t string")
    got = [r[0] for r in df.select(X.sentences("t")).collect()]
    assert got == [["One.", "Two!", "Three?"], ["no stop"], [], ["Wind 4.", "5 kt."]]


def test_md5_bucket_matches_python(spark):
    grams = ["storm", "landfall_near", "a", "x9", "hurricane_florence", "é"]
    df = spark.createDataFrame([(g,) for g in grams], "g string")
    for dim in (256, 100, 97):
        got = [r[0] for r in df.select(X.md5_bucket("g", dim)).collect()]
        assert got == [int(hashlib.md5(g.encode()).hexdigest(), 16) % dim for g in grams]


def test_overlap_and_embedding(spark):
    df = spark.createDataFrame([("a", "Storm surge storm", "storm wind")], "id string, q string, t string")
    o = df.select(X.overlap(X.tokens("q"), X.tokens("t"))).first()[0]
    assert abs(o - 0.5) < 1e-6
    v = retrieval.embed(df, "id", "q").collect()
    assert abs(sum(r.w * r.w for r in v) - 1.0) < 1e-9
