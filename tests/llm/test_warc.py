import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gtspark.llm import warc as W

PAGES = "page_id long, url string, html string"


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def want(rows, least=0):
    first = {}
    for i, _, t in rows:
        if i is not None and len((t or "").encode()) >= least:
            k = t or ""
            first[k] = min(first.get(k, i), i)
    out = []
    for i, _, t in rows:
        k = t or ""
        again = i is not None and k in first and first[k] != i and len(k.encode()) >= least
        out.append((i, len(k.encode()), digest(k), "revisit" if again else "response", first[k] if again else None))
    return sorted(out, key=str)


def sample():
    rng = random.Random(3)
    rows = []
    for i in range(120):
        t = "".join(rng.choice("ab <>é日\r\n") for _ in range(rng.randrange(0, 400)))
        if i % 5 == 0:                                  # payloads that look like records
            fake = f"{W.MAGIC}WARC-Type: response\r\nX-Page-Id: 9999\r\nContent-Length: {rng.randrange(200)}{W.END}"
            t = t[:50] + fake * rng.randrange(1, 4) + t[50:]
        if i % 11 == 0:
            t = W.MAGIC + t + W.MAGIC
        rows.append((i, f"http://x/{i}\r\nWARC-Type: evil", t))
    rows += [(200, None, None), (201, "u", ""), (202, "u", W.END * 3), (203, "u", "x" * 300_000), (None, "u", "dup"),
             (204, "u", "dup"), (205, "u", "dup"), (204, "u", "dup"), (206, "u", rows[0][2]), (1, "u", rows[7][2]),
             (207, "u", W.MAGIC[:-1]), (208, "u", "WARC/1.1\n"), (209, "u", f"{W.END}{W.MAGIC}{W.END}")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("split", ["128m", "2000b"])
def test_round_trip(spark, split):
    rows = sample()
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = spark.createDataFrame(rows, PAGES).withColumn("at", F.lit(1)).withColumn("head", F.lit("h")).repartition(3)
        got = sorted((tuple(r) for r in W.round_trip(df).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want(rows)


def test_least_length_and_empty_table(spark):
    rows = [(3, "u", "ab"), (1, "u", "ab"), (2, "u", "abc"), (4, "u", "abc"), (5, "u", None)]
    got = sorted((tuple(r) for r in W.round_trip(spark.createDataFrame(rows, PAGES), least=3).collect()), key=str)
    assert got == want(rows, 3) and [r[3] for r in got].count("revisit") == 1
    assert W.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_archive_bytes(spark, tmp_path):
    """A plain sequential reader finds the same records in the files."""
    rows = sample()
    W.write(spark.createDataFrame(rows, PAGES).repartition(2), f"{tmp_path}/a")
    found = []
    for f in (tmp_path / "a").glob("part-*"):
        raw, at = f.read_bytes(), 0
        while at < len(raw):
            assert raw.startswith(W.MAGIC.encode(), at)
            end = raw.index(b"\r\n\r\n", at)
            head = dict(x.split(": ", 1) for x in raw[at:end].decode().split("\r\n")[1:])
            size = int(head["Content-Length"])
            body = raw[end + 4:end + 4 + size].decode()
            at = end + 4 + size + 4
            assert raw[at - 4:at] == b"\r\n\r\n"
            found.append((head["WARC-Type"], head.get("X-Page-Id"), body))
    assert len(found) == len(rows)
    texts = {str(i): t or "" for i, _, t in rows}
    assert all(b == texts[i] for k, i, b in found if k == "response" and i and i != "1")
    seen = W.read(spark, f"{tmp_path}/a")
    assert sorted(b for _, _, b in found) == sorted(r.payload for r in seen.collect())
