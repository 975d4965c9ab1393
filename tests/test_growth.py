"""Steps whose tasks, copies and files must stay bounded as tables grow, and their exact results."""

import datetime
import hashlib
import math
import random
import re
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from gtspark.operators import evaluate, retrieval, search, spatial, sweep
from gtspark.plans import q_feeds
from gtspark.session import shared_dir
from gtspark.sources import feeds


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grams_are_counted_as_rows_stream_by(spark):
    rows = [("a", "x y x"), ("a", "x y"), (None, "z"), ("b", "!!"), ("c", None), ("d", "One two")]
    df = spark.createDataFrame(rows, "id string, text string")
    vec = retrieval.embed(df)
    assert "Aggregate" not in _plan(vec) and "Window" not in _plan(vec)
    got = {}
    for r in vec.collect():
        got.setdefault(r["id"], {})[r["bucket"]] = r["w"]
    assert set(got) == {"a", None, "d"} and all(math.isclose(sum(w * w for w in v.values()), 1.0) for v in got.values())
    packed = {r["id"]: r for r in retrieval.embed_packed(df).collect()}
    assert packed["a"]["n"] == 2 and sorted(packed["a"]["c"]) == [1, 2, 2, 3]      # y_x, y, x_y, x
    assert packed["b"]["b"] == [] and packed["b"]["norm"] == 0.0


def test_counts_not_texts_are_sorted_in_partitions_that_grow_in_number(spark, monkeypatch):
    rows = [(f"d{i % 90}", i % 3, " ".join(f"w{j * i % 17}" for j in range(i % 7))) for i in range(400)] + [(None, 0, "x y")] * 3
    df = spark.createDataFrame(rows, "id string, k int, text string")
    monkeypatch.setattr(retrieval, "HELD_COUNTS", 200)
    monkeypatch.setattr(retrieval, "PART_BYTES", 100_000)
    packed = retrieval.embed_packed(df, keep=("k",))
    plan = _plan(packed)
    assert plan.index("Sort [") < plan.rindex("MapInArrow")                # the sort is above the counting
    assert packed.rdd.getNumPartitions() == retrieval._parts(403, 256) > 8
    want = {}
    for i, k, text in rows:
        n, c = want.setdefault((i, k), [0, {}])
        want[i, k][0] += 1
        tok = text.split()
        for g in tok + [f"{x}_{y}" for x, y in zip(tok, tok[1:])]:
            b = int(hashlib.md5(g.encode()).hexdigest(), 16) % 256
            c[b] = c.get(b, 0) + 1
    got = packed.collect()
    assert len(got) == len(want) and {(r.id, r.k): [r.n, dict(zip(r.b, r.c))] for r in got} == want
    assert all(r.norm == math.sqrt(sum(x * x for x in r.c)) for r in got)


def _bytes_stored(spark):
    top = Path(shared_dir(spark).removeprefix("file:"))
    return sum(f.stat().st_size for f in top.rglob("*") if f.is_file())


def test_a_sweep_stores_and_deals_out_less_than_its_corpus(spark):
    rnd = random.Random(5)
    texts = [" ".join("%010x" % rnd.getrandbits(40) for _ in range(500)) for _ in range(120)]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    q = spark.createDataFrame([("q", " ".join(texts[3].split()[:160]))], "query_id string, query string")
    cells = [sweep.Cell(f"{s}/{o}", s, o, top_k=2) for s, o in ((320, 48), (320, 96), (160, 48))]
    before = _bytes_stored(spark)
    hits = sweep.cell_hits(q, docs, cells)
    assert _bytes_stored(spark) - before < sum(map(len, texts)) / 2             # three chunkings are four times the corpus
    got = {(r.cell, r.rank): r for r in hits.collect()}
    assert len(got) == 6 and all(got[c.label, 1].doc_id == "d3" and got[c.label, 1].text in texts[3] for c in cells)
    cut = sweep.chunk_cells(docs, cells).withColumnRenamed("chunking", "grp")
    packed = retrieval.embed_packed(cut, "chunk_id", "text", keep=("grp",), bits=True)
    assert "Exchange" not in _plan(packed)                                      # texts are counted where they are cut


def test_sweep_hits_with_repeated_and_missing_ids(spark):
    rnd = random.Random(6)
    say = lambda n: " ".join(rnd.choice(["Hail", "roof,", "w1", "w2", "\u212aite", "\u0130x", "caf\u00e9", "9-1", "--", "sea\u00a0wall"]) for _ in range(n))
    docs = [(rnd.choice([None, "a", "a::1", "b|c", "d", "e"]), say(rnd.randrange(40))) for _ in range(40)] + [("z", None), ("z", " ")]
    asked = [("q1", say(6)), ("q1", say(6)), (None, say(6)), ("q2", "--"), ("q3", None)]
    cells = [sweep.Cell("x", 8, 3, "none", top_k=5), sweep.Cell("y", 12, 0, "none", top_k=4)]
    hits = sweep.cell_hits(spark.createDataFrame(asked, "query_id string, query string"),
                           spark.createDataFrame(docs, "doc_id string, text string"), cells)
    got = {}
    for r in hits.collect():
        got.setdefault((r.cell, r.query_id), []).append((r.chunk_id, r.score, r.doc_id, r.text))

    def vector(texts):
        v = np.zeros(256)
        for t in texts:
            tok = re.findall("[a-z0-9]+", (t or "").lower().replace("\u0130", "i\u0307"))
            for g in tok + [f"{x}_{y}" for x, y in zip(tok, tok[1:])]:
                v[int(hashlib.md5(g.encode()).hexdigest(), 16) % 256] += 1
        return v / (np.sqrt((v * v).sum()) or 1)

    for c in cells:
        chunks, step = {}, max(1, c.chunk_size - c.overlap)
        for i, t in docs:
            w = (t or "").split()
            for k in range(min(max(0, -(-(len(w) - c.chunk_size) // step)), -(-len(w) // step) - 1) + 1 if w else 0):
                name = c.chunking if i is None else f"{c.chunking}|{i}::{k}"
                chunks.setdefault(name, []).append((i, " ".join(w[k * step:k * step + c.chunk_size])))
        for name in {i for i, _ in asked}:
            q = vector([t for i, t in asked if i == name] if name else [])      # questions of an id are one, a null id is nothing
            order = sorted((-round(float(q @ vector([t for _, t in v])) / (1 + 1e-9), 9), k) for k, v in chunks.items())
            want = [(k, -s) for s, k in order for _ in chunks[k]][:c.top_k]     # an id takes as many places as it has rows
            if name is None:
                assert (c.label, None) not in got                               # and joins no question
                continue
            own = got[c.label, name]
            assert {(k, round(s, 8)) for k, s, _, _ in own} == {(k, round(s, 8)) for k, s in want}
            assert all((d, t) in chunks[k] for k, _, d, t in own)
            asks = sum(i == name for i, _ in asked)
            assert len(own) == sum(len(chunks[k]) for k, _ in want) * asks      # every text of a hit, for every question of its id


def test_counts_travel_as_bits():
    rng = np.random.default_rng(7)
    for dim in (1, 5, 256, 300):
        c = rng.poisson(rng.choice([0, 0.1, 1.25, 5, 3000], 200)[:, None], (200, dim))
        c[0, 0] = 10 ** 7
        rows = retrieval._to_bits(c)
        assert np.array_equal(retrieval._from_bits([None, *rows], dim)[1:], c) and retrieval._from_bits([None], dim).sum() == 0
    assert max(map(len, retrieval._to_bits(rng.poisson(1.25, (50, 256))))) < 90
    grams = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in range(70)] * 2
    for dim in (256, 7, 2 ** 31 - 1):
        assert retrieval._buckets(pa.array(grams, pa.large_binary()), dim).tolist() == [int(hashlib.md5(g).hexdigest(), 16) % dim for g in grams]


def test_a_corpus_in_one_piece_is_dealt_out(spark):
    rows = [(f"d{i}", f"text {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert sweep.spread(docs) is docs
    dealt = sweep.spread(docs.coalesce(1))
    assert dealt.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, dealt.collect())) == sorted(rows)


def test_texts_of_hits_are_found_without_a_sort(spark):
    items = spark.createDataFrame([("a", "x y"), ("b", "z")], "item_id string, text string")
    hits = spark.createDataFrame([("q", "b", 0.5, 1)], "query_id string, item_id string, score double, rank int")
    r = retrieval.rerank(hits, spark.createDataFrame([("q", "z")], "query_id string, query string"), items)
    assert "ShuffledHashJoin" in _plan(r) and [(x.text, x.rank) for x in r.collect()] == [("z", 1)]


def test_blocks_grow_before_copies_do():
    assert retrieval._block_rows(1_000) == retrieval.BLOCK_ROWS
    assert math.ceil(200_000 / retrieval._block_rows(200_000)) <= retrieval.COPIES
    assert retrieval._block_rows(10 ** 9) == retrieval.MOST_BLOCK_ROWS


def test_tiles_find_the_same_neighbours_as_a_full_sort(monkeypatch):
    monkeypatch.setattr(retrieval, "TILE_ROWS", 64)
    rng = np.random.default_rng(1)
    q, c = rng.integers(-2, 3, (150, 4)).astype(float), rng.integers(-2, 3, (700, 4)).astype(float)
    c[::50] = np.nan
    cids = np.array([f"{i:05d}" for i in range(len(c))])
    got = retrieval._local_topk(np.arange(len(q)), q, cids, c, 4, 9, False)
    sims = np.round(q @ c.T / (np.outer(np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))) + 1e-9), 9)
    best = np.argsort(-sims, axis=1, kind="stable")[:, :4]
    assert got["item_id"].tolist() == cids[best.ravel()].tolist()
    assert np.array_equal(got["score"].to_numpy(), np.take_along_axis(sims, best, 1).ravel())


def test_evaluation_broadcasts_no_texts(spark):
    g = spark.createDataFrame([("q1", "s", "What?", "m", "It was a storm.", 3, 4, ["It was a storm. It rained."])],
                              "question_id string, storm_id string, question string, model string, answer string, "
                              "prompt_tokens int, completion_tokens int, contexts array<string>")
    rows = evaluate.evaluation_rows(g)
    assert "Broadcast" not in _plan(rows)
    assert [(r.groundedness, r.hallucinated) for r in rows.collect()] == [(1.0, None)]


def test_sentence_search_adds_up_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([("d1", "Hail fell. The roof made landfall there."), ("d2", "Hail fell. Roof."), ("d2", "Hail fell. Roof."),
                                  (None, "Hail roof hail.")], "doc_id string, text string")
    ask = spark.createDataFrame([("q1", "landfall roof"), ("q2", "hail"), ("q3", "nothing here"), (None, "roof")],
                                "query_id string, query string")
    monkeypatch.setattr(search, "QUESTION_ROWS", 2)
    monkeypatch.setattr(search, "SENTENCE_ROWS", 2)
    got = search.idf_search(ask, docs)
    assert "FlatMapGroupsInPandas" in _plan(got)                  # matches are summed in blocks, not shuffled as rows
    rows = {r.query_id: (r.doc_id, r.pos, r.sentence) for r in got.collect()}
    assert rows == {"q1": ("d2", 1, "Roof."), "q2": ("d2", 0, "Hail fell."), None: ("d2", 1, "Roof.")}


def test_sentence_scores_do_not_depend_on_tiles(monkeypatch):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(12)]
    held = pd.DataFrame([(f"d{i // 4:03d}", i % 4, bool(i % 3 == 0), " ".join(rng.choice(words, 3, replace=False))) for i in range(200)],
                        columns=["doc_id", "pos", "lf", "toks"])
    idf = {w: 1.0 + i / 7 for i, w in enumerate(words)}
    toks = [list(rng.choice(words, 4, replace=False)) for _ in range(9)]
    asked = pd.DataFrame({"query_id": range(9), "lf": [i % 2 == 0 for i in range(9)], "toks": [" ".join(t) for t in toks],
                          "idf": [[idf[x] for x in t] for t in toks]})
    whole = search._best_sentences(asked, held, 9)
    monkeypatch.setattr(search, "TILE_CELLS", 20)
    assert search._best_sentences(asked, held, 9) == whole
    for i, doc, pos, lf, score in whole:
        every = [(-round(sum(idf[x] for x in toks[i] if x in h.toks.split()) + 0.4 * (asked.lf[i] and h.lf), 9), h.doc_id, h.pos)
                 for h in held.itertuples()]
        assert min(every) == (-score, doc, pos)


def test_dense_stations_get_finer_cells_and_one_row_a_position(spark):
    rng = np.random.default_rng(3)
    st = [(int(i), 30.0 + float(a), -80.0 + float(b)) for i, (a, b) in enumerate(rng.random((400, 2)) * 0.2)]
    st += [(1000 + i, 35.0, -70.0) for i in range(300)] + [(5000, None, 1.0)]
    pts = [(int(i), 30.0 + float(a), -80.0 + float(b)) for i, (a, b) in enumerate(rng.random((60, 2)) * 0.2)] + [(900, 36.0, -69.0), (901, -20.0, 10.0)]
    s = spark.createDataFrame(st, "station_id int, lat double, lon double")
    p = spark.createDataFrame(pts, "place_id int, lat double, lon double")
    pos = s.select(F.col("lat").alias("_slat"), F.col("lon").alias("_slon")).distinct()
    assert spatial._finer(pos, 1.0, 16) and not spatial._finer(pos.filter("_slon > -75"), 1.0, 16)
    got = {r.place_id: r.station_id for r in spatial.nearest_station(p, s).collect()}

    def km(a, b):
        la, lo, lb, ln = map(math.radians, (*a, *b))
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ln - lo) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(h))

    known = [x for x in st if x[1] is not None]
    assert got == {i: min((round(km((a, b), x[1:]), 9), x[0]) for x in known)[1] for i, a, b in pts}


def test_a_day_of_the_feed_is_many_files(spark, tmp_path, monkeypatch):
    t = datetime.datetime(2024, 1, 1)
    rows = [(i, t + datetime.timedelta(hours=i % 30), i % 4, "click", float(i), '{"k": %d}' % (i % 7)) for i in range(200)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(
        str(tmp_path / "events.parquet"))
    monkeypatch.setattr(q_feeds, "FEED_ROWS", 20, raising=False)
    q_feeds._land_feed(spark, str(tmp_path), str(tmp_path / "feed"))
    files = list((tmp_path / "feed" / "day=2024-01-01").rglob("*.txt"))
    assert len(files) > 4 and max(len(f.read_text().splitlines()) for f in files) < 60
    got = q_feeds.active_storm_feed(spark, str(tmp_path)).collect()
    assert sorted(r.storm_id for r in got) == sorted(f"al{i}" for i in range(200))


def test_advisories_are_read_in_one_pass(spark, tmp_path):
    told = ['{"url": "u1", "n": [1, {"a": 2}]}', '"none"', "null", '"{\\"url\\": \\"u2\\"}"', '{"other": 1}', "7", "[1]"]
    (tmp_path / "t.json").write_text('{"activeStorms": [' + ", ".join(
        '{"id": "s%d", "publicAdvisory": %s}' % (i, v) for i, v in enumerate(told)) + "]}")
    got = {r.storm_id: r.advisory_url for r in feeds.read_active_storms(spark, str(tmp_path / "t.json")).collect()}
    assert got == {"s0": "u1", "s1": "", "s2": "", "s3": "u2", "s4": "", "s5": "", "s6": ""}
    assert "publicAdvisory variant" in feeds.FEED_STORM          # a string would read each object's place again


def _within(fixes, obs, hours=3.0, km=150.0):
    """The nearest observation of each fix by comparing all pairs."""
    out = {}
    for fid, ft, flat, flon in fixes:
        best = None
        for oid, ot, olat, olon in obs:
            a = (math.sin(math.radians(olat - flat) / 2) ** 2
                 + math.cos(math.radians(flat)) * math.cos(math.radians(olat)) * math.sin(math.radians(olon - flon) / 2) ** 2)
            d = 2 * 6371.0 * math.asin(math.sqrt(a))
            if abs((ot - ft).total_seconds()) <= hours * 3600 and d <= km:
                best = min(best or (round(d, 9), oid), (round(d, 9), oid))
        out[fid] = best and best[1]
    return out


def test_fixes_meet_places_not_observations(spark, monkeypatch):
    rng = np.random.default_rng(5)
    spots = [(25.0 + i / 7, 179.9 if i % 3 else -179.9) for i in range(6)]
    start = datetime.datetime(1969, 12, 31, 12)

    def rows(n, first, step):
        return [(first + i, start + datetime.timedelta(seconds=int(rng.integers(0, 86_400 // step)) * step),
                 *spots[int(rng.integers(0, len(spots)))]) for i in range(n)]

    fixes, obs = rows(60, 0, 3600), rows(400, 1000, 1800)       # many observations exactly 3 hours off
    obs += [(5000 + i, start + datetime.timedelta(days=3), 60.0 + i / 500, 10.0) for i in range(40)]   # a dense cell
    fixes += [(100, start + datetime.timedelta(days=3, hours=3), 60.0101, 10.0), (101, start + datetime.timedelta(days=3), 61.0, 10.0),
              (102, start + datetime.timedelta(days=3, hours=-3, seconds=-1), 60.0, 10.0), (103, start, -60.0, 10.0)]
    near, store = [], spatial.materialise

    def kept(df, name):
        out = store(df, name)
        if name == "near_places":
            near.append(out.count())
        return out

    monkeypatch.setattr(spatial, "materialise", kept)
    schema = "{} int, obs_time timestamp_ntz, lat double, lon double"
    got = spatial.nearest_within(spark.createDataFrame(fixes, schema.format("fix_id")),
                                 spark.createDataFrame(obs, schema.format("obs_id")))
    assert {r.fix_id: r.obs_id for r in got.collect()} == _within(fixes, obs)
    assert len(near) > 1 and sum(near) < 20 * len(fixes)        # all pairs in reach are about 90 a fix


def test_a_repeated_or_empty_fix_keeps_its_rows(spark):
    at = datetime.datetime(2024, 1, 1)
    fixes = [(1, at, 10.0, 10.0), (1, at, 10.5, 10.0), (2, None, 10.0, 10.0), (None, at, 10.0, 10.0)]
    obs = [(7, at, 10.4, 10.0), (8, at, 10.2, 10.0), (9, None, 10.5, 10.0), (3, at, None, 10.0)]
    schema = "{} int, obs_time timestamp_ntz, lat double, lon double"
    got = spatial.nearest_within(spark.createDataFrame(fixes, schema.format("fix_id")),
                                 spark.createDataFrame(obs, schema.format("obs_id")))
    assert sorted(((r.fix_id, r.obs_id) for r in got.collect()), key=str) == [(1, 7), (1, 7), (2, None), (None, None)]
