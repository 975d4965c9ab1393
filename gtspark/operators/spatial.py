"""Nearest station (J6) and track/observation proximity.

Both are equi-joins on grid keys plus an exact residual test; no pair
outside a key's neighbourhood is ever formed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gtspark import config as C
from gtspark.functions.scalar import haversine_km
from gtspark.session import materialise

RANK_DIGITS = 9


def _cells(lat, lon, size):
    return (F.floor((lat + 90.0) / size).cast("int"), F.floor((lon + 180.0) / size).cast("int"))


def _guarantee_km(lat, size):
    """Lower bound of the distance from a point to anything outside its 3x3 cell block."""
    lat_part = F.lit(C.EARTH_RADIUS_KM * math.radians(size))
    lon_part = C.EARTH_RADIUS_KM * F.asin(F.cos(F.radians(F.least(F.abs(lat) + size, F.lit(90.0))))
                                          * F.lit(math.sin(math.radians(min(size, 90.0)))))
    return F.least(lat_part, lon_part)


STATIONS_PER_CELL = 16
FINEST = 8                   # halvings of a level that are looked at


def _finer(st: DataFrame, size: float, most: int) -> list[float]:
    """Levels below ``size``, the finest one with at most ``most`` positions to a cell as a position sees it."""
    sizes = [size / 2 ** i for i in range(FINEST + 1)]
    cell = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), *[c.alias(n) for c, n in zip(
        _cells(F.col("_slat"), F.col("_slon"), s), ("a", "o"))]) for i, s in enumerate(sizes)])).alias("c")
    held = (st.select(cell).filter("c.a IS NOT NULL AND c.o IS NOT NULL").groupBy("c").count()
            .groupBy("c.i").agg((F.sum(F.col("count") * F.col("count")) / F.sum("count")).alias("n")).collect())
    seen = {r["i"]: r["n"] for r in held}                        # one row a size
    first = next((i for i in range(FINEST + 1) if seen.get(i, 0) <= most), FINEST)
    return [sizes[i] for i in range(first, 0, -2)]


def nearest_station(points: DataFrame, stations: DataFrame, point_id: str = "place_id",
                    station_id: str = "station_id", levels=(1.0, 8.0, 30.0, 90.0, 180.0),
                    max_km: float | None = None, station_per_cell: int = STATIONS_PER_CELL) -> DataFrame:
    """Nearest station per point (ties: smaller station id); none -> NULL.

    Stations at one position are one candidate, that of the smallest id.  If
    the cells of the first level hold more than ``station_per_cell`` positions
    on the average of their positions, finer levels come before it.

    Multi-level grid: at each level points meet only the stations of their
    3x3 cell block (an equi-join on cell keys); a point is settled when its
    best candidate lies within the block's guaranteed radius, otherwise it
    moves to the next, coarser level.  Each level's result and the points it
    leaves are written once, and the levels end when no point is left.  The last
    level (180-degree cells) covers the globe, so every point is settled exactly.  ``max_km`` applies
    the 120 km rejection of the map-page variant.
    """
    st = stations.select(F.col(station_id).alias("_sid"), F.col("lat").alias("_slat"),
                         F.col("lon").alias("_slon"))
    st = materialise(st.groupBy("_slat", "_slon").agg(F.min(F.struct("_sid")).alias("_s"))
                     .select(F.col("_s._sid").alias("_sid"), "_slat", "_slon"), "stations")
    levels = (*_finer(st, levels[0], station_per_cell), *levels)
    todo = points.select(F.col(point_id).alias("_pid"), F.col("lat").alias("_plat"), F.col("lon").alias("_plon"))
    done = None
    for li, size in enumerate(levels):
        last = li == len(levels) - 1
        n_lon = int(math.ceil(360.0 / size))
        sa, so = _cells(F.col("_slat"), F.col("_slon"), size)
        sc = st.select("*", sa.alias("_ca"), F.pmod(so, F.lit(n_lon)).alias("_co"))
        pa, po = _cells(F.col("_plat"), F.col("_plon"), size)
        offs = F.array(*[F.struct(F.lit(a).alias("da"), F.lit(o).alias("do")) for a in (-1, 0, 1)
                         for o in (-1, 0, 1)])
        pk = (todo.select("*", F.explode(offs).alias("_o"))
              .select("_pid", "_plat", "_plon", (pa + F.col("_o.da")).alias("_ca"),
                      F.pmod(po + F.col("_o.do"), F.lit(n_lon)).alias("_co"))
              .dropDuplicates(["_pid", "_ca", "_co"]))
        cand = pk.join(sc, ["_ca", "_co"])
        d = haversine_km(F.col("_plat"), F.col("_plon"), F.col("_slat"), F.col("_slon"))
        best = (cand.select("_pid", "_plat", "_sid", d.alias("_d"))
                .groupBy("_pid", "_plat").agg(F.min_by(F.struct("_sid", "_d"),
                                                       F.struct(F.round("_d", RANK_DIGITS), "_sid")).alias("b")))
        if not last:
            best = best.filter(F.col("b._d") <= _guarantee_km(F.col("_plat"), size))
        settled = materialise(best.select("_pid", F.col("b._sid").alias("_sid"), F.col("b._d").alias("_d")), "settled")
        done = settled if done is None else done.unionByName(settled)
        if not last:
            todo = materialise(todo.join(settled.select("_pid"), "_pid", "left_anti"), "points")
            if todo.isEmpty():
                break
    out = points.select(F.col(point_id).alias("_pid")).join(done, "_pid", "left")
    if max_km is not None:
        keep = F.col("_d") <= max_km
        out = out.select("_pid", F.when(keep, F.col("_sid")).alias("_sid"), F.when(keep, F.col("_d")).alias("_d"))
    return out.select(F.col("_pid").alias(point_id), F.col("_sid").alias(station_id),
                      F.col("_d").alias("distance_km"))


def _finer_places(places: DataFrame, most: int) -> list[float]:
    """Levels for places of a time bucket (see ``_finer``): none where 1-degree cells of a bucket hold few."""
    sizes = [1.0 / 2 ** i for i in range(FINEST + 1)]
    cell = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), *[c.alias(n) for c, n in zip(
        _cells(F.col("_olat"), F.col("_olon"), s), ("a", "o"))]) for i, s in enumerate(sizes)])).alias("c")
    held = (places.select("_tb", cell).groupBy("_tb", "c").count()
            .groupBy("c.i").agg((F.sum(F.col("count") * F.col("count")) / F.sum("count")).alias("n")).collect())
    seen = {r["i"]: r["n"] for r in held}                        # one row a size
    first = next((i for i in range(FINEST + 1) if seen.get(i, 0) <= most), FINEST)
    return [sizes[i] for i in range(first, 0, -2)] + ([1.0] if first else [])


PLACES_PER_CELL = 4


def nearest_within(fixes: DataFrame, obs: DataFrame, hours: float = 3.0, km: float = 150.0,
                   fix_id: str = "fix_id", obs_id: str = "obs_id", places_per_cell: int = PLACES_PER_CELL) -> DataFrame:
    """Nearest observation within ``hours`` and ``km`` of each fix (else NULL).

    Observations at one position in one time bucket of ``hours`` are one
    place.  A fix meets places, not observations: all of a place in its own
    bucket are in time, of one in the bucket before or after those up to the
    time limit are, whose smallest id is a running minimum by time.

    Where the 1-degree cells of a bucket hold more than ``places_per_cell``
    places on the average of their places, finer cells come first: a fix is
    settled when its best candidate lies within the radius its 3x3 cells
    guarantee.  The rest use a latitude band of at least ``km`` and, within
    the band, a longitude cell at least as wide as ``km`` is anywhere in the
    band and its neighbours; the fix is replicated to the neighbouring keys
    (3 x 3 x at most 3).  Time and distance tests are exact.
    """
    span = int(hours * 3600) * 1_000_000
    band = max(km / 111.0, 0.5)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    fix = ["_fid", "_fus", "_flat", "_flon"]
    place = ["_tb", "_olat", "_olon"]

    def cells(lb):
        """Number of longitude cells of a band: one where a pole is near."""
        top = F.least(F.lit(90.0), F.greatest(F.abs((lb - 1) * band - 90.0), F.abs((lb + 2) * band - 90.0)))
        half = F.lit(math.sin(km / C.EARTH_RADIUS_KM / 2)) / F.greatest(F.cos(F.radians(top)), F.lit(1e-12))
        return F.when(half >= 1, F.lit(1)).otherwise(
            F.greatest(F.lit(1), F.floor(F.lit(360.0) / (2 * F.degrees(F.asin(F.least(half, F.lit(1.0)))))))).cast("int")

    def cell(lon, n):
        return F.pmod(F.floor((F.col(lon) + 180.0) / 360.0 * n).cast("int"), n)

    def bucket(us):
        return ((F.col(us) - F.pmod(F.col(us), F.lit(span))) / span).cast("long")

    def lat_band(lat):
        return F.floor((F.col(lat) + 90.0) / band)

    o = obs.select(F.struct(F.col(obs_id).alias("_oid")).alias("_o"),
                   F.timestamp_diff("MICROSECOND", epoch, F.col("obs_time")).alias("_ous"),
                   F.col("lat").alias("_olat"), F.col("lon").alias("_olon"))
    o = materialise(o.dropna(subset=["_ous", "_olat", "_olon"]).withColumn("_tb", bucket("_ous")), "observations")
    places = materialise(o.groupBy(*place).agg(F.min("_o").alias("_o"), F.min("_ous").alias("_first"),
                                               F.max("_ous").alias("_last")), "places")
    sides = F.explode(F.array(F.lit(1), F.lit(-1))).alias("_side")     # after the fix, and before it by mirrored times
    timed = o.select(*place, sides, "_ous", "_o").select(
        *place, "_side", (F.col("_side") * F.col("_ous")).alias("_t"), F.lit(0).alias("_kind"), "_o")

    def best_of(pairs):
        """Best candidate of each fix among (fix, place) pairs, whose places are at most one bucket off."""
        d = haversine_km(F.col("_flat"), F.col("_flon"), F.col("_olat"), F.col("_olon"))
        side = (F.col("_tb") - bucket("_fus")).cast("int")
        low, high = F.col("_fus") - span, F.col("_fus") + span
        near = (pairs.withColumn("_d", d).filter(F.col("_d") <= km).withColumn("_side", side)
                .filter((F.col("_first") <= high) & (F.col("_last") >= low))
                .withColumn("_whole", (F.col("_first") >= low) & (F.col("_last") <= high)))
        near = materialise(near.select(*fix, *place, "_d", "_side", "_whole", "_o"), "near_places")
        asks = near.filter(~F.col("_whole")).select(
            *place, "_side", (F.col("_side") * F.col("_fus") + span).alias("_t"), F.lit(1).alias("_kind"),
            F.lit(None).cast(near.schema["_o"].dataType).alias("_o"), *[c for c in fix], "_d")
        w = (Window.partitionBy("_side", *place).orderBy("_t", "_kind")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        partly = (timed.unionByName(asks, allowMissingColumns=True).withColumn("_o", F.min("_o").over(w))
                  .filter((F.col("_kind") == 1) & F.col("_o").isNotNull()))
        cand = near.filter("_whole").select(*fix, "_d", "_o").unionByName(partly.select(*fix, "_d", "_o"))
        return cand.groupBy(*fix).agg(F.min_by(F.struct(F.col("_o._oid").alias("_oid"), "_d"),
                                               F.struct(F.round("_d", RANK_DIGITS), F.col("_o"))).alias("b"))

    f = fixes.select(F.col(fix_id).alias("_fid"), F.timestamp_diff("MICROSECOND", epoch, F.col("obs_time")).alias("_fus"),
                     F.col("lat").alias("_flat"), F.col("lon").alias("_flon"))
    todo, done = f.dropna().distinct(), None
    steps = [(a, b, t) for a in (-1, 0, 1) for b in (-1, 0, 1) for t in (-1, 0, 1)]
    offs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(t).alias("t")) for a, b, t in steps])
    for size in _finer_places(places, places_per_cell):
        n_lon = int(math.ceil(360.0 / size))
        oa, oo = _cells(F.col("_olat"), F.col("_olon"), size)
        fa, fo = _cells(F.col("_flat"), F.col("_flon"), size)
        around = places.select("*", F.explode(offs).alias("_s")).select(
            "*", (F.col("_tb") + F.col("_s.t")).alias("_b"), (oa + F.col("_s.a")).alias("_ca"),
            F.pmod(oo + F.col("_s.b"), F.lit(n_lon)).alias("_co")).drop("_s")
        keyed = todo.select("*", bucket("_fus").alias("_b"), fa.alias("_ca"), F.pmod(fo, F.lit(n_lon)).alias("_co"))
        best = best_of(keyed.join(around, ["_b", "_ca", "_co"]))
        settled = materialise(best.filter(F.col("b._d") <= _guarantee_km(F.col("_flat"), size) - 1e-6), "settled")
        done = settled if done is None else done.unionByName(settled)
        todo = materialise(todo.join(settled.select(*fix), fix, "left_anti"), "fixes")
    banded = places.withColumn("_lb", lat_band("_olat")).withColumn("_lc", cell("_olon", cells(F.col("_lb"))))
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("dt"), F.lit(b).alias("dl")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    keyed = (todo.select("*", around.alias("_s"))
             .withColumn("_tb", bucket("_fus") + F.col("_s.dt")).withColumn("_lb", lat_band("_flat") + F.col("_s.dl"))
             .drop("_s").withColumn("_n", cells(F.col("_lb"))).withColumn("_c", cell("_flon", F.col("_n")))
             .withColumn("_lc", F.explode(F.array_distinct(F.array(*[F.pmod(F.col("_c") + i, F.col("_n")) for i in (-1, 0, 1)]))))
             .drop("_n", "_c"))
    rest = best_of(keyed.join(banded, ["_tb", "_lb", "_lc"]))
    done = rest if done is None else done.unionByName(rest)
    best = done.groupBy("_fid").agg(F.min_by("b", F.struct(F.round("b._d", RANK_DIGITS), F.col("b._oid"))).alias("b"))
    return (f.select("_fid").join(best, "_fid", "left")
            .select(F.col("_fid").alias(fix_id), F.col("b._oid").alias(obs_id), F.col("b._d").alias("distance_km")))
