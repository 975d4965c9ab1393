from gtspark.operators import medallion
from gtspark.sources import hurdat2

RADII = ", ".join(["0"] * 12)
SAMPLE = f"""AL212031, ZEPHYRINE,  3,
20310802, 0000,  , TD, 14.1N,  41.7W,  30, 1007, {RADII}, 40
20310807, 2145, L, HU, 34.9N,  76.2W, 120,  944, {RADII}, 20
20310808, 0600,  , TS, 36.9N,  75.1W,  60,  988, {RADII}, 30

AL042027,          ,  2,
20270611, 1200,  , SS, 27.3N,  88.9W,  45, 1001, {RADII}, 25
20270612, 0000, L, TS, 29.8N,  90.4W,  40, -999, -999, {RADII[3:]},
EP172029, QUILLON,  1,
20290930, 1800,  , HU, 17.0N, 179.5E, 145,  915, {RADII}, 10
"""


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_parse_and_truth(spark, tmp_path):
    storms, points = hurdat2.read_hurdat2(spark, write(tmp_path, "track.txt", SAMPLE))
    got = {r.storm_id: (r.basin, r.cyclone_number, r.year, r.name) for r in storms.collect()}
    assert got == {"AL212031": ("AL", 21, 2031, "ZEPHYRINE"), "AL042027": ("AL", 4, 2027, "UNNAMED"),
                   "EP172029": ("EP", 17, 2029, "QUILLON")}
    assert points.count() == 6
    assert all(r.ok for r in hurdat2.count_check(storms, points).collect())
    truth = {r.storm_id: (r.landfall_category, r.peak_wind_kt, r.min_pressure_mb)
             for r in medallion.storm_truth(storms.select("storm_id", "name", "year"), points).collect()}
    assert truth == {"AL212031": (4, 120, 944), "AL042027": (None, 45, 1001), "EP172029": (None, 145, 915)}
    gap = points.filter("storm_id = 'AL042027' AND max_wind_kt = 40").first()
    assert gap.min_pressure_mb is None and gap.r34_ne is None and gap.rmw_nm is None
    assert points.filter("storm_id = 'EP172029'").first().lon == 179.5


def test_headers_stay_in_their_file(spark, tmp_path):
    write(tmp_path, "a.txt", SAMPLE)
    write(tmp_path, "b.txt", f"20310808, 1200,  , TS, 37.9N,  74.1W,  50,  990, {RADII}, 30\n")
    _, points = hurdat2.read_hurdat2(spark, str(tmp_path))
    assert points.count() == 6
    assert hurdat2.orphan_lines(spark, str(tmp_path)).count() == 1
    _, points = hurdat2.read_hurdat2(spark, str(tmp_path), continued=True)
    assert points.filter("storm_id = 'EP172029'").count() == 2
