"""Storm-truth and catalogue queries on the binding views."""

from __future__ import annotations

from pyspark.sql import functions as F

from gtspark import config as C
from gtspark.operators import medallion
from gtspark.plans.registry import register
from gtspark.plans.views import v_points, v_storms, with_views
from gtspark.session import scratch_path


def truth_df(spark, sf_dir):
    """The ground-truth table over every storm of v_storms, also those without a fix."""
    return medallion.storm_truth(v_storms(spark, sf_dir), v_points(spark, sf_dir))


_CAT_SQL = """CASE WHEN {w} IS NULL THEN NULL WHEN {w} >= 137 THEN 5 WHEN {w} >= 113 THEN 4
  WHEN {w} >= 96 THEN 3 WHEN {w} >= 83 THEN 2 WHEN {w} >= 64 THEN 1 ELSE 0 END"""


def cat_sql(w: str) -> str:
    return _CAT_SQL.format(w=w)


TRUTH_BODY = f"""
storm_truth AS (
  SELECT st.storm_id, st.name, st.year,
         (arg_min({{'c': {cat_sql('fix.max_wind_kt')}}}, (fix.obs_time, fix.line_no))
            FILTER (fix.record_id = 'L' AND fix.lat BETWEEN 33.5 AND 36.8 AND fix.lon BETWEEN -78.7 AND -75.3)).c
           AS landfall_category,
         max(fix.max_wind_kt) AS peak_wind_kt, min(fix.min_pressure_mb) AS min_pressure_mb
  FROM v_storms st LEFT JOIN v_points fix USING (storm_id)
  GROUP BY ALL)"""


def truth_sql(select: str) -> str:
    return with_views("", "v_points", "v_storms").rstrip() + "," + TRUTH_BODY + "\n" + select


@register("storm_truth", truth_sql("SELECT * FROM storm_truth"))
def storm_truth(spark, sf_dir):
    """The ground-truth table."""
    return truth_df(spark, sf_dir)


# ---------------------------------------------------------------------------
# Catalogue
# ---------------------------------------------------------------------------

from gtspark.operators import catalogue  # noqa: E402

_NOTABLE_SQL = ", ".join(f"'{n}'" for n in C.NOTABLE_NAMES)
_REGION_SQL = """region AS (
  SELECT * FROM v_storms WHERE storm_id IN (
    SELECT storm_id FROM v_points WHERE lat BETWEEN 31.0 AND 37.8 AND lon BETWEEN -82.5 AND -73.0))"""


def _pts_sql(body: str) -> str:
    return with_views(body, "v_points", "v_storms")


@register("track_category", _pts_sql(f"""
SELECT storm_id, line_no, obs_time, max_wind_kt, {cat_sql('max_wind_kt')} AS saffir_simpson FROM v_points"""))
def track_category(spark, sf_dir):
    """P1 silver step: category per fix."""
    return (medallion.with_category(v_points(spark, sf_dir))
            .select("storm_id", "line_no", "obs_time", "max_wind_kt", "saffir_simpson"))


@register("region_storms", _pts_sql(f""", {_REGION_SQL}
SELECT storm_id, name, year FROM region"""))
def region_storms(spark, sf_dir):
    """F2 + P10: storms touching the Carolina box."""
    return catalogue.region_storms(v_storms(spark, sf_dir), v_points(spark, sf_dir))


@register("storm_cards", _pts_sql(f""", {_REGION_SQL},
track AS (SELECT *, {cat_sql('max_wind_kt')} AS cat FROM v_points WHERE max_wind_kt IS NOT NULL),
lf AS (SELECT storm_id, cat, ROW_NUMBER() OVER (PARTITION BY storm_id ORDER BY obs_time, line_no) AS rn
       FROM track WHERE record_id = 'L' AND round(lat, 1) BETWEEN 33.5 AND 36.8
                                        AND round(lon, 1) BETWEEN -78.7 AND -75.3),
agg AS (SELECT storm_id, MAX(max_wind_kt) AS peak_wind, MIN(min_pressure_mb) AS min_pres,
               MAX(cat) AS peak_cat, COUNT(*) AS n_track FROM track GROUP BY storm_id)
SELECT r.storm_id AS id, upper(substr(r.name, 1, 1)) || lower(substr(r.name, 2)) AS name, r.year,
       a.peak_wind, a.min_pres, a.peak_cat, lf.cat AS landfall_cat, a.n_track
FROM region r JOIN agg a ON a.storm_id = r.storm_id
LEFT JOIN lf ON lf.storm_id = r.storm_id AND lf.rn = 1"""))
def storm_cards(spark, sf_dir):
    """A14 + P17: cards of the region's storms."""
    pts = v_points(spark, sf_dir)
    region = catalogue.region_storms(v_storms(spark, sf_dir), pts)
    return catalogue.storm_cards(region, pts)


@register("notable_quota", _pts_sql(f""", {_REGION_SQL},
flagged AS (SELECT *, upper(name) IN ({_NOTABLE_SQL}) AS notable FROM region)
SELECT storm_id, name, year FROM flagged WHERE notable
UNION ALL
SELECT storm_id, name, year FROM (
  SELECT *, ROW_NUMBER() OVER (ORDER BY year DESC, storm_id) AS rn FROM flagged
  WHERE notable IS NOT TRUE)
WHERE rn <= greatest(0, {C.CATALOGUE_MAX} - (SELECT COUNT(*) FROM flagged WHERE notable))"""))
def notable_quota(spark, sf_dir):
    """O1 + O2: notable-first catalogue selection (cap 90)."""
    pts = v_points(spark, sf_dir)
    return catalogue.notable_quota(catalogue.region_storms(v_storms(spark, sf_dir), pts))


@register("track_fields", _pts_sql(f"""
SELECT storm_id, seq, round(lat, 1) AS lat, round(lon, 1) AS lon, max_wind_kt AS wind,
       min_pressure_mb AS pres, cat, strftime(obs_time, '%Y-%m-%d %HZ') AS time,
       coalesce(record_id = 'L', FALSE) AS landfall,
       CASE WHEN cat = 0 THEN 'TS' ELSE 'C' || CAST(cat AS VARCHAR) END AS label, seq * 6 AS hours
FROM (SELECT *, {cat_sql('max_wind_kt')} AS cat,
             ROW_NUMBER() OVER (PARTITION BY storm_id ORDER BY obs_time, line_no) - 1 AS seq
      FROM v_points WHERE max_wind_kt IS NOT NULL)"""))
def track_fields(spark, sf_dir):
    """Flattened card tracks."""
    return catalogue.track_rows(v_points(spark, sf_dir))


_CARD_TRACK_SQL = f"""
fx AS (SELECT storm_id, row_number() OVER (PARTITION BY storm_id ORDER BY obs_time, line_no) - 1 AS seq, round(lat, 1) AS lat,
              round(lon, 1) AS lon, max_wind_kt AS wind, min_pressure_mb AS pres, {cat_sql('max_wind_kt')} AS cat,
              strftime(obs_time, '%Y-%m-%d %HZ') AS time, coalesce(record_id = 'L', FALSE) AS landfall
       FROM v_points WHERE max_wind_kt IS NOT NULL),
recs AS (SELECT storm_id, (seq // 50)::INTEGER AS part, count(*) AS n_fixes,
                sha256(string_agg(concat_ws('|', seq, (lat * 10)::BIGINT, (lon * 10)::BIGINT, wind, coalesce(pres::VARCHAR, '-'),
                                            cat, time, landfall), chr(10) ORDER BY seq)) AS track_sha256
         FROM fx GROUP BY 1, 2)"""


@register("card_export", _pts_sql(f""", {_REGION_SQL}, {_CARD_TRACK_SQL},
agg AS (SELECT storm_id, max(wind) AS peak_wind, max(cat) AS peak_cat, count(*) AS n_track FROM fx GROUP BY 1)
SELECT r.storm_id AS id, upper(substr(r.name, 1, 1)) || lower(substr(r.name, 2)) AS name, r.year, a.peak_wind, a.peak_cat, a.n_track,
       recs.part, recs.n_fixes, recs.track_sha256
FROM region r JOIN agg a USING (storm_id) JOIN recs USING (storm_id)"""))
def card_export(spark, sf_dir):
    """A14 SNK9: cards with nested tracks, 50 fixes a record, exported as JSON and read back."""
    pts, path = v_points(spark, sf_dir), scratch_path(spark, "cards")
    cards = catalogue.storm_cards(catalogue.region_storms(v_storms(spark, sf_dir), pts), pts)
    catalogue.export_cards(cards, catalogue.track_rows(pts), path, fixes=50)
    tenth = lambda c: F.round(c * 10).cast("long").cast("string")
    line = F.transform("track", lambda t: F.concat_ws(
        "|", t["seq"].cast("string"), tenth(t["lat"]), tenth(t["lon"]), t["wind"].cast("string"),
        F.coalesce(t["pres"].cast("string"), F.lit("-")), t["cat"].cast("string"), t["time"], t["landfall"].cast("string")))
    return catalogue.read_cards(spark, path).select(
        "id", "name", "year", "peak_wind", "peak_cat", "n_track", "part", F.size("track").cast("long").alias("n_fixes"),
        F.sha2(F.array_join(line, "\n"), 256).alias("track_sha256"))


@register("catalogue_filter", _pts_sql(f""", {_REGION_SQL},
agg AS (SELECT storm_id, max({cat_sql('max_wind_kt')}) AS peak_cat FROM v_points WHERE max_wind_kt IS NOT NULL GROUP BY 1)
SELECT r.storm_id AS id, r.year, a.peak_cat FROM region r JOIN agg a USING (storm_id)
WHERE a.peak_cat >= 3 AND r.year BETWEEN 1985 AND 2015 AND contains(lower(r.name), '1')"""))
def catalogue_filter(spark, sf_dir):
    """cards by year bounds, least category and part of the name."""
    pts = v_points(spark, sf_dir)
    cards = catalogue.storm_cards(catalogue.region_storms(v_storms(spark, sf_dir), pts), pts)
    return catalogue.filter_catalogue(cards, 1985, 2015, 3, " 1 ").select("id", "year", "peak_cat")
