"""Silver and gold steps: category per fix, storm truth, corpus, narrative links.

P1 A1 W1 J1 J2 U1 F1 F4 F6.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gtspark import config as C
from gtspark.functions.scalar import in_box, saffir_simpson


def with_category(points: DataFrame, wind_col: str = "max_wind_kt") -> DataFrame:
    """Silver: add ``saffir_simpson`` (P1) as a codegen CASE, not a UDF."""
    return points.withColumn("saffir_simpson", saffir_simpson(wind_col))


def landfall_fixes(points: DataFrame, box=C.NC_BOX) -> DataFrame:
    """fixes marked 'L' inside the box (pushes down to the scan)."""
    return points.filter((F.col("record_id") == "L") & in_box("lat", "lon", box))


def storm_facts(points: DataFrame, box=C.NC_BOX, key: str = "storm_id") -> DataFrame:
    """A1 + W1 in one aggregation per storm.

    peak wind / lowest pressure and the category of the first in-box landfall
    (earliest obs_time, line order breaking ties).  ``min_by`` on a struct is
    a declarative aggregate, so it runs as a partial (map-side) + final hash
    aggregate: a storm holding a third of all fixes is pre-reduced in every
    task before the shuffle, unlike a ROW_NUMBER window which would sort the
    whole group in one task.
    """
    is_lf = (F.col("record_id") == "L") & in_box("lat", "lon", box)
    order = F.when(is_lf, F.struct(F.col("obs_time"), F.col("line_no")))
    return (points.groupBy(key).agg(
        F.max("max_wind_kt").alias("peak_wind_kt"),
        F.min("min_pressure_mb").alias("min_pressure_mb"),
        F.min_by(saffir_simpson("max_wind_kt"), order).alias("landfall_category"),
    ))


def storm_truth(storms: DataFrame, points: DataFrame, box=C.NC_BOX) -> DataFrame:
    """Storms left-joined with their facts -> the 6-column gold table."""
    facts = storm_facts(points, box)
    return (storms.join(facts, "storm_id", "left")
            .select("storm_id", "name", "year", "landfall_category", "peak_wind_kt", "min_pressure_mb"))


def event_corpus(*docs: DataFrame, id_col: str = "doc_id", text_col: str = "document") -> DataFrame:
    """U1 + F4: UNION ALL of (id, text) frames, empty texts dropped."""
    out = None
    for d in docs:
        d = d.select(F.col(d.columns[0]).cast("string").alias(id_col), F.col(d.columns[1]).alias(text_col))
        out = d if out is None else out.unionByName(d)
    return out.filter(F.col(text_col).isNotNull() & (F.length(text_col) > 0))


def link_narratives(events: DataFrame, storms: DataFrame, whole_word: bool = False,
                    narrative_col: str = "event_narrative", year_col: str = "year",
                    name_col: str = "name", id_col: str = "storm_id") -> DataFrame:
    """Left join events to storms of the same year whose name appears in the narrative.

    The year equality is the hash key (no nested loop); the containment is a
    residual condition evaluated per candidate.  ``whole_word`` requires word
    boundaries so IDA does not match FLORIDA.
    """
    s = storms.select(F.col(id_col).alias("linked_storm_id"), F.col(name_col).alias("_name"),
                      F.col(year_col).alias("_syear"))
    # upper-case each narrative once, before the join, not once per candidate pair
    events = events.withColumn("_up", F.upper(F.col(narrative_col)))
    up = F.col("_up")
    if whole_word:
        cond = F.regexp_like(up, F.concat(F.lit("\\b\\Q"), F.col("_name"), F.lit("\\E\\b")))
    else:
        cond = up.contains(F.col("_name"))
    j = events.join(s, (F.col(year_col) == F.col("_syear")) & cond, "left")
    return j.drop("_name", "_syear", "_up")
