"""Scalar column expressions (all JVM-side, inside whole-stage codegen).

Each helper takes and returns ``Column`` objects, so they compose into any
projection, filter or join condition without a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gtspark import config as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def saffir_simpson(wind_kt) -> Column:
    """Category 0-5 from 1-minute wind in knots; NULL stays NULL."""
    w = _col(wind_kt)
    expr = F.when(w.isNull(), F.lit(None).cast("int"))
    for floor, cat in C.SAFFIR_SIMPSON_KT:
        expr = expr.when(w >= floor, F.lit(cat))
    return expr.otherwise(F.lit(0))


def signed_coord(token) -> Column:
    """P2: '29.1N' -> 29.1, '90.2W' -> -90.2 (S and W negative)."""
    t = F.trim(_col(token))
    hemi = F.upper(F.substring(t, -1, 1))
    val = F.substring(t, F.lit(1), F.length(t) - 1).try_cast("double")
    return F.when(hemi.isin("S", "W"), -val).otherwise(val)


def missing_int(token, missing=C.INT_MISSING) -> Column:
    """Trimmed token, sentinel codes -> NULL, else integer (bad text -> NULL)."""
    t = F.trim(_col(token))
    return F.when(t.isin(*missing) | t.isNull(), F.lit(None).cast("int")).otherwise(t.try_cast("int"))


def missing_double(token, missing=C.BUOY_MISSING) -> Column:
    """Trimmed token, sentinel codes -> NULL, unparsable -> NULL."""
    t = F.trim(_col(token))
    return F.when(t.isin(*missing) | t.isNull(), F.lit(None).cast("double")).otherwise(t.try_cast("double"))


def fix_time(date_token, time_token) -> Column:
    """P5: 'yyyyMMdd' + 'HHmm' -> timestamp (UTC wall clock, no zone)."""
    s = F.concat(F.trim(_col(date_token)), F.lpad(F.trim(_col(time_token)), 4, "0"))
    return F.try_to_timestamp(s, F.lit("yyyyMMddHHmm")).cast("timestamp_ntz")


def status_label(code) -> Column:
    """Status code -> text; unknown -> NULL."""
    m = F.create_map(*[F.lit(x) for kv in C.STATUS_LABELS.items() for x in kv])
    return F.try_element_at(m, F.upper(F.trim(_col(code))))


def in_box(lat, lon, box) -> Column:
    """P10: inclusive box test, box = (lat_min, lat_max, lon_min, lon_max)."""
    la, lo = _col(lat), _col(lon)
    return la.between(box[0], box[1]) & lo.between(box[2], box[3])


def haversine_km(lat1, lon1, lat2, lon2, radius=C.EARTH_RADIUS_KM) -> Column:
    """Great-circle distance in km."""
    p1, p2 = F.radians(_col(lat1)), F.radians(_col(lat2))
    dphi = p2 - p1
    dlmb = F.radians(_col(lon2)) - F.radians(_col(lon1))
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlmb / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(a))


def metres_to_feet(c) -> Column:
    """Metres -> feet, one decimal."""
    return F.round(_col(c) * 3.281, 1)


def celsius_to_fahrenheit(c) -> Column:
    """Celsius -> Fahrenheit, one decimal."""
    return F.round(_col(c) * 9.0 / 5.0 + 32.0, 1)


def reward(groundedness, hallucinated) -> Column:
    """Groundedness minus 1 when the structured check says TRUE."""
    return _col(groundedness) - F.when(F.coalesce(_col(hallucinated), F.lit(False)), 1.0).otherwise(0.0)


def title_name(name) -> Column:
    """Title case of a name."""
    return F.initcap(F.lower(_col(name)))


def claimed_category(answer) -> Column:
    """First 'category N' (N in 1-5); else first spelled 'category one..five'; else NULL."""
    a = _col(answer)
    digit = F.regexp_extract(a, r"(?i)categor(?:y|ies)\s*([1-5])", 1)
    word = F.lower(F.regexp_extract(a, r"(?i)categor(?:y|ies)\s+(one|two|three|four|five)", 1))
    words = F.create_map(*[F.lit(x) for kv in C.CATEGORY_WORDS.items() for x in kv])
    return F.coalesce(F.nullif(digit, F.lit("")).cast("int"), F.try_element_at(words, word))


def hallucination_flag(claimed, expected) -> Column:
    """TRUE/FALSE only when both the claim and the expected value exist."""
    return _col(claimed) != _col(expected)
