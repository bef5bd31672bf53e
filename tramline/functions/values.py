"""Column functions for measures, vocabularies and scraped text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..defaults import NO_LEADER_GAP_M

# Coarse load in percent per occupancy name of the public feed format.
OCCUPANCY_PCT = {
    "EMPTY": 0,
    "MANY_SEATS_AVAILABLE": 25,
    "FEW_SEATS_AVAILABLE": 55,
    "STANDING_ROOM_ONLY": 75,
    "CRUSHED_STANDING_ROOM_ONLY": 95,
    "FULL": 100,
    "NOT_ACCEPTING_PASSENGERS": 100,
}


def occupancy_pct(status: Column) -> Column:
    pairs = [F.lit(x) for kv in OCCUPANCY_PCT.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.upper(status)), F.lit(-1))


def round2(col: Column) -> Column:
    """Half-even to two places, computed the way array libraries do (scale, round, unscale)."""
    return F.rint(col * 100) / 100


def mercator_scale(lat_deg: Column) -> Column:
    """True metres to the inflated metres of a web-mercator model."""
    return 1.0 / F.cos(F.radians(lat_deg))


def descale_gap(gap: Column, scale: Column) -> Column:
    """Back to true metres; the no-leader value is not a distance and stays."""
    return F.when(gap >= NO_LEADER_GAP_M, gap).otherwise(gap / scale)


def speed_kph(mps: Column) -> Column:
    return F.rint(F.coalesce(mps, F.lit(0.0)) * 3.6 * 10) / 10


def distance_text_m(text: Column) -> Column:
    """``136m``, ``3.4km`` or a bare number, in metres."""
    s = F.lower(F.trim(text))
    num = F.regexp_extract(s, r"^(-?\d+(?:\.\d+)?)\s*(?:km|m)?$", 1).try_cast("double")
    return F.when(F.endswith(s, F.lit("km")), num * 1000.0).otherwise(num)


def offset_text_s(text: Column) -> Column:
    """``mm:ss`` or ``hh:mm:ss`` as seconds."""
    p = F.split(F.trim(text), ":")
    n = [p[i].try_cast("int") for i in range(3)]
    return F.when(F.size(p) == 2, n[0] * 60 + n[1]).when(
        F.size(p) == 3, n[0] * 3600 + n[1] * 60 + n[2]
    )


def is_bracketed(text: Column) -> Column:
    return F.trim(text).startswith("[") & F.trim(text).endswith("]")


def last_bracketed(text: Column) -> Column:
    """Last entry of ``['a', 'b']``; a plain value passes through."""
    inner = F.split(F.regexp_replace(F.trim(text), r"^\[|\]$|['\"]", ""), ",")
    return F.when(is_bracketed(text), F.trim(F.element_at(inner, -1))).otherwise(text)


def date_and_clock(route_date: Column, clock: Column) -> Column:
    """Date after the last underscore of a folder name plus a 12-hour clock."""
    day = F.substring_index(route_date, "_", -1)
    both = F.concat_ws(" ", day, F.upper(F.regexp_replace(clock, r"\s+", "")))
    return F.try_to_timestamp(both, F.lit("yyyy-MM-dd h:mm:ssa"))


def stable_config_key(config_json: Column, volatile: str) -> Column:
    """A configuration as text without one volatile key, keys in order."""
    m = F.map_filter(F.from_json(config_json, "map<string,string>"), lambda k, v: k != F.lit(volatile))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
