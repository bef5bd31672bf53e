"""Column functions for clocks, dates and time zones. The session zone must be UTC."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..defaults import LOCAL_ZONE


def local_date(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyyMMdd")


def effective_start_date(
    start_date: Column, vehicle_ts: Column, fetched_at: Column, zone: str = LOCAL_ZONE
) -> Column:
    """Service date of a ping: what the feed says, else the local date it was seen on."""
    return F.coalesce(start_date, local_date(vehicle_ts, zone), local_date(fetched_at, zone))


def gtfs_seconds(clock: Column) -> Column:
    """``HH:MM:SS`` with hours past 24 allowed, as seconds; anything else is null."""
    parts = F.split(F.trim(clock), ":")
    num = [parts[i].try_cast("int") for i in range(3)]
    return F.when(F.size(parts) == 3, num[0] * 3600 + num[1] * 60 + num[2])


def trip_start_utc(start_date: Column, start_time: Column, zone: str = LOCAL_ZONE) -> Column:
    """Instant of a scheduled start. The clock is added on the wall, then placed in the zone,
    so a 27:15 start and daylight-saving days come out as the timetable means them."""
    midnight = F.try_to_timestamp(start_date, F.lit("yyyyMMdd"))
    secs = F.coalesce(gtfs_seconds(start_time), F.lit(0))
    wall = F.timestamp_micros(F.unix_micros(midnight) + secs.cast("bigint") * 1_000_000)
    return F.to_utc_timestamp(wall, zone)


def epoch_to_utc(seconds: Column) -> Column:
    """Feed epoch seconds; the protocol's zero means unset."""
    return F.timestamp_seconds(F.nullif(seconds, F.lit(0)))


def local_minute(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    local = F.from_utc_timestamp(ts, zone)
    return F.hour(local) * 60 + F.minute(local) + F.second(local) / 60.0


def whole_seconds_between(later: Column, earlier: Column) -> Column:
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    return (micros / 1_000_000).cast("int")


def time_offset_seconds(ts: Column, trip_start: Column) -> Column:
    return whole_seconds_between(ts, trip_start)


def age_seconds(ts: Column, now: Column) -> Column:
    return whole_seconds_between(now, ts)


def day_angle(minute: Column) -> Column:
    return minute * (2.0 * math.pi / 1440.0)


def tod_sin(minute: Column) -> Column:
    return F.sin(day_angle(minute))


def tod_cos(minute: Column) -> Column:
    return F.cos(day_angle(minute))


def fetch_window(service_date, slack_hours: int = 6, zone: str = LOCAL_ZONE) -> tuple[Column, Column]:
    """UTC bounds ``[lo, hi)`` of fetch times that can hold a local service date. Both are
    foldable, so they reach the scan as literals and prune partitions."""
    day = F.to_timestamp(F.lit(str(service_date)))
    slack = F.make_dt_interval(F.lit(0), F.lit(slack_hours))
    lo = F.to_utc_timestamp(day, zone) - slack
    hi = F.to_utc_timestamp(day + F.make_dt_interval(F.lit(1)), zone) + slack
    return lo, hi


def tick_service_dates(now: Column, grace_hours: int = 1, zone: str = LOCAL_ZONE) -> Column:
    """Service dates a refresh at ``now`` must cover: today, and yesterday just after midnight."""
    local = F.from_utc_timestamp(now, zone)
    today = F.to_date(local)
    return F.when(F.hour(local) < grace_hours, F.array(F.date_sub(today, 1), today)).otherwise(
        F.array(today)
    )
