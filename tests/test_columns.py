"""Clock, text and geometry columns on golden values."""

import math

import pytest
from pyspark.sql import functions as F

from tramline.functions import geo, times, values


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def ts(text):
    return F.lit(text).cast("timestamp")


@pytest.mark.parametrize("clock,seconds", [("08:06:30", 29190), ("25:15:00", 90900), ("bogus", None), ("1:2", None), (" 7:00:00 ", 25200)])
def test_gtfs_seconds(spark, clock, seconds):
    assert one(spark, times.gtfs_seconds(F.lit(clock)))[0] == seconds


@pytest.mark.parametrize(
    "date,clock,utc",
    [
        ("20260115", "08:00:00", "2026-01-15 13:00:00"),  # winter, five hours behind
        ("20260715", "08:00:00", "2026-07-15 12:00:00"),  # summer, four hours behind
        ("20260115", "27:15:00", "2026-01-16 08:15:00"),  # past midnight
        ("20260115", None, "2026-01-15 05:00:00"),
        ("20260308", "08:00:00", "2026-03-08 12:00:00"),  # clocks jump ahead at 02:00
        ("garbage", "08:00:00", None),
    ],
)
def test_trip_start(spark, date, clock, utc):
    got = one(spark, times.trip_start_utc(F.lit(date), F.lit(clock).cast("string")).cast("string"))[0]
    assert got == utc


def test_epoch_zero_is_unset(spark):
    row = one(spark, times.epoch_to_utc(F.lit(0)), times.epoch_to_utc(F.lit(1_700_000_000)).cast("string"))
    assert row[0] is None and row[1] == "2023-11-14 22:13:20"


@pytest.mark.parametrize(
    "local_now,dates",
    [
        ("2026-06-10 14:30:00", ["2026-06-10"]),
        ("2026-06-10 00:02:00", ["2026-06-09", "2026-06-10"]),
        ("2026-06-10 00:59:59", ["2026-06-09", "2026-06-10"]),
        ("2026-06-10 01:00:00", ["2026-06-10"]),
        ("2026-07-01 00:30:00", ["2026-06-30", "2026-07-01"]),
    ],
)
def test_refresh_dates(spark, local_now, dates):
    now = F.to_utc_timestamp(ts(local_now), "America/Toronto")
    assert [str(x) for x in one(spark, times.tick_service_dates(now))[0]] == dates


def test_fetch_window_follows_local_midnight(spark):
    lo, hi = times.fetch_window("2026-07-01")
    row = one(spark, lo.cast("string"), hi.cast("string"))
    assert (row[0], row[1]) == ("2026-06-30 22:00:00", "2026-07-02 10:00:00")


def test_scraped_text(spark):
    row = one(
        spark,
        values.distance_text_m(F.lit("136m")), values.distance_text_m(F.lit("3.4km")), values.distance_text_m(F.lit(" 240 ")),
        values.distance_text_m(F.lit("")), values.offset_text_s(F.lit("1:46")), values.offset_text_s(F.lit("1:01:46")),
        values.last_bracketed(F.lit("['5:23:15AM', '5:23:45AM']")),
        values.date_and_clock(F.lit("29_2023-01-01"), F.lit("9:09:17AM")).cast("string"),
        values.date_and_clock(F.lit("29_2023-01-01"), F.lit("12:05:00AM")).cast("string"),
    )
    assert list(row) == [136.0, 3400.0, 240.0, None, 106, 3706, "5:23:45AM", "2023-01-01 09:09:17", "2023-01-01 00:05:00"]


def test_occupancy(spark):
    row = one(spark, *[values.occupancy_pct(F.lit(s).cast("string")) for s in ("full", "EMPTY", "NO_DATA_AVAILABLE", None)])
    assert list(row) == [100, 0, -1, -1]


def test_no_leader_gap_is_not_scaled(spark):
    row = one(spark, values.descale_gap(F.lit(20000.0), F.lit(1.38)), values.descale_gap(F.lit(138.0), F.lit(1.38)))
    assert row[0] == 20000.0 and row[1] == pytest.approx(100.0)


def test_projection(spark):
    x, y = geo.utm_xy(F.lit(-79.3871), F.lit(43.6426))
    lon, lat = geo.utm_lonlat(x, y)
    row = one(spark, x, y, lon, lat)
    assert row[0] == pytest.approx(630087.375, abs=0.01) and row[1] == pytest.approx(4833442.312, abs=0.01)
    assert row[2] == pytest.approx(-79.3871, abs=1e-9) and row[3] == pytest.approx(43.6426, abs=1e-9)


def test_haversine_quarter(spark):
    got = one(spark, geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.0)))[0]
    assert got == pytest.approx(geo.EARTH_RADIUS_M * math.pi / 2)
