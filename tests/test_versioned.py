"""The versioned table: what readers see between steps and after a crash, and runs of service dates on it."""

import threading
from datetime import date

import pytest
from pyspark.sql import functions as F

from tramline.plans import catalog, trajectories
from tramline.sources import store, timetable, versioned
from tramline.streaming import jobs

SCHEMA = "trip_id string, start_date string, service_date date, n int"


def rows(spark, *items):
    return spark.createDataFrame([(t, f"202601{d:02d}", date(2026, 1, d), n) for t, d, n in items], SCHEMA)


def seen(df):
    return sorted((r.trip_id, r.n) for r in df.collect())


def test_old_versions_stay_readable_until_vacuum(spark, tmp_path):
    path = f"{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        store.read_trajectories(spark, path)
    assert store.write_trajectories_replace(rows(spark, ("a", 5, 1), ("b", 5, 2), ("c", 6, 3)), path) == 1
    early = store.read_trajectories(spark, path)
    assert store.write_trajectories_replace(rows(spark, ("a", 5, 9)), path) == 2
    assert seen(early) == seen(store.read_trajectories(spark, path, 1)) == [("a", 1), ("b", 2), ("c", 3)]
    assert seen(store.read_trajectories(spark, path)) == [("a", 9), ("b", 2), ("c", 3)]
    untouched = versioned.manifest(spark, path, 1)["days"]["2026-01-06"]
    assert versioned.manifest(spark, path)["days"]["2026-01-06"] == untouched  # the other day's files are the same
    versioned.vacuum(spark, path, keep=1)
    assert versioned.versions(spark, path) == [2] and seen(store.read_trajectories(spark, path)) == [("a", 9), ("b", 2), ("c", 3)]
    with pytest.raises(FileNotFoundError):
        store.read_trajectories(spark, path, 1)
    assert store.read_trajectories(spark, path).schema == rows(spark, ("a", 5, 1)).schema


def test_a_crash_before_the_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    store.write_trajectories_replace(rows(spark, ("a", 5, 1), ("c", 6, 3)), path)

    def crash(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(versioned, "_publish", crash)
        keys = spark.createDataFrame([("a", "20260105"), ("c", "20260106")], "trip_id string, start_date string")
        with pytest.raises(RuntimeError, match="lost"):
            store.write_trajectories_replace(rows(spark, ("a", 5, 9)), path, keys)
    assert seen(store.read_trajectories(spark, path)) == [("a", 1), ("c", 3)]
    store.write_trajectories_replace(rows(spark, ("a", 5, 9)), path, keys)  # run again: both days change together
    assert seen(store.read_trajectories(spark, path)) == [("a", 9)]
    versioned.vacuum(spark, path, keep=1)
    assert seen(store.read_trajectories(spark, path)) == [("a", 9)]


def test_readers_never_see_a_mix(spark, tmp_path):
    path, stop, mixes = f"{tmp_path}/t", threading.Event(), []
    store.write_trajectories_replace(rows(spark, ("a", 5, 0), ("c", 6, 0)), path)

    def read():
        while not stop.is_set():
            values = {n for _, n in seen(store.read_trajectories(spark, path))}
            if len(values) != 1:
                mixes.append(values)

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for k in range(1, 6):
            store.write_trajectories_replace(rows(spark, ("a", 5, k), ("c", 6, k)), path)
    finally:
        stop.set()
        reader.join()
    assert not mixes


def test_two_writers_both_take_effect(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    store.write_trajectories_replace(rows(spark, ("a", 5, 1)), path)
    publish, first = versioned._publish, []

    def late(spark_, path_, number, content):
        if not first:
            first.append(number)
            store.write_trajectories_replace(rows(spark, ("b", 5, 2)), path)  # another writer gets there before
        return publish(spark_, path_, number, content)

    monkeypatch.setattr(versioned, "_publish", late)
    assert store.write_trajectories_replace(rows(spark, ("c", 5, 3)), path) == 3
    assert seen(store.read_trajectories(spark, path)) == [("a", 1), ("b", 2), ("c", 3)]


def test_emptied_days_and_rows_of_other_days(spark, tmp_path):
    path = f"{tmp_path}/t"
    store.write_trajectories_replace(rows(spark, ("a", 5, 1), ("c", 6, 3)), path)
    none = rows(spark, ("a", 5, 1)).filter("false")
    store.write_trajectories_replace(none, path, spark.createDataFrame([("a", "20260105"), ("c", "20260106")], "trip_id string, start_date string"))
    assert seen(store.read_trajectories(spark, path)) == [] and versioned.manifest(spark, path)["days"] == {}
    with pytest.raises(ValueError, match="2026-01-07"):
        versioned.change_days(spark, path, none.schema, [date(2026, 1, 5)], lambda old: rows(spark, ("x", 7, 1)))
    assert versioned.versions(spark, path) == [1, 2]


# --- catalog ------------------------------------------------------------------------------


def test_catalog_reads_changed_dates_only(spark, tmp_path, monkeypatch):
    path, rollup = f"{tmp_path}/t", f"{tmp_path}/r"
    schema = "trip_id string, start_date string, service_date date, route_id string, direction_id int"
    make = lambda *items: spark.createDataFrame([(t, f"202601{d:02d}", date(2026, 1, d), r, 0) for t, d, r in items], schema)
    assert catalog.refresh_route_catalog(spark, path, rollup) == [] and catalog.route_catalog(spark, rollup).count() == 0
    store.write_trajectories_replace(make(("a", 5, "R1"), ("a", 5, "R1"), ("b", 5, "R1"), ("c", 6, "R1"), ("d", 6, "R2")), path)
    reads = []
    monkeypatch.setattr(versioned, "read_days", lambda s, p, state, days, keep=versioned.read_days: (reads.append(list(days)), keep(s, p, state, days))[1])
    assert catalog.refresh_route_catalog(spark, path, rollup) == ["2026-01-05", "2026-01-06"]
    assert catalog.refresh_route_catalog(spark, path, rollup) == []
    store.write_trajectories_replace(make(("e", 6, "R2")), path)
    assert catalog.refresh_route_catalog(spark, path, rollup) == ["2026-01-06"]
    assert reads == [["2026-01-05", "2026-01-06"], ["2026-01-06"]]
    got = {(r.route_id, tuple(r.service_dates), r.trip_instance_count) for r in catalog.route_catalog(spark, rollup).collect()}
    assert got == {("R1", (date(2026, 1, 6), date(2026, 1, 5)), 3), ("R2", (date(2026, 1, 6),), 2)}
    keys = spark.createDataFrame([("a", "20260105"), ("b", "20260105")], "trip_id string, start_date string")
    store.write_trajectories_replace(make(("a", 5, "R1")).limit(0), path, keys)
    assert catalog.refresh_route_catalog(spark, path, rollup) == ["2026-01-05"]
    assert {(r.route_id, r.trip_instance_count) for r in catalog.route_catalog(spark, rollup).collect()} == {("R1", 1), ("R2", 2)}


# --- runs --------------------------------------------------------------------------------


def fake_build(vp, trips, shape_points, dates, *args):
    return vp.filter(F.col("start_date").isin([d.replace("-", "") for d in dates])).select(
        "trip_id", "start_date", F.to_date("start_date", "yyyyMMdd").alias("service_date"), "n")


def test_runs_are_in_the_ledger_and_failures_change_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trajectories, "build_trajectories", fake_build)
    vp = spark.createDataFrame([("a", "20260105", 1), ("b", "20260105", 2), ("c", "20260106", 3)], "trip_id string, start_date string, n int")
    path, ledger = f"{tmp_path}/t", f"{tmp_path}/ledger"
    info = spark.createDataFrame([("20260101", "20260105")], "feed_start_date string, feed_end_date string")
    out = trajectories.run_service_dates(vp, None, None, path, ledger, ["2026-01-05", "2026-01-06", "2026-01-07"], feed_info=info)
    assert [(o.instances, o.rows_written, o.status) for o in out] == [(2, 2, "ok"), (1, 1, "ok"), (0, 0, "ok")]
    assert seen(store.read_trajectories(spark, path)) == [("a", 1), ("b", 2), ("c", 3)]
    by_trip = {r.trip_id: r.run_id for r in store.read_trajectories(spark, path).collect()}
    assert by_trip["a"] == by_trip["b"] == out[0].run_id and by_trip["c"] == out[1].run_id

    def broken(*args):
        raise ValueError("no shapes")

    monkeypatch.setattr(trajectories, "build_trajectories", broken)
    with pytest.raises(ValueError, match="no shapes"):
        trajectories.run_service_dates(vp, None, None, path, ledger, ["2026-01-05"])
    runs = store.run_ledger(spark.read.parquet(ledger)).collect()
    assert sorted(r.status for r in runs) == ["failed", "ok", "ok", "ok"]
    assert [r.error_message for r in runs if r.status == "failed"] == ["no shapes"]
    covers = {r.config["service_date"]: r.config.get("timetable_covers_date") for r in spark.read.parquet(ledger).filter("status = 'ok'").collect()}
    assert covers == {"2026-01-05": "true", "2026-01-06": "false", "2026-01-07": "false"}
    assert seen(store.read_trajectories(spark, path)) == [("a", 1), ("b", 2), ("c", 3)]


# --- sessions ----------------------------------------------------------------------------


def test_closed_sessions_are_emitted_once_and_freed(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    ping = lambda v, minutes: [(v, m) for m in minutes]
    batches = [ping("a", [0, 1, 2]) + ping("b", [0, 1]), ping("a", [40, 41]) + ping("c", [42]), ping("a", [200])]
    for rows_ in batches:
        spark.createDataFrame(rows_, "vehicle_id string, m int").select(
            "vehicle_id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("m") * 60).alias("vehicle_timestamp")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("vehicle_id string, vehicle_timestamp timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    q = jobs.keep_table(jobs.vehicle_sessions(stream, "5 minutes", "10 minutes"), out, f"{tmp_path}/cp", "append")
    q.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert held[0] == 2 and held[-1] == 1  # at the end only the newest run is open
    got = sorted((r.vehicle_id, (r.first_seen.timestamp() - 1_700_000_000) / 60, r.pings) for r in jobs.read_latest(spark, out).collect())
    assert got == [("a", 0.0, 3), ("a", 40.0, 2), ("b", 0.0, 2), ("c", 42.0, 1)]


def test_a_mark_at_the_end_of_the_feed_closes_the_last_sessions(spark, tmp_path):
    """The newest sessions of every vehicle are in the answer: pings are counted in full."""
    from checks import QUERIES

    start = 1_704_067_200
    rows_ = [(i + 1, start + 1440 * i, 1 + i % 3, "view", 10.0) for i in range(30)] + [(50, start, 1, "view", 1.0)]  # id 50 has no vehicle time
    spark.createDataFrame(rows_, "event_id long, s long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s").write.parquet(
        f"{tmp_path}/events.parquet")
    got = QUERIES["st10_vehicle_sessions"](spark, str(tmp_path)).collect()
    assert sorted((r.vehicle_id, r.pings) for r in got) == [("V1", 10), ("V2", 10), ("V3", 10)]


# --- scans -------------------------------------------------------------------------------


def test_first_row_in_file_order_wins_whatever_is_read_first(spark, tmp_path):
    (tmp_path / "a.csv").write_text("trip_id,route_id\nt1,first\nt2,first\nt1,second\n")
    (tmp_path / "b.csv").write_text("trip_id,route_id\n" + "t1,third\nt3,first\n" + "t9,pad\n" * 5000)  # larger, so read first
    scan = spark.read.option("header", True).csv(str(tmp_path))
    got = {r.trip_id: r.route_id for r in timetable.dedup_trips_keep_first(scan).collect()}
    assert got == {"t1": "first", "t2": "first", "t3": "first", "t9": "pad"}
