"""Replacing stored trajectories: what a refresh reads, keeps and leaves behind."""

from datetime import date

from pyspark.sql import functions as F

from tramline.operators import fleet
from tramline.session import materialise, workspace
from tramline.sources import store


def _there(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def test_workspace_leaves_nothing(spark):
    with workspace(spark) as path:
        assert materialise(spark.range(5), "x").count() == 5
        assert _there(spark, path)
    assert not _there(spark, path)


def test_history_of_distant_days_skips_the_days_between(spark):
    fetched = ["2026-01-05 12:00:00", "2026-01-06 12:00:00", "2026-02-10 12:00:00", "2026-03-01 12:00:00", "2026-03-04 12:00:00"]
    history = spark.createDataFrame([(t,) for t in fetched], "t string").select(F.to_timestamp("t").alias("fetched_at"))
    got = fleet.fetched_for(history, [date(2026, 3, 1), date(2026, 1, 5), date(2026, 1, 6)])
    assert sorted(str(r.fetched_at) for r in got.collect()) == [fetched[0], fetched[1], fetched[3]]
    assert fleet.fetched_for(history, []).count() == 0


def test_replace_takes_keys_without_a_date(spark, tmp_path):
    path, schema = f"{tmp_path}/traj", "trip_id string, start_date string, service_date date, n int"
    day = lambda d: date(2026, 1, d)
    store.write_trajectories_replace(spark.createDataFrame(
        [("a", "20260105", day(5), 1), ("b", "20260105", day(5), 2), ("c", "20260106", day(6), 3)], schema), path)
    keys = spark.createDataFrame([("a", "20260105"), ("c", "20260106"), ("z", "no date")], "trip_id string, start_date string")
    store.write_trajectories_replace(spark.createDataFrame([("a", "20260105", day(5), 9)], schema), path, keys)
    assert sorted((r.trip_id, r.n) for r in store.read_trajectories(spark, path).collect()) == [("a", 9), ("b", 2)]


def test_landed_files_grow_in_number_not_in_size(spark):
    from checks.stream_cases import land

    files = lambda df: len(df.inputFiles())
    df = spark.range(1000)
    stream = land(df, "many", 2, rows_a_file=100)
    path = stream._jdf.queryExecution().analyzed().toString().split("FileSource[")[1].split("]")[0]
    landed = spark.read.parquet(path)
    assert files(landed) == 10 and landed.count() == 1000
