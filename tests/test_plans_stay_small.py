"""Plans of steps that once grew faster than their input."""

from pyspark.sql import functions as F

from tramline import session
from tramline.operators import audit, buses, scoring, shapes, trajectory


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def network(spark):
    points = spark.createDataFrame([("S0", i, 43.65 + 0.01 * i, -79.38) for i in range(4)], "shape_id string, shape_pt_sequence int, shape_pt_lat double, shape_pt_lon double")
    return shapes.shape_segments(points)


def test_the_nearest_line_is_searched_once_per_row(spark):
    here = spark.createDataFrame([(1, -79.381, 43.655), (2, None, None)], "id int, longitude double, latitude double")
    found = shapes.nearest_of_network(here, network(spark), 200.0).filter("nearest_shape_id is not null")
    assert plan(found.select("nearest_shape_id", "foot_x", "foot_y")).count("array_min") == 1
    assert [r.id for r in found.collect()] == [1]


def test_drop_rates_project_once(spark):
    rows = [("t", "20240101", 43.655 + 0.0001 * i, -79.38, i) for i in range(5)]
    vp = spark.createDataFrame(rows, "trip_id string, start_date string, latitude double, longitude double, id long").withColumns(
        {"datetime": F.timestamp_seconds(F.lit(1_704_100_000) + 60 * F.col("id")), "route_id": F.lit("R"), "direction_id": F.lit(0)})
    trips = spark.createDataFrame([("t", "S0", "R", 0)], "trip_id string, shape_id string, route_id string, direction_id int")
    out = audit.filter_drop_rates(vp, trips, network(spark))
    assert "array_min" not in plan(out)  # counted from stored rows
    row = out.first()
    assert (row.projected, row.dropped_off_route, row.dropped_teleport, row.dropped_dedup) == (5, 0, 0, 0)


def test_resampled_rows_are_cut_anew_before_the_runs_are_sorted(spark):
    ddl = "service_date string, route_id string, direction_id int, trip_id string, start_date string, vehicle_id string, t long, travel_distance_m double, moving_speed_m_s double"
    df = spark.createDataFrame([("d", "R", 0, "t", "20240101", "v", 10 * i, 60.0 * i, 6.0) for i in range(20)], ddl).withColumn("datetime", F.timestamp_seconds("t"))
    cut = buses.segment_vehicle_points(df.repartition("trip_id", "start_date").withColumn("z", F.explode(F.array(F.lit(1)))))
    physical = cut._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(service_date" in physical
    assert cut.count() == 20


def test_metrics_do_not_shuffle_scores_by_horizon(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        s = spark.createDataFrame([(i, h, float(i % 2), i / 10) for i in range(10) for h in (1, 2)], "example_id long, h int, y double, p double")
        t = s.select("h").distinct().withColumn("threshold", F.lit(0.5))
        out = scoring.score_metrics(s, t)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.n for r in out.collect()) == [10, 10]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tasks_follow_the_number_of_stored_rows(spark):
    """Tasks were cut by stored bytes, and never finer than one per core: sorted rows grew with the input."""
    from tramline import session

    stored = session.materialise(spark.range(1000), "t")
    assert session.tasks_for(stored) is None  # few rows: Spark's own sizes
    n = session.tasks_for(stored, rows=50)
    assert n == 20
    assert session.cut(stored, n, "id").rdd.getNumPartitions() == 20


def _run(spark):
    ddl = "service_date string, route_id string, direction_id int, trip_id string, start_date string, vehicle_id string, t long, travel_distance_m double, moving_speed_m_s double, stop_index double"
    rows = [("d", "R", 0, f"t{b}", "20240101", "v", 10 * i, 60.0 * i + 30 * b, 6.0, i / 10) for i in range(20) for b in range(2)]
    return spark.createDataFrame(rows, ddl).withColumn("datetime", F.timestamp_seconds("t"))


def test_runs_and_ticks_are_cut_by_their_rows(spark, monkeypatch):
    from tramline import session
    from tramline.operators import detect

    whole = buses.with_bus_id(buses.segment_vehicle_points(_run(spark)))
    want_points, want_runs = sorted(map(str, whole.collect())), sorted(map(str, detect.bunch_distance_runs(detect.interpolate_on_ticks(whole)).collect()))
    monkeypatch.setattr(session, "ROWS_PER_TASK", 3)
    pts = buses.with_bus_id(buses.segment_vehicle_points(_run(spark)))
    assert "hashpartitioning(service_date" in (text := pts._jdf.queryExecution().executedPlan().toString()) and ", 14)" in text
    assert sorted(map(str, pts.collect())) == want_points and want_points
    runs = detect.bunch_distance_runs(detect.interpolate_on_ticks(pts))
    assert "REPARTITION_BY_NUM" in runs._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, runs.collect())) == want_runs and want_runs


def test_examples_are_cut_by_their_rows(spark, monkeypatch):
    from tramline.operators import examples

    ddl = "service_date string, route_id string, direction_id int, trip_id string, start_date string, vehicle_id string, bus_id string, t long, travel_distance_m double, moving_speed_m_s double, stop_index double, num_stops int"
    rows = [("d", "R", 0, f"t{b}", "d", "v", f"t{b}", 60 * i, 300.0 * i + 400 * b, 5.0, 3 + i / 2, 31) for i in range(16) for b in range(2)]
    points = spark.createDataFrame(rows, ddl).withColumn("datetime", F.timestamp_seconds("t"))

    def found():
        return examples.labelled_examples(points, length=5, horizon=5)

    want = sorted(map(str, found().collect()))
    monkeypatch.setattr(examples, "GRID_ROWS_PER_TASK", 4)
    out = found()
    assert out._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 4
    assert sorted(map(str, out.collect())) == want and want


def test_pings_are_dealt_by_rows_before_they_are_grouped(spark, monkeypatch):
    from checks import fixtures as fx

    d = "/root/testdata/sf0.001"
    rows = lambda df: sorted(map(str, df.collect()))
    few = fx.trajectories(spark, d)
    assert "RepartitionByExpression" not in plan(few)
    keyed = fx.instances(spark, d)
    monkeypatch.setattr(session, "ROWS_PER_TASK", keyed.count() // (spark.sparkContext.defaultParallelism + 3))
    many = fx.trajectories(spark, d)
    assert "RepartitionByExpression [id" in plan(many)
    assert "entity_id" not in plan(many)  # whole rows are not carried through the grouped maximum
    assert rows(many) == rows(few)
    assert trajectory.dedup_instance_times(session.spread(keyed, "id")).count() == trajectory.dedup_instance_times(keyed).count()


def test_the_teleport_filter_runs_its_input_once(spark):
    rows = [("t", "20240101", 10 * i, 9000.0 if i == 3 else 50.0 * i) for i in range(6)]
    points = spark.createDataFrame(rows, "trip_id string, start_date string, s long, travel_distance_m double").withColumn("datetime", F.timestamp_seconds("s"))
    kept = trajectory.teleport_filter(points.withColumn("costly", F.xxhash64("s")))
    assert "xxhash64" not in plan(kept)  # both parts read the marked points from the shared folder
    assert sorted(r.s for r in kept.collect()) == [0, 10, 20, 40, 50]
