from tramline.operators import examples

SCHEMA = "service_date string, route_id string, direction_id int, bus_id string, k long, fwd_gap_m double, stop_index double, num_stops int, headway_s double"


def labels(spark, ticks, on_hole):
    keys = ("d", "r", 0, "b")
    rows = [(*keys, k, 50.0 if k % 2 else 500.0, 5.0, 20, 60.0) for k in ticks]
    chain = spark.createDataFrame(rows, SCHEMA)
    for c in set(examples.BUS) - set(chain.columns):
        raise AssertionError(c)
    out = examples.horizon_labels(chain, horizon=4, on_hole=on_hole).collect()
    return {r.k: r.labels for r in out}


def test_a_missing_tick_ends_the_walk_or_only_its_entry(spark):
    ticks = [0, 1, 3, 4, 5]
    assert labels(spark, ticks, "stop")[0] == [1.0, None, None, None]
    assert labels(spark, ticks, "skip")[0] == [1.0, None, 1.0, 0.0]
    assert labels(spark, ticks, "stop")[3] == [0.0, 1.0, None, None]
