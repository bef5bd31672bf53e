"""The overlapping-window join of points and reference times."""

import random

from pyspark.sql import functions as F

from tramline.plans import forecasting


def test_points_meet_the_references_in_reach_only(spark):
    rng = random.Random(1)
    points = [("d", f"R{rng.randint(0, 1)}", 0, rng.randint(0, 20_000)) for _ in range(400)]
    refs = [("d", f"R{r}", 0, t) for r in (0, 1) for t in range(0, 20_000, 700)]
    p = spark.createDataFrame(points, "service_date string, route_id string, direction_id int, t long").withColumn("datetime", F.timestamp_seconds("t"))
    q = spark.createDataFrame(refs + refs[:3], "service_date string, route_id string, direction_id int, t_ref long")
    got = forecasting.within_reach(p, q, 400.0, 120.0)
    want = sorted((r, t, x) for _, r, _, t in points for _, s, _, x in refs if r == s and x - 400 <= t <= x + 120)
    assert sorted((r.route_id, r.t, r.t_ref) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_cell" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
