"""Headline queries at one scale; prints one JSON line.

The inputs that the queries share (pings, instances, trajectories, bus points, timetable) are derived from the given tables once,
stored, and not timed: a query's seconds are its operator's. ``rows_per_s`` gives input rows read per second by the main input.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import QUERIES  # noqa: E402
from checks import fixtures as fx  # noqa: E402
from tramline.session import local_session, materialise  # noqa: E402

HEADLINE = [
    "flagship_bunching_by_route_hour",
    "w06_latest_per_key",
    "a11_route_catalog",
    "a01_feed_status",
    "a02_route_metrics",
    "w01_dedup_instance_timestamps",
    "w02_teleport_filter",
    "w08_upsample_grid",
    "j04_nearest_on_shape",
    "c01_build_trajectories",
    "w11_group_into_buses",
    "w15_bunch_time_events",
    "w17_bunch_distance_events",
    "w18_detect_all",
    "a17_hourly_time_allocation",
    "w22_cadence_gaps",
    "w26_leader_chain",
    "w27_passage_headway",
    "c04_build_examples",
    "m12_physics_baseline",
    "m13_score_metrics",
    "m14_average_precision",
    "m06_isotonic_calibration",
    "a41_channel_drift",
    "c05_evaluation_report",
    "s11_write_trajectories_replace",
    "st03_incremental_refresh",
]
# the input whose rows count for a query; the others read the events
MAIN_INPUT = {"trajectories": ("a11", "s11", "c04"), "bus_points": ("w15", "w17", "w18", "a17", "w26", "w27", "m12", "flagship"), "instances": ("w01", "w02", "w08", "j04", "w22")}
STORED = ["pings", "vehicle_positions", "instances", "trips", "stop_times", "route_stops", "shape_points", "stops", "trajectories", "bus_points", "fetch_logs"]


def store_inputs(spark, sf_dir: str) -> dict[str, int]:
    """Each shared input written once and read back by every later use; rows of each."""
    rows = {"events": fx.table(spark, sf_dir, "events").count()}
    for name in STORED:
        kept = materialise(getattr(fx, name)(spark, sf_dir), f"bench-{name}")
        rows[name] = kept.count()
        setattr(fx, name, lambda s, d, kept=kept: kept)
    return rows


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["a12_service_dates"](spark, sf_dir).collect()  # warm the JVM once
    rows, times, rates = store_inputs(spark, sf_dir), {}, {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        main_input = next((k for k, heads in MAIN_INPUT.items() if name.startswith(heads)), "events")
        rates[name] = round(rows[main_input] / max(times[name], 1e-3))
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "rows_per_s": rates,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
