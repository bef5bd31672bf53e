"""Transit inputs derived by Spark from the driver's tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.operators import buses, trajectory
from tramline.session import materialise, spread


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pings(spark: SparkSession, d: str) -> DataFrame:
    """One user is one vehicle on one trip; a day of events is squeezed into a minute."""
    ev = table(spark, d, "events").withColumn(
        "base", F.expr("(unix_micros(cast(ts as timestamp)) - 1704067200000000) div 1440000000")
    )
    u = F.col("user_id")
    return (
        ev.withColumn("mv", F.expr(
            "case when user_id % 4 = 0 then least(base, 600) + greatest(base - 960, 0) else base end"))
        .withColumn("jitter", F.expr(
            "case when user_id % 4 = 0 and base between 600 and 960 then 0e0 else value end"))
        .select(
            F.col("event_id").alias("id"),
            "user_id",
            F.concat(F.lit("V"), u).alias("vehicle_id"),
            F.concat(F.lit("T"), u).alias("trip_id"),
            F.expr("concat('R', user_id div 20)").alias("route_id"),
            F.expr("cast(user_id % 2 as int)").alias("direction_id"),
            F.expr("1704067200 + base + 3600 * ((user_id div 20) % 12) + 2700").alias("vt_s"),
            F.expr("(5e0 + ((user_id * 7) % 11) * 2e-1) * mv + 3e2 * ((user_id % 20) div 2) + jitter").alias("dist_m"),
            "event_type",
            "value",
        )
    )


def vehicle_positions(spark: SparkSession, d: str) -> DataFrame:
    return pings(spark, d).select(
        "id",
        F.expr("id div 10").alias("snapshot_id"),
        F.timestamp_seconds(F.expr("vt_s + id % 7")).alias("fetched_at"),
        F.concat(F.lit("e"), "id").alias("entity_id"),
        F.expr("case when id % 50 <> 0 then timestamp_seconds(vt_s) end").alias("vehicle_timestamp"),
        "vehicle_id", "trip_id", "route_id", "direction_id",
        F.expr("case when user_id % 3 = 0 then '20240101' end").alias("start_date"),
        F.expr("concat(lpad(6 + user_id % 20, 2, '0'), ':15:00')").alias("start_time"),
        F.expr("43.65e0 + dist_m / 111132e0").alias("latitude"),
        F.expr("-79.38e0 + (value - 50e0) / 80400e0").alias("longitude"),
        F.expr("case when event_type <> 'error' then 5e0 + (id % 17) / 2e0 end").alias("speed_mps"),
        F.expr("case event_type when 'view' then 'IN_TRANSIT_TO' when 'click' then 'STOPPED_AT' "
               "when 'signup' then 'INCOMING_AT' end").alias("current_status"),
        F.expr("case event_type when 'click' then 'EMPTY' when 'view' then 'MANY_SEATS_AVAILABLE' "
               "when 'signup' then 'STANDING_ROOM_ONLY' when 'purchase' then 'FULL' end").alias("occupancy_status"),
        "dist_m", "user_id", "event_type", "value",
    )


def instances(spark: SparkSession, d: str) -> DataFrame:
    """Keyed pings with the 1-D distance standing in for the projection."""
    return trajectory.with_instance(vehicle_positions(spark, d)).withColumnRenamed("dist_m", "travel_distance_m")


def trips(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select("user_id").distinct()
    return users.select(
        F.concat(F.lit("T"), "user_id").alias("trip_id"),
        F.expr("concat('R', case when user_id % 13 = 5 then user_id div 20 + 1 else user_id div 20 end)").alias("route_id"),
        F.expr("case when user_id % 10 = 9 then 'sat' else 'wk' end").alias("service_id"),
        F.expr("cast(user_id % 2 as int)").alias("direction_id"),
        F.expr("case when user_id % 7 = 0 then 'S1' else 'S0' end").alias("shape_id"),
        "user_id",
    )


def stop_times(spark: SparkSession, d: str) -> DataFrame:
    """31 stops per trip, a minute apart, from 06:00 plus six minutes per user."""
    return trips(spark, d).withColumn("stop_sequence", F.explode(F.sequence(F.lit(0), F.lit(30)))).select(
        "trip_id", "user_id",
        F.expr("21600 + 360 * user_id + 60 * stop_sequence").alias("dep_s"),
        F.concat(F.lit("P"), "stop_sequence").alias("stop_id"),
        "stop_sequence",
    ).withColumn("departure_time", F.expr(
        "concat(lpad(dep_s div 3600, greatest(2, length(cast(dep_s div 3600 as string))), '0'), ':', "
        "lpad((dep_s div 60) % 60, 2, '0'), ':', lpad(dep_s % 60, 2, '0'))"))


def route_stops(spark: SparkSession, d: str) -> DataFrame:
    """A stop every 500 m on every route and direction."""
    return pings(spark, d).select("route_id", "direction_id").distinct().withColumn(
        "stop_idx", F.explode(F.sequence(F.lit(0), F.lit(30)))
    ).select("route_id", "direction_id", "stop_idx", F.concat(F.lit("P"), "stop_idx").alias("stop_id"),
             F.col("stop_idx").alias("stop_sequence"), (F.col("stop_idx") * 500.0).alias("distance_m"))


def shape_points(spark: SparkSession, d: str) -> DataFrame:
    """Two polylines of 16 vertices: a meridian and a zigzag, for the shapes in use."""
    used = trips(spark, d).select("shape_id").distinct()
    return used.withColumn("shape_pt_sequence", F.explode(F.sequence(F.lit(0), F.lit(15)))).select(
        "shape_id", "shape_pt_sequence",
        F.expr("43.65e0 + 1e-2 * shape_pt_sequence").alias("shape_pt_lat"),
        F.expr("-79.38e0 + case when shape_id = 'S1' then 2e-3 * (shape_pt_sequence % 2) else 0e0 end").alias("shape_pt_lon"),
    )


def stops(spark: SparkSession, d: str) -> DataFrame:
    return route_stops(spark, d).select("stop_idx").distinct().select(
        F.concat(F.lit("P"), "stop_idx").alias("stop_id"),
        F.concat(F.lit("Stop "), "stop_idx").alias("stop_name"),
        F.expr("43.65e0 + stop_idx * 500e0 / 111132e0").alias("stop_lat"),
        F.expr("-79.38e0 + 2e-4 * (stop_idx % 3)").alias("stop_lon"),
    )


def trajectories(spark: SparkSession, d: str) -> DataFrame:
    """Dedup, speed, 10 s grid and rounding on the 1-D distance."""
    keyed = instances(spark, d).select(
        "trip_id", "start_date", "datetime", "travel_distance_m", "route_id", "direction_id", "vehicle_id", "occupancy_status", "id")
    pts = trajectory.dedup_instance_times(spread(keyed, "id"))
    up = trajectory.upsample_grid(trajectory.moving_speed(pts.withColumnRenamed("id", "source_vehicle_position_id")))
    return trajectory.canonical_columns(
        up.withColumn("service_date", F.to_date("start_date", "yyyyMMdd")))


def bus_points(spark: SparkSession, d: str) -> DataFrame:
    grouped = buses.group_into_buses(trajectories(spark, d), route_stops(spark, d), stale_s=330.0)
    return materialise(grouped, "points")  # several operators read it more than once


def fetch_logs(spark: SparkSession, d: str) -> DataFrame:
    """One poll per event, spread over three feeds (user mod 3)."""
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.expr("concat('feed', user_id % 3)").alias("feed_name"),
        F.expr("cast(ts as timestamp)").alias("fetched_at"),
        F.expr("case when event_type = 'error' then 500 else 200 end").alias("http_status"),
        F.expr("event_type <> 'error'").alias("success"),
        F.expr("cast(floor(value) as bigint)").alias("duration_ms"),
        F.expr("case when event_type <> 'error' then 1000 + user_id % 600 end").alias("entity_count"),
        F.expr("case when event_type <> 'error' then timestamp_seconds(unix_seconds(cast(ts as timestamp)) - event_id % 40) end").alias("feed_header_timestamp"),
        F.expr("case when event_type = 'error' then 'HttpError' end").alias("error_type"),
        F.expr("case when event_type = 'error' then props end").alias("error_message"),
        F.expr("sha2(concat(event_type, event_id div 3), 256)").alias("content_sha256"),
    )
