"""Fleet questions over the append-only observation log: lookups, latest state, rollups.

"Latest" is an aggregate (``max_by``), so it combines on the map side and a busy vehicle or a
route with a third of the log costs one partial row per task. Ties on the fetch time go to the
higher id.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, times
from .sequence import latest_by


def page_cap(df: DataFrame, limit: int | None = None, cap: int | None = None) -> DataFrame:
    """Result page: the smaller of the requested size and the cap; all rows where neither is
    given. Call after ``orderBy`` so the plan is one top-k."""
    sizes = [n for n in (limit, cap) if n is not None]
    return df.limit(min(sizes)) if sizes else df


# --- filters and lookups ---------------------------------------------------------------


def between_half_open(ts: Column, start: Column, end: Column) -> Column:
    return (ts >= start) & (ts < end)


def vehicle_history(vp: DataFrame, vehicle_id: str, start: Column, end: Column, limit: int | None = None) -> DataFrame:
    rows = vp.filter((F.col("vehicle_id") == vehicle_id) & between_half_open(F.col("fetched_at"), start, end))
    return page_cap(rows.orderBy(F.desc("fetched_at"), F.desc("id")), limit)


def replay_window(
    vp: DataFrame, start: Column, end: Column, route_id: str | None = None, limit: int | None = None
) -> DataFrame:
    """Rows of ``[start, end)``, oldest first. An empty or reversed window is an error on read."""
    ok = F.when(start < end, True).otherwise(F.raise_error(F.lit("start must be before end")).cast("boolean"))
    rows = vp.filter(between_half_open(F.col("fetched_at"), start, end) & ok)
    if route_id is not None:
        rows = rows.filter(F.col("route_id") == route_id)
    return page_cap(rows.orderBy("fetched_at", "id"), limit)


def snapshots_window(snapshots: DataFrame, feed: str, start: Column, end: Column, limit: int | None = None) -> DataFrame:
    rows = snapshots.filter((F.col("feed_name") == feed) & F.col("fetched_at").between(start, end))
    return page_cap(rows.orderBy("fetched_at", "id"), limit)


def trip_instance_rows(
    vp: DataFrame, trip_id: str, start_date: str, window: tuple[Column, Column] | None = None
) -> DataFrame:
    """Rows of one trip instance in time order; the optional fetch window prunes the scan."""
    eff = times.effective_start_date(F.col("start_date"), F.col("vehicle_timestamp"), F.col("fetched_at"))
    rows = vp.filter((F.col("trip_id") == trip_id) & (eff == start_date))
    if window is not None:
        rows = rows.filter(between_half_open(F.col("fetched_at"), *window))
    return rows.orderBy(F.coalesce("vehicle_timestamp", "fetched_at"), "id")


def fetched_in_window(vp: DataFrame, service_date, slack_hours: int = 6) -> DataFrame:
    return vp.filter(between_half_open(F.col("fetched_at"), *times.fetch_window(service_date, slack_hours)))


def fetched_for(history: DataFrame, days: Iterable[date]) -> DataFrame:
    """Rows fetched in the window of one of ``days``; neighbouring days share one range."""
    spans: list[list[date]] = []
    for d in sorted(days):
        if spans and (d - spans[-1][1]).days <= 1:
            spans[-1][1] = d
        else:
            spans.append([d, d])
    wanted = F.lit(False)
    for first, last in spans:
        lo, hi = times.fetch_window(first)[0], times.fetch_window(last)[1]
        wanted = wanted | ((F.col("fetched_at") >= lo) & (F.col("fetched_at") < hi))
    return history.filter(wanted)


def trip_trajectory(traj: DataFrame, trip_id: str, start_date: str) -> DataFrame:
    return traj.filter((F.col("trip_id") == trip_id) & (F.col("start_date") == start_date)).orderBy("datetime")


def trajectory_slice(traj: DataFrame, service_date: Column, route_id: str, direction_id: int) -> DataFrame:
    """One slice in grouping order: three partition-column filters and a sort."""
    rows = traj.filter(
        (F.col("service_date") == service_date)
        & (F.col("route_id") == route_id)
        & (F.col("direction_id") == direction_id)
    )
    return slice_order(rows)


def slice_order(traj: DataFrame) -> DataFrame:
    return traj.orderBy("trip_id", "start_date", F.asc_nulls_last("vehicle_id"), "datetime")


def time_of_day_filter(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Clock time within ``[start, end]`` whatever the date."""
    return df.filter(F.date_format(ts, "HH:mm:ss").between(start, end))


def bbox_filter(vp: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    return vp.filter(geo.in_box(F.col("longitude"), F.col("latitude"), box))


def within_radius_latest(vp: DataFrame, lon: float, lat: float, radius_m: float, since: Column) -> DataFrame:
    """Latest row per vehicle among rows within the radius, with the distance. A box around the
    circle is tested first so the scan can skip row groups."""
    dlat = radius_m / 110_000.0
    here = F.lit(lon), F.lit(lat)
    dlon = F.lit(dlat) / F.cos(F.radians(here[1]))
    near = vp.filter(
        (F.col("fetched_at") > since)
        & F.col("vehicle_id").isNotNull()
        & F.col("latitude").between(here[1] - dlat, here[1] + dlat)
        & F.col("longitude").between(here[0] - dlon, here[0] + dlon)
    ).withColumn("meters", geo.haversine_m(F.col("longitude"), F.col("latitude"), *here))
    rows = near.filter(F.col("meters") <= radius_m).select("vehicle_id", "route_id", "meters", "fetched_at", "id")
    return latest_by(rows, ["vehicle_id"], ["fetched_at", "id"])


def feed_covers_date(feed_info: DataFrame, day: Column) -> DataFrame:
    """Is the date inside the declared validity; unknown bounds count as covered."""
    ymd = F.date_format(day, "yyyyMMdd")
    inside = (F.col("feed_start_date") <= ymd) & (ymd <= F.col("feed_end_date"))
    return feed_info.select("*", F.coalesce(inside, F.lit(True)).alias("covered"))


def spatial_outliers(vp: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """One row: missing positions, and present ones at null island or outside the box."""
    lon, lat = F.col("longitude"), F.col("latitude")
    missing = lon.isNull() | lat.isNull()
    island = lat.between(-0.01, 0.01) & lon.between(-0.01, 0.01)
    out = ~missing & (island | ~geo.in_box(lon, lat, box))
    return vp.agg(
        F.count("*").alias("rows"),
        F.count_if(missing).alias("missing"),
        F.count_if(out).alias("outliers"),
        F.try_divide(100 * F.count_if(out), F.count_if(~missing)).alias("outlier_pct"),
    )


# --- latest state -----------------------------------------------------------------------


def latest_per_key(
    vp: DataFrame, key: str = "vehicle_id", since: Column | None = None, route_id: str | None = None
) -> DataFrame:
    rows = vp.filter(F.col(key).isNotNull())
    if since is not None:
        rows = rows.filter(F.col("fetched_at") >= since)
    if route_id is not None:
        rows = rows.filter(F.col("route_id") == route_id)
    return latest_by(rows, [key], ["fetched_at", "id"])


def newest_first(latest: DataFrame, limit: int | None = None) -> DataFrame:
    return page_cap(latest.orderBy(F.desc("fetched_at"), F.desc("id")), limit)


def snapshot_bucket_latest(vp: DataFrame, at: Column, bucket: Column) -> DataFrame:
    """Newest row per vehicle in ``(at - bucket, at]``; rows without a vehicle count as one."""
    rows = vp.filter((F.col("fetched_at") > at - bucket) & (F.col("fetched_at") <= at))
    return latest_by(rows, ["vehicle_id"], ["fetched_at", "id"])


# --- rollups ----------------------------------------------------------------------------


def feed_status(logs: DataFrame, now: Column, feed: str | None = None) -> DataFrame:
    """One row per feed: last fetch, last success, the last hour's outcome and the lag."""
    rows = logs if feed is None else logs.filter(F.col("feed_name") == feed)
    recent = F.col("fetched_at") >= now - F.make_dt_interval(F.lit(0), F.lit(1))
    order = F.struct("fetched_at", "id")
    last = F.struct(
        "fetched_at", "http_status", "error_type", "error_message", "entity_count", "feed_header_timestamp"
    )
    g = rows.groupBy("feed_name").agg(
        F.max_by(last, order).alias("last"),
        F.max(F.when(F.col("success"), F.col("fetched_at"))).alias("last_success_at"),
        F.count_if(recent).alias("fetches_last_hour"),
        F.count_if(recent & F.col("success")).alias("successes_last_hour"),
    )
    n, ok = F.col("fetches_last_hour"), F.col("successes_last_hour")
    lag = (F.unix_micros(now) - F.unix_micros("last.feed_header_timestamp")) / 1e6
    return g.select(
        "feed_name",
        F.col("last.fetched_at").alias("last_fetched_at"),
        "last_success_at",
        F.col("last.http_status").alias("last_http_status"),
        F.col("last.error_type").alias("last_error_type"),
        F.col("last.error_message").alias("last_error_message"),
        F.col("last.entity_count").alias("last_entity_count"),
        F.col("last.feed_header_timestamp").alias("last_feed_header_timestamp"),
        n,
        ok,
        (n - ok).alias("failures_last_hour"),
        F.when(n > 0, ok / n).alias("success_rate_last_hour"),
        lag.alias("lag_seconds"),
    )


def recent_fetches(logs: DataFrame, feed: str, limit: int | None = None) -> DataFrame:
    rows = logs.filter(F.col("feed_name") == feed)
    return page_cap(rows.orderBy(F.desc("fetched_at"), F.desc("id")), limit)


def route_metrics(vp: DataFrame, since: Column, route_id: str | None = None) -> DataFrame:
    """Latest state of every route's vehicles: count, speeds, breakdowns, bounding box.

    Latest is taken per route and vehicle, as a query for that route would see it.
    """
    rows = vp.filter(F.col("vehicle_id").isNotNull() & F.col("route_id").isNotNull() & (F.col("fetched_at") >= since))
    if route_id is not None:
        rows = rows.filter(F.col("route_id") == route_id)
    need = ["route_id", "vehicle_id", "fetched_at", "id", "speed_mps", "current_status", "occupancy_status",
            "latitude", "longitude"]
    latest = latest_by(rows.select(*need), ["route_id", "vehicle_id"], ["fetched_at", "id"])
    count_of = lambda c: F.coalesce(c, F.lit("UNKNOWN"))
    grouped = (
        latest.groupBy("route_id", count_of("current_status").alias("_s"), count_of("occupancy_status").alias("_o"))
        .agg(
            F.count("*").alias("n"), F.max("fetched_at").alias("seen"), F.sum("speed_mps").alias("sv"),
            F.count("speed_mps").alias("nv"), F.max("speed_mps").alias("mv"),
            F.min("latitude").alias("a"), F.max("latitude").alias("b"),
            F.min("longitude").alias("c"), F.max("longitude").alias("d"),
        )
    )
    # at most |status| x |occupancy| rows per route from here on
    def tally(v: str):
        pairs = F.collect_list(F.struct(F.col(v).alias("k"), F.col("n")))
        return F.map_from_entries(
            F.transform(
                F.array_sort(F.array_distinct(F.transform(pairs, lambda x: x["k"]))),
                lambda k: F.struct(
                    k,
                    F.aggregate(pairs, F.lit(0).cast("bigint"),
                                lambda acc, x: acc + F.when(x["k"] == k, x["n"]).otherwise(F.lit(0))),
                ),
            )
        )

    return grouped.groupBy("route_id").agg(
        F.sum("n").alias("active_vehicle_count"),
        F.max("seen").alias("latest_fetched_at"),
        F.when(F.sum("nv") > 0, F.sum("sv") / F.sum("nv")).alias("avg_speed_mps"),
        F.max("mv").alias("max_speed_mps"),
        tally("_s").alias("status_breakdown"),
        tally("_o").alias("occupancy_breakdown"),
        F.min("a").alias("min_lat"), F.max("b").alias("max_lat"),
        F.min("c").alias("min_lon"), F.max("d").alias("max_lon"),
    )


def active_routes(vp: DataFrame, since: Column, limit: int | None = None) -> DataFrame:
    rows = vp.filter(F.col("route_id").isNotNull() & (F.col("fetched_at") >= since))
    seen = rows.groupBy("route_id").agg(F.max("fetched_at").alias("last_seen"))
    return page_cap(seen.orderBy(F.desc("last_seen"), "route_id"), limit)


def fleet_by_route(vp: DataFrame, since: Column, limit: int | None = None) -> DataFrame:
    latest = latest_per_key(
        vp.filter(F.col("fetched_at") > since).select("vehicle_id", "route_id", "speed_mps", "fetched_at", "id")
    )
    per = latest.filter("route_id is not null").groupBy("route_id").agg(
        F.count("*").alias("active_vehicles"),
        (F.avg("speed_mps") * 3.6).alias("avg_speed_kph"),
        F.max("fetched_at").alias("latest_seen"),
    )
    return page_cap(per.orderBy(F.desc("active_vehicles"), "route_id"), limit)


def top_routes(latest: DataFrame, k: int) -> DataFrame:
    per = latest.filter("route_id is not null").groupBy("route_id").agg(F.count("*").alias("vehicles"))
    return per.orderBy(F.desc("vehicles"), "route_id").limit(k)


def occupancy_counts(vp: DataFrame, since: Column) -> DataFrame:
    rows = vp.filter(F.col("fetched_at") > since)
    return rows.groupBy(F.coalesce("occupancy_status", F.lit("UNKNOWN")).alias("occupancy_status")).agg(
        F.count("*").alias("n")
    )


def per_minute_counts(df: DataFrame, ts: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(F.date_trunc("minute", ts).alias("minute"), *by).agg(F.count("*").alias("rows"))


def replay_summary(rows: DataFrame) -> DataFrame:
    span = (F.unix_micros(F.max("fetched_at")) - F.unix_micros(F.min("fetched_at"))) / 6e7
    return rows.agg(
        F.count("*").alias("rows"),
        F.countDistinct("vehicle_id").alias("vehicles"),
        F.countDistinct("route_id").alias("routes"),
        span.alias("span_min"),
    )


def fleet_snapshot_summary(latest: DataFrame, now: Column) -> DataFrame:
    """Map header: plotted vehicles, routes, mean age in whole seconds, mean speed in km/h."""
    shown = latest.dropna(subset=["latitude", "longitude"])
    return shown.agg(
        F.count("*").alias("vehicles"),
        F.countDistinct("route_id").alias("routes"),
        F.floor(F.avg(times.age_seconds(F.col("fetched_at"), now))).alias("avg_age_s"),
        (F.avg("speed_mps") * 3.6).alias("avg_speed_kph"),
    )


# --- stored trajectories ----------------------------------------------------------------


def trip_instance_summary(
    traj: DataFrame, service_date: Column | None = None, route_id: str | None = None, limit: int | None = None
) -> DataFrame:
    """Per instance: the maximum of each identity column, time span, points and distance."""
    rows = traj
    if service_date is not None:
        rows = rows.filter(F.col("service_date") == service_date)
    if route_id is not None:
        rows = rows.filter(F.col("route_id") == route_id)
    ids = [c for c in ("route_id", "direction_id", "shape_id", "vehicle_id") if c in traj.columns]
    per = rows.groupBy("trip_id", "start_date", "service_date").agg(
        *[F.max(c).alias(c) for c in ids],
        F.min("datetime").alias("first_datetime"),
        F.max("datetime").alias("last_datetime"),
        F.count("*").alias("point_count"),
        F.coalesce(F.max("travel_distance_m"), F.lit(0.0)).alias("travel_distance_m"),
    )
    return page_cap(per.orderBy(F.desc("last_datetime"), "trip_id", "start_date"), limit)


def trip_detail_summary(traj: DataFrame) -> DataFrame:
    """Per instance: minutes, final km, mean of the non-zero speeds and top speed in km/h."""
    kph = F.rint(F.coalesce("moving_speed_m_s", F.lit(0.0)) * 3.6 * 100) / 100
    return traj.groupBy("trip_id", "start_date").agg(
        F.count("*").alias("points"),
        ((F.unix_micros(F.max("datetime")) - F.unix_micros(F.min("datetime"))) / 6e7).alias("duration_min"),
        F.max_by(F.rint(F.col("travel_distance_m")) / 1000.0, "datetime").alias("distance_km"),
        F.avg(F.when(kph != 0, kph)).alias("mean_moving_kph"),
        F.max(kph).alias("max_kph"),
    )


def instances_by_route_and_date(traj: DataFrame) -> DataFrame:
    """Distinct instances first, then a count per route, direction and date; no ``count(distinct row)``."""
    keys = ["route_id", "direction_id"]
    return (
        traj.filter("route_id is not null and direction_id is not null")
        .select(*keys, "service_date", "trip_id", "start_date")
        .distinct()
        .groupBy(*keys, "service_date")
        .agg(F.count("*").alias("n"))
    )


def catalog_of_counts(per_date: DataFrame) -> DataFrame:
    """One row per route and direction: its service dates, newest first, and its instances."""
    return per_date.groupBy("route_id", "direction_id").agg(
        F.sort_array(F.collect_list("service_date"), asc=False).alias("service_dates"),
        F.sum("n").alias("trip_instance_count"),
    )


def route_catalog(traj: DataFrame) -> DataFrame:
    """The catalog of routes from trajectory rows; ``plans.catalog`` keeps it up to date beside a stored table."""
    return catalog_of_counts(instances_by_route_and_date(traj))


def service_dates(traj: DataFrame, limit: int | None = None) -> DataFrame:
    return page_cap(traj.select("service_date").distinct().orderBy(F.desc("service_date")), limit)


def routes_on_date(traj: DataFrame, service_date: Column, limit: int | None = None) -> DataFrame:
    rows = traj.filter((F.col("service_date") == service_date) & F.col("route_id").isNotNull())
    return page_cap(rows.select("route_id").distinct().orderBy("route_id"), limit)


def richest_slice(traj: DataFrame, route_id: str | None = None, dates: tuple[Column, Column] | None = None) -> DataFrame:
    """Slice with most distinct runs; later date, then lower direction on ties. Without a route
    the best slice of every route, as a grouped maximum."""
    rows = traj.filter("direction_id is not null")
    if route_id is not None:
        rows = rows.filter(F.col("route_id") == route_id)
    if dates is not None:
        rows = rows.filter(F.col("service_date").between(*dates))
    runs = rows.select("route_id", "service_date", "direction_id", "trip_id", "start_date", "vehicle_id").distinct()
    per = runs.groupBy("route_id", "service_date", "direction_id").agg(F.count("*").alias("runs"))
    best = F.max_by(F.struct("service_date", "direction_id", "runs"),
                    F.struct("runs", "service_date", -F.col("direction_id")))
    return per.groupBy("route_id").agg(best.alias("b")).select("route_id", "b.*")


def consecutive_dup_rate(snapshots: DataFrame, chunk_s: int = 3600) -> DataFrame:
    """Share of a feed's polls with the same content hash as the poll before. A feed's log has
    no bound, so the previous row is found in chunks of time."""
    from .sequence import previous_in_chunks

    chunk = F.floor(F.unix_seconds("fetched_at") / chunk_s)
    seen = previous_in_chunks(
        snapshots.select("feed_name", "fetched_at", "id", "content_sha256"),
        ["feed_name"], ["fetched_at", "id"], chunk, {"prev_hash": F.col("content_sha256")},
    )
    per = seen.groupBy("feed_name").agg(
        F.count("*").alias("snaps"),
        F.count_if(F.col("content_sha256") == F.col("prev_hash")).alias("consec_dups"),
    )
    return per.withColumn("consec_dup_rate", F.col("consec_dups") / F.col("snaps"))


def top_risk(scored: DataFrame, k: int) -> DataFrame:
    """The k buses with the highest probability over their horizons, full vector kept."""
    return scored.withColumn("max_prob", F.array_max("probs")).orderBy(F.desc("max_prob"), "example_id").limit(k)
