"""Route polylines: projection of points, distances of stops, and checks of the geometry.

A polyline is a table of segments. Points never meet a whole network: segments are filed under
square cells, a point joins the one row of its own cell, and the minimum over that short list
is taken in the same row. One output row per point, no pair rows, no range join. Cells have one size where a
cutoff is given, and split where they are busy (``quadtree``) where the answer holds at any distance.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..defaults import DEFAULTS
from ..functions import geo
from . import quadtree
from .lookup import interval_lookup

SEGMENT = ["seg_no", "x0", "y0", "x1", "y1", "cum_m", "len_m"]


def with_xy(df: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """``df`` with its map position. The generator is a boundary: the optimizer does not copy the
    series into every later use of ``x`` and ``y``."""
    x, y = geo.utm_xy(F.col(lon), F.col(lat))
    return df.drop("x", "y").select("*", F.inline(F.array(F.struct(x.alias("x"), y.alias("y")))))


def shape_segments(shape_points: DataFrame) -> DataFrame:
    """Segments of each polyline in metres with the distance before them. The windows hold one
    polyline's vertices."""
    w = Window.partitionBy("shape_id").orderBy("shape_pt_sequence")
    pts = with_xy(shape_points, "shape_pt_lon", "shape_pt_lat").select(
        "shape_id",
        "shape_pt_sequence",
        (F.row_number().over(w) - 1).alias("seg_no"),
        F.col("x").alias("x0"),
        F.col("y").alias("y0"),
        F.lead("x").over(w).alias("x1"),
        F.lead("y").over(w).alias("y1"),
        "shape_pt_lon",
        "shape_pt_lat",
        F.lead("shape_pt_lon").over(w).alias("next_lon"),
        F.lead("shape_pt_lat").over(w).alias("next_lat"),
    )
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    segs = pts.withColumn("len_m", F.sqrt(dx * dx + dy * dy))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return (
        segs.withColumn("cum_m", F.coalesce(F.sum("len_m").over(before), F.lit(0.0)))
        .filter("x1 is not null")
    )


def shape_lengths(segments: DataFrame) -> DataFrame:
    return segments.groupBy("shape_id").agg(F.sum("len_m").alias("shape_length_m"))


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size)


def segment_cells(segments: DataFrame, reach_m: float, keys: Sequence[str] = ("shape_id",)) -> DataFrame:
    """Segments listed under every cell that has points within ``reach_m`` of them.

    Cells have side ``reach_m``. A cell of the padded bounding box is kept if its centre is
    near enough that some point in it could qualify, so long diagonals stay thin.
    """
    size = float(reach_m)
    lo = lambda a, b: _cell(F.least(a, b) - reach_m, size)
    hi = lambda a, b: _cell(F.greatest(a, b) + reach_m, size)
    each = segments.select(
        *keys,
        F.struct(*(["shape_id"] if "shape_id" not in keys else []), *SEGMENT).alias("seg"),
        F.explode(F.sequence(lo(F.col("x0"), F.col("x1")), hi(F.col("x0"), F.col("x1")))).alias("cx"),
        F.sequence(lo(F.col("y0"), F.col("y1")), hi(F.col("y0"), F.col("y1"))).alias("_ys"),
    ).withColumn("cy", F.explode("_ys"))
    centre = geo.project_on_segment((F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size, F.col("seg"))
    near = each.filter(centre["orth_m"] <= reach_m + size * math.sqrt(0.5) + 1e-6)
    return near.groupBy(*keys, "cx", "cy").agg(F.collect_list("seg").alias("segs"))


def _best(px: Column, py: Column, segs: str) -> Column:
    """Nearest of an array of segments; the foot fraction is computed once per segment."""
    with_f = F.transform(segs, lambda s: F.struct(s.alias("s"), geo.foot_fraction(px, py, s).alias("f")))
    return F.array_min(F.transform(with_f, lambda z: geo.project_on_segment(px, py, z["s"], z["f"])))


def _placed(joined: DataFrame) -> DataFrame:
    """Distance along and off the line from ``segs``. Unnesting a one-entry array keeps the
    optimizer from copying the search into every filter and column that uses its result."""
    hit = F.inline(F.array(_best(F.col("x"), F.col("y"), "segs"))).alias("orthogonal_distance_m", "_seg_no", "travel_distance_m")
    keep = [c for c in joined.columns if c not in ("segs", "cx", "cy", "x", "y")]
    return joined.select(*keep, hit).drop("_seg_no")


def nearest_on_shape(
    points: DataFrame, segments: DataFrame, max_orth_m: float = DEFAULTS.max_orthogonal_m
) -> DataFrame:
    """Distance along the point's own polyline, for points within ``max_orth_m`` of it.

    Exact for every kept row: all segments within the cutoff are in the row of the point's
    cell. Spark broadcasts the cell table only below its own size limit; otherwise the join
    shuffles on shape and cell, which also splits a busy shape.
    """
    cells = segment_cells(segments, max_orth_m)
    size = float(max_orth_m)
    located = with_xy(points).withColumns({"cx": _cell(F.col("x"), size), "cy": _cell(F.col("y"), size)})
    return _placed(located.join(cells, ["shape_id", "cx", "cy"])).filter(F.col("orthogonal_distance_m") <= max_orth_m)


def nearest_on_shape_unpruned(points: DataFrame, segments: DataFrame) -> DataFrame:
    """As ``nearest_on_shape`` at any distance, for audits. A point looks through the short list of its cell, not its
    whole polyline; points without a position or a polyline go."""
    here = quadtree.located(with_xy(points))
    lists = quadtree.segment_lists(here, segments, ["shape_id"])
    return _placed(here.join(lists, ["shape_id", "_fx", "_fy"])).drop("_fx", "_fy")


def nearest_of_network(points: DataFrame, segments: DataFrame, within_m: float | None = None) -> DataFrame:
    """Nearest polyline of the network: ``nearest_shape_id``, its distance and the foot point.

    Exact at any distance, or null beyond ``within_m``. Ties go to the lower shape id. Points without a position, or a
    network without lines, get null.
    """
    where = with_xy(points)
    here = quadtree.located(where)
    lists = quadtree.segment_lists(here, segments)

    def candidate(s):
        p = geo.project_on_segment(F.col("x"), F.col("y"), s)
        f = geo.foot_fraction(F.col("x"), F.col("y"), s)
        return F.struct(
            p["orth_m"].alias("orth_m"), s["shape_id"].alias("shape_id"), p["seg_no"].alias("seg_no"),
            (s["x0"] + f * (s["x1"] - s["x0"])).alias("fx"), (s["y0"] + f * (s["y1"] - s["y0"])).alias("fy"),
        )

    cell = {"_fx": F.when(F.isnan("x") | F.isnan("y"), None).otherwise(quadtree._cell(F.col("x"), quadtree.SIDES[-1])),
            "_fy": F.when(F.isnan("x") | F.isnan("y"), None).otherwise(quadtree._cell(F.col("y"), quadtree.SIDES[-1]))}
    # unnested as in ``_placed``: the search runs once per row, whatever uses its result
    best = F.inline(F.array(F.array_min(F.transform("segs", candidate)))).alias("_orth", "_shape", "_seg_no", "_foot_x", "_foot_y")
    hit = where.withColumns(cell).join(lists, ["_fx", "_fy"], "left").select(*[c for c in where.columns if c not in ("x", "y")], best)
    near = F.lit(True) if within_m is None else F.col("_orth") <= within_m
    return hit.withColumns(
        {
            "nearest_shape_id": F.when(near, F.col("_shape")),
            "shortest_distance_m": F.when(near, F.col("_orth")),
            "foot_x": F.when(near, F.col("_foot_x")),
            "foot_y": F.when(near, F.col("_foot_y")),
        }
    ).drop("_orth", "_shape", "_seg_no", "_foot_x", "_foot_y")


def nearest_among_shapes(points: DataFrame, segments: DataFrame, within_m: float) -> DataFrame:
    """``nearest_of_network`` within a corridor; points outside every corridor get null."""
    return nearest_of_network(points, segments, within_m)


def within_corridor(points: DataFrame, segments: DataFrame, radius_m: float) -> DataFrame:
    """Points inside the buffer of any polyline."""
    near = nearest_among_shapes(points, segments, radius_m)
    return near.filter("shortest_distance_m is not null").select(*points.columns)


def distance_of_foot(points: DataFrame, segments: DataFrame, shape_id: str) -> DataFrame:
    """Distance along one chosen polyline of the foot points found before."""
    chosen = segments.filter(F.col("shape_id") == shape_id)
    here = quadtree.located(points, "foot_x", "foot_y")
    lists = quadtree.segment_lists(here, chosen)
    hit = F.inline(F.array(_best(F.col("foot_x"), F.col("foot_y"), "segs"))).alias("_orth", "_seg_no", "travel_distance_m")
    return here.join(lists, ["_fx", "_fy"]).select(*points.columns, hit).drop("_orth", "_seg_no")


def lonlat_at_distance(traj: DataFrame, segments: DataFrame, width_m: float = 250.0) -> DataFrame:
    """Position at a distance along the row's polyline, clamped to its ends."""
    spans = segments.filter("len_m > 0").select(
        "shape_id", "x0", "y0", "x1", "y1", "len_m", F.col("cum_m").alias("lo"), (F.col("cum_m") + F.col("len_m")).alias("hi")
    )
    ends = segments.groupBy("shape_id").agg(
        F.max_by("x1", "seg_no").alias("_end_x"), F.max_by("y1", "seg_no").alias("_end_y"), F.sum("len_m").alias("_total")
    )
    at = F.greatest(F.lit(0.0), F.col("travel_distance_m"))
    placed = interval_lookup(traj.withColumn("_at", at), spans, ["shape_id"], "_at", ["x0", "y0", "x1", "y1", "len_m"], width_m)
    found = placed.join(ends, "shape_id", "left")
    frac = (F.col("_at") - F.col("lo")) / F.col("len_m")
    beyond = F.col("_at") >= F.col("_total")
    x = F.when(beyond | frac.isNull(), F.col("_end_x")).otherwise(F.col("x0") + frac * (F.col("x1") - F.col("x0")))
    y = F.when(beyond | frac.isNull(), F.col("_end_y")).otherwise(F.col("y0") + frac * (F.col("y1") - F.col("y0")))
    lon, lat = geo.utm_lonlat(F.col("_x"), F.col("_y"))
    return (
        found.withColumns({"_x": x, "_y": y})
        .withColumns({"longitude": lon, "latitude": lat})
        .select(*traj.columns, "longitude", "latitude")
    )


# --- canonical trip and stops of a route --------------------------------------------------


def canonical_shape(trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Per route and direction: the most used shape, and within it the trip with most stops.
    Ties: lower shape id, lower trip id. Two grouped extremes, no ranking windows."""
    keys = ["route_id", "direction_id"]
    known = trips.filter("trip_id is not null and shape_id is not null").select(*keys, "trip_id", "shape_id")
    shape = (
        known.groupBy(*keys, "shape_id").agg(F.count("*").alias("n"))
        .groupBy(*keys).agg(F.min_by("shape_id", F.struct(-F.col("n"), F.col("shape_id"))).alias("shape_id"))
    )
    sizes = stop_times.groupBy("trip_id").agg(F.count("*").alias("stops"))
    of_shape = known.join(shape, [*keys, "shape_id"]).join(sizes, "trip_id")
    return of_shape.groupBy(*keys, "shape_id").agg(
        F.min_by("trip_id", F.struct(-F.col("stops"), F.col("trip_id"))).alias("trip_id")
    )


def monotone_stop_distances(visits: DataFrame, segments: DataFrame, tol_m: float = DEFAULTS.stop_tolerance_m) -> DataFrame:
    """Distances of stops along their polyline, never decreasing in visit order.

    ``visits``: one row per list with ``shape_id`` and ``stops``, an ordered array of structs
    with ``x`` and ``y``. A stop further behind its predecessor than the tolerance is projected
    again on the part of the line still ahead; smaller steps back are clamped. A fold over one
    stop list, done in one row by array functions. Adds ``distances`` and ``shape_length_m``.
    """
    lines = segments.groupBy("shape_id").agg(
        F.collect_list(F.struct(*SEGMENT)).alias("segs"), F.sum("len_m").alias("shape_length_m")
    )
    joined = visits.join(lines, "shape_id")

    def ahead(p, prev):
        """Distance along at the nearest point of the line from ``prev`` on."""

        def on(s):
            dx, dy = s["x1"] - s["x0"], s["y1"] - s["y0"]
            len2 = dx * dx + dy * dy
            start = F.greatest(F.lit(0.0), (prev - s["cum_m"]) / s["len_m"])
            free = ((p["x"] - s["x0"]) * dx + (p["y"] - s["y0"]) * dy) / len2
            f = F.least(F.lit(1.0), F.greatest(start, free))
            ex, ey = p["x"] - s["x0"] - f * dx, p["y"] - s["y0"] - f * dy
            return F.struct(F.sqrt(ex * ex + ey * ey).alias("orth"), s["seg_no"].alias("k"),
                            (s["cum_m"] + f * s["len_m"]).alias("along"))

        rest = F.filter("segs", lambda s: (s["cum_m"] + s["len_m"] > prev) & (s["len_m"] > 0))
        return F.array_min(F.transform(rest, on))["along"]

    def step(acc, p):
        prev = acc["prev"]
        free = _best(p["x"], p["y"], "segs")["along_m"]
        d = (
            F.when(free >= prev, free)
            .when(free >= prev - tol_m, prev)
            .when(prev >= F.col("shape_length_m"), F.col("shape_length_m"))
            .otherwise(ahead(p, prev))
        )
        return F.struct(d.alias("prev"), F.concat(acc["out"], F.array(d)).alias("out"))

    start = F.struct(F.lit(0.0).alias("prev"), F.array().cast("array<double>").alias("out"))
    return joined.withColumn("distances", F.aggregate("stops", start, step)["out"]).drop("segs")


def route_stops(trips: DataFrame, stop_times: DataFrame, stops: DataFrame, segments: DataFrame) -> DataFrame:
    """Ordered stops of every route and direction along its canonical shape. A stop visited
    twice counts at its first visit."""
    keys = ["route_id", "direction_id"]
    canon = canonical_shape(trips, stop_times)
    first_visit = (
        stop_times.join(canon, "trip_id")
        .groupBy(*keys, "shape_id", "stop_id")
        .agg(F.min("stop_sequence").alias("stop_sequence"))
    )
    located = with_xy(first_visit.join(stops, "stop_id"), "stop_lon", "stop_lat")
    entry = F.struct("stop_sequence", "stop_id", "stop_name", "stop_lat", "stop_lon", "x", "y")
    lists = located.groupBy(*keys, "shape_id").agg(F.array_sort(F.collect_list(entry)).alias("stops"))
    measured = monotone_stop_distances(lists, segments)
    return measured.select(
        *keys, "shape_id", "shape_length_m",
        F.posexplode(F.arrays_zip("stops", "distances")).alias("stop_idx", "s"),
    ).select(
        *keys, "shape_id", "shape_length_m", "stop_idx",
        "s.stops.stop_id", "s.stops.stop_name", "s.stops.stop_lat", "s.stops.stop_lon",
        "s.stops.stop_sequence", F.col("s.distances").alias("distance_m"),
    )


# --- checks -------------------------------------------------------------------------------


def shape_variants(trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Trips per route, direction and shape, with the share off the canonical shape."""
    keys = ["route_id", "direction_id"]
    per = trips.filter("shape_id is not null").groupBy(*keys, "shape_id").agg(F.count("*").alias("trips"))
    canon = canonical_shape(trips, stop_times).select(*keys, F.col("shape_id").alias("canonical_shape_id"))
    total = Window.partitionBy(*keys)  # a few shapes per route
    off = F.when(F.col("shape_id") != F.col("canonical_shape_id"), F.col("trips")).otherwise(0)
    return per.join(canon, keys, "left").withColumn(
        "non_canonical_share", F.sum(off).over(total) / F.sum("trips").over(total)
    )


def shape_variant_compare(trips: DataFrame, stop_times: DataFrame, stops: DataFrame, segments: DataFrame) -> DataFrame:
    """For each route, direction and variant shape: one stop shared with the canonical trip and
    its distance along both shapes. The variant's lowest trip id with a shared stop, and that
    trip's lowest shared stop id, represent it."""
    keys = ["route_id", "direction_id"]
    canon = canonical_shape(trips, stop_times).select(
        *keys, F.col("shape_id").alias("canonical_shape_id"), F.col("trip_id").alias("canonical_trip_id")
    )
    variant = trips.join(canon, keys).filter("shape_id is not null and shape_id <> canonical_shape_id")
    of_variant = variant.join(stop_times.select("trip_id", "stop_id"), "trip_id")
    of_canon = canon.join(
        stop_times.select(F.col("trip_id").alias("canonical_trip_id"), "stop_id"), "canonical_trip_id"
    ).select(*keys, "stop_id").distinct()
    shared = (
        of_variant.join(of_canon, [*keys, "stop_id"])
        .groupBy(*keys, "shape_id", "canonical_shape_id")
        .agg(F.min(F.struct("trip_id", "stop_id")).alias("pick"))
        .select(*keys, "shape_id", "canonical_shape_id", "pick.trip_id", "pick.stop_id")
        .join(stops.select("stop_id", F.col("stop_lon").alias("longitude"), F.col("stop_lat").alias("latitude")), "stop_id")
    )
    on_own = nearest_on_shape_unpruned(shared, segments).withColumnRenamed("travel_distance_m", "variant_m")
    on_canon = nearest_on_shape_unpruned(
        on_own.drop("orthogonal_distance_m").withColumnsRenamed({"shape_id": "variant_shape_id", "canonical_shape_id": "shape_id"}),
        segments,
    )
    return on_canon.select(
        *keys, "variant_shape_id", F.col("shape_id").alias("canonical_shape_id"), "trip_id", "stop_id",
        "variant_m", F.col("travel_distance_m").alias("canonical_m"),
        F.abs(F.col("variant_m") - F.col("travel_distance_m")).alias("difference_m"),
    )


def shape_length_check(segments: DataFrame) -> DataFrame:
    """Planar length against the great-circle length of the same vertices."""
    hav = geo.haversine_m(F.col("shape_pt_lon"), F.col("shape_pt_lat"), F.col("next_lon"), F.col("next_lat"))
    return segments.groupBy("shape_id").agg(
        F.sum("len_m").alias("planar_m"), F.sum(hav).alias("haversine_m")
    ).withColumn("abs_error", F.abs(F.try_divide("planar_m", "haversine_m") - 1))


def stop_order_check(route_stops: DataFrame, probes: int = 200) -> DataFrame:
    """Is the stop sequence strictly increasing in distance order, and is the stop index
    monotone over evenly spaced probe distances."""
    from .buses import distance_to_stop_index

    keys = ["route_id", "direction_id"]
    by_distance = Window.partitionBy(*keys).orderBy("distance_m", "stop_idx")
    seq = (
        route_stops.withColumn("prev", F.lag("stop_sequence").over(by_distance))
        .groupBy(*keys)
        .agg(
            F.bool_and(F.col("prev").isNull() | (F.col("stop_sequence") > F.col("prev"))).alias("sequence_ok"),
            F.max("distance_m").alias("_len"),
        )
    )
    line = seq.select(*keys, "_len", F.explode(F.sequence(F.lit(0), F.lit(probes - 1))).alias("k")).withColumn(
        "travel_distance_m", F.col("_len") * F.col("k") / (probes - 1)
    )
    by_probe = Window.partitionBy(*keys).orderBy("k")
    mono = (
        distance_to_stop_index(line, route_stops)
        .withColumn("prev", F.lag("stop_index").over(by_probe))
        .groupBy(*keys)
        .agg(F.bool_and(F.col("prev").isNull() | (F.col("stop_index") >= F.col("prev") - 1e-9)).alias("index_ok"))
    )
    return seq.drop("_len").join(mono, keys)


def projection_audit(points: DataFrame, segments: DataFrame, max_orth_m: float = DEFAULTS.max_orthogonal_m) -> DataFrame:
    """Projected points at any distance with ``off_route`` set; input of the audits below."""
    return nearest_on_shape_unpruned(points, segments).withColumn(
        "off_route", F.col("orthogonal_distance_m") > max_orth_m
    )
