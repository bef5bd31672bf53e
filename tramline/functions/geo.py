"""Planar and spherical geometry as column arithmetic (no Python workers)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 and UTM zone 17N, with the published Krueger series coefficients.
SEMI_MAJOR_M = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE_K0 = 0.9996
CENTRAL_MERIDIAN_DEG = -81.0
FALSE_EASTING_M = 500000.0
THIRD_FLATTENING = FLATTENING / (2 - FLATTENING)
RECTIFYING_RADIUS_M = (
    SEMI_MAJOR_M / (1 + THIRD_FLATTENING) * (1 + THIRD_FLATTENING**2 / 4 + THIRD_FLATTENING**4 / 64)
)
ALPHA = (8.377318206304e-4, 7.608527714249e-7, 1.197638001561e-9, 2.443376194522e-12)
BETA = (8.377321640601e-4, 5.905869567934e-8, 1.673488880355e-10, 2.167737763022e-13)
DELTA = (3.356551469125e-3, 6.571873083960e-6, 1.764656400476e-8, 5.400482081694e-11)
EARTH_RADIUS_M = 6371000.0


def utm_xy(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees to zone-17N easting and northing in metres."""
    phi = F.radians(lat)
    lam = F.radians(lon - CENTRAL_MERIDIAN_DEG)
    c = 2 * math.sqrt(THIRD_FLATTENING) / (1 + THIRD_FLATTENING)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - c * F.atanh(c * s))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(ALPHA, start=1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k = SCALE_K0 * RECTIFYING_RADIUS_M
    return FALSE_EASTING_M + k * east, k * north


def utm_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """Inverse of ``utm_xy``."""
    k = SCALE_K0 * RECTIFYING_RADIUS_M
    xi0, eta0 = y / k, (x - FALSE_EASTING_M) / k
    xi, eta = xi0, eta0
    for j, b in enumerate(BETA, start=1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, d in enumerate(DELTA, start=1):
        phi = phi + d * F.sin(2 * j * chi)
    lam = F.atan2(F.sinh(eta), F.cos(xi))
    return CENTRAL_MERIDIAN_DEG + F.degrees(lam), F.degrees(phi)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlon / 2), 2
    )
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(h))


def foot_fraction(px: Column, py: Column, seg) -> Column:
    """Where the perpendicular of a point meets a segment, clamped to the segment."""
    dx, dy = seg["x1"] - seg["x0"], seg["y1"] - seg["y0"]
    dot = (px - seg["x0"]) * dx + (py - seg["y0"]) * dy
    len2 = dx * dx + dy * dy
    return F.when(len2 > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot / len2))).otherwise(F.lit(0.0))


def project_on_segment(px: Column, py: Column, seg, f: Column | None = None) -> Column:
    """``struct(orth_m, seg_no, along_m)`` of a point against one segment struct; the field
    order makes ``min`` pick the nearest segment, the first one on ties. ``f`` may be given
    where ``foot_fraction`` is already known."""
    if f is None:
        f = foot_fraction(px, py, seg)
    ex = px - seg["x0"] - f * (seg["x1"] - seg["x0"])
    ey = py - seg["y0"] - f * (seg["y1"] - seg["y0"])
    # to the micrometre, so that overlapping legs tie and the first one wins
    return F.struct(
        (F.rint(F.sqrt(ex * ex + ey * ey) * 1e6) / 1e6).alias("orth_m"),
        seg["seg_no"].alias("seg_no"),
        (seg["cum_m"] + f * seg["len_m"]).alias("along_m"),
    )


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    west, south, east, north = box
    return lon.between(west, east) & lat.between(south, north)
