"""Map projections as columns: EPSG 4326, 3857, and UTM 326xx / 327xx.

UTM is the Krueger series to third order in n (Karney 2011), good to a few
micrometres inside a zone; 3857 is the spherical Mercator.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# WGS 84 ellipsoid and UTM parameters.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING_SOUTH = 10000000.0

_n = FLATTENING / (2 - FLATTENING)
RECTIFYING_RADIUS = SEMI_MAJOR / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
ALPHA = (_n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16, 13 * _n**2 / 48 - 3 * _n**3 / 5, 61 * _n**3 / 240)
BETA = (_n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96, _n**2 / 48 + _n**3 / 15, 17 * _n**3 / 480)
DELTA = (2 * _n - 2 * _n**2 / 3 - 2 * _n**3, 7 * _n**2 / 3 - 8 * _n**3 / 5, 56 * _n**3 / 15)
CONFORMAL = 2 * math.sqrt(_n) / (1 + _n)


def _utm_zone(epsg: int) -> tuple[float, float]:
    """Central meridian in degrees and false northing."""
    zone, south = epsg % 100, epsg // 100 == 327
    return zone * 6 - 183.0, UTM_FALSE_NORTHING_SOUTH if south else 0.0


def is_utm(epsg: int) -> bool:
    return epsg // 100 in (326, 327) and 1 <= epsg % 100 <= 60


def to_lonlat(df: DataFrame, x: str, y: str, epsg: int, lon: str, lat: str) -> DataFrame:
    """Add degrees for coordinates of ``epsg``.

    Steps are columns of their own, dropped at the end, so that each series is
    evaluated once.
    """
    cx, cy = F.col(x), F.col(y)
    if epsg == 4326:
        return df.withColumns({lon: cx, lat: cy})
    if epsg == 3857:
        return df.withColumns({
            lon: F.degrees(cx / SEMI_MAJOR),
            lat: F.degrees(2 * F.atan(F.exp(cy / SEMI_MAJOR)) - math.pi / 2),
        })
    if not is_utm(epsg):
        raise ValueError(f"EPSG:{epsg} is not supported")
    meridian, false_northing = _utm_zone(epsg)
    scale = UTM_SCALE * RECTIFYING_RADIUS
    xi, eta, chi = F.col("_xi"), F.col("_eta"), F.col("_chi")
    xi1, eta1, phi = xi, eta, chi
    for j, b in enumerate(BETA, start=1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    for j, d in enumerate(DELTA, start=1):
        phi = phi + d * F.sin(2 * j * chi)
    return (
        df.withColumns({"_xi": (cy - false_northing) / scale, "_eta": (cx - UTM_FALSE_EASTING) / scale})
        .withColumns({"_xi1": xi1, "_eta1": eta1})
        .withColumn("_chi", F.asin(F.sin("_xi1") / F.cosh("_eta1")))
        .withColumns({lon: meridian + F.degrees(F.atan2(F.sinh("_eta1"), F.cos("_xi1"))), lat: F.degrees(phi)})
        .drop("_xi", "_eta", "_xi1", "_eta1", "_chi")
    )


def from_lonlat(df: DataFrame, lon: str, lat: str, epsg: int, x: str, y: str) -> DataFrame:
    """Add coordinates of ``epsg`` for degrees."""
    clon, clat = F.col(lon), F.col(lat)
    if epsg == 4326:
        return df.withColumns({x: clon, y: clat})
    if epsg == 3857:
        return df.withColumns({
            x: F.radians(clon) * SEMI_MAJOR,
            y: F.log(F.tan(F.radians(clat) / 2 + math.pi / 4)) * SEMI_MAJOR,
        })
    if not is_utm(epsg):
        raise ValueError(f"EPSG:{epsg} is not supported")
    meridian, false_northing = _utm_zone(epsg)
    scale = UTM_SCALE * RECTIFYING_RADIUS
    xi, eta, sp, dlon, t = (F.col(c) for c in ("_xi", "_eta", "_sp", "_dlon", "_t"))
    east, north = eta, xi
    for j, a in enumerate(ALPHA, start=1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return (
        df.withColumns({"_sp": F.sin(F.radians(clat)), "_dlon": F.radians(clon - meridian)})
        .withColumn("_t", F.sinh(F.atanh(sp) - CONFORMAL * F.atanh(CONFORMAL * sp)))
        .withColumns({"_xi": F.atan2(t, F.cos(dlon)), "_eta": F.atanh(F.sin(dlon) / F.sqrt(1 + t * t))})
        .withColumns({x: UTM_FALSE_EASTING + scale * east, y: false_northing + scale * north})
        .drop("_sp", "_dlon", "_t", "_xi", "_eta")
    )


def project(df: DataFrame, x: str, y: str, source: int, target: int, out_x: str, out_y: str) -> DataFrame:
    """Add the coordinates of ``target`` for those of ``source``; a copy when they are equal."""
    if source == target:
        return df.withColumns({out_x: F.col(x), out_y: F.col(y)})
    return from_lonlat(
        to_lonlat(df, x, y, source, "_lon", "_lat"), "_lon", "_lat", target, out_x, out_y).drop("_lon", "_lat")
