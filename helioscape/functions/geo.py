"""Geodesy as Column expressions."""
import math

from pyspark.sql import Column, functions as F

from .constants import EARTH_RADIUS_KM, MERCATOR_RADIUS_M
from .nulls import num

# WGS84 ellipsoid and the transverse-Mercator zone in use (central meridian 81 E).
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500_000.0
CENTRAL_MERIDIAN = 81.0


def unit_xyz(lat: Column, lon: Column) -> list[Column]:
    """Unit-sphere coordinates; chords on them order like great circles, poles and dateline included."""
    la, lo = F.radians(lat), F.radians(lon)
    return [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)]


def with_xyz(df, lat="lat", lon="lon"):
    x, y, z = unit_xyz(F.col(lat), F.col(lon))
    return df.withColumns({"ux": x, "uy": y, "uz": z})


def chord_km(chord: Column) -> Column:
    return num(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.greatest(chord / 2, num(0)), num(1)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_dlat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_dlon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_dlat * half_dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_dlon * half_dlon
    return num(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(a, num(1))))


def wrap_lon(lon: Column) -> Column:
    return F.pmod(lon + num(540), num(360)) - num(180)


def destination(lat: Column, lon: Column, bearing: Column, km: Column) -> tuple[Column, Column]:
    """(lat, lon) reached from a point along a bearing in degrees."""
    la, b, d = F.radians(lat), F.radians(bearing), km / num(EARTH_RADIUS_KM)
    sin_la2 = F.sin(la) * F.cos(d) + F.cos(la) * F.sin(d) * F.cos(b)
    east = F.atan2(F.sin(b) * F.sin(d) * F.cos(la), F.cos(d) - F.sin(la) * sin_la2)
    return F.degrees(F.asin(sin_la2)), wrap_lon(lon + F.degrees(east))


def merc_x(lon: Column) -> Column:
    return num(MERCATOR_RADIUS_M) * F.radians(lon)


def merc_y(lat: Column) -> Column:
    return num(MERCATOR_RADIUS_M) * F.log(F.tan(num(math.pi / 4) + F.radians(lat) / 2))


def inv_merc_y(y: Column) -> Column:
    return F.degrees(num(2) * F.atan(F.exp(y / num(MERCATOR_RADIUS_M))) - num(math.pi / 2))


def _krueger():
    """Series coefficients of the Krueger transverse Mercator, to the fourth power of n."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    inverse = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    latitude = [
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    ]
    return n, radius, forward, inverse, latitude


def project_metric(lat: Column, lon: Column, meridian: float = CENTRAL_MERIDIAN) -> tuple[Column, Column]:
    """lat/lon -> easting, northing in metres (northern-hemisphere false northing of 0)."""
    n, radius, forward, _, _ = _krueger()
    e = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - num(e) * F.atanh(num(e) * s))
    dlon = F.radians(lon - num(meridian))
    xi = F.atan2(t, F.cos(dlon))
    eta = F.asinh(F.sin(dlon) / F.sqrt(t * t + F.cos(dlon) * F.cos(dlon)))
    east, north = eta, xi
    for j, a in enumerate(forward, 1):
        north = north + num(a) * F.sin(num(2 * j) * xi) * F.cosh(num(2 * j) * eta)
        east = east + num(a) * F.cos(num(2 * j) * xi) * F.sinh(num(2 * j) * eta)
    k = UTM_SCALE * radius
    return num(UTM_FALSE_EASTING) + num(k) * east, num(k) * north


def unproject_metric(x: Column, y: Column, meridian: float = CENTRAL_MERIDIAN) -> tuple[Column, Column]:
    """easting, northing -> lat, lon."""
    _, radius, _, inverse, latitude = _krueger()
    k = UTM_SCALE * radius
    xi0, eta0 = y / num(k), (x - num(UTM_FALSE_EASTING)) / num(k)
    xi, eta = xi0, eta0
    for j, b in enumerate(inverse, 1):
        xi = xi - num(b) * F.sin(num(2 * j) * xi0) * F.cosh(num(2 * j) * eta0)
        eta = eta - num(b) * F.cos(num(2 * j) * xi0) * F.sinh(num(2 * j) * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, d in enumerate(latitude, 1):
        lat = lat + num(d) * F.sin(num(2 * j) * chi)
    return F.degrees(lat), num(meridian) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))


def block_id(lat: Column, lon: Column, step: float = 2.0) -> Column:
    """Spatial block label such as B5_-3."""
    i, j = F.floor(lat / num(step)), F.floor(lon / num(step))
    return F.concat(F.lit("B"), i.cast("string"), F.lit("_"), j.cast("string"))


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float,
           pad: float = 0.0) -> Column:
    """Plain range predicates, so they reach Parquet row-group statistics."""
    return lat.between(south - pad, north + pad) & lon.between(west - pad, east + pad)


def valid_coordinates(lat: Column, lon: Column) -> Column:
    return lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)


def segment_distance2(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared distance from a point to a segment in the plane."""
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, ((px - x1) * dx + (py - y1) * dy) / length2).otherwise(num(0))
    t = F.least(F.greatest(t, num(0)), num(1))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return ex * ex + ey * ey
