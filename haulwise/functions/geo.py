"""Geospatial column expressions. Every function takes and returns columns, so plans stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0
# Kilometres per degree used by the point-to-segment and the planar formula.
KM_PER_DEG_LAT = 110.57
KM_PER_DEG_LON_EQUATOR = 111.32
PLANAR_KM_PER_DEG_LAT = 111.32
PLANAR_KM_PER_DEG_LON = 85.39
# Compass octants, clockwise from north.
OCTANTS = ("N", "NE", "E", "SE", "S", "SO", "O", "NO")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clamp(value: Column, low: float | Column, high: float | Column) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(high, value))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial great-circle bearing in [0, 360)."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    phi1, phi2, dlon = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(phi2)
    x = F.cos(phi1) * F.sin(phi2) - F.sin(phi1) * F.cos(phi2) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def compass(bearing) -> Column:
    """Octant name; '-' when the bearing is unknown."""
    bearing = _col(bearing)
    octant = (F.floor(F.pmod(bearing, F.lit(360.0)) / 45 + 0.5) % 8).cast("int")
    return F.coalesce(F.element_at(F.array(*map(F.lit, OCTANTS)), octant + 1), F.lit("-"))


def angle_diff(a, b) -> Column:
    diff = F.abs((_col(a) - _col(b)) % 360)
    return F.when(diff > 180, 360 - diff).otherwise(diff)


def point_segment_km(lat, lon, lat_a, lon_a, lat_b, lon_b) -> Column:
    """Distance from a point to a segment on a local equirectangular plane, projection clamped to the segment."""
    lat, lon, lat_a, lon_a, lat_b, lon_b = map(_col, (lat, lon, lat_a, lon_a, lat_b, lon_b))
    per_lon = F.lit(KM_PER_DEG_LON_EQUATOR) * F.cos(F.radians((lat_a + lat_b + lat) / 3))
    abx, aby = (lon_b - lon_a) * per_lon, (lat_b - lat_a) * KM_PER_DEG_LAT
    apx, apy = (lon - lon_a) * per_lon, (lat - lat_a) * KM_PER_DEG_LAT
    length2 = abx * abx + aby * aby
    t = F.when(length2 <= 0, F.lit(0.0)).otherwise(clamp(F.try_divide(apx * abx + apy * aby, length2), 0.0, 1.0))
    dx, dy = apx - t * abx, apy - t * aby
    return F.sqrt(dx * dx + dy * dy)


def planar_km(lat, lon, lat_ref, lon_ref) -> Column:
    dy = (_col(lat) - _col(lat_ref)) * PLANAR_KM_PER_DEG_LAT
    dx = (_col(lon) - _col(lon_ref)) * PLANAR_KM_PER_DEG_LON
    return F.sqrt(dy * dy + dx * dx)


def interpolate(a, b, ratio) -> Column:
    return _col(a) + (_col(b) - _col(a)) * _col(ratio)
