"""Geodesy and grid arithmetic as native Columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
EFFECTIVE_RADIUS_M = 6371000.0 * 4.0 / 3.0
KM_PER_DEGREE = 111.32  # grids and pixel sizes
KM_PER_DEGREE_RANGE_BOX = 111.0  # range box around sites
MERCATOR_HALF_M = 20037508.34


def as_col(value: Column | str | float) -> Column:
    """Column name, number or Column, as a Column."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def round_half_up(value: Column | str, digits: int = 0) -> Column:
    """floor(x * 10^k + 0.5) / 10^k: halves go up, for negative numbers too."""
    scale = float(10**digits)
    # Spark's floor of a double is a bigint, which the division turns back into a double.
    return F.floor(as_col(value) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def round_pixel(value: Column | str) -> Column:
    return F.floor(as_col(value) + F.lit(0.5)).cast("int")


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(as_col, (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), chord))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(clamped))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial great-circle bearing in [0, 360)."""
    lat1, lon1, lat2, lon2 = map(as_col, (lat1, lon1, lat2, lon2))
    turn = F.radians(lon2 - lon1)
    east = F.sin(turn) * F.cos(F.radians(lat2))
    north = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.cos(turn)
    angle = F.degrees(F.atan2(east, north))
    return F.when(angle < 0, angle + 360.0).otherwise(angle)


def destination(lat, lon, bearing, distance_km) -> tuple[Column, Column]:
    """(lat, lon) reached from a point at a bearing and distance."""
    lat, lon, bearing = map(as_col, (lat, lon, bearing))
    arc = as_col(distance_km) / F.lit(EARTH_RADIUS_KM)
    phi, theta = F.radians(lat), F.radians(bearing)
    sin_lat = F.sin(phi) * F.cos(arc) + F.cos(phi) * F.sin(arc) * F.cos(theta)
    turn = F.atan2(F.sin(theta) * F.sin(arc) * F.cos(phi), F.cos(arc) - F.sin(phi) * sin_lat)
    return F.degrees(F.asin(sin_lat)), F.degrees(F.radians(lon) + turn)


def along_great_circle(lat1, lon1, lat2, lon2, arc, fraction) -> tuple[Column, Column]:
    """Slerp between two points; ``arc`` is their distance in radians.

    Points closer than 1e-12 rad give the first point.
    """
    lat1, lon1, lat2, lon2, arc, fraction = map(as_col, (lat1, lon1, lat2, lon2, arc, fraction))
    near = arc < 1e-12
    base = F.when(near, F.lit(1.0)).otherwise(F.sin(arc))
    a = F.sin((1.0 - fraction) * arc) / base
    b = F.sin(fraction * arc) / base
    p1, l1, p2, l2 = F.radians(lat1), F.radians(lon1), F.radians(lat2), F.radians(lon2)
    x = a * F.cos(p1) * F.cos(l1) + b * F.cos(p2) * F.cos(l2)
    y = a * F.cos(p1) * F.sin(l1) + b * F.cos(p2) * F.sin(l2)
    z = a * F.sin(p1) + b * F.sin(p2)
    lat = F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))
    lon = F.degrees(F.atan2(y, x))
    return F.when(near, lat1).otherwise(lat), F.when(near, lon1).otherwise(lon)


def mercator_x(lon) -> Column:
    return as_col(lon) * MERCATOR_HALF_M / 180.0


def mercator_y(lat) -> Column:
    lat = as_col(lat)
    return F.log(F.tan(F.lit(math.pi / 4) + lat * math.pi / 360.0)) * MERCATOR_HALF_M / math.pi


def latitude_of_mercator(y) -> Column:
    """Latitude of a Web-Mercator ordinate given in metres."""
    return F.degrees(2.0 * F.atan(F.exp(as_col(y) * math.pi / MERCATOR_HALF_M)) - math.pi / 2)


def tile_x(lon, zoom: int) -> Column:
    return F.floor((as_col(lon) + 180.0) / 360.0 * float(2**zoom))


def tile_y(lat, zoom: int) -> Column:
    phi = F.radians(as_col(lat))
    return F.floor((1.0 - F.log(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0 * float(2**zoom))


def tile_lon(x, zoom: int) -> Column:
    return as_col(x) / float(2**zoom) * 360.0 - 180.0


def tile_lat(y, zoom: int) -> Column:
    n = F.lit(math.pi) - 2.0 * math.pi * as_col(y) / float(2**zoom)
    return F.degrees(F.atan(0.5 * (F.exp(n) - F.exp(-n))))


def tile_bounds_m(x, y, zoom: int) -> dict[str, Column]:
    """Edges of a tile in Web-Mercator metres."""
    x, y, n = as_col(x), as_col(y), float(2**zoom)
    world = 2 * MERCATOR_HALF_M
    return {
        "west": x / n * world - MERCATOR_HALF_M,
        "north": F.lit(MERCATOR_HALF_M) - y / n * world,
        "east": (x + 1) / n * world - MERCATOR_HALF_M,
        "south": F.lit(MERCATOR_HALF_M) - (y + 1) / n * world,
    }


@dataclass(frozen=True)
class Grid:
    """Geometry of one raster: affine terms and size. Rasters themselves are pixel tables."""

    a: float
    c: float
    e: float
    f: float
    width: int
    height: int
    b: float = 0.0
    d: float = 0.0

    @staticmethod
    def from_bounds(west: float, south: float, east: float, north: float, width: int, height: int) -> Grid:
        return Grid((east - west) / width, west, (south - north) / height, north, width, height)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """west, south, east, north."""
        return self.c, self.f + self.height * self.e, self.c + self.width * self.a, self.f

    def pixel_km(self) -> float:
        """Mean pixel edge at the latitude of the grid centre."""
        centre = math.radians(self.f + self.height / 2 * self.e)
        return KM_PER_DEGREE * (abs(self.a) * math.cos(centre) + abs(self.e)) / 2

    def lon_lat(self, col, row) -> tuple[Column, Column]:
        col, row = as_col(col), as_col(row)
        lon, lat = self.a * col + self.c, self.e * row + self.f
        if self.b:
            lon = self.a * col + self.b * row + self.c
        if self.d:
            lat = self.d * col + self.e * row + self.f
        return lon, lat

    def col_row(self, lon, lat) -> tuple[Column, Column]:
        """Fractional pixel of a position; NULL for a singular transform."""
        lon, lat = as_col(lon), as_col(lat)
        if not self.b and not self.d:
            if abs(self.a * self.e) < 1e-15:
                return F.lit(None).cast("double"), F.lit(None).cast("double")
            return (lon - self.c) / self.a, (lat - self.f) / self.e
        det = self.a * self.e - self.b * self.d
        if abs(det) < 1e-15:
            return F.lit(None).cast("double"), F.lit(None).cast("double")
        return (
            (self.e * (lon - self.c) - self.b * (lat - self.f)) / det,
            (self.a * (lat - self.f) - self.d * (lon - self.c)) / det,
        )

    def contains(self, col, row) -> Column:
        col, row = as_col(col), as_col(row)
        return (col >= 0) & (col < self.width) & (row >= 0) & (row < self.height)


def range_steps(max_km: float, step_km: float = 0.2) -> list[float]:
    """Sweep distances by repeated addition, so the float sum decides the last step."""
    steps, distance = [], step_km
    while distance <= max_km:
        steps.append(distance)
        distance += step_km
    return steps
