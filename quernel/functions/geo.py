"""Distances and boxes on a sphere as Column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Radii of the sphere by unit, and kilometres or metres in a unit.
RADIUS = {"km": 6371.0, "mi": 3959.0, "m": 6_371_000.0}
IN_KM = {"km": 1.0, "mi": 1.60934, "m": 0.001}
IN_M = {"km": 1000.0, "mi": 1609.34, "m": 1.0}


def to_km(value: float, unit: str = "km") -> float:
    return value * IN_KM[unit]


def convert(value: Column, source: str, target: str) -> Column:
    return value if source == target else value * (IN_KM[source] / IN_KM[target])


def formatted(value: Column, unit: str) -> Column:
    """Two decimals and the unit."""
    return F.concat(F.format_string("%.2f", value.cast("double")), F.lit(unit))


def _c(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def distance(lat1: Column | float, lng1: Column | float, lat2: Column | float, lng2: Column | float, unit: str = "km") -> Column:
    """Great-circle distance (haversine)."""
    a1, o1, a2, o2 = (F.radians(_c(x)) for x in (lat1, lng1, lat2, lng2))
    a = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return 2 * RADIUS[unit] * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def within_radius(lat: Column, lng: Column, centre_lat: Column | float, centre_lng: Column | float, radius: Column | float, unit: str = "km") -> Column:
    return distance(lat, lng, centre_lat, centre_lng, unit) <= _c(radius)


def within_bounds(lat: Column, lng: Column, south: Column | float, west: Column | float, north: Column | float, east: Column | float) -> Column:
    """Inclusive; a box doesn't wrap at the 180th meridian."""
    return lat.between(_c(south), _c(north)) & lng.between(_c(west), _c(east))


def bounds(lat: float, lng: float, radius: float, unit: str = "km") -> tuple[float, float, float, float]:
    """South, west, north and east of a circle."""
    reach = math.degrees(to_km(radius, unit) / RADIUS["km"])
    across = reach / math.cos(math.radians(lat))
    return lat - reach, lng - across, lat + reach, lng + across


def box_filter(lat: Column, lng: Column, centre_lat: float, centre_lng: float, radius: float, unit: str = "km") -> Column:
    """A condition on plain columns that every point of the circle meets, for the scan's row groups; also near poles and the 180th meridian."""
    south, west, north, east = bounds(centre_lat, centre_lng, radius * 1.0001, unit)
    test = lat.between(south, north)
    if south > -89 and north < 89 and west >= -180 and east <= 180:
        lean = math.degrees(math.asin(min(1.0, math.sin(min(to_km(radius * 1.0001, unit) / RADIUS["km"], math.pi / 2)) / math.cos(math.radians(centre_lat)))))
        if centre_lng - lean >= -180 and centre_lng + lean <= 180 and to_km(radius, unit) < RADIUS["km"]:
            test = test & lng.between(centre_lng - lean, centre_lng + lean)
    return test


def valid(lat: Column, lng: Column) -> Column:
    """Numbers within range."""
    ok = lat.isNotNull() & lng.isNotNull() & ~F.isnan(lat.cast("double")) & ~F.isnan(lng.cast("double"))
    return ok & lat.between(-90, 90) & lng.between(-180, 180)


def centroid(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Aggregates: latitude and longitude of the mean direction; null for no points and for directions that cancel out."""
    a, o = F.radians(lat), F.radians(lng)
    x, y, z = F.avg(F.cos(a) * F.cos(o)), F.avg(F.cos(a) * F.sin(o)), F.avg(F.sin(a))
    some = x * x + y * y + z * z > 1e-24
    return F.when(some, F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))), F.when(some, F.degrees(F.atan2(y, x)))


def box_of(lat: Column, lng: Column) -> list[Column]:
    """Aggregates: south, west, north, east."""
    return [F.min(lat).alias("south"), F.min(lng).alias("west"), F.max(lat).alias("north"), F.max(lng).alias("east")]


def boxes_meet(a: tuple, b: tuple) -> Column:
    """Whether two boxes (south, west, north, east) share a point."""
    return reduce(lambda x, y: x & y, [_c(a[2]) >= _c(b[0]), _c(a[0]) <= _c(b[2]), _c(a[3]) >= _c(b[1]), _c(a[1]) <= _c(b[3])])
