"""Distances, angles and speeds as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6371000.0


def number(value: float) -> Column:
    return F.lit(float(value))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS) -> Column:
    """Metres along the great circle."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    a = F.least(F.greatest(a, number(0)), number(1))
    return number(2 * radius) * F.atan2(F.sqrt(a), F.sqrt(number(1) - a))


def haversine_number(lat1: float, lon1: float, lat2: float, lon2: float, radius: float = EARTH_RADIUS) -> float:
    """The same for plain numbers, where a fold has to run in Python."""
    p, q = math.radians(lat1), math.radians(lat2)
    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    a = min(1.0, max(0.0, a))
    return 2 * radius * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def planar(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance in degrees."""
    return F.sqrt(F.pow(lon1 - lon2, 2) + F.pow(lat1 - lat2, 2))


def bearing(angle: Column) -> Column:
    """An angle from 0 to below 360."""
    return F.pmod(angle, number(360))


def between_bearings(first: Column, second: Column, share: Column) -> Column:
    """A bearing on the shorter way from one to another."""
    turn = second - first
    turn = F.when(turn > 180, turn - 360).when(turn < -180, turn + 360).otherwise(turn)
    return bearing(first + share * turn)


def bearing_error(one: Column, other: Column) -> Column:
    """The angle between two bearings, 0 to 180."""
    apart = F.pmod(F.abs(one - other), number(360))
    return F.least(apart, number(360) - apart)


def implied_speed(metres: Column, seconds: Column) -> Column:
    """Metres a second; infinite if no time went by."""
    return F.when(seconds > 0, metres / seconds).otherwise(number(float("inf")))


def stepwise(value: Column, steps: tuple[tuple[float, int], ...]) -> Column:
    """The number of the first step whose bound lies above the value."""
    out = None
    for bound, result in steps[:-1]:
        out = F.when(value < bound, result) if out is None else out.when(value < bound, result)
    last = F.lit(steps[-1][1])
    return last if out is None else out.otherwise(last)


def curvature(path: Column) -> Column:
    """Length along a path of points (lon, lat) over the straight line between its ends; at least 1."""
    size = F.size(path)
    legs = F.zip_with(F.slice(path, 1, F.greatest(size - 1, F.lit(0))), F.slice(path, 2, F.greatest(size - 1, F.lit(0))), lambda a, b: haversine(a["lat"], a["lon"], b["lat"], b["lon"]))
    length = F.aggregate(legs, number(0), lambda acc, x: acc + x)
    first, last = F.get(path, F.lit(0)), F.get(path, size - 1)
    chord = haversine(first["lat"], first["lon"], last["lat"], last["lon"])
    return F.when((size < 2) | (chord < 1e-6), number(1)).otherwise(F.greatest(number(1), length / chord))


def file_date(path: Column) -> Column:
    """The date in a file name such as AIS_2023_01_31.zip."""
    return F.try_to_date(F.regexp_replace(F.regexp_extract(path, r"(?i)AIS_(\d{4}_\d{2}_\d{2})[^/]*$", 1), "_", "-"))


def class_name(value: Column) -> Column:
    """A transceiver class, trimmed and in capitals."""
    return F.upper(F.trim(value))


def register(spark) -> None:
    """The geometric functions for SQL text."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION haversine_m(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN "
        "2 * 6371000D * atan2(sqrt(least(greatest(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2), 0D), 1D)), "
        "sqrt(1 - least(greatest(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2), 0D), 1D)))"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION bearing_between(a DOUBLE, b DOUBLE, share DOUBLE) RETURNS DOUBLE RETURN pmod(a + share * (b - a + CASE WHEN b - a > 180 THEN -360 WHEN b - a < -180 THEN 360 ELSE 0 END), 360D)")
    from .dtw import flat_dtw

    spark.udf.register("route_dtw", flat_dtw)
