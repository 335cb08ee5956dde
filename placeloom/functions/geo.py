"""Distances, boxes and grid cells as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0
# Fixed value: miles in a kilometre.
MILES_PER_KM = 0.621371


def _chord(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2))
    return half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = _chord(lat1, lng1, lat2, lng2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_asin_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(_chord(lat1, lng1, lat2, lng2))))


def cosine_law_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    cos = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lng2) - F.radians(lng1)) + F.sin(F.radians(lat1)) * F.sin(F.radians(lat2))
    return EARTH_KM * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))


def box_deltas(lat: Column, radius_km: float, pad: float = 1.1) -> tuple[Column, Column]:
    """Half height and half width, in degrees, of a padded box around a circle; the width is bounded near the poles."""
    d_lat = F.lit(radius_km * pad / KM_PER_DEGREE)
    return d_lat, d_lat / F.cos(F.radians(F.greatest(F.lit(-89.9), F.least(F.lit(89.9), lat))))


def cell(lat: Column, lng: Column, size: float) -> tuple[Column, Column]:
    return F.floor(lat / size), F.floor(lng / size)


def known(lat: Column, lng: Column) -> Column:
    """Both recorded and neither zero, which stands for unknown."""
    return F.coalesce((lat != 0) & (lng != 0), F.lit(False))
