"""Coordinate systems in closed form, as Column expressions over degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of WGS 84: semi-major axis and flattening; the standard parallel of the equal-area grid; metres of a degree.
AXIS, FLATTENING, PARALLEL, DEGREE_M = 6378137.0, 1 / 298.257223563, 30.0, 111320.0
_E2 = FLATTENING * (2 - FLATTENING)
_E = math.sqrt(_E2)
_K0 = math.cos(math.radians(PARALLEL)) / math.sqrt(1 - _E2 * math.sin(math.radians(PARALLEL)) ** 2)


def equal_area_x(lon: Column) -> Column:
    """Easting of EPSG:6933 (cylindrical equal-area)."""
    return F.lit(AXIS * _K0) * F.radians(lon)


def equal_area_y(lat: Column) -> Column:
    """Northing of EPSG:6933."""
    s = F.sin(F.radians(lat))
    q = F.lit(1 - _E2) * (s / (1 - F.lit(_E2) * s * s) - F.lit(1 / (2 * _E)) * F.log((1 - F.lit(_E) * s) / (1 + F.lit(_E) * s)))
    return F.lit(AXIS) * q / F.lit(2 * _K0)


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone; longitude 180 belongs to zone 60."""
    zone = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60))
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


def mercator_x(lon: Column) -> Column:
    return F.lit(AXIS) * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    return F.lit(AXIS) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def pixel_count(xmin: Column, ymin: Column, xmax: Column, ymax: Column, resolution_m: float) -> Column:
    """Pixels that cover lon/lat bounds at a resolution."""
    mid = F.radians((ymin + ymax) / 2)
    return F.ceil((xmax - xmin) * DEGREE_M * F.cos(mid) / resolution_m) * F.ceil((ymax - ymin) * DEGREE_M / resolution_m)
