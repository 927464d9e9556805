"""Areas of interest from bounds, WKT, WKB, GeoJSON or a file, as polygons and bounds on the driver."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np

from fieldloom.functions.polygons import Polygon, area, read_wkb, read_wkt, ring_area


@dataclass(frozen=True)
class Area:
    """Polygons of an area; none if it is empty."""

    parts: list[Polygon]

    @property
    def empty(self) -> bool:
        return not self.parts or area(self.parts) == 0

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        points = np.concatenate([r for p in self.parts for r in p])
        return (*map(float, points.min(axis=0)), *map(float, points.max(axis=0)))

    @property
    def is_box(self) -> bool:
        x0, y0, x1, y1 = self.bounds
        return len(self.parts) == 1 and len(self.parts[0]) == 1 and abs(abs(ring_area(self.parts[0][0])) - (x1 - x0) * (y1 - y0)) < 1e-12 * max(1.0, (x1 - x0) * (y1 - y0))


def box_area(x0: float, y0: float, x1: float, y1: float) -> Area:
    return Area([[np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)], dtype=float)]])


def _geojson(data: dict) -> list[Polygon]:
    kind = data.get("type")
    if kind == "FeatureCollection":
        return [p for f in data.get("features", []) for p in _geojson(f)]
    if kind == "Feature":
        return _geojson(data.get("geometry") or {})
    closed = lambda r: np.array(r, dtype=float)[:, :2]
    if kind == "Polygon":
        return [[closed(r) for r in data["coordinates"]]]
    if kind == "MultiPolygon":
        return [[closed(r) for r in p] for p in data["coordinates"]]
    if kind == "GeometryCollection":
        return [p for g in data.get("geometries", []) for p in _geojson(g)]
    return []


def coerce(value) -> Area:
    """An area from an ``Area``, four numbers, WKB, a GeoJSON object or text, WKT, or the path of a GeoJSON file."""
    if isinstance(value, Area):
        return value
    if isinstance(value, (bytes, bytearray, memoryview)):
        return Area(read_wkb(bytes(value)))
    if isinstance(value, dict):
        return Area(_geojson(value))
    if isinstance(value, (list, tuple, np.ndarray)) and len(value) == 4:
        return box_area(*map(float, value))
    if isinstance(value, str):
        text = value.strip()
        if text.startswith("{"):
            return Area(_geojson(json.loads(text)))
        if text.upper().startswith(("POLYGON", "MULTIPOLYGON", "SRID=")):
            return Area(read_wkt(text))
        if os.path.exists(text):
            with open(text) as f:
                return Area(_geojson(json.load(f)))
        raise FileNotFoundError(f"neither a file nor a geometry: {value!r}")
    raise TypeError(f"can't make an area of {type(value).__name__}")
