"""Rings and polygons as arrays of (x, y) structs: measures, Chaikin smoothing, holes and parts, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_of_box(b: Column) -> Column:
    """The closed ring of a box, counter-clockwise from its lower left corner."""
    at = lambda x, y: F.struct(b[x].alias("x"), b[y].alias("y"))
    return F.array(at("xmin", "ymin"), at("xmax", "ymin"), at("xmax", "ymax"), at("xmin", "ymax"), at("xmin", "ymin"))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it: columns are expressions, and are copied where they are named."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _edges(ring: Column) -> Column:
    return once(ring, lambda r: F.arrays_zip(F.slice(r, F.lit(1), F.size(r) - 1).alias("p"), F.slice(r, F.lit(2), F.size(r) - 1).alias("q")))


def signed_area(ring: Column) -> Column:
    """Shoelace area of a closed ring, positive if counter-clockwise; taken about its first point, so that it is as exact far from the origin."""

    def about(r: Column) -> Column:
        base = F.get(r, F.lit(0))
        x, y = lambda p: p["x"] - base["x"], lambda p: p["y"] - base["y"]
        return F.aggregate(_edges(r), F.lit(0.0), lambda s, e: s + (x(e["p"]) * y(e["q"]) - x(e["q"]) * y(e["p"]))) / 2

    return once(ring, about)


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def ring_length(ring: Column) -> Column:
    step = lambda s, e: s + F.sqrt(F.pow(e["q"]["x"] - e["p"]["x"], 2) + F.pow(e["q"]["y"] - e["p"]["y"], 2))
    return F.aggregate(_edges(ring), F.lit(0.0), step)


def chaikin(ring: Column, rounds: int = 3) -> Column:
    """Corner cutting: each edge gives its points at one and three quarters; the ring stays closed."""
    for _ in range(rounds):
        cut = F.flatten(
            F.transform(
                _edges(ring),
                lambda e: F.array(
                    F.struct((e["p"]["x"] * 0.75 + e["q"]["x"] * 0.25).alias("x"), (e["p"]["y"] * 0.75 + e["q"]["y"] * 0.25).alias("y")),
                    F.struct((e["p"]["x"] * 0.25 + e["q"]["x"] * 0.75).alias("x"), (e["p"]["y"] * 0.25 + e["q"]["y"] * 0.75).alias("y")),
                ),
            )
        )
        ring = once(cut, lambda c: F.concat(c, F.slice(c, 1, 1)))
    return ring


def large_holes(rings: Column, least: float) -> Column:
    """The outer ring and the holes of at least an area."""
    return F.filter(rings, lambda r, i: (i == 0) | (ring_area(r) >= least))


def polygon_area(rings: Column) -> Column:
    """Area of the outer ring less that of the holes."""
    return F.aggregate(F.transform(rings, lambda r, i: F.when(i == 0, ring_area(r)).otherwise(-ring_area(r))), F.lit(0.0), lambda s, a: s + a)


def largest_part(parts: Column) -> Column:
    """The box of most area among an array of boxes; the first in order among equals."""
    area = lambda p: (p["xmax"] - p["xmin"]) * (p["ymax"] - p["ymin"])
    return F.array_max(F.transform(parts, lambda p, i: F.struct(area(p).alias("area"), (-i).alias("i"), p.alias("part"))))["part"]
