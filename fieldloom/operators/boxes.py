"""Axis-aligned box algebra as Column expressions over structs (xmin, ymin, xmax, ymax)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(xmin, ymin, xmax, ymax) -> Column:
    at = lambda v: (F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct(at(xmin).alias("xmin"), at(ymin).alias("ymin"), at(xmax).alias("xmax"), at(ymax).alias("ymax"))


def width(b: Column) -> Column:
    return b["xmax"] - b["xmin"]


def height(b: Column) -> Column:
    return b["ymax"] - b["ymin"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def perimeter(b: Column) -> Column:
    return 2 * (width(b) + height(b))


def touches(a: Column, b: Column) -> Column:
    """Inclusive overlap: boxes that share an edge or a corner count."""
    return (a["xmax"] >= b["xmin"]) & (a["xmin"] <= b["xmax"]) & (a["ymax"] >= b["ymin"]) & (a["ymin"] <= b["ymax"])


def common(a: Column, b: Column) -> Column:
    """The common box; meaningful where both touch."""
    return F.struct(
        F.greatest(a["xmin"], b["xmin"]).alias("xmin"), F.greatest(a["ymin"], b["ymin"]).alias("ymin"),
        F.least(a["xmax"], b["xmax"]).alias("xmax"), F.least(a["ymax"], b["ymax"]).alias("ymax"),
    )


def common_area(a: Column, b: Column) -> Column:
    x = F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"])
    y = F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"])
    return F.greatest(x, F.lit(0.0)) * F.greatest(y, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union has no area."""
    inter = common_area(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def flat(b: Column) -> list[Column]:
    return [b[n].alias(n) for n in ("xmin", "ymin", "xmax", "ymax")]
