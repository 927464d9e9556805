"""Spatial join of boxes as an equi-join on grid cells.

A box is filed under the cells that it covers on the grid of its own size class (cells grow by four from
class to class, so a box covers nine cells at most) and of every larger class that occurs. Two boxes meet on
the grid of the larger one's class, in the one cell that holds the lower left corner of their common box, so each
pair appears once and no ``distinct`` is needed. Large boxes cost no more than small ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.boxes import touches


def _level(b: Column, cell: float) -> Column:
    side = F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"], F.lit(cell))
    return F.ceil(F.log(side / cell) / F.log(F.lit(4.0)) - 1e-9).cast("int")


def _filed(df: DataFrame, name: str, cell: float, levels: list[int]) -> DataFrame:
    b = F.col(f"{name}.box")
    one = df.select(F.struct("*").alias(name)).where(b.isNotNull()).select("*", _level(b, cell).alias("own"))
    one = one.select("*", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda v: v >= F.col("own"))).alias("level"))
    size = F.lit(cell) * F.pow(F.lit(4.0), F.col("level"))
    cells = lambda low, high: F.sequence(F.floor(b[low] / size), F.floor(b[high] / size))
    return one.select("*", F.explode(cells("xmin", "xmax")).alias("cx")).select("*", F.explode(cells("ymin", "ymax")).alias("cy"))


def overlap_join(left: DataFrame, right: DataFrame, cell: float, how: Column | None = None) -> DataFrame:
    """Pairs ``l, r`` (structs of all columns) whose ``box`` columns touch; ``how`` is a further condition over ``l`` and ``r``.

    ``cell`` should be near the usual side of a box. Rows without a box meet nothing."""
    found = left.select(_level(F.col("box"), cell).alias("v")).unionByName(right.select(_level(F.col("box"), cell).alias("v")))
    # One small number for each size class that occurs, 32 or so at most.
    levels = sorted(r["v"] for r in found.where("v is not null").distinct().collect()) or [0]
    a = _filed(left, "l", cell, levels).withColumnRenamed("own", "l_own")
    b = _filed(right, "r", cell, levels).withColumnRenamed("own", "r_own")
    size = F.lit(cell) * F.pow(F.lit(4.0), F.col("level"))
    lb, rb = F.col("l.box"), F.col("r.box")
    once = (
        (F.col("level") == F.greatest("l_own", "r_own"))
        & (F.col("cx") == F.floor(F.greatest(lb["xmin"], rb["xmin"]) / size))
        & (F.col("cy") == F.floor(F.greatest(lb["ymin"], rb["ymin"]) / size))
    )
    joined = a.join(b, ["level", "cx", "cy"]).where(once & touches(lb, rb))
    return (joined.where(how) if how is not None else joined).select("l", "r")


def self_join(boxes: DataFrame, cell: float, how: Column | None = None) -> DataFrame:
    """Pairs of touching boxes of one table, ``l.fid < r.fid``."""
    order = F.col("l.fid") < F.col("r.fid")
    return overlap_join(boxes, boxes, cell, order if how is None else order & how)
