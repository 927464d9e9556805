"""Field shapes: area filters, holes, metadata, bounds and parameter maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import rings as r
from fieldloom.operators import boxes
from fieldloom.operators.components import settled


def area_between(df: DataFrame, least: float = 0, most: float | None = None, column: str = "area_m2") -> DataFrame:
    """Rows whose area is at least ``least`` (if that is above 0) and at most ``most`` (if given)."""
    if least > 0:
        df = df.where(F.col(column) >= least)
    return df.where(F.col(column) <= most) if most is not None else df


def without_small_holes(df: DataFrame, least: float, column: str = "rings") -> DataFrame:
    return df.withColumn(column, r.large_holes(F.col(column), least))


def with_metadata(df: DataFrame, engine: Column, source: str, year: int) -> DataFrame:
    """Adds the measures and the provenance of a delineation to fields with ``id`` and ``box``."""
    b = F.col("box")
    return df.withColumns(
        {
            "metrics:area": boxes.area(b), "metrics:perimeter": boxes.perimeter(b), "determination:method": F.lit("auto-imagery"),
            "determination:datetime": F.lit(str(year)), "delineation:engine": engine, "delineation:source": F.lit(source), "delineation:year": F.lit(year),
        }
    )


def positional(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the rows' positions by ``order`` (from 0, without gaps; ties in any order) as a long column ``name``.

    Rows are dealt to key ranges, numbered within each, and moved on by the rows of the ranges before: no task sees all rows."""
    dealt = settled(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    # One row for each partition, shuffle partitions at most.
    sizes = dealt.groupBy("__range").count()
    ahead = F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__range", F.coalesce(ahead, F.lit(0)).alias("__start"))
    nth = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.select("*", nth.alias("__nth")).join(F.broadcast(starts), "__range").select(*df.columns, (F.col("__start") + F.col("__nth") - 1).alias(name))


def total_bounds(df: DataFrame) -> DataFrame:
    """Bounds of all boxes, their centre, and a map zoom for their extent."""
    one = df.agg(*[f(f"box.{n}").alias(n) for f, n in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))])
    extent = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    zoom = F.when(extent < 0.1, 14).when(extent < 1, 12).when(extent < 10, 9).otherwise(6)
    return one.select("*", ((F.col("xmin") + F.col("xmax")) / 2).alias("cx"), ((F.col("ymin") + F.col("ymax")) / 2).alias("cy"), zoom.alias("zoom"))


def override(base: Column, own: Column, drop: list[str]) -> Column:
    """A map of parameters with some replaced and some left out."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k) & ~k.isin(*drop) if drop else ~F.map_contains_key(own, k))
    return F.map_concat(kept, F.map_filter(own, lambda k, _: ~k.isin(*drop)) if drop else own)
