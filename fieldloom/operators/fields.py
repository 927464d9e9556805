"""Queries of published field polygons: area of interest, label, year, de-duplication, clip, projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators import boxes

#: Columns and types of an empty result.
EMPTY_SCHEMA = "field_id string, geometry_hash string, label string, time string, year int, source_tile_id string, geometry binary"
#: Manifest states whose tiles can be read.
READABLE = ("ok", "exists", "complete", "completed", "written", "cached")


def in_bounds(b: Column, bounds: tuple[float, float, float, float]) -> Column:
    """Inclusive overlap with constant bounds, as comparisons that reach the Parquet scan."""
    x0, y0, x1, y1 = (float(v) for v in bounds)
    return (b["xmax"] >= x0) & (b["xmin"] <= x1) & (b["ymax"] >= y0) & (b["ymin"] <= y1)


def in_year(t: Column, year: int, kind: str) -> Column:
    """Whether a time falls in a year, by the type of its column.

    Times and dates become a half-open range, which the scan can use; text may be the year, start with
    the year and a separator, be compact (yyyymmdd), or parse as a timestamp; anything else is no match."""
    if kind in ("timestamp_ntz", "timestamp", "date"):
        return (t >= F.lit(f"{year:04d}-01-01").cast(kind)) & (t < F.lit(f"{year + 1:04d}-01-01").cast(kind))
    if kind == "string":
        short = t.rlike(rf"^{year:04d}($|[-/])") | t.rlike(rf"^{year:04d}(0[1-9]|1[0-2])[0-3]\d$")
        return F.coalesce(short | (F.year(F.try_to_timestamp(t)) == year), F.lit(False))
    return F.coalesce(t.cast("double") == float(year), F.lit(False))


def year_filter(df: DataFrame, year: int | None) -> DataFrame:
    """Rows of a year by the column ``year`` if there is one, else by ``time``; without either, all rows."""
    kinds = dict(df.dtypes)
    if year is None or not {"year", "time"} & kinds.keys():
        return df
    if "year" in kinds:
        return df.where(F.col("year") == (str(year) if kinds["year"] == "string" else year))
    return df.where(in_year(F.col("time"), year, kinds["time"]))


def label_filter(df: DataFrame, label: str | None) -> DataFrame:
    return df.where(F.col("label") == label) if label is not None and "label" in df.columns else df


def keep_first(df: DataFrame, key: str, order: list[str], spare: Column | None = None) -> DataFrame:
    """The first row of each key in the given total order; rows without a key all stay."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.select("*", n.alias("__n")).where(F.col(key).isNull() | (F.col("__n") == 1)).drop("__n")


def geometry_key(b: Column) -> Column:
    """A hash of a box's normalised corners."""
    return F.sha1(F.concat_ws(",", *[c.cast("long").cast("string") for c in boxes.flat(b)]).cast("binary"))


def clip(df: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Boxes cut to the bounds; those left without area go."""
    x0, y0, x1, y1 = (float(v) for v in bounds)
    cut = boxes.common(F.col("box"), boxes.box(x0, y0, x1, y1))
    return df.withColumn("box", cut).where((F.col("box.xmax") > F.col("box.xmin")) & (F.col("box.ymax") > F.col("box.ymin")))


def project(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """Requested columns that exist, in the order of the request, then the geometry."""
    wanted = [c for c in normal_columns(columns) or [c for c in df.columns if c != "box"] if c in df.columns and c != "box"]
    return df.select(*wanted, "box")


def normal_columns(columns: list[str] | str | None) -> list[str] | None:
    """Column names split at commas, trimmed, without repeats; None if nothing is left."""
    if columns is None:
        return None
    parts = [p.strip() for c in ([columns] if isinstance(columns, str) else columns) if c is not None for p in str(c).split(",")]
    return list(dict.fromkeys(p for p in parts if p)) or None


def query_fields(
    df: DataFrame,
    bounds: tuple[float, float, float, float],
    year: int | None = None,
    label: str | None = "field",
    columns: list[str] | None = None,
    cut: bool = True,
    deduplicate: bool = True,
    order: list[str] | None = None,
    max_features: int | None = None,
) -> DataFrame:
    """Fields that meet the bounds, of a label and year, first of each id, cut to the bounds.

    The order of the steps is part of the meaning: a limit comes before de-duplication, and that before
    the cut. ``order`` makes "first" definite."""
    found = year_filter(label_filter(df.where(in_bounds(F.col("box"), bounds)), label), year)
    order = order or [c for c in ("tile_ord", "row_ord") if c in df.columns] or ["field_id"]
    if max_features is not None:
        found = found.orderBy("field_id", *order).limit(max_features)
    if deduplicate and "field_id" in df.columns:
        found = keep_first(found, "field_id", order)
    return project(clip(found, bounds) if cut else found, columns)
