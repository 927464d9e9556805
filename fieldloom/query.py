"""The polygon query over published datasets, by area, label and year; boxes or general polygons (WKB)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom import aoi
from fieldloom.functions import polygons
from fieldloom.functions.rings import ring_of_box
from fieldloom.operators import boxes, fields
from fieldloom.sources import manifest as tiles
from fieldloom.sources.vector import read_dataset

BOUNDS = ("xmin", "ymin", "xmax", "ymax")


def with_box(df: DataFrame) -> DataFrame:
    """Adds ``box`` from a ``bbox`` struct, flat bounds or the WKB of ``geometry``, whichever is there first."""
    if "box" in df.columns:
        return df
    if "bbox" in df.columns:
        return df.withColumnRenamed("bbox", "box")
    if set(BOUNDS) <= set(df.columns):
        return df.withColumn("box", boxes.box(*BOUNDS)).drop(*BOUNDS)
    if "geometry" in df.columns:
        return df.withColumn("box", boxes.box(*[polygons.measures("geometry")[n] for n in BOUNDS]))
    raise ValueError("a dataset of fields needs bbox, flat bounds or geometry")


def query_polygons(
    spark: SparkSession,
    study_area,
    source: str | None = None,
    manifest: DataFrame | None = None,
    year: int | None = None,
    label: str | None = "field",
    columns: list[str] | str | None = None,
    clip: bool = True,
    deduplicate: bool = True,
    max_features: int | None = None,
    skip_bad_files: bool = False,
) -> DataFrame:
    """Fields of a dataset (``source``) or of the tiles of a normal-form ``manifest`` that meet the study area.

    Rows are compared by their bounds first, which the scan can skip by; then by their exact shape, if they have one or
    the area isn't a box: only what shares some of the area stays. ``clip`` cuts to the area, whatever its shape; a row cut by an area
    that isn't convex is a polygon for each convex piece of it, and rows of boxes get a ``geometry`` by an area that isn't a box.
    Unreadable files of a ``source`` are an error unless they are to be skipped; those of tiles are skipped.
    An empty area, or no tiles, gives an empty result."""
    area = aoi.coerce(study_area)
    if area.empty:
        return spark.createDataFrame([], fields.EMPTY_SCHEMA)
    if manifest is not None:
        df = tiles.read_tiles(manifest, area.bounds)
        if df is None:
            return spark.createDataFrame([], fields.EMPTY_SCHEMA)
    elif source is not None:
        df = read_dataset(spark, source, skip_bad_files=skip_bad_files)
    else:
        raise ValueError("give a source or a manifest")
    df = with_box(df)
    df = df.where(fields.in_bounds(F.col("box"), area.bounds))
    df = fields.year_filter(fields.label_filter(df, label), year)
    order = [c for c in ("tile_ord", "row_ord", "time", "geometry_hash") if c in df.columns] or ["box"]
    if max_features is not None:
        df = df.orderBy(*[c for c in ("field_id",) if c in df.columns], *order).limit(max_features)
    shaped = "geometry" in df.columns and dict(df.dtypes)["geometry"] == "binary"
    exact = shaped or not area.is_box
    if exact:
        shape = F.col("geometry") if shaped else polygons.to_wkb(F.array(ring_of_box(F.col("box"))))
        df = df.withColumn("__cut", polygons.clip_to(shape, polygons.convex_pieces(area.parts))).where("__cut is not null")
    if deduplicate:
        key = next((c for c in ("field_id", "geometry_hash") if c in df.columns), None)
        if key is not None:
            df = fields.keep_first(df, key, order)
    if exact:
        df = df.withColumn("geometry", F.col("__cut")).drop("__cut") if clip else df.drop("__cut")
        if clip:
            df = df.drop("box").withColumn("box", boxes.box(*[polygons.measures("geometry")[n] for n in BOUNDS]))
    elif clip:
        df = fields.clip(df, area.bounds)
    wanted = fields.normal_columns(columns)
    if wanted is None:
        return df
    return df.select(*[c for c in wanted if c in df.columns and c not in ("box", "geometry")], *[c for c in ("geometry", "box") if c in df.columns])
