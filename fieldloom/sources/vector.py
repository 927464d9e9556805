"""Reading and writing tables of fields: Parquet datasets, GeoJSON, provenance."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.rings import ring_of_box

PARQUET, GEOJSON = (".parquet", ".geoparquet"), (".geojson", ".json")


def read_dataset(spark: SparkSession, path: str, needed: list[str] | None = None, skip_bad_files: bool = False) -> DataFrame:
    """A Parquet file, folder or glob, with the needed columns that it has (None: all), in the order asked for."""
    reader = spark.read.option("ignoreCorruptFiles", skip_bad_files).option("recursiveFileLookup", not any(c in path for c in "*?["))
    df = reader.parquet(path)
    if needed is None:
        return df
    return df.select(*[c for c in dict.fromkeys(needed) if c in df.columns])


def with_provenance(df: DataFrame, column: str = "source_tile_id") -> DataFrame:
    """Adds the stem of each row's file, unless the column is there."""
    if column in df.columns:
        return df
    return df.withColumn(column, F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]+)?(/[^/]*part-[^/]*)?$", 1))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of a GeoJSON collection: the properties, and ``rings`` of each polygon (part by part, as ``part``)."""
    raw = spark.read.text(path, wholetext=True)
    shape = "features array<struct<properties:map<string,string>,geometry:string>>"
    kind = "struct<type:string,coordinates:string>"
    features = raw.select(F.inline(F.from_json("value", f"struct<{shape.replace(' ', ':', 1)}>")["features"]))
    g = features.select("properties", F.from_json("geometry", kind).alias("g")).where(F.col("g.type").isin("Polygon", "MultiPolygon"))
    rings, parts = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    many = F.when(F.col("g.type") == "Polygon", F.array(F.from_json("g.coordinates", rings))).otherwise(F.from_json("g.coordinates", parts))
    points = lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return g.select("properties", F.posexplode(many).alias("part", "raw")).select("properties", "part", F.transform("raw", points).alias("rings"))


def geojson_features(df: DataFrame) -> DataFrame:
    """One GeoJSON feature per row, as ``feature``: the box as a polygon, all else as properties."""
    ring = F.transform(ring_of_box(F.col("box")), lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    properties = F.struct(*[c for c in df.columns if c != "box"])
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("feature"))


def write_vector(df: DataFrame, path: str, kind: str | None = None) -> None:
    """Parquet, or a folder of GeoJSON features by line; by the path's ending unless ``kind`` says. Other formats are refused."""
    ending = f".{kind}" if kind else os.path.splitext(path)[1].lower()
    if ending in PARQUET:
        df.write.mode("overwrite").parquet(path)
    elif ending in GEOJSON:
        geojson_features(df).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"can't write {ending or 'a file without ending'}: known are {', '.join(PARQUET + GEOJSON)}")


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    ending = os.path.splitext(path)[1].lower()
    if ending in PARQUET:
        return read_dataset(spark, path)
    if ending in GEOJSON:
        return read_geojson(spark, path)
    raise ValueError(f"can't read {ending or 'a file without ending'}: known are {', '.join(PARQUET + GEOJSON)}")


def footer_bbox(meta: bytes | str | None) -> tuple[float, float, float, float] | None:
    """Bounds in a GeoParquet footer's ``geo`` text: a list of four or an object; else None."""
    try:
        geo = json.loads(meta)
        box = geo["columns"][geo["primary_column"]]["bbox"]
        values = [box[k] for k in ("xmin", "ymin", "xmax", "ymax")] if isinstance(box, dict) else list(box)
        return tuple(map(float, values)) if len(values) == 4 else None
    except (TypeError, ValueError, KeyError, AttributeError):
        return None
