"""Delineation without a learnt model: embeddings to clusters, regions, merged and filtered fields with metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.config import FieldConfig
from fieldloom.operators import boxes, cluster, ensemble, evaluate, merge, rasters, shapes


def delineate(vectors: DataFrame, config: FieldConfig, columns: int, pixel_m: float = 10.0, k: int = 10, dims: int = 16, crop: DataFrame | None = None) -> DataFrame:
    """Fields from an embedding raster (``vec_id`` in row-major order over ``columns`` columns, ``embedding``).

    Pixels are clustered, connected pixels of a cluster form a field, overlapping fields are merged, small ones
    go, and, with a crop grid, those with too little of it. The boxes are in metres of the raster."""
    if not config.is_embedding():
        raise ValueError(f"source {config.source!r} has no embedding to cluster")
    labels = cluster.cluster(vectors, k, dims).where("cluster > 0")
    cells = labels.select(F.floor(F.col("vec_id") / columns).alias("row"), (F.col("vec_id") % columns).alias("col"), "cluster")
    regions = ensemble.regions(cells, "cluster", 4, columns).groupBy("root").agg(
        F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.count("*").alias("pixels")
    )
    at = lambda c, more: (F.col(c) + more) * pixel_m
    fields = regions.select(F.col("root").alias("fid"), boxes.box(at("c0", 0), at("r0", 0), at("c1", 1), at("r1", 1)).alias("box"))
    merged = merge.merge_fields(fields, pixel_m * 4)
    merged = merged.select("fid", "member_count", boxes.box("xmin", "ymin", "xmax", "ymax").alias("box"), F.col("union_area").alias("area_m2"))
    kept = shapes.area_between(merged, config.min_field_area_m2, config.max_field_area_m2)
    if crop is not None and config.lulc_filter:
        share = rasters.zonal_mean(kept, crop, pixel_m).where(F.col("mean") >= config.lulc_crop_threshold).select("fid", F.col("mean").alias("lulc:crop_fraction"))
        kept = kept.join(share, "fid")
    return shapes.with_metadata(kept.withColumn("id", F.col("fid").cast("string")), F.lit(config.engine), config.source, config.year)


def score(fields: DataFrame, reference: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Metrics of fields against reference fields, both with ``fid`` and ``box``."""
    return evaluate.metrics(reference, fields, threshold)
