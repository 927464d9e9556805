"""Composites over a stream of scenes: an extension beyond the batch operators.

New observations arrive as files; cloudy ones are masked, repeats within the watermark are dropped, and each pixel's
window is summarised once it can't change any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.rasters import LANDSAT_BITS, bits_clear


def read_scenes(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_composite(scenes: DataFrame, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """``pixel, start, observations, nir_mean, nir_max`` of clear observations (``scene_id, pixel, ts, nir, qa``) by event-time window."""
    clear = scenes.where(bits_clear(F.col("qa"), LANDSAT_BITS)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["scene_id"])
    found = clear.groupBy(F.window("ts", every), "pixel").agg(F.count("*").alias("observations"), F.avg("nir").alias("nir_mean"), F.max("nir").alias("nir_max"))
    return found.select("pixel", F.col("window.start").alias("start"), "observations", "nir_mean", "nir_max")
