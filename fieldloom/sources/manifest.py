"""Tile manifests: normal form, state, and pruning by extent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import boxes
from fieldloom.operators.fields import READABLE, in_bounds

#: Names that the columns of a manifest may have, best first.
PATHS = ("tile_path", "out_path", "path", "url", "href", "uri", "file", "filename", "parquet_path")
IDS = ("tile_id", "id", "name")
BOUNDS = (("minx", "miny", "maxx", "maxy"), ("xmin", "ymin", "xmax", "ymax"), ("left", "bottom", "right", "top"), ("west", "south", "east", "north"))


def find(columns: list[str], names: tuple[str, ...]) -> str | None:
    """The first of the names that is a column, whatever its case."""
    low = {c.lower(): c for c in reversed(columns)}
    return next((low[n] for n in names if n in low), None)


def readable(manifest: DataFrame) -> DataFrame:
    """Tiles whose state says that they can be read, if any says so; without a state, all."""
    state = find(manifest.columns, ("status", "state"))
    if state is None:
        return manifest
    fine = F.lower(state).isin(*READABLE)
    some = manifest.agg(F.coalesce(F.bool_or(fine), F.lit(False)).alias("__some"))  # one row
    return manifest.crossJoin(F.broadcast(some)).where(~F.col("__some") | fine).drop("__some")


def normalise(manifest: DataFrame, tile_dir: str | None = None) -> DataFrame:
    """``tile_id, tile_path, box`` of the readable tiles, from columns of whichever known names."""
    m = readable(manifest)
    path, key = find(m.columns, PATHS), find(m.columns, IDS)
    if path is None and (tile_dir is None or key is None):
        raise ValueError("a manifest needs a column of paths, or ids and a folder of tiles")
    where = F.col(path) if path else F.concat(F.lit(f"{tile_dir}/"), F.col(key).cast("string"), F.lit(".parquet"))
    name = F.col(key).cast("string") if key else F.regexp_extract(where, r"([^/]+?)(\.[^./]+)?$", 1)
    bounds = next((b for b in ([find(m.columns, (n,)) for n in names] for names in BOUNDS) if all(b)), None)
    if bounds is None and "box" not in m.columns:
        raise ValueError("a manifest needs bounds")
    return m.select(name.alias("tile_id"), where.alias("tile_path"), (boxes.box(*bounds) if bounds else F.col("box")).alias("box"))


def prune(manifest: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Tiles that meet the bounds, touching ones included."""
    return manifest.where(in_bounds(F.col("box"), bounds))


def read_tiles(manifest: DataFrame, bounds: tuple[float, float, float, float], most_tiles: int = 100_000) -> DataFrame | None:
    """The rows of all pruned tiles by one scan, unreadable files skipped; None without tiles.

    The paths of the tiles that meet the bounds go through the driver, ``most_tiles`` at most."""
    paths = [r["tile_path"] for r in prune(manifest, bounds).select("tile_path").limit(most_tiles + 1).collect()]
    if len(paths) > most_tiles:
        raise ValueError(f"more than {most_tiles} tiles meet the bounds; read their folder as one dataset")
    if not paths:
        return None
    return manifest.sparkSession.read.option("ignoreCorruptFiles", True).option("mergeSchema", True).parquet(*paths)
