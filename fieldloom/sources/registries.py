"""Registries of engines, imagery sources and their bands, as literal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name, approach, whether a GPU is needed.
ENGINES = [
    ("delineate-anything", "YOLO instance segmentation", True),
    ("dinov3", "DINOv3 ViT backbone + DPT segmentation head", True),
    ("embedding", "Unsupervised K-means/spectral clustering on pixel embeddings", False),
    ("ensemble", "Multi-engine consensus via majority vote or intersection", True),
    ("ftw", "Semantic segmentation (UNet/UPerNet/DeepLabV3+)", True),
    ("geoai", "Mask R-CNN instance segmentation", True),
    ("prithvi", "Foundation model (ViT) + segmentation or embedding clustering", True),
]
#: Name, resolution in metres, number of bands, whether its bands are an embedding.
SOURCES = [
    ("google-embedding", 10.0, 64, True),
    ("hls", 30.0, 7, False),
    ("landsat", 30.0, 6, False),
    ("local", None, None, False),
    ("naip", 1.0, 4, False),
    ("sentinel2", 10.0, 12, False),
    ("spot", 6.0, 3, False),
    ("spot-pan", 1.5, 1, False),
    ("tessera-embedding", 10.0, 128, True),
    ("usgs-naip-plus", None, 4, False),
]
#: Bands of each source in order, and those that are red, green, blue and near infrared.
BANDS = {
    "hls": ("B1 B2 B3 B4 B5 B6 B7", "B4 B3 B2 B5"),
    "landsat": ("SR_B2 SR_B3 SR_B4 SR_B5 SR_B6 SR_B7", "SR_B4 SR_B3 SR_B2 SR_B5"),
    "naip": ("R G B N", "R G B N"),
    "sentinel2": ("B1 B2 B3 B4 B5 B6 B7 B8 B8A B9 B11 B12", "B4 B3 B2 B8"),
    "spot": ("R G B", "R G B"),
    "spot-pan": ("P", "P P P"),
    "usgs-naip-plus": ("R G B N", "R G B N"),
}
CANONICAL = ("R", "G", "B", "NIR")


def band_rows() -> list[tuple[str, str, int]]:
    """Source, canonical band, and its position from 1 in the source's composite."""
    out = []
    for source, (bands, roles) in BANDS.items():
        order = bands.split()
        out += [(source, role, order.index(native) + 1) for role, native in zip(CANONICAL, roles.split(), strict=False)]
    return out


def band_positions(source: str, names: list[str]) -> list[int]:
    """Positions of canonical bands; a local raster's are as they come."""
    if source == "local":
        return list(range(1, len(names) + 1))
    known = {band: at for s, band, at in band_rows() if s == source}
    if source not in BANDS:
        raise ValueError(f"source {source!r} has no bands by name")
    if missing := [n for n in names if n not in known]:
        raise ValueError(f"source {source!r} has no band {missing[0]!r}; it has {sorted(known)}")
    return [known[n] for n in names]


def as_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def as_sql(rows: list[tuple], names: tuple[str, ...]) -> str:
    """The same table as a VALUES list."""
    kinds = [next((type(r[k]) for r in rows if r[k] is not None), str) for k in range(len(names))]
    cast = {int: "INT", float: "DOUBLE", bool: "BOOLEAN", str: "VARCHAR"}

    def literal(v) -> str:
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    columns = ", ".join(f"CAST({n} AS {cast[k]}) AS {n}" for n, k in zip(names, kinds, strict=True))
    return f"SELECT {columns} FROM (VALUES {body}) AS t({', '.join(names)})"
