"""Configuration of a delineation run: defaults, normal forms, validation and YAML."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from fieldloom.sources.registries import ENGINES, SOURCES

FORMATS = {"parquet": ".parquet", "geoparquet": ".parquet", "geojson": ".geojson", "gpkg": ".gpkg"}
COMPOSITES = ("median", "greenest", "max_ndvi", "latest")
REMOTE = ("hls", "landsat", "naip", "sentinel2", "spot", "spot-pan")


@dataclass(frozen=True)
class FieldConfig:
    """What to delineate, from what, and how; checked when it is made."""

    source: str = "sentinel2"
    engine: str = "embedding"
    year: int = 2024
    study_area: str = ""
    output_path: str = "fields.parquet"
    output_format: str = "parquet"
    composite_method: str = "median"
    date_range: tuple[str, str] | None = None
    cloud_cover_max: int = 20
    local_path: str | None = None
    bands: dict[str, int] | None = None
    min_field_area_m2: float = 2500.0
    max_field_area_m2: float | None = None
    simplify_tolerance: float = 2.0
    lulc_filter: bool = True
    lulc_crop_threshold: float = 0.3
    allow_year_fallback: bool = False
    reference_boundaries: str | None = None
    val_split: float = 0.2
    engine_params: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in ("source", "engine", "output_format", "composite_method"):
            object.__setattr__(self, name, str(getattr(self, name)).strip().lower())
        if self.date_range is not None:
            object.__setattr__(self, "date_range", tuple(self.date_range))
        wrong = []
        for name, known in (("source", [s[0] for s in SOURCES]), ("engine", [e[0] for e in ENGINES]), ("output_format", FORMATS), ("composite_method", COMPOSITES)):
            if getattr(self, name) not in known:
                wrong.append(f"{name} {getattr(self, name)!r} is none of {', '.join(sorted(known))}")
        if self.source == "local" and not self.local_path:
            wrong.append("a local source needs local_path")
        if not 0 <= self.cloud_cover_max <= 100:
            wrong.append("cloud_cover_max must be from 0 to 100")
        if not 0 <= self.lulc_crop_threshold <= 1:
            wrong.append("lulc_crop_threshold must be from 0 to 1")
        if not 0 < self.val_split < 1:
            wrong.append("val_split must be between 0 and 1")
        if self.min_field_area_m2 < 0 or self.simplify_tolerance < 0:
            wrong.append("areas and tolerances can't be negative")
        if wrong:
            raise ValueError("; ".join(wrong))

    def with_(self, **changes) -> FieldConfig:
        return replace(self, **changes)

    def to_dict(self) -> dict[str, Any]:
        out = asdict(self)
        out["date_range"] = list(self.date_range) if self.date_range else None
        return out

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> FieldConfig:
        """Unknown keys are refused by name."""
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(data) - known):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**data)

    def to_yaml(self, path: str | Path) -> None:
        import yaml

        Path(path).write_text(yaml.safe_dump(self.to_dict(), sort_keys=False))

    @classmethod
    def from_yaml(cls, path: str | Path) -> FieldConfig:
        import yaml

        return cls.from_dict(yaml.safe_load(Path(path).read_text()) or {})

    def is_remote(self) -> bool:
        return self.source in REMOTE

    def is_embedding(self) -> bool:
        return next(s[3] for s in SOURCES if s[0] == self.source)

    def extension(self) -> str:
        return FORMATS[self.output_format]

    def season(self) -> tuple[str, str]:
        """The dates asked for, or the whole year."""
        return self.date_range or (f"{self.year}-01-01", f"{self.year}-12-31")
