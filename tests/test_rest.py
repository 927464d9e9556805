"""Configuration, registries, command line, stream and pipeline."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldloom import cli
from fieldloom.config import FieldConfig
from fieldloom.operators.ensemble import votes_needed
from fieldloom.sources.registries import band_positions


def test_config(tmp_path):
    c = FieldConfig(source=" Sentinel2 ", engine="EMBEDDING", year=2023, date_range=["2023-04-01", "2023-10-01"])
    assert (c.source, c.engine, c.date_range) == ("sentinel2", "embedding", ("2023-04-01", "2023-10-01"))
    c.to_yaml(tmp_path / "c.yaml")
    assert FieldConfig.from_yaml(tmp_path / "c.yaml") == c
    assert FieldConfig(year=2020).season() == ("2020-01-01", "2020-12-31")
    for wrong in ({"source": "mars"}, {"engine": "x"}, {"source": "local"}, {"cloud_cover_max": 200}, {"val_split": 1}, {"colour": 1}):
        with pytest.raises(ValueError):
            FieldConfig.from_dict(wrong)


def test_bands():
    assert band_positions("sentinel2", ["R", "G", "B", "NIR"]) == [4, 3, 2, 8]
    assert band_positions("spot-pan", ["R", "G", "B"]) == [1, 1, 1] and band_positions("local", ["R", "B"]) == [1, 2]
    with pytest.raises(ValueError):
        band_positions("spot", ["NIR"])


def test_votes():
    assert [votes_needed(n, t) for n, t in ((1, 0.5), (2, 0.5), (3, 0.5), (5, 0.5), (5, 0.9))] == [1, 2, 2, 3, 5]


def test_command_line(capsys):
    assert cli.main(["list-engines"]) == 0 and cli.main(["list-sources"]) == 0
    assert "embedding" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["query"])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_stream(spark, tmp_path):
    from fieldloom.streaming.scenes import read_scenes, windowed_composite

    rows = [(1, 7, "2024-01-01 10:00:00", 1.0, 0), (1, 7, "2024-01-01 10:00:00", 1.0, 0), (2, 7, "2024-01-01 11:00:00", 3.0, 0), (3, 7, "2024-01-01 12:00:00", 9.0, 8), (4, 7, "2024-01-05 12:00:00", 5.0, 0), (5, 7, "2024-01-09 12:00:00", 5.0, 0)]
    df = spark.createDataFrame(rows, "scene_id long, pixel long, t string, nir double, qa int").select("scene_id", "pixel", F.col("t").cast("timestamp").alias("ts"), "nir", "qa")
    df.write.parquet(str(tmp_path / "in"))
    q = windowed_composite(read_scenes(spark, str(tmp_path / "in"), df.schema)).writeStream.format("memory").queryName("composites").outputMode("append").start()
    try:
        q.processAllAvailable()
        first = spark.table("composites").orderBy("start").first()
        assert (first["observations"], first["nir_mean"], first["nir_max"]) == (2, 2.0, 3.0)
    finally:
        q.stop()


def test_pipeline(spark):
    from fieldloom.pipeline import delineate, score

    # Two halves of a 6 x 6 raster with embeddings far apart.
    rows = [(k, [1.0, 0.1 * (k % 2), 0.0] if k % 6 < 3 else [0.0, 0.1 * (k % 2), 1.0]) for k in range(36)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    config = FieldConfig(source="google-embedding", min_field_area_m2=100, lulc_filter=False)
    out = delineate(vectors, config, 6, 10.0, k=2, dims=2)
    assert sorted(r["area_m2"] for r in out.collect()) == [1800.0, 1800.0]
    assert score(out, out).first()["f1"] == 1
    with pytest.raises(ValueError):
        delineate(vectors, FieldConfig(), 6)


def test_spectral_assigns_every_vector(spark):
    from fieldloom.operators import cluster

    rows = [(k, [float(10 * (k % 2)) + 0.01 * (k % 7), 1.0 + 10 * ((k + 1) % 2), 0.01 * (k % 5)]) for k in range(200)]
    rows += [(200, [0.0, 0.0, 0.0]), (201, [float("nan"), 1.0, 1.0]), (202, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = cluster.spectral(vectors, 2, rows=60).collect()
    of = {r["vec_id"]: r["cluster"] for r in found}
    assert len(found) == 203 and of[200] == of[201] == of[202] == 0
    assert {of[k] for k in range(200)} <= {1, 2} and all(of[k] == of[k % 2] for k in range(200))


def test_auto_k_tries_the_whole_list_below_the_rows(spark, tmp_path):
    import random

    from fieldloom.plans import QUERIES

    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, 1) for _ in range(20)]) for k in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert [r["k"] for r in QUERIES["auto_k"](spark, str(tmp_path)).collect()] == [5, 10, 15, 20, 30]
