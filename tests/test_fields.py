"""The polygon query on small tiles: pruning, label, year, first of each id, clip, projection, empties."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fieldloom import aoi
from fieldloom.functions import polygons
from fieldloom.operators import boxes, fields
from fieldloom.query import query_polygons
from fieldloom.sources import manifest
from fieldloom.sources.vector import footer_bbox, geojson_features, read_vector, write_vector

TILE = "field_id string, geometry_hash string, label string, time string, xmin double, ymin double, xmax double, ymax double"
WEST = [
    ("w-10", "g10", "field", "2031-04-02", 10.0, 10.0, 16.0, 14.0),
    ("w-11", "g11", "non_field_background", "2031-04-02", 12.0, 11.0, 15.0, 13.0),
    ("w-12", "g12", "field", "2030-09-30", 11.0, 12.0, 19.0, 19.0),
]
EAST = [("w-10", "g10-again", "field", "2031-06-01", 10.0, 10.0, 16.0, 14.0), ("e-20", "g20", "field", "2031-05-05", 22.0, 11.0, 29.0, 17.0)]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tiles")
    for n, (name, rows) in enumerate((("west", WEST), ("east", EAST))):
        df = spark.createDataFrame(rows, TILE).withColumn("tile_ord", F.lit(n))
        df.select("field_id", "geometry_hash", "label", "time", "tile_ord", F.struct("xmin", "ymin", "xmax", "ymax").alias("bbox")).coalesce(1).write.parquet(str(top / f"{name}.parquet"))
    (top / "broken.parquet").write_text("this is no Parquet file")
    rows = [("west", f"{top}/west.parquet", "ok", 10.0, 10.0, 20.0, 20.0), ("east", f"{top}/east.parquet", "OK", 10.0, 10.0, 30.0, 20.0), ("north", f"{top}/broken.parquet", "ok", 10.0, 80.0, 30.0, 90.0), ("gone", "x", "skipped_no_candidates", 10.0, 10.0, 20.0, 20.0)]
    return manifest.normalise(spark.createDataFrame(rows, "tile_id string, out_path string, status string, xmin double, ymin double, xmax double, ymax double"))


def ids(df):
    return sorted(r["field_id"] for r in df.collect())


def test_bounds_label_year_and_first(spark, store):
    assert ids(query_polygons(spark, [10, 10, 20, 20], manifest=store, year=2031)) == ["w-10"]
    found = query_polygons(spark, [10, 10, 30, 20], manifest=store, year=2031)
    assert ids(found) == ["e-20", "w-10"]
    assert {r["geometry_hash"] for r in found.collect()} == {"g10", "g20"}
    assert ids(query_polygons(spark, [10, 10, 30, 20], manifest=store, year=2031, deduplicate=False)) == ["e-20", "w-10", "w-10"]
    assert ids(query_polygons(spark, [10, 10, 20, 20], manifest=store, label=None, year=2031)) == ["w-10", "w-11"]


def test_clip(spark, store):
    size = lambda clip: query_polygons(spark, [10, 10, 13, 12], manifest=store, year=2031, clip=clip).select(boxes.area(F.col("box"))).first()[0]
    assert size(True) == pytest.approx(3 * 2) and size(False) == pytest.approx(6 * 4)


def test_broken_files(spark, store, tmp_path):
    """A tile that can't be read is skipped; a broken file of a source is an error unless told otherwise."""
    assert query_polygons(spark, [10, 10, 30, 90], manifest=store, year=2031).count() == 2
    spark.createDataFrame(WEST, TILE).write.parquet(str(tmp_path / "f"))
    (tmp_path / "f" / "part-x.parquet").write_text("this is no Parquet file")
    with pytest.raises(Exception):  # noqa: B017
        query_polygons(spark, [10, 10, 20, 20], str(tmp_path / "f")).count()
    assert query_polygons(spark, [10, 10, 20, 20], str(tmp_path / "f"), year=2031, skip_bad_files=True).count() == 1


#: Areas, and what they share with the boxes of ``BOXES``, worked out by hand.
BOXES = [("arm", 1.0, 5.0, 2.0, 6.0), ("inner", 5.0, 5.0, 7.0, 7.0), ("foot", 6.0, 1.0, 8.0, 2.0), ("corner", 9.0, 9.0, 10.0, 10.0), ("edge", 2.0, 2.0, 6.0, 6.0)]
AREAS = {
    "POLYGON ((0 0, 10 0, 10 3, 3 3, 3 10, 0 10, 0 0))": {"arm": 1.0, "foot": 2.0, "edge": 4 * 1 + 1 * 3},  # an L
    "POLYGON ((0 0, 10 0, 0 10, 0 0))": {"arm": 1.0, "foot": 2.0, "edge": 16 - 2.0},  # a triangle
    "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 8 4, 8 8, 4 8, 4 4))": {"arm": 1.0, "foot": 2.0, "corner": 1.0, "edge": 16 - 4.0},  # a hole
    "MULTIPOLYGON (((0 4, 3 4, 3 7, 0 7, 0 4)), ((2 5, 9 5, 9 6, 2 6, 2 5)), ((9 9, 10 9, 10 10, 9 9)))": {"arm": 1.0, "inner": 2.0, "corner": 0.5, "edge": 1 * 2 + 3 * 1},  # parts that overlap
}


@pytest.mark.parametrize("text", AREAS)
@pytest.mark.parametrize("shaped", [False, True])
def test_areas_of_any_shape(spark, tmp_path, text, shaped):
    from fieldloom.functions.rings import ring_of_box

    df = spark.createDataFrame([(n, "field", *b) for n, *b in BOXES], "field_id string, label string, xmin double, ymin double, xmax double, ymax double")
    df = df.select("field_id", "label", boxes.box("xmin", "ymin", "xmax", "ymax").alias("bbox"))
    if shaped:
        df = df.withColumn("geometry", polygons.to_wkb(F.array(ring_of_box(F.col("bbox")))))
    df.write.parquet(str(tmp_path / "f.parquet"))
    cut = query_polygons(spark, text, str(tmp_path / "f.parquet"))
    found = {r["field_id"]: r["a"] for r in cut.select("field_id", polygons.measures("geometry")["area"].alias("a")).collect()}
    assert found == pytest.approx(AREAS[text])
    assert set(ids(query_polygons(spark, text, str(tmp_path / "f.parquet"), clip=False))) == set(AREAS[text])


def test_empty_and_projection(spark, store):
    none = query_polygons(spark, [60, 60, 61, 61], manifest=store, year=2031)
    assert none.count() == 0 and none.columns == ["field_id", "geometry_hash", "label", "time", "year", "source_tile_id", "geometry"]
    assert query_polygons(spark, [10, 10, 20, 20], manifest=store, year=2031, columns="label, absent,field_id").columns == ["label", "field_id", "box"]
    assert query_polygons(spark, [10, 10, 30, 20], manifest=store, max_features=1).count() <= 1


@pytest.mark.parametrize("text, fits", [("2025", True), ("2025-03-01", True), ("2025/03", True), ("20250301", True), ("2025-03-01 10:00:00", True), ("2024-12-31", False), ("20251", False), ("soon", False), (None, False)])
def test_year_of_text(spark, text, fits):
    df = spark.createDataFrame([(text,)], "time string")
    assert df.select(fields.in_year(F.col("time"), 2025, "string")).first()[0] is fits


def test_filters_reach_the_scan(spark):
    from fieldloom.plans import QUERIES

    plan = QUERIES["year_filter_ts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan and "l_comment" not in plan


def test_general_polygons(spark, tmp_path):
    triangle = polygons.write_wkb([polygons.read_wkt("POLYGON ((0 0, 4 0, 0 4, 0 0))")[0]])
    df = spark.createDataFrame([("t", "field", bytearray(triangle), {"xmin": 0.0, "ymin": 0.0, "xmax": 4.0, "ymax": 4.0})], "field_id string, label string, geometry binary, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    df.write.parquet(str(tmp_path / "f.parquet"))
    cut = query_polygons(spark, [0, 0, 2, 2], str(tmp_path / "f.parquet"))
    assert cut.select(polygons.measures("geometry")["area"]).first()[0] == pytest.approx(4.0)
    # The bounds meet, the triangle doesn't.
    assert query_polygons(spark, [3, 3, 4, 4], str(tmp_path / "f.parquet")).count() == 0


def test_areas():
    assert aoi.coerce([0, 0, 2, 1]).bounds == (0, 0, 2, 1) and aoi.coerce("POLYGON ((0 0, 1 0, 1 1, 0 0))").bounds == (0, 0, 1, 1)
    geo = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 2], [0, 0]]]}}
    assert aoi.coerce(geo).bounds == aoi.coerce(json.dumps(geo)).bounds == (0, 0, 1, 2)
    assert aoi.coerce({"type": "FeatureCollection", "features": []}).empty
    with pytest.raises(FileNotFoundError):
        aoi.coerce("nowhere.geojson")
    with pytest.raises(TypeError):
        aoi.coerce(7)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x", 0.0, 0.0, 2.0, 1.0)], "field_id string, xmin double, ymin double, xmax double, ymax double").select("field_id", boxes.box("xmin", "ymin", "xmax", "ymax").alias("box"))
    feature = json.loads(geojson_features(df).first()[0])
    assert feature["properties"] == {"field_id": "x"} and feature["geometry"]["coordinates"][0][2] == [2.0, 1.0]
    collection = tmp_path / "c.geojson"
    collection.write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    back = read_vector(spark, str(collection)).first()
    assert back["properties"]["field_id"] == "x" and len(back["rings"][0]) == 5
    write_vector(df, str(tmp_path / "o.parquet"))
    assert read_vector(spark, str(tmp_path / "o.parquet")).count() == 1
    with pytest.raises(ValueError):
        write_vector(df, "o.shp")


def test_footers():
    text = json.dumps({"primary_column": "geometry", "columns": {"geometry": {"bbox": [1, 2, 3, 4]}}})
    assert footer_bbox(text) == (1, 2, 3, 4) and footer_bbox(None) is None and footer_bbox("{}") is None and footer_bbox("no json") is None
