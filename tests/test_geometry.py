"""Polygon kernels against JTS, and joins, components and covers against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import geodesy, polygons, rings
from fieldloom.operators import boxes, catalog, cluster, evaluate, merge, shapes
from fieldloom.operators.components import connected_components
from fieldloom.operators.spatial_join import overlap_join


def star(rng, n=12):
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = rng.uniform(1, 5, n)
    points = np.stack([r * np.cos(angle), r * np.sin(angle)], axis=1)
    return np.concatenate([points, points[:1]])


def test_against_jts(spark):
    jts = spark._jvm.org.locationtech.jts
    reader, rng = jts.io.WKBReader(), np.random.default_rng(3)
    square = np.array([(-2, -2), (2, -2), (2, 2), (-2, 2), (-2, -2)], dtype=float)
    mask = reader.read(polygons.write_wkb([[square]]))
    for _ in range(40):
        parts = [[star(rng)]]
        g = reader.read(polygons.write_wkb(parts))
        if not g.isValid():
            continue
        assert polygons.valid(parts)
        assert polygons.area(parts) == pytest.approx(g.getArea()) and polygons.length(parts) == pytest.approx(g.getLength())
        assert polygons.centroid(parts) == pytest.approx((g.getCentroid().getX(), g.getCentroid().getY()))
        assert polygons.area(polygons.clipped(parts, square)) == pytest.approx(g.intersection(mask).getArea())
        assert polygons.area(polygons.read_wkb(bytes(jts.io.WKBWriter().write(g)))) == pytest.approx(g.getArea())
    bow = [[np.array([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)], dtype=float)]]
    assert not polygons.valid(bow)


def test_simplify_circle():
    a = np.linspace(0, 2 * np.pi, 101)
    ring = np.stack([100 * np.cos(a), 100 * np.sin(a)], axis=1)
    ring[-1] = ring[0]
    out = polygons.simplified([[ring]], 5.0)[0][0]
    assert 4 <= len(out) < 101 and abs(polygons.ring_area(out)) > 0.85 * np.pi * 1e4


def test_wkt_and_multi():
    parts = polygons.read_wkt("MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0), (0.5 0.5, 1 0.5, 1 1, 0.5 0.5)), ((5 5, 6 5, 6 6, 5 5)))")
    assert len(parts) == 2 and len(parts[0]) == 2
    assert polygons.area(polygons.read_wkb(polygons.write_wkb(parts))) == pytest.approx(4 - 0.125 + 0.5)
    assert polygons.read_wkt("POINT (1 2)") == [] and polygons.write_wkb([]) is None


def rectangles(rng, n, span, most):
    low = rng.integers(0, span, (n, 2)).astype(float)
    side = np.where(rng.random((n, 1)) < 0.05, span, rng.integers(1, most, (n, 2)))
    return [(k, *map(float, a), *map(float, a + s)) for k, (a, s) in enumerate(zip(low, side, strict=True))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "fid long, xmin double, ymin double, xmax double, ymax double").select("fid", boxes.box("xmin", "ymin", "xmax", "ymax").alias("box"))


def test_join_has_every_pair_once(spark):
    rng = np.random.default_rng(5)
    a, b = rectangles(rng, 150, 200, 20), rectangles(rng, 150, 200, 20)
    found = sorted((r["l"]["fid"], r["r"]["fid"]) for r in overlap_join(frame(spark, a), frame(spark, b), 10.0).collect())
    want = sorted((x[0], y[0]) for x in a for y in b if x[3] >= y[1] and x[1] <= y[3] and x[4] >= y[2] and x[2] <= y[4])
    assert found == want
    plan = overlap_join(frame(spark, a), frame(spark, b), 10.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_components_of_a_chain(spark):
    n = 200
    nodes = spark.range(n + 3).withColumnRenamed("id", "fid")
    links = spark.createDataFrame([(k, k + 1) for k in range(n - 1)] + [(n, n + 1)], "a long, b long")
    roots = {r["fid"]: r["root"] for r in connected_components(nodes, links).collect()}
    assert all(roots[k] == 0 for k in range(n)) and roots[n + 1] == n and roots[n + 2] == n + 2


def test_merge(spark):
    rows = [(1, 0.0, 0.0, 10.0, 10.0), (2, 5.0, 5.0, 15.0, 15.0), (3, 100.0, 100.0, 110.0, 110.0)]
    out = {r["fid"]: r for r in merge.merge_fields(frame(spark, rows), 10.0, iou=0.1).collect()}
    assert set(out) == {1, 3} and out[1]["union_area"] == pytest.approx(175) and out[1]["member_count"] == 2


def test_union_area_by_counting_squares(spark):
    rng = np.random.default_rng(11)
    rows = [(int(k % 4), float(x), float(y), float(x + w), float(y + h)) for k, (x, y, w, h) in enumerate(zip(*rng.integers(0, 40, (2, 120)), *rng.integers(0, 12, (2, 120)), strict=True))]
    rows += rows[:5] + [(9, -7.0, -7.0, -2.0, 3.0)]
    df = frame(spark, rows).withColumnRenamed("fid", "part")
    want = {}
    for key, x0, y0, x1, y1 in rows:
        want.setdefault(key, set()).update((x, y) for x in range(int(x0), int(x1)) for y in range(int(y0), int(y1)))
    for cell in (4.0, 15.0, 100.0):
        found = {r["part"]: r["union_area"] for r in merge.union_area(df, "part", cell).collect()}
        assert found == {k: pytest.approx(len(v)) for k, v in want.items()}
    empty = spark.createDataFrame([], df.schema)
    assert merge.union_area(empty, "part", 4.0).count() == 0


def test_components_of_random_links(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(7, 7), (8, 9), (9, 8)]
    root = list(range(300))
    for _ in range(300):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    found = connected_components(spark.range(300).withColumnRenamed("id", "fid"), spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["fid"]: r["root"] for r in found} == dict(enumerate(root)) and len(found) == 300


def test_positions(spark):
    keys = [5, 3, 3, 9, -1, 12, 7, 7, 7, 0] * 30
    out = shapes.positional(spark.createDataFrame([(k, "x") for k in keys], "k long, id string").repartition(3), ["k"], "at").collect()
    out.sort(key=lambda r: r["at"])
    assert [r["at"] for r in out] == list(range(300)) and [r["k"] for r in out] == sorted(keys)
    assert shapes.positional(spark.createDataFrame([], "k long"), ["k"], "at").count() == 0


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(8)
    rows = [(k, k % 30, [float(x) for x in rng.normal(size=4)]) for k in range(120)]
    v = spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>")
    q = v.where("vec_id % 3 = 0")
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(cluster.nearest(q, v, 4, most=7)) == plain(cluster.nearest(q, v, 4))
    assert plain(cluster.nearest_centroid(v, "label", most=7)) == plain(cluster.nearest_centroid(v, "label"))
    crossed = cluster.beside(v.select("vec_id"), q.select(F.col("vec_id").alias("q")), "vec_id", "q", 7, 50)
    assert plain(crossed) == sorted((a, b) for a in range(120) for b in range(0, 120, 3))


def test_metrics(spark):
    same = [(1, 0.0, 0.0, 200.0, 200.0), (2, 500.0, 500.0, 700.0, 700.0)]
    m = evaluate.metrics(frame(spark, same), frame(spark, same)).first()
    assert (m["precision"], m["recall"], m["f1"], m["iou_mean"], m["count_tp"]) == (1, 1, 1, 1, 2)
    m = evaluate.metrics(frame(spark, same), frame(spark, []), 0.4).first()
    assert (m["recall"], m["count_fn"], m["iou_threshold"]) == (0, 2, 0.4)
    m = evaluate.metrics(frame(spark, []), frame(spark, [])).first()
    assert (m["precision"], m["f1"], m["count_fp"]) == (1, 1, 0)


def test_cover(spark):
    rows = [(1, 1, 0.0, 0.0, 5.0, 10.0), (2, 2, 0.0, 0.0, 5.0, 10.0), (3, 3, 5.0, 0.0, 10.0, 10.0), (4, 4, 0.0, 0.0, 1.0, 1.0)]
    ranked = spark.createDataFrame(rows, "object_id long, rank int, xmin double, ymin double, xmax double, ymax double").select("object_id", "rank", boxes.box("xmin", "ymin", "xmax", "ymax").alias("box"))
    assert [r["object_id"] for r in catalog.greedy_cover(ranked, (0, 0, 10, 10), 10).collect()] == [1, 3]
    assert [r["object_id"] for r in catalog.greedy_cover(ranked, (50, 50, 60, 60), 10).collect()] == [1]


def test_coordinates(spark):
    places = [(-118.25, 34.05, 32611), (151.2, -33.87, 32756), (-0.12, 51.5, 32630), (37.0, 0.0, 32637), (-47.9, -15.8, 32723), (180.0, 1.0, 32660)]
    df = spark.createDataFrame(places, "lon double, lat double, want int")
    assert all(r[0] == r[1] for r in df.select(geodesy.utm_epsg(F.col("lon"), F.col("lat")), "want").collect())
    edge = spark.createDataFrame([(180.0, 90.0)], "lon double, lat double").select(geodesy.equal_area_x(F.col("lon")), geodesy.equal_area_y(F.col("lat") - 1e-9)).first()
    assert edge[0] == pytest.approx(17367530.45, abs=0.01) and edge[1] == pytest.approx(7342230.14, abs=0.01)


def test_chaikin_closes(spark):
    df = spark.range(1).select(rings.chaikin(rings.ring_of_box(boxes.box(0, 0, 4, 4)), 1).alias("r"))
    r = df.first()["r"]
    assert len(r) == 9 and r[0] == r[-1] and df.select(rings.ring_area(F.col("r"))).first()[0] == pytest.approx(14)
