"""Steps whose work grows no faster than their input."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import polygons, rings
from fieldloom.operators import boxes, cluster, ensemble, merge, rasters, tiles


def test_corner_cutting_names_its_ring_once_a_round(spark):
    far = spark.range(1).select(rings.ring_of_box(boxes.box(3e9, 7e9, 3e9 + 37, 7e9 + 37)).alias("ring"))
    size = lambda rounds: len(far.select(rings.chaikin(F.col("ring"), rounds))._jdf.queryExecution().analyzed().toString())
    one, two, three = map(size, (1, 2, 3))
    assert three - two < 1.5 * (two - one)  # before, each round named the ring of the last one six times
    area = far.select(rings.ring_area(rings.chaikin(F.col("ring"), 3)).alias("a")).first()["a"]
    assert area == pytest.approx(37 * 37 * (1 - 0.125 * 1.3125), abs=1e-6)  # before, 10 digits were lost to the distance


def test_nearest_sends_k_rows_a_block_and_keeps_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in np.float32(rng.normal(size=5))]) for k in range(90)]
    rows += [(100 + k, rows[k % 3][1]) for k in range(40)]  # ties, whose least ids count
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [1.0, 2.0]), (203, [2.0, 4.0]), (204, [float("nan")] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {(r["vec_id"], r["rank"]): (r["other_id"], r["cosine"]) for r in cluster.nearest(df, df, 3, most=40, rows=30).collect()}
    for i, a in rows:
        near = []
        for j, b in rows:
            if i != j:
                fit = a and b and None not in a and None not in b and len(a) == len(b)
                c = round(sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5), 6) if fit else None
                near.append((2 if c is None else 0 if c != c else 1, -c if c is not None and c == c else 0.0, j))
        for n, (kind, c, j) in enumerate(sorted(near)[:3], start=1):
            got = found[i, n]
            assert got[0] == j and (got[1] is None if kind == 2 else got[1] != got[1] if kind == 0 else got[1] == pytest.approx(-c, abs=1e-9))
    even = df.where("vec_id < 200")
    plan = cluster.nearest(even, even, 3)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "FlatMapCoGroupsInArrow" in plan  # before, every pair went through a loop row by row


def test_zonal_statistics_send_no_pixels_to_the_driver(spark, tmp_path):
    rng = np.random.default_rng(6)
    zones = [(k, float(x), float(y), float(x + w), float(y + w)) for k, (x, y, w) in enumerate(zip(*rng.integers(0, 12, (2, 40)), rng.integers(0, 6, 40), strict=True))]
    pixels = [(r, c, float(rng.integers(0, 9))) for r in range(15) for c in range(15) if (r + c) % 4]
    # From files, as the planner takes their size for that of the pixels that zones cover.
    spark.createDataFrame(zones, "fid long, xmin double, ymin double, xmax double, ymax double").write.parquet(str(tmp_path / "z"))
    spark.createDataFrame(pixels, "row long, col long, value double").write.parquet(str(tmp_path / "p"))
    z = spark.read.parquet(str(tmp_path / "z")).select("fid", boxes.box("xmin", "ymin", "xmax", "ymax").alias("box"))
    z, grid = z.unionByName(z.where("fid < 9").withColumn("fid", F.col("fid") + 100)), spark.read.parquet(str(tmp_path / "p"))
    means = rasters.zonal_mean(z, grid)
    assert "BroadcastHashJoin" not in means._jdf.queryExecution().executedPlan().toString()  # before: the covered pixels
    found = {r["fid"]: (r["n_pixels"], r["mean"]) for r in means.collect()}
    share = {r["fid"]: r["fraction"] for r in rasters.window_majority(z, grid, 0.4).collect()}
    assert len(found) == 49
    for k, x0, y0, x1, y1 in zones + [(z[0] + 100, *z[1:]) for z in zones[:9]]:
        inside = [v for r, c, v in pixels if x0 <= c + 0.5 < x1 and y0 <= r + 0.5 < y1]
        assert found[k] == (len(inside), pytest.approx(sum(inside) / len(inside) if inside else 0.0))
        part = sum(v > 0 for v in inside) / ((x1 - x0) * (y1 - y0) or 1)
        assert share.get(k) == (pytest.approx(part) if part > 0.4 else None)


def test_polygon_columns_take_batches_and_agree_with_single_polygons(spark):
    rng = np.random.default_rng(12)

    def ring(n):
        angle, r = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(1, 5, n)
        points = np.stack([r * np.cos(angle), r * np.sin(angle)], axis=1) + rng.uniform(-50, 50, 2)
        return np.concatenate([points, points[:1]])

    shapes = [[[ring(int(rng.integers(3, 30))) for _ in range(int(rng.integers(1, 3)))] for _ in range(1 + (k % 4 == 0))] for k in range(60)]
    shapes += [[[np.array([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)], dtype=float)]], [[np.zeros((4, 2))]], [[np.array([(0, 0), (1, 0), (2, 0), (0, 0)], dtype=float)]], []]
    data = [(k, polygons.write_wkb(s)) for k, s in enumerate(shapes)] + [(len(shapes), b"")]
    df = spark.createDataFrame(data, "k long, geom binary")
    out = df.select("k", polygons.measures("geom").alias("m"), polygons.simplify("geom", 1.0).alias("s")).collect()
    for r in out:
        parts = shapes[r["k"]] if r["k"] < len(shapes) else []
        if not parts:
            assert r["m"]["area"] is None and r["m"]["valid"] is None and r["s"] is None
            continue
        every = np.concatenate([x for p in parts for x in p])
        want = (polygons.area(parts), polygons.length(parts), *polygons.centroid(parts), *every.min(axis=0), *every.max(axis=0), len(every))
        assert tuple(r["m"])[:9] == pytest.approx(want, abs=1e-6) and r["m"]["valid"] == polygons.valid(parts)
        assert bytes(r["s"]) == polygons.write_wkb(polygons.simplified(parts, 1.0))
    rings_ = spark.createDataFrame([(0, [[{"x": 0.0, "y": 1.0}, {"x": 2.0, "y": 3.0}], [{"x": 4.0, "y": 5.0}]]), (1, None), (2, [])], "k long, r array<array<struct<x:double,y:double>>>")
    wkb = {r["k"]: r["w"] for r in rings_.select("k", polygons.to_wkb("r").alias("w")).collect()}
    assert wkb[1] is None and bytes(wkb[2]) == polygons.write_wkb([[]]) and bytes(wkb[0]) == polygons.write_wkb([[np.array([(0.0, 1.0), (2.0, 3.0)]), np.array([(4.0, 5.0)])]])
    square = spark.range(3).select(polygons.measures(polygons.to_wkb(F.array(rings.ring_of_box(boxes.box(0, 0, F.col("id") + 1, 2))))).alias("m"))
    plan = square._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["m"]["area"] for r in square.collect()) == [2.0, 4.0, 6.0] and "ArrowEvalPython" in plan


def rectangles(rng, n, span, most):
    low = rng.integers(0, span, (n, 2)).astype(float)
    return np.concatenate([low, low + rng.integers(0, most, (n, 2)) * np.where(rng.random((n, 1)) < 0.05, 8, 1)], axis=1)


def common(a, b):
    return max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)


def squares(some):
    return {(x, y) for a in some for x in range(int(a[0]), int(a[2])) for y in range(int(a[1]), int(a[3]))}


def test_kernels_of_tiles_in_small_blocks(monkeypatch):
    monkeypatch.setattr(tiles, "PAIRS", 7)
    side = rectangles(np.random.default_rng(2), 150, 60, 9)
    zero = np.zeros(len(side), dtype=np.int64)
    found = sorted((min(i, j), max(i, j)) for a, b in tiles.touching(side, zero, zero, 1.0) for i, j in zip(a.tolist(), b.tolist(), strict=True))
    assert found == [(i, j) for i in range(150) for j in range(i + 1, 150) if (side[i, :2] <= side[j, 2:]).all() and (side[j, :2] <= side[i, 2:]).all()]
    key = np.arange(150) % 4
    inside = [(x, y) for x in range(64) for y in range(64)]
    want = [len(squares(side[key == k]) & set(inside)) for k in range(4)]
    assert tiles.cut_areas(side, zero, zero, key, 4, 1.0).tolist() == pytest.approx(want)
    rows = [pa.RecordBatch.from_pydict({"tx": t, "ty": [0] * len(t), "n": list(range(len(t)))}) for t in ([1, 1, 2], [2, 2], [2, 2], [3], [3, 4], [])]
    parts = [t.column("tx").to_pylist() for t in tiles.whole_tiles(iter(rows), 4)]
    assert sum(parts, []) == [1, 1, 2, 2, 2, 2, 2, 3, 3, 4] and len(parts) > 1 and not any(set(a) & set(b) for a, b in zip(parts, parts[1:], strict=False))


@pytest.mark.parametrize("wide", [False, True])
def test_merging_by_tiles(spark, wide):
    side = rectangles(np.random.default_rng(3), 260, 300, 22)
    if wide:  # one box over very many tiles: joined by size classes
        side[0] = (0, 0, 5000, 5000)
    rows = [(k, *map(float, a)) for k, a in enumerate(side)]
    df = spark.createDataFrame(rows, "fid long, xmin double, ymin double, xmax double, ymax double").select("fid", boxes.box(*tiles.SIDES).alias("box"))
    df = df.unionByName(spark.range(1000, 1001).select(F.col("id").alias("fid"), F.lit(None).cast(df.schema["box"].dataType).alias("box")))
    area = [(a[2] - a[0]) * (a[3] - a[1]) for a in side]
    links = []
    for i in range(len(side)):
        for j in range(i + 1, len(side)):
            c = common(side[i], side[j])
            if (side[i, :2] <= side[j, 2:]).all() and (side[j, :2] <= side[i, 2:]).all() and c and (c / (area[i] + area[j] - c) >= 0.1 or c / min(area[i], area[j]) >= 0.4):
                links.append((i, j))
    root = list(range(len(side)))
    for _ in root:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    pairs = merge.merge_pairs(df, 1.0, 0.1, 0.4)
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == links and len(links) > 30
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert wide or ("Join" not in plan and "MapInArrow" in plan)  # before, the table was shuffled and sorted twice
    assert {r["fid"]: r["root"] for r in merge.merge_roots(df, 1.0, 0.1, 0.4).collect()} == dict(enumerate(root)) | {1000: 1000}
    if wide:
        return
    found = {r["fid"]: (r["member_count"], r["xmin"], r["ymax"], r["union_area"]) for r in merge.merge_fields(df, 1.0, 0.1, 0.4).collect()}
    for k in set(root):
        own = side[[i for i in range(len(side)) if root[i] == k]]
        assert found.pop(k) == (len(own), own[:, 0].min(), own[:, 3].max(), pytest.approx(len(squares(own))))
    assert not found
    whole = df.withColumn("part", F.when(F.col("fid") % 2 == 0, "even"))
    kept = {r["part"]: (r["member_count"], r["union_area"]) for r in merge.dissolve(whole, "part", 1.0).collect()}
    assert kept == {"even": (131, pytest.approx(len(squares(side[::2]))))}


def test_pixels_as_masks(spark):
    side = rectangles(np.random.default_rng(9), 80, 70, 12) - 30
    rows = [(int(k % 4), *(float(v) for v in a)) for k, a in enumerate(side)] + [(0, -3.4, -3.4, -3.3, -3.3), (1, 0.0, 0.0, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "engine long, xmin double, ymin double, xmax double, ymax double").select("engine", boxes.box(*tiles.SIDES).alias("box"))
    df = df.withColumn("engine", F.nullif("engine", F.lit(3)))  # rows without an engine cover pixels, but have no vote
    for size in (1.0, 2.5):
        seen = {}
        for engine, x0, y0, x1, y1 in rows:
            for r in range(-40, 160):
                for c in range(-40, 160):
                    if x0 <= (c + 0.5) * size < x1 and y0 <= (r + 0.5) * size < y1:
                        seen.setdefault((r, c), set()).add(engine)
        found = [(r["row"], r["col"]) for r in ensemble.covered(df, size).collect()]
        assert len(found) == len(seen) and set(found) == set(seen)
        votes = {(r["row"], r["col"]): r["votes"] for r in ensemble.vote(df, 3, 0.5, size).collect()}
        assert votes == {k: len(v - {3}) for k, v in seen.items() if len(v - {3}) >= 2}
    plan = ensemble.covered(df, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "bit_or" in plan and plan.index("Generate explode([0,1,2") < plan.index("Exchange")  # pixels are laid out behind the shuffle
