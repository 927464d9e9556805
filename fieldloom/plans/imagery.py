"""Queries over scenes, pixel grids and imagery catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import geodesy
from fieldloom.operators import boxes, catalog as cat, rasters
from fieldloom.plans import fixtures as fx
from fieldloom.plans.registry import query

AOI, YEAR = (100.0, 100.0, 500.0, 500.0), 1998
NEAR = "xmax >= 100 AND xmin <= 500 AND ymax >= 100 AND ymin <= 500"
NDVI = "CASE WHEN nir + red <> 0 THEN (nir - red) / (nir + red) END"


def _clear(spark, d):
    return fx.scenes(spark, d).where(rasters.bits_clear(F.col("qa"), rasters.LANDSAT_BITS))


def _ndvi():
    return rasters.normalised_difference(F.col("nir"), F.col("red"))


@query("qa_bitmask", f"WITH {fx.SCENES} SELECT scene_id, qa FROM scenes WHERE {fx.CLEAR}")
def qa_bitmask(spark, d):
    return _clear(spark, d).select("scene_id", "qa")


@query("scene_filter", f"WITH {fx.SCENES} SELECT scene_id, sensor, qa FROM scenes WHERE ts >= (SELECT min(ts) FROM scenes) + INTERVAL 5 DAY AND qa < 20")
def scene_filter(spark, d):
    s = fx.scenes(spark, d)
    first = s.agg((F.min("ts") + F.expr("INTERVAL 5 DAY")).alias("since"))  # one row
    return s.crossJoin(F.broadcast(first)).where((F.col("ts") >= F.col("since")) & (F.col("qa") < 20)).select("scene_id", "sensor", "qa")


@query(
    "scene_mission_union",
    f"""WITH {fx.SCENES}, m AS (SELECT scene_id, 1980 + CAST(scene_id % 45 AS INT) AS year, nir, red, CASE scene_id % 4 WHEN 0 THEN 'L5' WHEN 1 THEN 'L7' WHEN 2 THEN 'L8' ELSE 'L9' END AS mission FROM scenes)
    SELECT scene_id, mission, year, nir FROM m WHERE (mission = 'L5' AND year <= 2012) OR (mission = 'L7' AND year BETWEEN 1999 AND 2024) OR (mission = 'L8' AND year >= 2013) OR (mission = 'L9' AND year >= 2021)""",
)
def scene_mission_union(spark, d):
    k = F.col("scene_id")
    s = fx.scenes(spark, d).select("scene_id", (1980 + k % 45).cast("int").alias("year"), "nir", F.when(k % 4 == 0, "L5").when(k % 4 == 1, "L7").when(k % 4 == 2, "L8").otherwise("L9").alias("mission"))
    old = s.where("mission in ('L5', 'L7')").withColumnRenamed("nir", "band_4")
    new = s.where("mission in ('L8', 'L9')").withColumnRenamed("nir", "band_5")
    both = old.withColumnRenamed("band_4", "nir").unionByName(new.withColumnRenamed("band_5", "nir"))
    return both.where(rasters.mission_of_year(F.col("mission"), F.col("year"))).select("scene_id", "mission", "year", "nir")


@query("scene_year_window", f"WITH {fx.CATALOG} SELECT object_id, year FROM catalog WHERE year BETWEEN 1997 AND 1999")
def scene_year_window(spark, d):
    return fx.catalog(spark, d).where(F.col("year").between(YEAR - 1, YEAR + 1)).select("object_id", "year")


@query("ndvi", f"WITH {fx.SCENES} SELECT scene_id, round({NDVI}, 6) AS ndvi FROM scenes")
def ndvi(spark, d):
    return fx.scenes(spark, d).select("scene_id", F.round(_ndvi(), 6).alias("ndvi"))


@query("median_composite", f"WITH {fx.SCENES} SELECT pixel, round(median(nir), 6) AS nir, round(median(red), 6) AS red, count(*) AS observations FROM scenes WHERE {fx.CLEAR} GROUP BY pixel")
def median_composite(spark, d):
    out = rasters.median_composite(_clear(spark, d), ["pixel"], ["nir", "red"])
    return out.select("pixel", F.round("nir", 6).alias("nir"), F.round("red", 6).alias("red"), "observations")


@query(
    "greenest_composite",
    f"""WITH {fx.SCENES}, r AS (SELECT *, {NDVI} AS score, row_number() OVER (PARTITION BY pixel ORDER BY {NDVI} DESC, scene_id DESC) AS n FROM scenes WHERE {fx.CLEAR} AND {NDVI} IS NOT NULL)
    SELECT pixel, scene_id, round(nir, 6) AS nir, round(red, 6) AS red, round(score, 6) AS score FROM r WHERE n = 1""",
)
def greenest_composite(spark, d):
    top = rasters.best_observation(_clear(spark, d), ["pixel"], ["nir", "red"], _ndvi(), "scene_id")
    return top.select("pixel", "scene_id", *[F.round(c, 6).alias(c) for c in ("nir", "red", "score")])


@query("latest_mosaic", f"WITH {fx.SCENES}, r AS (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY ts DESC, scene_id DESC) AS n FROM scenes) SELECT pixel, scene_id, nir FROM r WHERE n = 1")
def latest_mosaic(spark, d):
    top = rasters.first_by(fx.scenes(spark, d), ["pixel"], F.col("ts").desc(), F.col("scene_id").desc())
    return top.select("pixel", "scene_id", "nir")


@query("mosaic_first", f"WITH {fx.SCENES}, v AS (SELECT pixel, scene_id, CASE WHEN qa >= 50 THEN nir END AS value FROM scenes) SELECT pixel, coalesce(arg_min(value, scene_id) FILTER (value IS NOT NULL), 0) AS value FROM v GROUP BY pixel")
def mosaic_first(spark, d):
    tiles = fx.scenes(spark, d).select("pixel", "scene_id", F.when(F.col("qa") >= 50, F.col("nir")).alias("value"))
    return rasters.first_valid(tiles, ["pixel"], "value", "scene_id")


@query("bitemporal_stack", f"WITH {fx.SCENES} SELECT pixel, round(median(nir) FILTER (day(ts) % 2 = 0), 6) AS nir_a, round(median(nir) FILTER (day(ts) % 2 = 1), 6) AS nir_b FROM scenes GROUP BY pixel")
def bitemporal_stack(spark, d):
    even = F.dayofmonth("ts") % 2 == 0
    half = lambda c, when, name: F.round(F.median(F.when(when, F.col(c))), 6).alias(name)
    return fx.scenes(spark, d).groupBy("pixel").agg(half("nir", even, "nir_a"), half("nir", ~even, "nir_b"))


@query(
    "band_percentile_stretch",
    f"""WITH {fx.SCENES}, p AS (SELECT quantile_cont(nir, 0.01) AS lo, quantile_cont(nir, 0.99) AS hi FROM scenes WHERE nir > 0)
    SELECT scene_id, CAST(trunc(least(greatest((nir - lo) / (hi - lo) * 255, 0), 255)) AS INT) AS nir_8bit FROM scenes, p""",
)
def band_percentile_stretch(spark, d):
    return rasters.stretch(fx.scenes(spark, d), "nir", 1, 99, F.col("nir") > 0).select("scene_id", "nir_8bit")


@query("band_zscore", f"WITH {fx.SCENES}, a AS (SELECT avg(nir) AS m, stddev_pop(nir) AS s FROM scenes) SELECT scene_id, round((nir - m) / s, 6) AS nir_z FROM scenes, a")
def band_zscore(spark, d):
    return rasters.zscore(fx.scenes(spark, d), "nir").select("scene_id", F.round("nir_z", 6).alias("nir_z"))


@query("band_reorder", f"WITH {fx.SCENES} SELECT scene_id, CAST(red AS REAL)::DOUBLE AS b1, CAST(nir AS REAL)::DOUBLE AS b2 FROM scenes")
def band_reorder(spark, d):
    finite = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c)).cast("float").cast("double")
    return fx.scenes(spark, d).select("scene_id", finite("red").alias("b1"), finite("nir").alias("b2"))


@query("raster_info", f"WITH {fx.GRID} SELECT max(row) + 1 AS height, max(col) + 1 AS width, count(*) AS pixels, count(DISTINCT label) AS classes FROM grid")
def raster_info(spark, d):
    return fx.label_grid(spark, d).agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"), F.count("*").alias("pixels"), F.countDistinct("label").alias("classes"))


@query("raster_window", f"WITH {fx.GRID} SELECT row - 5 AS row, col - 3 AS col, label FROM grid WHERE row BETWEEN 5 AND 14 AND col BETWEEN 3 AND 12")
def raster_window(spark, d):
    g = fx.label_grid(spark, d).where(F.col("row").between(5, 14) & F.col("col").between(3, 12))
    return g.select((F.col("row") - 5).alias("row"), (F.col("col") - 3).alias("col"), "label")


@query("raster_clip", f"WITH {fx.GRID} SELECT row, col, label FROM grid WHERE col + 0.5 >= 4 AND col + 0.5 < 15 AND row + 0.5 >= 2 AND row + 0.5 < 11")
def raster_clip(spark, d):
    from fieldloom.operators.ensemble import pixels

    mask = pixels(spark.range(1).select(boxes.box(4, 2, 15, 11).alias("box")), 1.0).select("row", "col")
    return fx.label_grid(spark, d).join(mask, ["row", "col"], "left_semi").select("row", "col", "label")


@query("raster_resample_nearest", f"WITH {fx.GRID} SELECT row // 2 AS row, col // 2 AS col, label AS value FROM grid WHERE row % 2 = 1 AND col % 2 = 1")
def raster_resample_nearest(spark, d):
    return rasters.nearest_resample(fx.label_grid(spark, d).withColumnRenamed("label", "value"), 2)


@query(
    "boundary_mask",
    f"""WITH {fx.GRID}, m AS (SELECT row, col FROM grid WHERE label <> 0), n(dr, dc) AS (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)),
    e1 AS (SELECT m.row + dr AS row, m.col + dc AS col FROM m, n GROUP BY 1, 2 HAVING count(*) = 5), e2 AS (SELECT e1.row + dr AS row, e1.col + dc AS col FROM e1, n GROUP BY 1, 2 HAVING count(*) = 5)
    SELECT m.row, m.col, CASE WHEN e2.row IS NULL THEN 2 ELSE 1 END AS class FROM m LEFT JOIN e2 ON e2.row = m.row AND e2.col = m.col""",
)
def boundary_mask(spark, d):
    return rasters.boundary(fx.label_grid(spark, d).where("label <> 0"), 2)


@query("chip_filter", f"WITH {fx.GRID} SELECT row // 5 AS chip_row, col // 5 AS chip_col, count(*) FILTER (label = 1) AS field_pixels FROM grid WHERE row // 5 < (SELECT (max(row) + 1) // 5 FROM grid) GROUP BY 1, 2 HAVING count(*) FILTER (label = 1) >= 0.01 * 25")
def chip_filter(spark, d):
    grid = fx.label_grid(spark, d)
    height = (grid.agg(F.max("row")).first()[0] or 0) + 1
    return rasters.chips(grid.select("row", "col", (F.col("label") == 1).cast("int").alias("value")), height, 25, 5)


@query("sliding_tiles", "WITH e AS (SELECT 1300 AS h, 900 AS w) SELECT i * 256 AS top, j * 256 AS \"left\", least(i * 256 + 512, h) AS bottom, least(j * 256 + 512, w) AS \"right\" FROM e, range(0, 6) a(i), range(0, 4) b(j)")
def sliding_tiles(spark, d):
    return rasters.sliding_windows(spark.range(1).select(F.lit(1300).cast("long").alias("height"), F.lit(900).cast("long").alias("width")), 512)


ZONAL = f"{fx.ZONES}, hit AS (SELECT fid, value FROM zones JOIN pixels ON col + 0.5 >= xmin AND col + 0.5 < xmax AND row + 0.5 >= ymin AND row + 0.5 < ymax), z AS (SELECT zones.fid, count(value) AS n_pixels, coalesce(avg(value), 0) AS mean FROM zones LEFT JOIN hit USING (fid) GROUP BY zones.fid)"


@query("zonal_mean", f"WITH {ZONAL} SELECT fid, n_pixels, round(mean + 1e-9, 4) AS mean FROM z")
def zonal_mean(spark, d):
    return rasters.zonal_mean(fx.zones(spark, d), fx.pixel_grid(spark, d)).select("fid", "n_pixels", F.round(F.col("mean") + 1e-9, 4).alias("mean"))


@query("zonal_mean_filter", f"WITH {ZONAL} SELECT fid, round(mean + 1e-9, 4) AS crop_fraction FROM z WHERE mean >= 0.1")
def zonal_mean_filter(spark, d):
    return rasters.zonal_mean(fx.zones(spark, d), fx.pixel_grid(spark, d)).where("mean >= 0.1").select("fid", F.round(F.col("mean") + 1e-9, 4).alias("crop_fraction"))


@query(
    "lulc_window_majority",
    f"""WITH {fx.ZONES}, w AS (SELECT fid, (xmax - xmin) * (ymax - ymin) AS cells FROM zones), hit AS (SELECT fid, count(*) AS n FROM zones JOIN pixels ON col + 0.5 >= xmin AND col + 0.5 < xmax AND row + 0.5 >= ymin AND row + 0.5 < ymax AND value > 0.05 GROUP BY fid)
    SELECT fid, round(n / cells, 6) AS fraction FROM hit JOIN w USING (fid) WHERE n / cells > 0.5""",
)
def lulc_window_majority(spark, d):
    marked = fx.pixel_grid(spark, d).select("row", "col", (F.col("value") > 0.05).cast("int").alias("value"))
    return rasters.window_majority(fx.zones(spark, d), marked).select("fid", F.round("fraction", 6).alias("fraction"))


@query(
    "lulc_route",
    """WITH p AS (SELECT s_suppkey AS id, CAST((s_suppkey * 37) % 360 - 180 AS DOUBLE) AS lon, CAST((s_suppkey * 17) % 160 - 80 AS DOUBLE) AS lat, 2010 + CAST(s_suppkey % 12 AS INT) AS year FROM supplier)
    SELECT id, CASE WHEN lon BETWEEN -125 AND -66 AND lat BETWEEN 24 AND 50 THEN 'nlcd' WHEN year >= 2015 THEN 'dynamic_world' ELSE 'c3s' END AS dataset,
    CASE WHEN lon BETWEEN -125 AND -66 AND lat BETWEEN 24 AND 50 THEN 30 WHEN year >= 2015 THEN 10 ELSE 300 END AS scale_m FROM p""",
)
def lulc_route(spark, d):
    k = F.col("s_suppkey")
    lon, lat, year = (k * 37) % 360 - 180, (k * 17) % 160 - 80, 2010 + k % 12
    conus = lon.between(-125, -66) & lat.between(24, 50)
    pick = lambda a, b, c: F.when(conus, a).when(year >= 2015, b).otherwise(c)
    return fx.table(spark, d, "supplier").select(k.alias("id"), pick("nlcd", "dynamic_world", "c3s").alias("dataset"), pick(30, 10, 300).alias("scale_m"))


PLACES = "places AS (SELECT c_custkey AS id, CAST((c_custkey * 7) % 340 - 170 AS DOUBLE) AS lon, CAST((c_custkey * 3) % 140 - 70 AS DOUBLE) AS lat FROM customer)"


def _places(spark, d):
    k = F.col("c_custkey")
    return fx.table(spark, d, "customer").select(k.alias("id"), ((k * 7) % 340 - 170).cast("double").alias("lon"), ((k * 3) % 140 - 70).cast("double").alias("lat"))


@query("utm_zone", f"WITH {PLACES} SELECT id, CAST((CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END) + least(floor((lon + 180) / 6) + 1, 60) AS INT) AS epsg FROM places")
def utm_zone(spark, d):
    return _places(spark, d).select("id", geodesy.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


E2 = "0.0066943799901413165"


@query(
    "equal_area_xy",
    f"""WITH {PLACES}, k AS (SELECT *, sin(radians(lat)) AS s, sqrt({E2}) AS e, cos(radians(30)) / sqrt(1 - {E2} * sin(radians(30)) ** 2) AS k0 FROM places)
    SELECT id, round(6378137.0 * k0 * radians(lon), 3) AS x, round(6378137.0 * (1 - {E2}) * (s / (1 - {E2} * s * s) - ln((1 - e * s) / (1 + e * s)) / (2 * e)) / (2 * k0), 3) AS y FROM k""",
)
def equal_area_xy(spark, d):
    return _places(spark, d).select("id", F.round(geodesy.equal_area_x(F.col("lon")), 3).alias("x"), F.round(geodesy.equal_area_y(F.col("lat")), 3).alias("y"))


@query(
    "pixel_count",
    f"WITH {PLACES} SELECT id, CAST(ceil(0.5 * 111320.0 * cos(radians((lat + lat + 0.25) / 2)) / 10) * ceil(0.25 * 111320.0 / 10) AS BIGINT) AS n FROM places",
)
def pixel_count(spark, d):
    lon, lat = F.col("lon"), F.col("lat")
    return _places(spark, d).select("id", geodesy.pixel_count(lon, lat, lon + 0.5, lat + 0.25, 10.0).cast("long").alias("n"))


@query(
    "tile_grid",
    f"""WITH {PLACES}, s AS (SELECT id, lon, lat, ceil(1.5 * 111320.0 * cos(radians((lat + lat + 1) / 2)) / 30) AS w, ceil(1.0 * 111320.0 / 30) AS h FROM places),
    g AS (SELECT *, CASE WHEN w * h > 4e6 THEN CAST(ceil(w / 2000) AS BIGINT) ELSE 1 END AS nx, CASE WHEN w * h > 4e6 THEN CAST(ceil(h / 2000) AS BIGINT) ELSE 1 END AS ny FROM s)
    SELECT id, j, i, round(lon + i * 1.5 / nx, 6) AS x0, round(lat + j * 1.0 / ny, 6) AS y0 FROM g, range(0, 10) a(j), range(0, 10) b(i) WHERE j < ny AND i < nx""",
)
def tile_grid(spark, d):
    extent = _places(spark, d).select("id", F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), (F.col("lon") + 1.5).alias("xmax"), (F.col("lat") + 1.0).alias("ymax"))
    return rasters.tile_grid(extent, 30.0, 2000).select("id", "j", "i", F.round("x0", 6).alias("x0"), F.round("y0", 6).alias("y0"))


@query(
    "export_grid",
    """WITH s AS (SELECT s_suppkey AS id, CAST((s_suppkey % 9 + 1) * 700 AS DOUBLE) AS w, CAST((s_suppkey % 7 + 1) * 500 AS DOUBLE) AS h FROM supplier), g AS (SELECT *, CAST(ceil(w / 2000) AS BIGINT) AS nx, CAST(ceil(h / 2000) AS BIGINT) AS ny FROM s)
    SELECT id, j, i, CAST(least(ceil(w / nx), 2000) AS BIGINT) AS px_w, CAST(least(ceil(h / ny), 2000) AS BIGINT) AS px_h FROM g, range(0, 10) a(j), range(0, 10) b(i) WHERE j < ny AND i < nx""",
)
def export_grid(spark, d):
    k = F.col("s_suppkey")
    sized = fx.table(spark, d, "supplier").select(k.alias("id"), ((k % 9 + 1) * 700).cast("double").alias("w"), ((k % 7 + 1) * 500).cast("double").alias("h"))
    many = lambda c: F.ceil(F.col(c) / 2000)
    steps = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cells = sized.select("*", many("w").alias("nx"), many("h").alias("ny")).select("*", steps("ny").alias("j")).select("*", steps("nx").alias("i"))
    side = lambda c, n: F.least(F.ceil(F.col(c) / F.col(n)), F.lit(2000)).cast("long")
    return cells.select("id", "j", "i", side("w", "nx").alias("px_w"), side("h", "ny").alias("px_h"))


@query(
    "crop_windows",
    f"""WITH {fx.PREDICTED}, w AS (SELECT fid, greatest(floor(xmin - 0.15 * (xmax - xmin)), 0) AS x0, greatest(floor(ymin - 0.15 * (ymax - ymin)), 0) AS y0, least(ceil(xmax + 0.15 * (xmax - xmin)), 4000) AS x1, least(ceil(ymax + 0.15 * (ymax - ymin)), 4000) AS y1 FROM predicted)
    SELECT fid, x0, y0, x1, y1 FROM w WHERE x1 - x0 >= 64 AND y1 - y0 >= 64""",
)
def crop_windows(spark, d):
    from fieldloom.plans.shapes import crop

    return crop(fx.predicted(spark, d), 0.15, 4000, 64)


@query(
    "catalog_query",
    f"WITH {fx.CATALOG} SELECT object_id, year, state FROM catalog WHERE category = 1 AND {NEAR} AND year = 1998",
)
def catalog_query(spark, d):
    return cat.query(fx.catalog(spark, d), AOI, YEAR, fallback=False).select("object_id", "year", "state")


@query("catalog_fallback", f"WITH {fx.CATALOG} SELECT object_id, year FROM catalog WHERE category = 1 AND {NEAR} AND (year = 2002 OR year BETWEEN 2001 AND 2003 AND NOT EXISTS (SELECT 1 FROM catalog WHERE category = 1 AND {NEAR} AND year = 2002))")
def catalog_fallback(spark, d):
    return cat.query(fx.catalog(spark, d), AOI, 2002).select("object_id", "year")


RANK = """CASE WHEN category <> 1 THEN 1 ELSE 0 END, coalesce(abs(year - 1998), 9999), CASE WHEN band_count < 4 THEN 1 ELSE 0 END,
  -(greatest(least(xmax, 500) - greatest(xmin, 100), 0) * greatest(least(ymax, 500) - greatest(ymin, 100), 0)), coalesce(resolution_value, 'inf'::DOUBLE), coalesce(acquisition_date, ''), object_id"""


@query("candidate_rank", f"WITH {fx.CATALOG} SELECT object_id, CAST(row_number() OVER (ORDER BY {RANK}) AS INT) AS rank FROM catalog WHERE {NEAR} AND year BETWEEN 1997 AND 1999")
def candidate_rank(spark, d):
    near = fx.catalog(spark, d).where(F.col("year").between(1997, 1999) & boxes.touches(F.col("box"), boxes.box(*AOI)))
    return cat.rank(near, AOI, YEAR).select("object_id", "rank")


@query("greedy_cover")
def greedy_cover(spark, d):
    return cat.greedy_cover(cat.rank(cat.query(fx.catalog(spark, d), AOI, YEAR), AOI, YEAR), AOI, 50)


@query("nearest_year", f"WITH {fx.CATALOG}, y AS (SELECT DISTINCT year FROM catalog) SELECT year FROM y ORDER BY abs(year - 2010), year LIMIT 1")
def nearest_year(spark, d):
    return cat.nearest_year(fx.catalog(spark, d).select("year").distinct(), 2010)


@query("min_resolution", f"WITH {fx.CATALOG} SELECT coalesce(min(resolution_value) FILTER (resolution_value > 0), 1.0)::DOUBLE AS resolution_m FROM catalog")
def min_resolution(spark, d):
    return cat.resolution(fx.catalog(spark, d))


@query("catalog_fingerprint", f"WITH {fx.CATALOG} SELECT object_id, substr(sha1(concat_ws('|', CAST(object_id AS VARCHAR), CAST(year AS VARCHAR), state)), 1, 12) AS fingerprint FROM catalog")
def catalog_fingerprint(spark, d):
    return fx.catalog(spark, d).select("object_id", cat.fingerprint(F.col("object_id").cast("string"), F.col("year").cast("string"), F.col("state")).alias("fingerprint"))


@query("catalog_coalesce", f"WITH {fx.CATALOG} SELECT object_id, coalesce(resolution_value, CAST(band_count AS DOUBLE)) AS resolution, try_cast(CASE WHEN object_id % 3 = 0 THEN '' WHEN object_id % 3 = 1 THEN 'x' ELSE CAST(year AS VARCHAR) END AS INT) AS parsed FROM catalog")
def catalog_coalesce(spark, d):
    k = F.col("object_id") % 3
    text = F.when(k == 0, "").when(k == 1, "x").otherwise(F.col("year").cast("string"))
    return fx.catalog(spark, d).select("object_id", F.coalesce("resolution_value", F.col("band_count").cast("double")).alias("resolution"), F.nullif(text, F.lit("")).try_cast("int").alias("parsed"))


@query("epoch_to_iso", f"WITH {fx.CATALOG} SELECT object_id, strftime(make_timestamp(acquired_ms * 1000), '%Y-%m-%dT%H:%M:%S') AS iso FROM catalog")
def epoch_to_iso(spark, d):
    return fx.catalog(spark, d).select("object_id", F.date_format(F.timestamp_millis("acquired_ms"), "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("esri_envelope", f"WITH {fx.CATALOG} SELECT object_id, xmin, ymin, xmax, ymax FROM catalog")
def esri_envelope(spark, d):
    text = fx.catalog(spark, d).select("object_id", F.to_json(F.struct(*boxes.flat(F.col("box")))).alias("geometry"))
    return text.select("object_id", F.from_json("geometry", "xmin double, ymin double, xmax double, ymax double").alias("e")).select("object_id", "e.*")
