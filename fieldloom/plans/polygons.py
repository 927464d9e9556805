"""Queries over published field polygons: filters, projections, de-duplication, summaries and the pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import boxes, fields as ops
from fieldloom.plans import fixtures as fx
from fieldloom.plans.registry import query
from fieldloom.sources import registries

AOI, YEAR = (500.0, 0.0, 800.0, 600.0), 1998
MEETS = "xmax >= 500 AND xmin <= 800 AND ymax >= 0 AND ymin <= 600"
ONE_YEAR = "time >= TIMESTAMP '1998-01-01' AND time < TIMESTAMP '1999-01-01'"
FIRST = "row_number() OVER (PARTITION BY field_id ORDER BY time, price, part, supp) AS n"
DAY = lambda c="time": F.to_date(c).alias("day")


def _flat(df, *more):
    return df.select(*more, *boxes.flat(F.col("box")))


@query(
    "query_fields",
    f"""WITH {fx.FIELDS}, kept AS (SELECT *, {FIRST} FROM fields WHERE {MEETS} AND label = 'field' AND {ONE_YEAR})
    SELECT field_id, label, CAST(time AS DATE) AS day, greatest(xmin, 500) AS xmin, greatest(ymin, 0) AS ymin, least(xmax, 800) AS xmax, least(ymax, 600) AS ymax
    FROM kept WHERE n = 1 AND least(xmax, 800) > greatest(xmin, 500) AND least(ymax, 600) > greatest(ymin, 0)""",
)
def query_fields(spark, d):
    found = ops.query_fields(fx.fields(spark, d), AOI, YEAR, "field", ["field_id", "label", "time"], order=fx.ORDER)
    return _flat(found, "field_id", "label", DAY())


@query("tile_projection", f"WITH {fx.FIELDS} SELECT field_id, label, xmin FROM fields WHERE tile_id = 3")
def tile_projection(spark, d):
    return fx.fields(spark, d).where("tile_id = 3").select("field_id", "label", F.col("box.xmin").alias("xmin"))


@query("dataset_scan", "SELECT l_returnflag AS engine, count(*) AS rows, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1")
def dataset_scan(spark, d):
    from fieldloom.sources.vector import read_dataset

    li = read_dataset(spark, f"{d}/lineitem.parquet", needed=["l_returnflag", "l_quantity"])
    return li.groupBy(F.col("l_returnflag").alias("engine")).agg(F.count("*").alias("rows"), F.sum("l_quantity").alias("quantity"))


@query("bbox_filter", f"WITH {fx.FIELDS} SELECT field_id, xmin, ymin, xmax, ymax FROM fields WHERE {MEETS}")
def bbox_filter(spark, d):
    return _flat(fx.fields(spark, d).where(ops.in_bounds(F.col("box"), AOI)), "field_id")


TILES = "tiles AS (SELECT tile_id, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, count(*) AS rows FROM fields GROUP BY tile_id)"


def _tiles(spark, d):
    bound = lambda f, n: f(f"box.{n}").alias(n)
    return fx.fields(spark, d).groupBy("tile_id").agg(bound(F.min, "xmin"), bound(F.min, "ymin"), bound(F.max, "xmax"), bound(F.max, "ymax"), F.count("*").alias("rows"))


@query("tile_extents", f"WITH {fx.FIELDS}, {TILES} SELECT * FROM tiles")
def tile_extents(spark, d):
    return _tiles(spark, d)


@query("tile_prune", f"WITH {fx.FIELDS}, {TILES} SELECT tile_id, rows FROM tiles WHERE {MEETS}")
def tile_prune(spark, d):
    from fieldloom.sources.manifest import prune

    return prune(_tiles(spark, d).select("tile_id", "rows", boxes.box("xmin", "ymin", "xmax", "ymax").alias("box")), AOI).select("tile_id", "rows")


STATUS = "CASE WHEN tile_id % 5 = 4 THEN 'skipped' ELSE 'OK' END"


@query("manifest_status", f"WITH {fx.FIELDS}, {TILES} SELECT tile_id, lower({STATUS}) AS status FROM tiles WHERE {STATUS} = 'OK'")
def manifest_status(spark, d):
    from fieldloom.sources.manifest import readable

    status = F.when(F.col("tile_id") % 5 == 4, "skipped").otherwise("OK")
    return readable(_tiles(spark, d).select("tile_id", status.alias("status"))).select("tile_id", F.lower("status").alias("status"))


@query(
    "manifest_normalize",
    f"WITH {fx.FIELDS}, {TILES} SELECT 't' || tile_id AS tile_id, 'data/t' || tile_id || '.parquet' AS tile_path, xmin, ymin, xmax, ymax FROM tiles WHERE {STATUS} = 'OK'",
)
def manifest_normalize(spark, d):
    from fieldloom.sources.manifest import normalise

    raw = _tiles(spark, d).select(
        F.concat(F.lit("data/t"), F.col("tile_id"), F.lit(".parquet")).alias("OUT_PATH"),
        F.when(F.col("tile_id") % 5 == 4, "skipped").otherwise("OK").alias("Status"), F.col("xmin").alias("minx"), F.col("ymin").alias("miny"), F.col("xmax").alias("maxx"), F.col("ymax").alias("maxy"),
    )
    return _flat(normalise(raw), "tile_id", "tile_path")


@query("label_filter", f"WITH {fx.FIELDS} SELECT field_id, label FROM fields WHERE label = 'field'")
def label_filter(spark, d):
    return ops.label_filter(fx.fields(spark, d), "field").select("field_id", "label")


@query("attribute_filter", "SELECT c_custkey AS fid, c_mktsegment AS county FROM customer WHERE c_mktsegment = 'BUILDING'")
def attribute_filter(spark, d):
    return fx.table(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("fid"), F.col("c_mktsegment").alias("county"))


@query("year_filter_col", f"WITH {fx.FIELDS} SELECT field_id, year FROM fields WHERE year = 1998")
def year_filter_col(spark, d):
    return ops.year_filter(fx.fields(spark, d).withColumn("year", F.year("time")), YEAR).select("field_id", "year")


@query("year_filter_ts", f"WITH {fx.FIELDS} SELECT field_id, CAST(time AS DATE) AS day FROM fields WHERE {ONE_YEAR}")
def year_filter_ts(spark, d):
    return ops.year_filter(fx.fields(spark, d), YEAR).select("field_id", DAY())


#: The time as text in one of five shapes, by the row's id.
TEXT_SQL = """CASE field_id % 5 WHEN 0 THEN strftime(time, '%Y') WHEN 1 THEN strftime(time, '%Y-%m-%d') WHEN 2 THEN strftime(time, '%Y/%m')
    WHEN 3 THEN strftime(time, '%Y%m%d') ELSE strftime(time, '%Y-%m-%d %H:%M:%S') END"""


def _text_time(spark, d):
    k = F.col("field_id") % 5
    shape = lambda f: F.date_format("time", f)
    text = F.when(k == 0, shape("yyyy")).when(k == 1, shape("yyyy-MM-dd")).when(k == 2, shape("yyyy/MM")).when(k == 3, shape("yyyyMMdd")).otherwise(shape("yyyy-MM-dd HH:mm:ss"))
    return fx.fields(spark, d).withColumn("time", text)


@query("year_filter_text", f"WITH {fx.FIELDS}, t AS (SELECT field_id, {TEXT_SQL} AS time FROM fields) SELECT * FROM t WHERE time LIKE '1998%'")
def year_filter_text(spark, d):
    return ops.year_filter(_text_time(spark, d), YEAR).select("field_id", "time")


@query("year_filter_isin", f"WITH {fx.FIELDS}, t AS (SELECT field_id, {TEXT_SQL} AS time FROM fields) SELECT * FROM t WHERE time IN ('1998', '1998-01-01', '1998-01-01 00:00:00')")
def year_filter_isin(spark, d):
    return _text_time(spark, d).where(F.col("time").isin("1998", "1998-01-01", "1998-01-01 00:00:00")).select("field_id", "time")


@query("aoi_intersects", f"WITH {fx.FIELDS} SELECT field_id, (least(xmax, 800) - greatest(xmin, 500)) * (least(ymax, 600) - greatest(ymin, 0)) AS shared FROM fields WHERE {MEETS}")
def aoi_intersects(spark, d):
    near = fx.fields(spark, d).where(ops.in_bounds(F.col("box"), AOI))
    return near.select("field_id", boxes.common_area(F.col("box"), boxes.box(*AOI)).alias("shared"))


@query(
    "clip_aoi",
    f"""WITH {fx.FIELDS} SELECT field_id, greatest(xmin, 500) AS xmin, greatest(ymin, 0) AS ymin, least(xmax, 800) AS xmax, least(ymax, 600) AS ymax
    FROM fields WHERE least(xmax, 800) > greatest(xmin, 500) AND least(ymax, 600) > greatest(ymin, 0)""",
)
def clip_aoi(spark, d):
    return _flat(ops.clip(fx.fields(spark, d).where(ops.in_bounds(F.col("box"), AOI)), AOI), "field_id")


@query("query_projection", f"WITH {fx.FIELDS} SELECT label, field_id, xmin, ymin, xmax, ymax FROM fields WHERE {MEETS} AND label = 'field'")
def query_projection(spark, d):
    found = ops.project(ops.label_filter(fx.fields(spark, d).where(ops.in_bounds(F.col("box"), AOI)), "field"), ops.normal_columns(" label, absent", ) + ["field_id", "label"])
    return _flat(found, *[c for c in found.columns if c != "box"])


@query("tile_provenance", f"WITH {fx.FIELDS} SELECT 'lineitem' AS source_tile_id, count(*) AS rows FROM fields GROUP BY 1")
def tile_provenance(spark, d):
    from fieldloom.sources.vector import with_provenance

    return with_provenance(fx.table(spark, d, "lineitem")).groupBy("source_tile_id").agg(F.count("*").alias("rows"))


@query("query_limit", f"WITH {fx.FIELDS} SELECT field_id, price FROM fields WHERE {MEETS} ORDER BY field_id, time, price, part, supp LIMIT 50")
def query_limit(spark, d):
    return ops.query_fields(fx.fields(spark, d), AOI, None, None, ["field_id", "price"], cut=False, deduplicate=False, order=fx.ORDER, max_features=50).select("field_id", "price")


@query("dedup_field_id", f"WITH {fx.FIELDS}, k AS (SELECT *, {FIRST} FROM fields) SELECT field_id, label, price FROM k WHERE n = 1")
def dedup_field_id(spark, d):
    return ops.keep_first(fx.fields(spark, d), "field_id", fx.ORDER).select("field_id", "label", "price")


KEY_SQL = "sha1(concat_ws(',', CAST(xmin AS BIGINT), CAST(ymin AS BIGINT), CAST(xmax AS BIGINT), CAST(ymax AS BIGINT)))"


@query(
    "dedup_geom_hash",
    f"""WITH {fx.FIELDS}, k AS (SELECT {KEY_SQL} AS geometry_hash, field_id, row_number() OVER (PARTITION BY xmin, ymin, xmax, ymax ORDER BY field_id, time, price, part, supp) AS n FROM fields)
    SELECT geometry_hash, field_id FROM k WHERE n = 1""",
)
def dedup_geom_hash(spark, d):
    keyed = fx.fields(spark, d).withColumn("geometry_hash", ops.geometry_key(F.col("box")))
    return ops.keep_first(keyed, "geometry_hash", ["field_id", *fx.ORDER]).select("geometry_hash", "field_id")


@query("tile_union", f"WITH {fx.FIELDS} SELECT field_id, CASE WHEN tile_id = 1 THEN label END AS label, CASE WHEN tile_id = 2 THEN price END AS price FROM fields WHERE tile_id IN (1, 2)")
def tile_union(spark, d):
    f = fx.fields(spark, d)
    a, b = f.where("tile_id = 1").select("field_id", "label"), f.where("tile_id = 2").select("price", "field_id")
    return a.unionByName(b, allowMissingColumns=True)


@query("empty_result", f"WITH {fx.FIELDS} SELECT CAST(field_id AS VARCHAR) AS field_id, label, year FROM fields WHERE xmin > 1e9")
def empty_result(spark, d):
    return spark.createDataFrame([], ops.EMPTY_SCHEMA).select("field_id", "label", "year")


@query("field_area", f"WITH {fx.FIELDS} SELECT field_id, price, (xmax - xmin) * (ymax - ymin) AS area_m2, 2 * ((xmax - xmin) + (ymax - ymin)) AS perimeter_m FROM fields")
def field_area(spark, d):
    b = F.col("box")
    return fx.fields(spark, d).select("field_id", "price", boxes.area(b).alias("area_m2"), boxes.perimeter(b).alias("perimeter_m"))


@query("area_filter", f"WITH {fx.FIELDS} SELECT field_id, price, (xmax - xmin) * (ymax - ymin) AS area_m2 FROM fields WHERE (xmax - xmin) * (ymax - ymin) BETWEEN 100 AND 900")
def area_filter(spark, d):
    from fieldloom.operators.shapes import area_between

    return area_between(fx.fields(spark, d).withColumn("area_m2", boxes.area(F.col("box"))), 100, 900).select("field_id", "price", "area_m2")


@query(
    "large_field_split",
    f"WITH {fx.FIELDS} SELECT field_id, price, CASE WHEN (xmax - xmin) * (ymax - ymin) > 1600 THEN 'kept' ELSE 'refined' END AS route FROM fields",
)
def large_field_split(spark, d):
    sized = fx.fields(spark, d).withColumn("a", boxes.area(F.col("box")))
    small, large = sized.where("a <= 1600").withColumn("route", F.lit("refined")), sized.where("a > 1600").withColumn("route", F.lit("kept"))
    return small.unionByName(large).select("field_id", "price", "route")


@query(
    "fiboa_metadata",
    f"""WITH {fx.OVERLAPS} SELECT CAST(row_number() OVER (ORDER BY fid) - 1 AS VARCHAR) AS id, (xmax - xmin) * (ymax - ymin) AS "metrics:area", 2 * ((xmax - xmin) + (ymax - ymin)) AS "metrics:perimeter",
    'auto-imagery' AS "determination:method", '1998' AS "determination:datetime", engine AS "delineation:engine", 'sentinel2' AS "delineation:source", 1998 AS "delineation:year" FROM crossing""",
)
def fiboa_metadata(spark, d):
    from fieldloom.operators.shapes import positional, with_metadata

    named = positional(fx.overlaps(spark, d), ["fid"], "id").withColumn("id", F.col("id").cast("string"))
    out = with_metadata(named, F.col("engine"), "sentinel2", 1998)
    return out.select("id", *[F.col(f"`{c}`") for c in out.columns if ":" in c])


@query("total_bounds", f"WITH {fx.FIELDS} SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, (min(xmin) + max(xmax)) / 2 AS cx, (min(ymin) + max(ymax)) / 2 AS cy, 6 AS zoom FROM fields")
def total_bounds(spark, d):
    from fieldloom.operators.shapes import total_bounds as bounds

    return bounds(fx.fields(spark, d))


@query("yearly_summary", f"WITH {fx.FIELDS} SELECT year, count(*) AS n, sum((xmax - xmin) * (ymax - ymin)) / 10000 AS hectares, round(avg((xmax - xmin) * (ymax - ymin)), 6) AS mean_area FROM fields GROUP BY year")
def yearly_summary(spark, d):
    a = boxes.area(F.col("box"))
    return fx.fields(spark, d).groupBy(F.year("time").alias("year")).agg(F.count("*").alias("n"), (F.sum(a) / 10000).alias("hectares"), F.round(F.avg(a), 6).alias("mean_area"))


@query(
    "yearly_stability",
    f"""WITH {fx.FIELDS}, y AS (SELECT year, count(*) AS n FROM fields GROUP BY year)
    SELECT a.year, b.year AS next_year, a.n, b.n AS next_n, round((b.n - a.n) / CAST(a.n AS DOUBLE), 6) AS change FROM y a JOIN y b ON b.year = (SELECT min(year) FROM y WHERE year > a.year)""",
)
def yearly_stability(spark, d):
    from pyspark.sql import Window

    n = fx.fields(spark, d).groupBy(F.year("time").alias("year")).agg(F.count("*").alias("n"))
    w = Window.orderBy("year")  # one row for each year
    out = n.select("year", F.lead("year").over(w).alias("next_year"), "n", F.lead("n").over(w).alias("next_n")).where("next_year is not null")
    return out.select("*", F.round((F.col("next_n") - F.col("n")) / F.col("n"), 6).alias("change"))


@query(
    "threshold_sweep",
    f"""WITH {fx.FIELDS}, t AS (SELECT unnest([100, 500, 1000, 2500]) AS least)
    SELECT least, count(*) AS n, round(avg((xmax - xmin) * (ymax - ymin)), 6) AS mean_area FROM t JOIN fields ON (xmax - xmin) * (ymax - ymin) >= least GROUP BY least""",
)
def threshold_sweep(spark, d):
    a = boxes.area(F.col("box"))
    per = lambda t: F.struct(F.lit(t).alias("least"), F.sum((a >= t).cast("long")).alias("n"), F.round(F.avg(F.when(a >= t, a)), 6).alias("mean_area"))
    # One pass for all thresholds.
    return fx.fields(spark, d).agg(F.array(*map(per, (100, 500, 1000, 2500))).alias("x")).select(F.inline("x")).where("n > 0")


@query(
    "before_after",
    f"""WITH {fx.FIELDS} SELECT count(*) AS n_before, count(*) FILTER ((xmax - xmin) * (ymax - ymin) >= 500) AS n_after, round(avg((xmax - xmin) * (ymax - ymin)), 6) AS mean_before,
    round(avg((xmax - xmin) * (ymax - ymin)) FILTER ((xmax - xmin) * (ymax - ymin) >= 500), 6) AS mean_after FROM fields""",
)
def before_after(spark, d):
    a = boxes.area(F.col("box"))
    return fx.fields(spark, d).agg(
        F.count("*").alias("n_before"), F.count(F.when(a >= 500, 1)).alias("n_after"), F.round(F.avg(a), 6).alias("mean_before"), F.round(F.avg(F.when(a >= 500, a)), 6).alias("mean_after")
    )


@query("distinct_regions", "SELECT DISTINCT n_name AS region FROM nation JOIN customer ON c_nationkey = n_nationkey")
def distinct_regions(spark, d):
    c, n = fx.table(spark, d, "customer"), fx.table(spark, d, "nation")
    return n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select(F.col("n_name").alias("region")).distinct()


@query(
    "group_by_prefix",
    f"WITH {fx.OVERLAPS} SELECT split_part(engine || '/' || (fid % 3), '/', 1) AS sensor, count(DISTINCT fid % 3) AS engines, count(*) AS n FROM crossing GROUP BY 1",
)
def group_by_prefix(spark, d):
    tagged = fx.overlaps(spark, d).withColumn("tag", F.concat_ws("/", "engine", (F.col("fid") % 3).cast("string")))
    return tagged.groupBy(F.split("tag", "/")[0].alias("sensor")).agg(F.countDistinct("tag").alias("engines"), F.count("*").alias("n"))


@query("semi_join_bbox", f"WITH {fx.REFERENCE}, {fx.PREDICTED} SELECT fid FROM reference r WHERE EXISTS (SELECT 1 FROM predicted p WHERE p.xmax >= r.xmin AND p.xmin <= r.xmax AND p.ymax >= r.ymin AND p.ymin <= r.ymax)")
def semi_join_bbox(spark, d):
    from fieldloom.operators.spatial_join import overlap_join

    ref = fx.reference(spark, d)
    met = overlap_join(ref, fx.predicted(spark, d), 100.0).select(F.col("l.fid").alias("fid"))
    return ref.join(met, "fid", "left_semi").select("fid")


@query("string_normalize", "SELECT n_nationkey AS id, lower(trim(n_name)) AS engine, upper(replace(n_name, '''', '''''')) AS quoted, replace(lower(n_name), ' ', '_') AS tag, nullif(trim(substr(n_name, 1, 0)), '') AS blank FROM nation")
def string_normalize(spark, d):
    n = F.col("n_name")
    return fx.table(spark, d, "nation").select(
        F.col("n_nationkey").alias("id"), F.lower(F.trim(n)).alias("engine"), F.upper(F.replace(n, F.lit("'"), F.lit("''"))).alias("quoted"),
        F.replace(F.lower(n), F.lit(" "), F.lit("_")).alias("tag"), F.nullif(F.trim(F.substring(n, 1, 0)), F.lit("")).alias("blank"),
    )


@query("date_window", f"WITH {fx.FIELDS} SELECT year, min(make_date(year, 1, 1)) AS first_day, min(make_date(year, 12, 31)) AS last_day, count(*) FILTER (month(time) = 4) AS april, count(*) FILTER (month(time) = 10) AS october FROM fields GROUP BY year")
def date_window(spark, d):
    y, m = F.year("time"), F.month("time")
    day = lambda a, b: F.min(F.make_date(F.year("time"), F.lit(a), F.lit(b)))
    return fx.fields(spark, d).groupBy(y.alias("year")).agg(day(1, 1).alias("first_day"), day(12, 31).alias("last_day"), F.count(F.when(m == 4, 1)).alias("april"), F.count(F.when(m == 10, 1)).alias("october"))


@query(
    "pipeline_fields",
    f"""WITH RECURSIVE {fx.OVERLAPS}, links AS (
      SELECT a.fid AS a, b.fid AS b FROM crossing a JOIN crossing b ON a.xmax >= b.xmin AND a.xmin <= b.xmax AND a.ymax >= b.ymin AND a.ymin <= b.ymax AND a.fid < b.fid,
      LATERAL (SELECT (least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) AS i, (a.xmax - a.xmin) * (a.ymax - a.ymin) AS x, (b.xmax - b.xmin) * (b.ymax - b.ymin) AS y)
      WHERE i / (x + y - i) >= 0.3 OR i / least(x, y) >= 0.8),
    step AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(fid, other) AS (SELECT fid, fid FROM crossing UNION SELECT r.fid, l.b FROM reach r JOIN step l ON l.a = r.other),
    roots AS (SELECT fid, min(other) AS root FROM reach GROUP BY fid)
    SELECT root AS id, count(*) AS members, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM crossing JOIN roots USING (fid) GROUP BY root
    HAVING max(CASE WHEN (xmax - xmin) * (ymax - ymin) >= 400 THEN 1 ELSE 0 END) = 1""",
)
def pipeline_fields(spark, d):
    from fieldloom.operators.merge import merged_groups

    return merged_groups(fx.overlaps(spark, d), 50.0).where("most >= 400").select(F.col("root").alias("id"), "members", "xmin", "ymin", "xmax", "ymax")


@query("list_engines", registries.as_sql(registries.ENGINES, ("name", "approach", "requires_gpu")))
def list_engines(spark, d):
    return registries.as_frame(spark, registries.ENGINES, "name string, approach string, requires_gpu boolean")


@query("list_sources", registries.as_sql(registries.SOURCES, ("name", "resolution_m", "bands", "embedding")))
def list_sources(spark, d):
    return registries.as_frame(spark, registries.SOURCES, "name string, resolution_m double, bands int, embedding boolean")


@query("band_lookup", registries.as_sql(registries.band_rows(), ("source", "band", "position")))
def band_lookup(spark, d):
    return registries.as_frame(spark, registries.band_rows(), "source string, band string, position int")


@query("geojson_rows")
def geojson_rows(spark, d):
    from fieldloom.sources.vector import geojson_features

    return geojson_features(ops.query_fields(fx.fields(spark, d), AOI, YEAR, "field", ["field_id", "label"], order=fx.ORDER))


@query("param_override", "SELECT n_nationkey AS id, n_name AS engine, CASE WHEN n_nationkey % 2 = 0 THEN '0.7' ELSE '0.5' END AS threshold, 'true' AS tta FROM nation")
def param_override(spark, d):
    from fieldloom.operators.shapes import override

    base = F.create_map(F.lit("threshold"), F.lit("0.5"), F.lit("tta"), F.lit("true"), F.lit("engines"), F.lit("x"))
    own = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("threshold"), F.lit("0.7"))).otherwise(F.create_map().cast("map<string,string>"))
    p = override(base, own, ["engines"])
    return fx.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("engine"), p["threshold"].alias("threshold"), p["tta"].alias("tta"))
