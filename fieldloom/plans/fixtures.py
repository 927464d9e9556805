"""Tables of fields, scenes, zones and catalog items, derived from the driver's tables; each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.operators.boxes import box


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A total order of the rows of one field id.
ORDER = ["time", "price", "part", "supp"]
FIELDS = """fields AS (
  SELECT l_orderkey * 10 + l_linenumber AS field_id,
         CASE WHEN l_returnflag = 'R' THEN 'non_field_background' ELSE 'field' END AS label,
         l_shipdate AS time, CAST(year(l_shipdate) AS INT) AS year, (l_suppkey % 100) // 10 AS tile_id,
         CAST((l_partkey % 200) * 10 AS DOUBLE) AS xmin, CAST((l_suppkey % 100) * 10 AS DOUBLE) AS ymin,
         (l_partkey % 200) * 10 + l_quantity AS xmax, (l_suppkey % 100) * 10 + l_quantity AS ymax,
         l_returnflag AS engine, l_extendedprice AS price, l_partkey AS part, l_suppkey AS supp
  FROM lineitem)"""


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published polygons: one row per line item; ids repeat."""
    li = table(spark, sf_dir, "lineitem")
    x, y = (F.col("l_partkey") % 200) * 10, (F.col("l_suppkey") % 100) * 10
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("field_id"),
        F.when(F.col("l_returnflag") == "R", "non_field_background").otherwise("field").alias("label"),
        F.col("l_shipdate").alias("time"),
        F.floor((F.col("l_suppkey") % 100) / 10).alias("tile_id"),
        box(x, y, x + F.col("l_quantity"), y + F.col("l_quantity")).alias("box"),
        F.col("l_returnflag").alias("engine"), F.col("l_extendedprice").alias("price"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
    )


REFERENCE = """reference AS (
  SELECT p_partkey AS fid, CAST((p_partkey % 50) * 100 AS DOUBLE) AS xmin, CAST((p_partkey // 50) * 100 AS DOUBLE) AS ymin,
         CAST((p_partkey % 50) * 100 + 40 + p_size AS DOUBLE) AS xmax, CAST((p_partkey // 50) * 100 + 40 + p_size AS DOUBLE) AS ymax
  FROM part)"""
PREDICTED = """predicted AS (
  SELECT p_partkey AS fid, CAST((p_partkey % 50) * 100 + (p_partkey % 7) * 4 AS DOUBLE) AS xmin, CAST((p_partkey // 50) * 100 + (p_partkey % 5) * 4 AS DOUBLE) AS ymin,
         CAST((p_partkey % 50) * 100 + (p_partkey % 7) * 4 + 35 + (p_size * 3) % 60 AS DOUBLE) AS xmax, CAST((p_partkey // 50) * 100 + (p_partkey % 5) * 4 + 35 + (p_size * 3) % 60 AS DOUBLE) AS ymax
  FROM part WHERE p_partkey % 10 < 8)"""


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, side = F.col("p_partkey"), 40 + F.col("p_size")
    x, y = (k % 50) * 100, F.floor(k / 50) * 100
    return table(spark, sf_dir, "part").select(k.alias("fid"), box(x, y, x + side, y + side).alias("box"))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, side = F.col("p_partkey"), 35 + (F.col("p_size") * 3) % 60
    x, y = (k % 50) * 100 + (k % 7) * 4, F.floor(k / 50) * 100 + (k % 5) * 4
    return table(spark, sf_dir, "part").where(k % 10 < 8).select(k.alias("fid"), box(x, y, x + side, y + side).alias("box"))


SCENES = """scenes AS (
  SELECT event_id AS scene_id, user_id AS pixel, ts, event_type AS sensor, value AS nir,
         value * ((event_id % 7) + 1) / 10 AS red, CAST(json_extract_string(props, '$.k') AS INT) AS qa
  FROM events)"""
CLEAR = "(qa & 8) = 0 AND (qa & 16) = 0"


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("scene_id"), F.col("user_id").alias("pixel"), "ts", F.col("event_type").alias("sensor"), F.col("value").alias("nir"),
        (F.col("value") * ((F.col("event_id") % 7) + 1) / 10).alias("red"), F.get_json_object("props", "$.k").cast("int").alias("qa"),
    )


GRID = "grid AS (SELECT vec_id // 25 AS row, vec_id % 25 AS col, label FROM embeddings)"


def label_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.floor(v / 25).alias("row"), (v % 25).alias("col"), "label")


ZONES = """pixels AS (SELECT event_id % 100 AS col, event_id // 100 AS row, value / 500 AS value FROM events),
zones AS (
  SELECT p_partkey AS fid, CAST((p_partkey % 10) * 10 AS DOUBLE) AS xmin, CAST(((p_partkey // 10) % 10) * 10 AS DOUBLE) AS ymin,
         CAST((p_partkey % 10) * 10 + (p_size % 9) + 1 AS DOUBLE) AS xmax, CAST(((p_partkey // 10) % 10) * 10 + (p_size % 9) + 1 AS DOUBLE) AS ymax
  FROM part)"""


def pixel_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select((k % 100).alias("col"), F.floor(k / 100).alias("row"), (F.col("value") / 500).alias("value"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, side = F.col("p_partkey"), (F.col("p_size") % 9) + 1
    x, y = (k % 10) * 10, (F.floor(k / 10) % 10) * 10
    return table(spark, sf_dir, "part").select(k.alias("fid"), box(x, y, x + side, y + side).alias("box"))


OVERLAPS = """crossing AS (
  SELECT (l_orderkey * 10 + l_linenumber) * 100 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber
           ORDER BY l_extendedprice, l_partkey, l_suppkey, l_quantity, l_returnflag) AS fid, l_returnflag AS engine,
         CAST(l_partkey * 40 AS DOUBLE) AS xmin, CAST((l_suppkey % 40) * 50 AS DOUBLE) AS ymin,
         l_partkey * 40 + l_quantity AS xmax, (l_suppkey % 40) * 50 + l_quantity AS ymax
  FROM lineitem)"""


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each line item: the columns grow with the parts, so that boxes crowd alike at every size of the tables."""
    li = table(spark, sf_dir, "lineitem")
    x, y, q = F.col("l_partkey") * 40, (F.col("l_suppkey") % 40) * 50, F.col("l_quantity")
    # Order and line number repeat; the ids don't.
    own = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    fid = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + F.row_number().over(own)
    return li.select(fid.alias("fid"), F.col("l_returnflag").alias("engine"), box(x, y, x + q, y + q).alias("box"))


CATALOG = """catalog AS (
  SELECT o_orderkey AS object_id, CAST(year(o_orderdate) AS INT) AS year, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS category,
         CAST(3 + o_orderkey % 2 AS INT) AS band_count, NULLIF(o_custkey % 5, 0) * 0.25::DOUBLE AS resolution_value, n_name AS state,
         strftime(o_orderdate, '%Y-%m-%d') AS acquisition_date, epoch_ms(o_orderdate) AS acquired_ms,
         CAST((o_custkey % 100) * 10 AS DOUBLE) AS xmin, CAST((o_orderkey % 100) * 10 AS DOUBLE) AS ymin,
         CAST((o_custkey % 100) * 10 + 60 AS DOUBLE) AS xmax, CAST((o_orderkey % 100) * 10 + 60 AS DOUBLE) AS ymax
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    x, y = (F.col("o_custkey") % 100) * 10, (F.col("o_orderkey") % 100) * 10
    joined = o.join(c.select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"), "left").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return joined.select(
        F.col("o_orderkey").alias("object_id"), F.year("o_orderdate").alias("year"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("category"),
        (3 + F.col("o_orderkey") % 2).cast("int").alias("band_count"), (F.nullif(F.col("o_custkey") % 5, F.lit(0)) * 0.25).alias("resolution_value"),
        F.col("n_name").alias("state"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("acquisition_date"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("acquired_ms"), box(x, y, x + 60, y + 60).alias("box"),
    )
