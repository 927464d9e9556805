"""Queries over field shapes: rings, parts, smoothing and simplification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import polygons, rings
from fieldloom.plans import fixtures as fx
from fieldloom.plans.registry import query

#: Smoothing a rectangle cuts every corner: its area falls by 1/8 of itself in the first round, and by a quarter as much in each further one.
LEFT = "(1 - 0.125 * (1 + 0.25 + 0.0625))"


def crop(df: DataFrame, margin: float, size: float, least: float) -> DataFrame:
    """Windows around boxes: a margin of the sides, whole pixels within the raster, and not too small."""
    b = F.col("box")
    w, h = (b["xmax"] - b["xmin"]) * margin, (b["ymax"] - b["ymin"]) * margin
    whole = lambda c: c.cast("double")
    out = df.select(
        "fid", whole(F.greatest(F.floor(b["xmin"] - w), F.lit(0))).alias("x0"), whole(F.greatest(F.floor(b["ymin"] - h), F.lit(0))).alias("y0"),
        whole(F.least(F.ceil(b["xmax"] + w), F.lit(int(size)))).alias("x1"), whole(F.least(F.ceil(b["ymax"] + h), F.lit(int(size)))).alias("y1"),
    )
    return out.where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))


@query("chaikin", f"WITH {fx.PREDICTED} SELECT fid, CAST(33 AS BIGINT) AS vertices, round((xmax - xmin) * (ymax - ymin) * {LEFT}, 6) AS area FROM predicted")
def chaikin(spark, d):
    smooth = fx.predicted(spark, d).select("fid", rings.chaikin(rings.ring_of_box(F.col("box")), 3).alias("r"))
    return smooth.select("fid", F.size("r").cast("long").alias("vertices"), F.round(rings.ring_area(F.col("r")), 6).alias("area"))


@query("centroid", f"WITH {fx.PREDICTED} SELECT fid, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy FROM predicted")
def centroid(spark, d):
    ring = rings.ring_of_box(F.col("box"))
    found = fx.predicted(spark, d).select("fid", polygons.to_wkb(F.array(ring)).alias("geom")).select("fid", polygons.measures("geom").alias("m"))
    return found.select("fid", F.round("m.cx", 6).alias("cx"), F.round("m.cy", 6).alias("cy"))


@query("hole_filter", f"WITH {fx.PREDICTED} SELECT fid, CASE WHEN 0.04 * (xmax - xmin) * (ymax - ymin) >= 100 THEN 2 ELSE 1 END AS rings, round((xmax - xmin) * (ymax - ymin) * CASE WHEN 0.04 * (xmax - xmin) * (ymax - ymin) >= 100 THEN 0.96 ELSE 1 END, 6) AS area FROM predicted")
def hole_filter(spark, d):
    b = F.col("box")
    w, h = b["xmax"] - b["xmin"], b["ymax"] - b["ymin"]
    from fieldloom.operators.boxes import box

    hole = box(b["xmin"] + 0.4 * w, b["ymin"] + 0.4 * h, b["xmin"] + 0.6 * w, b["ymin"] + 0.6 * h)
    # Half a millionth keeps a hole at the bound on the same side in both engines.
    kept = fx.predicted(spark, d).select("fid", rings.large_holes(F.array(rings.ring_of_box(b), rings.ring_of_box(hole)), 100.0 - 5e-7).alias("r"))
    return kept.select("fid", F.size("r").alias("rings"), F.round(rings.polygon_area(F.col("r")), 6).alias("area"))


@query("simplify", f"WITH {fx.PREDICTED} SELECT fid, CAST(5 AS BIGINT) AS vertices, (xmax - xmin) * (ymax - ymin) AS area FROM predicted")
def simplify(spark, d):
    """Boxes with a point added on each edge lose those points, and nothing else."""
    r = rings.ring_of_box(F.col("box"))
    more = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array(F.get(r, i), F.struct(((F.get(r, i)["x"] + F.get(r, i + 1)["x"]) / 2).alias("x"), ((F.get(r, i)["y"] + F.get(r, i + 1)["y"]) / 2).alias("y")))))
    dense = fx.predicted(spark, d).select("fid", polygons.to_wkb(F.array(F.concat(more, F.slice(r, 5, 1)))).alias("geom"))
    found = dense.select("fid", polygons.simplify("geom", 1.0).alias("geom")).select("fid", polygons.measures("geom").alias("m"))
    return found.select("fid", F.col("m.vertices").alias("vertices"), F.col("m.area").alias("area"))


@query("explode_parts", f"WITH {fx.REFERENCE}, {fx.PREDICTED} SELECT fid, 0 AS part, xmin, ymin FROM reference UNION ALL SELECT fid, 1, xmin, ymin FROM predicted")
def explode_parts(spark, d):
    return _multi(spark, d).select("fid", F.posexplode("parts").alias("part", "b")).select("fid", "part", F.col("b.xmin").alias("xmin"), F.col("b.ymin").alias("ymin"))


def _multi(spark, d):
    """Fields of up to two parts: the reference box, and the predicted one."""
    both = fx.reference(spark, d).select("fid", F.lit(0).alias("k"), "box").unionByName(fx.predicted(spark, d).select("fid", F.lit(1).alias("k"), "box"))
    return both.groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "box"))), lambda s: s["box"]).alias("parts"))


@query(
    "largest_part",
    f"""WITH {fx.REFERENCE}, {fx.PREDICTED}, p AS (SELECT fid, 0 AS k, (xmax - xmin) * (ymax - ymin) AS area, xmin FROM reference UNION ALL SELECT fid, 1, (xmax - xmin) * (ymax - ymin), xmin FROM predicted),
    r AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY area DESC, k) AS n FROM p) SELECT fid, area, xmin FROM r WHERE n = 1""",
)
def largest_part(spark, d):
    top = _multi(spark, d).select("fid", rings.largest_part(F.col("parts")).alias("b"))
    return top.select("fid", ((F.col("b.xmax") - F.col("b.xmin")) * (F.col("b.ymax") - F.col("b.ymin"))).alias("area"), F.col("b.xmin").alias("xmin"))
