"""Queries over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import cluster
from fieldloom.operators.rasters import split_rows
from fieldloom.plans import fixtures as fx
from fieldloom.plans.registry import query

DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


def _vectors(spark, d):
    return fx.table(spark, d, "embeddings")


@query("embedding_scan", "SELECT vec_id, label, len(embedding) AS dims, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def embedding_scan(spark, d):
    return _vectors(spark, d).select("vec_id", "label", F.size("embedding").cast("long").alias("dims"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("valid_pixel_mask", "SELECT vec_id, list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) AS valid FROM embeddings")
def valid_pixel_mask(spark, d):
    return _vectors(spark, d).select("vec_id", cluster.valid(F.col("embedding")).alias("valid"))


@query(
    "cosine_topk",
    f"""WITH n AS (SELECT vec_id, embedding AS e, sqrt({DOT.format(a='embedding', b='embedding')}) AS s FROM embeddings),
    p AS (SELECT q.vec_id, v.vec_id AS other_id, round({DOT.format(a='q.e', b='v.e')} / (q.s * v.s), 6) AS cosine FROM n q JOIN n v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, other_id) AS INT) AS rank FROM p) SELECT * FROM r WHERE rank <= 5""",
)
def cosine_topk(spark, d):
    v = _vectors(spark, d)
    return cluster.nearest(v.where("vec_id % 20 = 0"), v, 5)


@query(
    "nearest_centroid",
    """WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY label, i),
    g AS (SELECT vec_id, c.label, round(sum((embedding[i]::DOUBLE - m) ** 2), 6) AS distance2 FROM embeddings, c GROUP BY vec_id, c.label),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance2, label) AS n FROM g) SELECT vec_id, label AS nearest, distance2 FROM r WHERE n = 1""",
)
def nearest_centroid(spark, d):
    return cluster.nearest_centroid(_vectors(spark, d), "label")


@query("embedding_clusters")
def embedding_clusters(spark, d):
    return cluster.cluster(_vectors(spark, d), 10, 16)


@query("auto_k")
def auto_k(spark, d):
    return cluster.silhouettes(_vectors(spark, d), [5, 10, 15, 20, 30, 50], 16)


@query("spectral_clusters")
def spectral_clusters(spark, d):
    return cluster.spectral(_vectors(spark, d), 5)


@query("sample_pixels")
def sample_pixels(spark, d):
    return cluster.sample(_vectors(spark, d).select("vec_id", "label"), "vec_id", 100)


@query("train_val_split")
def train_val_split(spark, d):
    return split_rows(_vectors(spark, d).select("vec_id", "label"), "vec_id", 0.2)
