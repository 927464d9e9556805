"""Embedding clustering: valid vectors, PCA, K-means, a silhouette-chosen k, spectral groups, centroids and nearest vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, PowerIterationClustering
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid(v: Column) -> Column:
    """All components finite and one of them not zero."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)


def sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows whose key hashes least: the same on every run."""
    return df.orderBy(F.xxhash64(F.lit("sample"), key), key).limit(n)


def cluster(vectors: DataFrame, k: int, dims: int, seed: int = 42, fit_rows: int = 50_000) -> DataFrame:
    """``vec_id, cluster`` from 1 (0 for vectors that aren't valid): PCA and K-means fitted on a hash sample."""
    good = vectors.where(valid(F.col("embedding"))).select("vec_id", array_to_vector("embedding").alias("x"))
    fitted = sample(good, "vec_id", fit_rows)
    pca = PCA(k=dims, inputCol="x", outputCol="p").fit(fitted)
    model = KMeans(k=k, seed=seed, featuresCol="p", predictionCol="c").fit(pca.transform(fitted))
    found = model.transform(pca.transform(good)).select("vec_id", (F.col("c") + 1).alias("c"))
    return vectors.select("vec_id").join(found, "vec_id", "left").select("vec_id", F.coalesce("c", F.lit(0)).alias("cluster"))


def silhouettes(vectors: DataFrame, ks: list[int], dims: int, seed: int = 42, rows: int = 5_000) -> DataFrame:
    """``k, silhouette, chosen`` for each candidate (squared Euclidean distance); the first of the highest is chosen. Candidates that aren't fewer than the rows have none."""
    good = sample(vectors.where(valid(F.col("embedding"))), "vec_id", rows).select("vec_id", array_to_vector("embedding").alias("x"))
    reduced = PCA(k=dims, inputCol="x", outputCol="features").fit(good).transform(good).select("features").cache()
    try:
        n = reduced.count()
        found = [(k, ClusteringEvaluator().evaluate(KMeans(k=k, seed=seed).fit(reduced).transform(reduced))) for k in ks if k < n]
    finally:
        reduced.unpersist()
    best = max(found, key=lambda x: x[1])[0] if found else None
    return vectors.sparkSession.createDataFrame([(k, float(s), k == best) for k, s in found], "k int, silhouette double, chosen boolean")


def _neighbours(some: DataFrame, k: int) -> DataFrame:
    """``vec_id, other_id, cosine`` of the k nearest others (the lesser id of equals) among a sample of bounded size, which every task holds."""
    rows = some.select("vec_id", "embedding").orderBy("vec_id").collect()
    ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
    x = np.array([r["embedding"] for r in rows], dtype=np.float64).reshape(len(rows), -1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def run(batches):
        for b in batches:
            at = b.column(0).to_numpy()
            for block in np.array_split(at, -(-len(at) // 128) or 1):
                cosine = np.round(x[block] @ x.T, 6)
                cosine[ids[block][:, None] == ids] = -np.inf
                for i, c in zip(block, cosine, strict=True):
                    least = np.partition(c, -k)[-k] if len(c) > k else -np.inf
                    near = np.flatnonzero((c >= least) & (c > -np.inf))
                    near = near[np.lexsort((ids[near], -c[near]))][:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), ids[i])), pa.array(ids[near]), pa.array(c[near])], names=["vec_id", "other_id", "cosine"])

    spark = some.sparkSession
    return spark.range(0, len(ids), 1, spark.sparkContext.defaultParallelism).mapInArrow(run, "vec_id long, other_id long, cosine double")


def spectral(vectors: DataFrame, k: int, least: float = 0.0, neighbours: int = 10, rows: int = 50_000) -> DataFrame:
    """``vec_id, cluster`` from 1 (0 for vectors that aren't valid): power iteration on a nearest-neighbour graph of a hash sample, then the nearest centroid (the lesser of equals) for every row."""
    ok = F.coalesce(valid(F.col("embedding")), F.lit(False))
    some = sample(vectors.where(ok), "vec_id", rows)
    near = _neighbours(some, neighbours).where(F.col("cosine") > least)
    graph = near.select(F.least("vec_id", "other_id").alias("src"), F.greatest("vec_id", "other_id").alias("dst"), "cosine").groupBy("src", "dst").agg(F.max("cosine").alias("weight")).cache()
    try:
        if graph.isEmpty():
            return vectors.select("vec_id", F.when(ok, 1).otherwise(0).alias("cluster"))
        groups = PowerIterationClustering(k=k, maxIter=10, weightCol="weight").assignClusters(graph).select(F.col("id").alias("vec_id"), F.col("cluster").alias("c"))
        # k rows for each component.
        means = centroids(some.join(groups, "vec_id"), "c").groupBy("c").agg(F.array_sort(F.collect_list(F.struct("at", "mean"))).alias("m")).orderBy("c").collect()
    finally:
        graph.unpersist()
    gaps = []
    for r in means:
        at = F.array(*(F.lit(float(m["mean"])) for m in r["m"]))
        gap = F.aggregate(F.zip_with("embedding", at, lambda x, y: F.pow(x.cast("double") - y, 2)), F.lit(0.0), lambda s, x: s + x)
        gaps.append(F.struct(gap.alias("d"), F.lit(r["c"] + 1).cast("int").alias("c")))
    return vectors.select("vec_id", F.when(ok, F.array_min(F.array(*gaps))["c"]).otherwise(0).alias("cluster"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def beside(many: DataFrame, few: DataFrame, many_key: str, few_key: str, most: int = 4096, rows: int = 65_536) -> DataFrame:
    """Every row of a stated set ``few`` beside every row of ``many``.

    The set is counted and broadcast up to ``most`` rows. Beyond that both are dealt by their keys' hashes: a cell of the
    equi-join has about ``most`` rows of the one and ``rows`` of the other, whatever the sizes of both."""
    n = few.count()
    if n <= most:
        return many.crossJoin(F.broadcast(few))
    blocks, parts = -(-n // most), -(-many.count() // rows) or 1
    deal = lambda key, cells: F.pmod(F.xxhash64(key), F.lit(cells))
    every = lambda cells: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long")))
    left = many.select("*", deal(many_key, parts).alias("__part"), every(blocks).alias("__block"))
    right = few.select("*", every(parts).alias("__part"), deal(few_key, blocks).alias("__block"))
    return left.join(right, ["__part", "__block"]).drop("__part", "__block")


def _ranked(a: np.ndarray, b: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` and their cosine, rounded as SQL rounds, for the k best others in ``b`` of each row in ``a`` (NaN first, then the lesser id)."""
    norm_a, norm_b = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    with np.errstate(all="ignore"):
        score = (a / norm_a[:, None]) @ (b / norm_b[:, None]).T
    score[np.isnan(score)] = np.inf
    score[a_ids[:, None] == b_ids] = -np.inf
    # The k-th best of the blocks' best ones is no better than the k-th best of all; what may round to the same stays in.
    wide = -(-len(b) // max(64, 4 * k))
    tops = np.maximum.reduceat(score, np.arange(0, len(b), wide), axis=1)
    least = np.partition(tops, -k, axis=1)[:, -k] if tops.shape[1] >= k else np.full(len(a), -np.inf)
    found = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], [np.empty(0)]
    for i, row in enumerate(score):
        j = np.flatnonzero((row >= least[i] - 2e-6) & (row > -np.inf))
        exact = np.zeros(len(j))
        with np.errstate(all="ignore"):
            for x, y in zip(a[i], b[j].T, strict=True):  # in order, as SQL sums
                exact += x * y
            scaled = exact / (norm_a[i] * norm_b[j]) * 1e6
            cosine = np.copysign(np.floor(np.abs(scaled) + 0.5), scaled) / 1e6 + 0.0
        first = np.lexsort((b_ids[j], -np.where(np.isnan(cosine), np.inf, cosine)))[:k]
        for out, x in zip(found, (np.full(len(first), i), j[first], cosine[first]), strict=True):
            out.append(x)
    return tuple(np.concatenate(x) for x in found)


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    lists = pa.concat_arrays([c for c in t.column(name).chunks]) if t.num_rows else None
    return np.empty((0, 0)) if lists is None else lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _tops(queries: DataFrame, vectors: DataFrame, k: int, most: int, rows: int) -> DataFrame:
    """``vec_id, other_id, cosine``: for each query the k nearest of every block of vectors. All are of one length, without nulls."""

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        a, b, a_ids, b_ids = _matrix(q, "embedding"), _matrix(v, "embedding"), q.column("vec_id").to_numpy(), v.column("vec_id").to_numpy()
        out = []
        for at in range(0, len(a), 256) if len(b) else ():
            i, j, cosine = _ranked(a[at : at + 256], b, a_ids[at : at + 256], b_ids, k)
            out.append(pa.table({"vec_id": a_ids[at + i], "other_id": b_ids[j], "cosine": cosine}))
        return pa.concat_tables(out) if out else pa.table({"vec_id": pa.array([], pa.int64()), "other_id": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})

    blocks, parts = -(-queries.count() // most) or 1, -(-vectors.count() // rows) or 1
    deal = lambda cells: F.pmod(F.xxhash64("vec_id"), F.lit(cells))
    every = lambda cells: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long")))
    q = queries.select(F.col("vec_id").cast("long"), "embedding", deal(blocks).alias("block")).select("*", every(parts).alias("part"))
    v = vectors.select(F.col("vec_id").cast("long"), "embedding", deal(parts).alias("part")).select("*", every(blocks).alias("block"))
    return q.groupBy("part", "block").cogroup(v.groupBy("part", "block")).applyInArrow(run, "vec_id long, other_id long, cosine double")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, most: int = 4096, rows: int = 16_384) -> DataFrame:
    """``vec_id, other_id, cosine, rank`` of the k nearest vectors by cosine.

    Queries and vectors are dealt to cells of some ``most`` and ``rows``, and each cell gives its k best for each of its queries: the
    products grow with both tables, but they are matrix products, and only k rows for a query and block leave a task. Vectors that
    lack a component, or are of another length than the others, go beside everything row by row."""
    usual = vectors.where(F.col("embedding").isNotNull()).groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    even = F.col("embedding").isNotNull() & (F.size("embedding") == F.lit(usual[0]["n"] if usual else 0)) & F.forall("embedding", lambda x: x.isNotNull())
    even = F.coalesce(even, F.lit(False))
    found = _tops(queries.where(even), vectors.where(even), k, most, rows)
    if not (odd := vectors.where(~even)).isEmpty():
        found = found.unionByName(_plain(queries, odd, most))
    if not (odd := queries.where(~even)).isEmpty():
        found = found.unionByName(_plain(odd, vectors.where(even), most))
    order = Window.partitionBy("vec_id").orderBy(F.col("cosine").desc(), "other_id")
    return found.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def _plain(queries: DataFrame, vectors: DataFrame, most: int) -> DataFrame:
    q = queries.select("vec_id", F.col("embedding").alias("q"), F.sqrt(dot(F.col("embedding"), F.col("embedding"))).alias("qn"))
    v = vectors.select(F.col("vec_id").alias("other_id"), F.col("embedding").alias("v"), F.sqrt(dot(F.col("embedding"), F.col("embedding"))).alias("vn"))
    cosine = dot(F.col("q"), F.col("v")) / (F.col("qn") * F.col("vn"))
    return beside(v, q, "other_id", "vec_id", most).where(F.col("vec_id") != F.col("other_id")).select("vec_id", "other_id", F.round(cosine, 6).alias("cosine"))


def centroids(vectors: DataFrame, label: str) -> DataFrame:
    """``label, at, mean``: the mean of every component of each label's vectors."""
    return vectors.select(label, F.posexplode("embedding").alias("at", "x")).groupBy(label, "at").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def nearest_centroid(vectors: DataFrame, label: str, most: int = 4096) -> DataFrame:
    """``vec_id, nearest, distance2``: the label of the nearest centroid (the lesser of equals), met in blocks of ``most`` labels."""
    packed = centroids(vectors, label).groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "mean"))), lambda s: s["mean"]).alias("c"))
    gap = F.aggregate(F.zip_with("embedding", "c", lambda x, y: F.pow(x.cast("double") - y, 2)), F.lit(0.0), lambda s, x: s + x)
    all_ = beside(vectors.select("vec_id", "embedding"), packed, "vec_id", label, most).select("vec_id", label, F.round(gap, 6).alias("d"))
    return all_.groupBy("vec_id").agg(F.min(F.struct("d", label)).alias("m")).select("vec_id", F.col(f"m.{label}").alias("nearest"), F.col("m.d").alias("distance2"))
