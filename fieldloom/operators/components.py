"""Reliable checkpoints and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local session without that setting gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="fieldloom-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's checkpoint folder, its lineage cut there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the cluster's checkpoint folder, for tables of which only some columns or rows are read again."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(nodes: DataFrame, links: DataFrame, most_rounds: int = 80) -> DataFrame:
    """``fid, root`` for every row of ``nodes(fid)``: the least fid reachable by ``links(a, b)``.

    Links are contracted by stars (Kiveris et al., 2014): a round hangs the greater neighbours of every node on the least node
    around it, then the lesser ones, so that links turn into one star a component in rounds that grow with the logarithm
    of the graph. Rounds end when none changes a link; only the sum that tells so reaches the driver. Nodes without links
    are joined back at the end."""
    ordered = lambda df, a, b: df.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    stars, seen = settled(ordered(links.where("a <> b"), "a", "b")), None
    for _ in range(most_rounds):
        around = stars.unionByName(stars.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = around.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        outer = around.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        inner = outer.groupBy("hi").agg(F.min("lo").alias("m"))
        hung = outer.join(inner, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        stars = settled(ordered(hung.unionByName(inner.select("hi", F.col("m").alias("lo"))), "hi", "lo"))
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.select("fid").join(stars.select(F.col("hi").alias("fid"), F.col("lo").alias("root")), "fid", "left").select("fid", F.coalesce("root", "fid").alias("root"))
