"""Shared helpers: reliable checkpoints, word patterns, folds and distributed components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word; every other character belongs to one.
SPACES = " \t\n\x0b\x0c\r"
#: The largest number of narrow rows (16 bytes or so each) that a broadcast may carry, always counted first.
BROADCAST_ROWS = 500_000
#: Up to so many links (2 MB or so, counted first) are settled in one task; more go through rounds over all executors.
TASK_LINKS = 100_000
#: Spark's setting that deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set from ``spark.checkpoint.dir``; a local session without that setting gets a temporary one.

    On a cluster such a folder would be out of the executors' sight, so that one without the setting is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="fieldloom-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and cut its lineage there; its shuffle files, not needed any more, go at once."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the cluster's checkpoint folder and read it from there."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over Arrow batches that gives the memory it has freed back to the system when its task ends.

    Python workers outlive their tasks, and what they hold counts against the executor while other stages run."""

    def task(batches: Iterator) -> Iterator:
        import ctypes
        import gc

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return task


def sliced(batches: Iterator, column: int, most: int, rows: int = 1 << 30) -> Iterator:
    """The batches in slices whose strings or bytes in a column add up to ``most`` bytes at most, or single rows, and of ``rows`` rows at most."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, side="right"))
            end = min(max(begin + 1, end), begin + rows)
            yield batch.slice(begin, end - begin)
            begin = end


def bounded(small: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast where the counted size allows one; beyond it the join shuffles (and AQE splits hot keys)."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, with as many underscores ahead as it takes to be no column of the frames, whatever the case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words(text: Column) -> Column:
    """The words of a text, ``[^\\x20\\x09-\\x0D]+``, as an array; null text has none."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(flat, " ", -1), "")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the decimal doc_id modulo ``folds`` (null ids: the crc of the empty text, 0)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _settled(batches: Iterator) -> Iterator:
    """Components of all the links of a task: roots hook onto the least root that a link leads to, until none can."""
    import numpy as np
    import pyarrow as pa

    links = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not links:
        return
    u, v = (np.concatenate(x) for x in zip(*links, strict=True))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, np.concatenate([root[x], root[y]]), np.concatenate([low, low]))
        while (root != root[root]).any():
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``, the component being its least node.

    Alternating large-star and small-star contractions (Kiveris et al., 2014): each round is two
    pre-aggregated minima joined back to the edges, checkpointed; the rounds needed grow with the
    logarithm of the graph. Distinct edges that are counted to be few need no rounds: one task settles them.
    Nothing but two counters reaches the driver. Nodes without an edge to another node are absent from the result.
    """
    state = checkpointed(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    if state.count() <= TASK_LINKS:
        return state.coalesce(1).mapInArrow(trimmed(_settled), "node long, component long")
    for _ in range(max_rounds):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        state = checkpointed(
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct()
        )
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
