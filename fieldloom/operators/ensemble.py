"""Set operations over the fields of several engines."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import boxes
from fieldloom.operators.components import connected_components
from fieldloom.operators.merge import dissolved_overlaps
from fieldloom.operators.spatial_join import overlap_join


def union(fields: DataFrame, cell: float, engines: int) -> DataFrame:
    """Dissolved groups of overlapping fields of all engines."""
    return dissolved_overlaps(fields, cell).withColumn("engine_count", F.lit(engines))


def intersection(parts: list[DataFrame], cell: float) -> DataFrame:
    """Common boxes with area over all engines, folded from the left; ``fid_1``, ``fid_2`` ... tell the members."""

    def step(left: DataFrame, nth: tuple[int, DataFrame]) -> DataFrame:
        k, right = nth
        both = overlap_join(left, right.select("fid", "box"), cell, boxes.common_area(F.col("l.box"), F.col("r.box")) > 0)
        ids = [F.col(f"l.fid_{i}").alias(f"fid_{i}") for i in range(1, k)]
        return both.select(*ids, F.col("r.fid").alias(f"fid_{k}"), boxes.common(F.col("l.box"), F.col("r.box")).alias("box"))

    first = parts[0].select(F.col("fid").alias("fid_1"), "box")
    return reduce(step, enumerate(parts[1:], start=2), first).withColumn("engine_count", F.lit(len(parts)))


def votes_needed(engines: int, share: float) -> int:
    """At least two votes where two engines vote, and at least the share of them."""
    return max(2 if engines >= 2 else 1, math.ceil(share * engines))


def pixels(df: DataFrame, size: float) -> DataFrame:
    """Cells (``row, col``) whose centre lies in each row's box (low edges in, high edges out)."""
    b = F.col("box")
    first = lambda low: F.ceil(b[low] / size - 0.5)
    last = lambda high: F.ceil(b[high] / size - 0.5) - 1
    some = df.where((last("xmax") >= first("xmin")) & (last("ymax") >= first("ymin")))
    return some.select("*", F.explode(F.sequence(first("xmin"), last("xmax"))).alias("col")).select("*", F.explode(F.sequence(first("ymin"), last("ymax"))).alias("row"))


def _marks(df: DataFrame, size: float, *keys: str) -> DataFrame:
    """``keys``, and ``trow, tcol, mask``: the pixels that each row's box covers as bits of squares of 8 by 8 pixels, so that a box takes few rows."""
    b = F.col("box")
    first = lambda low: F.ceil(b[low] / size - 0.5)
    last = lambda high: F.ceil(b[high] / size - 0.5) - 1
    spans = df.select(*keys, first("xmin").alias("c0"), last("xmax").alias("c1"), first("ymin").alias("r0"), last("ymax").alias("r1")).where("c1 >= c0 and r1 >= r0")
    steps = lambda low, high: F.explode(F.sequence(F.shiftright(low, 3), F.shiftright(high, 3)))
    cut = spans.select("*", steps("c0", "c1").alias("tcol")).select("*", steps("r0", "r1").alias("trow"))
    inside = lambda low, high, at: (F.greatest(F.col(low) - F.col(at) * 8, F.lit(0)).cast("int"), F.least(F.col(high) - F.col(at) * 8, F.lit(7)).cast("int"))
    (x0, x1), (y0, y1) = inside("c0", "c1", "tcol"), inside("r0", "r1", "trow")
    # One line of bits from x0 to x1, in all eight lines; of these, the lines from y0 to y1.
    left = lambda c, n: F.call_function("shiftleft", c, n if isinstance(n, Column) else F.lit(n))
    ones = lambda n: F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 64 - n)
    marks = cut.select(*keys, "trow", "tcol", left(ones(x1 - x0 + 1), x0).alias("line"), left(ones(8 * (y1 - y0 + 1)), 8 * y0).alias("lines"))
    for n in (8, 16, 32):
        marks = marks.withColumn("line", F.col("line").bitwiseOR(left(F.col("line"), n)))
    return marks.select(*keys, "trow", "tcol", F.col("line").bitwiseAND(F.col("lines")).alias("mask"))


def _pixels_of(marked: DataFrame, mask: str, *more: str) -> DataFrame:
    """``row, col`` (and more columns) of every bit of a mask."""
    each = marked.select("*", F.explode(F.array(*map(F.lit, range(64)))).alias("bit"))
    each = each.where(F.call_function("shiftrightunsigned", F.col(mask), F.col("bit")).bitwiseAND(F.lit(1)) == 1)
    return each.select((F.col("trow") * 8 + F.shiftright("bit", 3)).alias("row"), (F.col("tcol") * 8 + F.col("bit").bitwiseAND(F.lit(7))).alias("col"), *more, "bit")


def covered(df: DataFrame, size: float) -> DataFrame:
    """``row, col`` of the cells whose centre lies in the box of any row, once each."""
    return _pixels_of(_marks(df, size).groupBy("trow", "tcol").agg(F.bit_or("mask").alias("mask")), "mask").select("row", "col")


def vote(fields: DataFrame, engines: int, share: float, size: float) -> DataFrame:
    """``row, col, votes``: cells that enough engines cover."""
    needed = votes_needed(engines, share)
    own = _marks(fields.where(F.col("engine").isNotNull()), size, "engine").groupBy("trow", "tcol", "engine").agg(F.bit_or("mask").alias("mask"))
    squares = own.groupBy("trow", "tcol").agg(F.collect_list("mask").alias("masks")).where(F.size("masks") >= needed)
    squares = squares.select("*", F.aggregate("masks", F.lit(0).cast("long"), lambda s, m: s.bitwiseOR(m)).alias("any"))
    each = _pixels_of(squares, "any", "masks")
    votes = F.aggregate("masks", F.lit(0).cast("long"), lambda s, m: s + F.call_function("shiftrightunsigned", m, F.col("bit")).bitwiseAND(F.lit(1).cast("long")))
    return each.select("row", "col", votes.alias("votes")).where(F.col("votes") >= needed)


def regions(cells: DataFrame, value: str | None = None, connectivity: int = 4, width: int = 1 << 31) -> DataFrame:
    """``row, col, root``: connected cells (of equal ``value``), the root being the least ``row * width + col``."""
    fid = F.col("row").cast("long") * width + F.col("col")
    nodes = cells.select("row", "col", *([value] if value else []), fid.alias("fid"))
    near = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    links = None
    for dy, dx in near:
        shifted = nodes.select((F.col("row") - dy).alias("row"), (F.col("col") - dx).alias("col"), *([F.col(value)] if value else []), F.col("fid").alias("b"))
        pairs = nodes.select("row", "col", *([value] if value else []), F.col("fid").alias("a")).join(shifted, ["row", "col", *([value] if value else [])]).select("a", "b")
        links = pairs if links is None else links.unionByName(pairs)
    return nodes.join(connected_components(nodes, links), "fid").drop("fid")
