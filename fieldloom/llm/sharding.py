"""Operator 1: shards of near-equal bytes by minimax contiguous partition, native DataFrame code only.

Equal texts form one atomic group; groups are ordered by the 64-bit hash of their text. The smallest
capacity for which a greedy walk over the ordered groups needs no more than ``n_shards`` shards is
found by binary search, and the groups are cut there.

The driver never sees the groups. It holds byte sums of key ranges, at most ``MAX_RANGES`` of them.
A greedy walk over such ranges brackets the capacity from both sides (cutting only at known
boundaries, or anywhere inside a range); only the ranges that a cut can still fall in are split further
by more bits of the key, until every such range is one group. The capacity found is then exact.

Edge cases: a null text has size 1 and a null checksum, an empty one size 1 and checksum 0; repeated
rows get slots of their own; no rows give no rows; further columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm._common import checkpointed

#: Key ranges that the driver holds at most, and bits of the first split.
MAX_RANGES, FIRST_BITS = 65_536, 12
#: Rows that are numbered together, about.
CELL_ROWS = 20_000


def _greedy(ends: list[int], solid: list[bool], capacity: int, n: int, anywhere: bool) -> list[int] | None:
    """Positions in bytes of the ends of greedy shards, or None if ``n`` shards don't reach the end.

    ``ends`` are prefix sums of the ranges. A cut falls on a known boundary, or, if ``anywhere``, also
    inside ranges that hold several groups."""
    at, cuts = 0, []
    for _ in range(n):
        k = bisect_right(ends, at + capacity)
        if k == len(ends):
            return [*cuts, ends[-1] if ends else 0]
        known = ends[k - 1] if k else 0
        nxt = at + capacity if anywhere and not solid[k] else max(known, at if anywhere else 0)
        if nxt <= at:
            return None
        at = nxt
        cuts.append(at)
    return None


def _least(ends, solid, n, low, high, anywhere):
    while low < high:
        mid = (low + high) // 2
        if _greedy(ends, solid, mid, n, anywhere):
            high = mid
        else:
            low = mid + 1
    return low


def minimax_cuts(groups: DataFrame, n_shards: int) -> tuple[list[int], int]:
    """First keys of shards 1.. and the capacity, for ``groups(key long, bytes long)`` ordered by key."""

    def ranges(df: DataFrame, bits: int) -> list:
        return (
            df.groupBy(F.shiftright("key", 64 - bits).alias("r"))
            .agg(F.sum("bytes").alias("bytes"), F.count("*").alias("groups"), F.max("bytes").alias("most"), F.min("key").alias("first"))
            .collect()
        )

    # (first key, bytes, groups, bits, range number, largest group)
    known = sorted((r["first"], r["bytes"], r["groups"], FIRST_BITS, r["r"], r["most"]) for r in ranges(groups, FIRST_BITS))
    if not known:
        return [], 0
    total, floor = sum(x[1] for x in known), max(x[5] for x in known)
    while True:
        ends = list(accumulate(x[1] for x in known))
        solid = [x[2] == 1 or x[3] == 64 for x in known]
        bottom = max(floor, -(-total // n_shards))
        high = _least(ends, solid, n_shards, bottom, total, False)
        low = _least(ends, solid, n_shards, bottom, high, True)
        late = _greedy(ends, solid, high, n_shards, True)
        early = _greedy(ends, solid, low, n_shards, False) or _stalled(ends, low, n_shards)
        open_ = set()
        for j in range(len(late) - 1):
            a = early[j] if j < len(early) else ends[-1]
            b = late[j]
            for k in range(bisect_right(ends, min(a, b)), min(bisect_right(ends, max(a, b)) + 1, len(ends))):
                if not solid[k]:
                    open_.add(k)
        if low == high or not open_:
            break
        bits = {known[k][3] for k in open_}
        deep = min(bits)
        chosen = [k for k in sorted(open_) if known[k][3] == deep]
        more = max(1, min(64 - deep, ((MAX_RANGES // len(chosen)) or 2).bit_length() - 1))
        want = groups.where(F.shiftright("key", 64 - deep).isin([known[k][4] for k in chosen]))
        finer = [(r["first"], r["bytes"], r["groups"], deep + more, r["r"], r["most"]) for r in ranges(want, deep + more)]
        gone = set(chosen)
        known = sorted([x for k, x in enumerate(known) if k not in gone] + finer)
    cuts = _greedy(ends, solid, high, n_shards, False)
    starts = [0, *ends[:-1]]
    where = {s: known[k][0] for k, s in reversed(list(enumerate(starts)))}
    return [where[c] for c in cuts[:-1]], high


def _stalled(ends, capacity, n):
    """Greedy cuts at known boundaries only, as far as they come."""
    at, cuts = 0, []
    for _ in range(n):
        k = bisect_right(ends, at + capacity)
        at = max(at, ends[k - 1] if k else 0)
        cuts.append(at)
    return cuts


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs(doc_id, text)``."""
    sized = checkpointed(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
            F.xxhash64("text").alias("key"),
        )
    )
    groups = checkpointed(sized.groupBy("key").agg(F.sum("size").alias("bytes")))
    cuts, _ = minimax_cuts(groups, n_shards)
    shard = F.lit(0)
    for key in cuts:
        shard = shard + (F.col("key") >= F.lit(key)).cast("int")
    cells = max(1, -(-sized.count() // (n_shards * CELL_ROWS)))
    placed = sized.select(
        "*", shard.cast("int").alias("shard"), F.pmod(F.xxhash64(F.lit("slot"), "doc_id", "size", "text_crc32"), F.lit(cells)).alias("cell")
    )
    ahead = (
        placed.groupBy("shard", "cell").agg(F.count("*").alias("rows"))
        .select("shard", "cell", (F.sum("rows").over(Window.partitionBy("shard").orderBy("cell")) - F.col("rows")).alias("before"))
    )
    inside = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        placed.select("*", inside.cast("long").alias("inside"))
        .join(ahead, ["shard", "cell"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("before") + F.col("inside")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
