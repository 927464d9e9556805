"""Operator 2: embedding near-duplicates by an exact metric range join over pivots.

Unit vectors with cosine >= c lie within ``r = sqrt(2 - 2c)`` of each other. Every distinct vector is at
home in the cell of its nearest pivot. By the triangle inequality a vector can only have a partner at home in
another cell if its distance to that cell's pivot is at most the cell's radius plus r, and if it lies within r of
the plane between the two pivots; then it is a guest there. Full cells are cut into units and small ones share one,
of some ``HOME`` vectors. A vector is sent to its own unit and, as a guest, to those before it, so that each pair
meets in one unit only, the first of the two.

Nothing holds all guests at once: units are joined in rounds, each of which sends about as many vectors as there are
(or one unit's), and whose shuffle files go with its checkpoint. So disk grows with the table, however many cells a
vector is a guest of; what that costs is rounds. Guests are dealt into blocks, so that no task holds more than
``HOME + OTHERS`` vectors, and fewer wide ones. A block returns counts of links and a spanning forest of the links,
never its pairs. Equal vectors are one vector with a multiplicity, which the counts add up.

Edge cases: null ids are rows like others (a component of none but null ids has the id null, and its rows are kept); vectors that are null, empty or zero or that hold null or non-finite components link with nothing; shorter vectors
count as padded with zeros; rows that repeat vec_id count as rows; no rows give no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._common import bounded, checkpointed, components, trimmed

#: Vectors of a unit at home and of the others that a block of it meets; fewer where they hold more than so many values.
HOME, OTHERS, VALUES = 16_384, 16_384, 1 << 21
#: Values that a round may send in any case (vectors of 64 values: 262,144); beyond it, as many vectors as there are.
ROUND = 1 << 24
#: Rounds after which what was found is added up.
FOLD = 8
#: Pivots at most (they are held by every task), and vectors for each.
MAX_PIVOTS, PER_PIVOT = 1024, 4096
#: Slack for the bounds, which are computed in floating point.
SLACK = 1e-6
#: Pivots no further apart than this aren't told apart by the plane between them.
TWINS = 1e-3


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles, padded to a width."""
    out = np.zeros((len(column), width))
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(flat) == out.size and (ends == width).all():
        return flat.reshape(out.shape).astype(np.float64)
    out[np.repeat(np.arange(len(column)), ends), np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    return out


def _units(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def block_links(ids: np.ndarray, home: int, x: np.ndarray, weight: np.ndarray, least: float, among: bool) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For each row the weight of those with cosine >= ``least``, between the first ``home`` rows and the others (and, if ``among``, each two at
    home); and a spanning forest of those links."""
    unit = _units(x)
    counts, root, links = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids)), []
    rough = unit.astype(np.float32)
    slack = max(1e-4, x.shape[1] * 2.0**-22)
    step = max(1, 2_000_000 // max(1, len(ids)))
    for at in range(0, home, step):
        end, first = min(home, at + step), at if among else home
        dots = rough[at:end] @ rough[first:].T
        i, j = np.nonzero(dots >= least - slack)
        sure = dots[i, j] >= least + slack
        i, j = i + at, j + first
        once = j > i
        i, j, sure = i[once], j[once], sure[once]
        doubt = np.flatnonzero(~sure)
        for k in range(0, len(doubt), 65536):
            some = doubt[k : k + 65536]
            sure[some] = np.einsum("ij,ij->i", unit[i[some]], unit[j[some]]) >= least
        i, j = i[sure], j[sure]
        if not len(i):
            continue
        counts += np.bincount(i, weight[j], len(ids)).astype(np.int64) + np.bincount(j, weight[i], len(ids)).astype(np.int64)
        for a in np.unique(i[root[i] != root[j]]):
            met = j[np.searchsorted(i, a) : np.searchsorted(i, a, side="right")]
            roots, where = np.unique(root[met], return_index=True)
            new = roots != root[a]
            if new.any():
                links += [(int(ids[a]), int(ids[b])) for b in met[where[new]]]
                root[np.isin(root, roots[new])] = root[a]
    return counts, links


def _mixed(ids: np.ndarray, salt: int) -> np.ndarray:
    """A hash of ids, of 31 bits."""
    h = (ids.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) >> np.uint64(33)).astype(np.int64)


def _groups(homes: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first cell of each group of cells, and the units of each: neighbours share a unit of up to ``most`` vectors, a larger cell is cut into units."""
    starts, units, full = [], [], most + 1
    for cell, n in enumerate(homes):
        if full + n > most:
            starts.append(cell)
            units.append(max(1, -(-n // most)))
            full = 0
        full += n
    return np.array(starts), np.array(units)


def _rounds(homes: list[int], guests: list[int], units: list[int], others: int, most: int) -> list[list[tuple[int, int, int]]]:
    """Units as (group, unit in it, blocks of others) by round. A round sends ``most`` vectors about, or those of one unit."""
    rounds, sent = [], most
    for g, (n, more, cut) in enumerate(zip(homes, guests, units, strict=True)):
        for u in range(cut if n else 0):
            met = more + n * (cut - 1 - u) // cut
            blocks = max(1, -(-met // others))
            cost = met + blocks * -(-n // cut)
            if sent + cost > most:
                rounds.append([])
                sent = 0
            rounds[-1].append((g, u, blocks))
            sent += cost
    return rounds


def near_duplicates(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding)``."""
    r = float(np.sqrt(2 - 2 * least)) + SLACK
    x = F.col("embedding")
    of = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "float" if of == "float" else "double"  # floats stay so: half the bytes
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    fine = F.coalesce(x.isNotNull() & ~F.exists(x, bad) & F.exists(x, lambda v: v != 0), F.lit(False))
    # Negative zero and zero are one component; equal vectors are met by two hashes of the whole array.
    plain = F.transform(x, lambda v: F.when(v == 0, F.lit(0.0).cast(kind)).otherwise(v.cast(kind)))
    hashed = vectors.select(F.col("vec_id").cast("long"), F.when(fine, plain).alias("x")).select("*", F.when(F.col("x").isNotNull(), F.xxhash64("x")).alias("h1"), F.xxhash64(F.lit("v"), "x").alias("h2"))
    rows = checkpointed(hashed.drop("x"))
    distinct = checkpointed(
        hashed.where("x is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("x").alias("x"))
        .withColumn("id", F.monotonically_increasing_id())  # vec_id may be null
    )
    size = distinct.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("w")).first()
    n, width = size["n"], size["w"] or 1
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = _joined(distinct, n, width, kind, least, r)
    counts = found.where("links is not null").groupBy("id").agg(F.sum("links").alias("links"))
    links = components(found.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")))
    member = checkpointed(
        distinct.select("h1", "h2", "id", "least", "weight").join(counts, "id", "left").join(links.withColumnRenamed("node", "id"), "id", "left")
        .select("h1", "h2", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("c"))
    )
    of_vector = checkpointed(member.join(member.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("h1", "h2", "n_links", "component_id"))
    out = rows.join(bounded(of_vector, of_vector.count()), ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _joined(distinct: DataFrame, n: int, width: int, kind: str, least: float, r: float) -> DataFrame:
    """``id, links, to``: weights of links by vector (``to`` is null), and links whose components are those of all links, of ``distinct(id, weight, x)``."""
    wanted = int(min(MAX_PIVOTS, max(1, n // PER_PIVOT)))
    # By a hash: about twice as many as are wanted reach the driver, which takes the least ones.
    share = F.pmod(F.xxhash64(F.lit("pivot"), "h1"), F.lit(max(1, n // (2 * wanted + 40)))) == 0
    chosen = sorted((r["o"], r["x"]) for r in distinct.where(share).select("x", F.xxhash64(F.lit("pivot order"), "h1").alias("o")).collect())[:wanted]
    pivots = np.zeros((len(chosen), width))
    for k, (_, x_) in enumerate(chosen):
        pivots[k, : len(x_)] = x_
    pivots = _units(pivots)
    between = np.linalg.norm(pivots[:, None] - pivots[None], axis=2) if len(pivots) <= 256 else np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))

    def distances(column: pa.Array) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * _units(_matrix(column, width)) @ pivots.T))

    def at_home(batches):
        for b in batches:
            d = distances(b.column(0)) if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1))], names=["cell", "d"])

    # One row for each pivot, MAX_PIVOTS at most.
    sizes = distinct.select("x").mapInArrow(at_home, "cell int, d double").groupBy("cell").agg(F.max("d").alias("radius"), F.count("*").alias("n")).collect()
    radius, homes = np.full(len(pivots), -np.inf), np.zeros(len(pivots), dtype=np.int64)
    for s in sizes:
        radius[s["cell"]], homes[s["cell"]] = s["radius"], s["n"]
    home, others = max(1, min(HOME, VALUES // width)), max(1, min(OTHERS, VALUES // width))
    starts, units = _groups(homes.tolist(), home)
    homes = np.add.reduceat(homes, starts)
    group = np.repeat(np.arange(len(starts)), np.diff([*starts, len(pivots)]))

    def placed(batches):
        """Slices of rows; the group that each row is at home in, and whether it is a guest of each group before that."""
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                d = distances(b.column("x"))
                own = d.argmin(axis=1)
                near = d.min(axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    # Of pivots that are one direction, up to rounding, the quotient says nothing.
                    plane = np.where(between[own] > TWINS, (d**2 - near[:, None] ** 2) / (2 * between[own]), -np.inf)
                guest = (d <= radius + r) & ~(plane > r + SLACK)
                yield b, group[own], np.logical_or.reduceat(guest, starts, axis=1) & (np.arange(len(starts)) < group[own][:, None])

    def visits(batches):
        total = sum((guest.sum(axis=0) for _, _, guest in placed(batches)), np.zeros(len(starts), dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(starts), dtype=np.int32)), pa.array(total.astype(np.int64))], names=["g", "n"])

    guests = np.zeros(len(starts), dtype=np.int64)
    for s in distinct.select("x").mapInArrow(visits, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():
        guests[s["g"]] = s["n"]

    def join(block: pa.Table) -> pa.Table:
        among = block["block"][0].as_py() == 0
        block = block.select(["home", "id", "weight", "x"]).combine_chunks()
        block = block.take(pa.array(np.argsort(~block["home"].to_numpy(zero_copy_only=False), kind="stable"))).combine_chunks()
        ids, at_home = block["id"].to_numpy(), int(block["home"].to_numpy(zero_copy_only=False).sum())
        counts, links = block_links(ids, at_home, _matrix(block["x"].combine_chunks(), width), block["weight"].to_numpy(), least, among)
        linked = np.flatnonzero(counts)
        a, b = ([e[k] for e in links] for k in (0, 1))
        return pa.table(
            {
                "id": pa.concat_arrays([pa.array(ids[linked], pa.int64()), pa.array(a, pa.int64())]),
                "links": pa.concat_arrays([pa.array(counts[linked], pa.int64()), pa.nulls(len(a), pa.int64())]),
                "to": pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(b, pa.int64())]),
            }
        )

    def sender(turn: list[tuple[int, int, int]]):
        def send(batches):
            for b, own, guest in placed(batches):
                ids = b.column("id").to_numpy()
                unit = _mixed(ids, 1) % units[own]
                row, stands = [], []
                for g, u, blocks in turn:
                    mine = np.flatnonzero((own == g) & (unit == u))
                    row.append(np.repeat(mine, blocks))
                    stands.append((np.full(len(row[-1]), g), np.full(len(row[-1]), u), np.tile(np.arange(blocks), len(mine)), np.ones(len(row[-1]), dtype=bool)))
                    more = np.flatnonzero(guest[:, g] | ((own == g) & (unit > u)))
                    row.append(more)
                    stands.append((np.full(len(more), g), np.full(len(more), u), _mixed(ids[more], 2) % blocks, np.zeros(len(more), dtype=bool)))
                row = pa.array(np.concatenate(row))
                g, u, block, is_home = (np.concatenate(s) for s in zip(*stands, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.astype(np.int32)), pa.array(u.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(is_home), *(b.column(c).take(row) for c in ("id", "weight", "x"))],
                    names=["g", "u", "block", "home", "id", "weight", "x"],
                )

        return send

    # Units of no vectors are never joined, and a lone unit's guests are none: still one round, since some unit holds a vector.
    done, new = None, []
    turns = _rounds(homes.tolist(), guests.tolist(), units.tolist(), others, max(n, ROUND // width))
    for k, turn in enumerate(turns, 1):
        sent = distinct.select("id", "weight", "x").mapInArrow(trimmed(sender(turn)), f"g int, u int, block int, home boolean, id long, weight long, x array<{kind}>")
        # By number, so that few large blocks aren't put into fewer tasks.
        dealt = sent.repartition(max(12, min(2 * sum(blocks for _, _, blocks in turn), 2048)), "g", "u", "block")
        new.append(checkpointed(dealt.groupBy("g", "u", "block").applyInArrow(join, "id long, links long, to long")))
        if k % FOLD == 0 or k == len(turns):
            every = new if done is None else [done, *new]
            done, new = checkpointed(reduce(DataFrame.unionByName, every).groupBy("id", "to").agg(F.sum("links").alias("links"))), []
    return done
