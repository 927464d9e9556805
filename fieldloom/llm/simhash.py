"""Operator 5: SimHash near-duplicates by multi-index hashing.

A text's words are lower-cased (A-Z) and joined into shingles; each shingle is hashed with XXH64
(seed 42), and a fingerprint bit is set if it is set in over half the hashes. Two fingerprints within
``max_distance`` = 3 bits differ by at most one bit in one of their 32-bit halves. So every distinct
fingerprint is filed under both halves, and asks under both halves and every half that sets one more
bit (of two halves that differ in one bit, one is the other with a bit set). What meets under a half is
verified by the whole distance.

A half that many fingerprints share is not paired off: it is filed again under the quarters of its
other half with the same ball, so that such a cell holds at most 2**16 fingerprints and their neighbours.
A cell is settled in one task, which returns a spanning forest of its links, never its pairs.

Edge cases: null and empty texts have the fingerprint 0, linked like any other; texts with fewer words than a
shingle have one shingle, all of their words; equal rows share a component; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm._common import bounded, checkpointed, components, trimmed

SEED, MAX_DISTANCE = 42, 3
#: A half with more fingerprints than this is filed again by quarters.
DIRECT = 24


def text_fingerprint(text: bytes, shingle: int = 3, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    w = text.lower().split()  # of bytes: only A-Z, and the six white space bytes
    if not w:
        return 0
    if len(w) < shingle:
        parts = [b" ".join(w)]
    else:
        parts = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return _majority(np.array([digest(s, seed) for s in parts], dtype=np.uint64))


def _majority(h: np.ndarray) -> int:
    """The fingerprint of hashes: the bits set in over half of them."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long) for every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            values = np.array([text_fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, fp long")


def _ball(df: DataFrame, parts: list[tuple[int, int]], prefix: list[str]) -> DataFrame:
    """``prefix, key, own, fp``: each fingerprint under its parts (shift, width) and under those that set one more bit."""
    sql = []
    for n, (shift, width) in enumerate(parts):
        part = f"(shiftrightunsigned(fp, {shift}) & {(1 << width) - 1}L)"
        ask = f"filter(transform(sequence(0, {width - 1}), i -> shiftleft(1L, i)), m -> ({part} & m) = 0L)"
        sql.append(f"transform(concat(array(0L), {ask}), m -> named_struct('key', ({part} | m) + {n}L * {1 << width}L, 'own', m = 0L))")
    return df.selectExpr(*prefix, "fp", f"inline(concat({', '.join(sql)}))")


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the distinct fingerprints that lie within the distance."""
    left, out = np.unique(fps).view(np.uint64), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= MAX_DISTANCE
            if near.any():
                found, left = left[near], left[~near]
                out += [(int(np.int64(x.astype(np.int64))), int(y)) for y in found.astype(np.int64)]
                queue += list(found)
    return out


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """``a, b``: links between the distinct fingerprints ``distinct(fp)`` whose components are those of all links."""
    ball = _ball(distinct, [(0, 32), (32, 32)], [])
    sizes = ball.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("long")).alias("owners")).where("n > 1 and owners > 0")
    met = checkpointed(ball.join(sizes, "key"))  # only halves at which something meets
    few = met.where(F.col("n") <= DIRECT)
    pairs = (
        few.where("own").select("key", F.col("fp").alias("a"))
        .join(few.select("key", F.col("fp").alias("b")), "key")
        .where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE))
        .select("a", "b")
    )
    many = met.where(F.col("n") > DIRECT).withColumnRenamed("key", "half").drop("own", "n", "owners")
    # The half that isn't shared, in quarters: two within 3 bits differ by one bit at most in one of them.
    quarters = _ball(many.where(F.col("half") < (1 << 32)), [(32, 16), (48, 16)], ["half"]).unionByName(
        _ball(many.where(F.col("half") >= (1 << 32)), [(0, 16), (16, 16)], ["half"])
    )

    def settle(_, cell: pa.Table) -> pa.Table:
        links = _forest(cell["fp"].to_numpy())
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    cells = quarters.drop("own").groupBy("half", "key").applyInArrow(lambda key, t: settle(key, t), "a long, b long")
    return pairs.unionByName(cells)


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text)``."""
    marked = checkpointed(fingerprints(docs, shingle))
    first = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    of_fp = _classes(first, fingerprint_links(first.select("fp")))
    return marked.join(bounded(of_fp, of_fp.count()), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _classes(first: DataFrame, links: DataFrame) -> DataFrame:
    """``fp, component_id`` from the least doc_id of each ``fp`` and the links between them."""
    comp = checkpointed(components(links))
    member = first.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    least = member.groupBy("c").agg(F.min("first").alias("component_id"))
    return checkpointed(member.join(least, "c").select("fp", "component_id"))


#: Of the pipeline's stage: texts are near copies where the Jaccard similarity of their shingle sets is 4/5 or more.
NEAR, OF = 4, 5
#: Texts sampled for the order of shingles, and the most shingles that order puts last.
ORDER_SAMPLE, ORDER_LAST = 4_000, 100_000
#: Turns in which some texts of each group meet the others (further ones find few links), how many do about, and the pairs for each
#: filed text that end the turns.
TURNS, HUBS, PAIRS_PER_ROW = 1, 16, 2
#: Buckets by which a text's shingles are counted, a power of two.
BUCKETS = 256


def shingle_set(text: bytes, shingle: int = 5, seed: int = SEED) -> np.ndarray:
    """The sorted distinct XXH64 hashes (as signed longs) of a UTF-8 text's shingles; none for a text without words."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, dtype=np.int64)
    parts = [b" ".join(w)] if len(w) < shingle else map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, seed) for s in parts], dtype=np.uint64).view(np.int64))


def _sets(docs: DataFrame, columns: str, row: Callable[[np.ndarray], tuple], shingle: int) -> DataFrame:
    """``doc_id, node`` (a hash of the shingle set) and what ``row`` makes of the set, for every row of ``docs(doc_id, text)``."""
    names = ["doc_id", "node", *(c.split()[0] for c in columns.split(", "))]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[c.split()[1]] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [shingle_set(t or b"", shingle) for t in batch.column(1).to_pylist()]
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
                made = zip(*(row(s) for s in sets), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes), *(pa.array(list(v), t) for v, t in zip(made, types, strict=True))], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(trimmed(run), f"doc_id long, node long, {columns}")


def _common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """Shingles that a sample of fixed size has more than once, the commonest last.

    They only put shingles in an order that all texts share; any such order is exact, and one with rare ones first leaves few to compare."""
    some = docs.orderBy(F.xxhash64(F.lit("order"), "doc_id")).limit(ORDER_SAMPLE)
    counted = _sets(some, "s array<long>", lambda s: (s,), shingle).dropDuplicates(["node"]).select(F.explode("s").alias("key")).groupBy("key").count()
    # At most ORDER_LAST rows reach the driver.
    rows = counted.where("count > 1").orderBy(F.desc("count"), "key").limit(ORDER_LAST).collect()
    return np.array([r["key"] for r in reversed(rows)], dtype=np.int64)


def _near(docs: DataFrame, ids: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """``a, b``: those of the distinct ``pairs(a, b)`` of nodes whose shingle sets are near; ``ids(node, first, n, sketch)`` says where their texts are.

    Two sets differ in as many shingles at least as their counts by bucket do (cut off or not), which spares most pairs
    the look at their whole sets."""

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), dtype=np.uint8).reshape(-1, BUCKETS).astype(np.int16) for k in (2, 4))
            n = b.column(3).to_numpy() + b.column(5).to_numpy()
            yield b.select(["a", "b"]).filter(pa.array((NEAR + OF) * np.abs(x - y).sum(axis=1, dtype=np.int64) <= (OF - NEAR) * n))

    of = lambda k: ids.select(F.col("node").alias(k), F.col("sketch").alias(f"s{k}"), F.col("n").alias(f"n{k}"))
    sketched = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sa", "na", "sb", "nb")
    pairs = checkpointed(sketched.mapInArrow(hopeful, "a long, b long"))
    wanted = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(ids, "node").select("node", "first"))
    n = wanted.count()
    of_id = bounded(wanted.select(F.col("first").alias("id")).distinct(), n)
    texts = docs.select("doc_id", "text").join(of_id, F.col("doc_id").cast("long").eqNullSafe(F.col("id")), "left_semi")
    # Ids may repeat, so that a set goes by its own hash.
    sets = _sets(texts, "s array<long>", lambda s: (s,), shingle).join(bounded(wanted.select("node"), n), "node", "left_semi")
    sets = checkpointed(sets.select("node", "s"))
    if sets.count() > sets.select("node").distinct().count():
        sets = checkpointed(sets.dropDuplicates(["node"]))
    both = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        .select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("o"), (F.size("sa") + F.size("sb")).alias("n"))
    )
    # o / (n - o) >= NEAR / OF
    return checkpointed(both.where((NEAR + OF) * F.col("o") >= NEAR * F.col("n")).select("a", "b"))


def _met_by_fingerprint(first: DataFrame) -> DataFrame:
    """``a, b``: of ``first(node, fp)``, each node with the least one of its fingerprint, and the least ones of fingerprints that link."""
    heads = checkpointed(first.groupBy("fp").agg(F.min("node").alias("head")))
    of = lambda k: heads.select(F.col("fp").alias(k), F.col("head").alias(f"h{k}"))
    across = fingerprint_links(heads.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))
    same = first.select("node", "fp").join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    return across.unionByName(same).distinct()


def similar_documents(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``doc_id, component_id``: groups of texts linked by a Jaccard similarity of 0.8 or more of their shingle sets.

    SimHash first: each set has a fingerprint, those within ``MAX_DISTANCE`` bits meet by multi-index hashing as in operator 5, and
    whole sets verify what met. Fingerprints of sets at 0.8 may lie further apart, so what is still in different
    components is completed exactly, by prefix filtering: of two such sets, each under one order of all shingles, the first
    n - ceil(0.8 n) + 1 of each have a shingle in common. A few of the texts that meet under a shingle are compared with the others
    while many pairs are left that no link has joined; then each two of those that still are apart. Groups of copies
    are one component by then: their pairs are never made."""
    last = _common_shingles(docs, shingle)
    by_key = np.argsort(last)
    known = last[by_key]

    def prefix(s: np.ndarray) -> tuple:
        n = len(s)
        sketch = np.minimum(np.bincount(s & (BUCKETS - 1), minlength=BUCKETS), 255).astype(np.uint8).tobytes()
        fp = int(np.uint64(_majority(s.view(np.uint64))).astype(np.int64))
        if not n:
            return 0, fp, sketch, s
        rank = np.zeros(n, dtype=np.int64)  # what isn't known to be common comes first
        if len(known):
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            rank = np.where(known[at] == s, by_key[at] + 1, 0)
        return n, fp, sketch, s[np.lexsort((s, rank))[: n - -(-NEAR * n // OF) + 1]]

    marked = checkpointed(_sets(docs, "n long, fp long, sketch binary, prefix array<long>", prefix, shingle))
    # Equal sets are one node, and what only one node is filed under goes right after the only shuffle of what is filed.
    first = checkpointed(marked.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch")))
    links = _near(docs, first, _met_by_fingerprint(first), shingle)
    filed = marked.select("node", "n", F.posexplode("prefix").alias("at", "key"))
    cell = Window.partitionBy("key")
    shared = filed.select("*", F.min("node").over(cell).alias("low"), F.max("node").over(cell).alias("high")).where("low <> high")
    met = checkpointed(shared.dropDuplicates(["key", "node"]))
    rest = met.select("key", "node", "n", "at")

    def enough(x: str, y: str) -> Column:
        """Of two texts filed under a shingle: lengths and ranks allow a similarity of 0.8, if it is the first that they share."""
        n, m, i, j = F.col(f"{x}n"), F.col(f"{y}n"), F.col(f"{x}at"), F.col(f"{y}at")
        alike = OF * F.least(n, m) >= NEAR * F.greatest(n, m)
        return alike & ((NEAR + OF) * F.least(n - i, m - j) >= NEAR * (n + m))

    for turn in range(TURNS):
        # What is filed under keys whose texts aren't all of one component yet.
        named = rest.join(checkpointed(components(links)), "node", "left").select("key", "node", "n", "at", F.coalesce("component", "node").alias("c"))
        mixed = named.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
        named = checkpointed(named.join(mixed, "key", "left_semi"))
        rest = named.drop("c")
        of_class = named.groupBy("key", "c").agg(F.count("*").cast("double").alias("m"))
        of_key = of_class.groupBy("key").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("inner"))
        size = of_key.agg(F.sum("m").alias("rows"), F.sum((F.col("m") * F.col("m") - F.col("inner")) / 2).alias("pairs")).first()
        if not size["rows"] or size["pairs"] <= PAIRS_PER_ROW * size["rows"]:
            break
        # Some HUBS of a key's texts, other ones each turn, meet those of other components: as many pairs for each row.
        shares = of_key.select("key", F.greatest(F.lit(1), F.floor(F.col("m") / HUBS)).cast("long").alias("share"))
        hubs = named.join(shares, "key").where(F.pmod(F.xxhash64(F.lit(turn), "node"), F.col("share")) == 0)
        spokes = named.join(hubs.select("key", F.struct("node", "n", "at", "c").alias("hub")), "key").where((F.col("c") != F.col("hub.c")) & enough("", "hub."))
        links = checkpointed(links.unionByName(_near(docs, first, spokes.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct(), shingle)))
    else:
        named = checkpointed(rest.join(checkpointed(components(links)), "node", "left").select("key", "node", "n", "at", F.coalesce("component", "node").alias("c")))
    x, y = named.alias("x"), named.alias("y")
    crossing = (
        x.join(y, F.col("x.key") == F.col("y.key"))
        .where((F.col("x.node") < F.col("y.node")) & (F.col("x.c") != F.col("y.c")) & enough("x.", "y."))
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    )
    links = links.unionByName(_near(docs, first, crossing, shingle))
    comp = checkpointed(components(links))
    member = first.join(comp, "node", "left").select("node", F.coalesce("first", F.lit(-(1 << 63))).alias("first"), F.coalesce("component", "node").alias("c"))
    least = member.groupBy("c").agg(F.min("first").alias("component_id"))
    classes = checkpointed(member.join(least, "c").select("node", "component_id"))
    return marked.select("doc_id", "node").join(bounded(classes, classes.count()), "node").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` with the least doc_id of their group; of rows that repeat it, the one whose text hashes least.

    Where null ids are the only ones of a group, one of its rows stays."""
    marked = similar_documents(docs, shingle)
    own = F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("component_id")
    kept = checkpointed(marked.where(own).groupBy(F.struct(F.col("doc_id").alias("id")).alias("of")).agg(F.count("*").alias("n")))
    n = kept.count()
    found = docs.select(F.struct(*docs.columns).alias("d")).join(bounded(kept, n), F.col("d.doc_id").eqNullSafe(F.col("of.id"))).select("d", "n")
    first = F.row_number().over(Window.partitionBy("d.doc_id").orderBy(F.xxhash64("d.text")))
    repeated = found.where("n > 1").select("d", first.alias("nth")).where("nth = 1").select("d")
    return found.where("n = 1").select("d").unionByName(repeated).select(*[F.col("d")[c].alias(c) for c in docs.columns])
