"""Operator 8: text scores of a hashed maximum-entropy model with a class-factored softmax.

``P(token | context) = P(class | context) * P(leaf | class, context) * share of the token in its leaf``.

Leaves stand in one order, by how words end, in a tree of ``BRANCH`` children a node; a class is the parent of
``BRANCH`` leaves. The three quarters of the leaves are one frequent word each, so that for these the second factor is a softmax over
words; the rest are ranges of endings, in which rarer words have their share by count, and the words that occur once in
training give the share of unknown words (Good and Turing), as one event for each leaf. Each step down the tree is a softmax that is
log-linear in hashed features of the context, joined with the node: the last word, the one before, the pair of both, and the third and fourth
last word as skip features. Higher steps use all of them, lower ones the nearest words (``FEATURES``).

The tree grows with the training vocabulary (``shape``): more distinct words give it more levels, and each level gives
it eight times the leaves, the feature rows and the words whose counts are at hand.

Everything is learnt from all training texts, in passes that each read what the last one wrote:

1.  Words are counted by two aggregations; the most frequent ones make the tree.
2.  One pass turns every text into the leaves of its tokens, and sums what the counts at hand can give; tokens of other words go to a
    shuffled join with the counts (no word that is left can be a hot key).
3.  Weights climb in ``ROUNDS`` rounds over disjoint parts of the corpus: each task climbs the gradient (AdaGrad,
    minibatches) over its part from the current weights, and its rows are averaged with those of the others, each weighted by
    how often it was used, in two levels of aggregation so that no group grows with the number of tasks.
4.  Scoring sums the steps of every token, in numpy batches.

Words are told apart by a 64-bit hash. Edge cases: null and empty texts are one end token; repeated rows score each; with no
training text all words are unknown; no rows give no rows; other columns are ignored; null ids score like others. A very long
text is worked on whole, at some 20 bytes of a worker's memory for each of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._common import SPACES, checkpointed, fold, sliced, stored, trimmed

#: Children of a node; fewest and most levels of a tree.
BRANCH, BITS, LEAST_LEVELS, MOST_LEVELS = 8, 3, 2, 6
#: Words with counts at hand for each leaf, and at most; feature rows of a table for each leaf.
HEAD, MOST_HEAD, ROWS = 64, 1 << 20, 4
#: Features of the context for each level from the root; the last entry holds for all further ones. Letters are how far back
#: the words stand (a: the last word); "ab" is the pair.
FEATURES = [("a", "b", "ab", "c", "d"), ("a", "b", "ab", "c"), ("a", "b"), ("a",)]
#: Rounds of training, tokens of a minibatch and of a task, step size, first sum of squares.
ROUNDS, MINIBATCH, TASK_TOKENS, RATE, SQUARE = 2, 32_768, 1_000_000, 0.3, 1.0
#: Rows of a block when weights are averaged; bytes of text that are taken at a time; distinct words that a counting task holds.
BLOCK, PIECE, HELD = 1_024, 1 << 20, 1_500_000

_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.isin(np.arange(256), list(SPACES.encode()))
_MIX = np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The end of a text: no word has this hash but by chance.
END = -0x6A09E667F3BCC909
_END_TAIL = 10


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(n, b, dtype=np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _words(data: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, hash and tail of each word of lower-cased bytes that end with a blank."""
    edge = np.flatnonzero(np.diff(blank, prepend=True))  # words begin and stop here in turn
    begins, stops = edge[::2], edge[1::2]
    power, back = _powers(max(PIECE, 1 << int(len(data)).bit_length() if len(data) > PIECE else 0))
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(_MIX[data] * power[: len(data)])])
    hashed = (sums[stops] - sums[begins]) * back[begins]
    hashed ^= hashed >> np.uint64(32)
    tail = np.zeros(len(begins), dtype=np.int64)
    for k in range(4):
        tail |= np.where(stops - 1 - k >= begins, data[np.maximum(stops - 1 - k, 0)], 0).astype(np.int64) << (24 - 8 * k)
    return begins, hashed.view(np.int64), tail


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and tails (the last four bytes, the last one highest) of all tokens in a row, and the number of tokens of each text.

    A word's hash is the sum of its lower-cased bytes' values times powers by place, modulo 2**64."""
    size = np.array([len(t or b"") for t in texts], dtype=np.int64)
    data = _LOWER[np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", dtype=np.uint8)]
    blank = _BLANK[data]
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data):  # cut behind a blank
            inner = np.flatnonzero(blank[at:end])
            end = at + int(inner[-1]) + 1 if len(inner) else end + int(blank[end:].argmax()) + 1
        begins, hashed, tail = _words(data[at:end], blank[at:end])
        parts.append((begins + at, hashed, tail))
        at = end
    begins, hashed, tail = (np.concatenate(x) for x in zip(*parts, strict=True))
    n = np.diff(np.searchsorted(begins, np.concatenate([[0], np.cumsum(size + 1)])))
    at = np.arange(len(begins)) + np.repeat(np.arange(len(texts)), n)
    h, t = np.full(len(begins) + len(texts), END, dtype=np.int64), np.full(len(begins) + len(texts), _END_TAIL, dtype=np.int64)
    h[at], t[at] = hashed, tail
    return h, t, n + 1


def count_words(docs: DataFrame) -> DataFrame:
    """``h, tail, c`` for every distinct token of ``docs(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, t, c = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h)
            first = np.flatnonzero(np.append(True, np.diff(h[order]) != 0))
            return h[order][first], t[order][first], np.add.reduceat(c[order], first)

        def rows(x: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v) for v in x], names=["h", "tail", "c"])

        for part in sliced(batches, 0, PIECE):
            h, t, _ = tokens(part.column(0).to_pylist())
            held.append((h, t, np.ones(len(h), dtype=np.int64)))
            n += len(h)
            if n > HELD:
                x = summed()
                if len(x[0]) > HELD // 2:
                    yield rows(x)
                    held, n = [], 0
                else:
                    held, n = [x], len(x[0])
        if held:
            yield rows(summed())

    counted = docs.select(F.col("text").cast("binary")).mapInArrow(trimmed(run), "h long, tail long, c long")
    return counted.groupBy("h").agg(F.first("tail").alias("tail"), F.sum("c").alias("c"))


@dataclass(frozen=True)
class Shape:
    """Sizes of a model with a number of levels, and where its rows of weights lie."""

    levels: int

    @property
    def leaves(self) -> int:
        return BRANCH**self.levels

    @property
    def head(self) -> int:
        return min(HEAD * self.leaves, MOST_HEAD)

    @property
    def table_bits(self) -> int:
        return int(ROWS * self.leaves).bit_length() - 1

    def tables(self) -> list[tuple[int, str, int, bool]]:
        """``level, feature, rows, hashed`` of each table of rows; the feature "" is the node's own row."""
        out = []
        for d in range(self.levels):
            for f in (*FEATURES[min(d, len(FEATURES) - 1)], ""):
                whole = BRANCH**d if f == "" else (self.leaves + 1) * BRANCH**d
                hashed = f == "ab" or whole > 1 << self.table_bits and f != ""
                out.append((d, f, 1 << self.table_bits if hashed else whole, hashed))
        return out

    def rows(self) -> int:
        return sum(n for _, _, n, _ in self.tables())


def shape(vocabulary: int) -> Shape:
    """The model for a number of distinct training words: two levels for every three that would hold them all."""
    return Shape(min(MOST_LEVELS, max(LEAST_LEVELS, int(np.log(max(1, vocabulary)) / np.log(BRANCH) * 2 / 3))))


class Vocabulary:
    """The words whose counts are at hand, and the tree's leaves: single words and ranges of tails."""

    def __init__(self, sizes: Shape, h: np.ndarray, tail: np.ndarray, c: np.ndarray) -> None:
        order = np.lexsort((h, -c))
        single = np.zeros(len(h), dtype=bool)
        single[order[: sizes.leaves * 3 // 4]] = True
        # Ranges begin at tails of the words that are left, each with an equal part of their counts.
        rest = np.flatnonzero(~single)[np.argsort(tail[~single], kind="stable")]
        begins = np.zeros(1, dtype=np.int64)
        if len(rest):
            until = np.cumsum(c[rest])
            wanted = sizes.leaves - sizes.leaves * 3 // 4
            begins = np.unique(np.append(0, tail[rest][np.searchsorted(until, until[-1] * np.arange(1, wanted) / wanted)]))
        # All leaves in the order of their tails; of one tail, the range first.
        ones = np.flatnonzero(single)
        ones = ones[np.lexsort((h[ones], tail[ones]))]
        at = np.argsort(np.concatenate([begins * 2, tail[ones] * 2 + 1]), kind="stable")
        place = np.empty(len(at), dtype=np.int64)
        place[at] = np.arange(len(at))
        self.range_begins, self.range_leaf = begins, place[: len(begins)]
        leaf = self.ranged(tail)
        leaf[ones] = place[len(begins) :]
        by_hash = np.argsort(h)
        self.h, self.c, self.leaf = h[by_hash], c[by_hash], leaf[by_hash]
        self.single = np.zeros(sizes.leaves, dtype=bool)
        self.single[place[len(begins) :]] = True

    def ranged(self, tail: np.ndarray) -> np.ndarray:
        return self.range_leaf[np.searchsorted(self.range_begins, tail, side="right") - 1]

    def look_up(self, h: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each token and its training count, -1 where that isn't at hand."""
        if not len(self.h):
            return self.ranged(tail), np.full(len(h), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        inside = self.h[at] == h
        leaf, c = self.leaf[at], np.where(inside, self.c[at], -1)
        out = np.flatnonzero(~inside)
        leaf[out] = self.ranged(tail[out])
        return leaf, c


def contexts(sizes: Shape, leaves: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """What each feature sees of each token's context; ``n`` tells how many tokens each text has."""
    at, first = np.arange(len(leaves)), np.repeat(np.cumsum(n) - n, n)
    small, start = leaves.astype(np.uint32), np.uint32(sizes.leaves)
    seen = {name: np.where(at - k >= first, small[np.maximum(at - k, 0)], start) for k, name in enumerate("abcd", 1)}
    seen["ab"] = seen["a"] * np.uint32(0x85EBCA6B) + seen["b"] * np.uint32(0xC2B2AE35)
    return seen


def _steps(sizes: Shape, seen: dict[str, np.ndarray], leaves: np.ndarray, part: slice) -> list[tuple[list[np.ndarray], np.ndarray]]:
    """For each level: the rows of weights that add up for each token of the part, and the child that was taken."""
    leaves = leaves[part]
    small = leaves.astype(np.uint32)
    out = [([], (leaves >> BITS * (sizes.levels - 1 - d)) & (BRANCH - 1)) for d in range(sizes.levels)]
    begin, shift = 0, np.uint32(32 - sizes.table_bits)
    for d, f, n, hashed in sizes.tables():
        node = small >> np.uint32(BITS * (sizes.levels - d))
        if f == "":
            row = node
        elif hashed:
            row = (seen[f][part] * np.uint32(0x9E3779B1) + node * np.uint32(0x7FEB352D) + np.uint32(0x68E31DA4)) >> shift
        else:
            row = seen[f][part] * np.uint32(BRANCH**d) + node
        out[d][0].append(row.astype(np.intp) + begin)
        begin += n
    return out


def _chances(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Probabilities of the children, one row for each child (sums over few children are cheap that way)."""
    x = np.take(weights, rows[0], axis=0, mode="clip")  # every row exists; this mode needs no buffer
    more = np.empty_like(x)
    for at in rows[1:]:
        np.take(weights, at, axis=0, mode="clip", out=more)
        x += more
    x = x.T.copy()
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def log_chances(sizes: Shape, weights: np.ndarray, seen: dict[str, np.ndarray], leaves: np.ndarray, part: slice) -> np.ndarray:
    """Log probability of the leaf of each token of the part."""
    out = 1.0
    for rows, chosen in _steps(sizes, seen, leaves, part):
        out = out * np.maximum(_chances(weights, rows)[chosen, np.arange(len(chosen))].astype(np.float64), 1e-30)
    return np.log(out)


def climb(sizes: Shape, weights: np.ndarray, squares: np.ndarray, uses: np.ndarray, seen: dict[str, np.ndarray], leaves: np.ndarray, part: slice) -> None:
    """One AdaGrad step (a scale for each row) on a minibatch, in place."""
    changes, tables = [], sizes.tables()
    begin = k = 0
    for rows, chosen in _steps(sizes, seen, leaves, part):
        error = -_chances(weights, rows).astype(np.float64)
        error[chosen, np.arange(len(chosen))] += 1
        for row in rows:
            n = tables[k][2]
            local, gradient = row - begin, np.empty((BRANCH, n))
            for g, e in zip(gradient, error, strict=True):
                g[:] = np.bincount(local, weights=e, minlength=n)
            changes.append((slice(begin, begin + n), gradient, np.bincount(local, minlength=n)))
            begin, k = begin + n, k + 1
    for at, gradient, times in changes:
        squares[at] += (gradient * gradient).mean(axis=0)
        gradient *= RATE / np.sqrt(squares[at])
        weights[at] += gradient.T
        uses[at] += times


def first_weights(sizes: Shape, totals: np.ndarray) -> np.ndarray:
    """Weights that give the leaves their shares of the training tokens, whatever the context; a leaf that nothing can be in has next to none."""
    share = totals.astype(np.float64) + 1e-9
    out = np.zeros((sizes.rows(), BRANCH), dtype=np.float32)
    begin = 0
    for d, f, n, _ in sizes.tables():
        if f == "":
            children = share.reshape(n, BRANCH, -1).sum(axis=2)
            out[begin : begin + n] = np.log(children / children.sum(axis=1, keepdims=True))
        begin += n
    return out


def _leaf_type(sizes: Shape) -> type:
    return np.uint16 if sizes.leaves <= 1 << 16 else np.uint32


def _read(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All leaves of a column of texts in a row, and the number of tokens of each."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1, offset=4 * column.offset)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]] if len(column) else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), dtype=kind).astype(np.int64), np.diff(ends) // np.dtype(kind).itemsize


def number_texts(docs: DataFrame, vocabulary: Vocabulary, sizes: Shape, log_base: float) -> DataFrame:
    """For every row of ``docs(doc_id, text)`` the leaves of its tokens, sums over those whose counts are at hand, and hash and leaf of the others."""
    kind = _leaf_type(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 1, PIECE):
            h, tail, n = tokens(part.column(1).to_pylist())
            leaf, c = vocabulary.look_up(h, tail)
            inside = c >= 0
            begins = np.cumsum(n) - n
            sums = lambda x: pa.array(np.add.reduceat(x, begins))
            outside = np.flatnonzero(~inside)
            offsets = pa.array(np.append(0, np.cumsum(np.add.reduceat((~inside).astype(np.int64), begins))), pa.int32())
            places = np.append(0, np.cumsum(n)).astype(np.int32) * np.int32(np.dtype(kind).itemsize)
            leaves = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(leaf.astype(kind).tobytes())])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(n), sums(inside.astype(np.int64)), sums(np.where(inside, np.log10(np.maximum(c, 0) + 1.0) - log_base, 0.0)),
                    sums(np.where(inside, np.log10(np.maximum(c, 1)), 0.0)), leaves,
                    pa.ListArray.from_arrays(offsets, pa.array(h[outside])), pa.ListArray.from_arrays(offsets, pa.array(leaf[outside].astype(np.int32))),
                ],
                names=["doc_id", "n_tokens", "known", "base", "log_c", "leaves", "h", "leaf"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, n_tokens long, known long, base double, log_c double, leaves binary, h array<long>, leaf array<int>")


def leaf_totals(numbered: DataFrame, sizes: Shape) -> np.ndarray:
    """Training tokens of each leaf."""
    kind = _leaf_type(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sizes.leaves, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_read(batch.column(0), kind)[0], minlength=sizes.leaves)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["leaf", "n"])

    return _by_leaf(numbered.select("leaves").mapInArrow(run, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")), sizes)


def _by_leaf(rows: DataFrame, sizes: Shape) -> np.ndarray:
    """``rows(leaf, n)``, one for a leaf at most, as an array."""
    found, out = rows.toArrow(), np.zeros(sizes.leaves)
    out[found["leaf"].to_numpy()] = found["n"].to_numpy()
    return out


def train_round(numbered: DataFrame, sizes: Shape, weights: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights after each task climbed over its texts, averaged by use; and the mean of the squares."""
    kind = _leaf_type(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        w, s, uses = weights.copy(), squares.copy(), np.zeros(len(weights))
        for batch in sliced(batches, 0, PIECE):
            leaves, n = _read(batch.column(0), kind)
            seen = contexts(sizes, leaves, n)
            for at in range(0, len(leaves), MINIBATCH):
                climb(sizes, w, s, uses, seen, leaves, slice(at, at + MINIBATCH))
        task = TaskContext.get().partitionId()
        for k in range(0, len(w), BLOCK):
            used = np.flatnonzero(uses[k : k + BLOCK])
            if len(used):
                at = used + k
                sums = np.concatenate([w[at] * uses[at, None], (s[at] * uses[at])[:, None], uses[at, None]], axis=1).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([task], pa.int32()), pa.array([used.astype(np.uint16).tobytes()]), pa.array([sums.tobytes()])], names=["block", "task", "used", "sums"])

    def add(found: pa.Table) -> pa.Table:
        total = np.zeros((BLOCK, BRANCH + 2))
        for used, x in zip(found["used"], found["sums"], strict=True):
            total[np.frombuffer(used.as_py(), dtype=np.uint16)] += np.frombuffer(x.as_py(), dtype=np.float32).reshape(-1, BRANCH + 2)
        used = np.flatnonzero(total[:, -1])
        return pa.table({"block": found["block"].slice(0, 1).cast(pa.int32()), "used": pa.array([used.astype(np.uint16).tobytes()]), "sums": pa.array([total[used].astype(np.float32).tobytes()])})

    climbed = numbered.select("leaves").mapInArrow(trimmed(run), "block int, task int, used binary, sums binary")
    groups = max(1, int(numbered.rdd.getNumPartitions() ** 0.5))
    to = "block int, used binary, sums binary"
    halfway = climbed.groupBy("block", F.pmod("task", F.lit(groups)).alias("g")).applyInArrow(add, to)
    out, out_squares = weights.copy(), squares.copy()
    averaged = halfway.groupBy("block").applyInArrow(add, to).toArrow()  # the weights, whose number the shape bounds
    for block, used, x in zip(*(averaged[k] for k in ("block", "used", "sums")), strict=True):
        at = block.as_py() + np.frombuffer(used.as_py(), dtype=np.uint16).astype(np.int64)
        sums = np.frombuffer(x.as_py(), dtype=np.float32).reshape(-1, BRANCH + 2)
        out[at], out_squares[at] = sums[:, :-2] / sums[:, -1:], sums[:, -2] / sums[:, -1]
    return out, out_squares


def score_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs(doc_id, text)``."""
    counts = checkpointed(count_words(docs.where(fold(F.col("doc_id"), 7) != 2)))
    size = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = int(size["n"] or 0), int(size["v"])
    sizes, log_base = shape(v), float(np.log10(n + v + 1))
    # The most frequent words: all above the least count whose words are no more than the head holds. A histogram tells it.
    step = F.floor(F.log2("c") * 8).cast("int")
    least, held = None, 0
    for row in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # 8 x 64 rows at most
        held += row["count"]
        if held > sizes.head:
            break
        least = row["step"]
    head = (counts.where(step >= least) if least is not None else counts.limit(0)).toArrow()
    vocabulary = Vocabulary(sizes, *(head[k].to_numpy() for k in ("h", "tail", "c")))
    numbered = stored(
        number_texts(docs, vocabulary, sizes, log_base).withColumn("held_out", fold(F.col("doc_id"), 7) == 2).withColumn("row", F.monotonically_increasing_id())
    )
    left = numbered.select("row", "held_out", F.inline(F.arrays_zip("h", "leaf"))).join(counts.select("h", "c"), "h", "left")
    found = checkpointed(
        left.groupBy("row").agg(
            F.count("c").alias("t_known"),
            F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0) - F.lit(log_base)).alias("t_base"),
            F.sum(F.coalesce(F.log10("c"), F.lit(0.0))).alias("t_log_c"),
            F.collect_list(F.when(F.col("c").isNull(), F.col("leaf"))).alias("unknown"),
            F.collect_list(F.when((F.col("c") == 1) & ~F.col("held_out"), F.col("leaf"))).alias("once"),
        )
    )
    training = numbered.where("not held_out")
    total = leaf_totals(training, sizes)
    once = _by_leaf(found.select(F.explode("once").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")), sizes)
    once += np.bincount(vocabulary.leaf[vocabulary.c == 1], minlength=sizes.leaves)
    # Shares of unknown words. A leaf without training words holds nothing else; a word that is a leaf is never unknown.
    unknown = np.where(total > 0, np.clip(once / np.maximum(total, 1), 1 / (total + 1), 0.9), 1.0)
    unknown[vocabulary.single] = 0.0
    weights = first_weights(sizes, total + np.isin(np.arange(sizes.leaves), vocabulary.range_leaf) * 0.5)
    squares = np.full(len(weights), SQUARE)
    if n:
        tasks = max(1, n // ROUNDS // TASK_TOKENS)
        for turn in range(ROUNDS):
            part = training.where(F.pmod(F.xxhash64(F.lit("round"), "doc_id", "n_tokens"), F.lit(ROUNDS)) == turn)
            weights, squares = train_round(part.coalesce(tasks), sizes, weights, squares)
    with np.errstate(divide="ignore"):
        # What a token adds besides its steps: known words 1 / total (and their log c, which is summed already).
        of_known = np.where(total > 0, np.log10(np.maximum(1 - unknown, 1e-300)) - np.log10(np.maximum(total, 1)), 0.0)
        of_unknown = np.log10(np.maximum(unknown, 1e-300)) - of_known
    kind, names = _leaf_type(sizes), ["row", "doc_id", "held_out", "n_tokens", "known", "base", "log_c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 7, PIECE):
            leaves, n_tokens = _read(batch.column(7), kind)
            seen, chance = contexts(sizes, leaves, n_tokens), np.empty(len(leaves))
            for at in range(0, len(leaves), MINIBATCH):
                part = slice(at, at + MINIBATCH)
                chance[part] = log_chances(sizes, weights, seen, leaves, part)
            model = np.add.reduceat(chance / np.log(10) + of_known[leaves], np.cumsum(n_tokens) - n_tokens)
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(model)], names=[*names, "model"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            more = [of_unknown[np.array(x, dtype=np.int64)].sum() if x else 0.0 for x in b.column(6).to_pylist()]
            score = np.array(b.column(5).to_pylist(), dtype=np.float64) + np.array(more, dtype=np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    narrow = numbered.select(*names, "leaves").mapInArrow(trimmed(run), "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, log_c double, model double")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = narrow.join(found.drop("once"), "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("t_known")).alias("n_known"), (F.col("base") + zero("t_base")).alias("base_score"),
        (F.col("model") + F.col("log_c") + zero("t_log_c")).alias("model"), "unknown",
    )
    done = out.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
