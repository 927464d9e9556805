"""Operator 7: document quality by a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad. A line's features describe its characters, its words and how it
repeats, binned to indicators; a line also sees the bins of the line before and after it. The
field joins these with a weight for each pair of neighbouring labels. Forward and backward sums give each
line's probability of being good; their mean, weighted by the lines' lengths, put through a logistic
fit, is the document's quality.

Training uses at most ``MAX_BAD`` low-quality and ``MAX_GOOD`` other labelled texts (by the order of a hash of
doc_id), collected to the driver, with a text's label standing for each of its lines; the likelihood is climbed by Adam.
Scoring covers whole texts, in place, a megabyte at a time; a longer text is read alone, at some 65 times its bytes.

Edge cases: null and empty texts are one empty line; blank lines count as lines of one byte; repeated rows score
each; without labels of both kinds every score is 0; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._common import fold, sliced, trimmed
from fieldloom.llm.toxicity import _logistic, labelled_texts

#: Labelled texts that are learnt from at most.
MAX_BAD, MAX_GOOD = 1500, 3000
#: Bytes of texts that are read together; working arrays take some 65 bytes for each.
PIECE = 1 << 20
#: Upper ends of the bins of each feature of a line.
BINS = {
    "bytes": [1, 20, 60, 120, 250, 500, 1000, 3000],
    "words": [0, 1, 3, 8, 20, 50, 150],
    "word_length": [2, 3.5, 4.5, 5.5, 6.5, 8, 11],
    "upper": [0, 0.02, 0.05, 0.1, 0.2, 0.5, 0.9],
    "digit": [0, 0.02, 0.1, 0.3],
    "symbol": [0, 0.005, 0.02, 0.05, 0.1, 0.2],
    "mark": [0, 0.01, 0.03, 0.06, 0.1, 0.2],
    "other": [0, 0.02, 0.1, 0.3],
    "repeated_words": [0, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6],
    "same_as_before": [0, 0.05, 0.2, 0.5, 0.9],
    "repeated_line": [0],
    "ends": [0],
}
_OFFSETS = dict(zip(BINS, np.cumsum([0, *(len(b) + 1 for b in BINS.values())]).tolist(), strict=False))
WIDTH = sum(len(b) + 1 for b in BINS.values())

#: Kinds of bytes: 0 a letter, mark of a sentence or UTF-8 continuation, and those below.
_SPACE, _UPPER, _DIGIT, _SYMBOL, _MARK, _OTHER, _NEWLINE = range(1, 8)
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[9, 11, 12, 13, 32]] = _SPACE
_KIND[10] = _NEWLINE
_KIND[65:91] = _UPPER
_KIND[48:58] = _DIGIT
_KIND[list(b"#*$%&|<>")] = _SYMBOL
_KIND[list(b"!?")] = _MARK
_KIND[list(b"@/\\^~`_=+{}[]")] = _OTHER
_KIND[:9] = _KIND[14:32] = _OTHER


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of every line (one column for each feature), the lines' bytes, and the number of lines of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    kind = _KIND[data]
    ends = np.flatnonzero(kind == _NEWLINE)
    starts = np.append(0, ends[:-1] + 1)
    n_lines = np.array([t.count(b"\n") + 1 for t in texts], dtype=np.int64)
    text_of = np.repeat(np.arange(len(texts)), n_lines)
    size = ends - starts

    def per_line(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[ends] - total[starts]

    blank = (kind == _SPACE) | (kind == _NEWLINE)
    begins = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    stops = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
    words = np.searchsorted(begins, ends) - np.searchsorted(begins, starts)
    full = size - per_line(kind == _SPACE)
    # Hashes of words: sums of mixed bytes times powers by place, modulo 2**64; equal words get equal sums.
    length = stops - begins
    place = np.arange(len(data)) - np.repeat(np.append(begins, len(data)), np.diff(np.append(np.append(0, begins[1:] if len(begins) else []), [len(data), len(data)])).astype(np.int64))[: len(data)] if len(begins) else np.zeros(len(data), dtype=np.int64)
    power = np.multiply.accumulate(np.full(int(length.max(initial=1)) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    mixed = (data.astype(np.uint64) + np.uint64(257)) * np.uint64(0xBF58476D1CE4E5B9)
    valued = np.where(blank, np.uint64(0), mixed * power[np.clip(place, 0, len(power) - 1)])
    total = np.concatenate([[np.uint64(0)], np.add.accumulate(valued)])
    hashed = total[stops] - total[begins]
    hashed ^= hashed >> np.uint64(29)
    line_of = np.searchsorted(ends, begins)
    # Words that their line holds more than once, and words equal to the one before.
    order = np.lexsort((hashed, line_of))
    twin = (hashed[order][1:] == hashed[order][:-1]) & (line_of[order][1:] == line_of[order][:-1])
    twice = np.bincount(line_of[order][1:][twin], minlength=len(ends))
    after = (hashed[1:] == hashed[:-1]) & (line_of[1:] == line_of[:-1])
    again = np.bincount(line_of[1:][after], minlength=len(ends))
    # Lines equal to an earlier line of their text: the same words in the same order.
    step = np.multiply.accumulate(np.full(len(hashed) + 1, 0xC2B2AE3D27D4EB4F, dtype=np.uint64))
    nth = np.arange(len(hashed)) - np.searchsorted(begins, starts)[line_of] if len(hashed) else np.zeros(0, dtype=np.int64)
    of_line = np.zeros(len(ends), dtype=np.uint64)
    if len(hashed):
        run = np.concatenate([[np.uint64(0)], np.add.accumulate((hashed * np.uint64(0x94D049BB133111EB)) * step[nth])])
        first = np.searchsorted(begins, starts)
        of_line = run[first + words] - run[first]
    order = np.lexsort((np.arange(len(ends)), of_line, text_of))
    same = (of_line[order][1:] == of_line[order][:-1]) & (text_of[order][1:] == text_of[order][:-1])
    repeated = np.zeros(len(ends))
    repeated[order[1:][same]] = 1
    repeated[words == 0] = 0
    last = np.where(size > 0, data[np.maximum(ends - 1, 0)], 0)
    ratio = lambda part, of: part / np.maximum(of, 1)
    values = {
        "bytes": size, "words": words, "word_length": ratio(full, words), "upper": ratio(per_line(kind == _UPPER), full),
        "digit": ratio(per_line(kind == _DIGIT), full), "symbol": ratio(per_line(kind == _SYMBOL), full),
        "mark": ratio(per_line(kind == _MARK), full), "other": ratio(per_line(kind == _OTHER), full),
        "repeated_words": ratio(twice, words), "same_as_before": ratio(again, words), "repeated_line": repeated,
        "ends": np.isin(last, list(b".?!:;\"'")).astype(float),
    }
    bins = np.stack([np.searchsorted(np.array(BINS[f], dtype=float), values[f], side="left") + _OFFSETS[f] for f in BINS], axis=1)
    return bins.astype(np.int32), size, n_lines


class Chain:
    """Weights of a line's own bins and of both neighbours' (for the label good), and of pairs of labels."""

    def __init__(self) -> None:
        self.own, self.left, self.right = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
        self.pairs = np.zeros((2, 2))
        self.slope, self.shift = 1.0, 0.0

    def parameters(self) -> list[np.ndarray]:
        return [self.own, self.left, self.right, self.pairs]

    def _neighbours(self, bins: np.ndarray, n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bins of the line before and after; the bin ``WIDTH`` where there is none."""
        none = np.full((1, bins.shape[1]), WIDTH, dtype=bins.dtype)
        left, right = np.concatenate([none, bins[:-1]]), np.concatenate([bins[1:], none])
        first = np.cumsum(n_lines) - n_lines
        left[first], right[first + n_lines - 1] = WIDTH, WIDTH
        return left, right

    def marginals(self, bins: np.ndarray, n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Each line's probability of being good, and the summed probabilities of pairs of labels."""
        left, right = self._neighbours(bins, n_lines)
        good = self.own[bins].sum(axis=1) + self.left[left].sum(axis=1) + self.right[right].sum(axis=1)
        local = np.stack([np.exp(-np.clip(good, 0, 60)), np.exp(np.clip(good, -60, 0))], axis=1)
        move = np.exp(self.pairs - self.pairs.max())
        order = np.argsort(-n_lines, kind="stable")
        first, count = (np.cumsum(n_lines) - n_lines)[order], n_lines[order]
        forward, backward = np.empty_like(local), np.ones_like(local)
        # All texts step from line to line together; those that have ended drop out, as they are in order of length.
        for t in range(int(count[0]) if len(count) else 0):
            at = first[: np.searchsorted(-count, -t, side="left")] + t
            step = local[at] if t == 0 else local[at] * (forward[at - 1] @ move)
            forward[at] = step / step.sum(axis=1, keepdims=True)
        for t in range(int(count[0]) - 1 if len(count) else 0, 0, -1):
            at = first[: np.searchsorted(-count, -t, side="left")] + t
            step = (local[at] * backward[at]) @ move.T
            backward[at - 1] = step / step.sum(axis=1, keepdims=True)
        p = forward * backward
        p /= p.sum(axis=1, keepdims=True)
        inner = np.ones(len(local), dtype=bool)
        inner[np.cumsum(n_lines) - n_lines] = False
        at = np.flatnonzero(inner)
        joint = forward[at - 1][:, :, None] * move[None] * (local[at] * backward[at])[:, None, :]
        return p[:, 1], joint / joint.sum(axis=(1, 2), keepdims=True), (left, right, at)

    def quality(self, texts: list[bytes]) -> np.ndarray:
        """Mean probability of the lines being good, weighted by their bytes."""
        if not texts:
            return np.zeros(0)
        return self.mean(*line_features(texts))

    def mean(self, bins: np.ndarray, size: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        p, _, _ = self.marginals(bins, n_lines)
        of = np.cumsum(n_lines) - n_lines
        weight = size + 1.0
        return np.add.reduceat(p * weight, of) / np.add.reduceat(weight, of)

    def score(self, texts: list[bytes]) -> np.ndarray:
        q = np.clip(self.quality(texts), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(q / (1 - q)) + self.shift)))


def train(texts: list[bytes], good: list[int], steps: int = 150, rate: float = 0.1, ridge: float = 2.0) -> Chain | None:
    """The field of labelled texts; None without both labels."""
    y = np.array(good)
    if not (y == 1).any() or not (y == 0).any():
        return None
    chain = Chain()
    # In blocks, as the working arrays hold a few words of memory for each byte of text.
    ends = np.cumsum([len(t) for t in texts])
    cuts = np.flatnonzero(np.diff(ends // PIECE, prepend=0))
    parts = [line_features(list(p)) for p in np.split(np.array([*texts, None], dtype=object)[:-1], cuts) if len(p)]
    bins, size, n_lines = (np.concatenate(x) for x in zip(*parts, strict=True))
    label = np.repeat(y, n_lines)
    # Both labels weigh the same, and a long text no more than a short one by its number of lines.
    weight = np.repeat(np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) / n_lines, n_lines) * len(y)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in chain.parameters()]
    for step in range(1, steps + 1):
        p, joint, (left, right, at) = chain.marginals(bins, n_lines)
        error = (label - p) * weight
        gradient = []
        for places in (bins, left, right):
            gradient.append(sum(np.bincount(places[:, k], weights=error, minlength=WIDTH + 1) for k in range(places.shape[1])))
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[at - 1], label[at]), weight[at])
        gradient.append(seen - (joint * weight[at][:, None, None]).sum(axis=0))
        for value, g, (m, v) in zip(chain.parameters(), gradient, moments, strict=True):
            g = (g - ridge * value) / len(y)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    q = np.clip(chain.mean(bins, size, n_lines), 1e-6, 1 - 1e-6)
    chain.slope, chain.shift = _logistic(np.log(q / (1 - q)), y)
    return chain


def fit(docs: DataFrame, labels: DataFrame, max_bad: int = MAX_BAD, max_good: int = MAX_GOOD) -> Chain | None:
    texts, good = labelled_texts(docs, labels, "quality", {0: max_bad, 1: max_good})
    return train([t.encode() for t in texts], good)


def score_documents(docs: DataFrame, chain: Chain | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``score`` for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, len(keep), PIECE, 256):
            texts = [t or b"" for t in batch.column(len(keep)).to_pylist()]
            scores = np.zeros(len(texts)) if chain is None else chain.score(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores)], names=[*keep, "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "score double"])
    return docs.select(*keep, F.col("text").cast("binary").alias("__text")).mapInArrow(trimmed(run), schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``."""
    scored = score_documents(docs, fit(docs, labels), ["doc_id"])
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
