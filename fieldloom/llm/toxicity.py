"""Operator 4: toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

A text is a bag of words, lower-cased, without the characters that aren't letters or digits ("i.d-i*o t" is
"idiot": runs of single characters are joined, too). The kernel of two words sums over all common
subsequences of three characters, each weighted by ``DECAY`` to the power of the stretch that it covers in either word,
so inserted or missing characters weaken a match but don't undo it. Words longer than ``WINDOW``
characters are read in overlapping windows. Landmarks, chosen from the training words, span the Nystroem feature map;
the machine is linear in it. A text scores as its worst word, put on a 0 to 1 scale by a logistic fit.

Labels belong to texts, so the machine learns from bags: the likeliest word of each toxic text is its
witness, and the most toxic-looking words of the clean texts are the negatives; witnesses and negatives are
chosen anew with each round of training.

Training uses at most ``MAX_TOXIC`` toxic and ``MAX_CLEAN`` clean labelled texts of ``MAX_BYTES`` in all (by the order of a hash of
doc_id), which are collected to the driver; scoring covers all texts, in place, a megabyte at a time (a longer text alone, at
some ten times its bytes for its distinct words).

The machine folds into one weight per subsequence of the landmarks' alphabet, so that a word costs a table look-up for each
of its subsequences. Edge cases: null and empty texts score as texts without words; repeated rows score each;
without labels of both kinds every score is 0; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm._common import checkpointed, fold, sliced, trimmed

LENGTH, DECAY, WINDOW = 3, 0.6, 20
LANDMARKS, ROUNDS, CACHE = 128, 4, 80_000
#: Bytes of texts that are scored together.
PIECE = 1 << 20
#: Labelled texts that are learnt from at most.
MAX_TOXIC, MAX_CLEAN = 1500, 3000
#: Bytes of texts that a classifier learns from at most, shared by the labels.
MAX_BYTES = 64_000_000
_LETTERS = re.compile(r"[\W_]+")
_SPELT = re.compile(r"(?<!\S)(?:\S[^\S\n]){2,}\S(?!\S)")


def text_words(text: str) -> set[str]:
    """The distinct words of a text as they stand, and runs of single characters joined."""
    low = text.lower()
    found = set(low.split())
    found.update(x.replace(" ", "") for x in _SPELT.findall(low))
    return found


def windows(word: str) -> list[str]:
    """A word's letters and digits, in overlapping windows if they are many."""
    plain = _LETTERS.sub("", word)
    if len(plain) <= WINDOW:
        return [plain]
    step = WINDOW // 2
    return [plain[k : k + WINDOW] for k in range(0, len(plain) - step, step)]


@cache
def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All increasing triples of places in a word of n characters, and the decay of the stretch of each."""
    at = np.array(list(combinations(range(n), LENGTH)), dtype=np.int64).reshape(-1, LENGTH)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1)


def _norms(codes: np.ndarray) -> np.ndarray:
    """The kernel of each word with itself, for words of equal length, by dynamic programming over their places."""
    b, n = codes.shape
    same = (codes[:, :, None] == codes[:, None, :]).astype(np.float64)
    ends = DECAY**2 * same
    for _ in range(LENGTH - 1):
        so_far = np.zeros((b, n + 1, n + 1))
        for i in range(1, n + 1):
            # Sum over all earlier ends, decayed by the distance in both words: first along one word, then the other.
            row = np.zeros(b)
            for j in range(1, n + 1):
                row = row * DECAY + ends[:, i - 1, j - 1]
                so_far[:, i, j] = DECAY * so_far[:, i - 1, j] + row
        ends = DECAY**2 * same * so_far[:, :n, :n]
    return ends.sum(axis=(1, 2))


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in the list and characters of words of equal length, in blocks."""
    sizes = np.array([len(w) for w in words])
    for n in np.unique(sizes):
        where = np.flatnonzero(sizes == n)
        if n < LENGTH:
            continue
        step = max(64, 400_000 // len(_places(int(n))[0]))
        for k in range(0, len(where), step):
            part = where[k : k + step]
            yield part, np.frombuffer("".join([words[i] for i in part]).encode("utf-32-le"), dtype=np.uint32).reshape(len(part), n)


def _triples(codes: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """The number of each subsequence of each word; characters outside the alphabet count as one."""
    at, _ = _places(codes.shape[1])
    size = len(alphabet) + 1
    k = np.searchsorted(alphabet, codes)
    k = np.where((k < len(alphabet)) & (alphabet[np.minimum(k, len(alphabet) - 1)] == codes), k + 1, 0)
    return (k[:, at[:, 0]] * size + k[:, at[:, 1]]) * size + k[:, at[:, 2]]


def subsequence_scores(words: list[str], alphabet: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each word the sum of its subsequences' weights, over its norm.

    ``rows`` tells the row of weights of each subsequence over the alphabet; columns are free."""
    out = np.zeros((len(words), weights.shape[1]))
    for part, codes in _by_length(words):
        _, decay = _places(codes.shape[1])
        index = rows[_triples(codes, alphabet)]
        if weights.shape[1] == 1:
            got = (weights[index, 0] * decay).sum(axis=1, keepdims=True)
        else:
            got = np.stack([(weights[i] * decay[:, None]).sum(axis=0) for i in index])
        out[part] = got / np.sqrt(np.maximum(_norms(codes), 1e-300))[:, None]
    return out


def landmark_table(landmarks: list[str], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each subsequence over the alphabet (0: no landmark holds it), and each landmark's normalised weights of
    those subsequences that occur, one column for each landmark."""
    found = [(part, _triples(codes, alphabet), _places(codes.shape[1])[1] / np.sqrt(_norms(codes))[:, None]) for part, codes in _by_length(landmarks)]
    seen = np.unique(np.concatenate([index.ravel() for _, index, _ in found]))
    rows = np.zeros((len(alphabet) + 1) ** LENGTH, dtype=np.int32)
    rows[seen] = np.arange(1, len(seen) + 1)
    out = np.zeros((len(seen) + 1, len(landmarks)))
    for part, index, value in found:
        for k, which in enumerate(part):
            np.add.at(out[:, which], rows[index[k]], value[k])
    return rows, out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Linear support vector machine (L1 loss) by dual coordinate ascent; the last feature is the constant."""
    rng = np.random.default_rng(7)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    square = (x * x).sum(axis=1)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), c * weight[i])
            w += (new - alpha[i]) * y[i] * x[i]
            alpha[i] = new
    return w


def _bent(word: str, rng: np.random.Generator, known: Counter) -> list[str]:
    """The word with a character put in, twice, and with one left out, unless clean texts hold that."""
    out = []
    for _ in range(2):
        k = int(rng.integers(1, len(word)))
        out.append(word[:k] + chr(97 + int(rng.integers(26))) + word[k:])
    if len(word) > 5:
        k = int(rng.integers(1, len(word) - 1))
        out.append(word[:k] + word[k + 1 :])
    return [w for w in out if w not in known]


class ToxicityModel:
    """``score(words)`` for words, ``text_scores(texts)`` for texts; small enough to go with each task."""

    def __init__(self, alphabet: np.ndarray, rows: np.ndarray, weights: np.ndarray, bias: float, slope: float, shift: float) -> None:
        self.alphabet, self.rows, self.weights, self.bias, self.slope, self.shift = alphabet, rows, weights, bias, slope, shift
        self.now: dict[str, float] = {}
        self.old: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"now": {}, "old": {}}

    def score(self, words: list[str]) -> np.ndarray:
        parts = [windows(w) for w in words]
        ends = np.cumsum([len(p) for p in parts])
        got = subsequence_scores([x for p in parts for x in p], self.alphabet, self.rows, self.weights)[:, 0] + self.bias
        return np.maximum.reduceat(got, np.append(0, ends[:-1])) if len(words) else got

    def margins(self, bags: list[set[str]]) -> np.ndarray:
        now, old = self.now, self.old
        fresh = set()
        for bag in bags:
            fresh.update(w for w in bag if w not in now)
        now.update((w, old[w]) for w in fresh if w in old)
        fresh = [w for w in fresh if w not in now]
        now.update(zip(fresh, self.score(fresh).tolist(), strict=True))
        out = np.array([max(map(now.__getitem__, bag), default=self.bias) for bag in bags])
        if len(now) > CACHE:
            self.now, self.old = {}, now
        return out

    def text_scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins([text_words(t) for t in texts]) + self.shift, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's method with a slight ridge and smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.stack([x, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (t - p) - 1e-3 * w)
        w += np.clip(step, -5, 5)
    return float(w[0]), float(w[1])


def _evidence(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How far the texts that hold a word are toxic beyond the share of all texts: the log likelihood ratio, with its sign."""
    expected = n1 / (n1 + n0)
    n = toxic + clean
    p = np.clip(toxic / n, 1e-12, 1 - 1e-12)
    gain = toxic * np.log(p / expected) + clean * np.log((1 - p) / (1 - expected))
    return np.where(p >= expected, gain, -gain)


def train(texts: list[str], toxic: list[int]) -> ToxicityModel | None:
    """The model of labelled texts; None without both labels."""
    y = np.array(toxic)
    if not (y == 1).any() or not (y == 0).any():
        return None
    # Sets have no order of their own: every choice below is made in the order of counts, then of the words.
    bags = [sorted({w for raw in text_words(t) for w in windows(raw) if len(w) >= LENGTH}) for t in texts]
    in_toxic, in_clean = Counter(), Counter()
    for bag, label in zip(bags, y, strict=True):
        (in_toxic if label else in_clean).update(bag)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    vocabulary = sorted(set(in_toxic) | set(in_clean))
    number = {w: k for k, w in enumerate(vocabulary)}
    score = _evidence(np.array([in_toxic[w] for w in vocabulary], float), np.array([in_clean[w] for w in vocabulary], float), n1, n0)
    rows = [np.array([number[w] for w in bag], dtype=np.int64) for bag in bags]
    clean_words = np.array([number[w] for w in sorted(in_clean)], dtype=np.int64)
    rng = np.random.default_rng(11)
    sample = rng.choice(clean_words, min(4000, len(clean_words)), replace=False) if len(clean_words) else clean_words
    model = None
    for turn in range(ROUNDS):
        witness = Counter(int(r[score[r].argmax()]) for r, label in zip(rows, y, strict=True) if label and len(r))
        hard = Counter(int(r[score[r].argmax()]) for r, label in zip(rows, y, strict=True) if not label and len(r))
        most = lambda counts: sorted(counts, key=lambda k: (-counts[k], k))[:3000]
        # A witness that clean texts hold as often is noise of the labels.
        ones = [k for k in most(witness) if in_clean[vocabulary[k]] * n1 <= 0.2 * in_toxic[vocabulary[k]] * n0]
        zeros = sorted((set(most(hard)) | set(sample.tolist())) - set(ones))
        if not ones or not zeros:
            break
        if turn == 0 or turn == ROUNDS // 2:
            marks = [vocabulary[k] for k in [*ones[: LANDMARKS * 3 // 4], *zeros[:: max(1, len(zeros) // (LANDMARKS // 4))][: LANDMARKS // 4]]]
            letters = Counter("".join(marks))
            alphabet = np.array(sorted(map(ord, sorted(letters, key=lambda c: (-letters[c], c))[:60])), dtype=np.uint32)
            marks = [m for m in marks if set(map(ord, m)) <= set(alphabet.tolist())]
            rows_of, table = landmark_table(marks, alphabet)
            values, vectors = np.linalg.eigh(table.T @ table)
            good = values > 1e-6 * values.max()
            features = np.ascontiguousarray(table @ (vectors[:, good] / np.sqrt(values[good])))
        bent = [x for k in ones if witness[k] >= 3 for x in _bent(vocabulary[k], rng, in_clean)]
        use = [*(vocabulary[k] for k in ones), *bent, *(vocabulary[k] for k in zeros)]
        x = subsequence_scores(use, alphabet, rows_of, features)
        x = np.concatenate([x, np.full((len(use), 1), 0.5)], axis=1)
        labels = np.array([1.0] * (len(ones) + len(bent)) + [-1.0] * len(zeros))
        weight = np.array([*(min(20.0, witness[k]) for k in ones), *([1.0] * (len(bent) + len(zeros)))])
        weight[labels < 0] *= max(1.0, weight[labels > 0].sum() / len(zeros))
        w = _svm(x, labels, weight)
        model = ToxicityModel(alphabet, rows_of, (features @ w[:-1])[:, None], float(w[-1] * 0.5), 1.0, 0.0)
        score = model.score(vocabulary)
    if model is None:
        return None
    model.slope, model.shift = _logistic(np.array([score[r].max() if len(r) else model.bias for r in rows]), y)
    return model


def labelled_texts(docs: DataFrame, labels: DataFrame, column: str, most: dict[int, int], most_bytes: int = MAX_BYTES) -> tuple[list[str], list[int]]:
    """Texts and labels of the learning folds, at most ``most[label]`` of each label and ``most_bytes`` in all, by the order of a hash of doc_id.

    Of rows that repeat a doc_id the text that hashes least is taken; a null text is empty."""
    chosen = None
    usable = labels.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 5) != 0)).select("doc_id", F.col(column).alias("label"))
    for label, n in most.items():
        part = usable.where(F.col("label") == label).orderBy(F.xxhash64(F.lit(column), "doc_id"), "doc_id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = checkpointed(
        docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id")
        .agg(F.first("label").alias("label"), F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    )  # as many rows as ``most`` says
    ahead = Window.partitionBy("label").orderBy(F.xxhash64(F.lit(column), "doc_id"), "doc_id")
    sizes = found.select("doc_id", F.sum(F.octet_length("text")).over(ahead).alias("held")).where(F.col("held") <= most_bytes // len(most)).select("doc_id")
    rows = found.join(F.broadcast(sizes), "doc_id").toPandas().sort_values("doc_id")
    return rows["text"].tolist(), [int(x) for x in rows["label"]]


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> ToxicityModel | None:
    return train(*labelled_texts(docs, labels, "toxic", {1: max_toxic, 0: max_clean}))


def score_documents(docs: DataFrame, model: ToxicityModel | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``score`` for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, len(keep), PIECE, 512):
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            scores = np.zeros(len(texts)) if model is None else model.text_scores(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores)], names=[*keep, "score"])
        if model is not None:
            model.now, model.old = {}, {}

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "score double"])
    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(trimmed(run), schema)


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, as they are, whose text scores below the threshold."""
    model, at, names = fit(docs, labels), docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at, PIECE, 512):
            if model is not None:
                batch = batch.filter(pa.array(model.text_scores([t or "" for t in batch.column(at).to_pylist()]) < threshold))
            yield pa.RecordBatch.from_arrays(batch.columns, names=names)
        if model is not None:
            model.now, model.old = {}, {}

    return docs.mapInArrow(trimmed(run), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``."""
    scored = score_documents(docs, fit(docs, labels), ["doc_id"])
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
