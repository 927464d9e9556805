"""Operators against brute force, other libraries and held-out labels."""

from __future__ import annotations

import base64
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

SMALL = "/root/testdata/sf0.01"


def texts(n, seed, words=8):
    rng = random.Random(seed)
    return [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(rng.randint(0, words))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string")


def least_capacity(sizes, n):
    def fits(c):
        shards, held = 1, 0
        for s in sizes:
            if s > c:
                return False
            if held + s > c:
                shards, held = shards + 1, 0
            held += s
        return shards <= n

    low, high = 1, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("bits", [2, 12])
def test_cuts_are_minimax(spark, monkeypatch, bits):
    from fieldloom.llm import sharding

    monkeypatch.setattr(sharding, "FIRST_BITS", bits)
    monkeypatch.setattr(sharding, "MAX_RANGES", 32)
    rng = random.Random(bits)
    rows = [(rng.getrandbits(64) - (1 << 63), rng.choice([1, 3, 10, 200])) for _ in range(300)]
    cuts, capacity = sharding.minimax_cuts(spark.createDataFrame(rows, "key long, bytes long"), 7)
    ordered = sorted(rows)
    assert capacity == least_capacity([b for _, b in ordered], 7) and len(cuts) <= 6
    shard = Counter()
    for key, size in ordered:
        shard[sum(key >= c for c in cuts)] += size
    assert max(shard.values()) <= capacity


def test_fingerprint_bits():
    import xxhash

    from fieldloom.llm.simhash import text_fingerprint

    for t in ["A b C d é", "one two", "x", "", " \t", "a b c a b c a b c"]:
        w = t.encode().lower().split()
        parts = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        assert text_fingerprint(t.encode()) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("direct", [2, 24])
def test_links_have_the_components_of_all_pairs(spark, monkeypatch, direct):
    from fieldloom.llm import simhash
    from fieldloom.llm._common import components

    monkeypatch.setattr(simhash, "DIRECT", direct)
    rng = random.Random(direct)
    fps = set()
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(12):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    found = {r["node"]: r["component"] for r in components(simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()}
    root = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3 and root[b] < root[a]:
                    root[a], changed = root[b], True
    assert {f: found.get(f, f) for f in fps} == root


def test_similar_documents_go_by_fingerprints(spark, monkeypatch):
    """Near copies meet by their fingerprints, of one bit pattern or within three bits, and whole sets verify what met."""
    from fieldloom.llm import simhash

    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = ["", "one two"]
    for _ in range(20):
        base = [word() for _ in range(600)]
        texts += [" ".join(base), " ".join([word(), *base[1:]]), " ".join(base).upper()]
    of = [simhash._majority(simhash.shingle_set(t.encode()).view(np.uint64)) for t in texts]
    seen, links = [], simhash.fingerprint_links
    monkeypatch.setattr(simhash, "fingerprint_links", lambda d: seen.append((d.collect(), links(d).collect())) or links(d))
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(frame(spark, texts)).collect()}
    assert len(seen) == 1 and {r["fp"] & (1 << 64) - 1 for r in seen[0][0]} == set(of)
    near = {frozenset((a, b)) for a in of for b in of if a != b and (a ^ b).bit_count() <= 3}
    assert near and {frozenset((r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1)) for r in seen[0][1]} == near
    assert found == {k: k if k < 2 else k - (k - 2) % 3 for k in range(len(texts))}


@pytest.mark.parametrize("known", [0, 100_000])
def test_similar_documents_are_all_pairs_at_the_threshold(spark, monkeypatch, known):
    from fieldloom.llm import simhash

    monkeypatch.setattr(simhash, "ORDER_LAST", known)
    if not known:  # all turns, with one text of a group in each
        monkeypatch.setattr(simhash, "PAIRS_PER_ROW", -1)
        monkeypatch.setattr(simhash, "HUBS", 1)
    rng = random.Random(known)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    texts = ["", None, "one two", "One  two", "one two three four five"]
    for k in range(30):
        base = passage * (k % 2) + [word() for _ in range(rng.choice([20, 100, 400]))]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w[: len(w) - rng.randint(0, len(w) // 6)]))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root, close = list(range(len(texts))), 0
    edges = []
    for a in range(len(texts)):
        for b in range(a):
            o, u = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if 5 * o >= 4 * u:
                edges.append((a, b))
                close += 100 * o < 85 * u
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            least = min(root[a], root[b])
            changed |= root[a] != root[b]
            root[a] = root[b] = least
    found = simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert close > 10 and {r["doc_id"]: r["component_id"] for r in found.collect()} == dict(enumerate(root))


def edits(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_lines_within_one_edit(spark):
    from fieldloom.llm.line_dedup import line_decisions

    rng = random.Random(4)
    bases = ["the quick brown fox jumps", "aaaaaaaaaaaaaaaaaaaaaaaa", "pack my box with five dözen"]
    lines = []
    for _ in range(120):
        s = list(rng.choice(bases))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(s))
            s[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "a", "é", "ab"])
        lines.append("".join(s))
    docs = ["\n".join(lines[k : k + 4]) for k in range(0, 120, 4)]
    seen, want = [], {}
    for i, t in enumerate(docs):
        for j, x in enumerate(t.split("\n")):
            f = " ".join(x.split()).lower()
            first = next((p for p, g in seen if f == g or min(len(f), len(g)) >= 16 and edits(f, g) <= 1), None)
            want[i, j] = (first is None, first or (i, j))
            seen.append(((i, j), f))
    found = {(r["doc"], r["line"]): (r["kept"], (r["first_doc"], r["first_line"])) for r in line_decisions(frame(spark, docs)).collect()}
    assert found == want


def test_embedding_links(spark):
    from fieldloom.llm import embedding_join

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    x = np.concatenate([c + rng.normal(scale=0.25, size=(20, 8)) for c in centres] + [rng.normal(size=(60, 8))]).astype(np.float32)
    x[5] = x[6] = x[40]
    embedding_join.PER_PIVOT, embedding_join.HOME, embedding_join.OTHERS, before = 40, 16, 64, (embedding_join.PER_PIVOT, embedding_join.HOME, embedding_join.OTHERS)
    try:
        rows = embedding_join.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    finally:
        embedding_join.PER_PIVOT, embedding_join.HOME, embedding_join.OTHERS = before
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.array([min([root[k], *root[near[k]]]) for k in range(len(x))])
    for r in rows:
        assert (r["n_links"], r["component_id"]) == (near[r["vec_id"]].sum(), root[r["vec_id"]])


def test_embedding_links_of_proportional_vectors(spark, monkeypatch):
    from fieldloom.llm import embedding_join

    rng = np.random.default_rng(3)
    one = rng.normal(size=8)
    noisy = one + rng.normal(scale=0.12, size=(120, 8))
    x = np.concatenate([one * rng.uniform(0.1, 9, size=(120, 1)), noisy])
    for name, value in (("PER_PIVOT", 16), ("HOME", 16), ("OTHERS", 64)):
        monkeypatch.setattr(embedding_join, name, value)
    rows = embedding_join.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert {r["vec_id"]: r["n_links"] for r in rows} == dict(enumerate(near.sum(axis=1)))


def test_embedding_rounds_bound_what_is_shuffled(spark, monkeypatch):
    """Vectors near every plane are guests of all cells; still no stage writes more than twice as many as there are, and no link is lost."""
    from fieldloom.llm import embedding_join

    x = np.random.default_rng(4).normal(size=(600, 24))
    x[300:340] = x[:40] + np.random.default_rng(5).normal(scale=0.2, size=(40, 24))
    for name, value in (("PER_PIVOT", 40), ("HOME", 32), ("OTHERS", 64), ("ROUND", 0)):
        monkeypatch.setattr(embedding_join, name, value, raising=False)
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def written():
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}

    before = written()
    rows = embedding_join.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert max(n for k, n in written().items() if k not in before) <= 2 * len(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert near.sum() >= 60 and {r["vec_id"]: r["n_links"] for r in rows} == dict(enumerate(near.sum(axis=1)))


def test_tokens_as_tiktoken():
    import public_tokenizers as p
    import tiktoken

    from fieldloom.llm.bpe import Codec

    where = p.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(where, "rb"))}
    library, own = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={}), Codec(where, p.PATTERN)
    rng = random.Random(3)
    odd = ["", " ", "  a  b ", "it's 'VE don't", "x" * 700, "ab" * 200, "<|endoftext|>", "日本語😀" * 90, "\n\n \t a\r\n", "1234567 8", "a\x00b\x0bc"]
    odd += ["".join(rng.choice("ab'st \n\t!.,12é日😀") for _ in range(rng.randint(1, 200))) for _ in range(100)]
    spaces = [chr(c) for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 0x1680, 0x2003, 0x2028, 0x202F, 0x205F, 0x3000, 0x200B, 0x180E)]
    odd += [f"a{x}b, {x}c{y}d {y}{x}\ne{x}" for x in spaces for y in spaces] + ["a" + x for x in spaces] + [x + "a\nb" for x in spaces] + ["ab\n", "\nab", "a\n\nb c", "é x²³ ª ǅ 'll don't ''s"]
    for _ in range(2):  # encoded anew, and from the cache
        for t, (ids, back) in zip(odd, own.run(odd), strict=True):
            assert ids == ",".join(map(str, library.encode_ordinary(t))) and back == t.encode()
    assert own.decode([library.encode_ordinary(t) for t in odd]) == [t.encode() for t in odd]


def test_token_cache_is_bounded_by_bytes():
    import public_tokenizers as p

    from fieldloom.llm.bpe import Codec

    own = Codec(p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN)
    own.cache = 400_000
    rng = random.Random(5)
    for k in range(6):
        # Double spaces, long stretches without any, and ever new words.
        texts = [" ".join(rng.choice("abcdefgh") * 2 + str(rng.random()) for _ in range(200)).replace(" ", "  " if k % 2 else " ", 1), f"{k}" * 5000]
        assert [back for _, back in own.run(texts)] == [t.encode() for t in texts]
        size = sum(map(len, (*own.ids, *own.back, *own.old[2], *own.old[3])))
        assert size < 400_000 and max(map(len, [*own.spaced, *own.bare, ""])) <= 128


def test_text_counts(spark):
    import re

    from fieldloom.llm.quality_rules import text_counts

    rows = [*texts(60, 1, 40), "a b c a b c a", "x\n x\nx\n\n\ny\nx", "#*$ %&|<> a b", "", None, "a a a a"]
    for r in text_counts(frame(spark, rows), ["doc_id"]).collect():
        t = rows[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {k + i for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for i in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)), t


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    from fieldloom.llm.quality_rules import binomial_tail

    cases = [(0, 10, 0.1), (3, 50, 0.05), (20, 1000, 0.01), (0, 100000, 0.01), (7, 7, 0.5)]
    for k, n, p in cases:
        found = spark.range(1).select(binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert found == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)


def labelled(column):
    import pandas as pd

    d = pd.read_parquet(f"{SMALL}/documents.parquet").merge(pd.read_parquet(f"{SMALL}/labels.parquet"), on="doc_id")
    held = d.doc_id.map(lambda k: zlib.crc32(str(k).encode()) % 5 == 0)
    return (d[~held].text.tolist(), d[~held][column].tolist()), (d[held].text.tolist(), d[held][column].to_numpy())


def test_toxicity_held_out():
    from fieldloom.llm.toxicity import train

    (learn, y), (rest, want) = labelled("toxic")
    model = train(learn, y)
    got = model.text_scores(rest) >= 0.5
    assert (got == want).mean() >= 0.9 and got[want == 0].mean() <= 0.03
    one = lambda w: model.text_scores([f"the {w} of it"])[0]
    assert min(one("idiot"), one("i.d.i.o.t"), one("i d i o t")) > 0.5 > one("theory")


def test_quality_held_out():
    from fieldloom.llm.line_quality import train

    (learn, y), (rest, want) = labelled("quality")
    chain = train([t.encode() for t in learn], y)
    got = chain.score([t.encode() for t in rest]) >= 0.3
    assert (got == want).mean() >= 0.95 and got[want == 1].mean() >= 0.98


def test_chain_marginals():
    """Forward and backward sums against all label sequences."""
    from itertools import product

    from fieldloom.llm.line_quality import WIDTH, Chain, line_features

    rng, chain = np.random.default_rng(1), Chain()
    for p in chain.parameters():
        p[...] = rng.normal(size=p.shape) * 0.5
    bins, _, n = line_features([b"One line.\nTWO!! LINES!!\nthree three three\n\nlast"])
    p, _, _ = chain.marginals(bins, n)
    none = np.full((1, bins.shape[1]), WIDTH)
    left, right = np.concatenate([none, bins[:-1]]), np.concatenate([bins[1:], none])
    good = chain.own[bins].sum(1) + chain.left[left].sum(1) + chain.right[right].sum(1)
    total = np.zeros(len(bins))
    mass = 0.0
    for y in product((0, 1), repeat=len(bins)):
        w = math.exp(sum(g for g, v in zip(good, y, strict=True) if v) + sum(chain.pairs[a, b] for a, b in zip(y, y[1:], strict=False)))
        mass += w
        total += w * np.array(y)
    assert p == pytest.approx(total / mass)


def test_language_model_knows_its_language(spark):
    from fieldloom.llm.language_model import score_documents

    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = score_documents(df.select("doc_id", "text")).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2}
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    c = Counter()
    by_id = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b"\n"] for r in df.collect()}
    for k, w in by_id.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            c.update(w)
    n, v = sum(c.values()), len(c)
    for r in rows:
        w = by_id[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in c for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    out = corpus_pipeline.run(spark, SMALL).collect()
    known = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert out and {r["doc_id"] for r in out} <= known and all(r["n_tokens"] == len(r["ids"]) for r in out)
