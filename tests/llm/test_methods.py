"""The operators' inner workings against enumeration, and each stage's effect."""

from __future__ import annotations

import subprocess
import sys
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from tests.llm.conftest import ODD


def subsequences(word, decay):
    out = defaultdict(float)
    for at in combinations(range(len(word)), 3):
        out["".join(word[i] for i in at)] += decay ** (at[-1] - at[0] + 1)
    return out


def test_kernel_is_that_of_all_subsequences():
    from fieldloom.llm import toxicity as t

    words, marks = ["idiot", "idxiot", "abcab", "zzz", "toidi", "é日abc", "ab"], ["idiot", "abcabc", "idea"]
    alphabet = np.array(sorted({ord(c) for m in marks for c in m}), dtype=np.uint32)
    rows, table = t.landmark_table(marks, alphabet)
    got = t.subsequence_scores(words, alphabet, rows, table)
    dot = lambda a, b: sum(v * b[k] for k, v in a.items() if k in b)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            a, b = subsequences(w, t.DECAY), subsequences(m, t.DECAY)
            want = dot(a, b) / np.sqrt(dot(a, a) * dot(b, b)) if a else 0.0
            assert got[i, j] == pytest.approx(want, abs=1e-9), (w, m)
    assert got[0, 0] == pytest.approx(1) and got[1, 0] > got[2, 0]


def test_toxicity_does_not_depend_on_the_hash_seed():
    code = """
from fieldloom.llm.toxicity import train
bad = ["you %s fool %s" % (a, b) for a in ("grumbol", "plimsok") for b in ("one", "two", "three", "four")]
good = ["the %s house %s" % (a, b) for a in ("grumble", "plinth", "garden", "river") for b in ("one", "two", "three", "four")]
m = train(bad + good, [1] * len(bad) + [0] * len(good))
print([round(float(x), 12) for x in m.text_scores(bad + good + ["grumxbol"])])
"""
    outs = {subprocess.run([sys.executable, "-c", code], env={"PYTHONHASHSEED": s, "PATH": "/usr/bin:/bin", "PYTHONPATH": ":".join(p for p in sys.path if p)}, capture_output=True, text=True, check=True).stdout for s in "0123"}
    assert len(outs) == 1


def test_labelled_texts_are_bounded(spark):
    from fieldloom.llm.toxicity import labelled_texts

    docs = spark.createDataFrame([(k % 40, f"text {k} " + "x" * (k % 40) * 10) for k in range(400)] + [(None, "z"), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(3, 1), (None, 1)], "doc_id long, toxic int")
    texts, y = labelled_texts(docs, labels, "toxic", {1: 8, 0: 100})
    assert sum(y) <= 8 and len(texts) == len(set(texts)) <= 40
    few, _ = labelled_texts(docs, labels, "toxic", {1: 8, 0: 100}, 1000)
    assert 0 < len(few) < len(texts) and sum(map(len, few)) <= 1000


def test_leaves_have_all_the_probability():
    from fieldloom.llm import language_model as m

    rng = np.random.default_rng(0)
    sizes = m.Shape(2)
    weights = rng.normal(size=(sizes.rows(), m.BRANCH)).astype(np.float32)
    n = np.array([3, 1, 4])
    leaves = rng.integers(0, sizes.leaves, n.sum())
    for k in range(len(leaves)):
        # Each possible leaf at one place, in the same context.
        total = 0.0
        for leaf in range(sizes.leaves):
            tried = leaves.copy()
            tried[k] = leaf
            total += np.exp(m.log_chances(sizes, weights, m.contexts(sizes, tried, n), tried, slice(k, k + 1))[0])
        assert total == pytest.approx(1, abs=1e-5)
    # A step up the gradient makes what was seen likelier.
    w, s, u = np.zeros_like(weights), np.full(len(weights), 1.0), np.zeros(len(weights))
    seen, whole = m.contexts(sizes, leaves, n), slice(0, len(leaves))
    before = m.log_chances(sizes, w, seen, leaves, whole)
    assert before == pytest.approx(np.full(len(leaves), -np.log(sizes.leaves)))
    m.climb(sizes, w, s, u, seen, leaves, whole)
    assert m.log_chances(sizes, w, seen, leaves, whole).sum() > before.sum()


def test_words_by_place_in_the_text():
    from fieldloom.llm import language_model as m

    texts = ["One  two\nONE\tzwö ", "", None, "a", "x" * 50 + " one", " \n"]
    raw = [t and t.encode() for t in texts]
    h, tail, n = m.tokens(raw)
    want = [w for t in raw for w in [*(t or b"").lower().split(), None]]
    assert n.tolist() == [len((t or b"").split()) + 1 for t in raw] and len(h) == len(want)
    for i, a in enumerate(want):
        assert tail[i] == (int.from_bytes((b"\0\0\0" + a)[-4:], "little") if a else 10)
        for j, b in enumerate(want):
            assert (h[i] == h[j]) == (a == b)
    cut = m.PIECE
    try:
        m.PIECE = 16
        assert all((x == y).all() for x, y in zip(m.tokens(raw), (h, tail, n), strict=True))
    finally:
        m.PIECE = cut


def counts_frame(spark, rows):
    zero = dict.fromkeys(["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"], 0)
    return spark.createDataFrame([{"doc_id": k, "lang": lang, **zero, "n_words": 1000, "n_lines": 10, "word_chars": 4000, "n_symbols": s} for k, (lang, s) in enumerate(rows)], "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_marks long")


def test_cutoffs_keep_the_bound(spark):
    """A cutoff is taken where its false rejections are proved rare, and none where they aren't."""
    from fieldloom.llm import quality_rules as q

    # In "en" no clean text has more than 6 symbols in 1,000 words; in "de" a tenth of them has 600; "fr" has few labels.
    rows = [("en", k % 7) for k in range(5000)] + [("de", 600 if k % 10 == 0 else 0) for k in range(5000)] + [("fr", 0)] * 150
    labels = spark.createDataFrame([(k, 1) for k in range(len(rows))], "doc_id long, quality int")
    found = {(r["stratum"], r["rule"]): r["cutoff"] for r in q.safe_cutoffs(counts_frame(spark, rows), labels).collect()}
    assert found["en", "symbols"] == 0.01 and found["de", "symbols"] == 1.0
    assert not any(s == "fr" for s, _ in found)
    # By hand: 4,000 labels that a cutoff never rejects prove a rate below 5 % / 6, over at most 96 tests; 120 labels prove none.
    assert (1 - 0.05 / 6) ** 3900 <= 0.05 / 96 < (1 - 0.05 / 6) ** 150


def test_rules_reject_what_proved_cutoffs_say(spark):
    from fieldloom.llm import quality_rules as q

    text = " ".join(f"w{k} x{k}" for k in range(60))
    docs = spark.createDataFrame([(k, text + " end" * (k % 2), "en") for k in range(5000)] + [(5000, text + " # $ % # % & | < > *" * 6, "en"), (5001, None, "en"), (5002, text + " # $ % # % & | < > *" * 6, "xx")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(5000)], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in q.judge(docs, labels).where("doc_id >= 4990").collect()}
    assert not got[5000] and got[4990] and got[4999] and not got[5001] and got[5002]


NAMES = "__n __key __id __nth __m __doc __k __gone __lines __size __taken __hash d n of id nth took place gone lines holder text_key taken p q t".split()


@pytest.fixture(scope="module")
def clash(odd):
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(k).alias(n) for k, n in enumerate(NAMES) if n not in odd.columns])


def test_no_column_name_clashes(clash):
    from fieldloom.llm.bpe import encode_documents
    from fieldloom.llm.line_dedup import dedup_documents
    from fieldloom.llm.mixing import mix_documents
    from fieldloom.llm.simhash import one_of_each

    for run in (mix_documents, dedup_documents, one_of_each):
        out = run(clash)
        assert out.columns == clash.columns
        rows = out.collect()
        assert rows and all(r["__key"] == NAMES.index("__key") and r["t"] == NAMES.index("t") for r in rows)
    import public_tokenizers as p

    assert encode_documents(clash, p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN).count() == len(ODD)


def test_embeddings_without_ids(spark):
    from fieldloom.llm.embedding_join import near_duplicates

    data = [(None, [1.0, 0.0]), (5, [1.0, 0.01]), (None, [0.0, 1.0]), (1 << 60, [0.5, 0.5]), ((1 << 60) + 1, [0.5, 0.51])]
    rows = near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    got = sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["n_links"], r["component_id"] or 0, r["kept"]) for r in rows)
    assert got == sorted([((True, 0), 1, 5, False), ((False, 5), 1, 5, True), ((True, 0), 0, 0, True), ((False, 1 << 60), 1, 1 << 60, True), ((False, (1 << 60) + 1), 1, 1 << 60, False)])


@pytest.mark.parametrize("module", ["toxicity", "line_quality"])
def test_batches_are_cut_by_bytes(module):
    """Texts of 4 MB in all, in one batch, are read a megabyte at a time."""
    import pyarrow as pa

    from fieldloom.llm._common import sliced

    texts = ["word " * 50_000] * 16 + ["", None, "x" * 3_000_000]
    parts = list(sliced(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])]), 0, 1 << 20, 512))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(0).to_pylist()) <= 1 << 20 for p in parts)


def test_stages_take_effect(spark):
    """Each stage of the pipeline on texts of which it is known what should become of them."""
    import corpus_pipeline as c

    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijkl"), 6))
    body = [" ".join(word() for _ in range(60)) for _ in range(30)]
    insults = ["grumbolt", "plimsok"]
    rows = [(k, b, "en", f"s{k % 3}", len(b)) for k, b in enumerate(body)]
    rows += [(100 + k, " ".join([*b.split()[:30], insults[k % 2], *b.split()[30:]]), "en", "s0", 0) for k, b in enumerate([" ".join(word() for _ in range(40)) for _ in range(20)])]
    near = body[0].split()
    near[7] = "changed"
    rows += [(200, " ".join(near), "en", "s1", 1), (201, body[1], "en", "s1", 1), (202, "a line that is said once before\n" + body[2], "en", "s2", 1), (203, "a line that is said once before\nother " + word(), "en", "s2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], 1, int(100 <= r[0] < 120)) for r in rows], "doc_id long, quality int, toxic int")
    from fieldloom.llm.toxicity import clean_documents

    kept = {r["doc_id"] for r in clean_documents(docs, labels).collect()}
    assert kept == {r[0] for r in rows if not 100 <= r[0] < 120}
    clean = docs.where(~docs.doc_id.between(100, 119))
    lines = {r["doc_id"]: r["text"] for r in c.line_dedup(spark, clean, "").collect()}
    assert lines[202].startswith("a line") and lines[203].startswith("other ") and lines[201] == "" and len(lines) == 34
    alone = sorted(r["doc_id"] for r in c.near_dedup(spark, clean, "").collect())
    # One changed word leaves 51 of 61 shingles; seven more words at the beginning 56 of 63: both are 0.8 or more.
    assert alone == [*range(30), 203]
    mixed = c.mixing(spark, clean, "").collect()
    assert {r["source"] for r in mixed} == {"s0", "s1", "s2"} and len(mixed) > 34
    out = {r["doc_id"]: r for r in c.tokens(spark, docs, "").collect()}
    import public_tokenizers as p
    from fieldloom.llm.bpe import codec

    assert codec(p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN).decode([out[3]["ids"]]) == [body[3].encode()]


def test_few_links_settle_in_one_task_as_in_rounds(spark, monkeypatch):
    import random

    from fieldloom.llm import _common

    draw = random.Random(3)
    links = [(draw.randrange(300) - 150, draw.randrange(300) - 150) for _ in range(140)]
    links += [(10**10 + i, 10**10 + i + 1) for i in range(60)] + [(5, 5), (2**62, -(2**62)), (None, 3)]
    least = {}
    for a, b in links:
        if a is not None and a != b:
            x, y = least.setdefault(a, {a}), least.setdefault(b, {b})
            if x is not y:
                x |= y
                least.update(dict.fromkeys(y, x))
    want = {(n, min(c)) for n, c in least.items()}
    edges = spark.createDataFrame(links, "a long, b long")
    for most in (_common.TASK_LINKS, 0):
        monkeypatch.setattr(_common, "TASK_LINKS", most)
        got = [tuple(r) for r in _common.components(edges).collect()]
        assert len(got) == len(want) and set(got) == want
        assert _common.components(edges.where("a < a")).count() == 0


def test_checkpoints_keep_rows_and_leave_the_setting(spark):
    from fieldloom.llm import _common

    before = spark.conf.get(_common.CLEANUP, "false")
    counted = spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count()
    cut = _common.checkpointed(counted)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, counted.collect()))
    assert spark.conf.get(_common.CLEANUP, "false") == before


def test_pipeline_encodes_with_a_small_cache(monkeypatch):
    """Its executors' heap is full by then: a worker's cache holds 30 MB, and ends with its task."""
    import corpus_pipeline as c

    given = {}
    monkeypatch.setattr(c, "encode_documents", lambda *a, **k: given.update(k))
    c.tokens(None, None, "")
    assert given["cache"] <= 30_000_000 and given["lasting"] is False
