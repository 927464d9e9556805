"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from tests.llm.conftest import ODD


def ids(rows):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)


ALL = sorted((r[0] is None, r[0] or 0) for r in ODD)


def test_sharding(odd, none):
    from fieldloom.llm.sharding import shard_documents

    rows = shard_documents(odd, 4).collect()
    assert ids(rows) == ALL
    by_text = {r[0]: r[1] for r in ODD}
    for r in rows:
        text = by_text[r["doc_id"]]
        assert r["size"] == len((text or "").encode()) + 1
        assert r["text_crc32"] == (None if text is None else zlib.crc32(text.encode()))
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert len({r["shard"] for r in rows if r["doc_id"] in (5, 6)}) == 1  # equal texts
    assert shard_documents(none, 4).count() == 0


def test_mixing(odd, none):
    from fieldloom.llm.mixing import mix_documents, mix_plan

    rows = mix_plan(odd).collect()
    assert ids(rows) == ALL
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    out = mix_documents(odd)
    assert out.columns == odd.columns
    taken = sum(r["taken"] for r in rows)
    assert sum(len(r["text"].split()) for r in out.collect()) == taken
    assert mix_plan(none).count() == 0 and mix_documents(none).count() == 0


def test_line_dedup(odd, none):
    from fieldloom.llm.line_dedup import dedup_documents, line_decisions

    out = {(r["doc_id"], r["text"]) for r in dedup_documents(odd).collect()}
    assert len(dedup_documents(odd).collect()) == len(ODD)
    # The changed line of 2 goes, its blank line stays; both copies of 1 keep their lines; 6 repeats 5.
    assert (2, "\nother words altogether in this one") in out
    assert (1, ODD[0][1]) in out and (6, "") in out and (3, None) in out
    assert dedup_documents(odd).columns == odd.columns
    assert line_decisions(none).count() == 0 and dedup_documents(none).count() == 0


def test_simhash(odd, none):
    from fieldloom.llm.simhash import near_duplicates, one_of_each, similar_documents

    rows = near_duplicates(odd, 3).collect()
    assert ids(rows) == ALL
    of = {r["doc_id"]: r for r in rows}
    assert of[3]["fingerprint"] == of[4]["fingerprint"] == of[7]["fingerprint"] == "0" * 16
    assert of[7]["component_id"] == 3 and of[6]["component_id"] == 5
    assert near_duplicates(none).count() == 0 and similar_documents(none).count() == 0 and one_of_each(none).count() == 0
    kept = one_of_each(odd)
    assert kept.columns == odd.columns
    left = [r["doc_id"] for r in kept.collect()]
    assert left.count(1) == 1 and 6 not in left and 4 not in left and 5 in left and None in left


@pytest.mark.parametrize("module", ["toxicity", "line_quality"])
def test_classifiers(odd, none, labels, module):
    import importlib

    m = importlib.import_module(f"fieldloom.llm.{module}")
    run = m.toxicity if module == "toxicity" else m.quality
    rows = run(odd, labels).collect()
    assert ids(rows) == ALL and all(0 <= r["score"] <= 1 for r in rows)
    assert run(none, labels).count() == 0
    assert all(r["score"] == 0 for r in run(odd, labels.limit(0)).collect())
    if module == "toxicity":
        assert m.clean_documents(odd, labels.limit(0)).count() == len(ODD)
        assert m.clean_documents(odd, labels).columns == odd.columns


def test_language_model(odd, none):
    from fieldloom.llm.language_model import score_documents

    rows = score_documents(odd).collect()
    assert ids(rows) == ALL
    by_text = {r[0]: r[1] for r in ODD}
    for r in rows:
        assert r["n_tokens"] == len((by_text[r["doc_id"]] or "").encode().split()) + 1
        assert r["score"] < 0 and r["base_score"] < 0
    assert score_documents(none).count() == 0


def test_quality_rules(odd, none, labels):
    from fieldloom.llm.quality_rules import judge

    rows = {r["doc_id"]: r for r in judge(odd, labels).collect()}
    assert rows[3]["n_words"] == 0 and rows[3]["base_failed"] and not rows[3]["kept"]
    assert rows[5]["n_repeat_words"] == rows[5]["n_words"] == 12000 and rows[5]["base_failed"]
    assert judge(odd, labels).count() == len(ODD) and judge(none, labels).count() == 0


def test_bpe(odd, none):
    import public_tokenizers as p

    from fieldloom.llm.bpe import decode_documents, encode_documents

    where = p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN
    rows = encode_documents(odd, *where, digests=True).collect()
    assert ids(rows) == ALL
    by_text = {r[0]: r[1] or "" for r in ODD}
    assert all(r["decoded_sha256"] == hashlib.sha256(by_text[r["doc_id"]].encode()).hexdigest() and len(r["ids"]) == r["n_tokens"] for r in rows)
    back = {r["doc_id"]: r["text"] for r in decode_documents(encode_documents(odd.select("doc_id", "text"), *where), *where).collect()}
    assert back == by_text
    assert encode_documents(none, *where).count() == 0


def test_embeddings(spark):
    from fieldloom.llm.embedding_join import near_duplicates

    inf, nan = float("inf"), float("nan")
    data = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.99, 0.1]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (10, [0.0, 1.0]), (10, [0.0, 1.0]), (11, [1.0]), (12, [1e-30, 0.0]), (13, [-1.0, -0.0])]
    rows = near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "1 as x", "2L as h1", "3 as weight")).collect()
    links = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows}
    assert len(rows) == len(data)
    assert {x for x in links if x[0] in (1, 2, 3, 11, 12)} == {(1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (11, 4, 1, False), (12, 4, 1, False)}
    assert {x for x in links if x[0] in (4, 5, 6, 7, 8, 9, 13)} == {(k, 0, k, True) for k in (4, 5, 6, 7, 8, 9, 13)}
    assert (10, 1, 10, True) in links
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
