"""Operator 6: line de-duplication by a deletion-neighbourhood join.

Lines are compared by their normal form: lower case, white space runs as one space, trimmed. A line goes if
an earlier line (by doc_id, then position) has the same form, or, where both forms have ``min_chars``
characters at least, a form within one edit (a character inserted, deleted or replaced). Blank lines stay.

1.  Equal forms are met by two 64-bit hashes; each group keeps its earliest line.
2.  Two forms within one edit are equal but for one of any number of blocks that they are cut into (from the left
    before it, from the right behind it, by the shorter one's length). Halves tell which forms can have a
    neighbour at all; sixteenths of those tell where the edit can be.
3.  Forms that share such a block's surroundings emit their deletion neighbourhood there: the form itself and the
    form without its i-th character, as hashed keys (two rolling hashes modulo 2**64, so a long line costs as
    much as it is long). Within a key, forms that lack the same position differ by one replacement, and the
    form that is the key itself differs from the rest by one insertion: each needs to meet only the
    earliest of those. A key's minima say which line that is; no pairs within a key are made.
4.  The edit distance to the earliest neighbour found is verified by ``levenshtein``.

Edge cases: null and empty texts have one blank line; rows that repeat both doc_id and text are one document here, and get
equal decisions; null ids come first; no rows give no rows; further columns of the input are ignored
(``dedup_documents`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._common import bounded, checkpointed, stored

#: Forms with fewer characters are compared for equality only.
MIN_CHARS = 16
#: Blocks that tell where an edit can be.
PARTS = 16
#: Odd multipliers of the rolling hashes, and the seeds that mix the characters.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def normal_form(line: Column) -> Column:
    # Single spaces, the most common by far, are left alone.
    return F.lower(F.trim(F.regexp_replace(line, r" [\s ]+|[\t\x0B\f\r ][\s ]*", " ")))


def _mix(codes: np.ndarray, seed: int) -> np.ndarray:
    x = codes.astype(np.uint64) + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(form: str) -> list[np.ndarray]:
    """Two hashes of the form and, from position 1 on, of the form without its i-th character."""
    codes, out = np.frombuffer(form.encode("utf-32-le"), dtype=np.uint32), []
    n = len(codes)
    for base in _BASES:
        power = np.full(n, base, dtype=np.uint64)
        if n:
            power[0] = 1
        power = np.multiply.accumulate(power)
        until = np.concatenate([[np.uint64(0)], np.add.accumulate(_mix(codes, base & 0xFFFFFFFF) * power)])
        back = np.uint64(pow(base, -1, 1 << 64))
        # Without character i: what stands before it, and what follows moved by one place.
        out.append(np.concatenate([[until[n]], until[:n] + (until[n] - until[1:]) * back]).view(np.int64))
    return out


def blocks(length: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Begin and end of each block of a form of a length."""
    return [(length * j // parts, length * (j + 1) // parts) for j in range(parts)]


def block_keys(form: str) -> list[tuple[int, int, str, str]]:
    """``shorter, block, what stands before it, what stands behind it``, for the form's own length and one less."""
    n = len(form)
    return [(shorter, j, form[:lo], form[n - (n - shorter - hi) :] if n - shorter > hi else "") for shorter in (0, 1) for j, (lo, hi) in enumerate(blocks(n - shorter))]


def _long(*parts) -> int:
    h = xxhash.xxh64(seed=7)
    for p in parts:
        h.update(p if isinstance(p, bytes) else str(p).encode() + b"\0")
    return int(np.uint64(h.intdigest()).astype(np.int64))


def block_rows(forms: DataFrame) -> DataFrame:
    """``h1, h2, shorter, block, around``: a hash of what surrounds each block of ``forms(h1, h2, form)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                found = [block_keys(f) for f in part.column(2).to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                sizes = [len(f) for f in part.column(2).to_pylist()]
                hashes = [_long(n - k[0], k[1], k[2].encode() + b"\0", k[3].encode()) for n, f in zip(sizes, found, strict=True) for k in f]
                flat = [k for f in found for k in f]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array([k[0] for k in flat], pa.int32()), pa.array([k[1] for k in flat], pa.int32()), pa.array(hashes, pa.int64())],
                    names=["h1", "h2", "shorter", "block", "around"],
                )

    return forms.select("h1", "h2", "form").mapInArrow(run, "h1 long, h2 long, shorter int, block int, around long")


def deletion_neighbourhood(forms: DataFrame) -> DataFrame:
    """``place, h1, h2, k1, k2, position`` for ``forms(place, h1, h2, form, at)``; position 0 is the form itself.

    ``at`` are the blocks, as (shorter, block), in which a neighbour may differ."""

    def positions(n: int, at: list[dict]) -> np.ndarray:
        take = np.zeros(n + 1, dtype=bool)
        for b in at:
            lo, hi = blocks(n - b["shorter"])[b["block"]]
            take[1 + lo : 1 + hi + b["shorter"]] = True
            take[0] |= not b["shorter"]
        return np.flatnonzero(take)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = part.column(3).to_pylist()
                chosen = [positions(len(t), a) for t, a in zip(texts, part.column(4).to_pylist(), strict=True)]
                keys = [[k[c] for k in deletion_keys(t)] for t, c in zip(texts, chosen, strict=True)]
                if not keys:
                    continue
                rows = pa.array(np.repeat(np.arange(len(keys)), [len(c) for c in chosen]))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k).take(rows) for k in range(3)), *(pa.array(np.concatenate([k[j] for k in keys])) for j in (0, 1)), pa.array(np.concatenate(chosen))],
                    names=["place", "h1", "h2", "k1", "k2", "position"],
                )

    place = "place struct<doc:long,key:long,line:long>"
    return forms.select("place", "h1", "h2", "form", "at").mapInArrow(run, f"{place}, h1 long, h2 long, k1 long, k2 long, position long")


def _lines(docs: DataFrame) -> DataFrame:
    """``first(doc, key, line), form, h1, h2`` for every line that isn't blank."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("key"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "raw")
    )
    rows = rows.select(F.struct("doc", "key", F.col("line").cast("long").alias("line")).alias("place"), normal_form(F.col("raw")).alias("form")).where("form <> ''")
    return rows.select("place", "form", F.xxhash64("form").alias("h1"), F.xxhash64(F.lit("line"), "form").alias("h2"))


def _halves(form: Column) -> Column:
    """Keys under which the form meets every form within one edit: both halves, for its own length and one less."""
    keys = []
    for length in (F.char_length(form), F.char_length(form) - 1):
        head = F.floor(length / 2).cast("int")
        keys += [F.xxhash64(length, F.lit("head"), form.substr(F.lit(1), head)), F.xxhash64(length, F.lit("tail"), F.right(form, (length - head)))]
    return F.array(*keys)


def line_decisions(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc, key, line, kept, first_doc, first_line`` for every line of ``docs(doc_id, text)`` that isn't blank.

    ``first_*`` is the earliest line that the line repeats (its own place if it is kept)."""
    scan = _lines(docs)
    narrow = stored(scan.select("place", "h1", "h2", F.when(F.char_length("form") >= min_chars, _halves(F.col("form"))).alias("halves")))
    filed = narrow.where("halves is not null").select("h1", "h2", F.explode("halves").alias("half"))
    meets = checkpointed(filed.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("half"))
    chosen = filed.join(bounded(meets, meets.count()), "half", "left_semi").select("h1", "h2").distinct()
    groups = stored(narrow.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.count("*").alias("n")))
    chosen = checkpointed(chosen.join(groups.select("h1", "h2", "place"), ["h1", "h2"]))
    n = chosen.count()
    # Texts of the chosen forms, from the documents that hold their earliest lines.
    holders = chosen.select(F.col("place.key").alias("holder")).distinct()
    of = _lines(docs.select("doc_id", "text", F.xxhash64("text").alias("holder")).join(bounded(holders, n), "holder", "left_semi"))
    forms = checkpointed(of.join(bounded(chosen, n), ["place", "h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]).select("place", "h1", "h2", "form"))
    around = checkpointed(block_rows(forms))
    shared = around.groupBy("around").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("around")
    where = around.join(shared, "around", "left_semi").groupBy("h1", "h2").agg(F.collect_set(F.struct("shorter", "block")).alias("at"))  # 2 x PARTS at most
    keys = checkpointed(deletion_neighbourhood(forms.join(where, ["h1", "h2"])))
    # Earliest form per key and position; position 0 is the form that is the key.
    per = keys.groupBy("k1", "k2", "position").agg(F.min(F.struct("place", "h1", "h2")).alias("least"))
    whole = per.groupBy("k1", "k2").agg(
        F.min(F.when(F.col("position") == 0, F.col("least"))).alias("itself"), F.min(F.when(F.col("position") > 0, F.col("least"))).alias("shorter")
    )
    met = keys.join(whole, ["k1", "k2"]).join(per, ["k1", "k2", "position"])
    near = met.select(
        "h1", "h2", "place",
        F.explode(F.array("least", F.when(F.col("position") == 0, F.col("shorter")).otherwise(F.col("itself")))).alias("o"),
    ).where("o.place < place").groupBy("h1", "h2").agg(F.min("o").alias("o"))
    other = forms.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("form").alias("o_form"))
    verified = (
        near.select("h1", "h2", F.col("o.h1").alias("o1"), F.col("o.h2").alias("o2"), F.col("o.place").alias("near"))
        .join(forms.select("h1", "h2", "form"), ["h1", "h2"]).join(other, ["o1", "o2"])
        .where(F.levenshtein("form", "o_form", 1) >= 0).select("h1", "h2", "near")
    )
    verified = checkpointed(verified)
    # Only groups with more than one line, or with a neighbour, decide anything.
    verdict = checkpointed(
        groups.join(bounded(verified, verified.count()), ["h1", "h2"], "left").where("n > 1 or near is not null").select("h1", "h2", F.col("place").alias("first"), "near")
    )
    place = F.col("place")
    first = F.coalesce(F.least("first", "near"), "first", "place")
    return (
        narrow.select("place", "h1", "h2").join(bounded(verdict, verdict.count()), ["h1", "h2"], "left")
        .select("place", first.alias("first"), ((place == F.coalesce("first", "place")) & F.col("near").isNull()).alias("kept"))
        .select("place.doc", "place.key", "place.line", "kept", F.col("first.doc").alias("first_doc"), F.col("first.line").alias("first_line"))
    )


def dedup_documents(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text`` (and ``n_chars`` following it); no document goes."""
    gone = checkpointed(
        line_decisions(docs, min_chars).where("not kept").distinct()
        .groupBy(F.struct("doc", "key").alias("of")).agg(F.collect_set(F.col("line").cast("int")).alias("gone"))
    )
    left = docs.select(F.struct(*docs.columns).alias("d"))
    joined = left.join(bounded(gone, gone.count() * 4), F.col("d.doc_id").eqNullSafe(F.col("of.doc")) & (F.xxhash64("d.text") == F.col("of.key")), "left")
    joined = joined.select("d", "gone", F.when(F.col("gone").isNotNull(), F.split("d.text", "\n", -1)).alias("lines"))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), '\n')")
    text = F.when(F.col("gone").isNull(), F.col("d.text")).otherwise(kept)
    return joined.select(*[text.alias(c) if c == "text" else F.coalesce(F.char_length(text), F.lit(0)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("d")[c].alias(c) for c in docs.columns])
