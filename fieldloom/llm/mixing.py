"""Operator 3: a mix of sources by capped water-filling, with seeded whole and fractional repetitions.

Every source asks for a share of all words by its weight. A source that would be repeated more
than ``max_epochs`` times is clamped there and its excess is dealt to the rest in proportion to their
weights, until no target is above its cap. A source's documents are then taken a whole number of
times, and, for the fraction that is left, once more in the order of a seeded hash until the target is
met; the document on the boundary gives only its first words,
joined by spaces.

Weights: the sources in code point order, null last, weigh ``weights`` in turn. Edge cases: null or empty
texts have no words and are taken 0 words; a source without words has target 0; repeated rows count
each; no rows give no rows; further columns of the input are ignored (``mix_documents`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm._common import checkpointed, free_name, words

#: Rows of a source that are put in order together, about.
CELL_ROWS = 20_000


def water_level(sources: DataFrame, max_epochs: int) -> float:
    """The level: a source's target is the lesser of level x weight and its cap.

    ``sources(source_size, weight)`` stays distributed; each round brings one row of sums."""
    cap = F.col("source_size") * max_epochs
    level = 0.0
    for _ in range(10_000):
        full = cap <= F.col("weight") * F.lit(level)
        r = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, cap).otherwise(0)).alias("capped"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not r["all"] or not r["open"]:
            return level
        higher = (r["all"] - r["capped"]) / r["open"]
        if higher <= level:
            return level
        level = higher
    raise RuntimeError("water-filling did not settle")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix-1") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` (and the document's key) for every row of ``docs``."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = checkpointed(
        docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), order.alias("u"), F.xxhash64("text").alias("text_key"))
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row per source
    turn = F.array(*[F.lit(float(w)) for w in weights])
    sources = checkpointed(per_source.select("*", F.element_at(turn, (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")).alias("weight")))
    level = water_level(sources, max_epochs)
    target = F.least(F.col("source_size") * F.lit(float(max_epochs)), F.col("weight") * F.lit(level))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = sources.select("source", "source_size", target.alias("target")).select(
        "*", F.least(whole, F.lit(max_epochs)).alias("whole")
    ).select("*", F.greatest(F.lit(0), F.round(F.col("target") - F.col("whole") * F.col("source_size"))).cast("long").alias("need"))
    # Cells by the leading hex digits of the order: enough for cells of about CELL_ROWS rows of a source at most.
    digits = max(1, min(8, len(f"{max(1, sized.count() // CELL_ROWS):x}")))
    celled = sized.select("*", F.substring("u", 1, digits).alias("cell"))
    cells = celled.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    ahead = F.sum("words").over(Window.partitionBy("source").orderBy("cell")) - F.col("words")
    cells = (
        cells.select("source", "cell", ahead.alias("before"))
        .join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .select(F.col("source").alias("s"), F.col("cell").alias("c"), "before", "source_size", "target", "whole", "need")
    )
    inside = Window.partitionBy("source", "cell").orderBy("u", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    part: Column = F.least(F.greatest(F.col("need") - F.col("before") - F.col("ahead"), F.lit(0)), F.col("size"))
    return (
        celled.select("*", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("ahead"))
        .join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
        .select("doc_id", "text_key", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).alias("taken"))
    )


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows that the plan gives, repeated: the columns of ``docs``, with ``text`` cut in a last, partial repetition.

    Documents that the mix doesn't take are left out. ``n_chars`` follows the text where it is there."""
    key, place, took = (free_name(n, docs) for n in ("text_key", "place", "took"))
    # Rows that repeat doc_id and text are told apart by a number; which of them is taken how often makes no difference.
    plan = mix_plan(docs, **how)
    nth = lambda text_key: F.row_number().over(Window.partitionBy("doc_id", text_key).orderBy(text_key))
    plan = plan.select("doc_id", "text_key", nth("text_key").alias("nth"), F.struct("size", "taken").alias("took")).where("took.taken > 0")
    plan = plan.select(F.struct("doc_id", "text_key", "nth").alias("p"), F.col("took").alias("t"))
    left = docs.select(F.struct(*docs.columns).alias("d"), F.xxhash64("text").alias(key), "doc_id")
    left = left.select("d", F.struct("doc_id", key, nth(key).alias(place)).alias("q"))
    same = F.col("q.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col(f"q.{key}") == F.col("p.text_key")) & (F.col(f"q.{place}") == F.col("p.nth"))
    joined = left.join(plan, same).select("d", F.col("t").alias(took))
    size, taken = F.col(f"{took}.size"), F.col(f"{took}.taken")
    full, rest = F.floor(taken / size).cast("int"), F.pmod(taken, size).cast("int")
    repeats = F.when(full > 0, F.array_repeat(F.lit(-1), full)).otherwise(F.array().cast("array<int>"))
    rows = joined.select("d", F.explode(F.concat(repeats, F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))).alias("n"))
    text = F.col("d.text")
    cut = F.when(F.col("n") < 0, text).otherwise(F.array_join(F.slice(words(text), 1, F.greatest(F.col("n"), F.lit(0))), " "))
    kept = [cut.alias("text") if c == "text" else F.char_length(cut).cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col("d")[c].alias(c) for c in docs.columns]
    return rows.select(*kept)
