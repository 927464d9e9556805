"""Operator 9: quality rules whose cutoffs are risk-controlled, native DataFrame code only.

Each rule rejects a text whose ratio lies above a cutoff. For every stratum (language), rule and cutoff of
a fixed grid the clean texts of the labelled holdout that the cutoff would reject are counted, and the
exact binomial tail ``P(X <= k | n, risk / rules)`` tells whether a false-rejection rate as high as the allowed
one is refuted. With Bonferroni's correction over all strata, rules and cutoffs, and the risk split evenly
among the rules, all chosen cutoffs hold together: with probability ``1 - delta`` no stratum loses more
than ``risk`` of its clean texts. The most rejecting cutoff that is proved safe is taken; a rule without a proved
cutoff in a stratum rejects nothing there (few labels, an unknown language).

Edge cases: a null text has no words; an empty table gives no rows; null or unseen languages form strata of
their own; repeated rows are judged each; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._common import bounded, checkpointed, fold, words

#: Ratios that the rules bound from above, as SQL over the counts.
RULES = {
    "word_length": "try_divide(word_chars, n_words)",
    "symbols": "try_divide(n_symbols, n_words)",
    "duplicate_lines": "try_divide(n_dup_lines, n_lines)",
    "repeated_words": "try_divide(n_repeat_words, n_words)",
    "upper_case": "try_divide(n_upper, word_chars)",
    "marks": "try_divide(n_marks, n_words)",
}
#: The cutoffs tried for each rule, from strict to lax.
CUTOFFS = {
    "word_length": [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0],
    "symbols": [0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0],
    "duplicate_lines": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9],
    "repeated_words": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5],
    "upper_case": [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.8],
    "marks": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 2.0],
}
#: Strata that get cutoffs of their own must have this many clean labelled texts; fewer could prove nothing.
LEAST_CLEAN = 100


def text_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the counts of every text."""
    w = docs.select(*keep, F.coalesce("text", F.lit("")).alias("t")).select("*", words(F.col("t")).alias("w"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    chars = lambda kind: F.char_length(F.regexp_replace("t", f"[^{kind}]+", "")).cast("long")
    n = F.size("w")
    hashed = F.when(n > 2, F.expr("zip_with(zip_with(slice(w, 1, size(w) - 2), slice(w, 2, size(w) - 2), (a, b) -> xxhash64(a, b)), slice(w, 3, size(w) - 2), (h, c) -> xxhash64(h, c))"))
    w = w.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        chars(r"#*$%&|<>").alias("n_symbols"),
        chars(r"\p{Lu}").alias("n_upper"),
        chars(r"!?").alias("n_marks"),
        lines.alias("lines"),
        F.coalesce(hashed, F.array().cast("array<bigint>")).alias("h"),
    )
    w = w.select("*", F.size("lines").cast("long").alias("n_lines"), F.size(F.array_distinct("lines")).cast("long").alias("__l"), F.size(F.array_distinct("h")).alias("__h"))
    # Windows in order of their hash; those equal to a neighbour, back in order of place, cover up to three words each.
    ordered = F.when(F.col("__h") < F.size("h"), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    w = w.select("*", ordered.alias("o")).drop("h", "lines")
    w = w.select("*", F.expr("concat(slice(o, 2, size(o)), array(cast(null as struct<h:bigint,i:int>)))").alias("after"), F.expr("concat(array(cast(null as struct<h:bigint,i:int>)), slice(o, 1, size(o) - 1))").alias("prior"))
    w = w.select("*", F.expr("sort_array(transform(filter(arrays_zip(o, after, prior), x -> x.o.h = coalesce(x.after.h, ~x.o.h) or x.o.h = coalesce(x.prior.h, ~x.o.h)), x -> x.o.i))").alias("at")).drop("o", "after", "prior")
    covered = F.expr("aggregate(at, named_struct('last', -3, 'n', 0L), (s, i) -> named_struct('last', i, 'n', s.n + least(3, i - s.last)), s -> s.n)")
    return w.select(
        *keep, "n_words", "word_chars", "n_symbols", (F.col("n_lines") - F.col("__l")).alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines", "n_upper", "n_marks",
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """``P(X <= k)`` for X binomial(n, p), summed exactly from the log of each term."""
    log_odds = F.lit(p).cast("double")
    odds = F.log(log_odds / (1 - log_odds))
    first = n * F.log1p(-log_odds)
    start = F.struct(first.alias("term"), first.alias("sum"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i) + odds
        high = F.greatest(s["sum"], term)
        return F.struct(term.alias("term"), (high + F.log(F.exp(s["sum"] - high) + F.exp(term - high))).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(steps, start, add, lambda s: s["sum"]))


def safe_cutoffs(counts: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """``stratum, rule, cutoff``: the most rejecting proved cutoffs, from ``counts(doc_id, lang, ...)`` and ``labels(doc_id, quality)``."""
    clean = counts.join(
        labels.where((F.col("quality") == 1) & (fold(F.col("doc_id"), 5) != 0)).select("doc_id").distinct(), "doc_id", "left_semi"
    ).where("n_words > 0")
    lines = [F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), F.coalesce(F.expr(RULES[r]) > c, F.lit(False)).cast("long").alias("hit")) for r in RULES for i, c in enumerate(CUTOFFS[r])]
    per = (
        clean.select(F.col("lang").alias("stratum"), F.inline(F.array(*lines)))
        .groupBy("stratum", "rule", "step", "cutoff").agg(F.count("*").alias("n"), F.sum("hit").alias("k"))
        .where(F.col("n") >= LEAST_CLEAN)
    )
    per = checkpointed(per)
    tests = max(1, per.count())
    each = risk / len(RULES)
    # A tail can only be small where k is below its mean; elsewhere the sum needn't be made.
    proved = per.where((F.col("k") < F.col("n") * each)).where(binomial_tail(F.col("k"), F.col("n"), each) <= delta / tests)
    return proved.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The counts of every row of ``docs(doc_id, text, lang)``, ``base_failed`` and ``kept``."""
    counts = checkpointed(text_counts(docs, ["doc_id", "lang"]))
    cutoffs = safe_cutoffs(counts, labels, risk, delta)
    # One row of cutoffs for each stratum; strata have LEAST_CLEAN labelled texts each, and are counted before a broadcast.
    wide = checkpointed(cutoffs.groupBy("stratum").pivot("rule", list(RULES)).agg(F.min("cutoff")))
    over = F.lit(False)
    for rule, ratio in RULES.items():
        over = over | F.coalesce(F.expr(ratio) > F.col(f"cut.{rule}"), F.lit(False))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    joined = counts.alias("c").join(bounded(wide, wide.count()).alias("cut"), F.col("c.lang").eqNullSafe(F.col("cut.stratum")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~over).alias("kept"),
    )
