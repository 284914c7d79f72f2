"""Quality rules with adaptive thresholds; built-in expressions only.

Statistics of every document go into KLL quantile sketches, one for each (language, source) and statistic.  Sketches merge,
so a small source takes its language's sketch, and a small language the corpus's, without a second pass.  A threshold lies some
spreads beyond a group's median; thresholds are joined back and filter the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut
from .textstats import with_base, with_style

#: statistic: (expression, direction, least spread).  A document fails above (1) or below (-1) its threshold.
STATISTICS = {
    "symbol_share": ("n_symbols / greatest(word_chars, 1)", 1, 0.01),
    "dup_line_share": ("n_dup_lines / greatest(n_lines, 1)", 1, 0.06),
    "repeat_share": ("n_repeat_words / greatest(n_words, 1)", 1, 0.04),
    "upper_share": ("n_upper / greatest(word_chars, 1)", 1, 0.02),
    "mark_share": ("n_marks / greatest(n_words, 1)", 1, 0.01),
    "long_words": ("word_chars / greatest(n_words, 1)", 1, 0.5),
    "short_words": ("word_chars / greatest(n_words, 1)", -1, 0.3),
}
#: Spreads (median to the 10 % quantile on the clean side) beyond the median, sketch size, fewest documents of a group.
SPREADS, SKETCH_K, LEAST_GROUP = 5.0, 2000, 100
LEAST_WORDS, MOST_REPEATED = 50, 50
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def statistics(documents: DataFrame, carry: list[str]) -> DataFrame:
    texts = documents.select("doc_id", "lang", "source", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carry)
    out = with_style(with_base(texts))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumns({k: F.expr(e).cast("double") for k, (e, _, _) in STATISTICS.items()}).withColumn("base_failed", failed)


def limits(sketch, k: str) -> Column:
    """Threshold of statistic k from its sketch: the spread is taken on the side that junk does not reach."""
    _, side, least = STATISTICS[k]
    quantile = lambda q: F.kll_sketch_get_quantile_double(sketch, F.lit(q))
    spread = F.greatest(F.abs(quantile(0.5) - quantile(0.5 - side * 0.4)), F.lit(least))
    return quantile(0.5) + side * SPREADS * spread


def thresholds(stats: DataFrame) -> DataFrame:
    """(lang, source, t_<statistic>...): of the group, or of the next larger one where the group is small.

    Documents that fail the base rules say nothing about their group and are left out of the sketches; a group of only such ones
    takes the larger group's thresholds."""
    own = stats.groupBy("lang", "source").agg(
        F.count(F.when(~F.col("base_failed"), 1)).alias("n"),
        *(F.kll_sketch_agg_double(F.when(~F.col("base_failed"), F.col(k)), F.lit(SKETCH_K)).alias(k) for k in STATISTICS),
    )
    own = cut(own, stats.rdd.getNumPartitions())  # a row for each group
    merge = lambda by: own.groupBy(*by).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(k).alias(k) for k in STATISTICS))
    by_lang, whole = merge(["lang"]), merge([])
    mine, lang, all_ = own.alias("mine"), by_lang.alias("lang"), whole.alias("whole")
    joined = mine.join(lang, F.col("mine.lang").eqNullSafe(F.col("lang.lang")), "left").join(all_, F.lit(True), "left")
    pick = lambda k: F.when(F.col("mine.n") >= LEAST_GROUP, F.col(f"mine.{k}")).when(F.col("lang.n") >= LEAST_GROUP, F.col(f"lang.{k}")).when(F.col("whole.n") > 0, F.col(f"whole.{k}"))
    picked = joined.select("mine.lang", "mine.source", *(pick(k).alias(k) for k in STATISTICS))
    return picked.select("lang", "source", *(limits(F.col(k), k).alias(f"t_{k}") for k in STATISTICS))


def apply_rules(documents: DataFrame, carry: list[str] = []) -> DataFrame:
    """(doc_id, *carry, base columns, base_failed, kept, failed_rules) for each document.

    Null text counts as empty and fails the base rules.  Null lang or source are groups of their own.  Repeated rows are
    judged each.  Without any document that passes the base rules there are no thresholds, and nothing is kept.  An empty table gives an empty
    result.  Other columns are ignored unless named in `carry`."""
    stats = cut(statistics(documents, carry).drop("text", "n_upper", "n_marks", "n_digits", "n_ends", "n_distinct"))
    s, t = stats.alias("s"), thresholds(stats).alias("t")
    same = F.col("s.lang").eqNullSafe(F.col("t.lang")) & F.col("s.source").eqNullSafe(F.col("t.source"))
    fails = [F.when((F.col(f"s.{k}") - F.col(f"t.t_{k}")) * side > 0, F.lit(k)) for k, (_, side, _) in STATISTICS.items()]
    failed = F.array_compact(F.array(*fails))
    return s.join(t, same, "left").select("s.doc_id", *(f"s.{c}" for c in carry), *(f"s.{c}" for c in BASE), "s.base_failed", (~F.col("s.base_failed") & (F.size(failed) == 0)).alias("kept"), F.array_join(failed, ",").alias("failed_rules"))
