"""Text statistics as built-in column expressions; each is a chain of projections, so Catalyst evaluates every array once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Bits of a packed place in step one of repeated_words.
PLACE_BITS = 21


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def adjacent_equal(array: Column, name: Column | None, key) -> Column:
    """Elements of a sorted array whose key equals a neighbour's."""
    return F.filter(array, lambda x, i: (key(x) == key(F.get(array, i - 1))) | (key(x) == key(F.get(array, i + 1))))


def with_repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds `out`: words in 3-word windows that stand at least twice in the text, the first one included.

    Windows are sorted by 43 bits of their 64-bit hash with the place beneath, as plain longs; the few that agree with a
    neighbour are compared by the whole hash."""
    w, h, p, c = (F.col(x) for x in (words, "_h", "_p", "_c"))
    n = F.size(w)
    df = df.withColumn("_h", F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))))
    high = F.lit(-1 << PLACE_BITS)
    packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(high).bitwiseOR(i.cast("bigint"))))
    df = df.withColumn("_p", F.when(n < (1 << PLACE_BITS), packed))
    near = F.transform(adjacent_equal(p, None, lambda x: x.bitwiseAND(high)), lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"))
    every = F.when(n < 3, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))))
    df = df.withColumn("_c", F.coalesce(near, every))
    df = df.withColumn("_c", F.sort_array(F.transform(c, lambda i: F.struct(F.get(h, i).alias("h"), i.alias("i")))))
    places = F.flatten(F.transform(adjacent_equal(c, None, lambda x: x["h"]), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return df.withColumn(out, F.size(F.array_distinct(places)).cast("bigint")).drop("_h", "_p", "_c")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def with_base(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines, n_repeat_words (all long), for a text that is not null."""
    t = F.col(text)
    df = df.withColumn("_w", words_of(t)).withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: without(x, WHITE) != ""))
    df = df.withColumns({
        "n_words": F.size("_w").cast("bigint"),
        "word_chars": F.length(without(t, WHITE)).cast("bigint"),
        "n_symbols": (F.length(t) - F.length(without(t, SYMBOLS))).cast("bigint"),
        "n_lines": F.size("_lines").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
    })
    return with_repeated_words(df, "_w", "n_repeat_words").drop("_w", "_lines")


def with_style(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_upper, n_marks (exclamation and question marks), n_digits, n_ends (sentence ends), n_distinct (different words): counts as long."""
    t = F.col(text)
    count = lambda chars: (F.length(t) - F.length(without(t, chars))).cast("bigint")
    return df.withColumns({
        "n_upper": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_marks": count("!?"),
        "n_digits": count("0123456789"),
        "n_ends": count(".!?"),
        "n_distinct": F.size(F.array_distinct(words_of(t))).cast("bigint"),
    })
