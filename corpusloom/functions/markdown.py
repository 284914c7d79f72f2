"""Scores of Markdown.  What needs the block structure of a text comes from one pass of `mdparse` over it in Arrow batches; everything else,
weights, penalties and scores, is column expressions.
"""

from __future__ import annotations

import sys
from functools import cache

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import mdparse
from .clean import garbage_hits, strip
from .mdparse import TAGS

# functions that run in Python workers are shipped by value, so executors need no copy of the library
for _module in (__name__, mdparse.__name__):
    cloudpickle.register_pickle_by_value(sys.modules[_module])

# Tag classes and weights of the density score.
LINEAR = ("table", "tr", "th", "td", "ul", "ol", "li")
WEIGHTS = {**dict.fromkeys(("table", "tr", "th", "td"), 25.0), **dict.fromkeys(("ul", "ol", "li"), 10.0), **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6", "pre", "code", "math"), 5.0)}
GAMMA, SCALE, HIT_COST, WALL_COST = 0.5, 150.0, 1.5, 5.0
PROFILE = "tags array<int>, violations long, orphans double, invalid double"


def _profiles(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([mdparse.profile(t) for t in texts], columns=["tags", "violations", "orphans", "invalid"])


@cache
def _profiler():
    return F.pandas_udf(_profiles, PROFILE)


def profile(text: Column) -> Column:
    """struct<tags, violations, orphans, invalid>; null is empty.  All uses of one text's profile in a projection share one pass."""
    return _profiler()(text)


def counts_in(profile_: Column) -> dict[str, Column]:
    """Tag -> number of its elements, from a profile."""
    return {t: F.get(profile_["tags"], k).cast("bigint") for k, t in enumerate(TAGS)}


def tag_counts(text: Column) -> dict[str, Column]:
    """Tag -> number of its elements in the text."""
    return counts_in(profile(text))


def density_bonus(counts: dict[str, Column], gamma: float = GAMMA) -> Column:
    """Weights by tag; repeats of tags outside tables and lists decay by gamma, in closed form."""
    total = F.lit(0.0)
    for tag, n in counts.items():
        w = WEIGHTS.get(tag, 1.0)
        linear = tag in LINEAR or gamma == 1
        total = total + (n * w if linear else w * (1 - F.pow(F.lit(gamma), n)) / (1 - gamma))
    return total


def garbage_penalty(text: Column) -> Column:
    wall = (F.length(text) > 1000) & (F.regexp_count(text, F.lit("\n\n")) < 2)
    return HIT_COST * garbage_hits(text) + F.when(wall, F.lit(WALL_COST)).otherwise(F.lit(0.0))


def density(bonus: Column, penalty: Column, text: Column) -> Column:
    """0 to 100, unrounded."""
    raw = F.greatest(bonus - penalty, F.lit(0.0))
    return F.when(F.length(strip(text)) < 5, F.lit(0.0)).otherwise(100 * (1 - F.exp(-raw / SCALE)))


def density_score(text: Column, gamma: float = GAMMA, profile_: Column | None = None) -> Column:
    """`profile_`: the text's profile, if there is a column of it."""
    counts = tag_counts(text) if profile_ is None else counts_in(profile_)
    return density(density_bonus(counts, gamma), garbage_penalty(text), text)


def word_count(text: Column) -> Column:
    plain = strip(F.regexp_replace(text, r"[#*_|`~\[\]()]", " "))
    return F.when(plain == "", F.lit(0)).otherwise(F.size(F.split(plain, r"(?U)\s+")))


def token_word_ratio(text: Column) -> Column:
    """Pre-tokens (letter runs, up to three digits, mark runs) for each word; an offline stand-in for a trained tokenizer's count."""
    n = word_count(text)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.regexp_count(text, F.lit(r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+")) / n)


def orphan_rate(text: Column) -> Column:
    """Share of chunks under no heading; a text without content counts as 1."""
    return profile(text)["orphans"]


def heading_violations(text: Column) -> Column:
    """Headings more than one level below the one before, plus raw HTML blocks that are not table anchors."""
    return profile(text)["violations"]


def front_matter_invalidity(text: Column) -> Column:
    """0.0 if the text starts with a closed block that is a YAML mapping, else 1.0."""
    return profile(text)["invalid"]


def composite(density_: Column, orphans: Column, ratio: Column, violations: Column, invalid: Column) -> Column:
    floor = lambda x: F.greatest(F.lit(0.0), x)
    tokens = floor(100 - 40 * floor(ratio - 1.5))
    return 0.40 * density_ + 0.30 * (1 - orphans) * 100 + 0.15 * tokens + 0.10 * floor(100 - 20.0 * violations) + 0.05 * F.when(invalid == 0, F.lit(100.0)).otherwise(F.lit(0.0))
