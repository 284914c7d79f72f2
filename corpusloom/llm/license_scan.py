"""License scans by an exact set-similarity join; built-in expressions only.

Each line of a text is a block, a set of words, and so is each run of as many words as a template has, wherever lines break; each
template is a set of words and is held against lines and against runs of its own length.  A block matches a template if it holds at
least `threshold` of the template's words.  Words of templates are ordered by how many blocks of the corpus hold them, rarest first.  By
that order a match must have its first common word within both prefixes, so blocks join templates on prefix words only; a
length filter and a positional filter drop pairs that cannot reach the threshold, and the rest is verified.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut

#: Labels of phrases that count wherever their words stand consecutively.  Fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: (label, template).
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License"),
    ("lgpl", "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved. No part of this publication may be reproduced"),
]
THRESHOLD = 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(lower: Column) -> Column:
    return F.array_remove(F.split(lower, SEPARATORS), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def template_words(text: str) -> list[str]:
    return list(dict.fromkeys(x for x in re.split(SEPARATORS, text.lower()) if x))


def strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def phrase_places(words: Column, lower: Column, phrase: str) -> Column:
    """Places of a phrase's first word; texts without its longest word are not walked."""
    parts = phrase.split()
    at = lambda x, i: [x == parts[0], *(F.get(words, i + k) == w for k, w in enumerate(parts[1:], 1))]

    def hit(x, i):
        test = at(x, i)
        out = test[0]
        for t in test[1:]:
            out = out & t
        return F.when(out, i)

    none = F.array().cast("array<int>")
    there = F.lit(True)
    for w in parts:
        there = there & F.contains(lower, F.lit(w))
    return F.when(there, F.array_compact(F.transform(words, hit))).otherwise(none)


def phrases(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base)."""
    df = documents.withColumn("_w", words_of(F.col("_lower")))
    names = [f"_p{k}" for k in range(len(PHRASES))]
    df = df.withColumns({n: phrase_places(F.col("_w"), F.col("_lower"), p) for n, p in zip(names, PHRASES)})
    found = [F.when(F.size(n) > 0, F.lit(label)) for n, label in zip(names, PHRASES.values())]
    every = F.concat(*names)
    return df.select(
        "doc_id",
        F.size("_w").cast("bigint").alias("n_words"),
        F.size(every).cast("bigint").alias("n_base"),
        F.array_min(every).cast("bigint").alias("first_word"),
        F.array_max(every).cast("bigint").alias("last_word"),
        F.array_compact(F.array(*found)).alias("base"),
    )


def window_matches(documents: DataFrame, prefixes: DataFrame, keys: list[str], widest: int) -> DataFrame:
    """(doc_id, label, overlap, size) of runs of words, over line breaks too, that reach a template's need.

    Such a run holds a word of the template's prefix, so only runs around these words are tried."""
    w = F.col("_w")
    near = lambda i: F.slice(w, F.greatest(i - (widest - 1), F.lit(0)) + 1, F.least(i, F.lit(widest - 1)) + widest)
    spot = lambda x, i: F.when(x.isin(*keys), F.struct(x.alias("word"), F.least(i, F.lit(widest - 1)).alias("at"), near(i).alias("near")))
    spots = documents.select("doc_id", words_of(F.col("_lower")).alias("_w")).select("doc_id", F.explode(F.array_compact(F.transform(w, spot))).alias("s")).select("doc_id", "s.*")
    pairs = spots.join(F.broadcast(prefixes), "word").where(F.size(F.array_intersect("near", "words")) >= F.col("need"))
    starts = F.sequence(F.greatest(F.col("at") - F.col("width") + 1, F.lit(0)), F.col("at"))
    best = F.array_max(F.transform(starts, lambda k: F.size(F.array_intersect(F.slice("near", k + 1, F.col("width")), F.col("words")))))
    return pairs.select("doc_id", "label", best.alias("overlap"), "size", "need").where(F.col("overlap") >= F.col("need")).drop("need")


def block_matches(documents: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """(doc_id, label, containment) of every block and template that reach the threshold, by document and label the best."""
    sets = [(label, template_words(text)) for label, text in templates]
    need = [math.ceil(threshold * len(w) - 1e-9) for _, w in sets]
    vocabulary = sorted({w for _, s in sets for w in s})
    fewest = min(need)
    lines = documents.select("doc_id", F.explode(F.split("_lower", "\n")).alias("line"))
    # a block's words that any template has; too few of them can match nothing
    held = lines.select("doc_id", F.array_intersect(strings(vocabulary), words_of(F.col("line"))).alias("held")).where(F.size("held") >= fewest)
    blocks = cut(held.groupBy("doc_id", "held").agg(F.count("*").alias("n")))  # equal blocks of a document once
    counts = {r[0]: r[1] for r in blocks.select("n", F.explode("held").alias("word")).groupBy("word").agg(F.sum("n")).collect()}  # a row for each template word at most
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    index, spark = [], documents.sparkSession
    for k, (label, s) in enumerate(sets):
        ranked = sorted(s, key=rank.__getitem__)
        width = len([x for x in re.split(SEPARATORS, templates[k][1].lower()) if x])
        index += [(w, k, label, i, len(s), need[k], ranked, width) for i, w in enumerate(ranked[: len(s) - need[k] + 1])]
    prefixes = spark.createDataFrame(index, "word string, template int, label string, i int, size int, need int, words array<string>, width int")
    blocks = blocks.select("doc_id", F.array_intersect(strings(order), F.col("held")).alias("block"))
    probes = blocks.select("doc_id", "block", F.posexplode(F.slice("block", F.lit(1), F.size("block") - fewest + 1)).alias("j", "word"))
    within = (F.size("block") >= F.col("need")) & (F.col("j") <= F.size("block") - F.col("need"))  # length; the block's own prefix
    reach = F.least(F.col("size") - F.col("i"), F.size("block") - F.col("j")) >= F.col("need")  # position
    pairs = probes.join(F.broadcast(prefixes), "word").where(within & reach)  # the templates' prefixes are a constant of the program
    overlap = F.size(F.array_intersect("block", "words"))
    lines_found = pairs.withColumn("overlap", overlap).where(F.col("overlap") >= F.col("need")).select("doc_id", "label", "overlap", "size")
    windows = window_matches(documents, prefixes, sorted({r[0] for r in index}), max(r[-1] for r in index))
    return lines_found.unionByName(windows).groupBy("doc_id", "label").agg(F.max(F.col("overlap") / F.col("size")).alias("containment"))


def scan_licenses(documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each document.

    score is 1 where a base phrase stands, else the best containment of a matched template, else 0.  Null text is empty: no words, no
    labels.  Repeated rows are reported each; rows that share a doc_id, null included, share what the method finds in any of them.  Other columns are
    ignored.  An empty table gives an empty result.  Ties between templates change nothing, as labels are sorted."""
    texts = documents.select("doc_id", lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_lower"))
    found = block_matches(texts, templates, threshold).groupBy("doc_id").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    base, extra = phrases(texts).alias("base"), found.alias("extra")
    joined = base.join(extra, F.col("base.doc_id").eqNullSafe(F.col("extra.doc_id")), "left")
    labels = F.array_sort(F.array_union(F.col("base.base"), F.coalesce(F.col("extra.more"), F.array().cast("array<string>"))))
    return joined.select(
        *(f"base.{c}" for c in ("doc_id", "n_words", "n_base", "first_word", "last_word")),
        F.array_join(F.array_sort(F.array_distinct("base.base")), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("base.n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.col("extra.best"), F.lit(0.0))).cast("double").alias("score"),
    )
