"""Comparison with a reference text: word error rate, ROUGE-1, ROUGE-L."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.clean import strip


def normal(text: Column) -> Column:
    """Markdown marks are spaces, white space is one space, lower case."""
    return F.lower(strip(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[#*_|`~\[\]()]", " "), r"(?U)\s+", " ")))


def rouge_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+"), lambda x: x != "")


def _codes(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    known = {t: k for k, t in enumerate(dict.fromkeys([*a, *b]))}
    return np.array([known[t] for t in a], np.int64), np.array([known[t] for t in b], np.int64)


def _distance(a: list[str], b: list[str]) -> int:
    """Edit distance, a row of the table at a time: the insertions along a row are a running minimum."""
    x, y = _codes(a, b)
    place = np.arange(len(y) + 1)
    row = place.copy()
    for i, c in enumerate(x, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (y != c))
        row = np.minimum.accumulate(np.append(i, best) - place) + place
    return int(row[-1])


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table at a time."""
    x, y = _codes(a, b)
    row = np.zeros(len(y) + 1, np.int64)
    for c in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], (row[:-1] + 1) * (y == c)))
    return int(row[-1])


def _wer(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    return pd.Series([1.0 if not r or not c else _distance(r.split(), c.split()) / len(r.split()) for r, c in zip(reference, candidate)])


def _rouge_l(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    out = []
    for r, c in zip(reference, candidate):
        r, c = list(r), list(c)
        out.append(2 * _common(r, c) / (len(r) + len(c)) if r and c else 0.0)
    return pd.Series(out)


def wer(reference: Column, candidate: Column) -> Column:
    return F.pandas_udf(_wer, "double")(normal(reference), normal(candidate))


def rouge_l(reference: Column, candidate: Column) -> Column:
    return F.pandas_udf(_rouge_l, "double")(rouge_tokens(reference), rouge_tokens(candidate))


def rouge_1(pairs: DataFrame, key: str, reference: str, candidate: str) -> DataFrame:
    """(key, rouge_1): overlap of token counts, by a join of the two bags."""
    bag = lambda c, n: pairs.select(key, F.explode(rouge_tokens(F.col(c))).alias("token")).groupBy(key, "token").agg(F.count("*").alias(n))
    common = bag(reference, "x").join(bag(candidate, "y"), [key, "token"]).groupBy(key).agg(F.sum(F.least("x", "y")).alias("common"))
    sizes = pairs.select(key, (F.size(rouge_tokens(F.col(reference))) + F.size(rouge_tokens(F.col(candidate)))).alias("sizes"))
    return sizes.join(common, key, "left").select(key, F.when(F.col("common") > 0, 2.0 * F.col("common") / F.col("sizes")).otherwise(0.0).alias("rouge_1"))


def evaluate_all(pairs: DataFrame, key: str, reference: str, candidate: str) -> DataFrame:
    """(key, WER, ROUGE_L, ROUGE_1), on texts without Markdown marks."""
    plain = pairs.select(key, normal(F.col(reference)).alias("_r"), normal(F.col(candidate)).alias("_c"))
    one = rouge_1(plain, key, "_r", "_c").withColumnRenamed("rouge_1", "ROUGE_1")
    return plain.select(key, wer(F.col("_r"), F.col("_c")).alias("WER"), rouge_l(F.col("_r"), F.col("_c")).alias("ROUGE_L")).join(one, key)


#: Questions that are sent to every task at most.
MOST_QUESTIONS = 100_000


def qa_contexts(qa: DataFrame, documents: DataFrame) -> DataFrame:
    """Judge inputs: each question (question, ground_truth) on each document, with the whole document as its one context; the truth stands for the answer.

    A question list is short by nature: it is a column of each document, exploded, and refused beyond MOST_QUESTIONS."""
    found = qa.select("question", "ground_truth").limit(MOST_QUESTIONS + 1).collect()
    if len(found) > MOST_QUESTIONS:
        raise ValueError(f"more than {MOST_QUESTIONS} questions")
    every = F.array(*(F.struct(F.lit(r[0]).alias("question"), F.lit(r[1]).alias("ground_truth")) for r in found)) if found else F.array().cast("array<struct<question:string,ground_truth:string>>")
    return documents.select("doc_id", F.array("text").alias("contexts"), F.explode(every).alias("_q")).select("doc_id", "contexts", "_q.question", "_q.ground_truth", F.col("_q.ground_truth").alias("answer"))
