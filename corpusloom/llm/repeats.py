"""What both exact repeat removers share: rows with a key of their own, and spans that meet their row again.

A row is known by its doc_id and a fingerprint of its text, so two texts under one doc_id are judged each; rows that are equal
in both have the same spans.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPANS = "doc_id long, print long, start int, stop int"
#: Names that the finishing pass takes for itself.
OWN = ("doc_id", "text", "_print", "_starts", "_stops")


def rows(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def refuse(carry: list[str], taken: tuple[str, ...]) -> None:
    if clash := sorted(set(carry) & set(taken)):
        raise ValueError(f"carried columns need other names than {clash}")


def keyed(documents: DataFrame, carry: list[str] = []) -> DataFrame:
    """(doc_id, text, _print, *carry)"""
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_print"), *(F.col(f"`{c}`") for c in carry))


def without_spans(documents: DataFrame, spans: DataFrame, finish: Callable, finished: str, carry: list[str]) -> DataFrame:
    """`finish` applies to each row of the documents the spans (SPANS) of its key."""
    refuse(carry, OWN)
    by_row = spans.groupBy("doc_id", F.col("print").alias("_print")).agg(F.collect_list("start").alias("_starts"), F.collect_list("stop").alias("_stops"))
    return keyed(documents, carry).join(by_row, ["doc_id", "_print"], "left").select("doc_id", "text", "_starts", "_stops", *carry).mapInArrow(finish, finished)
