"""YAML front matter of finished documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENGINE = "corpusloom"
SPLIT = r"(?s)^---\s*(.*?)\s*---\s*(.*)"


def title_of(name: Column) -> Column:
    return F.regexp_replace(F.replace(name, F.lit(".pdf"), F.lit("")), r"[^A-Za-zÀ-Úà-ú0-9_ -]", "")


def build(body: Column, name: Column, tables: Column, visuals: Column, score: Column, stamp: Column, engine: str = ENGINE) -> Column:
    """Eight keys; `tables` counts what was extracted, `stamp` is `YYYY-MM-DD HH:MM:SS`."""
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value.cast("string"), F.lit("\n"))
    keys = [
        ("title", title_of(name)),
        ("extraction_engine", F.lit(engine)),
        ("source_file", F.replace(name, F.lit(".pdf"), F.lit(""))),
        ("processing_date", stamp),
        ("total_characters", F.length(body)),
        ("tables_injected", tables),
        ("visual_blocks", visuals),
        ("mdeval_score", score),
    ]
    return F.concat(F.lit("---\n"), *(line(k, v) for k, v in keys), F.lit("---\n\n"), body)


def header(text: Column) -> Column:
    return F.regexp_extract(text, SPLIT, 1)


def body(text: Column) -> Column:
    return F.when(text.rlike(SPLIT), F.regexp_extract(text, SPLIT, 2)).otherwise(text)


def value(text: Column, key: str) -> Column:
    """A whole number under a key of the header, 0 if there is none."""
    return F.coalesce(F.regexp_extract(header(text), rf"(?m)^{key}: (\d+)$", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
