"""Document files in, Markdown files out.  Parsers are plug-ins; none is required."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLI_LIMIT, UPLOAD_LIMIT = 1 << 20, 2 << 20
PARSED = "path string, zones array<struct<page_number:int,zone_ord:int,category:string,content:string>>, narrative_a string, narrative_b string, tables array<struct<page:int,ord:int,cells:array<array<string>>>>, visuals array<string>, error string"


def scan(spark: SparkSession, path: str, suffix: str = ".pdf", limit: int = CLI_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(accepted, too large): one file of any case of the suffix, or a directory's files with it, not recursive.  The size test reaches the scan."""
    if path.lower().endswith(suffix):
        files = spark.read.format("binaryFile").load(path)
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "false").load(path)
    return files.where(F.col("length") <= limit), files.where(F.col("length") > limit).select("path", "length")


def uploads(files: DataFrame, limit: int = UPLOAD_LIMIT) -> DataFrame:
    """Each (name, length) once."""
    return files.where(F.col("length") <= limit).withColumn("name", F.element_at(F.split("path", "/"), -1)).dropDuplicates(["name", "length"])


def parse(files: DataFrame, parser: Callable[[str, bytes], dict]) -> DataFrame:
    """`parser(path, content)` gives the columns of PARSED but path and error; a failing file keeps its row, with the error."""
    fields = ("zones", "narrative_a", "narrative_b", "tables", "visuals")

    def run(batches: Iterator):
        import pandas as pd

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                row = dict.fromkeys(fields) | {"path": path, "error": None}
                try:
                    row |= parser(path, content)
                except Exception as e:  # the error wall: one bad file never fails the run
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pd.DataFrame(rows, columns=["path", *fields, "error"])

    return files.select("path", "content").mapInPandas(run, PARSED)


def write_markdown(results: DataFrame, folder: str) -> None:
    """One `{stem}.md` for each row (name, markdown), written where the task runs: the folder must be shared."""

    def run(rows):
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            with open(os.path.join(folder, os.path.splitext(os.path.basename(r.name))[0] + ".md"), "w", encoding="utf-8") as f:
                f.write(r.markdown)

    results.select("name", "markdown").foreachPartition(run)
