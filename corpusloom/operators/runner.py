"""From files to finished documents: readers, manifest, choice of narrative, tables, visuals, synthesis, result.

Readers are plug-ins that see one file at a time in Python; everything between and after them is joins and column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import clean as C
from corpusloom.functions import tables as T

from . import assemble, manifest

Zones = list[dict]
ZONE = "array<struct<page_number:int,zone_ord:int,category:string>>"
READ = f"path string, semantic {ZONE}, geometric {ZONE}, degraded boolean, narrative_a string, narrative_b string, tables array<struct<page:int,ord:int,cells:array<array<string>>>>, error string"
# Texts of the result.
DESCRIPTION, DEFAULT_NAME = "Comitê de Especialistas Orquestrado", "documento_extraido.pdf"
HEALTHIER, LONGER = "%s (Saúde Superior: %s%%)", "%s (Desempate por Volume)"
NO_TABLES, SOME_TABLES = "nenhum (sem tabelas detectadas)", "%s (%d tabelas)"
DEEP, OCR, NO_VISUALS, NO_WINNER = "%s (deep learning)", "%s (fallback)", "Skipped (Sem Blocos Visuais)", "N/A"
#: Errors of the semantic scan that leave the geometric one; any other fails the file.
RECOVERABLE = (OSError, ValueError, RuntimeError)


@dataclass
class Readers:
    """Each gets (path, content).

    semantic, geometric: zones as dicts (page_number, category; a category of None is a page without zones).  narrative_a, narrative_b: Markdown.
    tables: dicts (page, cells).  load_model makes what deep(path, content, model) needs, once for each worker.
    ocr(path, content, pages): texts of the pages listed, of all pages if none are."""

    geometric: Callable[[str, bytes], Zones]
    semantic: Callable[[str, bytes], Zones] | None = None
    narrative_a: Callable[[str, bytes], str] | None = None
    narrative_b: Callable[[str, bytes], str] | None = None
    tables: Callable[[str, bytes], list[dict]] | None = None
    deep: Callable[..., str] | None = None
    load_model: Callable[[], object] | None = None
    ocr: Callable[[str, bytes, list[int]], list[str]] | None = None
    names: tuple[str, str, str, str, str] = ("a", "b", "tables", "deep", "ocr")


def walled(reader: Callable | None, nothing, *args):
    """A reader that is missing or fails gives nothing."""
    try:
        return (reader(*args) if reader else nothing) or nothing
    except Exception:  # a reader's failure is its own: the others' results count
        return nothing


def read(files: DataFrame, readers: Readers) -> DataFrame:
    """READ for each file (path, content).  A failure of the scan that is not recoverable keeps the row, with the error."""

    def numbered(zones: Zones) -> list[dict]:
        return [{"page_number": int(z.get("page_number") or 1), "zone_ord": k, "category": z.get("category")} for k, z in enumerate(zones)]

    def run(batches: Iterator):
        import pandas as pd

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                row = {"path": path, "semantic": [], "geometric": [], "degraded": readers.semantic is None, "narrative_a": "", "narrative_b": "", "tables": [], "error": None}
                try:
                    try:
                        if readers.semantic:
                            row["semantic"] = numbered(readers.semantic(path, content))
                            row["geometric"] = numbered(readers.geometric(path, content))
                    except RECOVERABLE:
                        row |= {"degraded": True, "semantic": []}
                    if row["degraded"]:
                        row["geometric"] = numbered(readers.geometric(path, content))
                except Exception as e:  # the error wall: one bad file never fails the run
                    row["error"] = f"{type(e).__name__}: {e}"
                else:
                    row["narrative_a"], row["narrative_b"] = (walled(r, "", path, content) for r in (readers.narrative_a, readers.narrative_b))
                    found = walled(readers.tables, [], path, content)
                    row["tables"] = [{"page": int(t.get("page") or 1), "ord": k, "cells": t.get("cells") or []} for k, t in enumerate(found)]
                rows.append(row)
            yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in READ.split(", ")])

    return files.select("path", "content").mapInPandas(run, READ)


def zones_of(scanned: DataFrame) -> DataFrame:
    """(doc_id, page_number, zone_ord, zone_type) of the manifests: enriched, or of the geometric scan alone where the semantic one failed."""

    def exploded(column: str, of: DataFrame) -> DataFrame:
        one = of.select(F.col("path").alias("doc_id"), F.explode(column).alias("z")).where("z.category is not null")
        return one.select("doc_id", "z.page_number", "z.zone_ord", manifest.zone_type(F.col("z.category")).alias("zone_type"))

    whole = scanned.where("not degraded")
    return manifest.enrich(exploded("semantic", whole), exploded("geometric", whole)).unionByName(manifest.degraded(exploded("geometric", scanned.where("degraded"))))


def table_stage(tables: Column) -> Column:
    """Rendered tables in page order and order of detection, stripped, without empty ones."""
    ordered = F.array_sort(tables)
    return F.filter(F.transform(ordered, lambda t: C.strip(T.render_table(t["cells"]))), lambda t: t != "")


def see(files: DataFrame, plan: DataFrame, readers: Readers) -> DataFrame:
    """(path, deep, scanned): vision of the files in `plan` (path, pages); the fast reader is asked where the deep one has nothing."""

    def run(batches: Iterator):
        import pandas as pd

        model = None
        for batch in batches:
            rows = []
            for path, content, pages in zip(batch["path"], batch["content"], batch["pages"]):
                if model is None and readers.deep and readers.load_model:
                    model = walled(readers.load_model, None)
                deep = walled(readers.deep, "", path, content, model)
                scanned = [] if deep.strip() else [t.strip() for t in walled(readers.ocr, [], path, content, [int(p) for p in pages]) if t.strip()]
                rows.append((path, deep, scanned))
            yield pd.DataFrame(rows, columns=["path", "deep", "scanned"])

    return files.select("path", "content").join(plan, "path").mapInPandas(run, "path string, deep string, scanned array<string>")


def convert(files: DataFrame, readers: Readers, stamp: Column) -> DataFrame:
    """(path, name, success, error, markdown, score, winner_description, stats) for each file (path, content).

    stats: narrative_winner, data_winner, vision_winner, tables_injected, visual_blocks, total_pages, as text.  A file that failed has an
    empty document and its error."""
    a, b, plumber, deep, ocr = readers.names
    scanned = read(files, readers)
    zones = zones_of(scanned.where("error is null"))
    seen_pages = F.size(F.array_distinct(F.transform(F.concat("semantic", "geometric"), lambda z: z["page_number"])))
    images = manifest.document_rollup(zones).where(F.size("pages_with_images") > 0).select(F.col("doc_id").alias("path"), F.col("pages_with_images").alias("pages"))
    visuals = see(files, images, readers)
    name = F.element_at(F.split("path", "/"), -1)
    df = scanned.withColumns({"total_pages": seen_pages, "tables": table_stage(F.col("tables")), "name": name})
    df = assemble.fixed(df, a=C.clean(F.col("narrative_a")), b=C.clean(F.col("narrative_b"))).drop("semantic", "geometric", "narrative_a", "narrative_b")
    df = assemble.select_narrative(df, "a", "b")
    df = df.join(manifest.anchor_lists(zones).withColumnRenamed("doc_id", "path"), "path", "left").join(visuals, "path", "left")
    df = df.withColumns({
        "anchors": F.when(~F.col("failed"), F.col("anchors")),
        "name": F.when(F.col("failed"), F.lit(DEFAULT_NAME)).otherwise(F.col("name")),
        "visuals": F.when(F.col("deep").isNotNull(), assemble.choose_visuals(F.col("deep"), F.col("scanned"))).otherwise(F.array().cast("array<string>")),
    })
    text = lambda form, *args: F.format_string(form, *args)
    longer = (F.col("score_a") == 0) & (F.col("score_b") == 0) & (F.col("winner") == "b")
    healthier = F.when(F.col("winner") == "b", text(HEALTHIER, F.lit(b), F.col("score_b").cast("string"))).otherwise(text(HEALTHIER, F.lit(a), F.col("score_a").cast("string")))
    stats = {
        "narrative_winner": F.when(F.col("failed"), F.lit(NO_WINNER)).when(longer, text(LONGER, F.lit(b))).otherwise(healthier),
        "data_winner": F.when(F.size("tables") > 0, text(SOME_TABLES, F.lit(plumber), F.size("tables"))).otherwise(F.lit(NO_TABLES)),
        "vision_winner": F.when(F.col("deep").isNull(), F.lit(NO_VISUALS)).when(C.strip(F.col("deep")) != "", text(DEEP, F.lit(deep))).otherwise(text(OCR, F.lit(ocr))),
        "tables_injected": F.size("tables").cast("string"),
        "visual_blocks": F.size("visuals").cast("string"),
        "total_pages": F.col("total_pages").cast("string"),
    }
    out = assemble.synthesise(df.withColumn("stats", F.create_map(*(x for k, v in stats.items() for x in (F.lit(k), v)))), stamp)
    good = F.col("error").isNull()
    return out.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        good.alias("success"),
        "error",
        F.when(good, F.col("markdown")).otherwise(F.lit("")).alias("markdown"),
        F.when(good, F.col("score")).otherwise(F.lit(0.0)).alias("score"),
        F.when(good, F.lit(DESCRIPTION)).otherwise(F.lit("")).alias("winner_description"),
        F.when(good, F.col("stats")).otherwise(F.create_map().cast("map<string,string>")).alias("stats"),
    )
