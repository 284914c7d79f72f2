"""Page manifests: zones as rows (doc_id, page_number, zone_ord, zone_type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Element classes and their zone types; other classes are UNKNOWN.
TYPES = {"NarrativeText": "TEXT", "Title": "TITLE", "Table": "TABLE", "Image": "IMAGE", "Header": "HEADER", "Footer": "FOOTER", "ListItem": "LIST", "FigureCaption": "TEXT"}


def zone_type(category: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, category), F.lit("UNKNOWN"))


def page_rollup(zones: DataFrame) -> DataFrame:
    """(doc_id, page_number, has_tables, has_images, is_text_only)."""
    out = zones.groupBy("doc_id", "page_number").agg(F.bool_or(F.col("zone_type") == "TABLE").alias("has_tables"), F.bool_or(F.col("zone_type") == "IMAGE").alias("has_images"))
    return out.withColumn("is_text_only", ~F.col("has_tables") & ~F.col("has_images"))


def document_rollup(zones: DataFrame) -> DataFrame:
    """(doc_id, total_pages, pages_with_tables, pages_with_images): page lists in page order."""
    pages = lambda c: F.array_sort(F.collect_list(F.when(F.col(c), F.col("page_number"))))
    return page_rollup(zones).groupBy("doc_id").agg(F.count("*").alias("total_pages"), pages("has_tables").alias("pages_with_tables"), pages("has_images").alias("pages_with_images"))


def enrich(semantic: DataFrame, geometric: DataFrame) -> DataFrame:
    """Semantic zones plus geometric ones that they lack: the first image of a page without images, all tables of a page without tables."""
    key = ["doc_id", "page_number", "zone_type"]
    missing = geometric.where(F.col("zone_type").isin("IMAGE", "TABLE")).join(semantic.select(*key).distinct(), key, "left_anti")
    order = F.row_number().over(Window.partitionBy(*key).orderBy("zone_ord"))
    added = missing.withColumn("_n", order).where((F.col("zone_type") == "TABLE") | (F.col("_n") == 1)).drop("_n")
    return semantic.unionByName(added.select(*semantic.columns))


def degraded(geometric: DataFrame) -> DataFrame:
    """Without a semantic scan: every image, no table."""
    return geometric.where("zone_type = 'IMAGE'")


def numbered_tables(zones: DataFrame) -> DataFrame:
    """(doc_id, page_number, number, ordinal): tables numbered by page from 1, and through the document in page order."""
    tables = zones.where("zone_type = 'TABLE'")
    by_page = Window.partitionBy("doc_id", "page_number").orderBy("zone_ord")
    whole = Window.partitionBy("doc_id").orderBy("page_number", "zone_ord")
    return tables.select("doc_id", "page_number", F.row_number().over(by_page).alias("number"), F.row_number().over(whole).alias("ordinal"))


def anchor_lists(zones: DataFrame) -> DataFrame:
    """(doc_id, anchors array<struct<page, number>>) in the order in which they are appended."""
    items = numbered_tables(zones).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.col("page_number").alias("page"), "number"))).alias("a"))
    return items.select("doc_id", F.transform("a", lambda x: F.struct(x["page"].alias("page"), x["number"].alias("number"))).alias("anchors"))


def vision_plan(documents: DataFrame, zones: DataFrame) -> DataFrame:
    """(doc_id, page_number) to read by vision; documents without images are absent, and so skipped."""
    return documents.select("doc_id").join(page_rollup(zones).where("has_images"), "doc_id").select("doc_id", "page_number")
