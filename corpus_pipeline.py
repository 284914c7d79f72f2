"""From raw documents to packed training sequences: five stages, each one operator of corpusloom.llm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.decontaminate import decontaminate
from corpusloom.llm.frames import cut, table
from corpusloom.llm.jaccard_join import jaccard_components
from corpusloom.llm.packing import pack
from corpusloom.llm.quality_rules import apply_rules
from corpusloom.llm.recompression import dedup_substrings
from corpusloom.llm.registry import tokenizer_path


def aliased(docs: DataFrame, *more: Column) -> tuple[DataFrame, list[str]]:
    """The documents with all columns but doc_id and text under names of their own, and these names."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = [f"_c{k}" for k in range(len(others))]
    return docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(n) for c, n in zip(others, names)), *more), names


def restored(out: DataFrame, docs: DataFrame, text: str = "text", **changed: Column) -> DataFrame:
    """Columns of `out` under the names of the documents."""
    others = iter(range(len(docs.columns)))
    values = {c: F.col(text if c == "text" else c) if c in ("doc_id", "text") else F.col(f"_c{next(others)}") for c in docs.columns}
    return out.select(*((changed[c] if c in changed else values[c]).alias(c) for c in docs.columns))


def rewritten(docs: DataFrame, operator) -> DataFrame:
    """`operator(documents, carry)`; its kept_text becomes the text, and n_chars follows it."""
    plain, names = aliased(docs)
    return restored(operator(plain, names), docs, "kept_text", n_chars=F.length("kept_text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected rows go, each by its own verdict; rows without a doc_id are judged like any other."""
    plain, names = aliased(docs, F.col("text").alias("_text"), F.col("lang").alias("lang"), F.col("source").alias("source"))
    return restored(apply_rules(plain, ["_text", *names]).where("kept"), docs, "_text")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, equal rows once.  Two texts under this id stay both, as one
    document; rows without a doc_id take no part and stay."""
    kept = jaccard_components(docs).where("component_id = doc_id").select("doc_id", F.col("text_print").alias("_print")).distinct()
    plain, _ = aliased(docs, F.xxhash64(F.col("text").cast("string")).alias("_print"))
    with_id = plain.join(kept, ["doc_id", "_print"], "left_semi").dropDuplicates(["doc_id", "_print"])
    return restored(with_id.unionByName(plain.where("doc_id is null")), docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from all but their first document; a document of which nothing is left goes."""
    return rewritten(docs, lambda d, carry: dedup_substrings(d, carry=carry).where("n_removed < n_words or n_words = 0"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items go; a document that is mostly benchmark goes whole."""
    benchmark = table(spark, sf_dir, "benchmark")
    return rewritten(docs, lambda d, carry: decontaminate(d, benchmark, carry=carry).where("not dropped"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: Quantile sketches, near duplicates, removed passages and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
