"""Queries of this subpackage: one thin `opN_<name>` for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .frames import table
from .jaccard_join import jaccard_components
from .license_scan import scan_licenses
from .lm_scoring import cross_entropy_difference
from .oracles import ORACLE_SQL
from .packing import pack
from .quality_model import score_quality
from .quality_rules import apply_rules
from .recompression import dedup_substrings
from .runlength_dedup import dedup_bytes
from .style_tree import main_text


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))
    return out.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")))


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents")).drop("kept_bytes")


def op4_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("kept_text")


def op5_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op6_adaptive_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))


def op7_sparse_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_combination_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("text_print")


def op9_license_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_suffix_automaton_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), with_text=False)
    return out.drop("longest", "coverage", "dropped")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_cross_entropy_difference,
        op2_sum_of_squares_packing,
        op3_run_length_dedup,
        op4_recompression_dedup,
        op5_site_style_tree,
        op6_adaptive_quality_rules,
        op7_sparse_rule_ensemble,
        op8_token_combination_jaccard,
        op9_license_set_join,
        op10_suffix_automaton_decontamination,
    )
}

__all__ = ["ORACLE_SQL", "QUERIES", "tokenizer_path"]
