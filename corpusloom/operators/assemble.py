"""Choice of narrative, synthesis of the document, scores and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import clean as C
from corpusloom.functions import frontmatter as Y
from corpusloom.functions import markdown as M
from corpusloom.functions import tables as T


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds or replaces columns behind a generator, which the optimiser never looks through: long expressions are computed once, however often they are used."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*others, F.inline(F.array(F.struct(*(e.alias(c) for c, e in columns.items())))))


def spread(df: DataFrame) -> DataFrame:
    """Rows of few partitions dealt over the cores before a costly pass; what has partitions enough is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def choose(a: Column, b: Column, score_a: Column, score_b: Column) -> Column:
    """'b' if it scores strictly more, or if both score 0 and b is strictly longer; else 'a'."""
    longer = (score_a == 0) & (score_b == 0) & (F.length(b) > F.length(a))
    return F.when((score_b > score_a) | longer, F.lit("b")).otherwise(F.lit("a"))


def select_narrative(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds score_a, score_b, winner, narrative, failed (both are empty)."""
    df = fixed(df, score_a=F.round(M.density_score(F.col(a)), 2), score_b=F.round(M.density_score(F.col(b)), 2))
    df = df.withColumn("winner", choose(F.col(a), F.col(b), F.col("score_a"), F.col("score_b")))
    return df.withColumns({"narrative": F.when(F.col("winner") == "b", F.col(b)).otherwise(F.col(a)), "failed": (F.length(a) == 0) & (F.length(b) == 0)})


def visuals_block(visuals: Column) -> Column:
    head = "\n\n---\n## 🔍 Elementos Gráficos Reconstruídos\n\n"
    return F.when(F.size(visuals) > 0, F.concat(F.lit(head), F.array_join(F.transform(visuals, lambda v: F.concat(v, F.lit("\n\n"))), ""))).otherwise(F.lit(""))


def choose_visuals(deep: Column, scanned: Column) -> Column:
    """One block of the deep reader if it is not blank, else the scanned ones."""
    return F.when(C.strip(F.coalesce(deep, F.lit(""))) != "", F.array(deep)).otherwise(F.coalesce(scanned, F.array().cast("array<string>")))


def synthesise(df: DataFrame, stamp: Column) -> DataFrame:
    """narrative, anchors, tables, visuals, name -> markdown and score.

    Tables are put at anchors literally, whatever characters they hold."""
    text = F.concat("narrative", T.anchors(F.coalesce("anchors", F.array().cast("array<struct<page:int,number:int>>"))))
    tables = F.coalesce("tables", F.array().cast("array<string>"))
    visuals = F.coalesce("visuals", F.array().cast("array<string>"))
    df = fixed(fixed(df, _raw=F.concat(T.inject_tables(text, tables), visuals_block(visuals))), _body=C.clean(F.col("_raw"))).drop("_raw")
    df = df.withColumn("score", F.round(M.density_score(F.col("_body")), 2))
    name = F.coalesce("name", F.lit("documento_extraido.pdf"))
    return df.withColumn("markdown", Y.build(F.col("_body"), name, F.size(tables), F.size(visuals), F.col("score"), stamp)).drop("_body")


def lint(df: DataFrame, text: str) -> DataFrame:
    """Adds the four readiness numbers and the density, all structure from one pass over each text."""
    t, p = F.col(text), F.col("_profile")
    return df.withColumn("_profile", M.profile(t)).withColumns({
        "token_word_ratio": M.token_word_ratio(t),
        "orphan_rate": p["orphans"],
        "violations": p["violations"],
        "front_matter_invalid": p["invalid"],
        "density": M.density_score(t, profile_=p),
    }).drop("_profile")


def with_composite(df: DataFrame, text: str) -> DataFrame:
    df = lint(df, text)
    return df.withColumn("composite", M.composite(*(F.col(c) for c in ("density", "orphan_rate", "token_word_ratio", "violations", "front_matter_invalid"))))


def comparison_table(scored: DataFrame, engine: str, seconds: str) -> DataFrame:
    """The eight text columns of the comparison of engines, of rows with the columns of with_composite.

    Each score is a percentage with one decimal, the time has two; YAML is OK or a point."""
    percent = lambda c: F.format_string("%.1f%%", c)
    floor = lambda x: F.greatest(F.lit(0.0), x)
    return scored.select(
        F.col(engine).alias("Abordagem"),
        F.format_string("%.2fs", F.col(seconds).cast("double")).alias("Tempo"),
        percent(F.col("composite")).alias("Score RAG"),
        percent(F.round("density", 2)).alias("MDE"),
        percent(floor(100 - 40 * floor(F.col("token_word_ratio") - 1.5))).alias("TWR"),
        percent((1 - F.col("orphan_rate")) * 100).alias("Orphans"),
        percent(floor(100 - 20.0 * F.col("violations"))).alias("AST"),
        F.when(F.col("front_matter_invalid") == 0, F.lit("OK")).otherwise(F.lit(".")).alias("YAML"),
    )


def run_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if("success").alias("ok"), F.count("*").alias("total"))
