import pytest
from pyspark.sql import functions as F

from corpusloom.operators import assemble, refmetrics, runner
from corpusloom.plans.catalogue import recipe_readers
from corpusloom.sources import documents as S

STAMP = "2026-01-01 00:00:00"


def files(spark, *names):
    return spark.createDataFrame([(f"/in/{n}.pdf", str(n).encode()) for n in names], "path string, content binary")


def results(spark, readers, *names):
    return {r.name: r for r in runner.convert(files(spark, *names), readers, F.lit(STAMP)).collect()}


def broken(*args):
    raise ValueError("broken")


def test_readers_fail_alone(spark):
    """A narrative, tables or vision that fail are empty; a semantic scan that fails leaves the geometric one; other failures of it are the file's."""
    good = recipe_readers()
    readers = runner.Readers(geometric=good.geometric, semantic=good.semantic, narrative_a=good.narrative_a, narrative_b=broken, tables=broken, deep=broken, ocr=good.ocr, load_model=broken)
    got = results(spark, readers, 35, 26, 99)
    assert got["35.pdf"].success and got["35.pdf"].stats["data_winner"] == "nenhum (sem tabelas detectadas)"
    assert "Ocr of 2." in got["35.pdf"].markdown and got["35.pdf"].stats["vision_winner"] == "ocr (fallback)"
    assert not got["26.pdf"].success and got["26.pdf"].error.startswith("KeyError") and got["26.pdf"].markdown == "" and not got["26.pdf"].stats
    assert got["99.pdf"].success and "Ocr of 1." in got["99.pdf"].markdown and got["99.pdf"].stats["total_pages"] == "2"


def test_without_narratives(spark):
    out = runner.convert(files(spark, 1), runner.Readers(geometric=lambda p, c: [{"page_number": None, "category": "Image"}]), F.lit(STAMP)).first()
    assert out.success and out.name == "1.pdf" and out.score == 0.0
    assert out.stats["narrative_winner"] == "N/A" and out.stats["vision_winner"] == "ocr (fallback)" and out.stats["total_pages"] == "1"
    assert "title: documento_extraido\n" in out.markdown


def test_longer_wins_where_both_score_nothing(spark):
    readers = runner.Readers(geometric=lambda p, c: [], narrative_a=lambda p, c: "abc", narrative_b=lambda p, c: "abcd")
    assert results(spark, readers, 1)["1.pdf"].stats["narrative_winner"] == "b (Desempate por Volume)"


def test_tables_in_page_order_and_injection(spark):
    cells = lambda x: [[x, "y"], ["1", "2"]]
    readers = runner.Readers(
        geometric=lambda p, c: [],
        semantic=lambda p, c: [{"page_number": n, "category": "Table"} for n in (2, 1)],
        narrative_a=lambda p, c: "# Head",
        tables=lambda p, c: [{"page": 2, "cells": cells("second")}, {"page": 1, "cells": cells("first")}, {"page": 1, "cells": [[None, " "]]}, {"page": 3, "cells": cells("third")}],
    )
    out = results(spark, readers, 1)["1.pdf"]
    assert out.markdown.index("| first |") < out.markdown.index("| second |") and "third" not in out.markdown
    assert out.stats["tables_injected"] == "3" and out.markdown.count("[Tabela Detectada]") == 2


def test_scan_convert_and_sink(spark, tmp_path):
    (tmp_path / "7.pdf").write_bytes(b"7")
    good, _ = S.scan(spark, str(tmp_path))
    out = runner.convert(good, recipe_readers(), F.lit(STAMP))
    S.write_markdown(out.where("success"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "7.md").read_text().startswith("---\ntitle: 7\n")
    assert tuple(assemble.run_summary(out).first()) == (1, 1)


def test_empty_input(spark):
    assert runner.convert(files(spark, 1).limit(0), recipe_readers(), F.lit(STAMP)).count() == 0


def test_comparison_table(spark):
    scored = assemble.with_composite(spark.createDataFrame([("x", "", 1.3), ("y", "# A\n\ntext", 0.95)], "engine string, text string, seconds double"), "text")
    got = [tuple(r) for r in assemble.comparison_table(scored, "engine", "seconds").orderBy("Abordagem").collect()]
    assert got[0] == ("x", "1.30s", "25.0%", "0.0%", "100.0%", "0.0%", "100.0%", ".")
    assert got[1][:2] == ("y", "0.95s") and got[1][3] == "3.9%" and got[1][5:] == ("100.0%", "100.0%", ".")


def test_all_reference_metrics(spark):
    pairs = spark.createDataFrame([(1, "a b c d", "a x c"), (2, "a", ""), (3, "**A** b", "a b")], "k int, r string, c string")
    got = {r.k: r for r in refmetrics.evaluate_all(pairs, "k", "r", "c").collect()}
    assert (got[1].WER, got[2].WER, got[3].WER) == (0.5, 1.0, 0.0)
    assert got[1].ROUGE_L == pytest.approx(4 / 7) and got[1].ROUGE_1 == pytest.approx(4 / 7) and got[3].ROUGE_1 == 1.0


def test_every_question_on_every_document(spark):
    qa = spark.createDataFrame([("q1", "t1"), ("q2", "t2")], "question string, ground_truth string")
    docs = spark.createDataFrame([(1, "d1"), (2, "d2"), (3, "d3")], "doc_id long, text string")
    got = sorted((r.doc_id, r.question, r.contexts[0], r.answer) for r in refmetrics.qa_contexts(qa, docs).collect())
    assert got == sorted((i, q, f"d{i}", t) for i in (1, 2, 3) for q, t in (("q1", "t1"), ("q2", "t2")))
