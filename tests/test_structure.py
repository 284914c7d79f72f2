from pyspark.sql import functions as F

from corpusloom.functions import frontmatter as Y
from corpusloom.functions import markdown as M
from corpusloom.functions import tables as T
from corpusloom.operators import assemble, manifest, refmetrics
from corpusloom.sources import documents as S
from corpusloom.streaming import cleaning


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def cells(rows):
    return F.array(*(F.array(*(F.lit(c).cast("string") for c in r)) for r in rows)) if rows else F.array().cast("array<array<string>>")


def test_render_table(spark):
    assert one(spark, T.render_table(cells([]))) == ""
    assert one(spark, T.render_table(cells([["", " "], [None, ""]]))) == ""
    got = one(spark, T.render_table(cells([["a", "b\nc"], [None, " "], ["1"], ["x", "y", "z"]])))
    assert got == "| a | b c |\n| --- | --- |\n| 1 |  |\n| x | y |\n\n"


def test_inject_tables_is_literal(spark):
    text = F.lit("A <!-- TABLE_ANCHOR_p1_t1 --> B <!-- TABLE_ANCHOR_p1_t2 --> C")
    got = one(spark, T.inject_tables(text, F.array(F.lit(r"R$ 1 \g"))))
    assert got == "A \n\n### [Tabela Detectada]\n\nR$ 1 \\g\n\n B  C"
    assert one(spark, T.inject_tables(F.lit("none"), F.array(F.lit("t")))) == "none"


def test_density_values(spark):
    score = lambda t: round(one(spark, M.density_score(F.lit(t))), 2)
    assert score("# Head") == 3.28
    assert score("".join(f"# Head{i}\n\n" for i in range(5))) == 6.25
    assert score("- a\n" * 10) == 51.97
    assert score("| a | b | c |\n| --- | --- | --- |\n| 1 | 2 | 3 |\n| 1 | 2 | 3 |\n") == 88.54
    assert score("abc") == 0


def test_linter(spark):
    assert one(spark, M.heading_violations(F.lit("# A\n\n### B\n\n# C\n\n## D"))) == 1
    assert one(spark, M.heading_violations(F.lit("---\nt: 1\n---\n\n#### B"))) == 1
    assert one(spark, M.orphan_rate(F.lit(""))) == 1.0
    assert one(spark, M.orphan_rate(F.lit("pre\n# A\ntext\n# B\nmore"))) == 1 / 3
    assert one(spark, M.front_matter_invalidity(F.lit("---\ntitle: x\n---\nbody"))) == 0.0
    assert one(spark, M.front_matter_invalidity(F.lit("body"))) == 1.0
    empty = assemble.with_composite(spark.createDataFrame([("",)], "t string"), "t").first()
    assert round(empty.composite, 6) == 25.0


def test_front_matter_round_trip(spark):
    made = Y.build(F.lit("Body"), F.lit("a: b#.pdf"), F.lit(3), F.lit(0), F.lit(1.5), F.lit("2026-01-01 00:00:00"))
    assert one(spark, Y.value(made, "tables_injected")) == 3
    assert one(spark, Y.value(made, "total_characters")) == 4
    assert one(spark, Y.value(F.lit("no header"), "tables_injected")) == 0
    assert one(spark, Y.body(made)) == "Body"
    assert "title: a b\n" in one(spark, made)


def test_choice(spark):
    pick = lambda a, b, x, y: one(spark, assemble.choose(F.lit(a), F.lit(b), F.lit(x), F.lit(y)))
    assert [pick("x", "yy", 1.0, 1.0), pick("x", "y", 1.0, 2.0), pick("x", "yy", 0.0, 0.0), pick("xx", "yy", 0.0, 0.0)] == ["a", "b", "b", "a"]


def test_enrich_adds_one_image_and_all_tables(spark):
    schema = "doc_id int, page_number int, zone_ord int, zone_type string"
    semantic = spark.createDataFrame([(1, 1, 1, "TEXT"), (1, 2, 1, "TABLE")], schema)
    geometric = spark.createDataFrame([(1, 1, 5, "IMAGE"), (1, 1, 6, "IMAGE"), (1, 1, 7, "TABLE"), (1, 1, 8, "TABLE"), (1, 2, 5, "TABLE")], schema)
    got = sorted(tuple(r) for r in manifest.enrich(semantic, geometric).collect())
    assert got == [(1, 1, 1, "TEXT"), (1, 1, 5, "IMAGE"), (1, 1, 7, "TABLE"), (1, 1, 8, "TABLE"), (1, 2, 1, "TABLE")]
    assert one(spark, manifest.zone_type(F.lit("FigureCaption"))) == "TEXT"
    assert one(spark, manifest.zone_type(F.lit("other"))) == "UNKNOWN"


def test_reference_metrics(spark):
    pairs = spark.createDataFrame([(1, "a b c d", "a x c"), (2, "a", ""), (3, "**A** b", "a b")], "k int, r string, c string")
    got = {r.k: (r.w, r.l) for r in pairs.select("k", refmetrics.wer(F.col("r"), F.col("c")).alias("w"), refmetrics.rouge_l(F.col("r"), F.col("c")).alias("l")).collect()}
    assert got == {1: (0.5, 4 / 7), 2: (1.0, 0.0), 3: (0.0, 1.0)}
    assert {r.k: round(r.rouge_1, 4) for r in refmetrics.rouge_1(pairs, "k", "r", "c").collect()} == {1: round(4 / 7, 4), 2: 0.0, 3: 1.0}


def test_sources_and_sink(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"small")
    (tmp_path / "b.pdf").write_bytes(b"x" * (S.CLI_LIMIT + 1))
    (tmp_path / "c.txt").write_bytes(b"no")
    good, large = S.scan(spark, str(tmp_path))
    assert (good.count(), large.count(), S.uploads(good.union(good)).count()) == (1, 1, 1)

    def parser(path, content):
        if content != b"small":
            raise ValueError("bad")
        return {"narrative_a": "# Hi", "narrative_b": "", "tables": [], "visuals": [], "zones": []}

    assert S.parse(good, parser).first().narrative_a == "# Hi"
    assert S.parse(spark.read.format("binaryFile").load(str(tmp_path / "c.txt")), parser).first().error == "ValueError: bad"
    S.write_markdown(spark.createDataFrame([("a.pdf", "# Hi")], "name string, markdown string"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "a.md").read_text() == "# Hi"


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "Página 1 de 10"), (2, "# Title here")], "id int, text string").write.parquet(str(tmp_path / "in"))
    stream = cleaning.cleaned_stream(spark, str(tmp_path / "in"), "id int, text string")
    cleaning.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r.id: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "", 2: "# Title here"}
