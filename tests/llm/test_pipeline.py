import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from corpusloom.llm.quality_rules import apply_rules
from corpusloom.llm.registry import tokenizer_path
from tests.llm import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs)
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    text = [{r.doc_id: r.text for r in d.collect()} for d in (raw, *kept[:4])]
    assert all(d.columns == COLUMNS for d in kept[:4])
    verdict = {r.doc_id: r.kept for r in apply_rules(raw).collect()}
    assert set(text[1]) == {i for i in verdict if verdict[i]}
    assert set(text[2]) == {i for i, (_, c) in brute.op8(text[1]).items() if c == i}
    for i, (pieces, gone) in brute.repeats(text[2], lambda t: t.encode().split(), 50).items():
        assert (i not in text[3]) == (all(gone) and any(gone))
        if i in text[3]:
            assert text[3][i].encode().split() == [w for w, g in zip(pieces, gone) if not g]
            assert any(gone) or text[3][i] == text[2][i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = brute.op10(text[3], items)
    assert set(text[4]) == {i for i, h in hits.items() if 2 * h[1] <= h[0]}
    assert all(text[4][i] == text[3][i] for i in text[4] if not hits[i][4])
    assert all(r.n_chars == len(r.text) for r in kept[3].collect())
    tokenizer = Tokenizer.from_file(tokenizer_path())
    packed = kept[4].toPandas()
    assert set(packed.doc_id) == set(text[4])
    for r in packed.itertuples():
        ids = np.array([*tokenizer.encode(text[4][r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert P.run(spark, SF).agg(F.sum("length")).first()[0] == packed.length.sum()


def test_stages_on_odd_tables(spark, docs, empty):
    docs = docs.union(docs.limit(2)).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    for frame in (docs, empty):
        for _, stage in P.STAGES[:4]:
            out = stage(spark, frame, SF)
            assert out.columns == frame.columns
            assert out.count() <= frame.count()
        assert P.packing(spark, frame, SF).count() >= frame.count()


def test_rows_under_one_id_are_judged_each(spark):
    good = " ".join(f"w{k % 97}x{k}" for k in range(120))
    other = " ".join(f"v{k % 89}y{k}" for k in range(120))
    rows = [(5, good), (5, "too short"), (None, other), (7, good), (7, other), (7, other)] + [(100 + k, " ".join(f"a{k}b{j}" for j in range(80))) for k in range(8)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.quality_rules(spark, docs, SF)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted((i or 0, t) for i, t in rows if t != "too short")
    single = P.jaccard_join(spark, kept, SF)
    assert sorted((r.doc_id or 0, r.text) for r in single.collect() if (r.doc_id or 0) < 100) == sorted([(5, good), (0, other), (7, other)])
