"""Small frames under many shuffle partitions: what is written to checkpoints."""

from pathlib import Path

import pytest

from corpusloom.llm import jaccard_join, quality_rules, recompression
from corpusloom.llm.components import components
from corpusloom.llm.decontaminate import decontaminate
from tests.llm import brute

MANY = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def checkpoints(spark, monkeypatch):
    """The files of each checkpoint so far, under many partitions that are not coalesced."""
    from corpusloom.llm.frames import shared_folder

    shared_folder(spark)
    top = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = {k: spark.conf.get(k) for k in MANY}
    old = set(top.glob("rdd-*"))
    for k, v in MANY.items():
        spark.conf.set(k, v)
    yield lambda: [len(list(d.glob("part-*"))) for d in set(top.glob("rdd-*")) - old]
    for k, v in before.items():
        spark.conf.set(k, v)


def test_components(spark, checkpoints):
    edges = [(k + 1, k) for k in range(40)] + [(100, 101)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), files=5).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}
    assert len(checkpoints()) > 2 and max(checkpoints()) <= 5


def test_jaccard_join(spark, docs, texts, checkpoints):
    got = jaccard_join.jaccard_components(docs, group_bytes=2_000).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.op8(texts)
    files = checkpoints()
    assert len(files) > 8 and sum(n > 12 for n in files) <= 1  # the classes of the blocks, whose tasks are the work itself


@pytest.mark.parametrize("run", [
    lambda docs: quality_rules.apply_rules(docs),
    lambda docs: recompression.dedup_substrings(docs),
    lambda docs: decontaminate(docs, docs.selectExpr("cast(doc_id as string) item_id", "text").where("length(item_id) < 3")),
])
def test_others(spark, docs, checkpoints, run):
    assert run(docs).count() == docs.count()
    assert checkpoints() and max(checkpoints()) <= 12
