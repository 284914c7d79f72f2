import html
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import jaccard_join, registry
from corpusloom.llm.arrays import U64
from corpusloom.llm.components import components
from corpusloom.llm.decontaminate import decontaminate
from corpusloom.llm.license_scan import scan_licenses
from corpusloom.llm.lm_scoring import cross_entropy_difference
from corpusloom.llm.packing import SumOfSquares, pack
from corpusloom.llm.quality_model import RuleEnsemble, bounded_sample, score_quality
from corpusloom.llm.quality_rules import apply_rules
from corpusloom.llm.recompression import dedup_substrings
from corpusloom.llm.runindex import RunLengthIndex
from corpusloom.llm.runlength_dedup import dedup_bytes
from corpusloom.llm.style_tree import main_text
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


def twice(docs):
    """Repeated rows and rows without an id."""
    return docs.union(docs.limit(3)).union(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))


# --- substring dedup -----------------------------------------------------------------------------------------


def test_recompression_is_exact(docs, texts):
    assert rows(dedup_substrings(docs), "n_words", "n_removed", "kept_sha256") == brute.op4(texts)


@pytest.mark.parametrize("rounds", [0, 1, 12])
def test_rounds_change_no_result(docs, texts, rounds):
    assert rows(dedup_substrings(docs, rounds=rounds), "n_words", "n_removed", "kept_sha256") == brute.op4(texts)


def test_kept_text_keeps_its_layout(spark):
    body = " ".join(f"t{k}" for k in range(60))
    got = rows(dedup_substrings(spark.createDataFrame([(1, body), (2, f"head\n{body}\ntail  end")], "doc_id long, text string")), "kept_text")
    assert got == {1: (body,), 2: ("head\n\ntail  end",)}


def test_run_length_dedup_is_exact(docs, texts):
    assert rows(dedup_bytes(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.op3(texts)


def test_dedup_of_odd_tables(docs, empty):
    for operator in (dedup_substrings, dedup_bytes):
        assert operator(empty).count() == 0
        assert operator(twice(docs)).count() == docs.count() + 5


def test_run_length_index_streams_and_locates():
    rng = np.random.default_rng(3)
    strings = [rng.integers(97, 99, int(n)).astype(np.uint8).tobytes() for n in rng.integers(0, 90, 40)]
    data, lengths = np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings])
    index = RunLengthIndex(data, lengths, np.arange(40), 12)
    first = {}
    for i, s in enumerate(strings):
        for k in range(len(s) - 11):
            first.setdefault(s[k : k + 12], i)
    assert index.stream().tolist() == [first[s[k : k + 12]] for s in strings for k in range(len(s) - 11)]
    whole = b"\0".join(strings) + b"\0"
    order = [index.locate(r) for r in range(40, len(whole))]
    tail = lambda p: whole[p : whole.index(b"\0", p)]
    assert all(tail(a) <= tail(b) for a, b in zip(order, order[1:])) and len(set(order)) == len(order)
    assert len(index.starts) < len(whole)


# --- near duplicates -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("frequent, combined", [(64, 100), (2, 5)])
def test_jaccard_components_are_exact(docs, texts, frequent, combined, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "COMBINED", combined)
    assert rows(jaccard_join.jaccard_components(docs), "n_shingles", "component_id") == brute.op8(texts)


def test_jaccard_of_odd_tables(docs, empty):
    assert jaccard_join.jaccard_components(empty).count() == 0
    got = jaccard_join.jaccard_components(twice(docs)).collect()
    assert len(got) == docs.count() + 5
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_bounded_sample(spark):
    ids = spark.range(3000).select(F.col("id").alias("doc_id"))
    some = {r.doc_id for r in bounded_sample(ids, 1000).collect()}
    assert 900 < len(some) <= 1000
    assert some == {r.doc_id for r in bounded_sample(ids.orderBy(F.desc("doc_id")), 1000).collect()}
    assert bounded_sample(ids, 3000).count() == 3000
    same = ids.withColumn("doc_id", F.lit(7)).withColumn("x", F.col("doc_id"))
    assert bounded_sample(same, 100).count() <= 100
    assert bounded_sample(ids.limit(0), 10).count() == 0


def test_linked_finds_chains():
    base = np.arange(1, 101, dtype=U64)
    chain = [np.concatenate([base[k * 5 :], base[: k * 5] + U64(1000)]) for k in range(6)]
    label = jaccard_join.linked(np.arange(6) + 10, np.full(6, 100), chain, 80)
    assert label.tolist() == [10] * 6
    assert jaccard_join.linked(np.array([4, 9]), np.array([100, 100]), [chain[0], chain[5]], 80).tolist() == [4, 9]


def test_components(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, 200), (300, 200), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(21)}, 100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- decontamination -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [4_000_000, 300])
def test_decontamination_is_exact(spark, docs, texts, block):
    taken = [t for t in texts.values() if t and 80 < len(t.split()) < 130][:4]
    items = [(k, " ".join(t.upper().split()[5 : 5 + n])) for k, (t, n) in enumerate(zip(taken, (40, 10, 9, 3)))] + [(50, ""), (51, None), (52, "one"), (53, "one")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontaminate(docs, frame, block_chars=block), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute.op10(texts, items)
    assert any(x[-1] for x in got.values())


def test_decontamination_removes_spans_and_drops(spark):
    item = " ".join(f"q{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"Keep this. {item}! And {'more ' * 20}"), (2, item), (3, None)], "doc_id long, text string")
    got = rows(decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")), "kept_text", "dropped", "longest")
    assert got[1] == (f"Keep this. ! And {'more ' * 20}", False, 12)
    assert got[2] == ("", True, 12) and got[3] == ("", False, 0)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, none).where("contaminated").count() == 0
    assert decontaminate(docs.limit(0), none).count() == 0


# --- packing -------------------------------------------------------------------------------------------------


def test_packing_round_trip(docs, texts, empty):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    got = pack(docs, path, with_ids=True).toPandas()
    tokenizer = Tokenizer.from_file(path)
    for doc, parts in got.sort_values("start").groupby("doc_id"):
        ids = [*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 1]
        assert np.concatenate([np.frombuffer(x, "<u4") for x in parts.ids]).tolist() == ids
        assert parts.start.tolist() == [0, *parts.length.cumsum()[:-1]] and set(parts.doc_tokens) == {len(ids)}
        assert [zlib.crc32(x) for x in parts.ids] == parts.ids_crc32.tolist()
    assert set(got.doc_id) == set(texts)
    fill = got.sort_values("offset").groupby("sequence_id")
    assert all(x.offset.tolist() == [0, *x.length.cumsum()[:-1]] and x.length.sum() <= 2048 for _, x in fill)
    assert (fill.length.sum() < 2048).sum() <= docs.rdd.getNumPartitions()
    assert pack(empty, path).count() == 0 and pack(twice(docs), path).select("doc_id").distinct().count() == len(texts) + 1


def test_sum_of_squares_takes_the_best_level():
    rng, window = np.random.default_rng(1), 16
    packing = SumOfSquares(window)
    for size in rng.integers(1, window, 400).tolist():
        before = packing.counts.copy()

        def after(level):
            n = before.copy()
            n[level] -= level > 0
            if level + size < window:
                n[level + size] += 1
            return int((n[:window] ** 2).sum())

        best = min(after(h) for h in range(window - size + 1) if h == 0 or before[h])
        _, level = packing.place(size)
        assert after(level) == best


# --- quality -------------------------------------------------------------------------------------------------


def test_base_rules_are_exact(docs, texts, empty):
    got = rows(apply_rules(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, t in texts.items():
        b = brute.op6(t)
        assert got[i][:5] == b
        assert got[i][5] == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert not (got[i][5] and got[i][6])
    assert any(x[6] for x in got.values())
    assert apply_rules(empty).count() == 0
    assert apply_rules(twice(docs)).count() == docs.count() + 5


def test_thresholds_adapt_to_their_group(spark):
    """A share of symbols that is usual in one source is an outlier in another."""
    def text(k, symbols):
        return " ".join(f"w{k}x{j}" + ("*" if j < symbols + (k * 7 + j) % 2 else "") for j in range(80))

    data = [(k, text(k, 1), "en", "plain") for k in range(200)] + [(1000 + k, text(k, 40), "en", "code") for k in range(200)] + [(5000, text(5, 40), "en", "plain"), (5001, text(6, 40), "xx", "tiny")]
    got = rows(apply_rules(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")), "kept", "failed_rules")
    assert got[5000] == (False, "symbol_share") and all(got[1000 + k][0] for k in range(200)) and all(got[k][0] for k in range(200))


def test_native_queries_run_no_python(spark):
    for name in ("op6_adaptive_quality_rules", "op9_license_set_join"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_rule_ensemble_holds_out_and_learns(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = score_quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id)
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert (got.predicted == got.quality).mean() > 0.97


def test_rule_ensemble_of_odd_tables(spark, docs, empty, texts):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in score_quality(docs, none).collect()} == {0.5}
    assert score_quality(empty, none).count() == 0
    assert score_quality(twice(docs), none.union(spark.createDataFrame([(1, None), (None, 1)], none.schema))).count() == len(texts) + 5


def test_rules_compile_to_the_same_scores(spark):
    rng = np.random.default_rng(0)
    x = {f"f{k}": rng.random(600) for k in range(3)}
    y = ((x["f0"] > 0.5) & (x["f1"] < 0.6)).astype(float)
    model = RuleEnsemble.fit(x, y)
    frame = spark.createDataFrame([tuple(float(x[f][i]) for f in x) for i in range(600)], "f0 double, f1 double, f2 double")
    got = np.array([r.s for r in frame.select(model.score().alias("s")).collect()])
    margin = model.intercept + sum(w * r.on(x) for r, w in zip(model.rules, model.weights))
    assert np.allclose(got, 1 / (1 + np.exp(-margin))) and ((got > 0.5) == y).mean() > 0.97
    assert len(model.rules) < 200


# --- licences ------------------------------------------------------------------------------------------------


def test_license_scan(spark, docs, empty, texts):
    data = [
        (1, "CC BY. cc-by, All rights, reserved"),
        (2, "x\nLicensed under the Apache License, Version 2.0.\ny"),
        (3, "licensed under the apache version"),
        (4, "the GNU General  Public\nLicense"),
        (5, None),
        (6, "Version 2.0 of the Apache License: licensed under it"),
        (6, "nothing"),
    ]
    got = [tuple(r) for r in scan_licenses(spark.createDataFrame(data, "doc_id long, text string")).orderBy("doc_id", "n_words").collect()]
    assert got[0] == (1, 7, 3, 0, 4, "cc-by,reserved", "cc-by,reserved", 1.0)
    assert got[1] == (2, 10, 0, None, None, "", "apache-2.0", 1.0)
    assert got[2][5:] == ("", "", 0.0)
    assert got[3] == (4, 5, 1, 2, 2, "gpl", "gpl", 1.0)
    assert got[4] == (5, 0, 0, None, None, "", "", 0.0)
    assert [x[6] for x in got[5:]] == ["apache-2.0"] * 2
    assert scan_licenses(empty).count() == 0 and scan_licenses(twice(docs)).count() == len(texts) + 5


def test_license_scan_crosses_line_breaks(spark):
    data = [
        (1, "mit", "x y\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files\nz"),
        (2, "bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"),
        (3, "mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0"),
        (4, "", "Redistribution and use in source and\n" + "word " * 30 + "\nbinary forms, with or without modification"),
    ]
    got = rows(scan_licenses(spark.createDataFrame([(i, t) for i, _, t in data], "doc_id long, text string")), "labels", "score")
    assert got == {i: (label, 1.0 if label else 0.0) for i, label, _ in data}


# --- language models -----------------------------------------------------------------------------------------


def test_cross_entropy_difference_prefers_the_target(spark, docs, empty, texts):
    rng = np.random.default_rng(2)
    say = lambda low: " ".join(f"v{k}" for k in rng.integers(low, low + 30, 80))
    data = [(k, say(0 if k % 2 else 100)) for k in range(200)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    got = rows(cross_entropy_difference(frame, frame.where("doc_id % 4 = 1")), "score", "n_tokens", "target_loss", "background_loss")
    good, bad = [got[k][0] for k in range(200) if k % 4 == 3], [got[k][0] for k in range(200) if k % 2 == 0]
    assert max(good) < min(bad)
    assert all(abs(x[0] - (x[2] - x[3])) < 1e-9 and x[1] == 80 for x in got.values())
    trusted = docs.where("doc_id < 50")
    assert cross_entropy_difference(empty, trusted).count() == 0
    odd = cross_entropy_difference(twice(docs), trusted.limit(0)).collect()
    assert len(odd) == len(texts) + 5
    assert all(r.score == 0 for r in odd if r.n_tokens == 0) and not any(np.isnan(r.score) for r in odd)


@pytest.mark.parametrize("size", [8_000_000, 3_000])
def test_cross_entropy_difference_counts_whole_words(spark, docs, texts, size):
    many = {10_000 + k: " ".join(f"z{j % 90_000}" for j in range(k * 5_000, k * 5_000 + 6_000)) for k in range(20)}  # more words than any fixed table of 65,536
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(list(many.items()), "doc_id long, text string"))
    trusted = {i for i in texts if i % 3 == 0 or i < 50} | {10_000 + k for k in range(0, 20, 2)}
    got = rows(cross_entropy_difference(frame, spark.createDataFrame([(i,) for i in trusted], "doc_id long"), chunk_bytes=size), "n_tokens", "target_loss", "background_loss")
    expected = brute.op1(texts | many, trusted, 50.0)
    assert set(got) == set(expected)
    assert all(np.allclose(got[i], expected[i], rtol=1e-9, atol=1e-9) for i in expected)


# --- pages ---------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">We use cookies</div><main><article><header><h1>Title &amp; more</h1><span>by X</span></header><p>First <b>bold<br>line &lt;b&gt;
end<p>a &lt; b 1 < 2<form><input>Sign</form><aside>Side</aside><div id="comments">Nice!</div><div class="box">Box of the site</div></article></main><footer>&copy;</footer></body>"""


def test_main_text_of_furniture(spark):
    got = main_text(spark.createDataFrame([(1, "http://a.b/c", PAGE), (2, None, None), (3, "x", "")], "page_id long, url string, html string"))
    got = {r.page_id: (r.text, r.n_chars) for r in got.collect()}
    body = "Title & more First bold line <b> end a < b 1 < 2 Box of the site"
    assert got == {1: (body, len(body)), 2: ("", 0), 3: ("", 0)}


def test_style_tree_cuts_what_a_site_repeats(spark):
    pages = [(k, f"http://Host/{k}", PAGE.replace("First", f"Unique {k}").replace("Title", f"No. {k}")) for k in range(12)]
    got = main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == 12 and all("Box of the site" not in r.text and f"Unique {r.page_id} bold" in r.text for r in got)
    same = [(k, "http://host/", PAGE) for k in range(12)]
    assert all("First bold" in r.text for r in main_text(spark.createDataFrame(same, "page_id long, url string, html string")).collect())


def test_main_text_of_the_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in registry.QUERIES["op5_site_style_tree"](spark, SF).collect():
        inner = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        expected = " ".join(html.unescape(re.sub(r"<[a-z/][^>]*>", " ", inner.replace("<b>", ""))).split())
        assert (r.text, r.n_chars) == (expected, len(expected))


def family(k: int, copies: int, rng: np.random.Generator) -> list[str]:
    """Near copies of a text of 150 words, each with two words of its own, so that copies differ from each other as well."""
    base = [f"w{k}x{i}" for i in range(150)]
    out = []
    for c in range(copies):
        text = list(base)
        for at in rng.integers(0, 150, 2).tolist():
            text[at] = f"own{k}y{c}z{at}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("group_bytes", [3_000, 20_000])
def test_split_groups_lose_no_link(spark, group_bytes):
    """Families, chains between them, and strangers that share passages, in groups dealt to many blocks."""
    rng = np.random.default_rng(5)
    texts = [t for k in range(3) for t in family(k, 40, rng)]
    words = texts[0].split()
    for step in range(1, 12):  # a chain of neighbours that leads away from the first family
        texts.append(" ".join(words[6 * step :] + [f"c{i}" for i in range(6 * step)]))
    shared = " ".join(f"s{i}" for i in range(90))
    texts += [shared + " " + " ".join(f"q{k // 2}u{i}" for i in range(60)) for k in range(40)]
    rows_ = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    got = rows(jaccard_join.jaccard_components(docs, group_bytes=group_bytes), "n_shingles", "component_id")
    assert got == brute.op8(dict(rows_))
    assert len({c for _, c in got.values()}) > 4


def test_forest_joins_what_may_link():
    rng = np.random.default_rng(3)
    for n in (70, 130, 400):  # marks of one, two, four and more words
        base = rng.integers(0, 2**63, n).astype(U64)
        sets = [np.unique(np.concatenate([base[: n - cut_], rng.integers(0, 2**63, cut_).astype(U64)])) for cut_ in (0, n // 20, n // 3, n // 2)]
        sets += [base[: n - n // 10], rng.integers(0, 2**63, n).astype(U64)]
        size = np.array([len(s) for s in sets])
        marks = jaccard_join.Marks(size, np.concatenate([jaccard_join.mark(s, len(s)) for s in sets]))
        for a in range(len(sets)):
            for b in range(len(sets)):
                apart = len(np.setxor1d(sets[a], sets[b]))
                near = 100 * min(size[a], size[b]) >= 80 * max(size[a], size[b])
                assert not near or marks.differ(np.array([a]), np.array([b]))[0] <= apart
        every = np.arange(len(sets))
        a, b = jaccard_join.forest(np.zeros(len(sets), np.int64), every, size, size, marks, 80)
        label = jaccard_join.united(every, a, b)
        assert label[0] == label[1] == label[4] and len({label[0], label[3], label[5]}) == 3
