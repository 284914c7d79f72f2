"""Rows that share a doc_id, texts made to collide under polynomial fingerprints, wide windows, and hot passages."""

import collections
import hashlib
import random

import numpy as np
import pytest

from corpusloom.llm import registry
from corpusloom.llm.arrays import range_hashes, same, window_hashes, word_hashes
from corpusloom.llm.decontaminate import decontaminate
from corpusloom.llm.jaccard_join import jaccard_components
from corpusloom.llm.packing import pack
from corpusloom.llm.recompression import dedup_substrings
from corpusloom.llm.runlength_dedup import dedup_bytes
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(k).count("1") & 1] for k in range(n))


def expected_repeats(rows, split, width):
    """Of (doc_id, text) rows: (doc_id, pieces, removed)."""
    pieces = [(i, split(t or "")) for i, t in rows]
    first = {}
    for i, p in sorted(pieces, key=lambda x: x[0]):
        for k in range(len(p) - width + 1):
            first.setdefault(tuple(p[k : k + width]), i)
    out = []
    for i, p in pieces:
        gone = brute.covered(len(p), [k for k in range(len(p) - width + 1) if first[tuple(p[k : k + width])] < i], width)
        kept = [x for x, g in zip(p, gone) if not g]
        out.append((i, len(p), sum(gone), kept))
    return out


def check_repeats(spark, rows, window=50, **options):
    got = dedup_substrings(frame(spark, rows), window=window, **options).collect()
    want = [(i, n, r, hashlib.sha256(b" ".join(k)).hexdigest()) for i, n, r, k in expected_repeats(rows, lambda t: t.encode().split(), window)]
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == collections.Counter(want)
    got = dedup_bytes(frame(spark, rows), window=window).collect()
    want = [(i, n, r, hashlib.sha256(bytes(k)).hexdigest()) for i, n, r, k in expected_repeats(rows, lambda t: t.encode(), window)]
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == collections.Counter(want)


def body(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


@pytest.mark.parametrize(
    "rows",
    [
        [(1, body(1)), (5, "z z z " + body(1)), (5, "short")],
        [(1, body(1)), (5, body(1)), (5, body(2))],
        [(5, body(1)), (5, body(1)), (5, "x " + body(1)), (7, body(1) + " y")],
    ],
)
def test_rows_that_share_a_doc_id_are_judged_each(spark, rows):
    check_repeats(spark, rows)


@pytest.mark.parametrize("window", [3, 50, 400])
def test_windows_of_any_width(spark, window):
    rng = random.Random(window)
    long = " ".join(f"v{rng.randrange(300)}" for _ in range(900))
    check_repeats(spark, [(1, long), (2, long), (3, "a b " + long[: len(long) // 2]), (4, "q " * 500), (9, "q " * 700)], window)


@pytest.mark.parametrize("rounds, size", [(0, 8_000_000), (5, 500), (12, 3_000)])
def test_rounds_and_small_chunks(spark, rounds, size):
    rng = random.Random(1)
    passage = body(3, 70)
    rows = [(k, " ".join(f"u{rng.randrange(40)}" for _ in range(rng.randrange(30, 120))) + (f" {passage} " + body(k, 20)) * (k % 3 == 0)) for k in range(60)]
    check_repeats(spark, rows, rounds=rounds, chunk_bytes=size, bucket_bytes=size)


def test_a_passage_in_all_documents_with_other_surroundings(spark):
    passage = body(7, 55)
    check_repeats(spark, [(k, f"{body(100 + k, 30)} {passage} {body(900 + k, 30)}") for k in range(80)], chunk_bytes=4_000)


def test_thue_morse_words(spark, tmp_path):
    for n in (1024, 2048):
        one, two = thue_morse(n), thue_morse(n, "ba")
        data = np.frombuffer((one + two).encode(), np.uint8)
        starts, ends = np.array([0, n]), np.array([n, 2 * n])
        assert len(set(word_hashes(data, starts, ends).tolist())) == 2
        assert same(data, starts, ends, data, starts[::-1], ends[::-1]).tolist() == [False, False]
        lead = [f"x{k}" for k in range(30)]
        rows = [(1, " ".join([*lead, one, *lead])), (2, " ".join([*lead, two, *lead]))]
        check_repeats(spark, rows)
        got = {r.doc_id: r.component_id for r in jaccard_components(frame(spark, rows)).collect()}
        assert got == {i: c for i, (_, c) in brute.op8(dict(rows)).items()}
        item = " ".join([*lead[:9], one])
        docs = {1: " ".join([*lead[:9], two]), 2: f"z {item}"}
        got = decontaminate(frame(spark, list(docs.items())), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == brute.op10(docs, [(1, item)])
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(registry.tokenizer_path())
        packed = pack(frame(spark, rows), registry.tokenizer_path(), with_ids=True).toPandas().sort_values("start")
        for doc, parts in packed.groupby("doc_id"):
            ids = np.concatenate([np.frombuffer(x, "<u4") for x in parts.ids]).tolist()
            assert ids == [*tokenizer.encode(dict(rows)[doc], add_special_tokens=False).ids, 1]


def test_thue_morse_orders_of_words(spark):
    one, two = thue_morse(2048), thue_morse(2048, "ba")
    symbols = np.frombuffer((one + two).encode(), np.uint8).astype(np.uint64)
    assert len(set(window_hashes(symbols, 2048).tolist())) == 2049 - 2048 + 2048
    check_repeats(spark, [(1, " ".join(one)), (2, " ".join(two))], 1024)


def test_fingerprints_take_every_byte():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 4000).astype(np.uint8)
    starts = np.arange(0, 3600, 200)
    for n in (1, 7, 8, 9, 63, 64, 127, 128, 129, 200):
        for place in (0, n // 2, n - 1):
            other = data.copy()
            other[starts + place] ^= 1
            a, b = range_hashes(data, starts, starts + n), range_hashes(other, starts, starts + n)
            assert (a != b).all()
            assert not same(data, starts, starts + n, other, starts, starts + n).any()
            assert same(data, starts, starts + n, data.copy(), starts, starts + n).all()


def test_two_texts_under_one_doc_id_keep_their_links(spark):
    rng = random.Random(4)
    words = lambda: [f"w{rng.randrange(10**6)}" for _ in range(100)]
    near = lambda w: " ".join([*w[:-1], "other"])
    a, b = words(), words()
    rows = [(5, " ".join(a)), (5, " ".join(b)), (9, near(a)), (11, near(b)), (3, near(b) + " end")]
    got = sorted((r.doc_id, r.component_id) for r in jaccard_components(frame(spark, rows)).collect())
    assert got == [(3, 3), (5, 3), (5, 5), (9, 5), (11, 3)]


def test_names_that_operators_take_are_refused(spark):
    docs = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, _starts int")
    for operator in (dedup_substrings, dedup_bytes):
        with pytest.raises(ValueError):
            operator(docs, carry=["_starts"])


def test_items_without_an_id_or_in_pieces(spark):
    long = " ".join(f"i{k}" for k in range(3000))
    docs = {1: "a " + " ".join(f"i{k}" for k in range(1490, 1520)) + " b", 2: "None i1 i2"}
    items = spark.createDataFrame([("L", long), (None, " ".join(f"i{k}" for k in range(1495, 1507))), ("None", "zz")], "item_id string, text string")
    for block in (2_000_000, 3_000):
        got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in decontaminate(frame(spark, list(docs.items())), items, block_chars=block).collect()}
        assert got == {1: (30, 1, hashlib.sha256(b"L").hexdigest()), 2: (0, 0, hashlib.sha256(b"").hexdigest())}
