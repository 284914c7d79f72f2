"""op3 at size: rows between tasks follow the text, and frequent grams gather no windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from corpusloom.llm import runlength_dedup as op3

FLAT = np.zeros(1 << 20, np.uint8)


def prose(n: int, common: bytes, seed: int) -> bytes:
    """Words that never come again, with a common one between them."""
    letters = np.random.default_rng(seed).integers(97, 123, (n, 9), dtype=np.uint8)
    return common.join(x.tobytes() for x in letters)


def batches(texts: list[bytes], size: int) -> list[pa.RecordBatch]:
    ids = pa.array(range(len(texts)), pa.int64())
    return pa.table({"doc_id": ids, "text": pa.array([x.decode() for x in texts]), "_print": ids}).to_batches(max_chunksize=size)


def strings(out: list[pa.RecordBatch]) -> list[tuple]:
    found = []
    for batch in out:
        for row in batch.to_pylist():
            docs, prints, starts, counts, befores = (op3.values(row[c]) for c in op3.PACKED[:-1])
            body, at = op3.expand(row["body"], np.uint8), 0
            for d, p, s, c, b in zip(*(x.tolist() for x in (docs, prints, starts, counts, befores))):
                found.append((row["bucket"], d, p, s, c, b, body[at : at + c + 49].tobytes()))
                at += c + 49
            assert at == len(body)
    return sorted(found)


def test_rows_follow_gatherings_not_batches(monkeypatch):
    texts = [prose(40, b" of the ", k) for k in range(60)]
    out = list(op3.emitter(50, 8, FLAT)(5)(batches(texts, 3)))
    assert sum(b.num_rows for b in out) == 5  # one for each bucket, where each of 20 batches sent its own
    whole = strings(out)
    assert sum(c for *_, c, _, _ in whole) == sum(len(x) - 49 for x in texts)
    assert all(text == texts[d][s : s + c + 49] and text[b : b + 8] for _, d, _, s, c, b, text in whole)
    monkeypatch.setattr(op3, "ROW_STRINGS", 7)
    assert strings(list(op3.emitter(50, 8, FLAT)(5, 1_000)(batches(texts, 3)))) == whole


def test_frequent_grams_file_few_windows():
    texts = [prose(200, b" to the ", k) for k in range(40)]
    levels = op3.frequency_levels(pa.array([x.decode() for x in texts[::4]]), 8)

    def most(levels):
        data = np.frombuffer(b"".join(texts), np.uint8)
        off = np.cumsum([0, *map(len, texts)])
        _, start, count, before, anchor = op3.filed(data, off, 50, 8, levels)
        assert count.sum() == sum(len(x) - 49 for x in texts)
        at = start + before
        return sum(count[[data[i : i + 8].tobytes() == b" to the " for i in at.tolist()]]) / count.sum()

    flat = FLAT.copy()
    assert most(levels) == 0
    # the worst case of an order by fingerprint alone: the common gram comes first
    common = int(op3.gram_hashes(op3.blocks(np.frombuffer(b" to the ", np.uint8)), slice(0, 1), 8)[0] >> np.uint64(44))
    flat[:] = 1
    flat[common] = 0
    assert most(flat) > 0.9


def test_levels_of_little_text():
    for texts in ([], [None, ""], ["short"], ["twelve bytes"]):
        levels = op3.frequency_levels(pa.array(texts, pa.string()), 8)
        assert len(levels) == 1 << 20 and levels.max() <= 15
