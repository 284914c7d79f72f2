"""Cross-entropy difference with matched n-gram models.

A target model (documents of a trusted subset) and a background model (all documents) share one vocabulary, the words of all documents.
Both are bigram models with Dirichlet-smoothed back-off to unigrams, and their counts are those of the corpus: nothing is capped, so they
grow with it.  A document's score is the mean over its tokens of target loss minus background loss; lower is closer to the target.  A
document's own counts are taken out of the models that hold it before it is scored (leave one out), so members of the target have no advantage.

Words and bigrams are told apart by 64-bit fingerprints.  The counts are dealt by fingerprint to buckets; a chunk of documents adds up
its own first, so a frequent word comes to its bucket once from each chunk.  A bucket adds up and answers each chunk with the totals of what it
asked for, and with its part of the vocabulary's size; a chunk then scores its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U64, WHITE, buffers, lower_ascii, mix, pieces, planes, values, word_hashes, words
from .frames import buckets, cut, small_batches, text_bytes

#: Bytes of text in a chunk and for each bucket: what one task holds at once, to raise with larger executors.
CHUNK_BYTES, BUCKET_BYTES = 8_000_000, 8_000_000
#: Trusted ids that are broadcast at most (about 16 bytes each).
BROADCAST_ROWS = 1_000_000
SMOOTHING = 50.0
#: What a text's first token follows, as the fingerprint of a word; it sorts before all words.
BEGIN = U64(0)
#: Fingerprints of a chunk's words and how often they stand in it, its tokens, and tokens, doc_id and flags of each text.
CHUNKS = "chunk long, words binary, often binary, tokens binary, n binary, ids binary, flags binary"
#: A chunk's request to a bucket: fingerprints of words and bigrams, and their counts in the chunk.
REQUEST = "bucket int, chunk long, words binary, pairs binary, counts binary"
#: The answer: counts of the words and bigrams; on one answer of each bucket the size of its vocabulary and its tokens of target and background.
REPLY = "bucket int, chunk long, words binary, pairs binary, vocabulary long, target long, background long"
SCORED = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def sorted_keys(a: np.ndarray) -> bytes:
    return planes(np.diff(a, prepend=U64(0)))


def keys_of(b: bytes) -> np.ndarray:
    return np.cumsum(values(b).view(U64), dtype=U64)


class Chunk:
    """Places of a chunk's tokens among its different words and bigrams, both in the order of their fingerprints."""

    def __init__(self, keys: np.ndarray, word: np.ndarray, n: np.ndarray):
        """keys: BEGIN and the different words, sorted; word: place of each token in it; n: tokens of each text."""
        self.keys, self.word, self.n = keys, word, n
        first = np.cumsum(n) - n
        self.previous = np.append(0, word)[: len(word)]
        self.previous[first[n > 0]] = 0
        codes, pair = np.unique(self.previous * len(keys) + word, return_inverse=True)
        pairs = mix(keys[codes // len(keys)] * U64(0x9E3779B97F4A7C15) + keys[codes % len(keys)])
        order = np.argsort(pairs)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.pairs, self.pair = pairs[order], rank[pair]

    def counts(self, wanted: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often the wanted tokens are each word, follow each word, end each bigram."""
        size = len(self.keys)
        return np.bincount(self.word[wanted], minlength=size), np.bincount(self.previous[wanted], minlength=size), np.bincount(self.pair[wanted], minlength=len(self.pairs))


def parts_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n buckets begins among sorted keys, and the end."""
    return np.append(np.searchsorted(keys, np.array([(k << 64) // n for k in range(n)], U64)), len(keys))


def packed(words_: np.ndarray, n: np.ndarray, ids: np.ndarray, flags: np.ndarray) -> tuple:
    """What CHUNKS has but the number.  Tokens are ranks by how often their word stands in the chunk, which compress better than places."""
    keys, word = np.unique(np.append(BEGIN, words_), return_inverse=True)
    often = np.bincount(word[1:], minlength=len(keys))
    rank = np.empty(len(keys), np.int64)
    rank[np.argsort(-often, kind="stable")] = np.arange(len(keys))
    return sorted_keys(keys), planes(often), planes(rank[word[1:]]), planes(n), planes(ids), planes(flags)


def unpacked(row: dict) -> tuple[Chunk, np.ndarray, np.ndarray]:
    """(chunk, doc_ids, flags)"""
    by_rank = np.argsort(-values(row["often"]), kind="stable")
    return Chunk(keys_of(row["words"]), by_rank[values(row["tokens"])], values(row["n"])), values(row["ids"]), values(row["flags"])


def chunks_of(chunk_bytes: int):
    def run(batches):
        schema = pa.schema([("chunk", pa.int64()), *((x, pa.binary()) for x in ("words", "often", "tokens", "n", "ids", "flags"))])
        at, size, held = TaskContext.get().partitionId() << 32, 0, ([], [], [], [])

        def flush():
            row = (at, *packed(*map(np.concatenate, held)))
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types)], schema=schema)

        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            flags = np.array(batch.column(2).is_valid()).astype(np.int64) + 2 * np.array(batch.column(0).is_null()).astype(np.int64)  # in the target; no id
            data, off = buffers(batch.column(1))
            for a, b in pieces(off, 2_000_000):
                if size and size + off[b] - off[a] > chunk_bytes:
                    yield flush()
                    at, size = at + 1, 0
                own = lower_ascii(data[off[a] : off[b]])
                s, e, before = words(own, off[a : b + 1] - off[a], WHITE)
                for x, y in zip(held, (word_hashes(own, s, e), np.diff(before), ids[a:b], flags[a:b])):
                    x.append(y)
                size += off[b] - off[a] + 1
        if size:
            yield flush()

    return run


def requests(n_buckets: int):
    def run(batches):
        schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), *((x, pa.binary()) for x in ("words", "pairs", "counts"))])
        for batch in batches:
            for row in batch.to_pylist():
                chunk, _, flags = unpacked(row)
                target, background = chunk.counts(np.repeat((flags & 1) > 0, chunk.n)), chunk.counts(slice(None))
                a, b = parts_of(chunk.keys, n_buckets), parts_of(chunk.pairs, n_buckets)
                out = []
                for k in range(n_buckets):
                    w, p = slice(a[k], a[k + 1]), slice(b[k], b[k + 1])
                    if w.start == w.stop and p.start == p.stop:
                        continue
                    # words and firsts of target and background, then bigrams of both
                    counts = [x[s] for x, s in ((target[0], w), (target[1], w), (background[0], w), (background[1], w), (target[2], p), (background[2], p))]
                    out.append((k, row["chunk"], sorted_keys(chunk.keys[w]), sorted_keys(chunk.pairs[p]), planes(np.concatenate(counts))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each key among the different ones, sums of the rows of counts for those)."""
    different, place = np.unique(keys, return_inverse=True)
    return place, np.stack([np.bincount(place, c, len(different)).astype(np.int64) for c in counts])


def answers(group: pa.Table) -> pa.Table:
    """Totals over all chunks, for each chunk those of its own words and bigrams."""
    rows = group.to_pylist()
    word_keys, pair_keys = [keys_of(r["words"]) for r in rows], [keys_of(r["pairs"]) for r in rows]
    counts = [values(r["counts"]) for r in rows]
    word, word_sums = added(np.concatenate(word_keys), np.concatenate([c[: 4 * len(w)].reshape(4, -1) for c, w in zip(counts, word_keys)], axis=1))
    pair, pair_sums = added(np.concatenate(pair_keys), np.concatenate([c[4 * len(w) :].reshape(2, -1) for c, w in zip(counts, word_keys)], axis=1))
    size = {"vocabulary": int((word_sums[2] > 0).sum()), "target": int(word_sums[0].sum()), "background": int(word_sums[2].sum())}
    nothing, out, w, p = dict.fromkeys(size, 0), [], 0, 0
    for r, a, b in zip(rows, map(len, word_keys), map(len, pair_keys)):
        out.append({"bucket": r["bucket"], "chunk": r["chunk"], "words": planes(word_sums[:, word[w : w + a]].ravel()), "pairs": planes(pair_sums[:, pair[p : p + b]].ravel())} | (nothing if out else size))
        w, p = w + a, p + b
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 2, *[pa.int64()] * 3]
    return pa.table({c: pa.array([r[c] for r in out], t) for c, t in zip(out[0], kinds)})


def own_counts(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often each token's key stands in its text."""
    both = (text.astype(np.int64) << 32) | key
    order = np.argsort(both, kind="stable")
    head = np.flatnonzero(np.diff(both[order], prepend=-1))
    size = np.diff(head, append=len(both))
    out = np.empty(len(both), np.float64)
    out[order] = np.repeat(size, size)
    return out


def scored(smoothing: float, total: dict[str, int]):
    def run(own: pa.Table, answered: pa.Table) -> pa.Table:
        replies = sorted(answered.to_pylist(), key=lambda r: r["bucket"])
        chunk, ids, flags = unpacked(own.to_pylist()[0])
        n = chunk.n
        of_words = np.concatenate([values(r["words"]).reshape(4, -1) for r in replies], axis=1)
        of_pairs = np.concatenate([values(r["pairs"]).reshape(2, -1) for r in replies], axis=1)
        text = np.repeat(np.arange(len(n)), n)
        inside = ((flags & 1) > 0)[text]
        mine = [own_counts(text, x) for x in (chunk.word, chunk.previous, chunk.pair)]
        means = []
        for k, model in enumerate(("target", "background")):
            word, previous, pair = mine if k else (x * inside for x in mine)
            alone = (of_words[2 * k][chunk.word] - word + 1.0) / (total[model] + total["vocabulary"])
            first, seen = of_words[2 * k + 1][chunk.previous] - previous, of_pairs[k][chunk.pair] - pair
            loss = -np.log((seen + smoothing * alone) / (first + smoothing))
            means.append(np.bincount(text, loss, len(n)) / np.maximum(n, 1))
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=(flags & 2) > 0), "n_tokens": n, "target_loss": means[0], "background_loss": means[1], "score": means[0] - means[1]})

    return run


def cross_entropy_difference(documents: DataFrame, trusted: DataFrame, smoothing: float = SMOOTHING, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) for each document; `trusted` holds the doc_ids of the target.

    Null or empty text has no tokens: losses and score are 0.  A null doc_id is background only and is scored.  Repeated rows count and
    are scored each.  With an empty target its model is uniform over the vocabulary.  Other columns are ignored.  An empty table gives an empty result."""
    spark = documents.sparkSession
    small_batches(spark)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    flags = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("_t", F.lit(True))
    # the trusted list grows with the corpus: it is broadcast behind a count only, else both sides are shuffled
    few = flags.count() <= BROADCAST_ROWS
    marked = texts.join(F.broadcast(flags) if few else flags.hint("merge"), "doc_id", "left").select("doc_id", "text", "_t")
    chunks = cut(marked.mapInArrow(chunks_of(chunk_bytes), CHUNKS))
    n = buckets(text_bytes(texts), bucket_bytes)
    answered = cut(chunks.mapInArrow(requests(n), REQUEST).groupBy("bucket").applyInArrow(answers, REPLY))
    sums = answered.agg(*(F.sum(c).alias(c) for c in ("vocabulary", "target", "background"))).first()
    total = {c: sums[c] or 0 for c in ("vocabulary", "target", "background")}
    return chunks.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(scored(smoothing, total), SCORED)
