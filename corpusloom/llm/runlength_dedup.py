"""Byte-level exact substring dedup with run-length indexes.

Every window of 50 bytes is filed under its rarest 8-byte gram (by level of frequency, then fingerprint, the leftmost of equals), so
equal windows meet in one bucket wherever they stand.  Levels come from a sample of the texts; any levels give the same result, and these
keep what many documents say by chance out of one bucket.  Windows in a row under one gram travel as one string.  A bucket drops grams
that one document alone has, folds equal strings to the smallest document that has them (a hot group of copies folds to
one string), and builds run-length indexes over the different strings of each gram: these are near-repeats, so
their transforms have few runs.  The strings are streamed through their index; a window whose match reaches 50
bytes in a smaller document is marked.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import MASK, U64, blocks, buffers, covered, expand, mix, pieces, planes, range_hashes, ranges, same, squeeze, values
from .frames import buckets, cut, small_batches, text_bytes
from .repeats import SPANS, keyed, rows, without_spans
from .runindex import smallest_owner

#: Bytes in a window, and in the gram that files it.
WINDOW, GRAM = 50, 8


def gram_hashes(blocked: np.ndarray, places: np.ndarray | slice, gram: int) -> np.ndarray:
    """Fingerprints of the `gram` bytes from each place on, given the blocks of the bytes."""
    out = mix(blocked[places] & MASK[min(gram, 8)])
    for k in range(8, gram, 8):
        k = min(k, gram - 8)
        out = mix(out ^ mix(blocked[k:][places] + U64(k)))
    return out


#: Slots of gram fingerprints that are counted for their frequency, characters of a text and of all texts that the count takes at most.
SLOT_BITS, SAMPLE_TEXT, SAMPLE = 20, 4_000, 8_000_000


def frequency_levels(texts: pa.Array, gram: int) -> np.ndarray:
    """A level of 0 to 15 for each slot of gram fingerprints: how often its grams stand in the texts, by powers of two."""
    data, off = buffers(texts)
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    for a, b in pieces(off, 2_000_000):
        part = data[off[a] : off[b]]
        if len(part) >= gram:
            counts += np.bincount((gram_hashes(blocks(part), slice(0, len(part) - gram + 1), gram) >> U64(64 - SLOT_BITS)).astype(np.int64), minlength=len(counts))
    return np.clip(np.log2(np.maximum(counts, 1) / max(1, len(data)) * len(counts)), 0, 15).astype(np.uint8)


def sampled_levels(documents: DataFrame, size: int, gram: int) -> np.ndarray:
    """frequency_levels of the beginnings of some texts, dealt by a hash of the text; size: bytes of all."""
    text = F.col("text").cast("string")
    some = documents.where(F.pmod(F.xxhash64(text), F.lit(max(1, -(-size // SAMPLE)))) == 0).select(F.substring(text, 1, SAMPLE_TEXT).alias("text"))
    return frequency_levels(some.limit(SAMPLE // 1000).toArrow()["text"], gram)


def filed(data: np.ndarray, off: np.ndarray, window: int, gram: int, levels: np.ndarray):
    """Runs of windows under one gram: (text, first window's byte in the piece, windows, bytes before the gram in the first window, anchor)."""
    per = np.maximum(np.diff(off) - window + 1, 0)
    start = ranges(off[:-1], per)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, U64)
    grams = gram_hashes(blocks(data), slice(0, len(data) - gram + 1), gram)
    least = (levels[(grams >> U64(64 - SLOT_BITS)).astype(np.int64)].astype(U64) << U64(60)) | ((grams << U64(16)) >> U64(36) << U64(32))
    least |= np.arange(len(grams), dtype=U64)
    width, have = window - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    at = (least[start] & U64(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.diff(at, prepend=-1))
    return np.repeat(np.arange(len(per)), per)[head], start[head], np.diff(head, append=len(start)), (at - start)[head], mix(grams[at[head]])


#: Bytes of text for each bucket, to raise with larger executors.
BUCKET_BYTES = 4_000_000
#: Bytes of text and number of strings that a task gathers before it sends each bucket its row, and strings in a row.  There is a row for
#: each bucket and each gathering, so both sizes bound how the rows' number grows.
GATHER_BYTES, GATHER_STRINGS, ROW_STRINGS = 32_000_000, 2_000_000, 200_000
PACKED = ("docs", "prints", "starts", "counts", "befores", "body")
RUNS = "bucket int, " + ", ".join(f"{x} binary" for x in PACKED)


def sent(held: list[tuple], window: int):
    """Rows of the gathered strings by bucket; held: (bytes, their offsets, doc_ids, prints, then of each string: bucket, text, start, windows, bytes before)."""
    if not held:
        return
    schema = pa.schema([("bucket", pa.int32()), *((x, pa.binary()) for x in PACKED)])
    body, base, ids, prints, *strings = zip(*held)
    sizes, texts = [len(x) for x in body], [len(x) for x in ids]
    body, ids, prints = np.concatenate(body), np.concatenate(ids), np.concatenate(prints)
    base = np.concatenate([x[:-1] + shift for x, shift in zip(base, np.cumsum([0, *sizes[:-1]]))])
    many = [len(x) for x in strings[0]]
    bucket, text, start, count, before = (np.concatenate(x) for x in strings)
    text, start = text + np.repeat(np.cumsum([0, *texts[:-1]]), many), start + np.repeat(np.cumsum([0, *sizes[:-1]]), many)
    order = np.argsort(bucket, kind="stable")
    bucket, text, start, count, before = bucket[order], text[order], start[order], count[order], before[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    edges = np.append(first, len(bucket))
    edges = [k for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) for k in range(a, b, ROW_STRINGS)] + [len(bucket)]
    step = max(1, len(edges) * 100_000 // len(bucket))  # rows in a batch: of 3 MB or so
    for k in range(0, len(edges) - 1, step):
        spans = [slice(i, j) for i, j in zip(edges[k : k + step], edges[k + 1 : k + step + 1])]
        yield rows(schema, [
            [bucket[x.start] for x in spans],
            *([planes(of(x)) for x in spans] for of in (
                lambda x: ids[text[x]], lambda x: prints[text[x]], lambda x: start[x] - base[text[x]], lambda x: count[x], lambda x: before[x],
            )),
            [squeeze(body[ranges(start[x], count[x] + window - 1)]) for x in spans],
        ])


def emitter(window: int, gram: int, levels: np.ndarray):
    def emit(n: int, gather_bytes: int = GATHER_BYTES):
        def run(batches):
            held, size, strings = [], 0, 0
            for batch in batches:
                ids, prints = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
                data, off = buffers(batch.column(1))
                for a, b in pieces(off, 2_000_000):
                    part, base = data[off[a] : off[b]], off[a : b + 1] - off[a]
                    text, start, count, before, anchor = filed(part, base, window, gram, levels)
                    if not len(text):
                        continue
                    if held and (size + len(part) > gather_bytes or strings + len(text) > GATHER_STRINGS):
                        yield from sent(held, window)
                        held, size, strings = [], 0, 0
                    bucket = (anchor >> U64(32)) % U64(n)
                    held.append((part, base, ids[a:b], prints[a:b], *(x.astype(np.int32) for x in (bucket, text, start, count, before))))
                    size, strings = size + len(part), strings + len(text)
            yield from sent(held, window)

        return run

    return emit


def in_two(key: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Mask of rows whose key two documents have."""
    order = np.argsort(key)
    head = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
    d, out = docs[order], np.zeros(len(key), bool)
    if len(head):
        out[order] = np.repeat(np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head), np.diff(head, append=len(order)))
    return out


def trimmed(body, blocked, at, anchor, docs, count, before, window: int, gram: int, parts: int = 4):
    """(string, windows skipped, windows left): the strings cut to windows that may be shared.

    A window with b bytes before its gram belongs to one of `parts` ranges [low, high] of b, and holds the bytes from `low` before the
    gram to window - high after its start.  Where no two documents share these bytes, none of the range's windows is shared."""
    least, most = before - count + 1, before
    top = window - gram
    low_b, high_b = np.full(len(at), top + 1), np.full(len(at), -1)
    rows_, keys, edges = [], [], np.linspace(0, top + 1, parts + 1).astype(int)
    for low, high in zip(edges[:-1], edges[1:] - 1):
        i = np.flatnonzero((most >= low) & (least <= high))
        gram_at = at[i] + before[i]
        rows_.append((i, low, high))
        keys.append(range_hashes(body, gram_at - low, gram_at + window - high, blocked) ^ mix(anchor[i] + U64(low)))
    shared = in_two(np.concatenate(keys), np.concatenate([docs[i] for i, _, _ in rows_]))
    for i, low, high in rows_:
        mine, shared = i[shared[: len(i)]], shared[len(i) :]
        low_b[mine] = np.minimum(low_b[mine], low)
        high_b[mine] = np.maximum(high_b[mine], high)
    low_b, high_b = np.maximum(low_b, least), np.minimum(high_b, most)
    keep = np.flatnonzero(low_b <= high_b)
    return keep, (most - high_b)[keep], (high_b - low_b + 1)[keep]


def folded(body, blocked, at, length, anchor, docs):
    """(order, new): strings in an order by anchor and content, the smallest document first, and whether each begins a new content.
    Equality is of the bytes."""
    print_ = range_hashes(body, at, at + length, blocked)
    while True:
        order = np.lexsort((docs, print_, anchor))
        new = np.ones(len(order), bool)
        new[1:] = (print_[order][1:] != print_[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])
        again = np.flatnonzero(~new)
        here, before = order[again], order[again - 1]
        if same(body, at[here], at[here] + length[here], body, at[before], at[before] + length[before], blocked).all():
            return order, new
        seen: dict[bytes, int] = {}  # two contents under one fingerprint: tell them apart by their bytes
        print_ = np.array([seen.setdefault(body[i : i + n].tobytes(), len(seen)) for i, n in zip(at.tolist(), length.tolist())], U64)


#: Strings of a bucket whose windows are looked up at once.
SLICE = 100_000


def judge_with(window: int, gram: int):
    def judge(group: pa.Table) -> pa.Table:
        docs, rows_, start, count, before = (np.concatenate([values(x) for x in group[c].to_pylist()]) for c in PACKED[:-1])
        body = np.concatenate([expand(x, np.uint8) for x in group["body"].to_pylist()])
        gram_at = np.cumsum(count + window - 1) - (count + window - 1) + before
        blocked = blocks(body)
        anchor = mix(gram_hashes(blocked, gram_at, gram))
        length = count + window - 1
        at = np.cumsum(length) - length
        keep = np.flatnonzero(in_two(anchor, docs))
        docs, rows_, start, count, anchor, before, length, at = (x[keep] for x in (docs, rows_, start, count, anchor, before, length, at))
        out = ([], [], [], [])
        if len(keep):
            keep, skipped, count = trimmed(body, blocked, at, anchor, docs, count, before, window, gram)
            docs, rows_, start, anchor, at, length = docs[keep], rows_[keep], start[keep] + skipped, anchor[keep], at[keep] + skipped, count + window - 1
        if len(keep):
            # equal strings of one gram fold to the smallest document
            order, new = folded(body, blocked, at, length, anchor, docs)
            first = order[new]  # the different strings, each by its smallest document
            kind = np.empty(len(order), np.int64)
            kind[order] = np.cumsum(new) - 1
            group_of = np.cumsum(np.diff(anchor[first], prepend=~anchor[first[:1]]) != 0) - 1
            several = np.bincount(group_of)[group_of] > 1
            windows = count[first]
            least = np.repeat(docs[first], windows)
            some = first[several]
            if len(some):
                found = smallest_owner(body[ranges(at[some], length[some])], length[some], docs[some], group_of[several], window)
                least[np.repeat(several, windows)] = found
            from_ = (np.cumsum(windows) - windows)[kind]
            found = []
            for k in range(0, len(docs), SLICE):
                x = slice(k, k + SLICE)
                doc, row, byte = np.repeat(docs[x], count[x]), np.repeat(rows_[x], count[x]), ranges(start[x], count[x])
                later = doc > least[ranges(from_[x], count[x])]
                doc, row, byte = doc[later], row[later], byte[later]
                edge = np.flatnonzero((np.diff(byte, prepend=-9) != 1) | (np.diff(doc, prepend=-1) != 0) | (np.diff(row, prepend=0) != 0))
                found.append((doc[edge], row[edge], byte[edge], np.append(byte[edge[1:] - 1], byte[-1:]) + window if len(edge) else byte[edge]))
            out = tuple(np.concatenate(x) for x in zip(*found))
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("doc_id", "print", "start", "stop"), out, types)})

    return judge


def finish(batches):
    import pyarrow as pa

    for batch in batches:
        cols = {name: batch.column(name) for name in batch.schema.names}
        starts, stops = cols["_starts"].to_pylist(), cols["_stops"].to_pylist()
        n_bytes, n_removed, n_spans, sums, left = [], [], [], [], []
        for i, text in enumerate(cols["text"]):
            raw = (text.as_py() or "").encode()
            kept, spans = raw, 0
            if starts[i]:
                mask = covered(len(raw), np.array(starts[i]), np.array(stops[i]))
                kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                spans = int(np.count_nonzero(np.diff(mask.astype(np.int8), prepend=0) == 1))
            n_bytes.append(len(raw))
            n_removed.append(len(raw) - len(kept))
            n_spans.append(spans)
            sums.append(hashlib.sha256(kept).hexdigest())
            left.append(kept)
        carried = [c for c in cols if c not in ("doc_id", "text", "_starts", "_stops")]
        arrays = [cols["doc_id"], *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(sums, pa.string()), pa.array(left, pa.binary()), *(cols[c] for c in carried)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes", *carried])


def dedup_bytes(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, carry: list[str] = [], bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes, *carry): every byte removed that a `window`-byte string
    covers which also starts in a document with a smaller doc_id; matches never cross documents.

    Null text is empty.  Texts under `window` bytes lose nothing.  Repeats inside one document stay.  Rows that share a doc_id are judged
    each and never take bytes from one another.  A null doc_id takes no part: its text stays.  Other columns are ignored unless named in
    `carry`, where doc_id, text, _print, _starts and _stops are refused.  An empty table gives an empty result.
    kept_bytes may cut a character; it is bytes for that reason.  A text is held whole by one task, at about 55 bytes of memory for each of its bytes."""
    small_batches(documents.sparkSession)
    types, gram = dict(documents.dtypes), min(gram, window)
    size = text_bytes(documents)
    n, levels = buckets(size, bucket_bytes), sampled_levels(documents, size, gram)
    runs = keyed(documents).where("doc_id is not null").mapInArrow(emitter(window, gram, levels)(n), RUNS)
    spans = cut(runs.groupBy("bucket").applyInArrow(judge_with(window, gram), SPANS))
    finished = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary" + "".join(f", `{c}` {types[c]}" for c in carry)
    return without_spans(documents, spans, finish, finished, carry)
