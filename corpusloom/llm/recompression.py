"""Substring dedup on words by recompression.

Each text is a string of word symbols; chunks of texts hold them.  Rounds of recompression rename it: maximal runs of one symbol become
one symbol, then adjacent pairs (left class, right class) become one, the class being a bit of what a symbol stands for.  Naming is a
Spark round: every chunk sends the different words, runs and pairs that it has to the buckets they are dealt to; a bucket compares
them in full, numbers those that two texts have, and answers each chunk.  So a name stands for one string of words, equal substrings
have the same interior symbols everywhere, and a symbol that one text alone has gets no name.

With each symbol goes the range of words its naming looked at.  A window of 50 words with a nameless symbol's range in it stands
nowhere else and is given up at once; what no window needs any more is merged into blocks without a name, so after a few
rounds little but repeated passages is left.  A window is filed under one of its interior symbols of the last two levels, or its first word.  In the end the
windows filed under one symbol meet, each chunk's equal stretches folded to their smallest document, and are verified on the names of their words:
ranks of pairs of ranks of 1, 2, 4, ... names give equal windows, and nothing else, equal ranks.

A chunk writes its state after each round, so a lost executor costs one round.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .arrays import U64, WHITE, buffers, covered, expand, kinds, mix, pieces, planes, range_hashes, ranges, squeeze, values, word_kinds, words
from .frames import Written, buckets, cut, small_batches, text_bytes
from .repeats import OWN, SPANS, keyed, rows, without_spans

#: Words in a window.
WINDOW = 50
#: Rounds of run and pair naming; symbols grow by about a third in each.
ROUNDS = 4
#: Bytes of text in a chunk and for each bucket: what one task holds at once, to raise with larger executors.
CHUNK_BYTES, BUCKET_BYTES = 8_000_000, 8_000_000
#: Beyond any range.
FAR = 1 << 60

CHUNKS = "chunk long, docs binary, prints binary, n binary, tokens binary, bytes binary, lengths binary"
FIELDS = ("docs", "prints", "n", "starts", "anchors", "words", "symbols", "sizes", "back", "ahead")
STATE = "chunk long, " + ", ".join(f"{x} binary" for x in FIELDS)
#: Definitions that a chunk sends to a bucket: of words their bytes, of symbols two runs (symbol, length; the second may be none); and which of them two texts of the chunk have.
REQUEST = "bucket int, chunk long, defined binary, lengths binary, several binary"
#: Their names, 0 for those that one text alone has.
REPLY = "bucket int, chunk long, names binary"
STRINGS = "bucket int, chunk long, docs binary, counts binary, names binary"
LEAST = "bucket int, chunk long, least binary"


def arrow(schema: str) -> pa.Schema:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(c, types[t]) for c, t in (x.split(" ") for x in schema.split(", "))])


def batch_of(schema: str, row: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow(schema))], schema=arrow(schema))


def nothing(schema: str) -> pa.Table:
    return arrow(schema).empty_table()


# --- chunks --------------------------------------------------------------------------------------------------


def spread(hashes: np.ndarray, n: int) -> np.ndarray:
    return (hashes % U64(n)).astype(np.int64)


def chunks_of(chunk_bytes: int, window: int, n_buckets: int):
    """Chunks of the texts with a window's words at least.  Different words lie by bucket and fingerprint."""

    def run(batches):
        at, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            data = np.concatenate([x[0] for x in held])
            shift = np.cumsum([0, *(len(x[0]) for x in held)])
            starts, ends = (np.concatenate([x[k] + s for x, s in zip(held, shift)]) for k in (1, 2))
            n, docs, prints = (np.concatenate([x[k] for x in held]) for k in (3, 4, 5))
            hashes, sample, which = word_kinds(data, starts, ends)
            order = np.lexsort((hashes, spread(hashes, n_buckets)))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            s, length = starts[sample[order]], (ends - starts)[sample[order]]
            row = (at, planes(docs), planes(prints), planes(n), planes(rank[which]), squeeze(data[ranges(s, length)]), planes(length))
            held.clear()
            return batch_of(CHUNKS, row)

        for batch in batches:
            ids, prints = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 2))
            data, off = buffers(batch.column(1))
            for a, b in pieces(off, 2_000_000):
                part = data[off[a] : off[b]]
                s, e, before = words(part, off[a : b + 1] - off[a], WHITE)
                n = np.diff(before)
                keep = n >= window
                if not keep.any():
                    continue
                if size and size + len(part) > chunk_bytes:
                    yield flush()
                    at, size = at + 1, 0
                of_kept = np.repeat(keep, n)
                held.append((part, s[of_kept], e[of_kept], n[keep], ids[a:b][keep], prints[a:b][keep]))
                size += len(part)
        if held:
            yield flush()

    return run


def text_of(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the gap before each text, and of the last gap): a gap stands before each text and after the last one."""
    gaps = np.append(0, np.cumsum(n + 1))
    return gaps[:-1], gaps[-1]


def several_texts(code: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Which of n codes stand in two texts; texts ascend."""
    first, last = np.full(n, -1), np.full(n, -1)
    last[code] = text
    first[code[::-1]] = text[::-1]
    return first != last


def request_words(n_buckets: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n, tokens, body, length = values(row["n"]), values(row["tokens"]), expand(row["bytes"], np.uint8), values(row["lengths"])
                several = several_texts(tokens, np.repeat(np.arange(len(n)), n), len(length))
                upto = np.append(0, np.cumsum(length))
                bucket = spread(range_hashes(body, upto[:-1], upto[1:]), n_buckets)
                edge = np.flatnonzero(np.diff(bucket, prepend=-1))
                for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(bucket)]):
                    yield batch_of(REQUEST, (int(bucket[i]), row["chunk"], squeeze(body[upto[i] : upto[j]]), planes(length[i:j]), squeeze(several[i:j])))

    return run


# --- naming --------------------------------------------------------------------------------------------------


def numbered(which: np.ndarray, different: int, chunk: np.ndarray, several: np.ndarray, bucket: int, n_buckets: int, number: int) -> np.ndarray:
    """A name for each definition that two texts have, 0 for the others; `which`: the different definitions' numbers."""
    shared = several_texts(which, chunk, different)
    np.logical_or.at(shared, which, several)
    name = np.where(shared, ((np.arange(different) * n_buckets + bucket) << 5) + number + 1, 0)
    return name[which]


def named(n_buckets: int, number: int):
    """A round's naming in one bucket; round 0 names words."""

    def of_words(defined: list[np.ndarray], lengths: list[np.ndarray]):
        body, length = np.concatenate(defined), np.concatenate(lengths)
        upto = np.append(0, np.cumsum(length))
        s, e = upto[:-1], upto[1:]
        _, sample, which = word_kinds(body, s, e)
        return which, len(sample)

    def of_symbols(defined: list[np.ndarray]):
        parts = np.concatenate([d.reshape(4, -1) for d in defined], axis=1)
        sample, which = kinds(definition_hashes(parts))
        if (parts == parts[:, sample[which]]).all():
            return which, len(sample)
        different, which = np.unique(parts, axis=1, return_inverse=True)
        return which.ravel(), different.shape[1]

    def run(group: pa.Table) -> pa.Table:
        got = sorted(group.to_pylist(), key=lambda r: r["chunk"])
        several = [expand(r["several"], bool) for r in got]
        if number == 0:
            which, different = of_words([expand(r["defined"], np.uint8) for r in got], [values(r["lengths"]) for r in got])
        else:
            which, different = of_symbols([values(r["defined"]) for r in got])
        n = np.array([len(x) for x in several])
        names = numbered(which, different, np.repeat(np.arange(len(got)), n), np.concatenate(several), got[0]["bucket"], n_buckets, number)
        upto = np.append(0, np.cumsum(n))
        out = [batch_of(REPLY, (r["bucket"], r["chunk"], planes(names[i:j]))) for r, i, j in zip(got, upto, upto[1:])]
        return pa.Table.from_batches(out)

    return run


def definition_hashes(parts: np.ndarray) -> np.ndarray:
    """Of columns (symbol, length, symbol, length)."""
    out = mix(parts[0].view(U64) + U64(0x9FB21C651E98DF25))
    for k in (1, 2, 3):
        out = mix(out ^ mix(parts[k].view(U64) + U64(k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)))
    return out


# --- a chunk's symbols ---------------------------------------------------------------------------------------


def least_of(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The least key of each range, none of them empty, from the least of all ranges of 1, 2, 4, ... keys."""
    n, out, level, width = ends - starts, np.empty(len(starts), keys.dtype), keys, 1
    while len(n):
        mine = (n >= width) & (n < 2 * width)
        out[mine] = np.minimum(level[starts[mine]], level[ends[mine] - width])
        if int(n.max()) < 2 * width:
            break
        level, width = np.minimum(level[:-width], level[width:]), 2 * width
    return out


class State:
    """A chunk after some rounds.  Positions count words and gaps.  `starts`, `anchors`: windows that may be shared and the symbols they are filed under;
    `words`: names of words by position, 0 where no such window is; symbols cover all positions, those of name 0 hold what is given up, gaps included;
    `back`, `ahead`: how far beyond a symbol its naming looked."""

    def __init__(self, window: int, **fields: np.ndarray):
        self.window = window
        for k in FIELDS:
            setattr(self, k, fields[k])

    @property
    def size(self) -> int:
        return int(self.n.sum()) + len(self.n) + 1

    def needed(self) -> np.ndarray:
        step = np.zeros(self.size + 1, np.int64)
        step[self.starts] = 1
        step[self.starts + self.window] -= 1
        return np.cumsum(step[:-1]) > 0

    def row(self, chunk: int) -> pa.Table:
        if not len(self.starts):
            return nothing(STATE)  # nothing of this chunk can be a repeat
        packed = {k: getattr(self, k) for k in FIELDS} | {"starts": np.diff(self.starts, prepend=0), "words": self.words[self.needed()]}
        return pa.Table.from_batches([batch_of(STATE, (chunk, *(planes(packed[k]) for k in FIELDS)))])

    @classmethod
    def of(cls, row: dict, window: int) -> State:
        fields = {k: values(row[k]) for k in FIELDS}
        fields["starts"] = np.cumsum(fields["starts"])
        out = cls(window, **fields)
        held = np.zeros(out.size, np.int64)
        held[out.needed()] = out.words
        out.words = held
        return out

    def wanted(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which ranges lie in a window that may be shared."""
        upto = np.zeros(self.size + 1, np.int64)
        upto[1:][self.starts] = 1
        np.cumsum(upto, out=upto)
        out = (high - low <= self.window) & (low >= 0)
        out[out] = upto[low[out] + 1] > upto[np.maximum(high[out] - self.window, 0)]
        return out

    def settle(self, symbols: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, lost: np.ndarray, left_rounds: int) -> State:
        """`lost` symbols have got no name: windows around their ranges go, then symbols that no window needs.  In the last round a window is
        filed under the least of its interior symbols by a hash, which many windows in a row share, in the one before under the leftmost."""
        lost = lost & (high - low <= self.window) & (low >= 0)
        step = np.bincount(np.maximum(high[lost] - self.window, 0), minlength=self.size + 1) - np.bincount(low[lost] + 1, minlength=self.size + 1)
        left = np.cumsum(step)[self.starts] == 0
        self.starts, self.anchors = self.starts[left], self.anchors[left]
        symbols = np.where((symbols != 0) & self.wanted(low, high), symbols, 0)
        head = np.ones(len(symbols), bool)
        head[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
        at = np.flatnonzero(head)
        self.symbols, self.sizes = symbols[at], np.add.reduceat(sizes, at)
        first = np.cumsum(self.sizes) - self.sizes
        alive = self.symbols != 0
        self.back, self.ahead = np.where(alive, first - low[at], 0), np.where(alive, high[at] - first - self.sizes, 0)
        low, high, named_ = low[at][alive], high[at][alive], self.symbols[alive]
        if len(named_) and left_rounds <= 1:
            i, stop = np.searchsorted(low, self.starts), np.searchsorted(high, self.starts + self.window, "right")  # those whose range begins and ends in the window
            inside = i < stop
            anchor = least_of(mix(named_.view(U64)), i[inside], stop[inside]).view(np.int64) if left_rounds == 0 else named_[i[inside]]
            self.anchors = self.anchors.copy()
            self.anchors[inside] = anchor
        self.words = np.where(self.needed(), self.words, 0)
        return self

    def fused(self, number: int):
        """The symbols of the next round: (symbols, sizes, low, high, is new, definitions of the new ones, their texts).  New ones are still without a name."""
        alive = self.symbols != 0
        first = np.cumsum(self.sizes) - self.sizes
        low, high = np.where(alive, first - self.back, -FAR), np.where(alive, first + self.sizes + self.ahead, FAR)
        head = np.ones(len(alive), bool)
        head[1:] = ~alive[1:] | (self.symbols[1:] != self.symbols[:-1])
        at = np.flatnonzero(head)
        length = np.diff(at, append=len(alive))
        low, high = low[np.maximum(at - 1, 0)], high[np.minimum(at + length, len(alive) - 1)]
        symbols, sizes, alive, first = self.symbols[at], np.add.reduceat(self.sizes, at), alive[at], first[at]
        low, high = np.where(alive, low, -FAR), np.where(alive, high, FAR)
        salt = U64(mix(np.array([number + 1], U64))[0])
        right = (mix(mix(symbols.view(U64) + salt) ^ length.astype(U64)) & U64(1)).astype(bool)
        left, right = ~right & alive, right & alive
        joins, joined = np.zeros(len(symbols), bool), np.zeros(len(symbols), bool)
        joins[:-1] = left[:-1] & right[1:]
        joined[1:] = joins[:-1]
        follow = lambda x: np.append(x[1:], x[-1:])
        high, low = np.where(left, follow(high), high), np.where(right & ~joined, np.append(low[:1], low[:-1]), low)
        defined = np.stack([symbols, length, np.where(joins, follow(symbols), 0), np.where(joins, follow(length), 0)])
        sizes = np.where(joins, sizes + follow(sizes), sizes)
        keep = ~joined
        low, high, defined = low[keep], high[keep], defined[:, keep]
        wanted = alive[keep] & self.wanted(low, high)
        new = wanted & (joins[keep] | (length[keep] > 1))
        symbols = np.where(wanted & ~new, symbols[keep], 0)
        gaps, _ = text_of(self.n)
        return symbols, sizes[keep], low, high, new, defined[:, new], np.searchsorted(gaps, first[keep][new], "right") - 1


def by_bucket(defined: np.ndarray, n_buckets: int):
    """(different definitions by bucket, their buckets, each definition's place among them)"""
    hashes = definition_hashes(defined)
    sample, which = kinds(hashes)
    if not (defined == defined[:, sample[which]]).all():
        _, sample, which = np.unique(defined, axis=1, return_index=True, return_inverse=True)
        which = which.ravel()
    bucket = spread(hashes[sample], n_buckets)
    order = np.lexsort((hashes[sample], bucket))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return defined[:, sample[order]], bucket[order], rank[which]


def request_symbols(n_buckets: int, window: int, number: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                *_, defined, text = State.of(row, window).fused(number)
                if not len(text):
                    continue
                different, bucket, place = by_bucket(defined, n_buckets)
                several = several_texts(place, text, len(bucket))
                edge = np.flatnonzero(np.diff(bucket, prepend=-1))
                for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(bucket)]):
                    yield batch_of(REQUEST, (int(bucket[i]), row["chunk"], planes(np.ascontiguousarray(different[:, i:j]).ravel()), b"", squeeze(several[i:j])))

    return run


def names_of(answered: pa.Table) -> np.ndarray:
    got = sorted(answered.to_pylist(), key=lambda r: r["bucket"])
    return np.concatenate([values(r["names"]) for r in got]) if got else np.zeros(0, np.int64)


def take_words(window: int, left_rounds: int):
    """A chunk's first state: its words with their names."""

    def run(own: pa.Table, answered: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        n, names = values(row["n"]), names_of(answered)
        gaps, last = text_of(n)
        size = int(last) + 1
        place = ranges(gaps + 1, n)
        words_ = np.zeros(size, np.int64)
        words_[place] = names[values(row["tokens"])]
        first = np.arange(size)
        lost = np.zeros(size, bool)
        lost[place] = words_[place] == 0
        starts = ranges(gaps + 1, n - window + 1)
        none = np.zeros(0, np.int64)
        state = State(window, docs=values(row["docs"]), prints=values(row["prints"]), n=n, starts=starts, anchors=np.zeros(len(starts), np.int64), words=words_, symbols=none, sizes=none, back=none, ahead=none)
        return state.settle(words_, np.ones(size, np.int64), first, first + 1, lost, left_rounds).row(row["chunk"])

    return run


def take_symbols(n_buckets: int, window: int, number: int, left_rounds: int):
    def run(own: pa.Table, answered: pa.Table) -> pa.Table:
        if not own.num_rows:
            return nothing(STATE)
        row = own.to_pylist()[0]
        state = State.of(row, window)
        symbols, sizes, low, high, new, defined, _ = state.fused(number)
        if new.any():
            _, _, place = by_bucket(defined, n_buckets)
            symbols[new] = names_of(answered)[place]
        return state.settle(symbols, sizes, low, high, new & (symbols == 0), left_rounds).row(row["chunk"])

    return run


# --- verification --------------------------------------------------------------------------------------------


def stretches(state: State, n_buckets: int):
    """Windows in a row under one anchor: (first start, windows, text), then the different stretches by bucket: (bucket, smallest document, windows, names of
    the words), and each one's number among them."""
    gaps, _ = text_of(state.n)
    anchors = np.where(state.anchors == 0, state.words[state.starts], state.anchors)  # a window without a symbol of these rounds: its first word
    head = np.flatnonzero((np.diff(state.starts, prepend=-9) != 1) | (np.diff(anchors, prepend=0) != 0))
    start, count, anchor = state.starts[head], np.diff(head, append=len(state.starts)), anchors[head]
    text = np.searchsorted(gaps, start, "right") - 1
    seen: dict[tuple, list] = {}
    number = np.empty(len(start), np.int64)
    for k, (s, c, a, d) in enumerate(zip(start.tolist(), count.tolist(), anchor.tolist(), state.docs[text].tolist())):
        entry = seen.setdefault((a, state.words[s : s + c + state.window - 1].tobytes()), [len(seen), d, c])
        entry[1] = min(entry[1], d)
        number[k] = entry[0]
    bucket = spread(mix(np.array([a for a, _ in seen], np.int64).view(U64)), n_buckets)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    held = [(*entry[1:], names) for (_, names), entry in seen.items()]
    return start, count, text, bucket[order], [held[k] for k in order.tolist()], rank[number] if len(rank) else number


def send_stretches(n_buckets: int, window: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, _, _, bucket, held, _ = stretches(State.of(row, window), n_buckets)
                edge = np.flatnonzero(np.diff(bucket, prepend=-1))
                for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(bucket)]):
                    docs, counts, names = zip(*held[i:j])
                    yield batch_of(STRINGS, (int(bucket[i]), row["chunk"], planes(np.array(docs)), planes(np.array(counts)), planes(np.frombuffer(b"".join(names), np.int64))))

    return run


def window_ranks(names: np.ndarray, window: int) -> np.ndarray:
    """Numbers of the windows from each place on: equal for equal windows only."""
    rank, have = kinds(names)[1], 1
    while have < window:
        step = min(have, window - have)
        rank = kinds(rank[:-step] * (int(rank.max(initial=0)) + 1) + rank[step:])[1]
        have += step
    return rank


def verified(window: int):
    """For each window of each stretch the smallest document that has it."""

    def run(group: pa.Table) -> pa.Table:
        got = group.to_pylist()
        seen: dict[bytes, int] = {}
        docs, counts, which, sent = [], [], [], []
        for r in got:
            count, names = values(r["counts"]), values(r["names"])
            upto = np.append(0, np.cumsum(count + window - 1))
            sent.append(len(count))
            for d, c, i, j in zip(values(r["docs"]).tolist(), count.tolist(), upto.tolist(), upto[1:].tolist()):
                k = seen.setdefault(names[i:j].tobytes(), len(seen))
                if k == len(docs):
                    docs.append(d)
                    counts.append(c)
                docs[k] = min(docs[k], d)
                which.append(k)
        names, count, doc, which = np.frombuffer(b"".join(seen), np.int64), np.array(counts), np.array(docs), np.array(which)
        length = count + window - 1
        at = np.cumsum(length) - length
        rank = window_ranks(names, window)[ranges(at, count)]
        least = np.full(int(rank.max()) + 1, FAR)
        np.minimum.at(least, rank, np.repeat(doc, count))
        least, from_, upto = least[rank], np.cumsum(count) - count, np.append(0, np.cumsum(sent))
        out = [(r["bucket"], r["chunk"], planes(least[ranges(from_[which[i:j]], count[which[i:j]])])) for r, i, j in zip(got, upto, upto[1:])]
        return pa.Table.from_batches([batch_of(LEAST, x) for x in out])

    return run


def marked(n_buckets: int, window: int):
    """Spans of a chunk's rows that stand in a smaller document too."""

    def run(own: pa.Table, answered: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 4
        if own.num_rows and answered.num_rows:
            state = State.of(own.to_pylist()[0], window)
            start, count, text, _, held, number = stretches(state, n_buckets)
            got = sorted(answered.to_pylist(), key=lambda r: r["bucket"])
            least = np.concatenate([values(r["least"]) for r in got])
            sizes = np.array([c for _, c, _ in held])
            least = least[ranges((np.cumsum(sizes) - sizes)[number], count)]
            gaps, _ = text_of(state.n)
            text, place = np.repeat(text, count), ranges(start, count)
            later = state.docs[text] > least
            text, place = text[later], place[later]
            edge = np.flatnonzero((np.diff(place, prepend=-9) != 1))
            first, last = place[edge], np.append(place[edge[1:] - 1], place[-1:]) if len(edge) else place[edge]
            text = text[edge]
            out = state.docs[text], state.prints[text], first - gaps[text] - 1, last - gaps[text] - 1 + window
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("doc_id", "print", "start", "stop"), out, types)})

    return run


def finish(batches):
    import pyarrow as pa

    for batch in batches:
        cols = {name: batch.column(name) for name in batch.schema.names}
        texts, ids = cols["text"], cols["doc_id"]
        starts, stops = cols["_starts"].to_pylist(), cols["_stops"].to_pylist()
        n_words, n_removed, sums, kept_text = [], [], [], []
        for i in range(len(ids)):
            raw = (texts[i].as_py() or "").encode()
            kept = all_words = raw.split()
            if starts[i]:
                mask = covered(len(all_words), np.array(starts[i]), np.array(stops[i]))
                kept = [w for w, gone in zip(all_words, mask.tolist()) if not gone]
                begin, end, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), WHITE)
                first = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0) == 1)
                last = np.flatnonzero(np.diff(mask.astype(np.int8), append=0) == -1)
                raw = np.frombuffer(raw, np.uint8)[~covered(len(raw), begin[first], end[last])].tobytes()
            joined = b" ".join(kept)
            n_words.append(len(all_words))
            n_removed.append(len(all_words) - len(kept))
            sums.append(hashlib.sha256(joined).hexdigest())
            kept_text.append(raw)
        carried = [c for c in cols if c not in OWN]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", *carried]
        arrays = [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sums, pa.string()), pa.array(kept_text, pa.binary()).cast(pa.string()), *(cols[c] for c in carried)]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def repeated_spans(documents: DataFrame, window: int, rounds: int, chunk_bytes: int, bucket_bytes: int) -> DataFrame:
    """(doc_id, print, start, stop) of the words that stand in a smaller document too, in windows."""
    n = buckets(text_bytes(documents), bucket_bytes)
    by = lambda df, name: df.groupBy(name)
    old = Written(keyed(documents).where("doc_id is not null").mapInArrow(chunks_of(chunk_bytes, window, n), CHUNKS))
    replies = by(old.frame.mapInArrow(request_words(n), REQUEST), "bucket").applyInArrow(named(n, 0), REPLY)
    state = Written(by(old.frame, "chunk").cogroup(by(replies, "chunk")).applyInArrow(take_words(window, rounds), STATE))
    old.remove()
    for k in range(1, rounds + 1):
        replies = by(state.frame.mapInArrow(request_symbols(n, window, k), REQUEST), "bucket").applyInArrow(named(n, k), REPLY)
        old, state = state, Written(by(state.frame, "chunk").cogroup(by(replies, "chunk")).applyInArrow(take_symbols(n, window, k, rounds - k), STATE))
        old.remove()
    least = by(state.frame.mapInArrow(send_stretches(n, window), STRINGS), "bucket").applyInArrow(verified(window), LEAST)
    spans = cut(by(state.frame, "chunk").cogroup(by(least, "chunk")).applyInArrow(marked(n, window), SPANS), n)
    state.remove()
    return spans


def dedup_substrings(documents: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, carry: list[str] = [], chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text, *carry): every word removed that a window of `window` words covers
    whose word sequence also starts in a document with a smaller doc_id.

    Null text has no words.  Texts under `window` words lose nothing.  Repeats inside one document stay.  Rows that share a doc_id are judged
    each and never take words from one another.  A null doc_id takes no part: its text stays.  Other columns are ignored unless named in
    `carry`, where doc_id, text, _print, _starts and _stops are refused.  An empty table gives an empty result.
    kept_sha256 is of the kept words joined by one space; kept_text is the text without the removed stretches, as it was laid out.
    `rounds` is from 0 to 30.  A text is held whole by one task, at about 40 bytes of memory for each of its bytes."""
    small_batches(documents.sparkSession)
    types = dict(documents.dtypes)
    spans = repeated_spans(documents, window, rounds, chunk_bytes, bucket_bytes)
    finished = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string" + "".join(f", `{c}` {types[c]}" for c in carry)
    return without_spans(documents, spans, finish, finished, carry)
