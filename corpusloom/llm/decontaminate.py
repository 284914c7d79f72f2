"""Benchmark decontamination with a generalised suffix automaton.

The items' words become one automaton.  Training words are streamed through it, many stretches of a batch in step: a word
follows a transition, or the match falls back along suffix links, so each place has the longest match that ends there.
A match of 10 words (or a whole shorter item) hits the words it covers.  Items too many for one automaton of bounded size
are taken in blocks, each block a job of its own over the rows that writes its hits and lets its automaton go; a very long item is
taken in pieces that overlap by a window.  With one block rows are never shuffled.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import NOT_ALNUM, buffers, covered, lower_ascii, pieces, same, word_hashes, words
from .frames import buckets, cut, small_batches, text_bytes
from .repeats import keyed, refuse

WINDOW = 10
#: Characters of items in one automaton; it bounds what comes to the driver and is broadcast.
BLOCK_CHARS = 2_000_000
#: Parts of a block's expected size by which items are counted before they are dealt to blocks.
CELLS = 32


class SuffixAutomaton:
    """Of several strings of integers; transitions as sorted arrays for lookups of whole columns."""

    def __init__(self, strings: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        for s in strings:
            last = 0
            for c in s:
                last = self._extend(last, c)
        self.size = 1 + max((c for s in strings for c in s), default=0)
        edges = sorted((v * self.size + c, t) for v, out in enumerate(self.next) for c, t in out.items())
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.targets = np.array([t for _, t in edges], np.int64)
        self.links, self.lens = np.array(self.link, np.int64), np.array(self.len, np.int64)

    def _new(self, length: int, out: dict, link: int) -> int:
        self.next.append(out)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
        fresh, p = self._new(self.len[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = fresh
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[fresh] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return fresh

    def stream(self, tokens: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, longest match) after each token of the stretches tokens[start : start + count]; elsewhere 0."""
        state_of, match_of = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
        order = np.argsort(-counts, kind="stable")
        starts, counts = starts[order], counts[order]
        state, match = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for t in range(int(counts[0]) if len(counts) else 0):
            active = int(np.searchsorted(-counts, -t, "left"))
            token = tokens[starts[:active] + t]
            left = np.arange(active)
            while len(left):
                key = state[left] * self.size + token[left]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = self.keys[at] == key
                good = left[found]
                state[good] = self.targets[at[found]]
                match[good] += 1
                left = left[~found]
                root = state[left] == 0
                match[left[root]] = 0
                left = left[~root]
                state[left] = self.links[state[left]]
                match[left] = self.lens[state[left]]
            state_of[starts[:active] + t], match_of[starts[:active] + t] = state[:active], match[:active]
        return state_of, match_of


class Items:
    """The automaton of some items, with the items behind each window."""

    def __init__(self, ids: list, texts: list[str | None], window: int):
        data, off = buffers(pa.array(texts, pa.string()))
        data = lower_ascii(data)
        starts, ends, before = words(data, off, NOT_ALNUM)
        hashes = word_hashes(data, starts, ends)
        self.vocabulary, sample, tokens = np.unique(hashes, return_index=True, return_inverse=True)
        self.data, self.starts, self.ends = data, starts[sample], ends[sample]
        if not same(data, starts, ends, data, self.starts[tokens], self.ends[tokens]).all():
            raise RuntimeError("two words of the items share a fingerprint")
        strings = [tokens[a:b].tolist() for a, b in zip(before[:-1], before[1:])]
        self.window, self.automaton = window, (a := SuffixAutomaton(strings))
        lens, links = a.len, a.link
        # the state in whose class a match's last `window` words are
        self.full = np.full(len(lens), -1, np.int64)
        by_length = sorted(range(len(lens)), key=lambda v: lens[v])
        for v in by_length:
            if lens[v] >= window:
                self.full[v] = v if lens[links[v]] < window else self.full[links[v]]
        self.behind: dict[int, set] = {}
        whole = np.zeros(len(lens), bool)
        self.shortest = window
        for item, s in zip(ids, strings):
            v = 0
            for k, c in enumerate(s):
                v = a.next[v][c]
                if k + 1 >= window:
                    self.behind.setdefault(int(self.full[v]), set()).update(() if item is None else (item,))
            if 0 < len(s) < window:
                whole[v] = True
                self.shortest = min(self.shortest, len(s))
                self.behind.setdefault(v, set()).update(() if item is None else (item,))
        # the nearest whole short item on the way along the links, the state included
        self.whole = np.full(len(lens), -1, np.int64)
        for v in by_length[1:]:
            self.whole[v] = v if whole[v] else self.whole[links[v]]
        a.next = a.link = a.len = None

    def hits(self, data: np.ndarray, off: np.ndarray):
        """For lower-cased texts: word starts, ends, words before each text, mask of hit words, longest match at each word, and {text: items}."""
        a = self.automaton
        starts, ends, before = words(data, off, NOT_ALNUM)
        n = len(starts)
        hit, none = np.zeros(n, bool), np.zeros(n, np.int64)
        if not n or not len(a.keys):
            return starts, ends, before, hit, none, {}
        hashes = word_hashes(data, starts, ends)
        token = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[token] == hashes
        at = np.flatnonzero(known)
        known[at] = same(data, starts[at], ends[at], self.data, self.starts[token[at]], self.ends[token[at]])
        text = np.repeat(np.arange(len(off) - 1), np.diff(before))
        begin = known.copy()
        begin[1:] &= ~known[:-1] | (text[1:] != text[:-1])
        stop = known.copy()
        stop[:-1] &= ~known[1:] | (text[1:] != text[:-1])
        s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        long = e - s >= self.shortest
        state, match = a.stream(token, s[long], (e - s)[long])
        at = np.flatnonzero(match >= self.window)
        first, last, owner = [at - self.window + 1], [at + 1], [np.stack([text[at], self.full[state[at]]])]
        if self.shortest < self.window:
            at = np.flatnonzero(match > 0)
            v = state[at]
            v = self.whole[np.where(match[at] == a.lens[v], v, a.links[v])]
            while len(at := at[v >= 0]):
                v = v[v >= 0]
                first.append(at - a.lens[v] + 1)
                last.append(at + 1)
                owner.append(np.stack([text[at], v]))
                v = self.whole[a.links[v]]
        hit = covered(n, np.concatenate(first), np.concatenate(last))
        found: dict[int, set] = {}
        pairs = np.unique(np.concatenate(owner, axis=1), axis=1)
        for t, v in pairs.T.tolist():
            found.setdefault(t, set()).update(self.behind.get(v, ()))
        return starts, ends, before, hit, match, found


FOUND = "_hits array<int>, _items array<string>, _longest long"


def scanner(shared):
    """Adds the places of hit words, the items behind them, and the longest match."""

    def run(batches):
        import pyarrow as pa

        items = shared.value
        for batch in batches:
            names = batch.schema.names
            data, off = buffers(batch.column(names.index("text")))
            hits, found_items, longest = [None] * batch.num_rows, [None] * batch.num_rows, [0] * batch.num_rows
            for a, b in pieces(off, 2_000_000):
                _, _, before, hit, match, found = items.hits(lower_ascii(data[off[a] : off[b]]), off[a : b + 1] - off[a])
                top = np.append(match, 0)
                for k in range(a, b):
                    i, j = before[k - a], before[k - a + 1]
                    longest[k] = int(top[i:j].max(initial=0))
                    if k - a in found:
                        hits[k], found_items[k] = np.flatnonzero(hit[i:j]).tolist(), [str(x) for x in found[k - a]]
            arrays = [*(batch.column(n) for n in names), pa.array(hits, pa.list_(pa.int32())), pa.array(found_items, pa.list_(pa.string())), pa.array(longest, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "_hits", "_items", "_longest"])

    return run


def finisher(max_coverage: float, with_text: bool):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            names = batch.schema.names
            cols = {n: batch.column(names.index(n)) for n in names}
            data, off = buffers(cols["text"])
            n_words, starts_of = np.zeros(batch.num_rows, np.int64), {}
            hits = cols["_hits"].to_pylist()
            for a, b in pieces(off, 2_000_000):
                starts, ends, before = words(lower_ascii(data[off[a] : off[b]]), off[a : b + 1] - off[a], NOT_ALNUM)
                n_words[a:b] = np.diff(before)
                if with_text:
                    for k in range(a, b):
                        if hits[k]:
                            i, j = before[k - a], before[k - a + 1]
                            starts_of[k] = (starts[i:j] + off[a] - off[k], ends[i:j] + off[a] - off[k])
            n_hit, n_items, sums, text = [], [], [], []
            for k, (hit, found) in enumerate(zip(hits, cols["_items"].to_pylist())):
                hit, found = sorted(set(hit or ())), sorted(set(found or ()))
                n_hit.append(len(hit))
                n_items.append(len(found))
                sums.append(hashlib.sha256(",".join(found).encode()).hexdigest())
                if with_text:
                    raw = data[off[k] : off[k + 1]]
                    if hit:
                        s, e = starts_of[k]
                        at = np.array(hit)
                        edge = np.flatnonzero(np.diff(at, prepend=-9) != 1)
                        stop = np.append(edge[1:], len(at)) - 1
                        raw = raw[~covered(len(raw), s[at[edge]], e[at[stop]])]
                    text.append(raw.tobytes().decode())
            cover = np.array(n_hit) / np.maximum(n_words, 1)
            out = {n: cols[n] for n in names if n not in ("text", *OWN)}
            out |= {"n_words": n_words, "n_hit": n_hit, "n_items": n_items, "items_sha256": sums, "contaminated": [x > 0 for x in n_hit], "longest": cols["_longest"], "coverage": cover, "dropped": cover > max_coverage}
            if with_text:
                out["kept_text"] = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()], names=list(out))

    return run


def cutter(window: int, most: int):
    """(_item, text): items in pieces of about `most` characters that overlap by window - 1 words."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(text) <= most:
                    ids.append(item)
                    texts.append(text)
                    continue
                raw = lower_ascii(np.frombuffer(text.encode(), np.uint8))
                starts, ends, _ = words(raw, np.array([0, len(raw)]), NOT_ALNUM)
                first = 0
                while first < len(starts):
                    last = max(int(np.searchsorted(ends, starts[first] + most, "right")), min(first + 2 * window, len(starts)))
                    ids.append(item)
                    texts.append(raw[starts[first] : ends[last - 1]].tobytes().decode())
                    first = len(starts) if last == len(starts) else last - window + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["_item", "text"])

    return run


def dealt(items: DataFrame, window: int, block_chars: int) -> list[DataFrame]:
    """The items in blocks of at most about `block_chars` characters (one fine cell more, where a cell alone is larger)."""
    # a null id stays null, so it is never mistaken for an item of that name
    cut_ = items.select(F.col("item_id").cast("string").alias("_item"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    pieces_ = cut(cut_.mapInArrow(cutter(window, max(block_chars // CELLS, 1)), "_item string, text string"), buckets(text_bytes(items), block_chars))
    chars = pieces_.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars <= block_chars:
        return [pieces_]
    cells = CELLS * -(-chars // block_chars)
    cell = F.pmod(F.xxhash64("_item", "text"), F.lit(cells))
    size = dict(pieces_.groupBy(cell.alias("cell")).agg(F.sum(F.length("text")).alias("n")).collect())  # one row for each cell
    blocks, held = [], block_chars + 1
    for k in range(cells):
        if held + size.get(k, 0) > block_chars:
            blocks.append([k, k])
            held = 0
        held += size.get(k, 0)
        blocks[-1][1] = k
    return [pieces_.where(cell.between(a, b)) for a, b in blocks]


OWN = ("_print", "_hits", "_items", "_longest")


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, with_text: bool = True, carry: list[str] = [], block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(doc_id, *carry, n_words, n_hit, n_items, items_sha256, contaminated, longest, coverage, dropped, kept_text) for each document.

    A window is `window` consecutive words of an item, or a whole item of fewer words.  A word in any occurrence of a window is hit;
    kept_text lacks the hit stretches, and `dropped` marks documents of which more than `max_coverage` is hit.  `longest` is the longest match
    with an item, or with a piece of an item of over block_chars / 32 characters.
    Null text or item text has no words.  Items with a null item_id hit words but are not counted as items.  Repeated rows are judged each.
    Empty tables: no documents give no rows, no items give no hits.  Other columns are ignored unless named in `carry`, where the operator's own
    names and those beginning with _ that it takes (_print, _hits, _items, _longest) are refused.  A text is held whole by one task."""
    refuse(carry, ("doc_id", "text", *OWN))
    spark = documents.sparkSession
    small_batches(spark)
    types = dict(documents.dtypes)
    frame, carried = keyed(documents, carry), "".join(f"`{c}` {types[c]}, " for c in carry)
    out = f"doc_id long, {carried}n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, coverage double, dropped boolean" + ", kept_text string" * with_text

    def scanned(block: DataFrame, of: DataFrame, schema: str):
        found = block.collect()  # about block_chars characters
        shared = spark.sparkContext.broadcast(Items([r[0] for r in found], [r[1] for r in found], window))
        return shared, of.mapInArrow(scanner(shared), f"{schema}, {FOUND}")

    blocks = dealt(benchmark, window, block_chars)
    if len(blocks) == 1:
        _, hits = scanned(blocks[0], frame.drop("_print"), "doc_id long, text string, " + carried.removesuffix(", ") if carry else "doc_id long, text string")
        return hits.mapInArrow(finisher(max_coverage, with_text), out)
    parts = []
    for block in blocks:
        shared, hits = scanned(block, frame.select("doc_id", "text", "_print"), "doc_id long, text string, _print long")
        parts.append(cut(hits.where("_longest > 0").select("doc_id", "_print", "_hits", "_items", "_longest").distinct()))
        shared.destroy()
    every = reduce(DataFrame.unionByName, parts)
    gather = lambda c: F.flatten(F.collect_list(F.coalesce(c, F.array().cast(dict(every.dtypes)[c])))).alias(c)
    by_row = every.groupBy("doc_id", "_print").agg(gather("_hits"), gather("_items"), F.max("_longest").alias("_longest")).withColumnsRenamed({"doc_id": "_d", "_print": "_p"})
    joined = frame.join(by_row, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_print") == F.col("_p")), "left")
    return joined.select("doc_id", "text", *carry, "_hits", "_items", F.coalesce("_longest", F.lit(0)).alias("_longest")).mapInArrow(finisher(max_coverage, with_text), out)
