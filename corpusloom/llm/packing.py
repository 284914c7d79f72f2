"""Sum-of-squares online packing of token sequences.

A task streams its documents.  Full windows are cut off a long document at once; what is left, of size s, goes to
a partly filled window of fill level h (or to a new one) so that the sum over levels of N(h) squared is least, where
N(h), kept in a level array, counts the partly filled windows of level h.  At the end of a task its few partly filled windows
are poured together by cutting, so at most one window of a task is padded.
Nothing is shuffled; a sequence id is (partition, running number).
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import buffers, pieces, ranges, same, word_kinds
from .frames import small_batches

WINDOW, END_ID = 2048, 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, ids binary"


class SumOfSquares:
    """Chooses a fill level for each size; `counts[h]` partly filled windows have level h."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window)]
        self.begun = 0

    def place(self, size: int) -> tuple[int, int]:
        """(window number, level it had) for a size below the window; the window's level grows by the size."""
        counts, top = self.counts, self.window - size
        here = counts[: top + 1]
        # moving one window from h to h + size changes the sum by 2 (N(h + size) - N(h) + 1); a full window leaves the array
        change = 2 * (counts[size : self.window + 1] - here) + 2
        change[top] -= 1
        change[(here == 0)] = np.iinfo(np.int64).max
        change[0] = 2 * counts[size] + 1
        level = top - int(np.argmin(change[::-1]))
        if level:
            number = self.open[level].pop()
            counts[level] -= 1
        else:
            number = self.begun
            self.begun += 1
        if level + size < self.window:
            self.open[level + size].append(number)
            counts[level + size] += 1
        return number, level


MARKS = ".,!?;:*#$%&"
#: What stands between parts that are encoded together, and how many are.
SEPARATOR, GROUP = "\u00b6", 128


class Words:
    """Ids of texts by a tokenizer, each different part of a text encoded once for many.

    Parts end at white space and between an ASCII letter and a mark, and are encoded in groups, if the tokenizer gives `probes` the same ids whole and in
    parts; else one by one, if that holds; else they end at white space only; else texts are encoded whole."""

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.inside, self.letter, self.mark = (np.zeros(256, bool) for _ in range(3))
        self.letter[[*range(65, 91), *range(97, 123)]] = True
        self.separator = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        blank = b" \t\n\r\x0b\x0c"
        for marks, white, self.grouped in ((MARKS, blank, bool(self.separator)), (MARKS, blank, False), ("", blank, False), ("", b"", False)):
            self.clear()
            self.mark[:] = False
            self.mark[list(marks.encode())] = True
            self.inside[:] = True
            self.inside[list(white)] = False
            if not white or self._sound():
                break
        self.clear()

    def _sound(self) -> bool:
        probes = self.probes()
        raw = [t.encode() for t in probes]
        flat, upto = self.ids(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        whole = self.tokenizer.encode_batch_fast(probes, add_special_tokens=False)
        return all(flat[a:b].tolist() == e.ids for a, b, e in zip(upto, upto[1:], whole))

    @staticmethod
    def probes() -> list[str]:
        """Strings in which letters, marks, digits, white space and other scripts meet in many ways."""
        rng = np.random.default_rng(7)
        parts = [*"aZ09 '-_()/@", *MARKS, " ", "\n", "\t", "  ", "é", "ß", "漢", "字", "😀", "\u00a0", "\u0301", "n't", "the", "Http", "...", "<|endoftext|>"]
        return ["", " ", " a", "a ", *("".join(parts[k] for k in rng.integers(0, len(parts), n)) for n in rng.integers(1, 40, 300))]

    def clear(self):
        """Forgets the parts: their fingerprints in order, the number of each, its bytes, and its ids."""
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.bytes, self.ends_of = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.flat, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many of each).  Parts go to the tokenizer GROUP at a time around a separator, whose ids tell them apart; a group in which
        it is not found once between each two is encoded one by one."""
        if not self.grouped:
            got = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got))
        groups = [texts[k : k + GROUP] for k in range(0, len(texts), GROUP)]
        flat, sizes = [], []
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([f" {SEPARATOR} ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            here = np.ones(max(len(ids) - len(self.separator) + 1, 0), bool)
            for k, c in enumerate(self.separator):
                here &= ids[k : k + len(here)] == c
            at = np.flatnonzero(here)
            if len(at) != len(group) - 1 or any(SEPARATOR in t for t in group):
                got = [x.ids for x in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
                ids, size = np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got))
            else:
                size = np.diff(np.append(at, len(ids)), prepend=-len(self.separator)) - len(self.separator)
                ids = np.delete(ids, (at[:, None] + np.arange(len(self.separator))).ravel())
            flat.append(ids)
            sizes.append(size)
        return np.concatenate(flat), np.concatenate(sizes)

    def numbered(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each part, known by its bytes; new ones are encoded."""
        out, found = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            out = self.numbers[at]
            found = (self.hashes[at] == hashes) & same(data, starts, ends, self.bytes, self.ends_of[out], self.ends_of[out + 1])
        new = np.flatnonzero(~found)
        if len(new):
            s, e = starts[new], ends[new]
            if self.inside[10]:
                raw = data.tobytes()
                texts = [raw[i:j].decode() for i, j in zip(s.tolist(), e.tolist())]
            else:  # no part holds a line end
                lines = np.full(int((e - s + 1).sum()), 10, np.uint8)
                lines[ranges(np.cumsum(e - s + 1) - (e - s + 1), e - s)] = data[ranges(s, e - s)]
                texts = lines.tobytes().decode().split("\n")[:-1]
            flat, size = self.encoded(texts)
            out[new] = np.arange(len(new)) + len(self.begin) - 1
            self.bytes, self.ends_of = np.concatenate([self.bytes, data[ranges(s, e - s)]]), np.concatenate([self.ends_of, self.ends_of[-1] + np.cumsum(e - s)])
            self.flat, self.begin = np.concatenate([self.flat, flat]), np.concatenate([self.begin, self.begin[-1] + np.cumsum(size)])
            every, numbers = np.concatenate([self.hashes, hashes[new]]), np.concatenate([self.numbers, out[new]])
            order = np.argsort(every)
            self.hashes, self.numbers = every[order], numbers[order]
        return out

    def ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        inside = self.inside[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        cut = edge[1:-1] | (self.letter[data[:-1]] & self.mark[data[1:]]) if len(data) else edge[1:-1]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1] | cut
        ends[:-1] &= ~inside[1:] | cut
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        if len(self.hashes) > self.most:
            self.clear()
        hashes, sample, which = word_kinds(data, starts, ends)
        row = self.numbered(data, hashes, starts[sample], ends[sample])[which] if len(starts) else np.zeros(0, np.int64)
        begin = self.begin
        size = begin[row + 1] - begin[row] if len(row) else row
        flat = self.flat[ranges(begin[row], size)] if len(row) else np.zeros(0, np.uint32)
        total = np.append(0, np.cumsum(size))
        return flat, total[np.searchsorted(starts, off)]


def packer(path: str, window: int, end_id: int, with_ids: bool):
    def run(batches):
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, packing = Words(path), SumOfSquares(window)
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        # of a window: [offset, doc, start, ids, document's tokens]
        held: dict[int, list] = {}
        ready: list[tuple] = []
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

        def close(number, parts):
            for offset, doc, start, ids, tokens in parts:
                raw = ids.astype("<u4").tobytes()
                ready.append((doc, start, len(ids), zlib.crc32(raw), tokens, base + number, offset, raw if with_ids else None))

        def flush():
            columns = list(zip(*ready)) or [()] * len(names)
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns)], names=names)
            ready.clear()
            return out

        for batch in batches:
            docs = batch.column(0).to_pylist()
            data, off = buffers(batch.column(1))
            for a, b in pieces(off, 2_000_000):
                flat, upto = words.ids(data[off[a] : off[b]], off[a : b + 1] - off[a])
                for k in range(a, b):
                    ids = np.append(flat[upto[k - a] : upto[k - a + 1]], np.uint32(end_id))
                    tokens, start = len(ids), 0
                    while tokens - start >= window:
                        number, packing.begun = packing.begun, packing.begun + 1
                        close(number, [(0, docs[k], start, ids[start : start + window], tokens)])
                        start += window
                    if start < tokens:
                        number, level = packing.place(tokens - start)
                        held.setdefault(number, []).append((level, docs[k], start, ids[start:], tokens))
                        if level + tokens - start == window:
                            close(number, held.pop(number))
                if len(ready) > 5000:
                    yield flush()
        # pour the emptiest windows into the fullest ones
        by_fill = sorted(held.items(), key=lambda x: (-sum(len(p[3]) for p in x[1]), x[0]))
        first, last = 0, len(by_fill) - 1
        while first < last:
            number, parts = by_fill[first]
            room = window - sum(len(p[3]) for p in parts)
            while room and first < last:
                source = by_fill[last][1]
                if not source:
                    last -= 1
                    continue
                _, doc, start, ids, tokens = source.pop()
                taken = min(room, len(ids))
                parts.append((window - room, doc, start + len(ids) - taken, ids[len(ids) - taken :], tokens))
                if taken < len(ids):
                    source.append((0, doc, start, ids[: len(ids) - taken], tokens))
                room -= taken
            first += not room
        for number, parts in by_fill:
            at = 0
            for _, doc, start, ids, tokens in parts:
                close(number, [(at, doc, start, ids, tokens)])
                at += len(ids)
        yield flush()

    return run


def pack(documents: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, little-endian unsigned 32-bit).

    A document is its ids by `tokenizer` (a path) and then `end_id`; each id lies in exactly one piece.  Pieces fill a sequence
    gapless from offset 0; all sequences but at most one of a task are full.  Null or empty text is `end_id` alone.  A null doc_id
    is packed as it is; repeated rows are packed each.  Other columns are ignored.  An empty table gives an empty result."""
    small_batches(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.mapInArrow(packer(tokenizer, window, end_id, with_ids), PIECES)
    return out if with_ids else out.drop("ids")
