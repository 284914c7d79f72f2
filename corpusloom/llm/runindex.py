"""A run-length index: the run-compressed Burrows-Wheeler transform of many short strings.

The strings are joined by separators that sort before every byte and among themselves by place.  Kept are the
runs of the transform (symbol, first rank, where the last-to-first step lands) with a text position sampled at each
run's two ends, and, for one window length, the ranks where a new class of equal windows begins with the smallest owner of each
class.  These sizes follow the number of runs and classes, not the text; beside them two tables of four bytes a rank give its run and
class in one step, as long as the strings are there anyway.
"""

from __future__ import annotations

import numpy as np

from .arrays import U64, ranges


class RunLengthIndex:
    def __init__(self, data: np.ndarray, lengths: np.ndarray, owners: np.ndarray, window: int):
        """data: the strings' bytes, one after another; owners: an integer for each string."""
        self.window, self.lengths, self.strings = window, lengths.astype(np.int64), len(lengths)
        n = len(data) + len(lengths)
        stops = np.cumsum(self.lengths + 1) - 1
        text = np.zeros(n, np.uint16)
        inside = np.ones(n, bool)
        inside[stops] = False
        text[inside] = data.astype(np.uint16) + 1
        left = np.repeat(stops, self.lengths + 1) - np.arange(n)  # bytes before the separator
        order, same = self._sort(text, left, window)
        before = np.where(order > 0, text[order - 1], 0)
        head = np.flatnonzero((np.diff(before.astype(np.int32), prepend=-1) != 0) | (before == 0))  # a string's first suffix stands alone
        self.starts, self.symbols = head, before[head]
        counts = np.diff(head, append=n)
        self.run_of = np.repeat(np.arange(len(head), dtype=np.int32), counts)
        by_symbol = np.argsort(self.symbols, kind="stable")
        below = np.cumsum(counts[by_symbol]) - counts[by_symbol]
        self.lands = np.empty(len(head), np.int64)
        self.lands[by_symbol] = below
        #: text positions at the first and the last rank of each run
        self.sampled_first, self.sampled_last = order[head], order[np.append(head[1:], n) - 1]
        whole = left[order] >= window
        edge = np.flatnonzero(whole & ~(same & np.append(False, whole[:-1])))
        self.heads = edge
        self.class_of = np.repeat(np.arange(-1, len(edge), dtype=np.int32), np.diff(np.concatenate([[0], edge, [n]])))
        owner = np.repeat(owners, self.lengths + 1)[order]
        # suffixes shorter than a window never fall between two of one class
        self.least = np.minimum.reduceat(np.where(whole, owner, np.iinfo(np.int64).max), edge) if len(edge) else np.zeros(0, np.int64)

    @staticmethod
    def _sort(text: np.ndarray, left: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order, cut at their separators, and whether each agrees with the one before on `window` symbols."""
        n = len(text)
        key = np.zeros(n, U64)
        for k in range(7):
            ahead = np.zeros(n, U64)
            ahead[: n - k] = text[k:]
            key = (key << U64(9)) | np.where(left >= k, ahead, U64(0))

        def ranked(key):
            order = np.argsort(key)
            new = np.append(False, key[order][1:] != key[order][:-1])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            return rank

        def joined(rank, depth):
            ahead = np.zeros(n, np.int64)
            ahead[: n - depth] = rank[depth:] + 1
            return (rank.astype(U64) << U64(32)) | np.where(left >= depth, ahead, 0).astype(U64)

        depth, rank, agree = 7, ranked(key), None
        longest = int(left.max(initial=0)) + 1
        while depth < longest or agree is None:
            if agree is None and depth * 2 >= window:
                agree = joined(rank, window - depth) if depth < window else rank.astype(U64)
            if depth < longest:
                rank = ranked(joined(rank, depth))
            depth *= 2
        order = np.argsort((rank.astype(U64) << U64(32)) | np.arange(n, dtype=U64))
        return order, np.append(False, agree[order][1:] == agree[order][:-1])

    def back(self, ranks: np.ndarray) -> np.ndarray:
        """The last-to-first step: ranks of the suffixes one byte longer."""
        run = self.run_of[ranks]
        return self.lands[run] + ranks - self.starts[run]

    def stream(self) -> np.ndarray:
        """Streams every string from its end through the index and gives, for each window in order of the strings,
        the smallest owner among all strings that hold this window: its match reaches the window length in that owner's text."""
        windows = np.maximum(self.lengths - self.window + 1, 0)
        first = np.cumsum(windows) - windows
        out = np.empty(int(windows.sum()), np.int64)
        by_length = np.argsort(-self.lengths, kind="stable")
        lengths = self.lengths[by_length]
        ranks = by_length.astype(np.int64)  # the i-th separator has rank i
        for matched in range(1, int(lengths[0]) + 1 if len(lengths) else 1):
            active = int(np.searchsorted(-lengths, -matched, "right"))
            ranks[:active] = self.back(ranks[:active])
            if matched >= self.window:
                some = by_length[:active]
                out[first[some] + self.lengths[some] - matched] = self.least[self.class_of[ranks[:active]]]
        return out

    def locate(self, rank: int) -> int:
        """Text position of a rank, by steps back to a sampled run end."""
        steps = 0
        while True:
            run = int(np.searchsorted(self.starts, rank, "right")) - 1
            if rank == self.starts[run]:
                return int(self.sampled_first[run]) + steps
            rank, steps = int(self.back(np.array([rank]))[0]), steps + 1


def smallest_owner(data: np.ndarray, lengths: np.ndarray, owners: np.ndarray, group: np.ndarray, window: int, most: int = 1_000_000) -> np.ndarray:
    """For each window of each string, in order, the smallest owner of this window among the strings of one group.

    Strings lie in order of their groups; an index takes whole groups of about `most` bytes."""
    ends = np.cumsum(lengths)
    edges = np.append(np.flatnonzero(np.diff(group)) + 1, len(lengths))
    out, first = [], 0
    while first < len(lengths):
        from_byte = int(ends[first] - lengths[first])
        fit = edges[np.searchsorted(ends[edges - 1], from_byte + most, "right") - 1] if len(edges) else len(lengths)
        last = int(fit) if fit > first else int(edges[np.searchsorted(edges, first, "right")])
        index = RunLengthIndex(data[from_byte : int(ends[last - 1])], lengths[first:last], owners[first:last], window)
        out.append(index.stream())
        first = last
    return np.concatenate(out) if out else np.zeros(0, np.int64)


__all__ = ["RunLengthIndex", "ranges", "smallest_owner"]
