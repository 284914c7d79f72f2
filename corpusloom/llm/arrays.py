"""Vectorised building blocks on UTF-8 text: buffers, words, rolling fingerprints, packed rows.

A batch of texts is one byte array plus offsets, so every step below is a few passes of numpy
over contiguous memory.  Fingerprints take eight bytes at a time through an avalanche, so no arrangement of
letters or words collides by construction; `same` compares the bytes behind them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: ASCII white space U+0020 and U+0009..U+000D: what separates plain words.
WHITE = bytes([0x20, *range(0x09, 0x0E)])
#: Everything of ASCII but digits and letters: what separates alphanumeric words.
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
U64 = np.uint64
#: Bytes of a range that are taken in blocks; a longer one is hashed whole by blake2b.
SHORT = 128
#: Of a block of eight bytes, its first k.
MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xA0761D6478BD642F)
    x ^= x >> U64(32)
    return x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, most: int):
    """(first, last) rows of consecutive texts of about `most` bytes together; a longer text stands alone."""
    first, n = 0, len(off) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + most, "right")) - 1)
        yield first, last
        first = last


def lower_ascii(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def words(data: np.ndarray, off: np.ndarray, separators: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, words before each text): maximal runs of other bytes inside a text."""
    table = np.ones(256, bool)
    table[np.frombuffer(separators, np.uint8)] = False
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, off)


def blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of the data on as one number, zeros after the end: a view over one copy of the bytes."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Fingerprints of the bytes [start, end); `at`: blocks(data), if the caller has them."""
    n = (ends - starts).astype(np.int64)
    if not len(n):
        return np.zeros(0, U64)
    at = blocks(data) if at is None else at
    out = mix(n.astype(U64) * U64(0x632BE59BD9B4E019))
    short = n <= SHORT
    left = np.flatnonzero(short)
    for k in range(0, SHORT, 8):
        left = left[n[left] > k] if k else left
        if not len(left):
            break
        block = at[starts[left] + k] & MASK[np.minimum(n[left] - k, 8)]
        out[left] = mix(out[left] ^ mix(block + U64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
    for i in np.flatnonzero(~short).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def same(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, from_: np.ndarray, to: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Whether the bytes [start, end) of data are the bytes [from, to) of other; `at`: blocks(data), if the caller has them."""
    n = ends - starts
    out = n == to - from_
    here = blocks(data) if at is None else at
    there = here if other is data else blocks(other)
    left = np.flatnonzero(out & (n <= SHORT))
    for k in range(0, SHORT, 8):
        left = left[n[left] > k]
        if not len(left):
            break
        mask = MASK[np.minimum(n[left] - k, 8)]
        agree = (here[starts[left] + k] & mask) == (there[from_[left] + k] & mask)
        out[left[~agree]] = False
        left = left[agree]
    for i in np.flatnonzero(out & (n > SHORT)).tolist():
        out[i] = np.array_equal(data[starts[i] : ends[i]], other[from_[i] : to[i]])
    return out


word_hashes = range_hashes


def word_kinds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, a place of each different word, each word's number among them), by bytes."""
    at, n = blocks(data), ends - starts
    hashes = range_hashes(data, starts, ends, at)
    sample, which = kinds(hashes)
    first = sample[which]
    long = np.flatnonzero(n > 8)  # up to eight bytes a fingerprint stands for one word of its length
    if not (np.array_equal(n, n[first]) and same(data, starts[long], ends[long], data, starts[first[long]], ends[first[long]], at).all()):  # two words under one fingerprint
        seen: dict[bytes, int] = {}
        which = np.array([seen.setdefault(data[s:e].tobytes(), len(seen)) for s, e in zip(starts.tolist(), ends.tolist())])
        sample = np.unique(which, return_index=True)[1]
    return hashes[sample], sample, which


def window_hashes(symbols: np.ndarray, length: int) -> np.ndarray:
    """Fingerprint of each `length` consecutive 64-bit symbols, by doubling: halves overlap where the length is no power of two."""
    if len(symbols) < length:
        return np.zeros(0, U64)
    out, have = mix(symbols + U64(length)), 1
    while have < length:
        step = min(have, length - have)
        out = mix(out[:-step] * U64(0x9FB21C651E98DF25) + (out[step:] ^ U64(0xC2B2AE3D27D4EB4F)) * U64(0xE7037ED1A0B428DB))
        have += step
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] values for each i, one after another."""
    total = int(counts.sum())
    out = np.ones(total, np.int64)
    if not total:
        return out
    full = counts > 0
    starts, counts = starts[full].astype(np.int64), counts[full].astype(np.int64)
    at = np.cumsum(counts)[:-1]
    out[0] = starts[0]
    out[at] = starts[1:] - starts[:-1] - counts[:-1] + 1
    return np.cumsum(out)


def squeeze(a: np.ndarray) -> bytes:
    """Bytes of an array, compressed."""
    raw = np.ascontiguousarray(a).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def expand(b: bytes, dtype) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return np.frombuffer(pa.decompress(b[8:], n, codec="zstd", asbytes=True), dtype) if n else np.zeros(0, dtype)


def planes(a: np.ndarray) -> bytes:
    """64-bit values by byte, as many bytes as the largest one has, so that what is small compresses well."""
    u = np.ascontiguousarray(a, np.int64).view(U64)
    width = (int(np.bitwise_or.reduce(u)).bit_length() + 7) // 8 if len(u) else 0
    out = np.empty((width, len(u)), np.uint8)
    for k in range(width):
        out[k] = (u >> U64(8 * k)).astype(np.uint8)
    return bytes([width]) + len(u).to_bytes(8, "little") + squeeze(out)


def values(b: bytes) -> np.ndarray:
    width, n = b[0], int.from_bytes(b[1:9], "little")
    raw, out = expand(b[9:], np.uint8).reshape(width, n), np.zeros(n, U64)
    for k in range(width):
        out |= raw[k].astype(U64) << U64(8 * k)
    return out.view(np.int64)


def kinds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each different key, in the order of keys; each key's number among them)"""
    order = np.argsort(keys)
    ordered = keys[order]
    head = np.ones(len(keys), bool)
    head[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(head) - 1
    return order[head], which


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of n places that lie in some [start, end)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0
