"""N-gram Jaccard join with token-combination prefixes.

A text's tokens are its distinct 5-word shingles.  Texts with equal sets fold to one set first.  Then:

1. Tokens are counted over all sets, packed by bucket.  A set of which under 80 % of the tokens stand in another set cannot
   link with any and is finished; this is most of a corpus.
2. The tokens of the other sets get a class: in one set, rare, or frequent.  All sets order their tokens by class and hash.  Two similar sets
   share a token within both prefixes of n - t + 1 tokens (t: least overlap).  Rare ones there are indexed as single tokens.  Where
   a prefix reaches the frequent class, it is extended by one token and pairs of frequent tokens are indexed, since
   sets that share no rare token share two frequent ones there.
3. Sets travel to their index keys with a mark, a bitmap of their tokens with as many bits as tokens.  Where the marks of two sets under
   one key differ in more bits than similar sets have different tokens, they cannot link; the others are joined into a forest, never listed
   as pairs.  Trees that hang together form candidate groups, close to the true components.
4. Within a group exact overlaps decide, by a search from linked sets to those not yet linked.  A group over a size is dealt to blocks;
   the largest classes of some blocks visit all blocks, which joins most of a family, and then every set outside the largest class of its
   group visits all blocks, which finds each link that is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U64, WHITE, buffers, expand, lower_ascii, mix, pieces, ranges, squeeze, window_hashes, word_hashes, words
from .components import components
from .frames import buckets, cut, small_batches, text_bytes
from .repeats import rows

SHINGLE, PERCENT = 5, 80
#: Sets that hold a token of the frequent class: more than this.
FREQUENT = 64
#: Frequent tokens of one set that are combined in pairs; sets with more index them singly too.
COMBINED = 100
#: Bytes of a token in the first count, beside its bucket; equal tags of different tokens only let more sets through.
TAG_BYTES = 5
#: Bytes of text for each bucket, to raise with larger executors.
BUCKET_BYTES = 5_000_000
#: Bytes of tokens that one task takes of a candidate group, to raise with larger executors.
GROUP_BYTES = 1_000_000
#: Blocks of a group whose largest classes visit all its blocks first.
PIVOTS = 4


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct tokens of all texts, offsets): sorted within a text; a text of 1 to k - 1 words has one token."""
    data = lower_ascii(data)
    s, e, before = words(data, off, WHITE)
    symbols, n = word_hashes(data, s, e), np.diff(before)
    windows = window_hashes(symbols, k)
    per = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), per)
    token = np.empty(len(text), U64)
    at = np.cumsum(per) - per
    long = n >= k
    token[ranges(at[long], per[long])] = windows[ranges(before[:-1][long], per[long])]
    for i in np.flatnonzero((n > 0) & ~long).tolist():
        token[at[i]] = window_hashes(symbols[before[i] : before[i + 1]], int(n[i]))[0] ^ U64(n[i])
    order = np.lexsort((token, text))
    token, text = token[order], text[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (text[1:] != text[:-1])
    token, text = token[new], text[new]
    return token, np.searchsorted(text, np.arange(len(n) + 1))


def set_prints(token: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A fingerprint of each set of tokens."""
    total = np.append(U64(0), np.cumsum(mix(token + U64(0x1D8E4E27C47D124F)), dtype=U64))
    return mix(total[off[1:]] - total[off[:-1]] + np.diff(off).astype(U64)).view(np.int64)


def texts_of(batches):
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, off = buffers(batch.column(1))
        for a, b in pieces(off, 2_000_000):
            yield ids[a:b], data[off[a] : off[b]], off[a : b + 1] - off[a]


def describe(k: int):
    def run(batches):
        for batch in batches:
            n, prints = [], []
            data, off = buffers(batch.column(1))
            for a, b in pieces(off, 2_000_000):
                token, upto = shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], k)
                n.append(np.diff(upto))
                prints.append(set_prints(token, upto))
            found = (pa.array(np.concatenate(x) if x else []).cast(pa.int64()) for x in (n, prints))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *found], names=["doc_id", "text_print", "n_shingles", "print"])

    return run


PACKED = "bucket int, sets binary, counts binary, body binary"


def pack_tokens(schema, n: int, sets: np.ndarray, token: np.ndarray, upto: np.ndarray, width: int, more: tuple = ()):
    """Packed rows, one for each bucket of tokens: set ids, their numbers of tokens, the tokens' low bytes in the sets' order, and
    what the functions in `more` give for the places of the sets."""
    bucket = ((token >> U64(40)) % U64(n)).astype(np.int64)
    owner = np.repeat(np.arange(len(sets)), np.diff(upto))
    order = np.argsort(bucket, kind="stable")
    bucket, owner = bucket[order], owner[order]
    body = np.ascontiguousarray(token[order]).view(np.uint8).reshape(-1, 8)[:, :width]
    seg = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    place = owner[seg]
    count, sets = np.diff(seg, append=len(bucket)), sets[place]
    edge = np.flatnonzero(np.diff(bucket[seg], prepend=-1))
    last, first = np.append(edge[1:], len(seg)), np.append(seg, len(bucket))
    return rows(schema, [
        bucket[seg][edge],
        [squeeze(sets[i:j].astype(np.int64)) for i, j in zip(edge, last)],
        [squeeze(count[i:j].astype(np.int32)) for i, j in zip(edge, last)],
        [body[first[i] : first[j]].tobytes() for i, j in zip(edge, last)],
        *([f(place[i:j]) for i, j in zip(edge, last)] for f in more),
    ])


def emit_tokens(k: int, n: int, width: int):
    def run(batches):
        schema = pa.schema([("bucket", pa.int32()), ("sets", pa.binary()), ("counts", pa.binary()), ("body", pa.binary())])
        for _, data, off in texts_of(batches):
            token, upto = shingle_sets(data, off, k)
            sets, first = np.unique(set_prints(token, upto), return_index=True)  # equal sets of a batch travel once
            sizes = np.diff(upto)[first]
            token, upto = token[ranges(upto[first], sizes)], np.append(0, np.cumsum(sizes))
            if len(token):
                yield pack_tokens(schema, n, sets, token, upto, width)

    return run


def unpack(group: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, token) for each token of a bucket."""
    sets = np.concatenate([expand(x, np.int64) for x in group["sets"].to_pylist()])
    counts = np.concatenate([expand(x, np.int32) for x in group["counts"].to_pylist()])
    body = np.concatenate([np.frombuffer(x, np.uint8) for x in group["body"].to_pylist()]).reshape(-1, width)
    wide = np.zeros((len(body), 8), np.uint8)
    wide[:, :width] = body
    return np.repeat(sets, counts), wide.view(U64).ravel()


COUNTED = "part int, sets binary, counts binary"


def count_shared(parts: int):
    """How many of each set's tokens in this bucket another set has too, packed by part of the sets."""

    def run(group: pa.Table) -> pa.Table:
        sets, token = unpack(group, TAG_BYTES)
        order = np.argsort(token)
        sets, token = sets[order], token[order]
        head = np.flatnonzero(np.diff(token, prepend=~token[:1]))
        several = np.minimum.reduceat(sets, head) != np.maximum.reduceat(sets, head)
        found, n = np.unique(sets[np.repeat(several, np.diff(head, append=len(token)))], return_counts=True)
        part = (mix(found.view(U64)) % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, found, n = part[order], found[order], n[order]
        edge = np.flatnonzero(np.diff(part, prepend=-1))
        spans = list(zip(edge, np.append(edge[1:], len(part))))
        return pa.table({
            "part": pa.array(part[edge], pa.int32()),
            "sets": pa.array([squeeze(found[i:j].astype(np.int64)) for i, j in spans], pa.binary()),
            "counts": pa.array([squeeze(n[i:j].astype(np.int32)) for i, j in spans], pa.binary()),
        })

    return run


def add_counts(group: pa.Table) -> pa.Table:
    sets = np.concatenate([expand(x, np.int64) for x in group["sets"].to_pylist()])
    found, which = np.unique(sets, return_inverse=True)
    n = np.bincount(which, weights=np.concatenate([expand(x, np.int32) for x in group["counts"].to_pylist()]), minlength=len(found))
    return pa.table({"print": pa.array(found, pa.int64()), "n": pa.array(n.astype(np.int64), pa.int64())})


CLASSED = "part int, sets binary, counts binary, tokens binary, frequent binary"


def classify(parts: int):
    """Each set's tokens that other sets have too, with a mark for the frequent class, packed by part of the sets."""

    def run(group: pa.Table) -> pa.Table:
        sets, token = unpack(group, 8)
        order = np.argsort(token)
        sets, token = sets[order], token[order]
        head = np.flatnonzero(np.diff(token, prepend=~token[:1]))
        size = np.diff(head, append=len(token))
        size = np.repeat(size, size)
        keep = size > 1
        sets, token, frequent = sets[keep], token[keep], (size > FREQUENT)[keep]
        part = (mix(sets.view(U64)) % U64(parts)).astype(np.int64)
        order = np.lexsort((sets, part))
        part, sets, token, frequent = part[order], sets[order], token[order], frequent[order]
        edge = np.flatnonzero(np.diff(part, prepend=-1))
        spans = list(zip(edge, np.append(edge[1:], len(sets))))
        packed = [np.unique(sets[i:j], return_counts=True) for i, j in spans]
        return pa.table({
            "part": pa.array(part[edge], pa.int32()),
            "sets": pa.array([squeeze(x.astype(np.int64)) for x, _ in packed], pa.binary()),
            "counts": pa.array([squeeze(n.astype(np.int32)) for _, n in packed], pa.binary()),
            "tokens": pa.array([token[i:j].tobytes() for i, j in spans], pa.binary()),
            "frequent": pa.array([squeeze(frequent[i:j]) for i, j in spans], pa.binary()),
        })

    return run


def assemble(group: pa.Table) -> pa.Table:
    """A row for each set of a part: its shared tokens and their marks."""
    sets = np.concatenate([np.repeat(expand(x, np.int64), expand(n, np.int32)) for x, n in zip(group["sets"].to_pylist(), group["counts"].to_pylist())])
    token = np.concatenate([np.frombuffer(x, U64) for x in group["tokens"].to_pylist()])
    frequent = np.concatenate([expand(x, bool) for x in group["frequent"].to_pylist()])
    order = np.argsort(sets, kind="stable")
    sets, token, frequent = sets[order], token[order], frequent[order]
    edge = np.flatnonzero(np.diff(sets, prepend=~sets[:1]))
    spans = list(zip(edge, np.append(edge[1:], len(sets))))
    return pa.table({
        "set": pa.array(sets[edge], pa.int64()),
        "tokens": pa.array([token[i:j].tobytes() for i, j in spans], pa.binary()),
        "frequent": pa.array([frequent[i:j].tobytes() for i, j in spans], pa.binary()),
    })


def index_keys(n: int, token: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Keys of one set of n tokens, given those that other sets have."""
    order = np.lexsort((token, frequent))
    token, frequent = token[order], frequent[order]
    prefix = n - -(-percent * n // 100) + 1 - (n - len(token))  # tokens of no other set come first
    rare = int(len(token) - frequent.sum())
    keys = [mix(token[: max(0, min(prefix, rare))])]
    some = token[rare : max(rare, prefix + 1)]
    if len(some) >= 2:
        if len(some) <= COMBINED:
            a, b = np.triu_indices(len(some), 1)
            keys.append(mix(some[a] * U64(0x9FB21C651E98DF25) + some[b]))
        if n // 4 + 3 > COMBINED:  # a similar set may have more than can be combined
            keys.append(mix(some[:-1] ^ U64(0x5851F42D4C957F2D)))
    return np.unique(np.concatenate(keys))


def mark_words(n: np.ndarray) -> np.ndarray:
    """64-bit words in the mark of a set of n tokens: a power of two, so that marks of similar sets fold to one width."""
    return np.int64(1) << np.ceil(np.log2(np.maximum(n, 64) / 64)).astype(np.int64)


def mark(token: np.ndarray, n: int) -> np.ndarray:
    """Bitmap of a set: each token turns one bit over, so two marks differ in at most as many bits as the sets have different tokens."""
    bits = 64 * int(mark_words(np.array(n)))
    turned = np.bincount((mix(token ^ U64(0x2545F4914F6CDD1D)) % U64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(turned.astype(np.uint8), bitorder="little").view(U64)


INDEXED = PACKED + ", sizes binary, shared binary, marks binary"


def emit_keys(percent: int, buckets_: int):
    def run(batches):
        schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("sets", "counts", "body", "sizes", "shared", "marks"))])
        for batch in batches:
            ids, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            held, marks, shared, have = [], [], [], 0
            for i, (tokens, frequent) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                token = np.frombuffer(tokens, U64)
                held.append(index_keys(int(n[i]), token, np.frombuffer(frequent, bool), percent))
                marks.append(mark(token, int(n[i])))
                shared.append(len(token))
                have += len(held[-1])
                if have > 500_000 or i + 1 == batch.num_rows:
                    if have:
                        some = slice(i + 1 - len(held), i + 1)
                        size = [np.asarray(x, np.int64) for x in (n[some], shared)]
                        more = (
                            lambda at, x=size[0]: squeeze(x[at]),
                            lambda at, x=size[1]: squeeze(x[at]),
                            lambda at, x=marks: np.concatenate([x[k] for k in at]).tobytes(),
                        )
                        upto = np.append(0, np.cumsum([len(k) for k in held]))
                        yield pack_tokens(schema, buckets_, ids[some], np.concatenate(held), upto, 8, more)
                    held, marks, shared, have = [], [], [], 0

    return run


class Marks:
    """Marks of several sets; `differ` counts the bits in which pairs of them differ, at the width of the narrower one; none where one
    mark has over twice the width of the other."""

    def __init__(self, n: np.ndarray, flat: np.ndarray):
        self.width = mark_words(n)
        self.own = np.cumsum(self.width) - self.width
        half = self.width // 2
        at = ranges(self.own, half)
        self.folded = len(flat) + np.cumsum(half) - half
        self.flat = np.concatenate([flat, flat[at] ^ flat[at + np.repeat(half, half)]])

    def differ(self, a: np.ndarray, b: np.ndarray, most: int = 2_000_000) -> np.ndarray:
        out, width = np.zeros(len(a), np.int64), np.minimum(self.width[a], self.width[b])
        comparable = np.maximum(self.width[a], self.width[b]) <= 2 * width
        for w in np.unique(width).tolist():
            every = np.flatnonzero(comparable & (width == w))
            for some in np.array_split(every, -(-len(every) * w // most) or 1):
                x, y = (np.where(self.width[s[some]] == w, self.own[s[some]], self.folded[s[some]])[:, None] + np.arange(w) for s in (a, b))
                out[some] = np.bitwise_count(self.flat[x] ^ self.flat[y]).sum(axis=1, dtype=np.int64)
        return out


def united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels after pairs (a, b) got one label each."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(to, further := to[to]):
            to = further
        label = to[label]


def different_lists(key: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(list, member) for the lists of members under a key that have two at least, each list once."""
    order = np.lexsort((member, key))
    member, key = member[order], key[order]
    head = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    size = np.diff(head, append=len(key))
    head, size = head[size > 1], size[size > 1]
    if not len(head):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.append(U64(0), np.cumsum(mix(member.astype(U64) + U64(0x632BE59BD9B4E019)), dtype=U64))
    order = np.lexsort((total[head + size] - total[head], size))
    head, size = head[order], size[order]
    alike = np.flatnonzero(size[1:] == size[:-1])
    if len(alike):  # by their members
        n = size[alike]
        equal = np.logical_and.reduceat(member[ranges(head[alike], n)] == member[ranges(head[alike + 1], n)], np.cumsum(n) - n)
        again = np.ones(len(head), bool)
        again[alike[equal] + 1] = False
        head, size = head[again], size[again]
    return np.repeat(np.arange(len(head)), size), member[ranges(head, size)]


def forest(lists: np.ndarray, member: np.ndarray, n: np.ndarray, shared: np.ndarray, marks: Marks, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all members of one list which size and mark let link.  In each round the first member of every list meets the
    others that do not hang together with it yet, and leaves."""
    label, found = np.arange(len(n)), []
    while len(lists):
        head = np.flatnonzero(np.diff(lists, prepend=-1))
        which = np.cumsum(np.diff(lists, prepend=-1) != 0) - 1
        first = member[head][which]
        apart = label[member] != label[first]
        a, b = first[apart], member[apart]
        if len(a):
            a, b = np.divmod(np.unique(a * len(n) + b), len(n))
            near = (100 * np.minimum(n[a], n[b])) >= percent * np.maximum(n[a], n[b])
            a, b = a[near], b[near]
            most = (shared[a] + shared[b] - marks.differ(a, b)) // 2
            link = 100 * most >= percent * (n[a] + n[b] - most)
            a, b = a[link], b[link]
            label = united(label, a, b)
            found.append((a, b))
        low, high = np.minimum.reduceat(label[member], head), np.maximum.reduceat(label[member], head)
        keep = (low != high)[which]
        keep[head] = False
        lists, member = lists[keep], member[keep]
    return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), ())))


def joined_keys(percent: int):
    def run(group: pa.Table) -> pa.Table:
        sets, n, shared = (np.concatenate([expand(x, np.int64) for x in group[c].to_pylist()]) for c in ("sets", "sizes", "shared"))
        counts = np.concatenate([expand(x, np.int32) for x in group["counts"].to_pylist()])
        key, flat = (np.concatenate([np.frombuffer(x, U64) for x in group[c].to_pylist()]) for c in ("body", "marks"))
        lists, member = different_lists(key, np.repeat(np.arange(len(sets)), counts))
        a, b = forest(lists, member, n, shared, Marks(n, flat), percent)
        return pa.table({"a": pa.array(sets[a], pa.int64()), "b": pa.array(sets[b], pa.int64())})

    return run


def linked(reps: np.ndarray, n: np.ndarray, tokens: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the smallest document among the sets it hangs together with over exact links; `reps` has the smallest of each set.
    A search from linked sets to unlinked ones."""
    k = len(reps)
    size = np.array([len(t) for t in tokens])
    flat = np.concatenate(tokens)
    _, code = np.unique(flat, return_inverse=True)
    upto = np.append(0, np.cumsum(size))
    label = np.full(k, -1, np.int64)

    def postings(alive: np.ndarray):
        owner = np.repeat(np.flatnonzero(alive), size[alive])
        c = code[ranges(upto[:-1][alive], size[alive])]
        order = np.argsort(c, kind="stable")
        return owner[order], np.append(0, np.cumsum(np.bincount(c, minlength=int(code.max(initial=0)) + 1)))

    alive = np.ones(k, bool)
    owner, at = postings(alive)
    built = k
    for seed in np.argsort(reps, kind="stable").tolist():
        if not alive[seed]:
            continue
        alive[seed] = False
        label[seed] = reps[seed]
        queue = [seed]
        while queue:
            i = queue.pop()
            left = int(alive.sum())
            if not left:
                break
            if left < built // 2:
                owner, at = postings(alive)
                built = left
            c = code[upto[i] : upto[i + 1]]
            other, common = np.unique(owner[ranges(at[c], at[c + 1] - at[c])], return_counts=True)
            good = other[alive[other] & (100 * common >= percent * (n[i] + n[other] - common))]
            alive[good] = False
            label[good] = reps[seed]
            queue.extend(good.tolist())
        if not alive.any():
            break
    return label


def verify(percent: int):
    """The class of each set within its block, by the set of its smallest document."""

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group["rep"].to_numpy(), kind="stable")
        tokens = group["tokens"].to_pylist()
        root = linked(np.arange(len(order)), group["n"].to_numpy()[order], [np.frombuffer(tokens[i], U64) for i in order], percent)
        sets, reps = (group[c].to_numpy()[order] for c in ("set", "rep"))
        return pa.table({"set": pa.array(sets, pa.int64()), "root": pa.array(sets[root], pa.int64()), "first": pa.array(reps[root], pa.int64())})

    return run


def visited(percent: int):
    """Edges between classes of visitors and of the sets of a block, wherever two of them link."""

    def run(group: pa.Table) -> pa.Table:
        guest, n, root = (group[c].to_numpy() for c in ("guest", "n", "root"))
        tokens = [np.frombuffer(t, U64) for t in group["tokens"].to_pylist()]
        home, out = np.flatnonzero(~guest), set()
        if len(home) and guest.any():
            flat = np.concatenate([tokens[i] for i in home])
            owner = np.repeat(home, [len(tokens[i]) for i in home])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for g in np.flatnonzero(guest).tolist():
                from_ = np.searchsorted(flat, tokens[g], "left")
                other, common = np.unique(owner[ranges(from_, np.searchsorted(flat, tokens[g], "right") - from_)], return_counts=True)
                good = other[(100 * common >= percent * (n[g] + n[other] - common)) & (root[other] != root[g])]
                out.update((int(root[g]), r) for r in np.unique(root[good]).tolist())
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def renamed(placed: DataFrame, edges: DataFrame, files: int) -> DataFrame:
    """The sets with classes that hang together over edges as one class."""
    same = components(edges, files=files)
    return cut(placed.join(same.select(F.col("node").alias("root"), F.col("label").alias("_to")), "root", "left").withColumn("root", F.coalesce("_to", "root")).drop("_to"), files)


def group_labels(by_set: DataFrame, groups: DataFrame, percent: int, group_bytes: int, files: int) -> DataFrame:
    """(set, label): the smallest document that each set of a candidate group hangs together with over exact links.

    A group of more than `group_bytes` bytes of tokens is dealt to blocks by a hash of the set.  Links within a block are found there.
    Once the classes that pivots join are known, a link not yet known has an end outside the largest class of its group; so it is found
    when all sets outside visit every block, in chunks."""
    size = F.length("tokens").cast("long")
    of_group = by_set.select("set", size.alias("bytes"), "rep").join(groups.select(F.col("node").alias("set"), F.col("label").alias("family")), "set")
    parts = of_group.groupBy("family").agg(F.ceil(F.sum("bytes") / group_bytes).cast("int").alias("parts"))
    placed = cut(of_group.join(parts, "family").withColumn("part", F.pmod(F.xxhash64("set"), "parts").cast("int")), files)
    blocks = cut(by_set.select("set", "n", "tokens").join(placed.select("set", "rep", "family", "part", "parts"), "set"), files)
    found = cut(blocks.select("set", "n", "tokens", "rep", "family", "part").groupBy("family", "part").applyInArrow(verify(percent), "`set` long, root long, first long"))
    split = placed.where("parts > 1")
    if split.isEmpty():
        return found.select("set", F.col("first").alias("label"))
    split = cut(split.join(found.select("set", "root"), "set"), files)
    tokens = blocks.where("parts > 1").select("set", "n", "tokens")

    def met(split: DataFrame, guests: DataFrame) -> DataFrame:
        """Edges from guests (set, root, family, parts, chunk, chunks), which visit every block of their family in chunks."""
        chunks = guests.groupBy("family").agg(F.max("chunks").alias("chunks"))
        columns = ["family", "part", "chunk", "set", "root", "guest"]
        home = split.join(chunks, "family").withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).withColumn("guest", F.lit(False))
        away = guests.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("guest", F.lit(True))
        both = home.select(columns).unionByName(away.select(columns)).join(tokens, "set")
        return both.groupBy("family", "part", "chunk").applyInArrow(visited(percent), "a long, b long")

    classes = split.where(F.col("part") < PIVOTS).groupBy("family", "parts", "part", "root").count()
    pivots = classes.groupBy("family", "parts", "part").agg(F.max_by("root", F.struct("count", "root")).alias("root")).drop("part")
    pivots = pivots.withColumns({"set": F.col("root"), "chunk": F.lit(0), "chunks": F.lit(1)})
    split = renamed(split, met(split, pivots), files)
    largest = split.groupBy("family", "root").count().groupBy("family").agg(F.max_by("root", F.struct("count", "root")).alias("_root"))
    outside = split.join(largest, "family").where("root != _root").drop("_root")
    chunks = outside.groupBy("family").agg(F.ceil(F.sum("bytes") / group_bytes).cast("int").alias("chunks"))
    outside = outside.join(chunks, "family").withColumn("chunk", F.pmod(F.xxhash64("set", F.lit(1)), "chunks").cast("int"))
    split = renamed(split, met(split, outside), files)
    first = split.groupBy("root").agg(F.min("rep").alias("label"))
    whole = found.join(split.select("set"), "set", "left_anti").select("set", F.col("first").alias("label"))
    return whole.unionByName(split.join(first, "root").select("set", "label"))


def jaccard_components(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bucket_bytes: int = BUCKET_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_print) for each row: component_id is the smallest doc_id reachable over links,
    which join rows whose shingle sets have a Jaccard similarity of `percent` % at least; text_print is xxhash64 of the text.

    Words are lower-cased by ASCII.  Fewer words than a shingle are one token; null or empty text has none and links with nothing, not even
    another empty text.  Rows are judged and reported each, so two texts under one doc_id have their own links.  A null doc_id gets a null
    component_id and takes no part.  Ties do not matter, as every link counts.  Other columns are ignored.  An empty table gives an empty result.
    Tokens are told apart by 64-bit fingerprints, sets by one of their tokens."""
    spark = documents.sparkSession
    small_batches(spark)
    text = F.col("text").cast("string")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_print"))
    meta = cut(texts.mapInArrow(describe(shingle), "doc_id long, text_print long, n_shingles long, print long"))
    # a set: its fingerprint, size, and smallest document with one of its texts
    sets = meta.where("doc_id is not null and n_shingles > 0").groupBy("print", "n_shingles").agg(F.min(F.struct("doc_id", "text_print")).alias("first"))
    sets = sets.select("print", "n_shingles", F.col("first.doc_id").alias("rep"), F.col("first.text_print").alias("text_print"))
    n = buckets(text_bytes(texts), bucket_bytes)
    tags = texts.where("doc_id is not null").mapInArrow(emit_tokens(shingle, n, TAG_BYTES), PACKED)
    shared = cut(tags.groupBy("bucket").applyInArrow(count_shared(n), COUNTED).groupBy("part").applyInArrow(add_counts, "print long, n long"), n)
    open_ = cut(sets.join(shared, "print").where(100 * F.col("n") >= percent * F.col("n_shingles")).select("print", "n_shingles", "rep", "text_print"), n)
    mine = texts.join(open_.select(F.col("rep").alias("doc_id"), "text_print"), ["doc_id", "text_print"], "left_semi").dropDuplicates(["doc_id", "text_print"]).select("doc_id", "text")
    n = max(12, n // 2)
    classes = mine.mapInArrow(emit_tokens(shingle, n, 8), PACKED).groupBy("bucket").applyInArrow(classify(n), CLASSED)
    by_set = classes.groupBy("part").applyInArrow(assemble, "`set` long, tokens binary, frequent binary")
    by_set = cut(by_set.join(open_.select(F.col("print").alias("set"), F.col("n_shingles").alias("n"), "rep"), "set").select("set", "n", "tokens", "frequent", "rep"), n)
    keys = by_set.mapInArrow(emit_keys(percent, n), INDEXED)
    groups = components(keys.groupBy("bucket").applyInArrow(joined_keys(percent), "a long, b long"), files=n)
    found = cut(group_labels(by_set, groups, percent, group_bytes, n), n)
    labels = sets.join(found.withColumnRenamed("set", "print"), "print", "left").select("print", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    return meta.join(labels, ["print", "n_shingles"], "left").select("doc_id", "n_shingles", component, "text_print")
