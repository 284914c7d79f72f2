"""Plain versions of the contracts, for small inputs."""

import collections
import hashlib
import math
import re

UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def covered(n, starts, width):
    out = [False] * n
    for s in starts:
        out[s : s + width] = [True] * width
    return out


def repeats(docs, split, width):
    """doc_id -> (pieces, removed mask): pieces covered by a window that also starts in a smaller document."""
    pieces = {i: split(t or "") for i, t in docs.items()}
    first = {}
    for i in sorted(pieces):
        p = pieces[i]
        for k in range(len(p) - width + 1):
            first.setdefault(tuple(p[k : k + width]), i)
    return {i: (p, covered(len(p), [k for k in range(len(p) - width + 1) if first[tuple(p[k : k + width])] < i], width)) for i, p in pieces.items()}


def op4(docs):
    out = {}
    for i, (p, gone) in repeats(docs, lambda t: t.encode().split(), 50).items():
        kept = b" ".join(w for w, g in zip(p, gone) if not g)
        out[i] = (len(p), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def op3(docs):
    out = {}
    for i, (p, gone) in repeats(docs, lambda t: t.encode(), 50).items():
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(p), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(p, gone) if not g)).hexdigest())
    return out


def shingles(text):
    w = (text or "").encode().translate(UPPER).split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def op8(docs):
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def op10(docs, items):
    low = lambda t: ALNUM.findall((t or "").encode().translate(UPPER))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = low(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    out = {}
    for i, t in docs.items():
        w, found, hit = low(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if here := windows.get(tuple(w[k : k + n])):
                    found |= here
                    hit |= set(range(k, k + n))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


def op6(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    c = collections.Counter(zip(w, w[1:], w[2:]))
    mask = covered(len(w), [k for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1], 3)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), sum(mask))


def op1(docs, trusted, smoothing):
    """Counts of whole words and pairs of words, in plain dictionaries."""
    texts = {i: (t or "").encode().translate(UPPER).split() for i, t in docs.items()}
    pairs = {i: list(zip([None, *w], w)) for i, w in texts.items()}

    def counted(ids):
        return [collections.Counter(f(p) for i in ids for p in pairs[i]) for f in (lambda p: p[1], lambda p: p[0], lambda p: p)]

    every, target = counted(texts), counted([i for i in texts if i in trusted])
    out = {}
    for i, w in texts.items():
        own, mean = counted([i]), []
        for model, less in ((target, i in trusted), (every, True)):
            loss, total = 0.0, sum(model[0].values()) + len(every[0])
            for p in pairs[i]:
                word, first, pair = (m[k] - less * o[k] for m, o, k in zip(model, own, (p[1], p[0], p)))
                alone = (word + 1) / total
                loss -= math.log((pair + smoothing * alone) / (first + smoothing))
            mean.append(loss / max(len(w), 1))
        out[i] = (len(w), *mean)
    return out
