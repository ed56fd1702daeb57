"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

UPPER = {i: i + 32 for i in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def simhash(rows):
    """[(doc_id, text)] -> [(doc_id, fingerprint, component_id)]."""
    prints = []
    for _, text in rows:
        w = SPACED.findall((text or "").translate(UPPER))
        shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [(d, f"{prints[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)]


def contamination(docs, bench, n=13):
    """[(doc_id, n_words, n_hit, n_items, sha, contaminated)]."""
    windows = defaultdict(set)
    for item, text in bench:
        w = PLAIN.findall((text or "").translate(UPPER))
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i : i + k])].add("" if item is None else str(item))
    out = []
    for d, text in docs:
        w = PLAIN.findall((text or "").translate(UPPER))
        hit, items = set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if found := windows.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    items |= found
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(items), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def substring(docs, k=35):
    """[(doc_id, n_words, n_removed, kept)]."""
    words = [SPACED.findall(t or "") for _, t in docs]
    count = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (d, _), w in zip(docs, words, strict=True):
        gone = {j for i in range(len(w) - k + 1) if count[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def likeness(a, b):
    if a == b:
        return 1.0
    (ba, *sa), (bb, *sb) = a.split(":"), b.split(":")
    ba, bb = int(ba), int(bb)

    def alike(x, y):
        return 1.0 if not x and not y else 1 - distance(x, y) / max(len(x), len(y))

    if ba == bb:
        return max(alike(sa[0], sb[0]), alike(sa[1], sb[1]))
    if ba == 2 * bb:
        return alike(sa[0], sb[1])
    return alike(sa[1], sb[0]) if bb == 2 * ba else 0.0


def tokens(docs, tokenizer, end=1):
    """Sorted docs -> [(doc_id, start, n_tokens, crc)]."""
    at, out = 0, []
    for d, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def water(capacity, weight, budget):
    """Shares by weight under capacities, in whole units, the shortage of one going to the others."""
    left, out, open_ = budget, {}, dict(weight)
    while open_:
        total = sum(open_.values())
        full = [k for k in open_ if capacity[k] * total <= open_[k] * left]
        if not full:
            return out | {k: w * left // total for k, w in open_.items()}
        k = min(full, key=lambda x: (capacity[x] / weight[x], x))
        out[k] = capacity[k]
        left -= capacity[k]
        del open_[k]
    return out


M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def piecewise(data, gear, signs, window=7, target=64, base=0x5851F42D4C957F2D):
    """A fingerprint by its rule, byte by byte."""
    if not data:
        return "1::"

    def place(i):
        v = sum(gear[data[i - k]] * (1 if k == 0 else (2 * k + 1) ** 3) for k in range(min(window, i + 1))) & M32
        v = (v ^ v >> 16) * 0x7FEB352D & M32
        v = (v ^ v >> 15) * 0x846CA68B & M32
        return v ^ v >> 16

    def sign(part):
        h = 0
        for b in reversed(part):
            h = (h * base + b + 1) & M64
        h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & M64
        return signs[h >> 58]

    places = [place(i) for i in range(len(data))]

    def signature(block):
        out, at = "", 0
        for i, v in enumerate(places):
            if v % block == block - 1 and i + 1 - at >= max(1, block // 4):
                out, at = out + sign(data[at : i + 1]), i + 1
        return out + (sign(data[at:]) if at < len(data) else "")

    first = 1
    while first * target < len(data):
        first *= 2
    block = first
    while len(signature(block)) < target // 2 and block > max(1, first // 8):
        block //= 2
    return f"{block}:{signature(block)}:{signature(2 * block)}"


def gru(texts, cells, steps, w, b):
    """Mean probabilities of each text: both directions step by step over windows of ``steps`` bytes, zeros behind the end."""
    out = []
    for text in texts:
        total = [0.0] * len(w)
        for at in range(0, len(text), steps):
            x = list(text[at : at + steps].ljust(steps, b"\0"))
            n = min(steps, len(text) - at)
            states = []
            for (e, u, c), order in zip(cells, (range(steps), reversed(range(steps))), strict=True):
                hid, seen = len(c), {}
                h = [0.0] * hid
                for t in order:
                    m = [sum(u[k][j] * h[j] for j in range(hid)) for k in range(3 * hid)]
                    z = [1 / (1 + math.exp(-(e[k][x[t]] + m[k]))) for k in range(hid)]
                    r = [1 / (1 + math.exp(-(e[hid + k][x[t]] + m[hid + k]))) for k in range(hid)]
                    a = [math.tanh(e[2 * hid + k][x[t]] + r[k] * (m[2 * hid + k] + c[k])) for k in range(hid)]
                    h = [(1 - z[k]) * a[k] + z[k] * h[k] for k in range(hid)]
                    seen[t] = h
                states.append(seen)
            for t in range(n):
                both = states[0][t] + states[1][t]
                v = [math.exp(sum(p * q for p, q in zip(row, both, strict=True)) + o) for row, o in zip(w, b, strict=True)]
                total = [s + q / sum(v) for s, q in zip(total, v, strict=True)]
        out.append([s / max(1, len(text)) for s in total])
    return out


def boosted(row, start, trees, knots):
    """The calibrated score of one text's features, node by node."""
    raw = start
    for feature, cut, leaf in trees:
        at = 0
        while at < len(feature):
            at = 2 * at + 1 + (row[feature[at]] > cut[at])
        raw += leaf[at - len(feature)]
    xs, ys = knots
    if raw <= xs[0] or raw >= xs[-1]:
        return ys[0] if raw <= xs[0] else ys[-1]
    i = max(k for k, v in enumerate(xs) if v <= raw)
    return ys[i] + (ys[i + 1] - ys[i]) * (raw - xs[i]) / (xs[i + 1] - xs[i])


def toxic_features(text, words, stems, insults, you, looks, sizes=(4, 5, 6), near=5):
    """Densities counted word by word over the text in its order."""
    letter = lambda c: c.isalpha()
    ws = text.lower().split()
    n = max(1, len(ws))
    bare = [w[next((i for i, c in enumerate(w) if c.isalnum() or c == "_"), len(w)) :] for w in ws]
    bare = [b[: max((i + 1 for i, c in enumerate(b) if c.isalnum() or c == "_"), default=0)] for b in bare]
    bare = [w if w.isalpha() else b for w, b in zip(ws, bare, strict=True)]
    stem = [next((w[:k] for k in sizes if w[:k] in stems and len(w) > k), None) for w in ws]
    marks = set("0123456789@$!*_.-")
    odd = [b not in insults and bool(b) and not b.isalpha() and any(c in marks and any(map(letter, b[i + 1 :])) for i, c in enumerate(b)) for b in bare]
    plain = ["".join(looks.get(c, c) for c in w) for w in ws]
    hidden = [o and (x in insults or x in words) for o, x in zip(odd, plain, strict=True)]
    term = [b in words or b in insults or h for b, h in zip(bare, hidden, strict=True)]
    second = [i for i, w in enumerate(ws) if w in you]
    close = sum(t and any(abs(i - j) <= near for j in second) for i, t in enumerate(term))
    strong, weights = sum(b in words for b in bare), [words[b] for b in bare if b in words]
    fixed, sw = sum(b in insults for b in bare), [stems[s] for s in stem if s]
    raw = text.encode()
    upper, lower = sum(65 <= c < 91 for c in raw), sum(97 <= c < 123 for c in raw)
    digit, shout = sum(48 <= c < 58 for c in raw), sum(c in b"!?" for c in raw)
    beyond = sum(c >= 128 for c in raw)
    other = sum(33 <= c < 127 for c in raw) - upper - lower - digit - shout
    size = max(1, upper + lower + digit + shout + other + beyond)
    return [
        strong / n, math.log1p(strong), sum(weights) / n, max(weights, default=0.0), fixed / n, math.log1p(fixed), sum(hidden) / n, len({w for w, o in zip(ws, odd, strict=True) if o}) / n, len(second) / n,
        close / n, math.log1p(close), len(sw) / n, math.log1p(len(sw)), sum(sw) / n, max(sw, default=0.0), math.log1p(len({w for w, s in zip(ws, stem, strict=True) if s})), upper / max(1, upper + lower),
        digit / size, shout / size, other / size, beyond / size, math.log1p(len(ws)), len(set(ws)) / n,
    ]
