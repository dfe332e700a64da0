"""Plain restatements of the contracts, for small tables."""

import hashlib
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def line_dedup(docs):
    key = lambda x: lower(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x))
    held = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10 and i is not None:
                held.setdefault(key(x), set()).add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < 2 or min(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def quality_base(docs):
    out = []
    for i, t in docs:
        t = t or ""
        w = WORD.findall(t)
        lines, dup, seen = t.split("\n"), 0, set()
        for x in lines:
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        at = {}
        for k in range(len(w) - 4):
            at.setdefault(tuple(w[k : k + 5]), []).append(k)
        rep = {p + j for v in at.values() if len(v) > 1 for p in v for j in range(5)}
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)))
    return out


def simhash(docs):
    prints = []
    for _, t in docs:
        w = WORD.findall(lower(t or ""))
        parts = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, f"{p:016x}", least.get(find(k))) for k, ((i, _), p) in enumerate(zip(docs, prints))]


def nearest_part(item, text):
    """Smallest number of edits between the item and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


class Katz:
    """A bigram model in dictionaries, after Katz (1987); the unknown word has the unigrams' left-over mass."""

    def __init__(self, docs, discounts):
        from collections import Counter
        from math import log10

        self.log10, self.uni, self.bi = log10, Counter(), Counter()
        self.tokens = lambda t: [lower(w) for w in WORD.findall(t or "")] + [""]
        for i, t in docs:
            if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1:
                w = self.tokens(t)
                self.uni.update(w)
                self.bi.update(zip(["", *w], w))
        self.n = sum(self.uni.values())
        count = lambda c: [sum(v == r for v in c.values()) for r in range(7)]
        self.d1, self.d2 = discounts(count(self.uni)), discounts(count(self.bi))
        left = self.n and sum((1 - self.d1[min(c, 6)]) * c for c in self.uni.values()) / self.n
        self.s1, self.unknown = (1, left) if left > 0 else (self.n / (self.n + 1), 1 / (self.n + 1))
        self.follow = {}
        for (h, w), c in self.bi.items():
            self.follow.setdefault(h, {})[w] = c

    def low(self, w):
        c = self.uni[w]
        return self.d1[min(c, 6)] * c * self.s1 / self.n if c else self.unknown

    def p(self, h, w):
        f = self.follow.get(h)
        if not f:
            return self.low(w)
        c = sum(f.values())
        left = sum((1 - self.d2[min(x, 6)]) * x for x in f.values()) / c
        scale, left = (1, left) if left > 1e-12 else (c / (c + 1), 1 / (c + 1))
        if w in f:
            return self.d2[min(f[w], 6)] * f[w] / c * scale
        return left / (1 - sum(self.low(x) for x in f)) * self.low(w)

    def rows(self, docs):
        for i, t in docs:
            w = self.tokens(t)
            base = sum(self.log10((self.uni[x] + 0.5) / (self.n + 0.5 * (len(self.uni) + 1))) for x in w)
            yield (i, zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1, len(w), sum(self.uni[x] > 0 for x in w), self.n,
                   round(base, 6), round(sum(self.log10(self.p(h, x)) for h, x in zip(["", *w], w)), 6))
