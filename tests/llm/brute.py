"""Plain versions of what the operators compute, for small tables."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def order(i):
    """Null ids come first."""
    return (i is not None, i or 0)


def components(n, links):
    up = list(range(n))

    def find(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a, b in links:
        up[find(a)] = find(b)
    return [find(k) for k in range(n)]


def named(ids, roots):
    """The least id of each one's component, None if it has none."""
    least = {}
    for i, r in zip(ids, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [least.get(r) for r in roots]


class KneserNey:
    def __init__(self, texts):
        self.uni, self.bi, self.n_texts = Counter(), Counter(), len(texts)
        for t in texts:
            w = [*SPACE.findall(low(t)), None]
            self.uni.update(w)
            self.bi.update(zip(["<s>", *w], w))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.before, self.after, self.total = Counter(w for _, w in self.bi), defaultdict(Counter), Counter()
        for (a, _), c in self.bi.items():
            self.after[a][min(c, 3)] += 1
            self.total[a] += c
        self.d2, self.d1 = self.discount(self.bi.values()), self.discount(self.before.values())

    @staticmethod
    def discount(counts):
        n = Counter(counts)
        if not n[1] or not n[2]:
            return [0, 0.5, 0.5, 0.5]
        y = n[1] / (n[1] + 2 * n[2])
        d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        return [0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))]

    def score(self, text):
        w = [*SPACE.findall(low(text)), None]
        base = sum(math.log10((self.uni[x] + 0.5) / (self.n + 0.5 * (self.v + 1))) for x in w)
        rest = sum(self.d1[min(c, 3)] for c in self.before.values())
        p = 0.0
        for a, b in zip(["<s>", *w], w):
            c = self.before[b]
            one = (c - self.d1[min(c, 3)] + rest / (self.v + 1)) / len(self.bi)
            if self.total[a]:
                c = self.bi[a, b]
                one = (c - self.d2[min(c, 3)]) / self.total[a] + sum(self.d2[k] * n for k, n in self.after[a].items()) / self.total[a] * one
            p += math.log10(one)
        return len(w), sum(self.uni[x] > 0 for x in w), base, p


def line_dedup(rows, min_chars=50):
    """Of (id, text): the lines to remove of each row."""
    at = {}
    each = []
    for i, t in rows:
        lines = t.split("\n") if t is not None else []
        runs = []
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += len(lines[b])
                if n >= min_chars:
                    # longer runs from here contain this one, and repeat only where it does
                    runs.append((a, b + 1))
                    break
        for b in range(len(lines)):
            n = 0
            for a in range(b, -1, -1):
                n += len(lines[a])
                if n >= min_chars:
                    runs.append((a, b + 1))
                    break
        each.append((lines, runs))
        for a, b in runs:
            key = tuple(lines[a:b])
            at[key] = min(at.get(key, (order(i), a)), (order(i), a))
    out = []
    for (i, _), (lines, runs) in zip(rows, each):
        out.append({k for a, b in runs if at[tuple(lines[a:b])] < (order(i), a) for k in range(a, b)})
    return out


def fingerprint(text):
    w = SPACE.findall(low(text))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def similar(rows, shingle=5):
    """Components of texts whose sets of shingles are 0.8 or more alike."""
    words = [SPACE.findall(low(t)) for _, t in rows]
    sets = [{tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set() for w in words]
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    return named([i for i, _ in rows], components(len(rows), links))


def simhash(rows):
    f = [fingerprint(t) for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(f)), 2) if (f[a] ^ f[b]).bit_count() <= 2]
    return f, named([i for i, _ in rows], components(len(rows), links))


def contamination(texts, items):
    windows = defaultdict(set)
    for name, t in items:
        w = ITEM.findall(low(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(name)
    sizes = {len(w) for w in windows}
    out = []
    for t in texts:
        w = ITEM.findall(low(t))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= names
        found = sorted(str(x) for x in found if x is not None)
        out.append((len(w), len(hit), len(found), sha(",".join(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def suffix_dedup(rows, window=50):
    first = {}
    data = [(order(i), (t or "").encode()) for i, t in rows]
    for i, t in data:
        for k in range(len(t) - window + 1):
            s = t[k : k + window]
            if s not in first or i < first[s]:
                first[s] = i
    out = []
    for i, t in data:
        gone = bytearray(len(t))
        for k in range(len(t) - window + 1):
            if first[t[k : k + window]] < i:
                gone[k : k + window] = b"\1" * window
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


def luhn(s):
    d = [int(x) for x in reversed(re.sub("[^0-9]", "", s))]
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d)) % 10 == 0


def private(text):
    """kind, start and end of the base spans."""
    digits = lambda s: len(re.sub("[^0-9]", "", s))
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= digits(s) <= 19 and luhn(s)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= digits(s) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, good in rules for m in re.finditer(p, text or "") if good(m[0])]
