"""The operators' contracts in plain Python, for small inputs."""

import math
import re
import zlib
from collections import Counter, defaultdict


def words(text):
    return (text or "").encode().lower().split()


def near_duplicates(rows, width=5):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            shared = len(x & y)
            if x and y and 100 * shared >= 75 * (len(x) + len(y) - shared):
                r, s = root(a), root(b)
                parent[max(r, s)] = min(r, s)
    return {i: (len(sets[i]), root(i)) for i in sets}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    def passes(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def katz(rows, discounts, folds=5, fold=1, reserve=0.5):
    """Rows (id, text) -> list of (n_tokens, n_known, N, base, score) in order."""
    tokens = [(i is not None and zlib.crc32(str(i).encode()) % folds == fold, [*words(t), None]) for i, t in rows]
    single, double, history = Counter(), Counter(), Counter()
    for held, w in tokens:
        if not held:
            before = ["<s>", *w[:-1]]
            single.update(w)
            double.update(zip(before, w))
            history.update(before)
    d1, d2 = (discounts([sum(c == r for c in t.values()) for r in range(1, 7)]) for t in (single, double))
    n, v = sum(single.values()), len(single)

    def kept(d, c):
        return d[min(c, 6)] * c

    unknown = (reserve + sum(c - kept(d1, c) for c in single.values())) / (n + reserve)

    def alone(w):
        return kept(d1, single[w]) / (n + reserve) if single[w] else unknown

    mass, free = defaultdict(float), defaultdict(float)
    for (a, b), c in double.items():
        mass[a] += alone(b)
        free[a] += c - kept(d2, c)

    def probability(a, b):
        if double[a, b]:
            return kept(d2, double[a, b]) / (history[a] + reserve)
        if history[a]:
            return (free[a] + reserve) / (history[a] + reserve) / (1 - mass[a]) * alone(b)
        return alone(b)

    out = [(len(w), sum(single[x] > 0 for x in w), n, sum(math.log10((single[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w),
            sum(math.log10(probability(a, b)) for a, b in zip(["<s>", *w[:-1]], w))) for _, w in tokens]
    totals = [sum(probability(a, b) for b in single) + (probability(a, "never seen") if ("never seen",) else 0) for a in list(history)[:5]]
    return out, totals
