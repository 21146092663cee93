"""Plain versions of the operators, for small tables."""

import math
import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def order(value):
    return (value is not None, value or 0)


def repeats(rows, window):
    words = [WORDS.findall(t or "") for _, t in rows]
    runs = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if runs[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def lines(rows, percent=80):
    """(id, line, removed) of every place with words."""
    places = sorted({(order(i), k, x) for i, t in rows for k, x in enumerate((t or "").split("\n")) if WORDS.search(x)})
    first, sets, seen, out = {}, [], defaultdict(list), set()
    for i, k, x in places:
        s = frozenset(WORDS.findall(x))
        if x not in first:
            shared = Counter(j for w in s for j in seen[w])
            similar = any(100 * n >= percent * (len(s) + len(sets[j][0]) - n) for j, n in shared.items() if sets[j][1] != (i, k))
            first[x] = ((i, k), similar)
            for w in s:
                seen[w].append(len(sets))
            sets.append((s, (i, k)))
        out.add((i, k, first[x][1] or first[x][0] != (i, k)))
    return out


def contamination(rows, items, window=13):
    windows = {}
    for name, text in items:
        w = PLAIN.findall(lower(text))
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(name))
    sizes, out = sorted({len(k) for k in windows}), []
    for d, text in rows:
        w = PLAIN.findall(lower(text))
        hit, found = [False] * len(w), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if names := windows.get(tuple(w[i : i + k])):
                    found |= names
                    hit[i : i + k] = [True] * k
        out.append((d, len(w), sum(hit), sorted(found), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


def context_trees(train, texts, depth):
    """Log10 probability of every text."""
    counts, children = defaultdict(lambda: [0, 0]), defaultdict(list)

    def steps(text):
        s = b"\0" * depth + lower(text).encode() + b"\0"
        for p in range(depth, len(s)):
            node = 1
            for k in range(8):
                bit = s[p] >> (7 - k) & 1
                yield [(s[p - d : p], node) for d in range(depth + 1)], bit
                node = node * 2 + bit

    for t in train:
        for keys, bit in steps(t):
            for key in keys:
                counts[key][bit] += 1
    for c, n in counts:
        if c:
            children[c[1:], n].append((c, n))
    weighted, share = {}, {}
    for key, (a, b) in sorted(counts.items(), key=lambda x: -len(x[0][0])):
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        weighted[key], share[key] = own, 1.0
        if len(key[0]) < depth:
            below = sum(weighted[c] for c in children[key])
            top = max(own, below)
            weighted[key] = top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2)
            share[key] = math.exp(own - math.log(2) - weighted[key])
    out = []
    for t in texts:
        total = 0.0
        for keys, bit in steps(t):
            p = 0.5
            for key in reversed(keys):
                a, b = counts.get(key, (0, 0))
                p = share[key] * (b + 0.5) / (a + b + 1) + (1 - share[key]) * p if key in share else 0.5
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def near(rows, size, percent=80):
    """(id, set size, component, kept)."""
    sets = []
    for d, text in rows:
        w = WORDS.findall(lower(text))
        sets.append((d, frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()))
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    places = defaultdict(list)
    for i, (d, s) in enumerate(sets):
        if d is None:
            continue
        shared = Counter(j for x in s for j in places[x])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                a, b = root(d), root(sets[j][0])
                parent[max(a, b)] = min(a, b)
        for x in s:
            places[x].append(i)
    return [(d, len(s), None if d is None else root(d), d is None or root(d) == d) for d, s in sets]


def quality_counts(text):
    text = text or ""
    w = WORDS.findall(text)
    runs, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if runs[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    own = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(own) - len(set(own)), len(covered)
