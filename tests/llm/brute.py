"""Plain Python versions of the corpus operators' contracts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import xxhash

SPACES = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t, pattern=SPACES):
    return re.findall(pattern, t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def distance(a, b):
    """Words to take out or put in."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def op1(text, templates, sizes, most=0.15):
    """(name, differences, wording) of the matches of every stretch of words with every template."""
    found = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[\w.+/&-]*\w", text or "")]
    matches = []
    for name, t in sorted(templates.items()):
        a = re.findall(r"[\w.+/&-]*\w", t.lower())
        limit = int(2 * most * len(a))
        for j in range(1, len(found) + 1):
            best = min(((distance(a, [w for w, _, _ in found[i:j]]), -i) for i in range(max(0, j - len(a) - limit), j)), default=(99, 0))
            if best[0] <= limit:
                start, stop = found[-best[1]][1], found[j - 1][2]
                while stop < len(text) and not text[stop].isspace() and not re.match(r"[\w.+/&-]*\w", text[stop:]):
                    stop += 1
                alone, primed = sizes(name, text[start:stop].encode())
                matches.append((best[0], primed - alone, name, start, stop))
    taken = []
    for m in sorted(matches):
        if all(m[4] <= t[3] or m[3] >= t[4] for t in taken):
            taken.append(m)
    return sorted((m[3], m[2], m[0], text[m[3] : m[4]]) for m in taken)


def op2(pages):
    first = {}
    size = lambda h: len((h or "").encode())
    for p, _, h in pages:
        if size(h) >= 100 and p is not None:
            first[h] = min(first.get(h, p), p)
    out = []
    for p, _, h in pages:
        refers = first.get(h) if size(h) >= 100 and first.get(h, p) != p else None
        out.append((p, size(h), sha(h or ""), "revisit" if refers is not None else "response", refers))
    return out


def op3(docs, bits=4):
    prints = []
    for _, t in docs:
        w = words(lower(t))
        grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, f"{prints[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(docs)]


def op4_targets(sizes):
    """{source: size} to {source: target}, by sharing again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return {s: share.get(s, 2.0 * sizes[s]) for s in order}
        full.update(over)


def op5_base(docs):
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs]
    tokens = [[*words(lower(t)), None] for _, t in docs]
    c = Counter(x for h, t in zip(held, tokens, strict=True) if not h for x in t)
    n, v = sum(c.values()), len(c)
    return [(d, h, len(t), sum(c[x] > 0 for x in t), n, sum(log10((c[x] + 1) / (n + v + 1)) for x in t)) for (d, _), h, t in zip(docs, held, tokens, strict=True)]


def op6(docs, m=8):
    out = []
    for d, t in docs:
        w = words(t)
        lines = [x for x in (t or "").split("\n") if words(x)]
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeat = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        cover, longest = set(), 0
        starts = defaultdict(list)
        for i in range(len(w) - m + 1):
            starts[tuple(w[i : i + m])].append(i)
        for group in starts.values():
            for i in group:
                best = 0
                for j in group:
                    if i != j:
                        k = m
                        while max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                            k += 1
                        best = max(best, k)
                if best:
                    cover |= set(range(i, i + best))
                    longest = max(longest, best)
        n = len(w)
        failed = n < 50 or 100 * len(repeat) > 50 * n
        kept = not failed and len(cover) <= 0.25 * n and longest <= 0.125 * n
        out.append((d, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeat), failed, kept, len(cover), longest))
    return out


def op9(docs, items, n=13):
    phrases = defaultdict(set)
    for i, t in items:
        w = words(lower(t), ALNUM)
        for s in range(max(1, len(w) - n + 1)) if w else ():
            phrases[tuple(w[s : s + n])].add(i)
    lengths = {len(p) for p in phrases}
    out = []
    for d, t in docs:
        w = words(lower(t), ALNUM)
        hit, found = set(), set()
        for k in lengths:
            for s in range(len(w) - k + 1):
                if (p := tuple(w[s : s + k])) in phrases:
                    hit |= set(range(s, s + k))
                    found |= phrases[p]
        ids = sorted(str(x) for x in found)
        out.append((d, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def op10(docs, n=13):
    rank = lambda d: (d is None, d or 0)
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if g not in first or rank(d) < rank(first[g]):
                first[g] = d
    out = []
    for d, t in docs:
        w = words(t)
        gone = {i + k for i in range(len(w) - n + 1) if rank(first[tuple(w[i : i + n])]) < rank(d) for k in range(n)}
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out
