"""Plain, slow versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def suffix_dedup(docs, window=400):
    """docs: [(id, text)] -> {(id, n_bytes, n_removed, n_spans, sha)} as a Counter."""
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[s : s + window] for _, b in raw for s in range(len(b) - window + 1))
    out = Counter()
    for i, b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if seen[b[s : s + window]] > 1:
                gone[s : s + window] = b"\1" * window
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[(i, len(b), sum(gone), spans, sha(kept))] += 1
    return out


def substring_dedup(docs, window=20):
    """Distinct ids only."""
    words = {i: WORD.findall(t or "") for i, t in docs}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), (i, s))
    out = Counter()
    for i, w in words.items():
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (i, s):
                gone[s : s + window] = [True] * window
        out[(i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode()))] += 1
    return out


def shingles(text, n=3, lower=True):
    t = text or ""
    if lower:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t)
    w = WORD.findall(t)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def join_components(docs, percent=90, n=3, lower=True):
    sets = {i: shingles(t, n, lower) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    shared = Counter()
    for ids in by.values():
        ids = sorted(ids)
        for x in range(len(ids)):
            for y in range(x + 1, len(ids)):
                shared[ids[x], ids[y]] += 1
    for (a, b), k in shared.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return Counter((i, len(s), find(i)) for i, s in sets.items())


def edited(docs):
    """[(id, n_chars, sha of the edited text)] for distinct ids."""
    d = sorted(docs)
    out = []
    for x, (i, t) in enumerate(d):
        t, nxt = t or "", d[(x + 1) % len(d)][1] or ""
        k = len(t) // 2
        out.append((i, len(t), sha((t[: len(t) - k] + nxt[:k]).encode())))
    return out


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


def measures(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = Counter(wins)
    hit = {p for i, x in enumerate(wins) if many[x] > 1 for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def base_failed(m):
    return m[0] < 20 or 100 * m[4] > 30 * m[0]


def targets(sizes, cap=3):
    """{source: target}: shares by weight 1, 2, 3 in code point order (None last), the excess over the cap reshared until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: n % 3 + 1 for n, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def mix(docs):
    """docs: [(id, source, size)] -> {id: copies}, for distinct ids."""
    by = defaultdict(list)
    for i, s, n in docs:
        by[s].append((hashlib.md5(f"mix|{i}".encode()).hexdigest(), i, n))
    want, out = targets({s: sum(n for _, _, n in v) for s, v in by.items()}), {}
    for s, v in by.items():
        size, at = sum(n for _, _, n in v), 0
        whole = int(want[s] // size) if size else 0
        for _, i, n in sorted(v):
            out[i] = (whole + (at + n / 2 <= want[s] - whole * size)) if n else 0
            at += n
    return out


def pieces(ids, capacity=1024):
    """[(piece, start, length, crc)] of a document's ids."""
    import numpy as np

    n = len(ids)
    first = n % capacity or capacity if n > capacity else n
    cuts = [0, *range(first, n, capacity), n]
    return [(p, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
