"""Suffix-array dedup over bytes: every copy of a repeated 400-byte string goes.

Each shard (see repeats) gets a suffix array by Larsson-Sadakane refinement (groups of equal prefixes
are re-sorted by the rank behind them, with doubling length; finished groups drop out) and common
prefixes by Kasai's rule. In a contested shard the prefixes tell which windows occur twice; a shard
that was split is merged by binary search of one part's windows in the other's array. Into a shard of
witnesses the runs that claim them are merged by binary search too: one search finds all places where
a whole run stands. No byte goes that one of these searches has not found elsewhere.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, repeats
from . import textnum as tn

WINDOW = 400
GRAM = 40
#: Bytes of context under one suffix array; a larger shard is split, and its parts merged.
ARRAY_BYTES = 2 << 20
#: Ranges of an anchor's place in a window by which contested windows are told apart before the arrays.
CLASSES = 9


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """All suffixes in order (symbols below 65,535, a suffix before those it begins)."""
    n = len(symbols)
    if n < 2:
        return np.arange(n)
    h, bits = (5, 12) if symbols.max() < 4095 else (4, 16)
    s = np.zeros(n + h, np.uint64)
    s[:n] = symbols.astype(np.uint64) + np.uint64(1)
    packed = np.zeros(n, np.uint64)
    for k in range(h):
        packed = (packed << np.uint64(bits)) | s[k : n + k]
    sa = np.argsort(packed)
    key = packed[sa]
    head = np.empty(n, bool)
    head[0], head[1:] = True, key[1:] != key[:-1]
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = start
    while True:
        live = np.flatnonzero(~(head & np.append(head[1:], True)))  # groups of two and more
        if not len(live):
            break
        pos, group = sa[live], start[live]
        pair = group * (n + 1) + rank[np.minimum(pos + h, n)] + 1
        order = np.argsort(pair)  # groups stay in place: their starts lead the key
        pos, pair = pos[order], pair[order]
        sa[live] = pos
        fresh = np.empty(len(live), bool)
        fresh[0], fresh[1:] = True, pair[1:] != pair[:-1]
        head[live] = fresh
        start[live] = np.maximum.accumulate(np.where(fresh, live, 0))
        rank[pos] = start[live]
        h *= 2
    return sa


def kasai(data: np.ndarray, left: np.ndarray, sa: np.ndarray, cap: int, lanes: int = 8192) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array, at most ``cap``.

    ``data`` are bytes and ``left`` says how many of them remain to a place's own context. Kasai's rule
    (one less than the text's previous suffix has, at least) runs along ``lanes`` stretches of the
    text side by side, eight bytes a comparison.
    """
    n = len(data)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    rank = np.empty(n, np.int64)
    rank[sa] = np.arange(n)
    pad = np.concatenate([data, np.zeros(cap + 16, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(pad, (n + cap + 8, 8), (1, 1)).copy().view("<u8").ravel()
    step = -(-n // lanes)
    at = np.arange(0, n, step)
    h = np.zeros(len(at), np.int64)
    for t in range(step):
        i = at + t
        i = i[i < n]
        hh = h[: len(i)]
        r = rank[i]
        j = sa[r - 1]  # of the first suffix the last one, which is set right below
        most = np.minimum(np.minimum(left[i], left[j]), cap)
        hh = np.minimum(hh, most)
        live = np.flatnonzero(hh < most)
        while len(live):
            x = eight[i[live] + hh[live]] ^ eight[j[live] + hh[live]]
            low = x & (~x + np.uint64(1))
            run = np.where(x == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) >> 3)
            hh[live] += run
            live = live[(run == 8) & (hh[live] < most[live])]
        hh = np.where(r > 0, np.minimum(hh, most), 0)
        lcp[r] = hh
        h[: len(i)] = np.maximum(hh - 1, 0)
    return lcp


def _index(contexts: list[np.ndarray], window: int):
    """(bytes, context and offset of each byte, bytes left in it, suffix array, lcp) of contexts with separators between them."""
    sizes = np.array([len(c) + 1 for c in contexts])
    ends = np.cumsum(sizes)
    text = np.zeros(int(ends[-1]), np.int64)
    which = np.repeat(np.arange(len(contexts)), sizes)
    off = np.arange(len(text)) - np.repeat(ends - sizes, sizes)
    left = sizes[which] - 1 - off
    body = left > 0
    data = np.zeros(len(text), np.uint8)
    data[body] = np.concatenate(contexts)
    text[body] = data[body]
    text[~body] = 256 + np.arange(len(contexts))  # each its own, so that no match crosses it
    sa = suffix_array(text)
    return data, which, off, left, sa, kasai(data, left, sa, window)


def repeated_windows(contexts: list[np.ndarray], window: int = WINDOW, limit: int = ARRAY_BYTES) -> list[np.ndarray]:
    """For each context the offsets of its windows that occur anywhere else in the shard."""
    parts, size = [[]], 0
    for n, c in enumerate(contexts):
        if size + len(c) + 1 > limit and parts[-1] or len(parts[-1]) >= 60_000:
            parts.append([])
            size = 0
        parts[-1].append(n)
        size += len(c) + 1
    marks = [np.zeros(max(0, len(c) - window + 1), bool) for c in contexts]
    arrays = []
    for ids in parts:
        data, which, off, left, sa, lcp = _index([contexts[n] for n in ids], window)
        full = lcp >= window
        _mark(marks, ids, which, off, sa[full | np.append(full[1:], False)])
        if len(parts) > 1:
            arrays.append((ids, data, which, off, sa[(left[sa] >= window) & ~full]))  # one suffix of each different window, sorted
    for x in range(len(arrays)):
        for y in range(x + 1, len(arrays)):
            _merge(arrays[x], arrays[y], marks, window)
    return [np.flatnonzero(m) for m in marks]


def _mark(marks: list[np.ndarray], ids: list[int], which: np.ndarray, off: np.ndarray, at: np.ndarray) -> None:
    at = np.sort(at)
    bounds = np.searchsorted(which[at], np.arange(len(ids) + 1))
    for k in np.flatnonzero(np.diff(bounds)):
        marks[ids[k]][off[at[bounds[k] : bounds[k + 1]]]] = True


def _merge(left, right, marks: list[np.ndarray], window: int) -> None:
    """Marks windows that both arrays hold: a binary search of every window of one in the other."""
    lt, ls, rt, rs = left[1], left[4], right[1], right[4]
    if not len(ls) or not len(rs):
        return
    lo, hi = np.zeros(len(ls), np.int64), np.full(len(ls), len(rs))
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            break
        mid = (lo[live] + hi[live]) // 2
        less = _compare(rt, rs[mid], lt, ls[live], window) < 0
        lo[live] = np.where(less, mid + 1, lo[live])
        hi[live] = np.where(less, hi[live], mid)
    inside = np.flatnonzero(lo < len(rs))
    same = inside[_compare(rt, rs[lo[inside]], lt, ls[inside], window) == 0]
    for (ids, _, which, off, _), at in ((left, ls[same]), (right, rs[lo[same]])):
        _mark(marks, ids, which, off, at)


def _compare(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, window: int, step: int = 16) -> np.ndarray:
    """Sign of a[i:i+window] against b[j:j+window], element by element, a few bytes at a time."""
    out = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    for k in range(0, window, step):
        if not len(live):
            break
        at = np.arange(k, min(k + step, window))
        d = a[i[live, None] + at].astype(np.int64) - b[j[live, None] + at]
        first = (d != 0).argmax(1)
        v = np.sign(d[np.arange(len(live)), first])
        out[live] = v
        live = live[v == 0]
    return out


class Reference:
    """A suffix array over some runs (key, lo, bytes, anchor), for searching whole runs."""

    def __init__(self, runs: list[tuple[int, int, bytes, int]]) -> None:
        self.data = b"\0".join(r[2] for r in runs) + b"\0"
        self.ends, self.runs = np.cumsum([len(r[2]) + 1 for r in runs]), runs
        self.sa = suffix_array(np.frombuffer(self.data, np.uint8).astype(np.int64))

    def elsewhere(self, key: int, lo: int, run: bytes) -> bool:
        """Whether ``run`` stands in a place other than (key, lo)."""
        sa, data = self.sa, self.data
        a, z = 0, len(sa)
        while a < z:
            mid = (a + z) // 2
            at = int(sa[mid])
            if data[at : at + len(run)] < run:
                a = mid + 1
            else:
                z = mid
        while a < len(sa):  # suffixes that begin with the run stand together
            at = int(sa[a])
            if data[at : at + len(run)] != run:
                return False
            n = int(np.searchsorted(self.ends, at, side="right"))
            start = at - (int(self.ends[n - 1]) if n else 0)
            own, first, body, _ = self.runs[n]
            if start + len(run) <= len(body) and (own, first + start) != (key, lo):
                return True
            a += 1
        return False


def hopeful(references: list, window: int, gram: int, classes: int = CLASSES) -> list[tuple[int, int, int]]:
    """(reference, first, last window) of what may occur in another reference of its anchor; the rest cannot.

    The windows of a run all have the anchor's gram inside, so they agree on it and, by where it lies in
    them (one of ``classes`` ranges of places), on a string around it that the whole range has. Equal
    windows have the gram at one place: windows of a range can only be equal to some of another
    reference whose string for that range has the same hash. A run without its gram is kept whole.
    """
    size = np.array([len(r[2]) for r in references])
    base, span = np.cumsum(size) - size, size - window
    h = np.array([r[3] for r in references], np.int64).view(np.uint64)
    prefix = tn.Prefix(tn.byte_values(np.frombuffer(b"".join(r[2] for r in references), np.uint8)))
    most = window - gram
    n = np.maximum(0, most + 1 - span)  # places all windows of the run have
    run = np.repeat(np.arange(len(size)), n)
    off = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + span[run]
    hit = np.flatnonzero(prefix.span(base[run] + off, base[run] + off + gram) == h[run])
    known, first = np.unique(run[hit], return_index=True)
    at = np.full(len(size), -1)
    at[known] = off[hit[first]]
    lo, hi = np.where(at < 0, 0, span + 1), np.where(at < 0, span, -1)
    step = max(1, -(-(most + 1) // classes))
    for least in range(0, most + 1, step):
        top = min(most, least + step - 1)  # the gram lies at least..top into the window
        own = np.flatnonzero((at >= least) & (at - span <= top))
        with np.errstate(over="ignore"):
            string = prefix.span(base[own] + at[own] - least, base[own] + at[own] + window - top) + tn.mix(h[own])
        _, which, times = np.unique(string, return_inverse=True, return_counts=True)
        own = own[times[which] > 1]
        lo[own] = np.minimum(lo[own], np.maximum(0, at[own] - top))
        hi[own] = np.maximum(hi[own], np.minimum(span[own], at[own] - least))
    return [(k, int(lo[k]), int(hi[k])) for k in np.flatnonzero(lo <= hi)]


def index(references: list, streamed: list, contested: bool, window: int = WINDOW, gram: int = GRAM) -> tuple[list, list]:
    """What a shard's suffix arrays find (see repeats.repeated_spans): (key, start, end) spans, and refused runs."""
    found, refused = [], []
    if contested:
        some = hopeful(references, window, gram)
        if not some:
            return found, refused
        offs = repeated_windows([np.frombuffer(references[k][2], np.uint8)[a : z + window] for k, a, z in some], window)
        for (k, a, _), o in zip(some, offs):
            key, lo = references[k][0], references[k][1] + a
            found += [(key, lo + s, lo + e) for s, e in repeats.joined(o, window)]
        return found, refused
    ref = Reference(references)
    for run in streamed:
        key, lo, body, _ = run
        if ref.elsewhere(key, lo, body):
            found.append((key, lo, lo + len(body)))
        else:
            refused.append(run)
    return found, refused


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = repeats.HOT) -> DataFrame:
    """The documents with n_bytes, n_removed, n_spans and ``kept`` (binary: a cut may split a character).

    A byte goes if a string of ``window`` bytes that covers it starts anywhere else, in the same
    document too. Matches never cross documents. A null text is empty. Rows that repeat a doc_id, or
    have none, are documents of their own. Extra columns pass through, unless the operator makes one
    of that name.
    """
    units = repeats.Units("byte", window, gram)
    plain, rest = common.stash(docs)
    keyed = common.with_key(plain, "keyed")
    spans = repeats.repeated_spans(keyed, units, partial(index, window=window, gram=gram), keep_first=False, hot=hot)
    out = repeats.cut(keyed, spans, units, ["doc_id", "text", *rest], "binary")
    made = ["n_bytes", "n_removed", "n_spans", "kept"]
    return out.select(*common.unstash(docs, made), F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.col("kept").alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
