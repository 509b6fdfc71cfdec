"""Vectorised text primitives in numpy, straight on Arrow's UTF-8 buffers.

All word separators are ASCII, so words are found in bytes. Any span is hashed in constant time, by
prefix sums of a polynomial; hashes depend on content only, never on the batch a text came in. There
are two kinds: Prefix, modulo 2^64, is fast but has constructible collisions, and serves only where
a collision costs nothing but time (anchors, features). Where equal hashes propose that spans are
equal, Strong (modulo the prime 2^61 - 1 with a random base), chained or digest serve.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes that are worked on at once; a longer text is a chunk of its own.
CHUNK = 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts."""
    a = column.fill_null("") if column.null_count else column
    a = a.cast(pa.large_string())
    _, offs, data = a.buffers()
    o = np.frombuffer(offs, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and len(a) else np.zeros(0, np.uint8)
    return b, o - o[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, r in enumerate((_BASE, _INVERSE)):
                a = np.full(n + (n >> 2), r, np.uint64)
                a[0] = 1
                _powers[k] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


class Prefix:
    """Hashes of spans of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        with np.errstate(over="ignore"):
            up, self.down = powers(len(values) + 1)
            self.sums = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(values * up[:-1], out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[end] - self.sums[start]) * self.down[start]
            return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


_P = np.uint64((1 << 61) - 1)
_LOW32, _LOW29 = np.uint64((1 << 32) - 1), np.uint64((1 << 29) - 1)
_U32, _U29, _U61, _U3 = np.uint64(32), np.uint64(29), np.uint64(61), np.uint64(3)
#: Random bases modulo 2^61 - 1, one for each salt.
_BASES = [int(x) for x in _rng.integers(1 << 40, (1 << 61) - 2, 8, dtype=np.uint64)]
TABLE61 = _rng.integers(1, (1 << 61) - 2, 256, dtype=np.uint64)
_strong: dict[int, list[np.ndarray]] = {}


_BLOCK = 1 << 13


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, for a, b < 2^61, from products of 32-bit halves; in blocks that stay in the cache."""
    if len(a) > _BLOCK:
        out = np.empty(len(a), np.uint64)
        for i in range(0, len(a), _BLOCK):
            out[i : i + _BLOCK] = mulmod(a[i : i + _BLOCK], b[i : i + _BLOCK] if np.ndim(b) else b)
        return out
    a1, a0, b1, b0 = a >> _U32, a & _LOW32, b >> _U32, b & _LOW32
    t = a1 * b0
    t += a0 * b1
    a0 = a0 * b0
    a1 = a1 * b1
    a1 <<= _U3
    a1 += t >> _U29
    t &= _LOW29
    t <<= _U32
    a1 += t
    a1 += a0 & _P
    a1 += a0 >> _U61
    t = a1 >> _U61
    a1 &= _P
    a1 += t
    a1 -= np.where(a1 >= _P, _P, np.uint64(0))
    return a1


def _strong_powers(n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the salt's base and of its inverse, by doubling."""
    got = _strong.setdefault(salt, [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    if len(got[0]) < n:
        p, base = int(_P), _BASES[salt]
        for k, r in enumerate((base, pow(base, -1, int(_P)))):
            a = got[k]
            while len(a) < n:
                a = np.concatenate([a, mulmod(a, np.uint64(pow(r, len(a), p)))])
            got[k] = a
    return got[0][:n], got[1][:n]


class Strong:
    """Hashes of spans of a sequence of values below 2^61 - 1; two different spans of n values have equal
    hashes with a probability of n / 2^61, whatever they are."""

    def __init__(self, values: np.ndarray, salt: int = 0):
        up, self.down = _strong_powers(len(values) + 1, salt)
        term = mulmod(values, up[:-1])
        high, low = np.cumsum(term >> _U32, dtype=np.uint64), np.cumsum(term & _LOW32, dtype=np.uint64)
        total = mulmod(high, np.uint64(1 << 32)) + low % _P
        self.sums = np.zeros(len(values) + 1, np.uint64)
        self.sums[1:] = np.where(total >= _P, total - _P, total)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = self.sums[end], self.sums[start]
        d = np.where(a >= b, a - b, a + _P - b)
        with np.errstate(over="ignore"):
            return mix(mulmod(d, self.down[start]) ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def digest(data: bytes, salt: int = 0) -> int:
    """64 bits of a cryptographic hash."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=bytes([salt])).digest(), "little")


def chained(words: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs of ``size`` 64-bit values: mixed one after the other, so no sum or product of them can be forged."""
    h = np.full(len(start), np.uint64(size))
    with np.errstate(over="ignore"):
        for k in range(size):
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + words[start + k])
    return h


def strong_words(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of words: polynomials modulo 2^61 - 1 over their pieces of seven bytes."""
    base, size = np.uint64(_BASES[salt]), ends - starts
    h = np.zeros(len(starts), np.uint64)
    eight = np.lib.stride_tricks.as_strided(np.concatenate([b, np.zeros(8, np.uint8)]), (len(b) + 1, 8), (1, 1))
    live, at = np.arange(len(starts)), 0
    while len(live):
        piece = eight[starts[live] + at].view("<u8").ravel()
        left = np.minimum(size[live] - at, 7).astype(np.uint64)
        piece = piece & ((np.uint64(1) << (left * np.uint64(8))) - np.uint64(1))
        t = (mulmod(h[live], base) if at else h[live]) + piece + np.uint64(1)
        h[live] = np.where(t >= _P, t - _P, t)
        at += 7
        live = live[size[live] > at]
        if at >= 140 and len(live):  # the few endless ones
            for k in live.tolist():
                h[k] = digest(b[starts[k] : ends[k]].tobytes(), salt)
            break
    with np.errstate(over="ignore"):
        return mix(h ^ (size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def byte_values(b: np.ndarray) -> np.ndarray:
    return _TABLE[b]


def word_spans(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of all words and the number of the first word of each row (one more at the end)."""
    n = len(b)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    sep = _SEP[b]
    first = np.empty(n, bool)
    first[0], first[1:] = True, sep[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    first[edge] = True
    last = np.empty(n, bool)
    last[-1], last[:-1] = True, sep[1:]
    last[edge[edge > 0] - 1] = True
    word = ~sep
    starts, ends = np.flatnonzero(first & word), np.flatnonzero(last & word) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Prefix(byte_values(b)).span(starts, ends)


def lower_ascii(b: np.ndarray) -> np.ndarray:
    return np.where((b >= 65) & (b <= 90), b + np.uint8(32), b)


def window_starts(rows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, row) of every window of units that lies inside one row; ``rows`` are the rows' offsets."""
    count = np.maximum(0, np.diff(rows) - window + 1)
    row = np.repeat(np.arange(len(count)), count)
    before = np.cumsum(count) - count
    return rows[:-1][row] + np.arange(len(row)) - before[row], row


_PLACE = np.uint64((1 << 28) - 1)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by doubling."""
    m, span = a, 1
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < w:
        d = w - span
        m = np.minimum(m[:-d], m[d:])
    return m


def anchors(prefix: Prefix, rows: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Content-defined anchors: every window is assigned its gram of least hash, the leftmost of equals.

    Which gram that is depends on the window's content alone, so equal windows have equal anchors
    at the same place inside them. Neighbouring windows mostly share an anchor. Returns, for each
    anchor, (row, first window start, last window start, hash of the gram).
    """
    if int(rows[-1]) < PART:
        return _anchors(prefix, rows, window, gram, 0)
    out = []  # windows are dealt with in parts: an anchor whose windows two parts share has two runs
    for lo in range(0, int(rows[-1]), PART):
        cut = np.clip(rows, lo, lo + PART + window - 1)
        out.append(_anchors(prefix, cut, window, gram, lo))
    return tuple(np.concatenate(x) for x in zip(*out))


#: Units whose windows are worked on at once.
PART = 1 << 26


def _anchors(prefix: Prefix, rows: np.ndarray, window: int, gram: int, base: int) -> tuple[np.ndarray, ...]:
    n = int(rows[-1]) - base
    starts, row = window_starts(rows, window)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    at = np.arange(n - gram + 1)
    g = prefix.span(at + base, at + base + gram)
    best = sliding_min((g & ~_PLACE) | at.astype(np.uint64), window - gram + 1)
    place = (best[starts - base] & _PLACE).astype(np.int64)
    new = np.empty(len(starts), bool)
    new[0], new[1:] = True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return row[first], starts[first], starts[last], g[place[first]]


def covered(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``size`` units lie in any of the spans."""
    d = np.zeros(size + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, end, -1)
    return np.cumsum(d[:-1]) > 0
