"""Sets of word shingles: hashed for searching, digested for identity, exact for decisions."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

from . import textnum as tn


def shingle_hashes(b: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every shingle, row offsets): all windows of ``size`` words, or the whole of a shorter text."""
    s, e, rows = tn.word_spans(b, offsets)
    words, n = tn.strong_words(b, s, e), np.diff(rows)
    start, row = tn.window_starts(rows, size)
    h, r = [tn.chained(words, start, size)], [row]
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        if len(short):
            h.append(tn.chained(words, rows[short], k))
            r.append(short)
    h, row = np.concatenate(h), np.concatenate(r)
    if len(r) > 1:
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    return h, np.searchsorted(row, np.arange(len(n) + 1))


@dataclass(frozen=True)
class Shingles:
    """What a document's set is: shingles of ``size`` words, with ASCII letters lower-cased or not."""

    size: int
    lower: bool

    def sets(self, b: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The different shingle hashes of each text, sorted."""
        h, rows = shingle_hashes(tn.lower_ascii(b) if self.lower else b, offsets, self.size)
        return [np.unique(h[rows[r] : rows[r + 1]]) for r in range(len(rows) - 1)]

    def words(self, raw: bytes) -> list[bytes]:
        return (raw.lower() if self.lower else raw).split()  # bytes: only ASCII letters and separators count

    def exact(self, raw: bytes) -> frozenset:
        """The set itself."""
        w, k = self.words(raw), self.size
        return frozenset([tuple(w)]) if 0 < len(w) < k else frozenset(zip(*(w[i:] for i in range(k))))

    def ids(self, raw: bytes, bad: np.ndarray) -> tuple[int, int] | tuple[None, None]:
        """(id, tag) of the text's word sequence: two halves of a cryptographic digest; none without words.

        Ids in ``bad`` have been seen with several tags; there the tag joins the id.
        """
        w = self.words(raw)
        if not w:
            return None, None
        d = np.frombuffer(hashlib.blake2b(b" ".join(w), digest_size=16).digest(), np.int64)
        if len(bad) and bad[min(len(bad) - 1, np.searchsorted(bad, d[0]))] == d[0]:
            with np.errstate(over="ignore"):
                return int(tn.mix(d.view(np.uint64)[:1] ^ tn.mix(d.view(np.uint64)[1:])).view(np.int64)[0]), int(d[1])
        return int(d[0]), int(d[1])
