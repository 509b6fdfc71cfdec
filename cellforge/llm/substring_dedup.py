"""Substring dedup over words: every repeat of a passage but the first goes.

Reference shards are suffix automata over words (compared as such, not as hashes). Runs of documents
that claim to repeat a passage (see repeats) are streamed through the automaton of the shard that
holds its first occurrence: matching statistics say where a window of it ends there, each state
knows the earliest place of its strings, and maximal spans of windows that start earlier go. In a
contested shard every context is streamed through the automaton of those before it and then added.

A shard's reference is sent to every task that streams against it: a passage in demand to as many as
its claims fill. All references are not broadcast to all tasks, since they grow with the corpus.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, repeats

WINDOW = 20
GRAM = 5
UNITS = repeats.Units("word", WINDOW, GRAM)


class Automaton:
    """A generalised suffix automaton over words, built online; states know where their strings first end."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]
        self.first = [-1]
        self.size = 0

    def add(self, seq: list) -> int:
        """Adds a sequence; returns the number of its first place. Places of all sequences count on."""
        nxt, link, ln, first = self.next, self.link, self.len, self.first
        base, last = self.size, 0
        self.size += len(seq)
        for at, c in enumerate(seq, base):
            q = nxt[last].get(c)
            if q is not None:
                last = q if ln[q] == ln[last] + 1 else self._split(last, c, q)
                continue
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            ln.append(ln[last] + 1)
            first.append(at)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if ln[q] == ln[p] + 1 else self._split(p, c, q)
            last = cur
        return base

    def _split(self, p: int, c, q: int) -> int:
        nxt, link, ln = self.next, self.link, self.len
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        ln.append(ln[p] + 1)
        self.first.append(self.first[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def window(self, seq: list, start: int, window: int) -> tuple[int, int] | None:
        """The first window of ``seq`` from ``start`` on that the automaton holds, as (offset, first place)."""
        return next(self._windows(seq, start, window), None)

    def windows(self, seq: list, window: int) -> list[tuple[int, int]]:
        """(offset, first place) of every window of ``seq`` that the automaton holds."""
        return list(self._windows(seq, 0, window))

    def _windows(self, seq: list, start: int, window: int) -> Iterator[tuple[int, int]]:
        """By matching statistics: the length of the longest match that ends at each word."""
        nxt, link, ln, first = self.next, self.link, self.len, self.first
        at, l = 0, 0
        for n in range(start, len(seq)):
            c = seq[n]
            while at and c not in nxt[at]:
                at = link[at]
                l = ln[at]
            to = nxt[at].get(c)
            if to is None:
                l = 0
                continue
            at, l = to, l + 1
            if l >= window:
                while ln[link[at]] >= window:  # the state of the window itself
                    at = link[at]
                    l = ln[at]
                yield n - window + 1, first[at] - window + 1


def index(references: list, streamed: list, contested: bool, window: int = WINDOW) -> tuple[list, list]:
    """What a shard's automaton finds (see repeats.repeated_spans): (key, start, end) spans, and refused runs.

    References come in order of (anchor, key, start), so the first place of a window is its earliest.
    Contexts of different anchors share no window: each anchor has an automaton of its own. Words
    become the numbers that a dictionary of the shard's words gives them.
    """
    found, refused, numbers = [], [], {}
    number = lambda body: [numbers.setdefault(w, len(numbers)) for w in body.split()]
    if contested:
        for _, group in itertools.groupby(references, key=lambda r: r[3]):
            auto, last = Automaton(), None
            for key, lo, body, _ in group:
                if last is not None:
                    auto.add(last)
                last = number(body)
                offs = [o for o, _ in auto.windows(last, window)] if auto.size else []
                if offs:
                    found += [(key, lo + s, lo + e) for s, e in repeats.joined(np.array(offs), window)]
        return found, refused
    auto, starts, own, text = Automaton(), [], [], []
    for key, lo, body, _ in references:
        seq = number(body)
        starts.append(auto.add(seq))
        own.append((key, lo))
        text.append(np.array(seq))
    for run in streamed:
        key, lo, body, _ = run
        seq = number(body)
        arr, at, spans = np.array(seq), 0, []
        while at <= len(seq) - window:
            hit = auto.window(seq, at, window)
            if hit is None:
                break
            o, place = hit
            n = bisect.bisect_right(starts, place) - 1
            first = place - starts[n]
            if (own[n][0], own[n][1] + first) >= (key, lo + o):
                at = o + 1
                continue
            a, b = arr[o:], text[n][first:]  # where the match goes on in the reference itself, so do its windows
            size = min(len(a), len(b))
            differ = np.flatnonzero(a[:size] != b[:size])
            end = o + (int(differ[0]) if len(differ) else size)
            spans.append((o, end))
            at = end - window + 1
        found += [(key, lo + s, lo + e) for s, e in spans]
        if not spans or spans[0][0] > 0 or spans[-1][1] < len(seq) or any(b > e - window + 1 for (_, e), (b, _) in itertools.pairwise(spans)):
            refused.append(run)
    return found, refused


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = repeats.HOT) -> DataFrame:
    """The documents with n_words, n_removed, n_spans and ``kept_text`` (kept words joined by one space).

    A word goes if a window of ``window`` words that covers it also starts earlier: in a document of
    smaller doc_id, or earlier in the same one. A null text has no words. Rows that repeat a doc_id
    are documents of their own, ordered by their texts' hashes; null ids come first. Extra columns
    pass through, unless the operator makes one of that name.
    """
    units = repeats.Units("word", window, gram)
    plain, rest = common.stash(docs)
    keyed = common.with_key(plain, "keyed")
    spans = repeats.repeated_spans(keyed, units, partial(index, window=window), keep_first=True, hot=hot)
    out = repeats.cut(keyed, spans, units, ["doc_id", "text", *rest], "string")
    made = ["n_words", "n_removed", "n_spans", "kept_text"]
    return out.select(*common.unstash(docs, made), F.col("n_units").alias("n_words"), "n_removed", "n_spans", F.col("kept").alias("kept_text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), "n_spans")
