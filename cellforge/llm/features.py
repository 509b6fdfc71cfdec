"""Per-text features in numpy: normalised words as hashes, and structure statistics."""

from __future__ import annotations

import numpy as np

from . import textnum as tn

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def normal_words(b: np.ndarray, offsets: np.ndarray, stem_bytes: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, stem hash, row offsets in words): ASCII lower case, punctuation at both ends stripped.

    A word of nothing but punctuation is left out. The stem is the word's first ``stem_bytes`` bytes,
    or fewer so as not to split a character.
    """
    low = tn.lower_ascii(b)
    s, e, _ = tn.word_spans(low, offsets)
    for _ in range(8):
        trim = (e > s) & ~_LETTER[low[np.maximum(e - 1, 0)]] if len(s) else np.zeros(0, bool)
        if not trim.any():
            break
        e = e - trim
    for _ in range(8):
        trim = (e > s) & ~_LETTER[low[np.minimum(s, len(low) - 1)]] if len(s) else np.zeros(0, bool)
        if not trim.any():
            break
        s = s + trim
    ok = e > s
    s, e = s[ok], e[ok]
    cut = np.minimum(e, s + stem_bytes)
    if len(s):
        for _ in range(3):  # back to the start of a character
            inside = (cut < e) & ((low[np.minimum(cut, len(low) - 1)] & 0xC0) == 0x80)
            cut = cut - inside
    p = tn.Prefix(tn.byte_values(low))
    return p.span(s, e), p.span(s, cut), np.searchsorted(s, offsets)


_CLASSES = np.zeros((256, 9))
for _n, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b"#*$%&<>@^~", b"!?", b"|", b".,;:", b" \t\r\x0b\x0c", range(128, 256))):
    _CLASSES[list(_bytes), _n] = 1
#: Statistics of a text, in order.
STRUCTURE = ("upper", "lower", "digit", "symbol", "bang", "pipe", "stop", "space", "wide", "log_bytes", "log_words", "word_bytes", "distinct", "top_word", "line_words", "dup_lines", "ends_in_stop", "repeats_next")


def structure(raw: bytes, words: np.ndarray) -> np.ndarray:
    """The statistics of one text from its bytes and word hashes."""
    n, w = len(raw), len(words)
    out = np.zeros(len(STRUCTURE))
    if not n:
        return out
    out[:9] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[9], out[10] = np.log1p(n), np.log1p(w)
    out[11] = n / max(1, w)
    if w:
        counts = np.unique(words, return_counts=True)[1]
        out[12], out[13] = len(counts) / w, counts.max() / w
        out[17] = float((words[1:] == words[:-1]).mean()) if w > 1 else 0.0
    out[14] = np.log1p(w / max(1, len(lines)))
    out[15] = 1 - len(set(lines)) / max(1, len(lines))
    out[16] = raw.rstrip().endswith((b".", b"!", b"?", b'"'))
    return out
