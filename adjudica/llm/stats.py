"""Statistics of one text, each computed when first asked for. Plain helpers of the quality operators."""

from __future__ import annotations

import zlib

import numpy as np

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def repeated_positions(ids: np.ndarray, width: int) -> np.ndarray:
    """Which of the ids lie in a width-long window that occurs twice or more; width is a power of two.

    One wrapping product sum per window proves most texts free of repeats, because equal windows
    have equal sums. Texts with an equal pair are decided by exact codes of doubled windows.
    """
    covered = np.zeros(len(ids), bool)
    n = len(ids) - width + 1
    if n < 2:
        return covered
    sums = np.zeros(n, np.uint64)
    wide = ids.astype(np.uint64) + np.uint64(1)
    for k in range(width):
        sums = sums * np.uint64(0x9E3779B97F4A7C15) + wide[k:k + n]
    ordered = np.sort(sums)
    if not (ordered[1:] == ordered[:-1]).any():
        return covered
    codes, span = ids.astype(np.int64), 1
    while span < width:
        pairs = codes[:len(codes) - span] * np.int64(len(ids) + 1) + codes[span:]
        codes = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        span *= 2
    starts = np.flatnonzero(np.bincount(codes)[codes] > 1)
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return np.cumsum(edges)[:-1] > 0


class TextStats:
    """Lazy counts of a text. Every property looks at the whole text."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self._known: dict = {}

    def __getattr__(self, name):
        maker = type(self).__dict__.get("_" + name)
        if maker is None:
            raise AttributeError(name)
        if name not in self._known:
            self._known[name] = maker(self)
        return self._known[name]

    def _words(self):
        return self.text.encode("utf-8", "surrogatepass").split()

    def _n_words(self):
        return len(self.words)

    def _word_chars(self):
        return len(self.text) - sum(self.text.count(c) for c in " \t\n\x0b\x0c\r")

    def _n_symbols(self):
        return sum(self.text.count(c) for c in SYMBOLS)

    def _lines(self):
        return [x for x in self.text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]

    def _n_dup_lines(self):
        return len(self.lines) - len(set(self.lines))

    def _word_ids(self):
        seen: dict = {}
        return np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), np.int64, self.n_words)

    def _n_distinct(self):
        return int(self.word_ids.max()) + 1 if self.n_words else 0

    def _n_repeat_words(self):
        return int(repeated_positions(self.word_ids, WINDOW).sum())

    def _n_stutter(self):
        """Words equal to the word before them."""
        return int((self.word_ids[1:] == self.word_ids[:-1]).sum())

    def _code_points(self):
        return np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def _byte_counts(self):
        return np.bincount(np.frombuffer(self.text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)

    def _n_upper(self):
        """Capitals of ASCII and of the accented Latin-1 block, the only ones counted."""
        c = self.code_points
        return int(self.byte_counts[65:91].sum()) + int(((c >= 0xC0) & (c <= 0xDE) & (c != 0xD7)).sum())

    def _n_lower(self):
        c = self.code_points
        return int(self.byte_counts[97:123].sum()) + int(((c >= 0xDF) & (c <= 0xFF) & (c != 0xF7)).sum())

    def _packed(self):
        """Length of the text after fast compression."""
        return len(zlib.compress(self.text.encode("utf-8", "surrogatepass"), 1))
