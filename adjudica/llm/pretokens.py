"""The words that a byte-level BPE encodes separately, cut in numpy for many texts at once.

Follows public_tokenizers.PATTERN: a run of letters, of numbers or of other characters takes one blank before it;
contractions stand alone where a word may start; the last of several white-space characters before a word is left to it.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa

LETTER, NUMBER, OTHER, SPACE = range(4)
#: The characters of the White_Space property.
SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def class_runs() -> tuple[np.ndarray, np.ndarray]:
    """(lengths, classes) of the runs of code points of one class."""
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        first = unicodedata.category(chr(c))[0]
        if first in "LN":
            kinds[c] = LETTER if first == "L" else NUMBER
    kinds[list(SPACES)] = SPACE
    edges = np.flatnonzero(np.diff(kinds)) + 1
    starts = np.concatenate([[0], edges])
    return np.diff(np.append(starts, len(kinds))), kinds[starts]


def cut(texts: list[str], table: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """The words of all texts as one array over their joined bytes, and how many each text has."""
    joined = "".join(texts)
    c = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = len(c)
    edges = np.cumsum([0, *map(len, texts)])
    text_start = np.zeros(n + 1, bool)
    text_start[edges] = True
    kind = table[c]
    start = text_start.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    last_space = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~text_start[1:n]) if n else np.zeros(0, np.int64)
    start[last_space] = True
    start[last_space[c[last_space] == 0x20] + 1] = False
    quote = np.flatnonzero((c[:-1] == 0x27) & start[:max(n - 1, 0)] & (kind[1:] == LETTER) & ~text_start[1:n]) if n else np.zeros(0, np.int64)
    one = quote[np.isin(c[quote + 1], [ord(x) for x in "stmd"])]
    start[one + 1] = False
    start[one + 2] = True
    long = quote[quote + 2 < n]
    long = long[~text_start[long + 2]]
    pair = c[long + 1].astype(np.int64) << 32 | c[long + 2]
    two = long[np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]
    start[two + 1] = False
    start[two + 3] = True
    firsts = np.flatnonzero(start[:n])
    width = np.ones(n, np.int64)
    for limit in (0x80, 0x800, 0x10000):
        width += c >= limit
    at = np.concatenate([[0], np.cumsum(width)])
    offsets = at[np.append(firsts, n)].astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(firsts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(joined.encode("utf-8"))])
    return words, np.diff(np.searchsorted(firsts, edges))


def in_slices(texts: list[str], chars: int = 1 << 20):
    """Texts in order, in lists of about so many characters."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part
