"""Substring dedup on bytes by suffix arrays of shards.

Spans that may match (see anchors) meet in shards. A shard's texts are joined and its suffix array is built by induced
sorting: suffixes are classified, the leftmost-smaller substrings are sorted and named, their order is found on the
string of names, and the array is induced from it in one sweep for larger and one for smaller suffixes. Sweeps handle
a bucket's waiting entries together in numpy, so the work stays linear. The string of names has an alphabet as long as
itself, for which a sweep by buckets would be a Python loop; its recursion is by name doubling instead, which halves
the number of unsorted names per level. Common prefixes are computed in text order (permuted): a suffix whose left
neighbour matches too inherits its value, and only the others are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from adjudica.llm.anchors import MASKS, arrow_schema, covered, mixed, repeated, whole_anchors
from adjudica.llm.common import texts

WIDTH, GRAM = 100, 40
SHARD_BYTES = 2 << 20
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def smaller_suffixes(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one to their right; the last character is the least and counts as smaller."""
    n = len(t)
    less = np.zeros(n, bool)
    less[:-1] = t[:-1] < t[1:]
    less[-1] = True
    differs = np.ones(n, bool)
    differs[:-1] = t[:-1] != t[1:]
    # In a run of equal characters all suffixes are like the run's last one.
    ends = np.flatnonzero(differs)
    return less[ends[np.searchsorted(ends, np.arange(n))]]


def induce(t: np.ndarray, smaller: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The suffix array that follows from the leftmost-smaller suffixes in the order given."""
    n, kinds = len(t), int(t.max()) + 1
    count = np.bincount(t, minlength=kinds)
    stop = np.cumsum(count)
    start = stop - count
    sa = np.full(n, -1, np.int64)

    def put(places: np.ndarray, chars: np.ndarray, pointer: np.ndarray, step: int) -> None:
        order = np.argsort(chars, kind="stable")
        c = chars[order]
        new = np.ones(len(c), bool)
        new[1:] = c[1:] != c[:-1]
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(c)))
        rank = np.arange(len(c)) - np.repeat(first, many)
        sa[pointer[c] + step * rank] = places[order]
        pointer[c[first]] += step * many

    tail = stop - 1
    put(heads[::-1], t[heads[::-1]], tail, -1)
    lead = start.copy()
    for c in range(kinds):
        if not count[c]:
            continue
        at = start[c]
        while True:
            filled = lead[c]
            # Larger suffixes of this bucket come first; some of them are placed by their own bucket.
            batch = sa[at:filled] if at < filled else sa[tail[c] + 1:stop[c]]
            last = at >= filled
            before = batch[batch > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                put(before, t[before], lead, 1)
            if last:
                break
            at = filled
    tail = stop - 1
    larger_end = lead
    for c in range(kinds - 1, -1, -1):
        if not count[c]:
            continue
        at = stop[c] - 1
        while True:
            filled = tail[c]
            batch = sa[filled + 1:at + 1][::-1] if at > filled else sa[start[c]:larger_end[c]][::-1]
            last = at <= filled
            before = batch[batch > 0] - 1
            before = before[smaller[before]]
            if len(before):
                put(before, t[before], tail, -1)
            if last:
                break
            at = filled
    return sa


def order_of_names(names: np.ndarray) -> np.ndarray:
    """Suffixes of the string of names in order: names of pairs, of pairs of pairs, until all differ."""
    n, span = len(names), 1
    rank = names.astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[:n - span] = rank[span:] + 1
        kinds, rank = np.unique(rank * (n + 2) + after, return_inverse=True)
        if len(kinds) == n:
            return np.argsort(rank)
        span *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Of integers whose last one is the least and stands nowhere else."""
    if len(t) < 2:
        return np.zeros(len(t), np.int64)
    smaller = smaller_suffixes(t)
    heads = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    rough = induce(t, smaller, heads)
    is_head = np.zeros(len(t), bool)
    is_head[heads] = True
    by_substring = rough[is_head[rough]]
    # Name equal substrings alike. A substring reaches to the next head, itself included.
    until = np.zeros(len(t), np.int64)
    until[heads] = np.append(heads[1:], len(t) - 1)
    a, b = by_substring[:-1], by_substring[1:]
    length = until[a] - a
    alive = np.flatnonzero(length == until[b] - b)
    k = 0
    equal = np.zeros(len(a), bool)
    while len(alive):
        alive = alive[t[a[alive] + k] == t[b[alive] + k]]
        done = length[alive] <= k
        equal[alive[done]] = True
        alive = alive[~done]
        k += 1
    name = np.zeros(len(t), np.int64)
    name[by_substring] = np.concatenate([[0], np.cumsum(~equal)])
    names = name[heads]
    order = heads[order_of_names(names)] if len(heads) > 1 else heads
    return induce(t, smaller, order)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, left): per position the length shared with the suffix before it in the array, and where that one starts."""
    n = len(t)
    left = np.full(n, -1, np.int64)
    left[sa[1:]] = sa[:-1]
    position = np.arange(n)
    inherits = (left > 0) & (position > 0)
    inherits[inherits] = t[position[inherits] - 1] == t[left[inherits] - 1]
    alive = np.flatnonzero(~inherits & (left >= 0))
    shared = np.zeros(n, np.int64)
    k = 0
    while len(alive):
        inside = np.maximum(alive, left[alive]) + k < n
        alive = alive[inside]
        alive = alive[t[alive + k] == t[left[alive] + k]]
        k += 1
        shared[alive] = k
    reach = np.where(inherits, 0, shared + position)
    return np.maximum.accumulate(reach) - position, left


def later_copies(contents: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Which windows of the joined contents stand earlier in them as well. Contents come in order of place.

    The result has an entry per byte of b"".join(contents); a window lies within one content.
    """
    lengths = np.array([len(c) for c in contents], np.int64)
    t = np.zeros(int(lengths.sum()) + len(contents) + 1, np.int64)
    stops = np.cumsum(lengths + 1)
    body = np.ones(len(t), bool)
    body[stops - 1] = False
    body[-1] = False
    t[body] = np.frombuffer(b"".join(contents), np.uint8).astype(np.int64) + 2
    t[stops - 1] = 1
    sa = suffix_array(t)
    plcp, _ = permuted_common_prefixes(t, sa)
    room = np.zeros(len(t), np.int64)
    room[body] = (np.repeat(stops - 1, lengths) - np.flatnonzero(body))
    fits = room >= width
    # Neighbours in the array that share a window's length form one group; windows too near a content's end are in none.
    joined = (plcp[sa] >= width) & fits[sa]
    joined[1:] &= fits[sa[:-1]]
    joined[0] = False
    group = np.cumsum(~joined) - 1
    earliest = np.full(int(group[-1]) + 1, len(t), np.int64)
    np.minimum.at(earliest, group, sa)
    later = np.zeros(len(t), bool)
    later[sa] = (sa > earliest[group]) & fits[sa]
    return later[body]


def byte_symbols(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    encoded = [t.encode("utf-8", "surrogatepass") for t in found]
    table = mixed(np.arange(1, 257, dtype=np.uint64))
    edges = np.zeros(len(found) + 1, np.int64)
    edges[1:] = np.cumsum([len(b) for b in encoded])
    return table[np.frombuffer(b"".join(encoded), np.uint8)], edges


def span_bytes(found: list[str], _symbols: np.ndarray, edges: np.ndarray, rows: dict) -> list[bytes]:
    joined = b"".join(t.encode("utf-8", "surrogatepass") for t in found)
    at = edges[rows["doc"]] + rows["pos"]
    return [joined[p:p + n + WIDTH - 1] for p, n in zip(at.tolist(), rows["n"].tolist())]


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the stream between anchors into shards of about SHARD_BYTES and answer each from its suffix array."""
    def answered(t: pa.Table) -> pa.RecordBatch:
        # Earliest place first; equal windows have one anchor, so other anchors' order does not matter.
        order = np.lexsort([t.column(c).to_numpy() for c in ("pos", "doc", "block", "doc_key")])
        t = t.take(pa.array(order))
        contents = t.column("content").to_pylist()
        lengths = np.array([len(c) for c in contents], np.int64)
        n = t.column("n").to_numpy().astype(np.int64)
        later = later_copies(contents)
        row = np.repeat(np.arange(len(n)), lengths)[later]
        bit = np.flatnonzero(later) - np.repeat(np.cumsum(lengths) - lengths, lengths)[later]
        mask = np.zeros(len(n), np.int64)
        np.bitwise_or.at(mask, row, np.int64(1) << bit)
        keep = np.flatnonzero(mask)
        return pa.RecordBatch.from_pydict({**{c: t.column(c).to_numpy()[keep] for c in ("block", "doc", "pos", "n")}, "mask": mask[keep]}, schema=arrow_schema(MASKS))

    for t in whole_anchors(batches, SHARD_BYTES):
        yield answered(t)


def _rest_of_bytes(rows: pa.Table, found: list[str], edges: np.ndarray, starts: np.ndarray) -> pa.Table:
    gone = covered(int(edges[-1]), starts, WIDTH)
    columns: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
    for d, text in enumerate(found):
        mine = gone[edges[d]:edges[d + 1]]
        b = text.encode("utf-8", "surrogatepass")
        columns["n_bytes"].append(len(b))
        columns["n_removed"].append(int(mine.sum()))
        columns["n_spans"].append(int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum()))
        columns["kept_sha256"].append(hashlib.sha256(np.frombuffer(b, np.uint8)[~mine].tobytes() if mine.any() else b).hexdigest())
    return pa.Table.from_pydict({"doc_id": rows.column("doc_id"), **columns}, schema=arrow_schema(OUT))


def digest(docs: DataFrame) -> DataFrame:
    """Per row: bytes, removed bytes, removed runs, and the digest of the bytes that stay.

    A byte goes if it lies in a WIDTH-byte string that starts earlier too: in a smaller doc_id, or before in its own text.
    Rows without an id come before all others, rows of one id in order of their texts. A null text is empty; texts
    shorter than WIDTH stay whole. Matches never cross texts. One output row per input row.
    """
    return repeated(texts(docs), byte_symbols, span_bytes, shards, _rest_of_bytes, OUT, WIDTH, GRAM, first_stays=True)
