"""Document fingerprints from closed syncmers.

A K-mer of code points is an anchor if the least hash among its S-mers stands first or last in it. That depends on the
K-mer alone, so an anchor is chosen wherever it occurs, whatever surrounds it. A fingerprint is all anchors of a text, 32
bits each, once and in the order of their first occurrence. Two fingerprints are matched by position: a common anchor
counts if it keeps its order (longest chain that ascends in both).
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adjudica.llm.anchors import gram_hashes, least_in_windows, mixed
from adjudica.llm.common import texts

K, S = 16, 6
SLICE_CHARS = 1 << 21
OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


@dataclass(eq=False)
class Anchors:
    """32-bit hashes of a text's anchors, each once and in ascending order, and the first place of each."""

    hashes: np.ndarray
    places: np.ndarray

    def __len__(self) -> int:
        return len(self.hashes)

    def items(self) -> Iterator[tuple[int, int]]:
        return zip(self.hashes.tolist(), self.places.tolist())

    def get(self, h: int) -> int | None:
        return dict(self.items()).get(h)


def anchors(found: list[str]) -> list[Anchors]:
    """Hash and first place of all anchors of each text, least hash first.

    A text without an anchor is one anchor itself; an empty one has none.
    """
    out: list[Anchors] = []
    part: list[str] = []
    size = 0
    for text in [*found, None]:
        if part and (text is None or size + len(text) > SLICE_CHARS):
            out += _anchors_of_slice(part)
            part, size = [], 0
        if text is not None:
            part.append(text)
            size += len(text)
    return out


def _anchors_of_slice(found: list[str]) -> list[Anchors]:
    edges = np.cumsum([0, *map(len, found)])
    symbols = mixed(np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    small = gram_hashes(symbols, S)
    width = K - S + 1
    where, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(small) >= width:
        low = least_in_windows(small, width)
        n = len(low)
        where = np.flatnonzero((small[:n] == low) | (small[width - 1:width - 1 + n] == low))
        doc = np.searchsorted(edges, where, side="right") - 1
        where = where[where + K <= edges[doc + 1]]
        hashes = gram_hashes(symbols, K)[where]
    bounds = np.searchsorted(where, edges)
    out = []
    for d, text in enumerate(found):
        a, b = bounds[d], bounds[d + 1]
        if a == b:
            whole = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "big")
            own = [whole] if text else []
            out.append(Anchors(np.array(own, np.uint32), np.zeros(len(own), np.int64)))
            continue
        kinds, first = np.unique((hashes[a:b] >> np.uint64(32)).astype(np.uint32), return_index=True)
        out.append(Anchors(kinds, where[a:b][first] - edges[d]))
    return out


def written_as(a: Anchors) -> str:
    """A fingerprint as text: its hashes in order of place, four little-endian bytes each, in base64."""
    return base64.b64encode(a.hashes[np.argsort(a.places, kind="stable")].astype("<u4").tobytes()).decode("ascii")


def read_from(fingerprint: str) -> Anchors:
    """Anchors of a written fingerprint; an anchor's place is its rank, which is all that matching needs."""
    hashes = np.frombuffer(base64.b64decode(fingerprint), "<u4")
    order = np.argsort(hashes)
    return Anchors(hashes[order], order)


def longest_ascent(places: np.ndarray) -> int:
    """Length of the longest ascending chain of different numbers."""
    falls = np.flatnonzero(places[1:] < places[:-1])
    if not len(falls):
        return len(places)
    # What ascends from the start is a chain itself; only the rest is searched.
    chain = places[:falls[0] + 1].tolist()
    for p in places[falls[0] + 1:].tolist():
        k = bisect_left(chain, p)
        chain[k:k + 1] = [p]
    return len(chain)


def likeness(a: Anchors, b: Anchors) -> float:
    """Share of the anchors of two fingerprints that match in one order; two empty ones are alike.

    Of two texts of one length that agree in their first two thirds and nowhere else, about two thirds match.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    _, i, j = np.intersect1d(a.hashes, b.hashes, assume_unique=True, return_indices=True)
    return 2 * longest_ascent(b.places[j][np.argsort(a.places[i])]) / (len(a) + len(b))


def edited(text: str, after: str) -> str:
    """The last third of the text replaced by as much of the start of the next one, or all of that."""
    cut = len(text) // 3
    return text[:len(text) - cut] + after[:cut]


def digest(docs: DataFrame, bucket_bytes: int = 32 << 20) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; the next document is by descending doc_id.

    Documents are dealt into ranges of ids of about bucket_bytes; the first document of each range is also sent to the range
    before it, and the first of all to the last one, so each range has every neighbour it needs. A null text is empty. Rows
    of one id follow each other by descending text, rows without an id come last. A lone document is its own next.
    """
    docs = texts(docs)
    size, n = docs.agg(F.sum(F.octet_length("text")), F.count("doc_id")).first()
    parts = max(1, -(-int(size or 0) // bucket_bytes)) if n else 1
    heads: list[int] = []
    if parts > 1:
        # Elements of the table, so every range has its first document: one number per range comes to the driver.
        shares = [k / parts for k in range(1, parts + 1)]
        heads = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 100 * parts)).first()[0]) | {docs.agg(F.max("doc_id")).first()[0]}, reverse=True)
    alone = len(heads) < 2
    descending = -np.array(heads, np.int64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if alone:
                range_of, guest = np.zeros(n, np.int64), np.zeros(0, np.int64)
            else:
                known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
                range_of = np.where(known, np.searchsorted(descending, -ids, side="right") - 1, len(heads) - 1)
                guest = np.flatnonzero(known & np.isin(ids, heads))
            row = np.concatenate([np.arange(n), guest])
            to = np.concatenate([range_of, (range_of[guest] - 1) % max(1, len(heads))])
            moved = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array((np.arange(len(row)) >= n).astype(np.int32)),
                                              moved.column("doc_id"), moved.column("text")], names=["range", "guest", "doc_id", "text"])

    def printed(rows: list[tuple]) -> pa.RecordBatch:
        """rows: documents in order, each the next of the one before; the last only serves the one before it."""
        found = [t for _, t in rows]
        changed = [edited(a, b) for a, b in zip(found, found[1:])]
        own, other = anchors(found), anchors(changed)
        return pa.RecordBatch.from_arrays([
            pa.array([i for i, _ in rows[:-1]], pa.int64()), pa.array([len(t) for t in found[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
            pa.array([written_as(a) for a in own[:-1]], pa.string()), pa.array([written_as(a) for a in other], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, other)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64())],
            names=[x.split()[0] for x in OUT.split(", ")])

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        current, closed, size, first = None, False, 0, None
        for batch in batches:
            for part, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("range", "guest", "doc_id", "text"))):
                if part != current:
                    if len(rows) > 1:
                        yield printed(rows)
                    rows, current, closed, size, first = [], part, False, 0, (doc_id, text)
                if closed:
                    continue
                rows.append((doc_id, text))
                closed = bool(guest)
                size += len(text)
                if size > SLICE_CHARS:
                    if len(rows) > 1:
                        yield printed(rows)
                    rows, size = rows[-1:], 0
        if alone and rows:
            rows.append(first)
        if len(rows) > 1:
            yield printed(rows)

    ranged = docs.mapInArrow(dealt, "range int, guest int, doc_id long, text string")
    ranged = ranged.coalesce(1) if alone else ranged.repartitionById(len(heads), F.col("range"))
    return ranged.sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), F.col("text").desc()).mapInArrow(streamed, OUT)
