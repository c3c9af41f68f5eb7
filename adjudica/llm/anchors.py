"""Repeated windows of a corpus by context-free anchors: what the two exact substring operators share.

A window is `width` consecutive symbols of one text. Its anchor is the k-gram of least hash in it (the leftmost of
equals), which depends on the window alone; so equal windows have equal anchors, and everything that can match meets
under one anchor. Consecutive windows with one anchor form a span. Spans that recur as a whole, which is nearly all of
a copied passage, are settled by their hashes. Only where an anchor carries different spans, at the ends of passages,
do the texts of these spans travel, one of each kind, to the operator's own exact matcher.

An anchor of a phrase shorter than a window stands in as many kinds of spans as there are surroundings. Such a crowded
anchor, of more than CROWD kinds in a block or ALTOGETHER in all, is not a key: each block gives a row per distinct
window under it, and these meet by the hash of the whole window, so that only equal windows come together.

Texts are dealt into blocks of about block_bytes by a hash of doc_id. A block ships at most CROWD spans of an anchor and
one row per distinct span or window, so a passage or a phrase that stands in a third of the corpus arrives a bounded
number of times per block. Every pass reads the same shuffled blocks, which Spark reuses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

GOLD = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD1342543DE82EF95)
SLICE = 1 << 19
NO_ID = -(1 << 63)
CROWD, ALTOGETHER = 32, 1024
TABLE_BYTES = 2 << 20

FOUND = "anchor long, span long, doc_key long, block int, doc int, pos int, n int, copies int"
SETTLED = "block int, doc int, pos int, n int, mask long, kind int, anchor long, doc_key long"
ASKED = "block int, doc int, pos int, n int, kind int, anchor long, doc_key long, content binary"
MASKS = "block int, doc int, pos int, n int, mask long"

DUPLICATE, ASK, DUPLICATE_AND_ASK, CROWDED, WINDOW = 1, 2, 3, 4, 5
#: In place of copies: the block has more kinds of spans of this anchor than it ships.
MORE = 3
#: In place of a document: the row's mask is a crowded anchor of the block.
NO_DOC = -1


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(symbols: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of all width-long windows, built by doubling."""
    n = len(symbols) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, piece, span, power = None, 0, symbols, 1, BASE
    rest = width
    while rest:
        if rest & 1:
            if out is None:
                out, have = piece, span
            else:
                m = len(symbols) - have - span + 1
                out = out[:m] * power + piece[have:have + m]
                have += span
        rest >>= 1
        if rest:
            m = len(piece) - span
            piece = piece[:m] * power + piece[span:span + m]
            span *= 2
            with np.errstate(over="ignore"):
                power = power * power
    return mixed(out[:n])


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    n, span, low = len(values) - width + 1, 1, values
    while 2 * span <= width:
        low = np.minimum(low[:len(low) - span], low[span:])
        span *= 2
    return np.minimum(low[:n], low[width - span:width - span + n])


@dataclass
class Found:
    """Spans of one block: arrays of equal length, in order of doc and pos."""

    anchor: np.ndarray
    span: np.ndarray
    doc: np.ndarray
    pos: np.ndarray
    n: np.ndarray


def find_spans(symbols: np.ndarray, edges: np.ndarray, width: int, gram: int) -> Found:
    """Spans of all texts of a block; symbols holds them one after the other, text d in edges[d]:edges[d + 1]."""
    parts: list[tuple] = []
    total = len(symbols)
    for at in range(0, max(total - width + 1, 0), SLICE):
        here = symbols[at:at + SLICE + width - 1]
        n = len(here) - width + 1
        grams = gram_hashes(here, gram)
        # High bits of the hash rank a gram, the position in the slice breaks ties to the left.
        ranked = (grams & ~np.uint64((1 << 23) - 1)) | np.arange(len(grams), dtype=np.uint64)
        anchor_at = (least_in_windows(ranked, width - gram + 1) & np.uint64((1 << 23) - 1)).astype(np.int64)
        full = gram_hashes(here, width)
        doc = np.searchsorted(edges, np.arange(at, at + n), side="right") - 1
        whole = np.arange(at, at + n) + width <= edges[doc + 1]
        first = np.ones(n, bool)
        first[1:] = (anchor_at[1:] != anchor_at[:-1]) | (doc[1:] != doc[:-1])
        starts = np.flatnonzero(first & whole)
        if not len(starts):
            continue
        # A span ends at the next first window, or at the last whole window of its text.
        bounds = np.append(np.flatnonzero(first), n)
        ends = bounds[np.searchsorted(bounds, starts, side="right")] - 1
        ends = np.minimum(ends, edges[doc[starts] + 1] - width - at)
        length = ends - starts + 1
        span = mixed(full[starts] * GOLD + full[ends] * BASE + length.astype(np.uint64) * GOLD + (anchor_at[starts] - starts).astype(np.uint64))
        parts.append((grams[anchor_at[starts]], span, doc[starts], starts + at - edges[doc[starts]], length))
    if not parts:
        return Found(*(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)))
    return Found(*(np.concatenate(x) for x in zip(*parts)))


def first_of_kind(found: Found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, new, copies): rows sorted by anchor, span and place; which start a new kind; how many rows each kind has."""
    order = np.lexsort((np.arange(len(found.anchor)), found.span, found.anchor))
    a, s = found.anchor[order], found.span[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
    return order, new, np.diff(np.append(np.flatnonzero(new), len(order)))


def in_order(group: pa.Table) -> tuple[pa.Table, list]:
    """Rows of a block by id, then text, and their texts: every pass numbers them alike. Null ids come first."""
    ids, found = group.column("doc_id").to_pylist(), group.column("text").to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (NO_ID if ids[k] is None else ids[k], found[k]))
    return group.take(pa.array(order, pa.int64())), [found[k] for k in order]


Symbols = Callable[[list], tuple[np.ndarray, np.ndarray]]


def in_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Rows with their block; rows of one id share it, rows without an id are dealt by text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return docs.select(F.pmod(key, F.lit(n)).cast("int").alias("block"), "*")


def whole_anchors(batches: Iterator[pa.RecordBatch], least_bytes: int = TABLE_BYTES) -> Iterator[pa.Table]:
    """The rows, sorted by anchor, in tables of about least_bytes that have all rows of their anchors."""
    closed: list[pa.RecordBatch] = []
    last: list[pa.RecordBatch] = []
    size, current = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = batch.column("anchor").to_numpy()
        cut = int(np.searchsorted(anchor, anchor[-1], side="left"))
        if cut or anchor[-1] != current:
            head = [*last, batch.slice(0, cut)] if cut else last
            closed += head
            size += sum(x.nbytes for x in head)
            last, current = [], anchor[-1]
        last.append(batch.slice(cut))
        if size >= least_bytes:
            yield pa.Table.from_batches(closed)
            closed, size = [], 0
    if closed or last:
        yield pa.Table.from_batches([*closed, *last])


def settle(batches: Iterator[pa.RecordBatch], first_stays: bool) -> Iterator[pa.RecordBatch]:
    """Decide spans that recur whole, ask for the texts where an anchor has several kinds, and name crowded anchors.

    Rows come sorted. A crowded anchor gets one row for each of its blocks, and no other.
    """
    schema = arrow_schema(SETTLED)
    for t in whole_anchors(batches):
        c = {name: t.column(name).to_numpy() for name in t.column_names}
        n = len(c["anchor"])
        new_anchor, new = np.ones(n, bool), np.ones(n, bool)
        new_anchor[1:] = c["anchor"][1:] != c["anchor"][:-1]
        new[1:] = new_anchor[1:] | (c["span"][1:] != c["span"][:-1])
        kind_of, anchor_of = np.cumsum(new) - 1, np.cumsum(new_anchor) - 1
        kinds = np.bincount(anchor_of, new)
        crowded = ((kinds > ALTOGETHER) | (np.bincount(anchor_of, c["copies"] == MORE) > 0))[anchor_of]
        recurs = np.bincount(kind_of, c["copies"])[kind_of] > 1
        duplicate = ~new if first_stays else recurs
        ask = new & (kinds[anchor_of] > 1)
        kind = np.where(duplicate & ask, DUPLICATE_AND_ASK, np.where(ask, ASK, np.where(duplicate, DUPLICATE, 0)))
        kind[crowded] = 0
        keep = np.flatnonzero(kind)
        if len(keep):
            yield pa.RecordBatch.from_pydict({
                **{name: c[name][keep] for name in ("block", "doc", "pos", "n", "anchor", "doc_key")},
                "mask": np.where(duplicate[keep], -1, 0), "kind": kind[keep].astype(np.int32)}, schema=schema)
        rows = np.flatnonzero(crowded)
        if len(rows):
            anchor, block = np.unique(np.stack([c["anchor"][rows], c["block"][rows].astype(np.int64)]), axis=1)
            none = np.zeros(len(anchor), np.int32)
            yield pa.RecordBatch.from_pydict({
                "block": block.astype(np.int32), "doc": none + NO_DOC, "pos": none, "n": none, "mask": anchor,
                "kind": none + CROWDED, "anchor": anchor, "doc_key": np.zeros(len(anchor), np.int64)}, schema=schema)


def runs(firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all runs: so many from each first one."""
    return np.repeat(firsts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def windows_of(symbols: np.ndarray, edges: np.ndarray, found: Found, crowded: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(starts, hashes, new, copies): a block's windows under crowded anchors, by hash and place; which start a kind; rows of each kind."""
    mine = np.isin(found.anchor, crowded.view(np.uint64))
    starts = runs(edges[found.doc[mine]] + found.pos[mine], found.n[mine])
    hashes = [np.zeros(0, np.uint64)]
    for at in range(0, max(len(symbols) - width + 1, 0), SLICE):
        a, b = np.searchsorted(starts, [at, at + SLICE])
        if a < b:
            hashes.append(gram_hashes(symbols[at:at + SLICE + width - 1], width)[starts[a:b] - at])
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    return starts[order], h, new, np.diff(np.append(np.flatnonzero(new), len(h)))


def matched(batches: Iterator[pa.RecordBatch], match: Callable, first_stays: bool) -> Iterator[pa.RecordBatch]:
    """Decide windows by their hashes, which stand in place of anchors and come first; spans go on to the matcher."""
    spans: list[pa.RecordBatch] = []

    def windows() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = int((batch.column("kind").to_numpy() == WINDOW).sum())
            yield batch.slice(0, many)
            if many < batch.num_rows:
                spans.append(batch.slice(many))
                return

    for t in whole_anchors(windows()):
        anchor = t.column("anchor").to_numpy()
        new = np.ones(len(anchor), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        kind_of = np.cumsum(new) - 1
        keep = np.flatnonzero(~new if first_stays else np.bincount(kind_of, t.column("n").to_numpy())[kind_of] > 1)
        yield pa.RecordBatch.from_pydict({
            **{c: t.column(c).to_numpy()[keep] for c in ("block", "doc", "pos")},
            "n": np.ones(len(keep), np.int32), "mask": np.full(len(keep), -1)}, schema=arrow_schema(MASKS))
    yield from match(chain(spans, batches))


def repeated(docs: DataFrame, symbols: Symbols, content: Callable, match: Callable, finish: Callable, out: str,
             width: int, gram: int, first_stays: bool, block_bytes: int = 4 << 20) -> DataFrame:
    """Find all windows that recur and hand every block, with its covered windows, to finish.

    symbols(texts) -> (hashes, edges); content(texts, symbols, edges, rows) -> bytes per asked span;
    match(batches) -> MASKS rows for asked spans, all spans of an anchor (ALTOGETHER at most) in one call's stream;
    finish(rows, texts, edges, starts) -> a table with the schema out, rows being the block's, starts the windows that
    recur, as offsets into symbols. Columns of docs beyond doc_id and text travel along for finish.
    """
    blocks = in_blocks(docs, block_bytes)

    def spans(group: pa.Table) -> pa.Table:
        rows, found_texts = in_order(group)
        s, edges = symbols(found_texts)
        found = find_spans(s, edges, width, gram)
        order, new, copies = first_of_kind(found)
        at, copies = order[new], np.minimum(copies, 2)
        # The first span of a crowded anchor stands for all: they are not decided by spans.
        first = np.ones(len(at), bool)
        first[1:] = found.anchor[at[1:]] != found.anchor[at[:-1]]
        kinds = np.diff(np.append(np.flatnonzero(first), len(at)))
        crowded = np.repeat(kinds > CROWD, kinds)
        copies[crowded] = MORE
        at, copies = at[first | ~crowded], copies[first | ~crowded]
        key = np.array([NO_ID if i is None else i for i in rows.column("doc_id").to_pylist()], np.int64)
        return pa.Table.from_pydict({
            "anchor": found.anchor[at].view(np.int64), "span": found.span[at].view(np.int64), "doc_key": key[found.doc[at]],
            "block": np.full(len(at), group.column("block")[0].as_py(), np.int32), "doc": found.doc[at].astype(np.int32),
            "pos": found.pos[at].astype(np.int32), "n": found.n[at].astype(np.int32), "copies": copies.astype(np.int32)},
            schema=arrow_schema(FOUND))

    settled = (blocks.groupBy("block").applyInArrow(spans, FOUND).repartition("anchor")
               .sortWithinPartitions("anchor", "span", "doc_key", "block", "doc", "pos")
               .mapInArrow(lambda batches: settle(batches, first_stays), SETTLED))

    def answers(group: pa.Table, asked: pa.Table) -> pa.Table:
        columns = {name: asked.column(name).to_numpy() for name in ("block", "doc", "pos", "n", "kind", "anchor", "doc_key")}
        if not asked.num_rows:
            return arrow_schema(ASKED).empty_table()
        ids, found_texts = in_order(group)
        s, edges = symbols(found_texts)
        crowded = columns["kind"] == CROWDED
        rows = {name: c[~crowded] for name, c in columns.items()}
        out = [pa.Table.from_pydict({**rows, "content": pa.array(content(found_texts, s, edges, rows), pa.binary())}, schema=arrow_schema(ASKED))]
        if crowded.any():
            starts, hashes, new, copies = windows_of(s, edges, find_spans(s, edges, width, gram), columns["anchor"][crowded], width)
            at = starts[new]
            doc = np.searchsorted(edges, at, side="right") - 1
            key = np.array([NO_ID if i is None else i for i in ids.column("doc_id").to_pylist()], np.int64)
            none = np.zeros(len(at), np.int32)
            out.append(pa.Table.from_pydict({
                "block": none + columns["block"][0], "doc": doc.astype(np.int32), "pos": (at - edges[doc]).astype(np.int32),
                "n": np.minimum(copies, 2).astype(np.int32), "kind": none + WINDOW, "anchor": hashes[new].view(np.int64), "doc_key": key[doc],
                "content": pa.nulls(len(at), pa.binary())}, schema=arrow_schema(ASKED)))
        return pa.concat_tables(out)

    asks = settled.where(F.col("kind") >= ASK)
    masks = (blocks.groupBy("block").cogroup(asks.groupBy("block")).applyInArrow(answers, ASKED).repartition("anchor")
             .sortWithinPartitions(F.col("kind") != WINDOW, "anchor", "doc_key", "block", "doc", "pos")
             .mapInArrow(lambda batches: matched(batches, match, first_stays), MASKS))

    def applied(group: pa.Table, marks: pa.Table) -> pa.Table:
        rows, found_texts = in_order(group)
        s, edges = symbols(found_texts)
        found = find_spans(s, edges, width, gram)
        order, new, copies = first_of_kind(found)
        again = ~new if first_stays else np.repeat(copies > 1, copies)
        lead, length = edges[found.doc] + found.pos, found.n
        # Spans, and windows under crowded anchors, that recur inside the block are known here; the others come as marks.
        firsts = [lead[order[again]]]
        lengths = [length[order[again]]]
        m = {name: marks.column(name).to_numpy() for name in ("doc", "pos", "n", "mask")}
        named = m["doc"] == NO_DOC
        crowded, m = m["mask"][named], {name: c[~named] for name, c in m.items()}
        whole = m["mask"] == -1
        at = edges[m["doc"]] + m["pos"]
        firsts.append(at[whole]), lengths.append(m["n"][whole])
        starts = [runs(np.concatenate(firsts), np.concatenate(lengths))]
        if len(crowded):
            at_window, _, new, copies = windows_of(s, edges, found, crowded, width)
            starts.append(at_window[~new if first_stays else np.repeat(copies > 1, copies)])
        for bit in range(width - gram + 1):
            hit = ~whole & ((m["mask"] >> bit) & 1).astype(bool)
            starts.append(at[hit] + bit)
        return finish(rows, found_texts, edges, np.unique(np.concatenate(starts)))

    every = settled.where(F.col("kind") != ASK).select("block", "doc", "pos", "n", "mask").unionByName(masks)
    return blocks.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(applied, out)


def covered(total: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which symbols lie in one of the windows."""
    edges = np.zeros(total + 1, np.int64)
    edges[starts] += 1
    np.subtract.at(edges, starts + width, 1)
    return np.cumsum(edges)[:-1] > 0
