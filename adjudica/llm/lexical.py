"""Ranked lexical search by hashed max-sketches.

What a term adds to a document's score is a product: the term's weight in the corpus times the impact of its frequency
in the document. A document's impacts are folded into COORDINATES cells, each the greatest impact of the terms that hash
to it. For a query, the sum of weight times the cell of each term is never below the document's score, and a batch of
documents is held against a block of queries by one matrix product. Documents are then scored exactly in descending
order of that bound, until no bound reaches the score that the task's k-th best document already has.

Queries are taken in blocks of at most ITEMS items and TERM_BYTES of terms, the only data shipped to tasks. A task returns
its k best documents of each query, which is all that can be among the k best of the table; two rounds of ranking merge
them, the first within salted groups.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from adjudica.llm.common import in_rows, texts

COORDINATES = 4096
ITEMS, TERM_BYTES = 256, 1 << 20
TOP = 50
SALTS = 64
#: Documents of one matrix product, and documents scored exactly before the threshold is looked at again.
CHUNK, STEP = 1024, 64
#: Fixed value: the ASCII characters that terms are made of; every other ASCII character separates.
TERM_ASCII = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
TERM_BYTE = bytes(b if b >= 0x80 else (chr(b).lower().encode()[0] if chr(b) in TERM_ASCII else 0x20) for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTE).split()


@dataclass(frozen=True)
class Block:
    """Some queries: their ids, the sorted distinct terms of all of them, and for each the places of its terms there."""

    ids: list[int | None]
    terms: list[bytes]
    places: list[np.ndarray]


def blocks(items: DataFrame, most_items: int = ITEMS, most_bytes: int = TERM_BYTES) -> Iterator[Block]:
    """The items with at least one term, in blocks of bounded size; the rows come to the driver one partition at a time.

    An item larger than most_bytes is a block of its own.
    """
    def block(part: list[tuple[int | None, set]]) -> Block:
        terms = sorted(set().union(*(t for _, t in part)))
        place = {t: k for k, t in enumerate(terms)}
        return Block([i for i, _ in part], terms, [np.array(sorted(place[t] for t in own)) for _, own in part])

    part: list[tuple[int | None, set]] = []
    size = 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").toLocalIterator():
        own = set(terms_of(row.text))
        if not own:
            continue
        weight = sum(map(len, own))
        if part and (len(part) == most_items or size + weight > most_bytes):
            yield block(part)
            part, size = [], 0
        part.append((row.item_id, own))
        size += weight
    if part:
        yield block(part)


def counted(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(document, term, frequency) of every distinct term of each text, in order, and the terms."""
    lists = [terms_of(t) for t in found]
    lengths = np.array([len(x) for x in lists], np.int64)
    words = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
    terms = words.dictionary.to_pylist()
    pairs = np.repeat(np.arange(len(lists)), lengths) * max(len(terms), 1) + words.indices.to_numpy(zero_copy_only=False)
    keys, counts = np.unique(pairs, return_counts=True)
    return keys // max(len(terms), 1), keys % max(len(terms), 1), counts, terms


def statistics(docs: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all their terms, document frequency of each term of the block) over the whole table."""
    place = {t: k for k, t in enumerate(block.terms)}

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(place), np.int64)
        n = length = 0
        for batch in in_rows(batches, CHUNK):
            doc, term, count, terms = counted(batch.column("text").to_pylist())
            n += len(np.unique(doc))
            length += int(count.sum())
            known = np.array([place.get(t, -1) for t in terms], np.int64)
            here = known[term] if len(term) else np.zeros(0, np.int64)
            df += np.bincount(here[here >= 0], minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at.tolist()], pa.int64()), pa.array([n, length, *df[at].tolist()], pa.int64())], names=["k", "v"])

    sums = {r.k: r.v for r in texts(docs).mapInArrow(summed, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    return sums.get(-2, 0), sums.get(-1, 0), np.array([sums.get(k, 0) for k in range(len(block.terms))], np.int64)


def weights_of(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Best:
    """The k best (score, doc_id) of each query so far; equal scores by ascending id, rows without an id last."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = [np.zeros(0, np.int64)] * queries
        self.id = [np.zeros(0, np.int64)] * queries
        self.none = [np.zeros(0, bool)] * queries

    def threshold(self, q: int) -> int:
        """A document needs this score at least."""
        return max(1, int(self.score[q][-1])) if len(self.score[q]) == self.k else 1

    def add(self, q: int, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        score, ids, none = np.append(self.score[q], score), np.append(self.id[q], ids), np.append(self.none[q], none)
        order = np.lexsort((ids, none, -score))[:self.k]
        self.score[q], self.id[q], self.none[q] = score[order], ids[order], none[order]


def sketches(doc: np.ndarray, impact: np.ndarray, cell: np.ndarray, n_docs: int) -> np.ndarray:
    """One row of COORDINATES cells per document: the greatest impact of its terms in each."""
    out = np.zeros((n_docs, COORDINATES))
    np.maximum.at(out, (doc, cell), impact)
    return out


def best_of_partition(block: Block, n: int, length: int, weights: np.ndarray, k: int):
    """A mapInArrow function: the k best documents of a partition for each query of the block."""
    place = {t: p for p, t in enumerate(block.terms)}
    cells = np.array([zlib.crc32(t) % COORDINATES for t in block.terms], np.int64)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = np.zeros((COORDINATES, len(block.places)))
        for q, own in enumerate(block.places):
            np.add.at(lookup[:, q], cells[own], weights[own])
        best = Best(len(block.places), k)
        for batch in in_rows(batches, CHUNK):
            doc, term, tf, terms = counted(batch.column("text").to_pylist())
            if not len(doc):
                continue
            total = np.bincount(doc, weights=tf, minlength=batch.num_rows).astype(np.int64)
            m = 50 + (50 * total * n) // length
            impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
            cell = np.array([zlib.crc32(t) % COORDINATES for t in terms], np.int64)
            bound = sketches(doc, impact, cell[term], batch.num_rows) @ lookup
            known = np.array([place.get(t, -1) for t in terms], np.int64)[term]
            # Impacts of query terms, sorted by document and term.
            mine = np.flatnonzero(known >= 0)
            key = doc[mine] * len(place) + known[mine]
            order = np.argsort(key)
            key, value = np.append(key[order], -1), np.append(impact[mine][order], 0)
            ids = batch.column("doc_id")
            none = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for q, own in enumerate(block.places):
                hopeful = np.flatnonzero(bound[:, q] >= best.threshold(q))
                hopeful = hopeful[np.argsort(-bound[hopeful, q], kind="stable")]
                for at in range(0, len(hopeful), STEP):
                    rows = hopeful[at:at + STEP]
                    if bound[rows[0], q] < best.threshold(q):
                        break
                    asked = rows[:, None] * len(place) + own
                    where = np.searchsorted(key[:-1], asked)
                    score = np.where(key[where] == asked, value[where], 0) @ weights[own]
                    good = score >= best.threshold(q)
                    best.add(q, score[good], ids[rows[good]], none[rows[good]])
        sizes = [len(s) for s in best.score]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int32()), pa.array(np.concatenate(best.id), pa.int64(), mask=np.concatenate(best.none)),
             pa.array(np.concatenate(best.score), pa.int64())], names=["item", "doc_id", "score"])

    return searched


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of every item with a score above 0.

    Null texts have no terms; items without terms have no rows. Rows that repeat, of either table, count and are ranked
    one by one; equal scores rank by ascending doc_id, rows without an id last. Either table may be empty.
    """
    parts = []
    for number, block in enumerate(blocks(items)):
        n, length, df = statistics(docs, block)
        if not n:
            continue
        found = texts(docs).mapInArrow(best_of_partition(block, n, length, weights_of(n, df), k), "item int, doc_id long, score long")
        item_ids = F.array(*[F.lit(i).cast("long") for i in block.ids])
        parts.append(found.select(F.lit(number).alias("block"), "item", F.get(item_ids, F.col("item")).alias("item_id"), "doc_id", "score"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    salted = reduce(DataFrame.unionAll, parts).withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    first = Window.partitionBy("block", "item", "salt").orderBy(*order)
    last = Window.partitionBy("block", "item").orderBy(*order)
    few = salted.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
