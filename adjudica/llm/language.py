"""Language identification by a string kernel.

Kernel: cosine of n-gram presence over a blended spectrum (1 to 4 characters, hashed into 2^BITS cells, of which a text
lists those it has). Nystroem: landmark texts span the feature space, phi(x) = k(x, landmarks) K^-1/2. One ridge regression
per language on phi. A score is linear in the presence vector, so the landmark products are folded into one matrix, with a
row for each cell of a landmark, and a batch of texts is scored by the product of its sparse presence matrix with it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from adjudica.llm.common import drop_written, in_rows, remainder, written

BITS = 20
ORDERS = 4
SLICE = 1 << 16
UNKNOWN = "und"
SEEN = "doc_id long, lang string, print long, bits binary"


def cells(text: str) -> np.ndarray:
    """Cells of all n-grams of the whole text, lower-cased, digits as one character; ascending, each once."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c[(c >= 48) & (c <= 57)] = 48
    h, grams = c, []
    for order in range(ORDERS):
        if order:
            h = h[:-1] * np.uint64(0x100000001B3) + c[order:]
        if not len(h):
            break
        grams.append((((h + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.int32)


def packed(found: np.ndarray) -> bytes:
    """Cells as bits, compressed: at most 2^BITS / 8 bytes and a little, however long the text."""
    row = np.zeros(1 << BITS, bool)
    row[found] = True
    return zlib.compress(np.packbits(row).tobytes(), 1)


def unpacked(bits: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8))).astype(np.int32)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclass
class Landmarks:
    """Presence of the cells that any landmark has: a row of bits per cell, a bit per landmark."""

    known: np.ndarray
    bits: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, marks: list[np.ndarray]) -> Landmarks:
        known = np.unique(np.concatenate([np.zeros(0, np.int32), *marks]))
        bits = np.zeros((len(known), -(-len(marks) // 8)), np.uint8)
        for k, mark in enumerate(marks):
            bits[np.searchsorted(known, mark), k // 8] |= np.uint8(128 >> k % 8)
        return cls(known, bits, np.array(list(map(len, marks)), np.float64))

    def rows(self, at: np.ndarray | slice) -> np.ndarray:
        return np.unpackbits(self.bits[at], axis=1, count=len(self.sizes))

    def kernel(self, found: np.ndarray) -> np.ndarray:
        """Cosine of a text's presence with that of each landmark."""
        at = np.searchsorted(self.known, found)
        at = at[self.known[np.minimum(at, len(self.known) - 1)] == found] if len(self.known) else at[:0]
        common = np.zeros(len(self.sizes))
        for k in range(0, len(at), SLICE):
            common += self.rows(at[k:k + SLICE]).sum(axis=0, dtype=np.int64)
        return common / np.sqrt(np.maximum(self.sizes * len(found), 1.0))

    def folded(self, coefficients: np.ndarray) -> np.ndarray:
        """A row per known cell: what its presence adds, before division by the root of a text's number of cells."""
        scaled = (coefficients / np.sqrt(np.maximum(self.sizes, 1.0))[:, None]).astype(np.float32)
        parts = [self.rows(slice(k, k + SLICE)).astype(np.float32) @ scaled for k in range(0, len(self.known), SLICE)]
        return np.concatenate([np.zeros((0, coefficients.shape[1]), np.float32), *parts])


@dataclass
class Model:
    languages: list[str]
    known: np.ndarray  # cells that have weights, ascending
    weights: np.ndarray  # known cells x languages

    def places(self) -> np.ndarray:
        """For every cell its row of weights, or -1."""
        at = np.full(1 << BITS, -1, np.int32)
        at[self.known] = np.arange(len(self.known), dtype=np.int32)
        return at

    def scores(self, found: list[np.ndarray], places: np.ndarray) -> np.ndarray:
        """Product of the sparse presence matrix of a batch of texts with the weights, rows scaled to length 1."""
        sizes = np.array(list(map(len, found)), np.int64)
        column = places[np.concatenate([np.zeros(0, np.int32), *found])]
        row = np.repeat(np.arange(len(found)), sizes)[column >= 0]
        column = column[column >= 0]
        out = np.zeros((len(found), len(self.languages)))
        for at in range(0, len(column), SLICE):
            mine, first = np.unique(row[at:at + SLICE], return_index=True)
            out[mine] += np.add.reduceat(self.weights[column[at:at + SLICE]], first)
        return out / np.sqrt(np.maximum(sizes, 1))[:, None]


def fit(landmarks: Landmarks, marks_kernel: np.ndarray, kernel: np.ndarray, y: list[str], ridge: float = 1e-2) -> Model:
    """kernel: a row per taught text, a column per landmark; marks_kernel: that of the landmarks themselves."""
    languages = sorted(set(y))
    if not languages:
        return Model([], np.zeros(0, np.int32), np.zeros((0, 0), np.float32))
    values, vectors = np.linalg.eigh(marks_kernel)
    good = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, good] / np.sqrt(values[good])
    phi = kernel @ root
    target = np.where(np.array(y)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    w = np.linalg.solve(phi.T @ phi + ridge * len(y) / 100 * np.eye(phi.shape[1]), phi.T @ target)
    return Model(languages, landmarks.known, landmarks.folded(root @ w))


def train(docs: DataFrame, rows_per_language: int = 400, landmarks: int = 240, max_rows: int = 20_000) -> Model:
    """Learn from rows outside the fold crc32(doc_id) mod 3 = 1 that have text and lang.

    The fit sees about rows_per_language rows of each language, chosen by a hash of the id; larger languages are thinned
    at the scan. Equal rows teach once, and max_rows rows at most, whatever the number of languages and of rows of one id.
    Landmarks, `landmarks` at most, are the first of each language by that hash. Tasks compare the taught rows with them. The
    driver collects the cells of the landmarks (128 KB each at most) and a kernel row (8 bytes a landmark) per taught row.
    """
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").alias("text"))
            .where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), 3) != 1)))
    shares = rows.groupBy("lang").agg(F.least(F.lit(1.0), rows_per_language / F.count("*")).alias("share"))
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    ids = rows.select("doc_id", "lang", spread.alias("at")).join(shares, "lang").where(F.col("at") < F.col("share")).select("doc_id").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # About rows_per_language ids a language, max_rows at most, as many as the fit collects: the texts need not be shuffled.
    taught = rows.join(F.broadcast(ids), "doc_id")

    def seen_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_rows(batches):
            part = batch.filter(pa.array([has_letter(t) for t in batch.column("text").to_pylist()], pa.bool_()))
            found = [cells(t) for t in part.column("text").to_pylist()]
            prints = [int.from_bytes(hashlib.blake2b(c.tobytes(), digest_size=8).digest(), "little", signed=True) for c in found]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(prints, pa.int64()), pa.array(map(packed, found), pa.binary())],
                                             names=["doc_id", "lang", "print", "bits"])

    key = ["doc_id", "lang", "print"]
    seen = written(taught.mapInArrow(seen_cells, SEEN).dropDuplicates(key), "language")
    order = [F.xxhash64("doc_id"), *key]
    chosen = seen.select(*key).orderBy(*order).limit(max_rows)
    names = chosen.select(F.count_distinct("lang")).first()[0]
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    first = chosen.withColumn("rank", rank).where(F.col("rank") <= max(1, landmarks // max(names, 1))).orderBy("rank", *order).limit(landmarks)
    got = seen.join(F.broadcast(first), key).select(*key, "bits").collect()
    marks = [unpacked(bytes(r.bits)) for r in sorted(got, key=lambda r: (r.doc_id, r.lang, r.print))]
    index = Landmarks.of(marks)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_rows(batches):
            found = [index.kernel(unpacked(b)).tobytes() for b in batch.column("bits").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in key] + [pa.array(found, pa.binary())], names=[*key, "kernel"])

    kernels = seen.join(F.broadcast(chosen), key).select(*key, "bits").mapInArrow(compared, "doc_id long, lang string, print long, kernel binary").collect()
    drop_written(seen)
    kernels.sort(key=lambda r: (r.doc_id, r.lang, r.print))
    kernel = np.array([np.frombuffer(bytes(r.kernel)) for r in kernels]).reshape(len(kernels), len(marks))
    return fit(index, np.array([index.kernel(m) for m in marks]).reshape(len(marks), len(marks)), kernel, [r.lang for r in kernels])


def predict(docs: DataFrame, model: Model, rows: int = 128) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    A text that is null or has no letter is `und` with score 0, and so is every text when nothing was learned. The score
    is the winning regression value mapped from [-1, 1] to [0, 1].
    """
    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = model.places()
        for part in in_rows(batches, rows):
            found = part.column("text").to_pylist()
            live = [has_letter(t) and bool(model.languages) for t in found]
            names, scores = [UNKNOWN] * len(found), np.zeros(len(found))
            if model.languages:
                s = model.scores([cells(t if live[k] else "") for k, t in enumerate(found)], places)
                top = s.argmax(axis=1)
                names = [model.languages[top[k]] if live[k] else UNKNOWN for k in range(len(found))]
                scores = np.where(live, np.clip((s.max(axis=1) + 1) / 2, 0, 1), 0.0).astype(float)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predicted, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
