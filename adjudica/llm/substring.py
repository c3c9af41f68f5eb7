"""Substring dedup on words by the hashes of anchored windows.

The reference is the whole corpus. No document is factored: a relative Lempel-Ziv parsing against blocks of the corpus in
turn would cost documents times blocks. Instead every window of `width` words is grouped by its anchor (see anchors), under
which all its copies meet, and is known elsewhere or not. The words of known windows go: they are those that factors
of at least `width` words would cover.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from adjudica.llm.anchors import ASK, MASKS, arrow_schema, covered, gram_hashes, repeated, whole_anchors
from adjudica.llm.common import BLANKS, quoted, texts

WIDTH, GRAM = 35, 8
OUT = "doc_id long, n_words long, n_removed long, n_factors long, kept_sha256 string"
BLANK = re.compile(rb"[\x20\x09-\x0d]")
WORD = re.compile(rb"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+")


def word_hashes(found: list[str], piece_bytes: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    return hashes_of_words([t.encode("utf-8", "surrogatepass") for t in found], piece_bytes)


def hashes_of_words(found: list[bytes], piece_bytes: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words and the edges of each text, computed for pieces of the joined bytes."""
    rng = np.random.default_rng(20240229)
    letters = rng.integers(1, 1 << 63, 256, np.uint64)
    joined = b"\n".join(found)
    hashes, at = [np.zeros(0, np.uint64)], 0
    while at < len(joined):
        stop = len(joined)
        if at + piece_bytes < stop:
            blank = BLANK.search(joined, at + piece_bytes)
            stop = blank.end() if blank else stop
        b = np.frombuffer(joined, np.uint8, stop - at, at)
        solid = (b != 32) & ((b < 9) | (b > 13))
        where = np.flatnonzero(solid)
        if len(where):
            new = np.ones(len(where), bool)
            new[1:] = where[1:] != where[:-1] + 1
            starts = np.flatnonzero(new)
            lengths = np.diff(np.append(starts, len(where)))
            offset = np.arange(len(where)) - np.repeat(starts, lengths)
            powers = np.cumprod(np.full(int(lengths.max()), 0xF1357AEA2E62A9C5, np.uint64))
            hashes.append(np.add.reduceat(letters[b[where]] * powers[offset], starts))
        at = stop
    edges = np.zeros(len(found) + 1, np.int64)
    edges[1:] = np.cumsum([len(b.split()) for b in found])
    return np.concatenate(hashes), edges


def window_hashes(_found: list[str], symbols: np.ndarray, edges: np.ndarray, rows: dict) -> list[bytes]:
    """For each asked span the hashes of its windows."""
    full = gram_hashes(symbols, WIDTH)
    at = edges[rows["doc"]] + rows["pos"]
    return [full[p:p + n].tobytes() for p, n in zip(at.tolist(), rows["n"].tolist())]


def known_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The index block: windows of all spans of its anchors. Answers which windows of a lone span stand elsewhere."""
    for t in whole_anchors(batches):
        n = t.column("n").to_numpy().astype(np.int64)
        kind = t.column("kind").to_numpy()
        windows = np.frombuffer(b"".join(t.column("content").to_pylist()), np.uint64)
        row = np.repeat(np.arange(len(n)), n)
        # A span that recurs as a whole stands for at least two places.
        weight = np.where(kind == ASK, 1, 2)[row]
        _, of, = np.unique(windows, return_inverse=True)
        known = np.bincount(of, weight)[of] > 1
        bit = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        mask = np.zeros(len(n), np.int64)
        np.bitwise_or.at(mask, row[known], np.int64(1) << bit[known])
        keep = np.flatnonzero((kind == ASK) & (mask != 0))
        yield pa.RecordBatch.from_pydict({**{c: t.column(c).to_numpy()[keep] for c in ("block", "doc", "pos", "n")}, "mask": mask[keep]}, schema=arrow_schema(MASKS))


def _digests(rows: pa.Table, found: list[str], edges: np.ndarray, starts: np.ndarray) -> pa.Table:
    gone = covered(int(edges[-1]), starts, WIDTH)
    columns: dict[str, list] = {c: [] for c in ("n_words", "n_removed", "n_factors", "kept_sha256")}
    for d, text in enumerate(found):
        mine = gone[edges[d]:edges[d + 1]]
        words = text.encode("utf-8", "surrogatepass").split()
        kept = b" ".join(compress(words, ~mine) if mine.any() else words)
        columns["n_words"].append(len(words))
        columns["n_removed"].append(int(mine.sum()))
        columns["n_factors"].append(int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum()))
        columns["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
    return pa.Table.from_pydict({"doc_id": rows.column("doc_id"), **columns}, schema=arrow_schema(OUT))


def _texts_left(rows: pa.Table, found: list[str], edges: np.ndarray, starts: np.ndarray) -> pa.Table:
    """The rows with what remains of their texts; a word goes with the blanks before it."""
    gone = covered(int(edges[-1]), starts, WIDTH)
    left = []
    for d, text in enumerate(found):
        mine = gone[edges[d]:edges[d + 1]]
        if mine.any():
            text = b"".join(compress(WORD.findall(text.encode("utf-8", "surrogatepass")), ~mine)).decode("utf-8", "surrogatepass").lstrip(BLANKS)
        left.append(text)
    return pa.Table.from_arrays([pa.array(left, pa.string()), rows.column("rest")], names=["text", "rest"])


def digest(docs: DataFrame) -> DataFrame:
    """Per row: words, removed words, removed runs, and the digest of the words that stay.

    A word goes if it lies in a run of WIDTH words that starts anywhere else, in its own text too; judged on the input.
    A null or empty text has no words; repeated rows are copies of each other like any others; texts of fewer than WIDTH
    words stay whole. One output row per input row.
    """
    return repeated(texts(docs), word_hashes, window_hashes, known_windows, _digests, OUT, WIDTH, GRAM, first_stays=False)


def rewrite(docs: DataFrame) -> DataFrame:
    """The rows with their columns and with texts that have lost their duplicate words, n_chars recounted if there is one.

    Every row stays; a text that is repeated in full becomes empty, and so does a null one.
    """
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.struct(*(F.col(quoted(c)) for c in others)).alias("rest"))
    out = StructType([StructField("text", StringType()), rows.schema["rest"]])
    left = repeated(rows, word_hashes, window_hashes, known_windows, _texts_left, out, WIDTH, GRAM, first_stays=False)
    columns = {c: F.col(f"rest.{quoted(c)}").alias(c) for c in others} | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return left.select(*(columns[c] for c in docs.columns))
