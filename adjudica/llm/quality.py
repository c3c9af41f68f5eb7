"""Quality classifier: histogram gradient-boosted trees over statistics of the text.

Statistics are computed in Arrow batches on the executors. Trees grow on histograms of at most BINS quantile bins from
a bounded sample of labelled rows (max_rows, those with the smallest id hashes; at 30 columns of 8 bytes about 5 MB for
the default), and are flattened into arrays of one entry per node, which numpy walks for a whole batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from adjudica.llm.common import in_rows, remainder, texts
from adjudica.llm.stats import TextStats

BINS = 64
FEATURES = (
    "log_chars", "log_words", "mean_word", "upper", "digits", "blanks", "new_lines", "pipes", "exclamations", "periods", "commas",
    "other_punctuation", "symbols", "high_bytes", "control", "duplicate_lines", "repeated_words", "distinct_words", "stutter",
    "compression", "line_words", "long_words", "short_words", "entropy", "log_lines",
)


def features(text: str | None) -> list[float]:
    """Statistics of the whole text as FEATURES names them; a null or empty text gives zeros."""
    s = TextStats(text)
    if not s.text:
        return [0.0] * len(FEATURES)
    b = s.byte_counts
    size, words, lines = int(b.sum()), max(1, s.n_words), max(1, len(s.lines))
    lengths = np.fromiter(map(len, s.words), np.int64, s.n_words)
    share = b[b > 0] / size
    punctuation = int(b[33:48].sum() + b[58:65].sum() + b[91:97].sum() + b[123:127].sum())
    return [
        np.log1p(len(s.text)), np.log1p(s.n_words), s.word_chars / words, s.n_upper / max(1, s.n_upper + s.n_lower), b[48:58].sum() / size,
        (b[32] + b[9]) / size, b[10] / size, b[124] / words, b[33] / words, b[46] / words, b[44] / words,
        (punctuation - b[33] - b[44] - b[46] - b[124]) / size, s.n_symbols / words, b[128:].sum() / size, (b[:32].sum() - b[9] - b[10]) / size,
        s.n_dup_lines / lines, s.n_repeat_words / words, s.n_distinct / words, s.n_stutter / words,
        s.packed / size, s.n_words / lines, (lengths > 15).sum() / words, (lengths < 3).sum() / words, float(-(share * np.log2(share)).sum()), np.log1p(len(s.lines)),
    ]


@dataclass
class Forest:
    """All trees in five flat arrays; a leaf points at itself, so every row takes the same number of steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row; all rows descend all trees together."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1.0 / (1.0 + np.exp(-(self.bias + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, l2: float = 1.0, least_rows: int = 5) -> Forest:
    """Boost depth-limited trees on the logistic loss. One bincount per level makes the histograms of all its nodes.

    Without rows, or with one label only, the forest has no split and returns the smoothed share of label 1.
    """
    n, width = x.shape
    share = (y.sum() + 1.0) / (n + 2.0)
    bias = float(np.log(share / (1 - share)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) if n else np.zeros(0) for k in range(width)]
    binned = np.stack([np.searchsorted(cuts[k], x[:, k], side="left") for k in range(width)], axis=1) if n else np.zeros((0, width), np.int64)
    margin = np.full(n, bias)

    def leaf(v: float) -> int:
        node = len(feature)
        feature.append(0), threshold.append(0.0), left.append(node), right.append(node), value.append(v)
        return node

    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1.0 / (1.0 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(leaf(0.0))
        node_of, level = np.full(n, roots[-1]), [roots[-1]]
        for step in range(depth + 1):
            place = {node: k for k, node in enumerate(level)}
            slot = np.full(len(feature), -1)
            slot[level] = np.arange(len(level))
            mine = slot[node_of]
            live = np.flatnonzero(mine >= 0)
            sums_g = np.bincount(mine[live], grad[live], len(level))
            sums_h = np.bincount(mine[live], hess[live], len(level))
            for node in level:
                value[node] = float(-rate * sums_g[place[node]] / (sums_h[place[node]] + l2))
            if step == depth:
                break
            best = [(1e-6, -1, -1)] * len(level)
            for k in range(width):
                if not len(cuts[k]):
                    continue
                cell = mine[live] * BINS + binned[live, k]
                g, h, c = (np.bincount(cell, w, len(level) * BINS).reshape(len(level), BINS).cumsum(axis=1) for w in (grad[live], hess[live], None))
                gain = g ** 2 / (h + l2) + (sums_g[:, None] - g) ** 2 / (sums_h[:, None] - h + l2) - (sums_g ** 2 / (sums_h + l2))[:, None]
                gain[(c < least_rows) | (c[:, -1:] - c < least_rows)] = -np.inf
                top = gain[:, :len(cuts[k])].argmax(axis=1)
                for m in range(len(level)):
                    if gain[m, top[m]] > best[m][0]:
                        best[m] = (gain[m, top[m]], k, int(top[m]))
            below = []
            for m, node in enumerate(level):
                _, k, cut = best[m]
                if k < 0:
                    continue
                feature[node], threshold[node] = k, float(cuts[k][cut])
                left[node], right[node] = leaf(0.0), leaf(0.0)
                value[node] = 0.0
                rows = live[mine[live] == m]
                node_of[rows] = np.where(binned[rows, k] <= cut, left[node], right[node])
                below += [left[node], right[node]]
            level = below
            if not level:
                break
        margin += np.asarray(value)[node_of]
    return Forest(np.asarray(feature, np.int64), np.asarray(threshold), np.asarray(left, np.int64), np.asarray(right, np.int64),
                  np.asarray(value), np.asarray(roots, np.int64), depth, bias)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_rows(batches):
        rows = [features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], names=["label", "x"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Forest:
    """Fit on the labelled rows whose crc32(doc_id) mod 4 is not 2; at most max_rows labels, by id hash.

    An id that repeats in docs teaches once per row, up to four times max_rows rows in all, chosen by a hash of what they
    show, so that both labels stay in proportion; the bound is that of the fit.

    Labels that are null or not 0/1, and ids that are null or held out, teach nothing. Without any row the
    forest returns 0.5 for every text.
    """
    ids = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
           .where(F.col("label").isin(0, 1) & (remainder(F.col("doc_id"), 4) != 2))
           .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows))
    # At most max_rows pairs of an id and a bit: the broadcast is bounded by that parameter.
    taught = texts(docs).join(F.broadcast(ids), "doc_id").select("label", "text")
    rows = taught.mapInArrow(_feature_rows, "label int, x array<double>").orderBy(F.xxhash64("x", "label"), "x", "label").limit(4 * max_rows).collect()
    rows.sort(key=lambda r: (r.label, r.x))
    x = np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r.label for r in rows], float))


def score(docs: DataFrame, forest: Forest, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; a null text is scored as an empty one."""
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_rows(batches):
            x = np.array([features(t) for t in batch.column("text").to_pylist()], float).reshape(batch.num_rows, len(FEATURES))
            s = forest.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])

    out = texts(docs).mapInArrow(scored, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, forest: Forest, threshold: float = 0.7) -> DataFrame:
    """The rows scored at least threshold, with all their columns."""
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_rows(batches):
            x = np.array([features(t) for t in batch.column("text").to_pylist()], float).reshape(batch.num_rows, len(FEATURES))
            yield batch.filter(pa.array(forest.scores(x) >= threshold))

    return docs.mapInArrow(kept, docs.schema)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, threshold: float = 0.7) -> DataFrame:
    return score(docs, train(docs, labels, max_rows), threshold)
