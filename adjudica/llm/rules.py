"""Quality rules as a short-circuit cascade.

The cost and the rejection rate of each rule are measured on a sample; the rules then run in order of rejections
per second, and a text leaves at the first rule it breaks. Every rule is a pure function of the text and the verdict
is their conjunction, so the order changes the time a run takes and never a result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adjudica.llm.common import in_rows, texts
from adjudica.llm.stats import TextStats


@dataclass(frozen=True)
class Rule:
    name: str
    broken: Callable[[TextStats], bool]


def base_failed(s: TextStats) -> bool:
    return s.n_words < 20 or 100 * s.n_repeat_words > 30 * s.n_words


#: The thresholds sit well outside what prose shows; a text must be far off to be rejected.
RULES = (
    Rule("few_words", lambda s: s.n_words < 20),
    Rule("repeated_words", lambda s: 100 * s.n_repeat_words > 30 * s.n_words),
    Rule("symbols", lambda s: 4 * s.n_symbols > s.n_words),
    Rule("duplicate_lines", lambda s: 2 * s.n_dup_lines > len(s.lines)),
    Rule("stutter", lambda s: 10 * s.n_stutter > 3 * s.n_words),
    Rule("capitals", lambda s: s.n_upper > s.n_lower),
    Rule("word_length", lambda s: not 2 * s.n_words <= s.word_chars <= 20 * s.n_words),
)


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) on about sample_rows texts; what rules share is timed for each of them."""
    n = docs.count()
    if not n:
        return []

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hits, rows = [0.0] * len(rules), [0] * len(rules), 0
        for batch in in_rows(batches):
            for text in batch.column("text").to_pylist():
                rows += 1
                for k, rule in enumerate(rules):
                    begin = time.perf_counter()
                    hits[k] += rule.broken(TextStats(text))
                    spent[k] += time.perf_counter() - begin
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(rules)), pa.int32()), pa.array(spent), pa.array(hits, pa.int64()), pa.array([rows] * len(rules), pa.int64())],
            names=["k", "spent", "hits", "rows"])

    sample = texts(docs).sample(fraction=min(1.0, sample_rows / n), seed=7)
    sums = sample.mapInArrow(timed, "k int, spent double, hits long, rows long").groupBy("k").agg(
        F.sum("spent").alias("spent"), F.sum("hits").alias("hits"), F.sum("rows").alias("rows"))
    return [(rules[r.k].name, r.spent / r.rows, r.hits / r.rows) for r in sums.collect() if r.rows]


def ordered(rules: tuple[Rule, ...], measured: list[tuple[str, float, float]]) -> tuple[Rule, ...]:
    """Rules by rejections per second, the best first; without a measurement the given order stays."""
    gain = {name: rate / max(cost, 1e-9) for name, cost, rate in measured}
    return tuple(sorted(rules, key=lambda r: -gain.get(r.name, 0.0)))


def passes(s: TextStats, rules: tuple[Rule, ...]) -> bool:
    return not any(rule.broken(s) for rule in rules)


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """The rows whose text breaks no rule, with all their columns.

    Null and empty texts have no words and are rejected. Repeated rows are judged alike; an empty table stays empty.
    """
    cascade = ordered(rules, measure(docs, rules, sample_rows))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_rows(batches):
            yield batch.filter(pa.array([passes(TextStats(t), cascade) for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """The base counts of every text, whether the base rules reject it, and the verdict of the cascade.

    Null texts count as empty (all counts 0, rejected). One row per input row, ids may be null or repeat.
    """
    cascade = ordered(rules, measure(docs, rules, sample_rows))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_rows(batches):
            columns: dict[str, list] = {c: [] for c in (*counts, "base_failed", "kept")}
            for text in batch.column("text").to_pylist():
                s = TextStats(text)
                verdict = passes(s, cascade)
                failed = not verdict and base_failed(s)
                for c in counts:
                    columns[c].append(getattr(s, c))
                columns["base_failed"].append(failed)
                columns["kept"].append(verdict)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **columns}, schema=pa.schema(
                [("doc_id", pa.int64()), *((c, pa.int64()) for c in counts), ("base_failed", pa.bool_()), ("kept", pa.bool_())]))

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean"
    return texts(docs).mapInArrow(judged, schema)
