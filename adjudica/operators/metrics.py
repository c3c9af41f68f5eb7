"""Confusion, kappa and classification metrics, each from one aggregate pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from adjudica.constants import SEVERITY_LABELS

_EPS = 2.220446049250313e-16


def add(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def cell(actual: str, pred: str, a: int, p: int) -> Column:
    return F.count_if((F.col(actual) == a) & (F.col(pred) == p)).cast("double")


def confusion(df: DataFrame, actual: str, pred: str, labels: Sequence[int] = SEVERITY_LABELS) -> DataFrame:
    """Long confusion matrix over fixed labels; absent cells are 0.

    One partial aggregate of k*k counters, then unpivoted from a single row.
    """
    cells = df.agg(*[F.count_if((F.col(actual) == a) & (F.col(pred) == p)).alias(f"{a}|{p}")
                     for a in labels for p in labels])
    entries = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"),
                                 F.col(f"`{a}|{p}`").alias("n")) for a in labels for p in labels])
    return cells.select(F.explode(entries).alias("c")).select("c.*")


def kappa_of(cells: dict[tuple[int, int], Column], labels: Sequence[int]) -> Column:
    """Cohen's kappa from confusion cells; NULL when chance agreement is 1."""
    n = F.nullif(add(list(cells.values())), F.lit(0.0))
    observed = add([cells[v, v] for v in labels]) / n
    chance = add([add([cells[v, p] for p in labels]) * add([cells[a, v] for a in labels])
                  for v in labels]) / (n * n)
    return F.try_divide(observed - chance, F.nullif(1 - chance, F.lit(0.0)))


def kappa(actual: str, pred: str, labels: Sequence[int] = SEVERITY_LABELS,
          where: Column | None = None) -> Column:
    """Aggregate expression for Cohen's kappa, optionally over a subset of rows."""
    keep = where if where is not None else F.lit(True)
    cells = {(a, p): F.count_if(keep & (F.col(actual) == a) & (F.col(pred) == p)).cast("double")
             for a in labels for p in labels}
    return kappa_of(cells, labels)


def per_class(df: DataFrame, actual: str, pred: str, labels: Sequence[int] = SEVERITY_LABELS) -> DataFrame:
    """Precision, recall, F1 and support for each label seen in ``actual``."""
    stats = df.agg(*[e.alias(f"{k}{v}") for v in labels for k, e in (
        ("tp", cell(actual, pred, v, v)),
        ("sup", F.count_if(F.col(actual) == v)),
        ("out", F.count_if(F.col(pred) == v)))])
    entries = F.array(*[F.struct(
        F.lit(v).alias("label"),
        F.coalesce(F.try_divide(F.col(f"tp{v}"), F.nullif(F.col(f"out{v}"), F.lit(0))), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(F.col(f"tp{v}"), F.nullif(F.col(f"sup{v}"), F.lit(0))), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col(f"tp{v}"), F.nullif(F.col(f"sup{v}") + F.col(f"out{v}"), F.lit(0))),
                   F.lit(0.0)).alias("f1"),
        F.col(f"sup{v}").alias("support")) for v in labels])
    return stats.select(F.explode(entries).alias("c")).select("c.*").where("support > 0")


def summary(df: DataFrame, actual: str, pred: str, labels: Sequence[int] = SEVERITY_LABELS,
            probabilities: Sequence[str] | None = None) -> DataFrame:
    """Accuracy, macro and weighted F1 (labels seen on either side), optional log loss."""
    n = F.count(F.lit(1)).cast("double")
    f1, seen, weight = [], [], []
    for v in labels:
        tp = cell(actual, pred, v, v)
        sup, out = F.count_if(F.col(actual) == v), F.count_if(F.col(pred) == v)
        score = F.coalesce(F.try_divide(2 * tp, F.nullif(sup + out, F.lit(0))), F.lit(0.0))
        f1.append(score)
        seen.append((sup + out > 0).cast("int"))
        weight.append(score * sup)
    columns = [
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(actual) == F.col(pred)).cast("double")).alias("accuracy"),
        F.try_divide(add(f1), F.nullif(add(seen), F.lit(0))).alias("macro_f1"),
        F.try_divide(add(weight), F.nullif(n, F.lit(0.0))).alias("weighted_f1"),
    ]
    if probabilities is not None:
        chosen = F.lit(None).cast("double")
        for v, name in zip(labels, probabilities):
            chosen = F.when(F.col(actual) == v, F.col(name)).otherwise(chosen)
        clipped = F.least(F.greatest(chosen, F.lit(_EPS)), F.lit(1 - _EPS))
        columns.append(F.avg(-F.log(clipped)).alias("log_loss"))
    return df.agg(*columns)


def class_weights(df: DataFrame, label: str, fixed_labels: int | None = None) -> DataFrame:
    """Inverse-frequency weights; ``fixed_labels`` divides by a given label count instead of
    the number of classes present."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.agg(F.struct(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k")).alias("t"))
    rows = counts.withColumn("_t", totals.scalar())
    k = F.lit(fixed_labels) if fixed_labels else F.col("_t.k")
    return rows.select(label, (F.col("_t.n") / (k * F.col("_n"))).alias("weight"))


def group_modes(df: DataFrame, key: str | None, value: str) -> DataFrame:
    """Most frequent value per group (or overall); ties go to the smallest.

    Counts are aggregated first, so a hot group ships one row per distinct value and task.
    """
    keys = [key] if key else []
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(
        F.min_by(value, F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("mode"))
