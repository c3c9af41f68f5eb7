"""Feature pruning by missing rate, correlation, mutual information and importance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from adjudica.constants import (
    BOOLEAN_FEATURES, CORRELATION_THRESHOLD, ENGINEERED_TOKENS, IMPORTANCE_DROP_PERCENTILE,
    NUMERIC_FEATURES, SELECTION_MISSING_RATE,
)
from adjudica.operators.encode import raw_value
from adjudica.operators.quality import missing_rates
from adjudica.session import cut_lineage


def drop_sparse(df: DataFrame, columns: Sequence[str],
                max_rate: float = SELECTION_MISSING_RATE) -> tuple[list[str], list[str]]:
    present = [c for c in columns if c in df.columns]
    rates = missing_rates(df, present) if present else {}
    return [c for c in present if rates[c] <= max_rate], [c for c in present if rates[c] > max_rate]


_MOMENTS = ("i int, j int, n double, x double, y double, xx double, yy double, xy double, x0 double, x1 double, y0 double, y1 double, odd boolean")


def _moments(width: int, block: int):
    """A task's function: for each pair of columns the moments over the rows that have both values, one row per pair and task."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # [i, j] is about column i over the rows that also have column j.
        n, mean, square, cross = (np.zeros((width, width)) for _ in range(4))
        low, high = np.full((width, width), np.inf), np.full((width, width), -np.inf)
        odd = np.zeros((width, width), bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            known = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            value = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            finite = np.isfinite(value)
            strange = (known & ~finite).astype(float)
            value = np.where(known & finite, value, 0.0)
            has = known.astype(float)
            odd |= strange.T @ has > 0
            centre = value.sum(0) / np.maximum(has.sum(0), 1)
            off = np.where(known, value - centre, 0.0)
            m = has.T @ has
            own = np.maximum(m, 1)
            total = off.T @ has
            here = centre[:, None] + total / own
            spread = np.maximum((off * off).T @ has - total * total / own, 0)
            both = off.T @ off - total * total.T / own
            for at in range(0, width, block):
                for j in range(at, min(at + block, width)):
                    rows = value[known[:, j]]
                    mine = known[known[:, j]]
                    low[:, j] = np.minimum(low[:, j], np.where(mine, rows, np.inf).min(0, initial=np.inf))
                    high[:, j] = np.maximum(high[:, j], np.where(mine, rows, -np.inf).max(0, initial=-np.inf))
            # Moments about the means of two parts are joined without a difference of large sums.
            all_ = np.maximum(n + m, 1)
            step = np.where(m > 0, np.where(n > 0, here - mean, 0.0), 0.0)
            square += spread + step * step * n * m / all_
            cross += both + step * step.T * n * m / all_
            mean = np.where(n > 0, mean + step * m / all_, here)
            n += m
        i, j = np.triu_indices(width, 1)
        i, j = i[n[i, j] > 0], j[n[i, j] > 0]
        columns = [n[i, j], mean[i, j], mean[j, i], square[i, j], square[j, i], cross[i, j], low[i, j], high[i, j], low[j, i], high[j, i]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *map(pa.array, columns), pa.array(odd[i, j] | odd[j, i])],
            names=["i", "j", "n", "x", "y", "xx", "yy", "xy", "x0", "x1", "y0", "y1", "odd"])
    return summed


def correlations(df: DataFrame, columns: dict[str, Column], block: int = 48) -> DataFrame:
    """(left, right, corr): Pearson over rows with both values; NULL for a constant side, NaN for a side that is not finite.

    One scan serves all pairs: a task multiplies the matrices of its batches and sends a row per pair. An aggregate of
    every pair's moments would be hundreds of buffers, which cannot be compiled, and a scan per block of pairs.
    """
    names = list(columns)
    pairs = [(i, j, names[i], names[j]) for i, j in combinations(range(len(names)), 2)]
    if not pairs:
        return df.sparkSession.createDataFrame([], "left string, right string, corr double")
    values = df.select(*[e.cast("double").alias(f"c{i}") for i, e in enumerate(columns.values())])
    own = Window.partitionBy("i", "j")
    parts = values.mapInArrow(_moments(len(names), block), _MOMENTS)
    parts = parts.withColumns({c: F.col(c) - F.sum(F.col("n") * F.col(c)).over(own) / F.sum("n").over(own) for c in ("x", "y")})
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    flat = (F.min("x0") == F.max("x1")) | (F.min("y0") == F.max("y1"))
    alike = F.sum(F.col("xy") + n * x * y) / F.sqrt(F.sum(F.col("xx") + n * x * x)) / F.sqrt(F.sum(F.col("yy") + n * y * y))
    found = parts.groupBy("i", "j").agg(F.when(F.bool_or("odd"), F.lit(float("nan"))).when(~flat, alike).alias("corr"))
    listed = df.sparkSession.createDataFrame(pairs, "i int, j int, left string, right string")
    return listed.join(found, ["i", "j"], "left").select("left", "right", "corr")


def _edges_below(value: Column, edges: Sequence[float]) -> Column:
    listed = F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>")
    return F.when(value.isNotNull(), F.size(F.filter(listed, lambda edge: edge < value)))


def equal_depth_bins(df: DataFrame, columns: dict[str, Column], bins: int = 10) -> dict[str, Column]:
    """Bin index by approximate quantile edges; only the edges reach the driver."""
    names = list(columns)
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = df.agg(*[F.percentile_approx(columns[c], shares, F.lit(10_000)).alias(f"e{i}")
                   for i, c in enumerate(names)]).first()
    binned = {}
    for i, c in enumerate(names):
        binned[c] = _edges_below(columns[c], sorted(set(row[f"e{i}"] or [])))
    return binned


def mutual_information(df: DataFrame, discrete: dict[str, Column], label: str) -> DataFrame:
    """(feature, mi) in nats between each discrete column and the label, in one shuffle of the rows."""
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.concat(F.lit("="), e.cast("string")), F.lit("")).alias("x"))
                        for c, e in discrete.items()])
    rows = df.select(F.explode(entries).alias("e"), F.col(label).alias("y")).select("e.*", "y")
    # Four readers share the counts, so the rows are multiplied and counted once.
    joint = cut_lineage(rows.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("nxy")))
    by_x = joint.groupBy("feature", "x").agg(F.sum("nxy").alias("nx"))
    by_y = joint.groupBy("feature", "y").agg(F.sum("nxy").alias("ny"))
    total = joint.groupBy("feature").agg(F.sum("nxy").alias("n"))
    terms = joint.join(by_x, ["feature", "x"]).join(by_y, ["feature", "y"]).join(total, "feature")
    share = F.col("nxy") / F.col("n")
    ratio = F.col("nxy").cast("double") * F.col("n") / (F.col("nx").cast("double") * F.col("ny"))
    return terms.groupBy("feature").agg(F.sum(share * F.log(ratio)).alias("mi"))


def correlation_prune(pairs: Sequence[tuple[str, str, float | None]], scores: dict[str, float],
                      columns: Sequence[str], numeric: Sequence[str],
                      threshold: float = CORRELATION_THRESHOLD) -> tuple[list[str], list[tuple[str, str]]]:
    """Greedy pass in column order: of two correlated columns the lower score goes.

    Works on the k*k summary, not on rows. An undefined correlation keeps both columns, and a
    dropped column prunes nothing further.
    """
    place = {c: k for k, c in enumerate(numeric)}
    strong = [tuple(sorted((a, b), key=place.get)) for a, b, c in pairs if c is not None and abs(c) > threshold and a in place and b in place]
    lost: dict[str, str] = {}
    for a, b in sorted(strong, key=lambda p: (place[p[0]], place[p[1]])):
        if not lost.keys() & {a, b}:
            weak, good = (b, a) if scores.get(a, 0.0) >= scores.get(b, 0.0) else (a, b)
            lost[weak] = good
    return [c for c in columns if c not in lost], list(lost.items())


def prune_raw(train: DataFrame, columns: Sequence[str], label: str = "penalty_severity",
              max_missing: float = SELECTION_MISSING_RATE,
              threshold: float = CORRELATION_THRESHOLD) -> tuple[list[str], DataFrame]:
    """Missing-rate then correlation pruning; also a report frame (column, status, because)."""
    dense, sparse = drop_sparse(train, columns, max_missing)
    numeric = [c for c in dense if c in NUMERIC_FEATURES or c in BOOLEAN_FEATURES]
    kept, dropped = dense, []
    if len(numeric) > 1:
        # Texts are cast once; every statistic below reads the values.
        rows = cut_lineage(train.select(F.col(label).alias("_label"), *[raw_value(c).alias(f"x_{c}") for c in dense]))
        values = {c: F.col(f"`x_{c}`") for c in numeric}
        pairs = [(r.left, r.right, r.corr) for r in correlations(rows, values).collect()]
        discrete = equal_depth_bins(rows, values) | {c: F.col(f"`x_{c}`") for c in dense if c not in numeric}
        scores = {r.feature: r.mi for r in mutual_information(rows, discrete, "_label").collect()}
        kept, dropped = correlation_prune(pairs, scores, dense, numeric, threshold)
    report = [(c, "kept", None) for c in kept] + [(c, "missing", None) for c in sparse]
    report += [(a, "correlated", b) for a, b in dropped]
    return kept, train.sparkSession.createDataFrame(report, "column string, status string, because string")


def drop_least_important(gains: DataFrame, percentile: float = IMPORTANCE_DROP_PERCENTILE) -> DataFrame:
    """The bottom share of ``gains(feature, gain)``; at least one if there are two or more."""
    n = gains.count()
    drop = max(1, int(n * percentile / 100)) if n > 1 else 0
    return gains.orderBy("gain", "feature").limit(drop)


def top_features(gains: DataFrame, n: int) -> DataFrame:
    """The n largest importances with flags for domain and engineered features."""
    engineered = "|".join(ENGINEERED_TOKENS)
    return gains.orderBy(F.col("gain").desc(), "feature").limit(n).withColumns({
        "is_domain": F.col("feature").rlike("incident_type|severity"),
        "is_engineered": F.col("feature").rlike(engineered)})


def sanity_checks(gains: DataFrame, domain_n: int = 10, engineered_n: int = 15) -> DataFrame:
    domain = top_features(gains, domain_n).agg(F.bool_or("is_domain").alias("domain_in_top"))
    engineered = top_features(gains, engineered_n).agg(F.bool_or("is_engineered").alias("engineered_in_top"))
    return domain.withColumn("engineered_in_top", engineered.scalar())
