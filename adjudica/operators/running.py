"""Ordered scans that split a hot key: per-cell windows plus a carry between cells.

A window over (key ORDER BY time) puts a whole key into one task. Here the order is cut into
cells by a monotone bucket (a day, a date and round, an id prefix). Rows are scanned inside
their cell; one row per cell is scanned across cells; the two are combined. No task ever
holds more than one cell, or one row per cell of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def running(df: DataFrame, keys: Sequence[str], bucket: Sequence[str], order: Sequence[Column],
            value: Column, out: str, how: str = "sum", inclusive: bool = False) -> DataFrame:
    """Add ``out``: the aggregate of ``value`` over earlier rows of the same key.

    ``bucket`` columns must be monotone in ``order`` and neither they nor the keys may be
    NULL. ``how`` is ``sum``, ``max`` or ``last`` (last non-NULL).
    """
    keys, bucket = list(keys), list(bucket)
    df = df.withColumn("_v", value)
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    stop = 0 if inclusive else -1
    inside = Window.partitionBy(*keys, *bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, stop)
    across = Window.partitionBy(*keys).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    if how == "sum":
        total, scan, carry = F.sum("_v"), F.sum("_v").over(inside), F.sum("_total").over(across)
    elif how == "max":
        total, scan, carry = F.max("_v"), F.max("_v").over(inside), F.max("_total").over(across)
    else:
        total = F.max_by("_v", F.when(F.col("_v").isNotNull(), rank))
        scan = F.last("_v", ignorenulls=True).over(inside)
        carry = F.last("_total", ignorenulls=True).over(across)
    cells = df.groupBy(*keys, *bucket).agg(total.alias("_total"))
    cells = cells.select(*keys, *bucket, carry.alias("_carry"))
    joined = df.withColumn("_scan", scan).join(cells, [*keys, *bucket], "left")
    if how == "sum":
        both = F.coalesce(F.col("_scan"), F.lit(0)) + F.coalesce(F.col("_carry"), F.lit(0))
    elif how == "max":
        both = F.greatest("_scan", "_carry")
    else:
        both = F.coalesce("_scan", "_carry")
    return joined.withColumn(out, both).drop("_v", "_scan", "_carry")


def with_text_cell(df: DataFrame, value: str, out: str, cells: int = 64) -> DataFrame:
    """Add a monotone cell of a text column: how many of ``cells`` sampled values are smaller; NULL is in cell 0.

    The sample is the values with the smallest hashes, so it follows the data whatever its ids look like; it shapes the
    work and no result.
    """
    sample = df.select(F.col(value).alias("v")).where("v is not null").orderBy(F.xxhash64("v"), "v").limit(cells)
    bounded = df.withColumn("_bounds", sample.agg(F.array_sort(F.collect_set("v"))).scalar())
    smaller = F.size(F.filter("_bounds", lambda b: b < F.col(value)))
    return bounded.withColumn(out, F.when(F.col(value).isNull(), 0).otherwise(smaller)).drop("_bounds")


def dense_code(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """Zero-based rank of distinct ``value`` within ``group`` in binary text order."""
    distinct = with_text_cell(df.select(group, value).distinct(), value, "_cell")
    return running(distinct, [group], ["_cell"], [F.col(value)], F.lit(1), out).drop("_cell")
