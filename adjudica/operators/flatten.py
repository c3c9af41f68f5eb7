"""Incident rows to driver rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from adjudica.constants import (
    ALIGNMENT_EXEMPT, ALIGNMENT_GROUPS, DRIVER_FIELDS, MULTI_VALUE_COLUMNS, SHARED_COLUMNS,
)
from adjudica.functions.blanks import or_empty
from adjudica.functions.multi import count_keep, pick, split_drop, split_keep


def is_aligned(df: DataFrame) -> Column:
    """Every non-empty multi-value cell has as many values as there are drivers."""
    cells = [c for c in MULTI_VALUE_COLUMNS if c in df.columns and c != "drivers" and c not in ALIGNMENT_EXEMPT]
    # One array of cells, the drivers first: each cell is read and counted once, also where the condition is negated.
    sizes = F.transform(F.array(*[or_empty(F.col(f"`{c}`")) for c in ("drivers", *cells)]), count_keep)
    return F.get(F.transform(F.array(sizes), lambda n: F.forall(n, lambda size: (size == 0) | (size == n[0]))), F.lit(0))


def misaligned_groups(df: DataFrame) -> Column:
    """Names of the first driver columns of groups whose non-empty sizes differ."""
    bad = []
    for i, group in enumerate(ALIGNMENT_GROUPS):
        present = [c for c in group if c in df.columns]
        sizes = F.array(*[F.size(split_drop(c)) for c in present])
        bad.append(F.when(F.size(F.array_distinct(F.filter(sizes, lambda s: s > 0))) > 1, F.lit(i)))
    return F.array_compact(F.array(*bad))


def alignment_errors(df: DataFrame) -> DataFrame:
    return df.select("incident_id", misaligned_groups(df).alias("groups")).where(F.size("groups") > 0)


def flatten_incidents(df: DataFrame) -> DataFrame:
    """One row per driver under investigation; misaligned incidents are left out.

    With exactly two drivers each row also carries the other driver's fields.
    """
    shared = [F.col(f"`{c}`") for c in SHARED_COLUMNS if c in df.columns]
    sources = [c for c, _, _ in DRIVER_FIELDS if c in df.columns]
    arrays = df.where((count_keep("drivers") > 0) & is_aligned(df)).select(
        *shared, split_keep("drivers").alias("_drivers"),
        *[split_keep(c).alias(f"_{c}") for c in sources])
    rows = arrays.select("*", F.posexplode("_drivers").alias("_pos", "driver"))
    pair = F.size("_drivers") == 2
    other = F.lit(1) - F.col("_pos")
    columns = [F.concat_ws("_", F.col("incident_id"), F.col("driver")).alias("row_id"), F.col("driver")]
    columns += [pick(F.col(f"_{src}"), F.col("_pos")).alias(own) if src in sources
                else F.lit(None).cast("string").alias(own) for src, own, _ in DRIVER_FIELDS]
    columns.append(F.when(pair, F.get("_drivers", other)).alias("opponent"))
    columns += [F.when(pair, pick(F.col(f"_{src}"), other)).alias(opp) if src in sources
                else F.lit(None).cast("string").alias(opp) for src, _, opp in DRIVER_FIELDS]
    return rows.select(*shared, *columns)


def misaligned_incidents(df: DataFrame) -> DataFrame:
    """Side frame of incidents that flatten leaves out although they list drivers."""
    return df.where((count_keep("drivers") > 0) & ~is_aligned(df)).select("incident_id")
