"""Temporal splits by season, never random."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F


def season_list(value: Any) -> list[int]:
    if value is None:
        return []
    if isinstance(value, (list, tuple, set, frozenset)):
        return [int(v) for v in value]
    return [int(value)]


def assignments(splits: Mapping[str, Any]) -> dict[int, str]:
    """Season -> split name; a season in two splits is an error."""
    if twice := overlap(splits):
        raise ValueError(f"seasons {sorted(twice)} appear in multiple splits")
    keys = {"train": "train_seasons", "validation": "validation_season", "test": "test_season"}
    return {season: name for name, key in keys.items() for season in season_list(splits.get(key))}


def overlap(splits: Mapping[str, Any]) -> set[int]:
    names = [set(season_list(splits.get(k))) for k in ("train_seasons", "validation_season", "test_season")]
    return (names[0] & names[1]) | (names[0] & names[2]) | (names[1] & names[2])


def split_column(assigned: Mapping[int, str]) -> Column:
    chosen = F.lit(None).cast("string")
    for season, name in assigned.items():
        chosen = F.when(F.col("season").cast("int") == season, name).otherwise(chosen)
    return chosen


def present_seasons(df: DataFrame) -> list[int]:
    """Distinct seasons; the driver receives one small row per season."""
    rows = df.select(F.col("season").cast("int").alias("s")).where("s is not null").distinct().collect()
    return sorted(r.s for r in rows)


def unassigned_seasons(df: DataFrame, assigned: Iterable[int]) -> DataFrame:
    seasons = df.select(F.col("season").cast("int").alias("season")).where("season is not null").distinct()
    return seasons.where(~F.col("season").isin(*[int(s) for s in assigned]))


def temporal_split(df: DataFrame, splits: Mapping[str, Any], strict: bool = True) -> DataFrame:
    """Add a ``split`` column. Strict splitting refuses unassigned seasons and empty parts."""
    assigned = assignments(splits)
    if strict:
        seen = present_seasons(df)
        stray = [s for s in seen if s not in assigned]
        if stray:
            raise ValueError(f"seasons not assigned to a split: {stray}")
        for name, key in (("train", "train_seasons"), ("validation", "validation_season")):
            wanted = season_list(splits.get(key))
            if (name == "train" or wanted) and not set(wanted) & set(seen):
                raise ValueError(f"{name} split is empty")
    out = df.withColumn("split", split_column(assigned))
    return out.where(F.col("split").isNotNull())
