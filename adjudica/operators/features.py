"""Row-level and championship features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from adjudica.constants import (
    BOOLEAN_V1, BOOLEAN_V2, CATEGORICAL_V1, CATEGORICAL_V2,
    CONTENDER_MAX_GAP, CONTENDER_MAX_STANDING, FEATURE_GROUPS, LEAKAGE_COLUMNS, NUMERIC_V1,
    NUMERIC_V2, OPTIONAL_COLUMNS, OPTIONAL_MISSING_RATE, POINTS_PER_RACE, REDUNDANT_COLUMNS,
)
from adjudica.functions.blanks import number
from adjudica.functions.scoring import (
    completion, is_last_round, lap_remaining, points_remaining, race_stage, round_progress, same_team,
)
from adjudica.operators.quality import missing_rates


def _or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def relational_features(df: DataFrame) -> DataFrame:
    """Lap progress where missing, driver count, same team, standing and points gaps."""
    columns = {
        "lap_remaining": F.coalesce(number(_or_null(df, "lap_remaining")),
                                    lap_remaining(_or_null(df, "lap"), _or_null(df, "full_laps"))),
        "completion_percentage": F.coalesce(number(_or_null(df, "completion_percentage")),
                                            completion(_or_null(df, "lap"), _or_null(df, "full_laps"))),
        "same_team": same_team("driver_team", "opponent_team"),
        "standing_difference": number(_or_null(df, "driver_standing")) - number(_or_null(df, "opponent_standing")),
        "points_difference": number(_or_null(df, "driver_points")) - number(_or_null(df, "opponent_points")),
    }
    if "num_drivers" in df.columns:
        columns["num_drivers"] = number("num_drivers")
        out = df.withColumns(columns)
    else:
        out = group_size(df.withColumns(columns), "incident_id", "driver", "num_drivers")
    redundant = sorted(set(REDUNDANT_COLUMNS) & set(out.columns))
    if redundant:
        raise ValueError(f"redundant derived columns: {redundant}")
    return out


def group_size(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Group count on every row: aggregate first, then join, so no group sits in one task."""
    counts = df.groupBy(key).agg(F.count(value).alias(out))
    return df.join(counts, key, "left")


def race_features(df: DataFrame) -> DataFrame:
    rounds = _or_null(df, "rounds")
    return df.withColumns({
        "race_stage": race_stage(_or_null(df, "completion_percentage")),
        "round_progress": round_progress("round", rounds),
        "is_first_round": F.coalesce(number("round") == 1, F.lit(False)),
        "is_last_round": is_last_round("round", rounds)})


def leader_points(df: DataFrame) -> DataFrame:
    """Points of the best-placed row per (season, round); equal standings take more points."""
    standing, points = number("driver_standing"), number("driver_points")
    valid = df.where(standing.isNotNull() & points.isNotNull())
    return valid.groupBy("season", "round").agg(
        F.min_by(points, F.struct(standing.alias("s"), (-points).alias("p"))).alias("leader_points"))


def championship_features(df: DataFrame, max_standing: int = CONTENDER_MAX_STANDING,
                          max_gap: float = CONTENDER_MAX_GAP, per_race: float = POINTS_PER_RACE) -> DataFrame:
    joined = df.join(leader_points(df), ["season", "round"], "left")
    own, other = number("driver_points"), number(_or_null(df, "opponent_points"))
    gap = F.col("leader_points") - own
    opponent = F.col("opponent").isNotNull() if "opponent" in df.columns else F.lit(False)
    near = (number("driver_standing") <= max_standing) & (gap < max_gap)
    return joined.withColumns({
        "points_gap_to_leader": gap,
        "points_gap_to_opponent": F.when(opponent, F.abs(own - other)),
        "title_contender": F.coalesce(near, F.lit(False)),
        "construct_title_contender": F.coalesce(
            number(_or_null(df, "driver_construct_standing")) <= max_standing, F.lit(False)),
        "points_available_remaining": points_remaining("round", _or_null(df, "rounds"), per_race),
    }).drop("leader_points")


def feature_columns(df: DataFrame, extra_forbidden: Sequence[str] = (),
                    drop_sparse: bool = True) -> list[str]:
    """Model inputs present in ``df``, in a fixed order, minus forbidden and sparse columns."""
    forbidden = set(LEAKAGE_COLUMNS) | set(REDUNDANT_COLUMNS) | set(extra_forbidden)
    optional = [c for c in OPTIONAL_COLUMNS if c in df.columns]
    if optional and drop_sparse:
        rates = missing_rates(df, optional)
        forbidden |= {c for c in optional if rates[c] > OPTIONAL_MISSING_RATE}
    order = CATEGORICAL_V1 + CATEGORICAL_V2 + BOOLEAN_V1 + BOOLEAN_V2 + NUMERIC_V1 + NUMERIC_V2
    return [c for c in order if c in df.columns and c not in forbidden]


def group_columns(df: DataFrame, groups: Sequence[str]) -> list[str]:
    """Base features plus those of the chosen feature groups."""
    engineered = {c for g in FEATURE_GROUPS.values() for c in g}
    chosen = {c for g in groups for c in FEATURE_GROUPS[g]}
    columns = feature_columns(df)
    return [c for c in columns if c not in engineered] + [c for c in columns if c in chosen]


def assert_no_leakage(columns: Sequence[str]) -> None:
    leaked = sorted(set(columns) & set(LEAKAGE_COLUMNS))
    if leaked:
        raise ValueError(f"leakage columns among the features: {leaked}")

