"""Strictly-prior history at round grain.

Rows are first aggregated to one row per (entity, season, round). Windows run over that grain,
so rows of the same round never see each other and a hot entity costs one row per round. The
result is joined back to the rows on (entity, season, round), where the runtime may split a
skewed key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from adjudica.constants import HISTORY_WINDOWS, MIN_PRECEDENTS
from adjudica.functions.blanks import number, token
from adjudica.functions.scoring import clamp_severity, class_rate, is_warning, similarity_value

_COUNT = "_rows"


def round_counts(df: DataFrame, entity: Sequence[str], counters: Mapping[str, Column],
                 period: Sequence[str] = ("season", "round")) -> DataFrame:
    """One row per entity and round with a conditional count per counter."""
    known = df.where(F.col(period[0]).isNotNull() & F.col(period[1]).isNotNull())
    return known.groupBy(*entity, *period).agg(
        F.count(F.lit(1)).alias(_COUNT),
        *[F.count_if(cond).alias(f"_{name}") for name, cond in counters.items()])


def attach(df: DataFrame, grain: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(grain, list(keys), "left")


def _prior(entity: Sequence[str], period: Sequence[str], start: int = Window.unboundedPreceding):
    return Window.partitionBy(*entity).orderBy(*period).rowsBetween(start, -1)


def history_features(df: DataFrame, entity: str = "driver", severity: str = "penalty_severity",
                     windows: Sequence[int] = HISTORY_WINDOWS,
                     period: Sequence[str] = ("season", "round")) -> DataFrame:
    """Career counters, rates per 100 prior rounds, last-N-round counters, rounds since."""
    level = F.coalesce(number(severity), F.lit(0.0))
    grain = round_counts(df, [entity], {"pen": level > 0, "major": level == 2}, period)
    season, round_ = period
    before = _prior([entity], period)

    def total(name: str, frame) -> Column:
        return F.coalesce(F.sum(name).over(frame), F.lit(0)).cast("double")

    incidents, penalties = total(_COUNT, before), total("_pen", before)
    rounds = F.count(F.lit(1)).over(before)
    here = F.struct(F.col(season).alias("s"), F.col(round_).alias("r"))
    last_round = F.last(here).over(before)
    last_penalty = F.last(F.when(F.col("_pen") > 0, here), ignorenulls=True).over(before)

    def since(last: Column) -> Column:
        return F.when(last["s"] == F.col(season), (F.col(round_) - last["r"] - 1).cast("double"))

    columns = {
        "career_incidents": incidents,
        "career_penalties": penalties,
        "career_major_penalties": total("_major", before),
        "career_incidents_per_100_races": F.when(rounds > 0, incidents / rounds * 100),
        "career_penalties_per_100_races": F.when(rounds > 0, penalties / rounds * 100),
    }
    for n in windows:
        recent = _prior([entity], period, -n)
        columns[f"incidents_last_{n}_races"] = total(_COUNT, recent)
        columns[f"penalties_last_{n}_races"] = total("_pen", recent)
    columns["races_since_last_penalty"] = since(last_penalty)
    columns["races_since_last_incident"] = since(last_round)
    grain = grain.select(entity, *period, *[c.alias(n) for n, c in columns.items()])
    return attach(df.drop(*columns), grain, [entity, *period])


def escalation_counters(df: DataFrame, mode: str = "actual", entity: str = "driver",
                        period: Sequence[str] = ("season", "round")) -> DataFrame:
    """Counters the rules read: recent track limits, collisions, penalties, warnings.

    ``mode="actual"`` counts actual outcomes, ``mode="rules"`` the rule outcomes of a
    previous pass.
    """
    if mode not in ("actual", "rules"):
        raise ValueError(f"unsupported escalation mode: {mode}")
    by_rules = mode == "rules"
    severity = "normative_penalty_severity" if by_rules and "normative_penalty_severity" in df.columns \
        else "penalty_severity"
    level = F.coalesce(number(severity), F.lit(0.0)) if severity in df.columns else F.lit(0.0)
    if by_rules and "normative_penalty_detail" in df.columns:
        warned = token("normative_penalty_detail").isin("warning", "reprimand")
    else:
        warned = is_warning("penalty" if "penalty" in df.columns else F.lit(None), level)
    kind = token("incident_type") if "incident_type" in df.columns else F.lit("")
    # Counter -> (condition, rounds looked back).
    counters = {
        "driver_track_limits_last_5_races": (kind == "track_limits", 5),
        "driver_collisions_last_5_races": (kind == "collision", 5),
        "driver_penalties_last_5_races": (level > 0, 5),
        "driver_warnings_last_10_races": (warned, 10),
    }
    grain = round_counts(df, [entity], {n: c for n, (c, _) in counters.items()}, period)
    grain = grain.select(entity, *period, *[
        F.coalesce(F.sum(f"_{n}").over(_prior([entity], period, -back)), F.lit(0)).cast("double").alias(n)
        for n, (_, back) in counters.items()])
    return attach(df.drop(*counters), grain, [entity, *period])


def precedent_features(df: DataFrame, similarity: Sequence[str] = ("incident_type", "session"),
                       severity: str = "penalty_severity", min_count: int = MIN_PRECEDENTS,
                       period: Sequence[str] = ("season", "round")) -> DataFrame:
    """Count and class rates of earlier incidents with the same similarity key.

    Below ``min_count`` the rates are those of all earlier incidents; the count stays the
    group's own. The all-incident prefix runs over one row per round.
    """
    keys = [f"_key{i}" for i in range(len(similarity))]
    keyed = df.withColumns({k: similarity_value(c) for k, c in zip(keys, similarity)})
    level = clamp_severity(severity)
    grain = round_counts(keyed, keys, {f"c{v}": level == v for v in (0, 1, 2)}, period)
    parts = [_COUNT, "_c0", "_c1", "_c2"]
    overall = grain.groupBy(*period).agg(*[F.sum(p).alias(f"_all{p}") for p in parts])
    calendar = Window.orderBy(*period).rowsBetween(Window.unboundedPreceding, -1)
    overall = overall.select(*period, *[F.sum(f"_all{p}").over(calendar).alias(f"_all{p}") for p in parts])
    own = _prior(keys, period)
    grain = grain.select(*keys, *period, *[
        F.coalesce(F.sum(p).over(own), F.lit(0)).alias(p) for p in parts])
    grain = grain.join(overall, list(period), "left")
    enough = F.col(_COUNT) >= min_count
    names = ("precedent_no_penalty_rate", "precedent_minor_penalty_rate", "precedent_major_penalty_rate")
    grain = grain.select(
        *keys, *period, F.col(_COUNT).cast("double").alias("precedent_count"),
        *[F.when(enough, class_rate(F.col(f"_c{v}"), F.col(_COUNT)))
          .otherwise(class_rate(F.col(f"_all_c{v}"), F.col(f"_all{_COUNT}"))).alias(name)
          for v, name in enumerate(names)])
    keyed = keyed.drop("precedent_count", *names)
    return attach(keyed, grain, [*keys, *period]).drop(*keys)
