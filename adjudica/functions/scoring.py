"""Severity, fault, feature and deviation expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from adjudica.constants import RACE_STAGE_BINS, SEVERITY_PATTERNS
from adjudica.functions.blanks import as_col, number, or_empty, strip
from adjudica.functions.text import contains_any, driver_at_fault, normalize_text


def at_least(value: Column, bound: float) -> Column:
    """Lower bound that keeps NULL (``greatest`` would skip it)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(bound)))


def at_most(value: Column, bound: float) -> Column:
    return F.when(value.isNotNull(), F.least(value, F.lit(bound)))


def years_in_sport(season: Column | str, debut: Column | str) -> Column:
    return at_least(as_col(season).cast("int") - as_col(debut).try_cast("int"), 0)


def first_named_driver(drivers: Column) -> Column:
    """First driver that is not a ``car_N`` placeholder."""
    return F.get(F.filter(drivers, lambda d: ~d.startswith("car_")), F.lit(0))


def infer_fault(fact: Column | str, reason: Column | str, decision: Column | str,
                drivers: Column) -> Column:
    """Struct (value, confidence) for the party at fault."""
    text = F.lower(normalize_text(F.concat_ws(" ", or_empty(fact), or_empty(reason), or_empty(decision))))
    parsed = driver_at_fault(reason, fact)
    # Phrases that clear every driver, and phrases that blame one.
    clear = contains_any(text, [
        "no driver was wholly or predominantly to blame", "no driver predominantly to blame",
        "racing incident", "no further action"])
    blamed = contains_any(text, ["wholly to blame", "predominantly to blame"])
    fault = contains_any(text, [
        "wholly to blame", "predominantly to blame", "caused a collision",
        "caused the collision", "wholly responsible", "predominantly responsible"])
    car = F.regexp_extract(text, r"\bcar\s+(\d+)\b", 1)
    named = first_named_driver(drivers)

    def result(value: Column, confidence: float) -> Column:
        return F.struct(value.alias("value"), F.lit(confidence).cast("double").alias("confidence"))

    return (
        F.when(text == "", result(F.lit(""), 0.0))
        .when(parsed == "none", result(F.lit("none"), 0.88))
        .when(parsed.startswith("car_"), result(parsed, 0.9))
        .when(clear & ~blamed, result(F.lit("none"), 0.72))
        .when(fault & (car != ""), result(F.concat(F.lit("car_"), car), 0.86))
        .when(fault & (F.coalesce(named, F.lit("")) != ""), result(named, 0.78))
        .when(fault, result(F.lit("unknown"), 0.65))
        .otherwise(result(F.lit(""), 0.0))
    )


def suggest_severity(fact: Column | str, reason: Column | str, decision: Column | str,
                     penalty: Column | str) -> Column:
    """Struct (value 1-5, confidence)."""
    text = F.lower(normalize_text(F.concat_ws(" ", or_empty(fact), or_empty(reason), or_empty(decision))))
    label = strip(F.lower(or_empty(penalty)))
    # Fixed values: (test, base, confidence), first hit wins.
    cases = (
        (contains_any(label, ["disqualification", "disqualified"]), 5, 0.82),
        (label.contains("drive_through") | label.rlike(r"\d+s_time_penalty"), 4, 0.8),
        (label.contains("grid") & label.contains("place"), 3, 0.78),
        (label.contains("reprimand"), 2, 0.76),
        (label.contains("warning"), 2, 0.74),
        (label.isin("", "no_further_action"), 1, 0.7),
    )
    base, sure = F.lit(3), F.lit(0.55)
    for test, value, confidence in reversed(cases):
        base = F.when(test, value).otherwise(base)
        sure = F.when(test, confidence).otherwise(sure)
    risky = contains_any(text, ["dangerous", "reckless", "unsafe", "high speed"])
    base = F.when(risky, F.least(F.lit(5), base + 1)).otherwise(base)
    sure = F.when(risky, F.least(F.lit(0.9), sure + 0.05)).otherwise(sure)
    base = F.when(text.contains("minor"), F.greatest(F.lit(1), base - 1)).otherwise(base)
    return F.struct(base.cast("int").alias("value"), F.round(sure, 3).alias("confidence"))


def penalty_severity(penalty: Column | str,
                     patterns: Mapping[int, Sequence[str]] = SEVERITY_PATTERNS,
                     whole_words: bool = False) -> Column:
    """Class 2, 1 or 0 by substring, in that order; ``whole_words`` stops "15s" matching "5s"."""
    text = F.translate(F.lower(strip(or_empty(penalty))), "_", " ")
    label = F.lit(None).cast("int")
    for value in sorted(patterns):
        if whole_words:
            alternatives = "|".join(rf"\Q{p.lower()}\E" for p in patterns[value])
            hit = text.rlike(rf"(?<![a-z0-9])(?:{alternatives})(?![a-z0-9])")
        else:
            hit = contains_any(text, [p.lower() for p in patterns[value]])
        label = F.when(hit, value).otherwise(label)
    return F.when(text != "", label).cast("int")


def lap_remaining(lap: Column | str, full: Column | str) -> Column:
    return number(full) - number(lap)


def completion(lap: Column | str, full: Column | str) -> Column:
    return F.try_divide(number(lap), F.nullif(number(full), F.lit(0.0))) * 100


def valid_lap_remaining(lap: Column | str, full: Column | str) -> Column:
    """Whole laps left, never negative; used when exporting."""
    return at_least(number(full).cast("int") - number(lap).cast("int"), 0)


def valid_completion(lap: Column | str, full: Column | str) -> Column:
    full_laps = F.nullif(number(full).cast("int"), F.lit(0))
    return F.round(F.try_divide(number(lap).cast("int"), full_laps) * 100, 6)


def same_team(left: Column | str, right: Column | str) -> Column:
    return F.coalesce(as_col(left) == as_col(right), F.lit(False))


def race_stage(completion_pct: Column | str, bins: Sequence[float] = RACE_STAGE_BINS) -> Column:
    early, middle, late = bins
    value = number(completion_pct)
    return F.when(value.isNotNull(), (
        F.when(value <= early, "early").when(value <= middle, "middle")
        .when(value <= late, "late").otherwise("final_laps")
    ))


def round_progress(round_: Column | str, rounds: Column | str) -> Column:
    ratio = F.try_divide(number(round_), F.nullif(number(rounds), F.lit(0.0)))
    return at_most(at_least(ratio, 0.0), 1.0)


def is_last_round(round_: Column | str, rounds: Column | str) -> Column:
    return F.coalesce(number(round_) == number(rounds), F.lit(False))


def points_remaining(round_: Column | str, rounds: Column | str, per_race: float) -> Column:
    return at_least(number(rounds) - number(round_), 0.0) * float(per_race)


def similarity_value(value: Column | str) -> Column:
    text = F.lower(strip(or_empty(value)))
    return F.when(text != "", text).otherwise("__missing__")


def clamp_severity(value: Column | str) -> Column:
    return F.least(F.greatest(F.coalesce(number(value), F.lit(0.0)).cast("int"), F.lit(0)), F.lit(2))


def is_warning(penalty: Column | str, severity: Column | str) -> Column:
    text = F.lower(or_empty(penalty))
    minor = F.coalesce(number(severity), F.lit(0.0)) == 1.0
    return contains_any(text, ["warning", "reprimand"]) | (minor & ~text.contains("no_further"))


def label_or_zero(value: Column | str) -> Column:
    return F.coalesce(number(value), F.lit(0.0)).cast("int")


def license_points(value: Column | str) -> Column:
    return F.coalesce(number(value).cast("int"), F.lit(0))


def class_rate(count: Column, total: Column) -> Column:
    return F.try_divide(count.cast("double"), F.nullif(total.cast("double"), F.lit(0.0)))
