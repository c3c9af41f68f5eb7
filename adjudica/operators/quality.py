"""Fill rates, duplicates, review reasons and quality gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from adjudica.constants import (
    FAULT_MIN_CONFIDENCE, INCIDENT_COLUMNS, MIN_PARSE_CONFIDENCE, QUALITY_GATES, SECTOR_TARGETS,
)
from adjudica.functions.blanks import is_blank, or_empty, strip
from adjudica.functions.multi import split_drop
from adjudica.functions.scoring import valid_completion, valid_lap_remaining


def conform(df: DataFrame, columns: Sequence[str] = INCIDENT_COLUMNS) -> DataFrame:
    """Project to a fixed column list; absent columns are blank."""
    return df.select(*[
        F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c in df.columns
        else F.lit("").alias(c) for c in columns])


def missing_columns(df: DataFrame, columns: Sequence[str] = INCIDENT_COLUMNS) -> list[str]:
    return [c for c in columns if c not in df.columns]


def fill_rate(column: Column | str, mask: Column | None = None) -> Column:
    """Aggregate: share of filled cells, over the masked rows only; 0 without rows."""
    filled = F.when(is_blank(column), 0.0).otherwise(1.0)
    chosen = filled if mask is None else F.when(mask, filled)
    return F.round(F.coalesce(F.avg(chosen), F.lit(0.0)), 4)


def fill_rates(df: DataFrame, columns: Sequence[str] = INCIDENT_COLUMNS) -> DataFrame:
    """(column, fill_rate) for every column in one pass; absent columns are 0."""
    present = [c for c in columns if c in df.columns]
    row = df.agg(*[fill_rate(F.col(f"`{c}`")).alias(c) for c in present])
    entries = F.array(*[F.struct(
        F.lit(c).alias("column"),
        (F.col(f"`{c}`") if c in present else F.lit(0.0)).alias("fill_rate")) for c in columns])
    return row.select(F.explode(entries).alias("e")).select("e.*")


def missing_rates(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Share of NULL or empty cells per column; one aggregate row reaches the driver."""
    row = df.agg(*[
        F.coalesce(F.avg(F.when(strip(or_empty(F.col(f"`{c}`"))) == "", 1.0).otherwise(0.0)), F.lit(0.0))
        .alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(columns)}


def duplicates(df: DataFrame, key: str = "incident_id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def derive_export_fields(df: DataFrame) -> DataFrame:
    """Driver count, laps remaining and completion where they can be computed."""
    n = F.size(split_drop("drivers"))
    left, done = valid_lap_remaining("lap", "full_laps"), valid_completion("lap", "full_laps")
    return df.withColumns({
        "num_drivers": F.when(n > 0, n.cast("string")).otherwise(F.col("num_drivers")),
        "lap_remaining": F.coalesce(left.cast("string"), F.col("lap_remaining")),
        "completion_percentage": F.coalesce(done.cast("string"), F.col("completion_percentage"))})


def review_reasons(min_parse: float = MIN_PARSE_CONFIDENCE,
                   min_fault: float = FAULT_MIN_CONFIDENCE) -> Column:
    """Ordered list of reasons a row needs a person to look at it."""
    empty = lambda c: strip(or_empty(c)) == ""
    fault = strip(or_empty("driver_at_fault_suggestion"))
    sure = F.coalesce(F.col("driver_at_fault_confidence").cast("double"), F.lit(0.0))
    known = F.coalesce(F.nullif(F.col("driver_at_fault_confidence").cast("double"), F.lit(0.0)), F.lit(1.0))
    severity = F.col("severity_suggestion").cast("string")
    return F.array_compact(F.array(
        F.when(F.coalesce(F.col("parse_confidence").cast("double"), F.lit(1.0)) < min_parse,
               F.lit("low_parse_confidence")),
        F.when(empty("severity"), F.when(or_empty(severity) != "",
               F.concat(F.lit("severity_suggestion:"), severity)).otherwise("missing_severity")),
        F.when(empty("driver_at_fault"), F.when((fault != "") & (sure > 0),
               F.concat(F.lit("driver_at_fault_suggestion:"), fault)).otherwise("missing_driver_at_fault"))
        .when(known < min_fault, "low_driver_at_fault_confidence"),
        F.when((F.lower(or_empty("session")) == "race") & empty("lap"), F.lit("missing_lap")),
        F.when(empty("round"), F.lit("missing_round"))))


def review_queue(incidents: DataFrame, meta: DataFrame) -> DataFrame:
    """Rows with at least one review reason, reasons joined by a bar."""
    wanted = ("parse_confidence", "severity_suggestion", "driver_at_fault_suggestion", "driver_at_fault_confidence")
    side = meta.select("incident_id", *[
        F.col(c) if c in meta.columns else F.lit(None).cast("string").alias(c) for c in wanted])
    rows = incidents.join(side, "incident_id", "left").withColumn("_r", review_reasons())
    return rows.where(F.size("_r") > 0).withColumn("review_reasons", F.array_join("_r", "|")).drop("_r", *wanted)


def gate_metrics(df: DataFrame, prior: DataFrame, provenance_rate: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The gated fill rates in one aggregate; ``prior`` lists incidents with earlier points."""
    flagged = df.join(prior.select("incident_id", F.lit(True).alias("_prior")), "incident_id", "left")
    race = F.lower(or_empty("session")) == "race"
    drivers = F.size(split_drop("drivers")) > 0
    has_prior = F.coalesce("_prior", F.lit(False))
    metrics = flagged.groupBy(*by).agg(
        fill_rate("lap", race).alias("lap_race_fill_rate"),
        fill_rate("flag", race).alias("flag_race_fill_rate"),
        fill_rate(F.col("`positions_of_involved parties`"), drivers).alias("positions_with_drivers_fill_rate"),
        fill_rate("sector").alias("sector_fill_rate"),
        fill_rate("superlicense_points_before_incident").alias("superlicense_before_fill_rate"),
        fill_rate("superlicense_points_before_incident", has_prior).alias("points_before_given_prior_rate"),
        F.count_if(has_prior).alias("rows_with_prior_points"))
    if by:
        return metrics.join(provenance_rate.withColumnRenamed("rate", "standings_provenance_rate"), list(by), "left")
    return metrics.withColumn("standings_provenance_rate", provenance_rate.select("rate").scalar())


def evaluate_gates(metrics: DataFrame, season: Column | None = None, targets: Mapping[str, float] | None = None,
                   sector_targets: Mapping[str, float] = SECTOR_TARGETS) -> DataFrame:
    """One row per gate: actual, target, passed. The prior-points gate needs such rows; some seasons have a sector target of their own."""
    targets = targets or {}
    keep = [c for c in ("season",) if c in metrics.columns]
    year = season if season is not None else F.lit(None)
    entries = []
    for gate, metric, default, strict in QUALITY_GATES:
        target = F.lit(float(targets.get(gate, default)))
        if gate == "sector":
            for text, value in sector_targets.items():
                target = F.when(year.cast("string") == text, value).otherwise(target)
        actual = F.col(metric)
        entry = F.struct(F.lit(gate).alias("gate"), actual.alias("actual"), target.alias("target"),
                         (actual > target if strict else actual >= target).alias("passed"))
        if gate == "points_before_given_prior":
            entry = F.when(F.col("rows_with_prior_points") > 0, entry)
        entries.append(entry)
    return metrics.select(*keep, F.explode(F.array_compact(F.array(*entries))).alias("g")).select(*keep, "g.*")


def timestamp_audit(meta: DataFrame) -> DataFrame:
    """Rows, share and offset share per parse method."""
    method = F.coalesce("time_parse_method", F.lit("unparsed"))
    return meta.groupBy(method.alias("method")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.avg(F.col("session_offset_seconds").isNotNull().cast("double")), 4).alias("offset_rate"))


def timestamp_totals(meta: DataFrame) -> DataFrame:
    method = F.coalesce("time_parse_method", F.lit("unparsed"))
    return meta.agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.coalesce(F.avg((method != "unparsed").cast("double")), F.lit(0.0)), 4).alias("parsed_rate"),
        F.round(F.coalesce(F.avg(F.col("session_offset_seconds").isNotNull().cast("double")), F.lit(0.0)), 4)
        .alias("offset_rate"))
