"""Actual against rule and model outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from adjudica.functions.scoring import label_or_zero
from adjudica.operators.metrics import kappa

DIMENSIONS = ("incident_type", "session", "circuit", "season")


def add_deviation(df: DataFrame, actual: str = "penalty_severity",
                  ruled: str = "normative_penalty_severity") -> DataFrame:
    """Agreement flag, signed direction (rule minus actual) and magnitude."""
    a, r = label_or_zero(actual), label_or_zero(ruled)
    return df.withColumns({
        "_actual": a, "_ruled": r, "agreement": a == r,
        "deviation_direction": r - a, "deviation_magnitude": F.abs(r - a)})


def _rate(test: Column) -> Column:
    return F.avg(F.coalesce(test, F.lit(False)).cast("double"))


def _rates(df: DataFrame) -> list[Column]:
    manual = F.col("normative_penalty_detail") == "manual_review" \
        if "normative_penalty_detail" in df.columns else F.lit(False)
    return [
        F.count(F.lit(1)).alias("n"),
        _rate(F.col("agreement")).alias("agreement_rate"),
        (1 - _rate(F.col("agreement"))).alias("disagreement_rate"),
        F.avg("deviation_direction").alias("mean_deviation_direction"),
        F.avg("deviation_magnitude").alias("mean_deviation_magnitude"),
        _rate(F.col("deviation_direction") < 0).alias("actual_harsher_rate"),
        _rate(F.col("deviation_direction") > 0).alias("rule_harsher_rate"),
        _rate(manual).alias("manual_review_rate"),
    ]


def breakdowns(deviations: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Every breakdown in one grouping-sets pass; NULL keys stay a group of their own."""
    present = [d for d in dimensions if d in deviations.columns]
    rows = deviations.withColumns({d: F.col(d).cast("string") for d in present})
    grouped = rows.groupingSets([[F.col(d)] for d in present], *[F.col(d) for d in present]).agg(
        *[F.grouping(d).alias(f"_off_{d}") for d in present], *_rates(rows))
    on = {d: F.col(f"_off_{d}") == 0 for d in present}
    rates = [c for c in grouped.columns if c not in present and not c.startswith("_off_")]
    return grouped.select(F.coalesce(*[F.when(on[d], d) for d in present]).alias("dimension"),
                          F.coalesce(*[F.when(on[d], F.col(d)) for d in present]).alias("key"), *rates)


def overall(deviations: DataFrame) -> DataFrame:
    """One row of agreement metrics, with and without rows sent to manual review."""
    judged = F.col("normative_penalty_detail") != "manual_review" \
        if "normative_penalty_detail" in deviations.columns else F.lit(True)
    return deviations.agg(
        *_rates(deviations),
        kappa("_actual", "_ruled").alias("cohens_kappa"),
        F.count_if(judged).alias("matched_row_count"),
        F.avg(F.when(judged, F.col("agreement").cast("double"))).alias("agreement_rate_excl_manual_review"),
        kappa("_actual", "_ruled", where=judged).alias("cohens_kappa_excl_manual_review"),
    ).withColumnRenamed("n", "row_count")


def top_deviations(deviations: DataFrame, limit: int = 15, tie: str = "row_id") -> DataFrame:
    """Largest disagreements; a top-k sort, ties in season, round and row order."""
    return deviations.where(~F.col("agreement")).orderBy(
        F.col("deviation_magnitude").desc(), F.col("season").asc_nulls_last(),
        F.col("round").asc_nulls_last(), F.col(tie)).limit(limit)


def prediction_column(df: DataFrame) -> str | None:
    # Accepted names of a prediction column, in order.
    names = ("pred_xgboost", "pred", "prediction", "penalty_severity_pred")
    return next((n for n in names if n in df.columns), None)


def three_way(deviations: DataFrame, predictions: DataFrame) -> DataFrame:
    """Agreement of actual, rule and model labels on the rows all three cover."""
    column = prediction_column(predictions)
    if column is None:
        raise ValueError("no prediction column")
    key = "row_id" if "row_id" in predictions.columns else "incident_id"
    rows = deviations.join(predictions.select(key, label_or_zero(column).alias("_model")), key, "inner")
    same = lambda a, b: F.avg((F.col(a) == F.col(b)).cast("double"))
    return rows.agg(
        F.count(F.lit(1)).alias("overlap_rows"),
        same("_actual", "_model").alias("agreement_actual_model"),
        same("_ruled", "_model").alias("agreement_rule_model"),
        same("_actual", "_ruled").alias("agreement_actual_rule"),
        kappa("_actual", "_model").alias("kappa_actual_model"),
        kappa("_ruled", "_model").alias("kappa_rule_model"))
