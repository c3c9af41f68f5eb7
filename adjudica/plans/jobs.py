"""Dataset, feature, text and rule jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, functions as F

from adjudica.functions.scoring import penalty_severity
from adjudica.operators import compare, features, flatten, prior, quality, rules, textset
from adjudica.operators.documents import incident_rows, parse_documents, primary_documents
from adjudica.operators.encode import Encoder, fit_encoder
from adjudica.operators.splits import temporal_split
from adjudica.rulesets import DEFAULT_RULES
from adjudica.session import cut_lineage


def build_incidents(raw: DataFrame, circuits: DataFrame, seq: str = "seq", include_event: bool = False) -> DataFrame:
    """Raw document texts to incident rows: parse, pick primaries, map."""
    # The parsed documents are read twice: to choose, and to take what was chosen.
    parsed = cut_lineage(parse_documents(raw).drop("raw_text"))
    return incident_rows(primary_documents(parsed, seq, include_event), circuits, include_event)


@dataclass
class Export:
    processed: DataFrame
    review: DataFrame
    fill_rates: DataFrame
    duplicates: DataFrame
    misaligned: DataFrame


def validate_export(incidents: DataFrame, meta: DataFrame) -> Export:
    """Derived fields, checks, review queue and fill rates of one processed table."""
    derived = quality.derive_export_fields(incidents)
    processed = quality.conform(derived)
    return Export(processed, quality.review_queue(processed, meta), quality.fill_rates(processed),
                  quality.duplicates(processed), flatten.alignment_errors(processed))


def quality_report(processed: DataFrame, prior_points: DataFrame, rate: DataFrame,
                   meta: DataFrame, review: DataFrame) -> DataFrame:
    """Gates joined to the row counts, fill rate and timestamp figures of the data-quality record."""
    gates = quality.evaluate_gates(quality.gate_metrics(processed, prior_points, rate))
    counts = processed.agg(F.count(F.lit(1)))
    queued = review.agg(F.count(F.lit(1)))
    stamps = quality.timestamp_totals(meta).select(F.struct("parsed_rate", "offset_rate"))
    totals = gates.agg(F.struct(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total")))
    report = gates.withColumns({"row_count": counts.scalar(), "review_count": queued.scalar(),
                                "_s": stamps.scalar(), "_t": totals.scalar()})
    return report.select("gate", "actual", "target", "passed", "row_count", "review_count", "_s.parsed_rate",
                         "_s.offset_rate", F.col("_t.passed").alias("gates_passed"), F.col("_t.total").alias("gates_total"))


def labelled_rows(processed: DataFrame) -> DataFrame:
    """Rows with a mapped severity class, at driver grain with relational features."""
    labelled = processed.withColumn("penalty_severity", penalty_severity("penalty"))
    trainable = labelled.where(F.col("penalty_severity").isNotNull())
    return features.relational_features(flatten.flatten_incidents(trainable))


def engineered(rows: DataFrame) -> DataFrame:
    """Race, championship, history and precedent features on driver rows."""
    out = features.race_features(features.relational_features(rows))
    out = features.championship_features(out)
    return prior.precedent_features(prior.history_features(out))


def encoded(rows: DataFrame, splits: Mapping[str, Any], columns: Sequence[str] | None = None) -> tuple[DataFrame, Encoder]:
    """Split by season, fit the encoder on the training part, encode every part.

    The statistics need several passes, so the engineered rows are written once.
    """
    parts = cut_lineage(temporal_split(rows, splits))
    chosen = list(columns) if columns is not None else features.feature_columns(parts)
    encoder = fit_encoder(parts.where("split = 'train'"), chosen)
    return encoder.transform(parts), encoder


def prepare(processed: DataFrame, splits: Mapping[str, Any]) -> tuple[DataFrame, Encoder]:
    return encoded(labelled_rows(processed), splits)


def text_dataset(processed: DataFrame, meta: DataFrame, docs: DataFrame, splits: Mapping[str, Any],
                 profile: str = "fact_offence") -> tuple[DataFrame, DataFrame]:
    """Labelled driver rows with leakage-checked text and a split, plus the join audit."""
    labelled = processed.withColumn("penalty_severity", penalty_severity("penalty")).where("penalty_severity is not null")
    rows = flatten.flatten_incidents(labelled)
    lost = labelled.join(flatten.misaligned_incidents(labelled), "incident_id", "left_semi")
    built = textset.text_rows(rows, meta, docs, profile)
    kept = built.where("drop_reason is null").select(
        "row_id", "incident_id", "season", "round", "session", "driver", "penalty", "penalty_severity",
        "document_id", "parse_confidence", "text")
    return temporal_split(kept, splits, strict=False), textset.audit(labelled, built, lost)


def compare_outcomes(rows: DataFrame, facts: DataFrame | None = None, ruleset=DEFAULT_RULES) -> dict[str, DataFrame]:
    """Predict when the outcome columns are absent, then every comparison table."""
    if "normative_penalty_severity" not in rows.columns:
        rows = rules.predict(rows, facts, ruleset)
    deviations = compare.add_deviation(rows)
    return {"rows": deviations, "overall": compare.overall(deviations), "breakdowns": compare.breakdowns(deviations),
            "top_deviations": compare.top_deviations(deviations)}
