"""Leakage-checked text rows and their join audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from adjudica.functions.blanks import or_empty, strip
from adjudica.functions.text import normalize_text, section

PROFILES = ("fact_only", "fact_offence", "leaky_full")
DROP_REASONS = ("missing_meta", "missing_document_id", "missing_document", "text_build_error")
_MIN_BODY = 12


def build_text(profile: str = "fact_offence", metadata: bool = True) -> Column:
    """Tagged sections of a document row (session, event, document_type, fact, ...)."""
    if profile not in PROFILES:
        raise ValueError(f"unknown text profile: {profile}")
    parts = []
    if metadata:
        parts += [section("SESSION", "session"), section("EVENT", "event"), section("DOCTYPE", "document_type")]
    parts.append(section("FACT", "fact"))
    if profile != "fact_only":
        parts.append(section("OFFENCE", "offence"))
    if profile == "leaky_full":
        parts += [section("DECISION", "decision"), section("REASON", "reason")]
    return F.concat_ws("\n", *parts)


def leakage(text: Column | str, decision: Column | str, reason: Column | str) -> Column:
    """A forbidden tag, or a decision or reason body of some length, occurs in the text."""
    body = or_empty(text)
    return _leaks(body, normalize_text(body), decision, reason)


def _leaks(body: Column, flat: Column, decision: Column | str, reason: Column | str) -> Column:
    """``leakage`` of a text whose normalised form is at hand. Each field is normalised once."""
    tagged = F.upper(body).contains("[DECISION]") | F.upper(body).contains("[REASON]")
    told = F.array(normalize_text(decision), normalize_text(reason))
    return tagged | F.exists(told, lambda value: (F.length(value) >= _MIN_BODY) & F.lower(flat).contains(F.lower(value)))


def text_rows(rows: DataFrame, meta: DataFrame, docs: DataFrame, profile: str = "fact_offence",
              metadata: bool = True) -> DataFrame:
    """Driver rows with their text, or the reason they have none in ``drop_reason``.

    ``meta(incident_id, document_id, parse_confidence)``; ``docs(document_id, event,
    document_type, session, fact, offence, decision, reason)``.
    """
    side = meta.select("incident_id", "document_id", "parse_confidence", F.lit(True).alias("_meta"))
    # A text depends on its document alone: it is built there, once, and only it and its fault travel to the rows.
    built = docs.withColumn("_text", build_text(profile, metadata))
    # Sections are normalised; their joints alone are left.
    flat = F.replace("_text", F.lit("\n"), F.lit(" "))
    leaky = _leaks(F.col("_text"), flat, "decision", "reason") if profile != "leaky_full" else F.lit(False)
    body = built.select(F.col("document_id").alias("_of"), "_text", leaky.alias("_leaky"), F.lit(True).alias("_doc"))
    joined = rows.join(side, "incident_id", "left")
    # Rows without a document id match nothing; their own ids spread them.
    blank = strip(or_empty("document_id")) == ""
    key = F.when(blank, F.concat(F.lit("\u0000"), or_empty("incident_id"))).otherwise(F.col("document_id"))
    joined = joined.withColumn("_key", key).join(body, F.col("_key") == F.col("_of"), "left")
    reason = (
        F.when(F.col("_meta").isNull(), "missing_meta")
        .when(blank, "missing_document_id")
        .when(F.col("_doc").isNull(), "missing_document")
        .when(F.col("_leaky") | (strip("_text") == ""), "text_build_error"))
    return joined.withColumn("drop_reason", reason).withColumn("text", F.when(F.col("drop_reason").isNull(), F.col("_text"))).drop(
        "_meta", "_doc", "_of", "_key", "_text", "_leaky")


def audit(labelled: DataFrame, rows: DataFrame, misaligned: DataFrame) -> DataFrame:
    """Per season and in total: labelled incidents, flattened rows, losses by reason, join rate."""
    counted = rows.groupBy("season").agg(
        F.count(F.lit(1)).alias("flattened_rows"),
        F.count_if(F.col("drop_reason").isNull()).alias("rows_with_text"),
        *[F.count_if(F.col("drop_reason") == r).alias(r) for r in DROP_REASONS])
    base = labelled.groupBy("season").agg(F.count(F.lit(1)).alias("labelled_incident_rows"))
    lost = misaligned.groupBy("season").agg(F.count(F.lit(1)).alias("misaligned_skipped"))
    seasons = base.join(counted, "season", "left").join(lost, "season", "left").na.fill(0)
    names = [c for c in seasons.columns if c != "season"]
    total = seasons.rollup("season").agg(*[F.sum(c).alias(c) for c in names])
    return total.withColumn("join_rate", F.round(
        F.col("rows_with_text") / F.greatest(F.col("flattened_rows"), F.lit(1)), 4))
