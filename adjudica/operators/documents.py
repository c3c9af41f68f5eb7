"""Decision documents to incident rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from adjudica.functions import text as tx
from adjudica.functions.blanks import or_empty
from adjudica.operators.lookup import corner_sector, resolve_circuit

_DECIDING = ("decision", "offence", "infringement")


def parse_documents(raw: DataFrame) -> DataFrame:
    """``(document_id, event, season, title, raw_text)`` to typed fields and a confidence."""
    text, blank = F.col("_text"), F.lit("")
    labels = {"_driver": "No / Driver", "_fact": "Fact", "_offence": "Offence", "_decision": "Decision", "_reason": "Reason", "_session": "Session",
              "_document": "Document", "_date": "Date", "_clock": "Time", "_competitor": "Competitor"}
    kept = [F.col(f"`{c}`") for c in raw.columns]
    read = raw.withColumn("_text", tx.plain_spaces("raw_text"))
    cut = read.select(*kept, "_text", *[tx.cut_field(text, label).alias(name) for name, label in labels.items()],
                      tx.last_time_field(text).alias("_own_time"), tx.document_type("title").alias("_kind"))
    # A generator stops the optimizer from repeating the cuts in the filters and keys above it.
    lines = cut.select(*kept, F.inline(F.array(F.struct(
        *[F.col(name) for name in labels if name not in ("_offence", "_document", "_session")], "_own_time",
        tx.document_session("_session").alias("_session"),
        F.coalesce(F.nullif("_offence", blank), tx.cut_field(text, "Infringement")).alias("_offence"),
        F.coalesce(F.nullif("_document", blank), tx.cut_field(text, "No")).alias("_document"),
        F.col("_kind").alias("document_type")))))
    offence = F.col("_offence")
    car = tx.car_number("_driver")
    fields = F.struct(
        F.col("_document").alias("document_no"),
        F.col("_date").alias("date"),
        F.col("_clock").alias("time"),
        F.col("_own_time").alias("incident_time"),
        tx.grand_prix("raw_text").alias("grand_prix"),
        car.alias("car_number"),
        tx.car_driver("_driver").alias("driver_name"),
        F.col("_competitor").alias("competitor"),
        F.col("_session").alias("session"),
        F.col("_fact").alias("fact"),
        offence.alias("offence"),
        F.col("_decision").alias("decision"),
        F.col("_reason").alias("reason"),
        tx.opponent_cars("_fact", car).alias("opponent_car_numbers"),
        tx.turn_number("_fact").alias("turn_number"),
        tx.penalty_label("_decision").alias("penalty"),
        tx.penalty_points("_decision").alias("superlicense_points_added"),
        offence.alias("mentioned_article"),
        tx.driver_at_fault("_reason", "_fact").alias("driver_at_fault"),
    )
    missing = missing_fields(F.col("_session"), F.col("_fact"), F.col("_decision"), F.col("document_type"))
    parsed = lines.withColumns({"parsed_fields": fields, "parse_errors": missing})
    required = F.when(F.col("document_type") == "decision", 3).otherwise(2)
    parsed = parsed.withColumn("parse_confidence", F.round(1 - F.size("parse_errors") / required, 3))
    return parsed.drop(*[c for c in lines.columns if c.startswith("_")])


def missing_fields(session: Column, fact: Column, decision: Column, document_type: Column) -> Column:
    """Names of required fields that are empty; a decision document also needs its decision."""
    return F.array_compact(F.array(
        F.when(or_empty(session) == "", "session"),
        F.when(or_empty(fact) == "", "fact"),
        F.when((document_type == "decision") & (or_empty(decision) == ""), "decision")))


def is_eligible(document_type: Column, fact: Column, decision: Column) -> Column:
    """Deciding documents with a fact or decision; summons only while undecided."""
    has_fact, has_decision = or_empty(fact) != "", or_empty(decision) != ""
    return ((document_type == "summons") & ~has_decision) | (
        document_type.isin(*_DECIDING) & (has_fact | has_decision))


def document_rank(title: Column | str, document_type: Column) -> Column:
    correction = F.lower(or_empty(title)).contains("correction")
    kind = (F.when(document_type == "decision", 0).when(document_type.isin("offence", "infringement"), 1)
            .when(document_type == "summons", 2).otherwise(3))
    return F.struct(F.when(correction, 0).otherwise(1).alias("c"), kind.alias("k"))


def primary_documents(docs: DataFrame, seq: str = "seq", include_event: bool = False,
                      by_season: bool = True) -> DataFrame:
    """One document per (season, car, session, fact): corrections, then decisions, then input order.

    Rank and ``seq`` make one number, so a hash aggregate finds the best of a group with one number per task, and the
    rows are fetched by it. ``seq`` is unique and from 0 to 2^60 - 1.
    """
    f = F.col("parsed_fields")
    keys = {"_car": or_empty(f["car_number"]), "_session": or_empty(f["session"]),
            "_fact": tx.normalize_fact(f["fact"])}
    if by_season:
        keys["_season"] = F.col("season")
    if include_event:
        keys["_event"] = or_empty("event")
    good = docs.where(is_eligible(F.col("document_type"), f["fact"], f["decision"]))
    rank = document_rank("title", F.col("document_type"))
    packed = (rank["c"] * 4 + rank["k"]).cast("long") * (1 << 60) + F.col(seq).cast("long")
    best = good.groupBy(*[c.alias(n) for n, c in keys.items()]).agg((F.min(packed) % (1 << 60)).alias("_best"))
    return docs.join(best.select("_best"), F.col(seq).cast("long") == F.col("_best"), "left_semi")


def incident_rows(docs: DataFrame, circuits: DataFrame, include_event: bool = False) -> DataFrame:
    """Primary documents to incident rows, meta columns included."""
    f = F.col("parsed_fields")
    rows = docs.select(
        "document_id", "event", "season", "title", "document_type", "parse_confidence",
        *[f[c].alias(c) for c in (
            "session", "fact", "offence", "car_number", "driver_name", "competitor", "turn_number",
            "opponent_car_numbers", "driver_at_fault", "penalty", "superlicense_points_added",
            "mentioned_article", "time", "date")])
    rows = resolve_circuit(rows, circuits)
    facts = circuits.select("circuit", F.col("country").alias("country"),
                            F.col("first_season").cast("string").alias("first_season"))
    rows = corner_sector(rows.join(facts, "circuit", "left"), circuits)
    kind = tx.incident_type("fact", "offence")
    opponents = F.transform("opponent_car_numbers", lambda n: F.concat(F.lit("car_"), n))
    drivers = F.filter(F.concat(F.array(tx.slug("driver_name")), opponents), lambda d: d != "")
    team = F.replace(F.lower(or_empty("competitor")), F.lit(" "), F.lit("_"))
    decided = F.col("document_type").isin(*_DECIDING, "summons")
    basis = F.when(F.col("fact") != "", F.col("fact")).otherwise(F.col("document_id"))
    return rows.select(
        tx.incident_id("season", "session", "car_number", basis,
                       F.col("event") if include_event else None).alias("incident_id"),
        "circuit", F.coalesce("country", F.lit("")).alias("country"),
        F.coalesce("first_season", F.lit("")).alias("first_season"),
        F.col("season").cast("string").alias("season"), "session",
        kind.alias("incident_type"), kind.alias("incident_classification"), "sector",
        F.size(drivers).cast("string").alias("num_drivers"), F.array_join(drivers, ",").alias("drivers"),
        team.alias("respective_teams"), F.when(decided, "TRUE").otherwise("FALSE").alias("investigation"),
        "driver_at_fault", "penalty", "superlicense_points_added", "mentioned_article",
        "document_id", "parse_confidence", "event", "car_number", "time", "date")
