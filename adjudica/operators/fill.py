"""Gap filling with per-field provenance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from adjudica.functions.blanks import is_blank, or_empty

RECORDS = "array<struct<field:string,source:string,stage:int,details:map<string,string>>>"


def fill_gap(old: Column, new: Column, always: bool = False, keep_blank: bool = True) -> Column:
    """``new`` where ``old`` is blank, or everywhere with ``always``.

    A blank ``new`` never replaces a value unless ``keep_blank`` is off.
    """
    useful = ~is_blank(new) if keep_blank else F.lit(True)
    write = useful if always else useful & is_blank(old)
    return F.when(write, new.cast("string")).otherwise(old.cast("string"))


def fill_columns(df: DataFrame, updates: Mapping[str, Column], always: Sequence[str] = ()) -> DataFrame:
    return df.withColumns({
        name: fill_gap(F.col(f"`{name}`"), value, name in always) for name, value in updates.items()})


def first_filled(*sources: Column) -> Column:
    """First non-blank of several sources in priority order."""
    return F.coalesce(*[F.when(~is_blank(s), s) for s in sources])


def records(source: str, stage: int, fields: Mapping[str, tuple[Column, Mapping[str, Column]]]) -> Column:
    """What a stage writes, as an array that travels with its row: ``fields`` maps a name to (when, details).

    Empty details are left out, and so are fields whose condition does not hold.
    """
    entries = [F.when(when, F.struct(
        F.lit(name).alias("field"), F.lit(source).alias("source"), F.lit(stage).alias("stage"),
        F.map_from_entries(F.array_compact(F.array(*[
            F.when(or_empty(value) != "", F.struct(F.lit(key).alias("key"), value.cast("string").alias("value")))
            for key, value in details.items()])).cast("array<struct<key:string,value:string>>")).alias("details"))) for name, (when, details) in fields.items()]
    return F.array_compact(F.array(*entries)).cast(RECORDS)


def unfolded(df: DataFrame, column: str) -> DataFrame:
    """The records of all rows, one each: (incident_id, field, source, stage, details)."""
    # Of a plain column the optimizer would ask first whether it is empty, and for that evaluate all records twice.
    rows = df.where(or_empty("incident_id") != "").select("incident_id", F.explode(F.array_compact(column)).alias("e"))
    return rows.select("incident_id", "e.field", "e.source", "e.stage", "e.details")


def record_all(df: DataFrame, source: str, stage: int, fields: Mapping[str, tuple[Column, Mapping[str, Column]]]) -> DataFrame:
    """Provenance rows of several fields of one source, in one pass."""
    return unfolded(df.select("incident_id", records(source, stage, fields).alias("_new")), "_new")


def record(df: DataFrame, field: str, source: str, stage: int, when: Column, details: Mapping[str, Column]) -> DataFrame:
    """Provenance rows of one field; incidents without an id leave none."""
    return record_all(df, source, stage, {field: (when, details)})


def latest_provenance(records: DataFrame) -> DataFrame:
    """Last write per (incident, field) by stage."""
    payload = F.struct("source", "details")
    return records.groupBy("incident_id", "field").agg(
        F.max_by(payload, "stage").alias("_p")).select("incident_id", "field", "_p.*")


def provenance_summary(provenance: DataFrame) -> DataFrame:
    """Counts by source, by field and in total."""
    grouped = provenance.groupingSets(
        [[F.col("source")], [F.col("field")], []], F.col("source"), F.col("field"),
    ).agg(F.count(F.lit(1)).alias("fields_recorded"),
          F.countDistinct("incident_id").alias("incidents"),
          F.grouping_id().alias("_g"))
    kind = F.when(F.col("_g") == 1, "source").when(F.col("_g") == 2, "field").otherwise("total")
    return grouped.select(kind.alias("kind"), F.coalesce("source", "field").alias("name"),
                          "fields_recorded", "incidents")


def provenance_rate(incidents: DataFrame, provenance: DataFrame, field: str, source: str,
                    detail: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of incidents with a round whose field came from ``source`` with ``detail`` set, in all or by some columns."""
    hits = provenance.where((F.col("field") == field) & (F.col("source") == source)
                            & F.col("details")[detail].isNotNull()).select(
        "incident_id", F.lit(1.0).alias("_hit"))
    rows = incidents.where(~is_blank("round")).select("incident_id", *by).join(hits, "incident_id", "left")
    return rows.groupBy(*by).agg(F.round(F.coalesce(F.avg(F.coalesce("_hit", F.lit(0.0))), F.lit(0.0)), 4).alias("rate"))


def upsert(current: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Keyed upsert: update values win where present, new keys are appended."""
    extra = [c for c in updates.columns if c != key]
    joined = current.join(updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in extra]), key, "full_outer")
    columns = [key]
    for name in dict.fromkeys([*current.columns, *extra]):
        if name == key:
            continue
        old = F.col(name) if name in current.columns else F.lit(None)
        columns.append(F.coalesce(f"_new_{name}", old).alias(name) if name in extra else F.col(name))
    return joined.select(*columns)
