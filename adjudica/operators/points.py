"""Rolling license points before each incident."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from adjudica.functions.blanks import number
from adjudica.functions.multi import split_drop
from adjudica.functions.scoring import first_named_driver, license_points
from adjudica.operators.running import running, with_text_cell

_UNKNOWN_ROUND = 999
_UNKNOWN_DATE = "9999-12-31"


def _held(incidents: DataFrame) -> DataFrame:
    """One row per incident and listed driver, with the incident's drivers and what the driver held before it.

    Order within a season is (round, date, incident id): earlier rows of the same round do count. Points go to the first
    named driver. Cells between sampled ids cut a driver's single date.
    """
    drivers = split_drop("drivers")
    rows = with_text_cell(incidents, "incident_id", "_cell").select(
        "incident_id", F.coalesce(F.col("season").cast("int"), F.lit(-1)).alias("season"),
        F.coalesce(number("round").cast("int"), F.lit(_UNKNOWN_ROUND)).alias("_round"),
        F.coalesce(F.col("date").cast("date"), F.lit(_UNKNOWN_DATE).cast("date")).alias("_date"),
        "_cell",
        license_points("superlicense_points_added").alias("_points"),
        first_named_driver(drivers).alias("_primary"), drivers.alias("_listed"),
        F.explode(F.array_distinct(drivers)).alias("driver"))
    credit = F.when(F.col("driver") == F.col("_primary"), F.greatest("_points", F.lit(0))).otherwise(0)
    return running(rows, ["season", "driver"], ["_round", "_date", "_cell"],
                   [F.col("_round"), F.col("_date"), F.col("incident_id")], credit, "points_before")


def driver_points(incidents: DataFrame) -> DataFrame:
    """One row per incident and named driver with the points held before the incident."""
    return _held(incidents).where(~F.col("driver").startswith("car_")).drop("_listed")


def points_before(incidents: DataFrame) -> DataFrame:
    """(incident_id, superlicense_points_before_incident): one value per listed driver, blank for one without a name.

    The list travels with its drivers through the scan, so it is put together again without a join.
    """
    value = F.when(F.col("driver").startswith("car_"), "").otherwise(F.coalesce(F.col("points_before").cast("string"), F.lit("")))
    held = _held(incidents).groupBy("incident_id").agg(
        F.first("_listed").alias("_listed"), F.map_from_entries(F.collect_list(F.struct("driver", value))).alias("_points"))
    return held.select("incident_id", F.array_join(F.transform("_listed", lambda d: F.element_at("_points", d)), ",").alias(
        "superlicense_points_before_incident"))


def incidents_with_prior_points(incidents: DataFrame) -> DataFrame:
    return driver_points(incidents).where("points_before > 0").select("incident_id").distinct()
