"""Dimension lookups: single keys, computed fallbacks, per-element and round N-1 joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from adjudica.functions.blanks import number, or_empty
from adjudica.functions.multi import split_drop
from adjudica.functions.scoring import years_in_sport
from adjudica.functions.text import id_slug, nationality_slug, slug


def with_meta(incidents: DataFrame, meta: DataFrame) -> DataFrame:
    return incidents.join(meta, "incident_id", "left")


def resolve_circuit(df: DataFrame, circuits: DataFrame, event: str = "event") -> DataFrame:
    """Circuit by event name, else the slug of the event without its suffix."""
    known = circuits.select(F.col("event_name").alias(event), F.col("circuit").alias("_c"))
    fallback = slug(F.replace(or_empty(event), F.lit(" Grand Prix"), F.lit("")))
    return df.join(known, event, "left").withColumn(
        "circuit", F.coalesce("_c", fallback)).drop("_c")


def corner_sector(df: DataFrame, circuits: DataFrame) -> DataFrame:
    """Sector of (circuit, turn); ``circuits.corners`` maps turn to sector."""
    corners = circuits.select("circuit", F.explode("corners").alias("turn_number", "_sector"))
    return df.join(corners, ["circuit", "turn_number"], "left").withColumn(
        "sector", F.coalesce(F.col("_sector").cast("string"), F.lit(""))).drop("_sector")


def canonical_teams(teams: DataFrame) -> DataFrame:
    """(team_id, canonical): every id and legacy id; a canonical id wins over a legacy one."""
    own = teams.select(F.col("team_id"), F.col("team_id").alias("canonical"), F.lit(-1).cast("long").alias("p"))
    old = teams.select(F.explode("legacy_ids").alias("team_id"), F.col("team_id").alias("canonical"),
                       F.col("ordinal").cast("long").alias("p"))
    return own.unionByName(old).groupBy("team_id").agg(F.min_by("canonical", "p").alias("canonical"))


def resolve_teams(df: DataFrame, teams: DataFrame, team: str = "team_id") -> DataFrame:
    table = canonical_teams(teams).withColumnRenamed("team_id", team)
    return df.join(table, team, "left").withColumn(
        "canonical", F.coalesce("canonical", F.col(team)))


def explode_drivers(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(split_drop("drivers")).alias("pos", "driver"))


def regroup(rows: DataFrame, key: str, *fields: str) -> DataFrame:
    """Per-driver values back to one comma-joined cell per incident, in driver order."""
    cell = F.struct("pos", *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields])
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(cell)).alias("_cells"))
    return grouped.select(key, *[F.array_join(F.col(f"_cells.{f}"), ",").alias(f) for f in fields])


def season_driver_fields(incidents: DataFrame, drivers: DataFrame, standings: DataFrame,
                         team_standings: DataFrame, teams: DataFrame) -> DataFrame:
    """Nationality, end-of-season standing, points, team and experience per listed driver.

    ``drivers(driver, nationality, debut)``, ``standings(season, driver, position, points,
    team)``, ``team_standings(season, team, position, points)``.
    """
    rows = explode_drivers(incidents, "incident_id", "season")
    named = ~F.col("driver").startswith("car_")
    table = standings.select("season", "driver", F.col("position").alias("driver_standings"),
                             F.col("points").alias("driver_points"), F.col("team").alias("team_id"))
    rows = (rows.join(drivers, "driver", "left").join(table, ["season", "driver"], "left"))
    rows = resolve_teams(rows, teams).withColumnRenamed("canonical", "respective_teams")
    by_team = team_standings.select("season", F.col("team").alias("respective_teams"),
                                    F.col("position").alias("construct_standings"),
                                    F.col("points").alias("construct_points"))
    rows = rows.join(by_team, ["season", "respective_teams"], "left")
    fields = ("nationalities", "driver_standings", "driver_points", "respective_teams",
              "construct_standings", "construct_points", "years_in_sport")
    rows = rows.withColumns({"nationalities": nationality_slug("nationality"),
                             "years_in_sport": years_in_sport("season", "debut")})
    rows = rows.withColumns({f: F.when(named, F.col(f).cast("string")) for f in fields})
    return regroup(rows, "incident_id", *fields)


def standing_keys(standings: DataFrame) -> DataFrame:
    """Three lookup keys per standing row (id, family name, code); the later row wins a key."""
    keys = F.array_distinct(F.array(
        id_slug("driver_id"),
        F.replace(F.lower(or_empty("family_name")), F.lit(" "), F.lit("_")),
        F.lower(or_empty("code"))))
    rows = standings.select("season", "round", F.explode(keys).alias("key"), F.struct(
        "driver_id", "position", "points", "nationality",
        F.col("constructor_id").alias("constructor_id")).alias("standing"), "ordinal")
    return rows.where("key <> ''").groupBy("season", "round", "key").agg(
        F.max_by("standing", "ordinal").alias("standing"))


def prior_round_standings(rows: DataFrame, standings: DataFrame) -> DataFrame:
    """Join exploded drivers to the standings after the previous round.

    Key cascade: the driver's slug, then its last token. Adds a ``standing`` struct.
    """
    keys = standing_keys(standings)
    after = (F.col("round") + 1).alias("round")
    by_slug = keys.select("season", after, F.col("key").alias("driver"), F.col("standing").alias("_a"))
    by_tail = keys.select("season", after, F.col("key").alias("_tail"), F.col("standing").alias("_b"))
    joined = (rows.withColumn("_tail", F.element_at(F.split("driver", "_"), -1))
              .join(by_slug, ["season", "round", "driver"], "left")
              .join(by_tail, ["season", "round", "_tail"], "left"))
    standing = F.when(~F.col("driver").startswith("car_"), F.coalesce("_a", "_b"))
    return joined.withColumn("standing", standing).drop("_tail", "_a", "_b")


def car_drivers(results: DataFrame) -> DataFrame:
    """(season, round, car_number, driver): the later result wins a number."""
    return results.where(or_empty("number") != "").groupBy(
        "season", "round", F.col("number").cast("string").alias("car_number")).agg(
        F.max_by(id_slug("driver_id"), "seq").alias("driver"))


def drivers_from_car(incidents: DataFrame, results: DataFrame) -> DataFrame:
    """Fill a blank drivers cell from the document's car number."""
    table = car_drivers(results).withColumnRenamed("driver", "_d")
    joined = incidents.join(table, ["season", "round", "car_number"], "left")
    blank = F.trim(or_empty("drivers")) == ""
    return joined.withColumn("drivers", F.when(blank & F.col("_d").isNotNull(), F.col("_d"))
                             .otherwise(F.col("drivers"))).drop("_d")


def top_four(standings: DataFrame) -> DataFrame:
    """First four drivers per (season, round) in standing order.

    The row_number filter becomes a group limit before the shuffle, so a group never grows.
    """
    best = Window.partitionBy("season", "round").orderBy("ordinal", "driver_id")
    rows = standings.withColumn("_n", F.row_number().over(best)).where("_n <= 4")
    listed = rows.groupBy("season", "round").agg(
        F.array_sort(F.collect_list(F.struct("_n", id_slug("driver_id").alias("d")))).alias("_l"))
    return listed.select("season", "round", F.array_join(F.col("_l.d"), ",").alias("current_top_4_drivers"))


def mode_lookup(df: DataFrame, modes: DataFrame, fallback: Column, key: str, out: str) -> DataFrame:
    """Group mode with a global fallback."""
    return df.join(modes.withColumnRenamed("mode", "_m"), key, "left").withColumn(
        out, F.coalesce("_m", fallback)).drop("_m")


def resolve_round(rows: DataFrame, local: DataFrame, fetched: DataFrame) -> DataFrame:
    """Own round, else the local calendar's, else the fetched calendar's."""
    first = local.select("season", "event", F.col("round").alias("_local"))
    second = fetched.select("season", "event", F.col("round").alias("_fetched"))
    return (rows.join(first, ["season", "event"], "left").join(second, ["season", "event"], "left")
            .withColumn("round", F.coalesce(number("round").cast("int"), "_local", "_fetched"))
            .drop("_local", "_fetched"))
