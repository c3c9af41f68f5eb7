"""The other dimensions, payloads, feeds and frames, and what enrichers record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from adjudica.functions import text as tx
from adjudica.plans import enrich
from adjudica.queries import query, roles
from adjudica.queries.joins import STANDING_SQL, standings
from adjudica.queries.roles import FEED_SQL, FIELDS_SQL, LAPS, MESSAGES, POSITIONS, SPARE, table
from adjudica.queries.scalars import FAULT_SURE_SQL, FAULT_VALUE_SQL, SEVERITY_SURE_SQL, SEVERITY_VALUE_SQL
from adjudica.queries.studies import processed
from adjudica.queries.windows import POINTS_SQL
from adjudica.session import new_path
from adjudica.sources import readers, writers


def keyed_file(rows: DataFrame, key: Column, order: Column, value: Column, path: str) -> str:
    """One object with a member per row, in order: the stored form of a curated dimension."""
    member = F.concat(F.to_json(F.struct(key.alias("k"))), F.lit(""))
    name = F.regexp_extract(member, r'^\{"k":(".*")\}$', 1)
    listed = rows.agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.concat(name, F.lit(":"), value).alias("m")))).alias("e"))
    return writers.write_texts(listed.select(F.concat(F.lit("{"), F.array_join("e.m", ","), F.lit("}")).alias("value")), path)


@query("S07_driver_dimension", "SELECT 'driver_' || n_nationkey AS driver, n_name AS name, lower(n_name) AS nationality, CAST(1980 + n_nationkey AS STRING) AS debut, n_nationkey AS ordinal FROM nation")
def _(spark, sf):
    rows = table(spark, sf, "nation")
    value = F.to_json(F.struct(F.col("n_name").alias("name"), F.lower("n_name").alias("nationality"), (1980 + F.col("n_nationkey")).cast("string").alias("debut")))
    path = keyed_file(rows, F.concat(F.lit("driver_"), "n_nationkey"), F.col("n_nationkey"), value, new_path(spark, "drivers"))
    return readers.read_drivers(spark, path)


@query("S07_team_dimension", """SELECT 'team_' || r_regionkey AS team_id, r_name AS name, r_regionkey AS ordinal,
    (SELECT string_agg('old_' || n_nationkey, ',' ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) AS legacy_ids FROM region""")
def _(spark, sf):
    old = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_nationkey")).alias("keys"))
    rows = table(spark, sf, "region").join(old, "r_regionkey")
    value = F.to_json(F.struct(F.col("r_name").alias("name"), F.transform("keys", lambda k: F.concat(F.lit("old_"), k)).alias("legacy_ids")))
    path = keyed_file(rows, F.concat(F.lit("team_"), "r_regionkey"), F.col("r_regionkey"), value, new_path(spark, "teams"))
    return readers.read_teams(spark, path).withColumn("legacy_ids", F.array_join("legacy_ids", ","))


@query("S07_keyword_dimension", """SELECT lower(r_name) AS incident_type, (SELECT string_agg(lower(n_name), ',' ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) AS terms,
    r_regionkey AS ordinal FROM region""")
def _(spark, sf):
    terms = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(
        F.array_sort(F.collect_list(F.struct("n_nationkey", F.lower("n_name").alias("t")))).alias("l"))
    rows = table(spark, sf, "region").join(terms, "r_regionkey")
    path = keyed_file(rows, F.lower("r_name"), F.col("r_regionkey"), F.to_json("l.t"), new_path(spark, "keywords"))
    return readers.read_keywords(spark, path).withColumn("terms", F.array_join("terms", ","))


_SEASON_SQL = """r AS (SELECT 2000 + r_regionkey AS season, n_nationkey AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS position FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@query("S07_season_dimension", f"""WITH {_SEASON_SQL}, f AS (SELECT season, CAST(count(*) AS INT) AS rounds, CAST(count(*) FILTER (position <= 2) AS INT) AS num_teams FROM r GROUP BY 1)
    SELECT season, 'facts' AS part, rounds AS position, NULL AS id, num_teams AS points FROM f
    UNION ALL SELECT season, 'calendar', position, 'ring_' || k, NULL FROM r UNION ALL SELECT season, 'drivers', position, 'driver_' || k, 100 - k FROM r
    UNION ALL SELECT season, 'teams', position, 'team_' || k, 200 - k FROM r WHERE position <= 2""")
def _(spark, sf):
    listed = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("keys"))
    named = lambda prefix: lambda k: F.concat(F.lit(prefix), k)
    driver = lambda k: F.struct(F.concat(F.lit("driver_"), k).alias("id"), F.concat(F.lit("team_"), k).alias("team"), (100 - k).alias("total_points"))
    team = lambda k: F.struct(F.concat(F.lit("team_"), k).alias("id"), (200 - k).alias("total_points"))
    value = F.to_json(F.struct(
        (2000 + F.col("n_regionkey")).alias("year"), F.size("keys").alias("rounds"), F.transform("keys", named("ring_")).alias("calendar_in_order"),
        F.transform("keys", driver).alias("drivers.standings_order"), F.transform(F.slice("keys", 1, 2), team).alias("teams.standings_order")))
    path = keyed_file(listed, (2000 + F.col("n_regionkey")).cast("string"), F.col("n_regionkey"), value, new_path(spark, "seasons"))
    parts = readers.read_seasons(spark, path)
    none = F.lit(None)
    return (parts["seasons"].select("season", F.lit("facts").alias("part"), F.col("rounds").alias("position"), none.cast("string").alias("id"), F.col("num_teams").alias("points"))
            .unionByName(parts["calendar"].select("season", F.lit("calendar").alias("part"), F.col("round").alias("position"), F.col("circuit").alias("id"), none.cast("int").alias("points")))
            .unionByName(parts["drivers"].select("season", F.lit("drivers").alias("part"), "position", F.col("driver").alias("id"), "points"))
            .unionByName(parts["teams"].select("season", F.lit("teams").alias("part"), "position", F.col("team").alias("id"), "points")))


def _race_payload(rows: DataFrame, *fields: Column) -> DataFrame:
    """One payload per row of (season, round)."""
    race = F.struct(F.col("round").cast("string").alias("round"), *fields)
    races = F.struct(F.col("season").cast("string").alias("season"), F.array(race).alias("Races"))
    return rows.select(F.to_json(F.struct(F.struct(races.alias("RaceTable")).alias("MRData"))).alias("value"))


_ROUNDS = ("CAST(year(o_orderdate) AS INT) AS season", "CAST(month(o_orderdate) AS INT) AS round")
_ROUNDS_SQL = f"r AS (SELECT {', '.join(_ROUNDS)}, min(o_custkey) AS low, max(o_custkey) AS high FROM orders GROUP BY ALL)"


def rounds(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*_ROUNDS, "o_custkey").groupBy("season", "round").agg(F.min("o_custkey").alias("low"), F.max("o_custkey").alias("high"))


@query("S08_calendar_payload", f"WITH {_ROUNDS_SQL} SELECT season, round, 'Race ' || low AS race_name, 'ring_' || high AS circuit_id, 'new_land_' || round AS country FROM r")
def _(spark, sf):
    place = F.struct(F.concat(F.lit("ring_"), "high").alias("circuitId"), F.struct(F.concat(F.lit("New Land "), "round").alias("country")).alias("Location"))
    payload = _race_payload(rounds(spark, sf), F.concat(F.lit("Race "), "low").alias("raceName"), place.alias("Circuit"))
    return readers.read_calendar(spark, writers.write_texts(payload, new_path(spark, "calendar")))


@query("S08_results_payload", f"""WITH {_ROUNDS_SQL} SELECT season, round, 0 AS seq, CAST(low AS STRING) AS number, 'driver_' || low AS driver_id FROM r
    UNION ALL SELECT season, round, 1, CAST(high AS STRING), 'driver_' || high FROM r""")
def _(spark, sf):
    entry = lambda c: F.struct(F.col(c).cast("string").alias("number"), F.struct(F.concat(F.lit("driver_"), c).alias("driverId")).alias("Driver"))
    payload = _race_payload(rounds(spark, sf), F.array(entry("low"), entry("high")).alias("Results"))
    return readers.read_results(spark, writers.write_texts(payload, new_path(spark, "results")))


@query("S08_team_standings_payload", f"""WITH {STANDING_SQL} SELECT season, round, position - 1 AS ordinal, 'old-' || (k % 5) AS constructor_id, CAST(position AS STRING) AS position, CAST(points AS STRING) AS points FROM st""")
def _(spark, sf):
    entry = F.struct("ordinal", "position", "points", F.struct(F.col("constructor_id").alias("constructorId")).alias("Constructor"))
    lists = standings(spark, sf).groupBy("season", "round").agg(F.array_sort(F.collect_list(entry)).alias("ConstructorStandings"))
    table_ = F.struct(F.col("season").cast("string").alias("season"), F.col("round").cast("string").alias("round"), F.array(F.struct("ConstructorStandings")).alias("StandingsLists"))
    payload = lists.select(F.to_json(F.struct(F.struct(table_.alias("StandingsTable")).alias("MRData"))).alias("value"))
    return readers.read_team_standings(spark, writers.write_texts(payload, new_path(spark, "team-standings")))


def _stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


_AT = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"


def _back(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("S10_position_feed", f"WITH e AS ({FEED_SQL}) SELECT session_key, driver_number, position, {_AT} AS date FROM e WHERE event_type = '{POSITIONS}'")
def _(spark, sf):
    rows = roles.feed(spark, sf, POSITIONS).select("session_key", "driver_number", "position", _stamp("ts").alias("date"))
    return _back(readers.read_feed(spark, writers.write_json(rows, new_path(spark, "position")), "position"), "date")


@query("S10_race_control_feed", f"WITH e AS ({FEED_SQL}) SELECT session_key, {_AT} AS date, flag, message, CAST(sector AS STRING) AS sector FROM e WHERE event_type = '{MESSAGES}'")
def _(spark, sf):
    rows = roles.feed(spark, sf, MESSAGES).select("session_key", _stamp("ts").alias("date"), "flag", "message", F.col("sector").cast("string").alias("sector"))
    return _back(readers.read_feed(spark, writers.write_json(rows, new_path(spark, "race-control")), "race_control"), "date")


@query("S10_session_feed", f"""WITH e AS ({FEED_SQL}), s AS (SELECT session_key, min(ts) AS ts FROM e GROUP BY 1) SELECT 2024 AS season, CAST(session_key // 10 AS INT) AS meeting_key, session_key, 'Race' AS session_name, {_AT} AS date_start FROM s""")
def _(spark, sf):
    rows = roles.feed(spark, sf).groupBy("session_key").agg(F.min("ts").alias("ts"))
    rows = rows.select(F.lit(2024).alias("season"), F.floor(F.col("session_key") / 10).cast("int").alias("meeting_key"), "session_key",
                       F.lit("Race").alias("session_name"), _stamp("ts").alias("date_start"))
    back = readers.read_feed(spark, writers.write_json(rows, new_path(spark, "sessions")), "sessions")
    return _back(back.select("season", "meeting_key", "session_key", "session_name", "date_start"), "date_start")


@query("S10_driver_feed", f"WITH e AS ({FEED_SQL}) SELECT DISTINCT session_key, driver_number, 'Driver ' || driver_number AS full_name, 'D' || driver_number AS name_acronym FROM e WHERE driver_number IS NOT NULL")
def _(spark, sf):
    rows = roles.feed(spark, sf).where("driver_number is not null").select(
        "session_key", "driver_number", F.concat(F.lit("Driver "), "driver_number").alias("full_name"), F.concat(F.lit("D"), "driver_number").alias("name_acronym")).distinct()
    return readers.read_feed(spark, writers.write_json(rows, new_path(spark, "roster")), "drivers")


@query("S11_lap_frame", f"""WITH e AS ({FEED_SQL}) SELECT day AS round, driver_number AS "DriverNumber", lap_number AS "LapNumber", position AS "Position", round(seconds, 6) AS "Time" FROM e WHERE event_type = '{LAPS}'""")
def _(spark, sf):
    rows = roles.feed(spark, sf, LAPS).select(
        F.lit(2024).alias("season"), F.col("day").alias("round"), F.lit("race").alias("session"), F.col("driver_number").cast("int").alias("DriverNumber"),
        F.col("lap_number").cast("int").alias("LapNumber"), F.col("position").cast("int").alias("Position"), F.col("seconds").alias("Time"))
    back = readers.read_session_frame(spark, writers.write_parquet(rows, new_path(spark, "laps"), "season"), "laps")
    return back.select("round", "DriverNumber", "LapNumber", "Position", F.round("Time", 6).alias("Time"))


@query("S11_weather_frame", f"""WITH e AS ({FEED_SQL}) SELECT day AS round, value > 20 AS "Rainfall", round(seconds, 6) AS "Time" FROM e WHERE event_type = '{SPARE}'""")
def _(spark, sf):
    rows = roles.feed(spark, sf, SPARE).select(
        F.lit(2024).alias("season"), F.col("day").alias("round"), F.lit("race").alias("session"), F.col("seconds").alias("Time"),
        (F.col("value") > 20).alias("Rainfall"), F.lit("Dry").alias("TrackStatus"))
    back = readers.read_session_frame(spark, writers.write_parquet(rows, new_path(spark, "weather"), "season"), "weather")
    return back.select("round", "Rainfall", F.round("Time", 6).alias("Time"))


@query("E06_license_point_provenance", f"""WITH {POINTS_SQL}, b AS (SELECT x.incident_id, string_agg(CASE WHEN held.points IS NULL THEN '' ELSE CAST(CAST(held.points AS BIGINT) AS STRING) END, ',' ORDER BY pos) AS v
        FROM x LEFT JOIN held ON x.incident_id = held.incident_id AND x.driver = held.driver GROUP BY x.incident_id)
    SELECT incident_id, 'superlicense_points_before_incident' AS field, 'corpus_rolling' AS source, 6 AS stage, v AS value FROM b WHERE v <> '' AND incident_id <> ''""")
def _(spark, sf):
    dates = roles.multi_incidents(spark, sf).select("incident_id", "date")
    _, records = enrich.enrich_points(processed(spark, sf), dates)
    return records.select("incident_id", "field", "source", "stage", F.col("details")["value"].alias("value"))


@query("E07_text_field_provenance", f"""WITH f AS ({FIELDS_SQL}), s AS (SELECT document_id AS incident_id, cents % 7 = 0 AS known, {FAULT_VALUE_SQL} AS fault, {FAULT_SURE_SQL} AS sure, {SEVERITY_VALUE_SQL} AS severity,
        {SEVERITY_SURE_SQL} AS severity_confidence FROM f)
    SELECT incident_id, 'driver_at_fault' AS field, fault AS value, round(sure, 6) AS confidence, CASE WHEN known OR sure < 0.7 THEN 'true' END AS suggestion_only FROM s WHERE fault <> ''
    UNION ALL SELECT incident_id, 'severity', CAST(severity AS STRING), round(severity_confidence, 6), 'false' FROM s""")
def _(spark, sf):
    rows = roles.fields(spark, sf)
    docs = rows.select("document_id", F.struct("fact", "reason", "decision").alias("parsed_fields"))
    incidents = rows.select(
        F.col("document_id").alias("incident_id"), F.concat(F.lit("car_4,d"), F.col("custkey").cast("string")).alias("drivers"),
        F.when(F.col("cents") % 7 == 0, "x").otherwise("").alias("driver_at_fault"), tx.penalty_label("decision").alias("penalty"), F.lit("").alias("severity"))
    _, records, _ = enrich.enrich_text(incidents, rows.select(F.col("document_id").alias("incident_id"), "document_id"), docs)
    d = F.col("details")
    return records.select("incident_id", "field", d["value"].alias("value"), F.round(d["confidence"].cast("double"), 6).alias("confidence"), d["suggestion_only"].alias("suggestion_only"))
