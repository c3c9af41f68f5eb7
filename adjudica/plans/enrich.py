"""Enrichment jobs. Each takes incident rows and returns them with what it wrote, as provenance records.

Stages run in this order: reference, standings, timestamps, race feed, session frames, license points, text fields.
``enrich_all`` runs them as one job: the records of a row travel with it in an array and are unfolded once, at the end.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from adjudica.constants import FAULT_MIN_CONFIDENCE, FEED_FIRST_SEASON, MATCH_TOLERANCE_SECONDS, STANDINGS_COLUMNS
from adjudica.functions import times
from adjudica.functions.blanks import is_blank, number, or_empty
from adjudica.functions.feeds import flag_state, safety_car_state, track_condition, track_sector, weather_condition
from adjudica.functions.multi import split_drop
from adjudica.functions.scoring import infer_fault, suggest_severity
from adjudica.functions.text import id_slug, nationality_slug
from adjudica.operators import lookup, match, points, quality
from adjudica.operators.asof import Feed, last_match, nearest_match, scan
from adjudica.operators.fill import RECORDS, fill_columns, fill_gap, latest_provenance, record_all, records, unfolded
from adjudica.session import cut_lineage, written

POSITIONS = "positions_of_involved parties"
SUGGESTIONS = ("driver_at_fault_suggestion", "driver_at_fault_confidence", "severity_suggestion", "severity_confidence")
#: The records of one stage, on their way out of it.
NEW = "_new"
Enriched = tuple[DataFrame, DataFrame]


def _noted(rows: DataFrame, incidents: DataFrame, new: Column) -> DataFrame:
    """The columns that came in, and what the stage wrote."""
    return rows.select(*[F.col(f"`{c}`") for c in incidents.columns], new.alias(NEW))


def _apart(noted: DataFrame) -> Enriched:
    return noted.drop(NEW), unfolded(noted, NEW)


def enrich_reference(incidents: DataFrame, meta: DataFrame, circuits: DataFrame, drivers: DataFrame,
                     teams: DataFrame, seasons: Mapping[str, DataFrame], with_standings: bool = True) -> DataFrame:
    """Round, circuit facts, season facts and per-driver fields from the curated dimensions."""
    rows = lookup.with_meta(incidents, meta.select("incident_id", "event"))
    names = circuits.select("event_name", "circuit", "ordinal")
    rounds = match.local_rounds(rows, names, seasons["calendar"]).select(
        "season", "event", F.col("circuit").alias("_circuit"), F.col("round").alias("_round"))
    facts = circuits.select(F.col("circuit").alias("_circuit"), F.col("country").alias("_country"),
                            F.col("first_season").alias("_first"), F.col("total_laps").alias("_laps"))
    rows = rows.join(rounds, ["season", "event"], "left").join(facts, "_circuit", "left")
    season = seasons["seasons"].select("season", F.col("rounds").alias("_rounds"), F.col("num_teams").alias("_teams"))
    rows = rows.join(season, "season", "left")
    race_laps = F.when(F.lower(or_empty("session")) == "race", F.col("_laps"))
    updates = {"round": F.col("_round"), "circuit": F.col("_circuit"), "country": F.col("_country"),
               "first_season": F.col("_first"), "full_laps": race_laps,
               "rounds": F.col("_rounds"), "num_teams": F.col("_teams")}
    rows = fill_columns(rows, updates, always=("rounds", "num_teams"))
    fields = lookup.season_driver_fields(incidents, drivers, seasons["drivers"], seasons["teams"], teams)
    wanted = [c for c in fields.columns if c != "incident_id"]
    if not with_standings:
        wanted = ["nationalities", "years_in_sport"]
    fields = fields.select("incident_id", *[F.col(c).alias(f"_f_{c}") for c in wanted])
    rows = rows.join(fields, "incident_id", "left")
    rows = fill_columns(rows, {c: F.col(f"_f_{c}") for c in wanted})
    if with_standings:
        top = lookup.top_four(seasons["drivers"].select(
            "season", F.lit(0).alias("round"), F.col("position").alias("ordinal"), F.col("driver").alias("driver_id")))
        rows = rows.join(top.select("season", F.col("current_top_4_drivers").alias("_top")), "season", "left")
        rows = fill_columns(rows, {"current_top_4_drivers": F.col("_top")})
    return rows.select(*incidents.columns)


def standing_fields(rows: DataFrame, standings: DataFrame, team_standings: DataFrame, teams: DataFrame) -> DataFrame:
    """Per-driver cells after round N-1, one row per incident."""
    found = lookup.prior_round_standings(rows, standings)
    s = F.col("standing")
    found = found.withColumns({
        "nationalities": nationality_slug(s["nationality"]), "driver_standings": s["position"].cast("string"),
        "driver_points": s["points"].cast("string"), "team_id": id_slug(s["constructor_id"])})
    found = found.withColumn("team_id", F.when(s.isNotNull(), F.col("team_id")))
    found = found.withColumn("nationalities", F.when(s.isNotNull(), F.col("nationalities")))
    found = lookup.resolve_teams(found, teams).withColumnRenamed("canonical", "respective_teams")
    by_team = team_standings.select(
        "season", (F.col("round") + 1).alias("round"), id_slug("constructor_id").alias("team_id"),
        F.col("position").cast("string").alias("construct_standings"),
        F.col("points").cast("string").alias("construct_points"))
    found = found.join(by_team, ["season", "round", "team_id"], "left")
    return lookup.regroup(found, "incident_id", "nationalities", "respective_teams", "driver_standings",
                          "driver_points", "construct_standings", "construct_points")


def enrich_standings(incidents: DataFrame, meta: DataFrame, calendar: DataFrame, standings: DataFrame,
                     team_standings: DataFrame, results: DataFrame, teams: DataFrame,
                     overwrite: bool = True, write_blanks: bool = False) -> Enriched:
    """Round, circuit and country from the fetched calendar, standings from round N-1."""
    return _apart(note_standings(incidents, meta, calendar, standings, team_standings, results, teams, overwrite, write_blanks))


def note_standings(incidents: DataFrame, meta: DataFrame, calendar: DataFrame, standings: DataFrame,
                   team_standings: DataFrame, results: DataFrame, teams: DataFrame,
                   overwrite: bool = True, write_blanks: bool = False) -> DataFrame:
    rows = lookup.with_meta(incidents, meta.select("incident_id", "event", "car_number"))
    # The match asks for the events many times and is joined to two branches: events and rounds are each found once.
    events = written(rows.select("season", "event").where(or_empty("event") != "").distinct(), "events")
    found = written(match.ranked_rounds(events, calendar), "rounds").withColumnRenamed("round", "_round")
    races = calendar.select("season", F.col("round").alias("_round"), F.col("circuit_id").alias("_circuit"),
                            F.col("country").alias("_country"))
    rows = rows.join(found, ["season", "event"], "left").join(races, ["season", "_round"], "left")
    count = calendar.groupBy("season").agg(F.count(F.lit(1)).alias("_rounds"))
    size = team_standings.groupBy("season").agg(F.countDistinct("constructor_id").alias("_teams"))
    rows = rows.join(count, "season", "left").join(size, "season", "left")
    basics = {"round": F.col("_round"), "circuit": F.col("_circuit"), "country": F.col("_country")}
    rows = rows.withColumn("_basics", records("standings_feed", 2, {c: (is_blank(c) & ~is_blank(v), {"value": v}) for c, v in basics.items()}))
    rows = fill_columns(rows, {**basics, "rounds": F.col("_rounds"), "num_teams": F.col("_teams")})
    rows = lookup.drivers_from_car(rows.withColumn("_r", F.col("round")).withColumn("round", F.col("_round")), results)
    rows = rows.withColumn("round", F.col("_r")).drop("_r")
    exploded = rows.where("_round is not null").select(
        "incident_id", "season", F.col("_round").alias("round"), F.posexplode(split_drop("drivers")).alias("pos", "driver"))
    fields = standing_fields(exploded, standings, team_standings, teams)
    top = lookup.top_four(standings).select("season", (F.col("round") + 1).alias("_round"),
                                            F.col("current_top_4_drivers").alias("_f_current_top_4_drivers"))
    names = [c for c in fields.columns if c != "incident_id"]
    fields = fields.select("incident_id", *[F.col(c).alias(f"_f_{c}") for c in names])
    rows = rows.join(fields, "incident_id", "left").join(top, ["season", "_round"], "left")
    names.append("current_top_4_drivers")
    used = F.greatest(F.col("_round") - 1, F.lit(0))
    # A cell of commas only holds no value.
    value = {c: F.when(F.replace(or_empty(f"_f_{c}"), F.lit(","), F.lit("")) != "", F.col(f"_f_{c}")) for c in names}
    new = records("standings_feed", 2, {
        c: (value[c].isNotNull(), {"value": value[c], "round_used": used}) for c in names}) if overwrite else F.array().cast(RECORDS)
    rows = rows.withColumn(NEW, F.concat("_basics", new)).withColumns({c: fill_gap(
        F.col(c), F.coalesce(F.col(f"_f_{c}"), F.lit("")) if write_blanks else value[c],
        overwrite and c in STANDINGS_COLUMNS, not write_blanks) for c in names})
    return _noted(rows, incidents, F.col(NEW))


def enrich_timestamps(incidents: DataFrame, meta: DataFrame, schedule: DataFrame, local_rounds: DataFrame,
                      fetched_rounds: DataFrame, max_error: float = MATCH_TOLERANCE_SECONDS) -> DataFrame:
    """Meta rows with parse method, confidence, lap hint and session offset."""
    rows = meta.join(incidents.select("incident_id", "season", "session", "round"), "incident_id", "left")
    rows = lookup.resolve_round(rows, local_rounds, fetched_rounds)
    rows = rows.withColumn("_session", F.lower(or_empty("session")))
    starts = schedule.select("season", "round", F.col("session").alias("_session"), F.col("start_ts").alias("_start"))
    rows = rows.join(starts, ["season", "round", "_session"], "left")
    rows = rows.withColumns({"_time": times.parse_time_text("time"), "_date": times.parse_date("date")})
    rows = rows.withColumn("_offset", times.session_offset(F.col("_time"), F.col("_start"), F.col("_date"), max_error))
    local = F.when((F.col("_time.method") == "document_clock") & F.col("_offset.offset").isNotNull(), F.date_format(
        times.add_seconds(F.col("_date").cast("timestamp"), F.col("_time.hours") * 3600 + F.col("_time.minutes") * 60
                          + F.col("_time.seconds")), "yyyy-MM-dd HH:mm:ss"))
    return rows.select(
        *meta.columns, F.coalesce("_time.method", F.lit("unparsed")).alias("time_parse_method"),
        F.coalesce("_offset.confidence", F.lit(0.0)).alias("time_parse_confidence"),
        F.col("_offset.offset").alias("session_offset_seconds"), F.col("_time.lap_hint").alias("lap_hint"),
        local.alias("incident_time_local"))


def timestamp_provenance(meta: DataFrame) -> DataFrame:
    return record_all(meta, "timestamp", 8, {
        "session_offset_seconds": (F.col("session_offset_seconds").isNotNull(), {
            "value": F.col("session_offset_seconds"), "method": F.col("time_parse_method"), "confidence": F.col("time_parse_confidence")}),
        "lap": (F.col("lap_hint").isNotNull(), {"value": F.col("lap_hint"), "via": F.lit("lap_hint")})})


def max_laps(laps: DataFrame, keys: list[str], lap: str) -> DataFrame:
    return laps.groupBy(*keys).agg(F.max(lap).cast("string").alias("_max_lap"))


def _looked_up(rows: DataFrame, keys: list[str], numbers: DataFrame, on: list[str], feeds: list[Feed], drivers: Feed, position: str,
               found: dict[str, Column], tolerance: float) -> DataFrame:
    """rows with the matches of ``found``, and in ``_positions`` the nearest position of each listed driver, blanks kept.

    One stack holds the feeds of the session and the positions of its drivers, which differ in the last key: blank, or the
    driver's number. So all of them are shuffled once and scanned once per direction. The rows are cut first: the stack
    takes what it sorts from the same rows that its matches are joined to.
    """
    rows = cut_lineage(rows.withColumn("_id", F.monotonically_increasing_id()))
    listed = rows.select("_id", "_at", "car_number", *dict.fromkeys([*on, *keys]), F.posexplode(split_drop("drivers")).alias("pos", "driver"))
    numbered = match.driver_numbers(listed, numbers, on)
    probes = rows.select("_id", F.lit(-1).alias("pos"), *keys, F.lit("").alias("_who"), "_at").unionByName(
        numbered.select("_id", "pos", *keys, F.col("driver_number").cast("string").alias("_who"), "_at"))
    known = drivers.rows.where(F.col(position).isNotNull())
    stacked = [Feed(f.name, f.rows.withColumn("_who", F.lit("")), f.time, f.take, f.seq, f.after, f.highest) for f in feeds]
    stacked.append(Feed("place", known.withColumn("_who", F.col(drivers.name).cast("string")), drivers.time, [position], drivers.seq, after=True))
    near = nearest_match("place", [position], tolerance)[position].cast("string")
    seen = scan(probes, stacked, [*keys, "_who"], "_at").select(
        "_id", "pos", F.when(F.col("pos") < 0, F.struct(*[c.alias(n) for n, c in found.items()])).alias("found"), F.coalesce(near, F.lit("")).alias("place"))
    cells = F.transform(F.array_sort(F.collect_list(F.when(F.col("pos") >= 0, F.struct("pos", "place")))), lambda c: c["place"])
    by_row = seen.groupBy("_id").agg(F.first("found", ignorenulls=True).alias("_found"), F.array_join(cells, ",").alias("_cells"))
    joined = rows.join(by_row, "_id").withColumn("_positions", F.when(F.replace("_cells", F.lit(","), F.lit("")) != "", F.col("_cells")))
    return joined.withColumns({n: F.col(f"_found.{n}") for n in found})


def enrich_feed(incidents: DataFrame, meta: DataFrame, sessions: DataFrame, laps: DataFrame, messages: DataFrame,
                position: DataFrame, numbers: DataFrame, tolerance: float = MATCH_TOLERANCE_SECONDS,
                first_season: int = FEED_FIRST_SEASON) -> Enriched:
    """Lap, full laps, flag, sector and positions from time-stamped feeds of the session."""
    return _apart(note_feed(incidents, meta, sessions, laps, messages, position, numbers, tolerance, first_season))


def note_feed(incidents: DataFrame, meta: DataFrame, sessions: DataFrame, laps: DataFrame, messages: DataFrame,
              position: DataFrame, numbers: DataFrame, tolerance: float = MATCH_TOLERANCE_SECONDS,
              first_season: int = FEED_FIRST_SEASON) -> DataFrame:
    side = meta.select("incident_id", "event", "car_number", "session_offset_seconds", "lap_hint")
    rows = lookup.with_meta(incidents, side).withColumn("_year", number("season").cast("int"))
    wanted = rows.where(F.col("_year") >= first_season).select(F.col("_year").alias("season"), "event", "session")
    keys = match.session_keys(wanted, sessions).select(
        F.col("season").alias("_year"), "event", "session", "session_key", "date_start")
    rows = rows.join(keys, ["_year", "event", "session"], "left")
    rows = rows.withColumn("_at", times.add_seconds(
        F.col("date_start"), F.col("session_offset_seconds").cast("double")))
    said = ["flag", "message", "sector"]
    rows = _looked_up(
        rows, ["session_key"], numbers, ["session_key"],
        [Feed("lap", laps, "date_start", ["lap_number"], "lap_number"), Feed("rc", messages, "date", said, "seq", after=True)],
        Feed("driver_number", position, "date", [], "seq"), "position",
        {"_lap": last_match("lap", ["lap_number"]), "_rc": nearest_match("rc", said, tolerance)}, tolerance)
    rows = rows.join(max_laps(laps, ["session_key"], "lap_number"), "session_key", "left")
    known = F.col("session_key").isNotNull()
    hint = F.when(known & (F.coalesce("lap_hint", F.lit(0)) > 0), F.col("lap_hint").cast("string"))
    lap = F.coalesce(hint, F.col("_lap.lap_number").cast("string"))
    flag = F.nullif(F.when(F.col("_rc").isNotNull(), flag_state("_rc.flag", "_rc.message")), F.lit(""))
    sector = F.nullif(F.when(F.col("_rc").isNotNull(), track_sector("_rc.sector", "_rc.message")), F.lit(""))
    updates = {"lap": lap, "full_laps": F.col("_max_lap"), "flag": flag, "sector": sector, POSITIONS: F.col("_positions")}
    rc = {"message": F.col("_rc.message"), "match_error_seconds": F.col("_rc.error_seconds")}
    details = {
        "lap": {"via": F.when(hint.isNotNull(), "lap_hint"),
                "session_key": F.when(hint.isNull(), F.col("session_key")),
                "match_error_seconds": F.when(hint.isNull(), F.col("_lap.error_seconds"))},
        "full_laps": {"session_key": F.col("session_key")}, "flag": rc, "sector": rc,
        POSITIONS: {"session_key": F.col("session_key")}}
    new = records("race_feed", 4, {c: (is_blank(F.col(f"`{c}`")) & v.isNotNull(), {"value": v, **details[c]}) for c, v in updates.items()})
    return _noted(fill_columns(rows.withColumn(NEW, new), updates), incidents, F.col(NEW))


def enrich_session_frames(incidents: DataFrame, meta: DataFrame, laps: DataFrame, messages: DataFrame,
                          weather: DataFrame, numbers: DataFrame, tolerance: float = MATCH_TOLERANCE_SECONDS) -> Enriched:
    """Laps, weather, flag, sector, safety car and positions on session time."""
    return _apart(note_session_frames(incidents, meta, laps, messages, weather, numbers, tolerance))


def note_session_frames(incidents: DataFrame, meta: DataFrame, laps: DataFrame, messages: DataFrame,
                        weather: DataFrame, numbers: DataFrame, tolerance: float = MATCH_TOLERANCE_SECONDS) -> DataFrame:
    keys = ["_year", "_round", "_session"]

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({"_year": F.col("season").cast("int"), "_round": F.col("round").cast("int"),
                               "_session": F.lower(or_empty("session"))}).drop("season", "round", "session")

    laps, messages, weather = keyed(laps), keyed(messages), keyed(weather)
    side = meta.select("incident_id", "car_number", "time", "session_offset_seconds", "lap_hint")
    rows = lookup.with_meta(incidents, side).withColumns({
        "_year": number("season").cast("int"), "_round": number("round").cast("int"),
        "_session": F.lower(or_empty("session"))})
    seconds = times.incident_seconds("session_offset_seconds", "time")
    rows = rows.withColumn("_at", F.when(seconds >= 0, seconds))
    said = ["Message", "Flag", "Sector"]
    rows = _looked_up(
        rows, keys, numbers, ["_year", "_round"],
        [Feed("lap", laps, "Time", ["LapNumber"], highest=True), Feed("rc", messages, "Time", said, "seq", after=True)],
        Feed("DriverNumber", laps, "Time", [], "LapNumber"), "Position",
        {"_lap": F.col("lap_before"), "_rc": nearest_match("rc", said, tolerance)}, tolerance)
    rows = rows.join(max_laps(laps, keys, "LapNumber"), keys, "left")
    last = weather.groupBy(*keys).agg(F.max_by(F.struct("Rainfall", "TrackStatus"), "Time").alias("_weather"))
    text = F.upper(or_empty("Message"))
    states = messages.groupBy(*keys).agg(
        F.bool_or(text.contains("VIRTUAL SAFETY CAR")).alias("_vsc"),
        F.bool_or(text.contains("SAFETY CAR") & ~text.contains("VIRTUAL SAFETY CAR")).alias("_sc"))
    rows = rows.join(last, keys, "left").join(states, keys, "left")
    hint = F.when(F.coalesce("lap_hint", F.lit(0)) > 0, F.col("lap_hint").cast("string"))
    near = F.col("_rc").isNotNull()
    w = F.col("_weather")
    overall = F.when(F.col("_sc"), "safety_car").when(F.col("_vsc"), "vsc").when(F.col("_sc").isNotNull(), "none")
    updates = {
        "full_laps": F.col("_max_lap"),
        "track_conditions": F.when(w.isNotNull(), track_condition(w["Rainfall"], w["TrackStatus"])),
        "weather_conditions": F.when(w.isNotNull(), weather_condition(w["Rainfall"])),
        "lap": F.coalesce(hint, F.col("_lap").cast("string")),
        "flag": F.nullif(F.when(near, flag_state("_rc.Flag", "_rc.Message")), F.lit("")),
        "sector": F.nullif(F.when(near, track_sector("_rc.Sector", "_rc.Message")), F.lit("")),
        POSITIONS: F.col("_positions"),
        "safety_car": F.when(F.col("_at").isNull(), overall).when(near, safety_car_state("_rc.Message")),
    }
    new = records("session_frames", 5, {
        c: (is_blank(F.col(f"`{c}`")) & v.isNotNull(), {"value": v, "round": F.col("_round")}) for c, v in updates.items()})
    return _noted(fill_columns(rows.withColumn(NEW, new), updates), incidents, F.col(NEW))


def enrich_points(incidents: DataFrame, dates: DataFrame) -> Enriched:
    """License points held before each incident; ``dates(incident_id, date)``."""
    return _apart(note_points(incidents, dates))


def note_points(incidents: DataFrame, dates: DataFrame) -> DataFrame:
    rows = incidents.join(dates.select("incident_id", "date"), "incident_id", "left")
    before = points.points_before(rows).withColumnRenamed("superlicense_points_before_incident", "_before")
    rows = incidents.join(before, "incident_id", "left")
    new = records("corpus_rolling", 6, {"superlicense_points_before_incident": (
        or_empty("_before") != "", {"value": F.col("_before"), "season": F.col("season")})})
    rows = rows.withColumn(NEW, new).withColumn(
        "superlicense_points_before_incident", F.coalesce("_before", "superlicense_points_before_incident"))
    return _noted(rows, incidents, F.col(NEW))


def enrich_text(incidents: DataFrame, meta: DataFrame, docs: DataFrame,
                min_confidence: float = FAULT_MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Party at fault and severity suggestions from the document text.

    Returns incidents, provenance and the suggestion columns for the meta table.
    """
    rows = note_text(incidents, meta, docs, min_confidence)
    return (*_apart(rows.drop(*SUGGESTIONS)), rows.select("incident_id", *SUGGESTIONS))


def note_text(incidents: DataFrame, meta: DataFrame, docs: DataFrame, min_confidence: float = FAULT_MIN_CONFIDENCE) -> DataFrame:
    """The rows, what was written, and the suggestions for the meta table."""
    body = docs.select("document_id", *[F.col(f"parsed_fields.{c}").alias(f"_{c}") for c in ("fact", "reason", "decision")])
    rows = lookup.with_meta(incidents, meta.select("incident_id", "document_id")).join(body, "document_id", "left")
    rows = rows.withColumns({
        "_fault": infer_fault("_fact", "_reason", "_decision", split_drop("drivers")),
        "_sev": suggest_severity("_fact", "_reason", "_decision", "penalty")})
    fault, sure = F.col("_fault.value"), F.col("_fault.confidence")
    write = (fault != "") & (sure >= min_confidence) & is_blank("driver_at_fault")
    new = records("text_fields", 7, {
        "driver_at_fault": (fault != "", {"value": fault, "confidence": sure, "suggestion_only": F.when(~write, "true")}),
        "severity": (F.lit(True), {"value": F.col("_sev.value"), "confidence": F.col("_sev.confidence"),
                                   "suggestion_only": (~is_blank("severity")).cast("string")})})
    rows = rows.withColumns({
        NEW: new, "driver_at_fault_suggestion": fault, "driver_at_fault_confidence": sure,
        "severity_suggestion": F.col("_sev.value"), "severity_confidence": F.col("_sev.confidence")})
    rows = rows.withColumn("driver_at_fault", F.when(write, fault).otherwise(F.col("driver_at_fault")))
    return rows.select(*[F.col(f"`{c}`") for c in incidents.columns], NEW, *SUGGESTIONS)


@dataclass(frozen=True)
class Sources:
    """Everything the stages look things up in; the columns are those of the single jobs."""

    circuits: DataFrame
    drivers: DataFrame
    teams: DataFrame
    seasons: Mapping[str, DataFrame]
    calendar: DataFrame
    standings: DataFrame
    team_standings: DataFrame
    results: DataFrame
    schedule: DataFrame
    local_rounds: DataFrame
    sessions: DataFrame
    feed: Mapping[str, DataFrame]
    frames: Mapping[str, DataFrame]
    feed_numbers: DataFrame
    frame_numbers: DataFrame
    documents: DataFrame


@dataclass(frozen=True)
class EnrichedCorpus:
    incidents: DataFrame
    meta: DataFrame
    provenance: DataFrame


def enrich_all(incidents: DataFrame, meta: DataFrame, sources: Sources, tolerance: float = MATCH_TOLERANCE_SECONDS,
               first_season: int = FEED_FIRST_SEASON) -> EnrichedCorpus:
    """All stages as one job over incident rows and their meta rows, one of each per incident id.

    A row carries its records through the stages; each stage ends with one reliable cut, so a lost executor repeats one
    stage at most. Timestamps add to the meta rows on the way, text fields at the end. The provenance has the last write of
    each field; what the timestamps say is recorded last.
    """
    def next_stage(noted: DataFrame) -> DataFrame:
        return cut_lineage(noted.withColumn("_records", F.concat("_records", NEW)).drop(NEW))

    rows = quality.conform(incidents).withColumn("season", F.col("season").cast("int")).withColumn("_records", F.array().cast(RECORDS))
    rows = cut_lineage(enrich_reference(rows, meta, sources.circuits, sources.drivers, sources.teams, sources.seasons))
    rows = next_stage(note_standings(rows, meta, sources.calendar, sources.standings, sources.team_standings, sources.results, sources.teams))
    fetched = match.ranked_rounds(lookup.with_meta(rows, meta.select("incident_id", "event")), sources.calendar)
    side = cut_lineage(enrich_timestamps(rows, meta, sources.schedule, sources.local_rounds, fetched))
    rows = next_stage(note_feed(rows, side, sources.sessions, sources.feed["laps"], sources.feed["messages"], sources.feed["positions"],
                                sources.feed_numbers, tolerance, first_season))
    rows = next_stage(note_session_frames(rows, side, sources.frames["laps"], sources.frames["messages"], sources.frames["weather"],
                                          sources.frame_numbers, tolerance))
    rows = next_stage(note_points(rows, side.select("incident_id", times.parse_date("date").alias("date"))))
    rows = next_stage(note_text(rows, side, sources.documents))
    side = side.join(rows.select("incident_id", *SUGGESTIONS), "incident_id", "left")
    written = unfolded(rows, "_records").unionByName(timestamp_provenance(side))
    return EnrichedCorpus(rows.drop("_records", *SUGGESTIONS), side, latest_provenance(written))
