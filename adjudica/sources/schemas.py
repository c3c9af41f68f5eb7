"""Explicit schemas of the stored tables and payloads."""

from __future__ import annotations

from pyspark.sql import types as T

from adjudica.constants import INCIDENT_COLUMNS


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


INCIDENT = _strings(*INCIDENT_COLUMNS)

CATALOGUE = "document_id string, url string, local_path string, event string, event_slug string, " \
            "title string, sha256 string, season int"

PARSED_FIELDS = (
    "document_no string, date string, time string, incident_time string, grand_prix string, car_number string, "
    "driver_name string, competitor string, session string, fact string, offence string, decision string, "
    "reason string, opponent_car_numbers array<string>, turn_number string, penalty string, "
    "superlicense_points_added string, mentioned_article string, driver_at_fault string")

DOCUMENT = (
    "document_id string, document_type string, event string, event_slug string, season int, title string, "
    f"raw_text string, parse_confidence double, parse_errors array<string>, parsed_fields struct<{PARSED_FIELDS}>")

META = (
    "incident_id string, event string, car_number string, parse_confidence double, document_id string, "
    "time string, date string")

# Reference dimensions are objects keyed by id.
CIRCUITS = ("map<string, struct<country: string, first_season: int, total_laps: int, event_name: string, "
            "corners: map<string, int>>>")
DRIVERS = "map<string, struct<name: string, nationality: string, debut: string>>"
TEAMS = "map<string, struct<name: string, legacy_ids: array<string>>>"
SEASONS = ("map<string, struct<year: int, rounds: int, calendar_in_order: array<string>, "
           "`drivers.standings_order`: array<struct<id: string, team: string, total_points: int>>, "
           "`teams.standings_order`: array<struct<id: string, total_points: int>>>>")

_DRIVER = "Driver: struct<driverId: string, familyName: string, code: string, nationality: string>"
CALENDAR_PAYLOAD = (
    "MRData struct<RaceTable: struct<season: string, Races: array<struct<round: string, raceName: string, "
    "Circuit: struct<circuitId: string, Location: struct<country: string>>, date: string, time: string, "
    "FirstPractice: struct<date: string, time: string>, Qualifying: struct<date: string, time: string>, "
    f"Sprint: struct<date: string, time: string>, Results: array<struct<number: string, {_DRIVER}>>>>>>")
STANDINGS_PAYLOAD = (
    "MRData struct<StandingsTable: struct<season: string, round: string, StandingsLists: array<struct<"
    f"DriverStandings: array<struct<position: string, positionText: string, points: string, {_DRIVER}, "
    "Constructors: array<struct<constructorId: string>>>>, "
    "ConstructorStandings: array<struct<position: string, points: string, "
    "Constructor: struct<constructorId: string>>>>>>>")

FEEDS = {
    "sessions": "season int, meeting_key int, session_key int, session_type string, session_name string, "
                "country_name string, location string, circuit_short_name string, date_start timestamp",
    "laps": "session_key int, driver_number int, lap_number int, date_start timestamp",
    "position": "session_key int, driver_number int, position int, date timestamp",
    "race_control": "session_key int, date timestamp, flag string, message string, sector string",
    "drivers": "session_key int, driver_number int, full_name string, name_acronym string",
}
SESSION_FRAMES = {
    "laps": "season int, round int, session string, DriverNumber int, LapNumber int, Position int, Time double",
    "messages": "season int, round int, session string, Time double, Message string, Flag string, Sector string",
    "weather": "season int, round int, session string, Time double, Rainfall boolean, TrackStatus string",
}
