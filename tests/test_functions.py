"""Text, time, feed and scoring expressions on hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from adjudica.functions import blanks, feeds, scoring, text as tx, times
from adjudica.functions.multi import split_drop, split_keep
from adjudica.operators.documents import parse_documents

DECISION = """From
The Stewards
Document
39
Date
01 December 2019
Time
18:21
2019 ABU DHABI GRAND PRIX
28 November - 1 December 2019
The Stewards have considered the following matter.
No / Driver
88 - Robert Example
Competitor
Example Racing
Time
17:52
Session
Race
Fact
Incident between car 99 and car 88 in turn 12.
Offence
Alleged breach of Chapter IV Article 2 of the
Code.
Decision
No further action.
Reason
The Stewards determined that no driver was wholly or
predominantly to blame.
Competitors are reminded of their right to appeal.
"""
lit = F.lit


def test_decision_text(spark):
    raw = spark.createDataFrame([("d1", "e", 2019, "Doc 39 - Decision - Car 88", DECISION)],
                                "document_id string, event string, season int, title string, raw_text string")
    doc = parse_documents(raw).first()
    f = doc.parsed_fields
    assert (f.car_number, f.driver_name, f.session, f.penalty) == ("88", "Robert Example", "race", "no_further_action")
    assert (f.driver_at_fault, f.turn_number, f.opponent_car_numbers) == ("none", "12", ["99"])
    assert f.offence == "Alleged breach of Chapter IV Article 2 of the Code."
    assert f.reason.endswith("predominantly to blame.") and f.grand_prix == "ABU DHABI GRAND PRIX"
    assert f.time.startswith("18:21") and f.incident_time == "17:52"
    assert doc.document_type == "decision" and doc.parse_confidence == 1.0 and doc.parse_errors == []


@pytest.mark.parametrize("text,label", [
    ("A 3 place grid penalty will be applied.", "3_place_grid_drop"), ("10 second time penalty", "10s_time_penalty"),
    ("Drop to the back of the grid, last place", "grid_penalty"), ("Drive through penalty", "drive_through"), ("", ""),
    ("Reprimand and a warning", "reprimand"), ("Fine of 500", "fine_of_500")])
def test_penalty_label(one, text, label):
    assert one(tx.penalty_label(lit(text))) == label


def test_titles(one):
    assert one(tx.document_type(lit("Doc 52 - Infringement - Car 18 - x"))) == "infringement"
    included = lambda t: one(tx.title_included(lit(t), ("Decision",), ("Starting Grid", "Provisional")))
    assert included("Decision - Car 4.pdf") and included("Provisional Decision") and not included("Indecision")
    assert not included("Decision Starting Grid") and included("Decision Starting Grid correction")


def test_odd_spaces(one):
    assert one(tx.normalize_text(lit("  a� b \n"))) == "a b"
    assert one(blanks.is_blank(lit(" NaN "))) and not one(blanks.is_missing(lit("nan"))) and one(blanks.is_blank(lit(None)))
    assert one(blanks.number(lit("nan"))) is None and one(blanks.number(lit(" 1e2 "))) == 100.0 and one(blanks.number(lit("1d"))) is None


@pytest.mark.parametrize("raw,method,confidence,lap", [
    ("18:21 2019 GP", "document_clock", 0.55, None), ("1:23:45", "session_elapsed", 0.9, None),
    ("Incident on lap 37 of 50", "lap_hint", 0.85, 37), ("seen at 0:01:02", "session_elapsed", 0.75, None)])
def test_time_text(one, raw, method, confidence, lap):
    got = one(times.parse_time_text(lit(raw)))
    assert (got.method, got.confidence, got.lap_hint) == (method, confidence, lap)


def test_unparsed_time(one):
    assert one(times.parse_time_text(lit("soon"))) is None


@pytest.mark.parametrize("raw", ["1 December 2019", "01 Dec 2019", "2019-12-1", "1/12/2019"])
def test_dates(one, raw):
    assert str(one(times.parse_date(lit(raw)))) == "2019-12-01"


def test_session_offsets(one):
    start, day = lit("2019-12-01 17:10:00").cast("timestamp"), lit("2019-12-01").cast("date")
    elapsed = one(times.session_offset(times.parse_time_text(lit("0:45:10")), lit(None).cast("timestamp"), lit(None).cast("date")))
    assert (elapsed.offset, elapsed.confidence) == (2710.0, 0.9)
    clock = one(times.session_offset(times.parse_time_text(lit("18:21")), start, day))
    assert (clock.offset, clock.confidence) == (4260.0, 0.55)
    early = one(times.session_offset(times.parse_time_text(lit("16:00")), start, day))
    assert early.offset is None and early.confidence == pytest.approx(0.55 * 0.35)
    assert one(times.clock_to_seconds(lit("1:30"))) == 5400 and one(times.clock_to_seconds(lit("1:30"), legacy=True)) == 3630


def test_feed_states(one):
    assert one(feeds.flag_state(lit("YELLOW"), lit(""))) == "yellow"
    assert one(feeds.track_sector(lit("17"), lit("YELLOW IN TRACK SECTOR 17"))) == "3"
    assert one(feeds.track_sector(lit(None), lit("clear"))) == "" and one(feeds.track_sector(lit("x"), lit("Sector 2"))) == "2"
    assert one(feeds.safety_car_state(lit("Virtual safety car deployed"))) == "vsc"


@pytest.mark.parametrize("value,stage", [(10, "early"), (33, "early"), (50, "middle"), (66, "middle"), (80, "late"), (90, "final_laps"), (None, None)])
def test_race_stage(one, value, stage):
    assert one(scoring.race_stage(lit(value).cast("double"))) == stage


@pytest.mark.parametrize("penalty,label", [("no_further_action", 0), ("5s_time_penalty", 1), ("reprimand", 1), ("3_place_grid_penalty", 2),
                                           ("disqualification", 2), ("", None), ("unknown", None)])
def test_penalty_severity(one, penalty, label):
    assert one(scoring.penalty_severity(lit(penalty))) == label


def test_substring_classes(one):
    # "15s" contains "5s" unless whole words are asked for.
    assert one(scoring.penalty_severity(lit("15s"))) == 1 and one(scoring.penalty_severity(lit("15s"), whole_words=True)) is None


def test_fault_and_severity(one):
    drivers = F.array(lit("car_63"), lit("someone"))
    fault = lambda f, r, d="": tuple(one(scoring.infer_fault(lit(f), lit(r), lit(d), drivers)))
    assert fault("Car 44 was wholly to blame for the collision with Car 63.", "") == ("car_44", 0.86)
    assert fault("This was a racing incident.", "No driver was wholly or predominantly to blame.") == ("none", 0.88)
    assert fault("He caused a collision", "") == ("someone", 0.78) and fault("", "") == ("", 0.0)
    got = one(scoring.suggest_severity(lit("dangerous"), lit(""), lit(""), lit("5s_time_penalty")))
    assert (got.value, got.confidence) == (5, 0.85)


def test_null_bounds(one):
    assert one(scoring.years_in_sport(lit(2020), lit("x"))) is None and one(scoring.years_in_sport(lit(2020), lit("2025"))) == 0
    assert one(scoring.points_remaining(lit(None), lit(19), 25)) is None and one(scoring.points_remaining(lit(3), lit(19), 25)) == 400.0


def test_split_dialects(one):
    assert one(split_keep(lit("a, ,b"))) == ["a", "", "b"] and one(split_drop(lit("a, ,b"))) == ["a", "b"]
    assert one(split_keep(lit(" "))) == [] and one(split_drop(lit(None))) == []
