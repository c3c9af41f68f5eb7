"""Incident times, dates and session offsets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from adjudica.constants import MATCH_TOLERANCE_SECONDS
from adjudica.functions.blanks import as_col, or_empty, strip

_CLOCK = r"^(\d{1,2}):(\d{2})(?::(\d{2}))?\b"
_ELAPSED = r"^(\d{1,2}):(\d{2}):(\d{2})\b"
_INLINE = r"(?i)\bat\s+(\d{1,2}):(\d{2}):(\d{2})\b"
_LAP = r"(?i)\blap\s*(\d{1,3})\b"
# Accepted date layouts, in order.
_DATE_LAYOUTS = ("d MMMM yyyy", "d MMM yyyy", "yyyy-M-d", "d/M/yyyy")


def _time_struct(method: str, text: Column, pattern: str | None, confidence: float,
                 lap: Column | None = None) -> Column:
    def part(index: int) -> Column:
        if pattern is None:
            return F.lit(0)
        return F.coalesce(F.regexp_extract(text, pattern, index).try_cast("int"), F.lit(0))

    return F.struct(
        F.lit(method).alias("method"),
        part(1).alias("hours"),
        part(2).alias("minutes"),
        part(3).alias("seconds"),
        (lap if lap is not None else F.lit(None)).cast("int").alias("lap_hint"),
        F.lit(confidence).cast("double").alias("confidence"),
    )


def parse_time_text(raw: Column | str) -> Column:
    """Struct of method, h/m/s, lap hint and confidence; NULL when nothing matches."""
    text = strip(or_empty(raw))
    lap = F.regexp_extract(text, _LAP, 1)
    return (
        F.when(lap != "", _time_struct("lap_hint", text, None, 0.85, lap.try_cast("int")))
        .when(text.rlike(_ELAPSED), _time_struct("session_elapsed", text, _ELAPSED, 0.9))
        .when(text.rlike(_CLOCK), _time_struct("document_clock", text, _CLOCK, 0.55))
        .when(text.rlike(_INLINE), _time_struct("session_elapsed", text, _INLINE, 0.75))
    )


def parse_date(raw: Column | str) -> Column:
    text = strip(or_empty(raw))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(layout)) for layout in _DATE_LAYOUTS]).cast("date")


def seconds_of(ts: Column | str) -> Column:
    """Instant as epoch seconds with fractions (naive values read in the session zone)."""
    return as_col(ts).cast("timestamp").cast("double")


def session_offset(parsed: Column, session_start: Column, incident_date: Column,
                   max_error_seconds: float = MATCH_TOLERANCE_SECONDS) -> Column:
    """Struct (offset, confidence): seconds into the session and scaled confidence."""
    limit = max_error_seconds * 120
    clock = (parsed["hours"] * 3600 + parsed["minutes"] * 60 + parsed["seconds"]).cast("double")
    from_clock = seconds_of(incident_date) + clock - seconds_of(session_start)
    is_elapsed = parsed["method"] == "session_elapsed"
    is_clock = (parsed["method"] == "document_clock") & session_start.isNotNull() & incident_date.isNotNull()
    offset = F.when(is_elapsed, clock).when(is_clock, from_clock)
    valid = F.coalesce(offset.between(0, limit), F.lit(False))
    factor = (
        F.when(valid, 1.0).when(is_elapsed, 0.5).when(is_clock, 0.35).otherwise(0.25)
    )
    return F.when(parsed.isNotNull(), F.struct(
        F.when(valid, offset).alias("offset"),
        (parsed["confidence"] * factor).alias("confidence"),
    ))


def add_seconds(start: Column, offset: Column) -> Column:
    """``start`` plus a possibly fractional number of seconds."""
    return start + F.make_dt_interval(secs=offset.cast("decimal(18,6)"))


def clock_to_seconds(value: Column | str, legacy: bool = False) -> Column:
    """``H:MM`` or ``H:MM:SS[.f]`` to seconds; ``legacy`` adds the minutes unscaled."""
    text = strip(or_empty(value))
    short, long = r"^\s*(\d+)\s*:\s*(\d+)\s*$", r"^\s*(\d+)\s*:\s*(\d+)\s*:\s*(\d+(?:\.\d*)?|\.\d+)\s*$"

    def part(pattern: str, index: int) -> Column:
        return F.regexp_extract(text, pattern, index).try_cast("double")

    return (
        F.when(text.rlike(short), part(short, 1) * 3600 + part(short, 2) * (1 if legacy else 60))
        .when(text.rlike(long), part(long, 1) * 3600 + part(long, 2) * 60 + part(long, 3))
    )


def incident_seconds(offset: Column | str, raw_time: Column | str) -> Column:
    return F.coalesce(as_col(offset).cast("double"), clock_to_seconds(raw_time))


def schedule_instant(date: Column | str, time: Column | str) -> Column:
    clock = F.replace(or_empty(time), F.lit("Z"), F.lit(""))
    text = F.concat(or_empty(date), F.lit("T"), clock)
    return F.when(or_empty(date) != "", F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def schedule_key(session: Column | str) -> Column:
    text = F.lower(or_empty(session))
    return (
        F.when(text == "race", "Race").when(text == "qualifying", "Qualifying")
        .when(text == "practice", "FirstPractice").when(text == "sprint", "Sprint")
    )
