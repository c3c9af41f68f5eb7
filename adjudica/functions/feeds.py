"""Race-feed vocabulary: flags, sectors, safety car, session types."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from adjudica.functions.blanks import as_col, or_empty, strip
from adjudica.functions.text import contains_any


def flag_state(flag: Column | str, message: Column | str) -> Column:
    text = F.upper(F.concat(or_empty(flag), F.lit(" "), or_empty(message)))
    return (
        F.when(text.contains("DOUBLE YELLOW"), "double_yellow")
        .when(text.contains("YELLOW"), "yellow")
        .when(text.contains("RED"), "red")
        .when(contains_any(text, ["VIRTUAL SAFETY CAR", "VSC"]), "vsc")
        .when(text.contains("SAFETY CAR") | (strip(text) == "SC"), "safety_car")
        .when(text.contains("BLUE"), "blue")
        .when(text.contains("GREEN"), "green")
        .when(contains_any(text, ["CHEQUERED", "CHECKERED"]), "chequered")
        .otherwise("")
    )


def track_sector(sector: Column | str, message: Column | str) -> Column:
    """Sector 1-3 from the value, the message, or the mini-sector number."""
    value = as_col(sector).cast("string")
    named = F.regexp_extract_all(F.upper(or_empty(message)), F.lit(r"\bSECTOR\s*([123])\b"), F.lit(1))
    mini = F.when(value.rlike(r"^\s*[+-]?\d+\s*$"), value.try_cast("int"))
    third = F.when(mini.isNotNull(), F.least(F.floor((mini - 1) / 8) + 1, F.lit(3)).cast("string"))
    return (
        F.when(value.isin("1", "2", "3"), value)
        .when(F.size(named) > 0, F.array_min(named))
        .when(mini.between(1, 3), mini.cast("string"))
        .otherwise(F.coalesce(third, F.lit("")))
    )


def safety_car_state(message: Column | str) -> Column:
    text = F.upper(or_empty(message))
    return (
        F.when(text.contains("VIRTUAL SAFETY CAR"), "vsc")
        .when(text.contains("SAFETY CAR"), "safety_car")
        .otherwise("none")
    )


def session_type(session: Column | str) -> Column:
    text = F.lower(or_empty(session))
    return (
        F.when(text == "race", "Race").when(text == "qualifying", "Qualifying")
        .when(text == "practice", "Practice 1").when(text == "sprint", "Sprint")
        .otherwise(or_empty(session))
    )


def track_condition(rainfall: Column, status: Column | str) -> Column:
    wet = F.coalesce(rainfall.cast("boolean"), F.lit(False)) | F.lower(or_empty(status)).contains("wet")
    return F.when(wet, "wet").otherwise("dry")


def weather_condition(rainfall: Column) -> Column:
    return F.when(F.coalesce(rainfall.cast("boolean"), F.lit(False)), "rain").otherwise("sunny")
