"""Missing-value tests and lenient casts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from adjudica.constants import FACT_TEXT_FIELDS

# Unicode white space; Java's \s alone is ASCII only.
WS = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WS_CHARS = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    return F.btrim(as_col(value).cast("string"), F.lit(WS_CHARS))


def or_empty(value: Column | str) -> Column:
    return F.coalesce(as_col(value).cast("string"), F.lit(""))


def is_blank(value: Column | str) -> Column:
    """NULL, empty, white space or the text ``nan``."""
    text = F.lower(strip(or_empty(value)))
    return (text == "") | (text == "nan")


def nullify(value: Column | str) -> Column:
    return F.when(~is_blank(value), as_col(value))


def is_missing(value: Column | str) -> Column:
    """Like ``is_blank`` but the text ``nan`` counts as a value."""
    return strip(or_empty(value)) == ""


def number(value: Column | str) -> Column:
    """Text to double; anything unreadable becomes NULL."""
    text = as_col(value).cast("string")
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def whole(value: Column | str) -> Column:
    return number(value).try_cast("int")


def token(value: Column | str) -> Column:
    return F.lower(strip(or_empty(value)))


def bool_to_int(value: Column | str) -> Column:
    """True/"True" -> 1, False/"False" -> 0, else NULL."""
    text = F.initcap(as_col(value).cast("string"))
    return F.when(text == "True", 1).when(text == "False", 0)


def fact_text(df: DataFrame) -> Column:
    """Present text fields of a row joined by a space, in their fixed order."""
    parts = [
        F.when(~is_missing(F.col(name)), F.col(name).cast("string"))
        for name in FACT_TEXT_FIELDS if name in df.columns
    ]
    return F.concat_ws(" ", *parts) if parts else F.lit("")
