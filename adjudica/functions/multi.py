"""Comma-separated cells as arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from adjudica.functions.blanks import as_col, or_empty, strip


def split_keep(value: Column | str) -> Column:
    """Elements trimmed, blanks kept; an empty cell is an empty array."""
    text = strip(or_empty(value))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.split(text, ",", -1), strip))


def count_keep(value: Column | str) -> Column:
    """Number of elements ``split_keep`` gives, without building them."""
    text = or_empty(value)
    return F.when(strip(text) == "", 0).otherwise(F.size(F.split(text, ",", -1)))


def split_drop(value: Column | str) -> Column:
    """Elements trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(or_empty(value), ",", -1), strip), lambda item: item != "")


def join_keep(values: Column | str) -> Column:
    """Array back to a cell; NULL elements become blanks."""
    return F.array_join(as_col(values).cast("array<string>"), ",", "")


def pick(values: Column, index: Column) -> Column:
    """Element at a position; one value serves every position; blank is NULL."""
    return F.nullif(F.when(F.size(values) == 1, F.get(values, F.lit(0)))
                    .otherwise(F.get(values, index)), F.lit(""))
