"""Dates and relative times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardloom.reference_data import MONTHS


def date_of(year: Column, month: Column, day: Column) -> Column:
    """A date from whole numbers, null when the parts name no real day."""
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    known = year.isNotNull() & month.isNotNull() & day.isNotNull() & year.between(1, 9999)
    return F.when(known, F.try_to_date(text, "yyyy-MM-dd"))


def whole_number(text: Column) -> Column:
    digits = F.trim(text)
    return F.when(digits.rlike(r"^[+-]?[0-9]{1,9}$"), digits.cast("int"))


def pubmed_date(year: Column, month: Column, day: Column) -> Column:
    """Year needed; month by three-letter name, else January; a day that does not exist gives the 1st."""
    number = whole_number(year)
    by_name = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.coalesce(month, F.lit(""))))
    month_number = F.greatest(by_name.cast("int"), F.lit(1))
    day_number = whole_number(F.coalesce(day, F.lit("1")))
    return F.coalesce(
        date_of(number, month_number, day_number),
        date_of(number, month_number, F.lit(1)),
    )


def dashed_date(text: Column) -> Column:
    """Year, month and day as the first three parts of a dashed text, else null."""
    parts = F.split(F.coalesce(text, F.lit("")), "-")
    piece = [whole_number(F.get(parts, i)) for i in range(3)]
    return date_of(*piece)


def compact_date(text: Column) -> Column:
    """Date of the first eight digits, else null."""
    piece = [whole_number(F.substring(text, start, width)) for start, width in ((1, 4), (5, 2), (7, 2))]
    return F.when(F.length(text) >= 8, date_of(*piece))


# words of a relative time and how many minutes each stands for; a number without a word is minutes
_UNITS = (("d|days?", 1440), ("h|hrs?|hours?", 60), ("m|mins?|minutes?", 1), ("s|secs?|seconds?", 1 / 60))


def offset_minutes(text: Column) -> Column:
    """Minutes of a relative time such as ``T+45min``, ``T+1.5h``, ``T+2h30min`` or ``T+30sec``; null if unreadable."""
    number = r"(\d+(?:\.\d+)?)"
    parts = [rf"(?:{number}\s*(?:{words})\s*)?" for words, _ in _UNITS]
    shape = rf"(?i)^\s*T\s*\+\s*(?:{number}|{''.join(parts)})\s*$"
    minutes = F.lit(0.0)
    for group, factor in enumerate((1, *(factor for _, factor in _UNITS)), 1):
        digits = F.regexp_extract(text, shape, group)
        minutes = minutes + F.when(digits != "", digits.cast("double") * factor).otherwise(0.0)
    return F.when(text.rlike(shape) & text.rlike(r"\d"), minutes)
