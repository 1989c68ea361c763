"""Dates and survey weeks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from resight.functions.mathx import as_col

def parse_date(text, order: str = "dmy") -> Column:
    """A date from day, month and year in the given order; anything else is null, never an error.

    Separators may be ``-``, ``/``, ``.`` or blanks, the month a number or a three-letter
    name, the year two (69 to 99 are in the 1900s) or four
    digits. The text is brought to one spelling first, so each
    value is parsed once and a wrong pattern is never tried.
    """
    text = F.regexp_replace(F.trim(as_col(text)), r"[/. ]+", "-")
    text = F.regexp_replace(text, r"-(69|[7-9]\d)$", "-19$1")
    text = F.regexp_replace(text, r"-([0-6]\d)$", "-20$1")
    numeric = {"dmy": "d-M-yyyy", "mdy": "M-d-yyyy"}[order]
    named = {"dmy": "d-MMM-yyyy", "mdy": "MMM-d-yyyy"}[order]
    return F.when(F.rlike(text, F.lit("[A-Za-z]")), F.try_to_date(text, named)).otherwise(F.try_to_date(text, numeric))


def week_sunday(d) -> Column:
    """Week of the year counted from Sundays; days before the first Sunday are week 0."""
    d = as_col(d)
    return F.floor((F.dayofyear(d) + 7 - F.dayofweek(d)) / 7).cast("int")


def week_block(d) -> Column:
    """Week of the year as seven-day blocks from 1 January; the first block is 1."""
    return (F.floor((F.dayofyear(as_col(d)) - 1) / 7) + 1).cast("int")


def week_rollover(week, pivot: int = 20, add: int = 52) -> Column:
    """Weeks before ``pivot`` close the previous season."""
    week = as_col(week)
    return F.when(week < pivot, week + add).otherwise(week)
