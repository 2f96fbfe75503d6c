"""Dates written in several formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed_date(c: Column) -> Column:
    """`d-M-yyyy H:m:s`, `yyyy-M-d` or `d-M-yyyy` as a date; anything else is null."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("d-M-yyyy H:m:s")).cast("date"), F.try_to_timestamp(c, F.lit("yyyy-M-d")).cast("date"), F.try_to_timestamp(c, F.lit("d-M-yyyy")).cast("date"))


def shown_date(c: Column) -> Column:
    """`dd-MM-yyyy` where the text is a date, the text itself otherwise; empty for null."""
    return F.coalesce(F.date_format(parsed_date(c), "dd-MM-yyyy"), c, F.lit(""))


def moved_date(c: Column, days: int) -> Column:
    """The date so many days on (or back), shown as `shown_date` shows it; what is no date stays as it is."""
    return F.coalesce(F.date_format(F.date_add(parsed_date(c), days), "dd-MM-yyyy"), c, F.lit(""))


def list_date(c: Column) -> Column:
    """As `shown_date`, but only `yyyy-MM-dd` counts as a date."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c, F.lit("yyyy-M-d")), "dd-MM-yyyy"), c)
