"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column | str) -> Column:
    """A double with NaN turned into null."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def day_number(c: Column | str) -> Column:
    """Days since 1970-01-01."""
    return F.datediff(F.col(c) if isinstance(c, str) else c, F.lit("1970-01-01").cast("date"))


def minute_number(c: Column | str) -> Column:
    """Whole minutes since 1970-01-01 00:00 of a timestamp, as the clock shows it."""
    c = F.col(c) if isinstance(c, str) else c
    return day_number(c.cast("date")).cast("long") * 1440 + F.hour(c) * 60 + F.minute(c)


def minute_text(c: Column) -> Column:
    """``YYYY-MM-DD HH:MM`` of a minute number."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c / 1440).cast("int"))
    rest = F.pmod(c, F.lit(1440))
    hour, minute = F.floor(rest / 60).cast("string"), F.pmod(rest, F.lit(60)).cast("string")
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), F.lpad(hour, 2, "0"), F.lit(":"), F.lpad(minute, 2, "0"))


def iso(c: Column | str) -> Column:
    """``YYYY-MM-DD`` of a date."""
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd")
