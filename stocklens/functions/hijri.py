"""The tabular Islamic calendar as column expressions: date to (year, month, day) and back.

Days are numbered from 1 Muharram 1 (0622-07-19 in the proleptic Gregorian calendar). A cycle
of 30 years has 10,631 days: 354 a year and eleven leap days, in the years y with
(11 y + 14) mod 30 < 11; months have 30 and 29 days in turn, the last one a day more in leap
years. All arithmetic is on whole numbers, so it is exact for every date; dates before the
epoch have no Islamic date (null). Sighted calendars can differ by a day or two.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPOCH = -492148           # 0622-07-19 as days from 1970-01-01
CYCLE = 10631             # days of 30 years


def _whole(c: Column) -> Column:
    return F.floor(c).cast("int")


def day_number(year: Column, month: Column, day: Column) -> Column:
    """Days from 1970-01-01 to an Islamic date."""
    leaps = _whole((year * 11 + 3) / F.lit(30))
    months = _whole((month * 59 - 58) / F.lit(2))          # 30 and 29 days in turn
    return F.lit(EPOCH) + (year - 1) * 354 + leaps + months + day - 1


def hijri_date(year: Column, month: Column, day: Column) -> Column:
    """The date of an Islamic year, month and day."""
    return F.date_add(F.lit("1970-01-01").cast("date"), day_number(year, month, day).cast("int"))


def hijri(date: Column) -> Column:
    """struct(year, month, day) of a date; null before the epoch."""
    n = F.unix_date(date) - EPOCH
    year = _whole((n * 30 + 10646) / F.lit(CYCLE))
    into = F.unix_date(date) - day_number(year, F.lit(1), F.lit(1))
    month = F.least(F.lit(12), _whole(into * 2 / F.lit(59)) + 1)
    day = F.unix_date(date) - day_number(year, month, F.lit(1)) + 1
    return F.when(n >= 0, F.struct(year.alias("year"), month.alias("month"), day.cast("int").alias("day")))
