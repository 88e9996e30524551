"""Type coercion for mixed-quality input columns (CLN-01..03)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

# Days between the spreadsheet epoch (1899-12-30) and the Unix epoch.
_SHEET_EPOCH_OFFSET = 25569
# Numbers below this are spreadsheet serials (9999-12-31); those above the second limit lie
# beyond the contract's nanosecond timestamps and are null.
_SHEET_SERIAL_END = 2958466
_SHEET_SERIAL_MAX = 106751.99116730064
# Serial 60 is the non-existent 1900-02-29.
_SHEET_SERIAL_BAD = 60
# A number is read as Unix seconds when it is this close to now.
_UNIX_WINDOW_SECONDS = 1e10
# First and last day of the contract's nanosecond timestamps.
_FIRST_DAY, _LAST_DAY = "1677-09-22", "2262-04-11"
# Text that is a number; anything else (such as '12d') is none.
_NUMBER_TEXT = r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$|^[+-]?inf(inity)?$"


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _kind(dtype) -> str:
    """'int', 'num' (fractional), 'text' or 'any' (unknown: take the generic text path)."""
    if isinstance(dtype, _INTEGRAL):
        return "int"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "num"
    if isinstance(dtype, T.StringType):
        return "text"
    return "any"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _try_double(c: Column) -> Column:
    # try_cast through text handles text, numbers and nulls uniformly.
    s = F.trim(c.cast("string"))
    return F.when(s.rlike(_NUMBER_TEXT), s.try_cast("double"))


def num_or_null(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """Number or null (NaN is null); ANSI-safe. Typed numeric input skips the text path."""
    c = _col(c)
    v = c.cast("double") if _kind(dtype) in ("int", "num") else _try_double(c)
    return F.when(~F.isnan(v), v)


def num0(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """CLN-01: unparsable or null becomes 0."""
    c = _col(c)
    if _kind(dtype) not in ("int", "num"):
        return F.coalesce(_try_double(c), F.lit(0.0))      # no text gives NaN; parsed once
    v = c.cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(v)


def key_int(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """CLN-02: invoice ids as nullable bigint ('12', 12.0 and '12.0' all give 12)."""
    c = _col(c)
    kind = _kind(dtype)
    if kind == "int":
        return c.cast("long")
    v = c.cast("double") if kind == "num" else _try_double(c)
    whole = F.when(v.isNotNull() & ~F.isnan(v) & (F.rint(v) == v), v.try_cast("long"))
    if kind == "num":
        return whole
    # text of digits goes straight to bigint: doubles hold 53 bits only
    return F.coalesce(F.trim(c.cast("string")).try_cast("long"), whole)


def key_text(c: Column | str, null_text: str | None = None, dtype: T.DataType | None = None) -> Column:
    """CLN-02 + D5/D6: ids as text; whole numbers as plain integer text.

    ``null_text`` replaces a null key (products use ``'nan'``)."""
    c = _col(c)
    kind = _kind(dtype)
    if kind == "int":
        s = c.cast("string")
    elif kind == "num":
        v = c.cast("double")
        whole = F.when(~F.isnan(v) & (F.rint(v) == v), v.try_cast("long"))
        s = F.coalesce(whole.cast("string"), c.cast("string"))
    else:
        s = F.regexp_replace(F.trim(c.cast("string")), r"^(-?\d+)\.0+$", "$1")
    if null_text is not None:
        s = F.coalesce(s, F.lit(null_text))
    return s


def _parse_text_date(s: Column) -> Column:
    """Text dates in a fixed order of formats; anything else is null."""
    s = F.trim(s)
    digits = s.rlike(r"^\d+$")
    by_format = F.coalesce(
        s.try_cast("timestamp"),                       # ISO date / date-time / yyyy-MM
        F.try_to_timestamp(s, F.lit("M/d/yyyy")),
        F.try_to_timestamp(s, F.lit("d/M/yyyy")),
        F.try_to_timestamp(s, F.lit("M/d/yyyy H:m:s")),
        F.try_to_timestamp(s, F.lit("d/M/yyyy H:m:s")),
        F.try_to_timestamp(s, F.lit("MMM d yyyy")),
        F.try_to_timestamp(s, F.lit("MMM d, yyyy")),
        F.try_to_timestamp(s, F.lit("d MMM yyyy")),
    )
    by_digits = (
        F.when(F.length(s) == 8, F.try_to_timestamp(s, F.lit("yyyyMMdd")))
        .when(F.length(s) == 4, F.try_to_timestamp(s, F.lit("yyyy")))
    )
    return _in_range(F.when((s == "") | s.isNull(), F.lit(None).cast("timestamp"))
                     .when(digits, by_digits)
                     .otherwise(by_format))


def _in_range(ts: Column) -> Column:
    """Null outside the contract's timestamps."""
    return F.when(ts.cast("date").between(F.lit(_FIRST_DAY).cast("date"), F.lit(_LAST_DAY).cast("date")), ts)


def _parse_number_date(x: Column, now: Column) -> Column:
    """Spreadsheet serial (fraction kept) or Unix seconds near ``now``; else null."""
    micros_per_day = 86400 * 1_000_000
    # Both encodings give naive wall-clock times (UTC wall clock); keep that wall clock
    # whatever the session time zone is.
    wall = lambda micros: F.to_utc_timestamp(F.timestamp_micros(micros), F.current_timezone())
    sheet = wall(F.round((x - F.lit(_SHEET_EPOCH_OFFSET)) * F.lit(micros_per_day)).cast("long"))
    unix = wall(F.round(x * F.lit(1_000_000)).cast("long"))
    now_s = F.unix_micros(now.cast("timestamp")) / F.lit(1_000_000)
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(None).cast("timestamp"))
        .when((x > 1) & (x < _SHEET_SERIAL_END),
              F.when((x != _SHEET_SERIAL_BAD) & (x < _SHEET_SERIAL_MAX), sheet))
        .when(F.abs(x - now_s) < _UNIX_WINDOW_SECONDS, _in_range(unix))
    )


def parse_mixed_date(c: Column | str, dtype: T.DataType, now: Column | None = None) -> Column:
    """CLN-03: parse a date column of any input type to a timestamp (null when unparsable).
    ``now`` (default: the clock) is what Unix seconds must be near.

    ``dtype`` is the column's input type (Spark columns are typed, so the branch is
    chosen once per column instead of per value)."""
    c = F.col(c) if isinstance(c, str) else c
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    if isinstance(dtype, _NUMERIC):
        return _parse_number_date(c.cast("double"), F.current_timestamp() if now is None else now)
    return _parse_text_date(c.cast("string"))
