"""Labels, buckets and rounding (ANL-03/04/06/11)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, functions as F

from stocklens import params


def round_half_even(c: Column | str, digits: int = 2) -> Column:
    """numpy-style rounding: ``rint(x * 10^d) / 10^d`` (ties to even on the scaled value).
    Same bits as the pandas contract and as any engine doing the same IEEE steps."""
    c = F.col(c) if isinstance(c, str) else c
    k = float(10 ** digits)
    return F.rint(c.cast("double") * F.lit(k)) / F.lit(k)


def whole_days_between(lo: Column, hi: Column) -> Column:
    """floor((hi - lo) / 1 day) on the wall clock (DST-safe), as bigint."""
    tod = lambda c: F.date_format(c, "HH:mm:ss.SSSSSS")
    return (F.datediff(hi.cast("date"), lo.cast("date")) - F.when(tod(hi) < tod(lo), 1).otherwise(0)).cast("long")


def efficiency_bucket(ratio: Column | str) -> Column:
    """ANL-04: [0,0.8) / [0.8,1.2) / [1.2,inf) ; null or negative gives N/A."""
    r = F.col(ratio) if isinstance(ratio, str) else ratio
    b = params.EFFICIENCY_BINS
    lab = params.EFFICIENCY_LABELS
    expr = F.when(r.isNull() | (r < b[0]), F.lit(params.EFFICIENCY_NA))
    for lo, hi, name in zip(b[:-1], b[1:], lab):
        expr = expr.when((r >= lo) & (r < hi), F.lit(name))
    return expr.otherwise(F.lit(params.EFFICIENCY_NA))


def stagnant_bucket(days: Column | str) -> Column:
    """ANL-11: [90,180) 3-6 months, [180,365) 6-12 months, [365,inf) >1 year."""
    d = F.col(days) if isinstance(days, str) else days
    b = params.STAGNANT_BINS
    expr = None
    for lo, hi, name in zip(b[:-1], b[1:], params.STAGNANT_LABELS):
        cond = (d >= lo) & (d < hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def as_of_lit(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = _dt.date.fromisoformat(as_of)
    if isinstance(as_of, _dt.datetime):
        as_of = as_of.date()
    return F.lit(as_of)


def days_since(last: Column | str, as_of, mode: str = "floor") -> Column:
    """ANL-06: whole days from the last sale to midnight of ``as_of``.

    ``floor``: floored on the timestamp (a sale later on the as_of day gives -1);
    ``date``: plain date difference. Null gives 99999."""
    last = F.col(last) if isinstance(last, str) else last
    day = as_of_lit(as_of).cast("date")
    if mode == "date":
        d = F.datediff(day, last.cast("date"))
    elif mode == "floor":
        # floor((midnight - last) / 1 day) on the wall clock (DST-safe): the date
        # difference, one less when the sale was after midnight
        last_ts = last.cast("timestamp")
        after_midnight = last_ts != last_ts.cast("date").cast("timestamp")
        d = (F.datediff(day, last_ts.cast("date")) - F.when(after_midnight, 1).otherwise(0)).cast("int")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.coalesce(d, F.lit(params.NO_SALE_DAYS))
