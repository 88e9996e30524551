"""Sums of doubles that do not depend on the order of rows.

A double is split into five whole digits of base 2^30, at weights 2^50, 2^20, 2^-10, 2^-40 and
2^-70: digit k is ``rint(x / w_k)`` less the part that the digits above it hold, so it lies
within 2^29 of zero and the digits add up to x, rounded to a multiple of 2^-70 (no rounding at
all from 2^-17 up). Digits are summed as ``bigint``, which is exact and associative; carries
are settled at the end and the total is rounded to a double once: correctly below 2^43, and by
the same rule for any order of rows beyond.

Values from 2^84 (about 1.9e25) count as infinite. Infinities and NaN are summed apart, where
order does not matter either. A sum without values is null. Up to 2^34 rows fit a group even
if all digits have one sign.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

BASE = 30
WEIGHTS = (50, 20, -10, -40, -70)      # binary exponents of the digits, the largest first
LARGEST = 84


def limbs(c: Column | str) -> list[Column]:
    """The five digits of a value, and what is beyond them (0, infinite or NaN)."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    held = F.abs(x) < F.lit(2.0 ** LARGEST)
    out, above = [], None
    for w in WEIGHTS:
        q = F.rint(x * F.lit(2.0 ** -w))
        digit = q if above is None else q - above * F.lit(2.0 ** BASE)
        out.append(F.when(held, digit.cast("bigint")).when(x.isNotNull(), F.lit(0).cast("bigint")))
        above = q
    beyond = F.when(F.isnan(x), x).otherwise(F.signum(x) * F.lit(float("inf")))
    return [*out, F.when(held, F.lit(0.0)).when(x.isNotNull(), beyond)]


def recombine(sums: Sequence[Column]) -> Column:
    """The total as a double, from the sums of the digits."""
    *digits, beyond = sums
    half, base = F.lit(1 << (BASE - 1)).cast("bigint"), F.lit(1 << BASE).cast("bigint")
    settled: list[Column] = []
    carry = None
    for s in reversed(digits[1:]):                  # centred digits: a small total has small digits
        s = s if carry is None else s + carry
        carry = F.shiftright(s + half, BASE)
        settled.append(s - carry * base)
    top = digits[0] + carry
    d4, d3, d2, d1 = settled                        # 2^-70, 2^-40, 2^-10, 2^20
    low = d3 * base + d4                            # in 2^-70
    high = d1 * base + d2                           # in 2^-10
    sticky = F.shiftright(low, 8).bitwiseOR(F.when(low.bitwiseAND(255) != 0, 1).otherwise(0).cast("bigint"))
    small = (high * F.lit(1 << 60).cast("bigint") + low).cast("double") * F.lit(2.0 ** -70)
    large = top.cast("double") * F.lit(2.0 ** 50) + high.cast("double") * F.lit(2.0 ** -10) + sticky.cast("double") * F.lit(2.0 ** -62)
    return F.when((top == 0) & F.abs(high).between(0, 4), small).otherwise(large) + beyond


def exact_squares(c: Column | str) -> Column:
    """Aggregate: the order-free sum of squares, for values up to 2^55, in multiples of 2^-44."""
    x = (F.col(c) if isinstance(c, str) else c) * F.lit(2.0 ** -13)
    return exact_sum(x * x) * F.lit(2.0 ** 26)


def exact_sum(c: Column | str) -> Column:
    """Aggregate: the order-free sum of ``c``."""
    return recombine([F.sum(x) for x in limbs(c)])
