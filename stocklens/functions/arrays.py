"""Small dense vectors and matrices as array columns (lists of doubles, row by row)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside a lambda."""
    return F.transform(F.array(value), body)[0]


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def add_outer(m: Column, v: Column) -> Column:
    """``m`` plus the products of all pairs of entries of ``v``."""
    return F.zip_with(m, v, lambda row, a: F.zip_with(row, v, lambda x, b: x + a * b))


def sweep(m: Column, k: Column) -> Column:
    """The symmetric sweep of a cross-product matrix on pivot ``k``: after sweeping a set S the
    rows of S hold the regression on S (coefficients in the other columns, minus the inverse
    in the columns of S), the other rows the residual products."""
    return let(F.get(F.get(m, k), k), lambda d: let(F.get(m, k), lambda pivot: F.transform(m, lambda row, i: let(
        F.get(row, k) / d, lambda f: F.transform(row, lambda v, j: F.when((i == k) & (j == k), F.lit(-1.0) / d)
                                                 .when((i == k) | (j == k), v / d).otherwise(v - f * F.get(pivot, j)))))))
