"""Order-free sums against exact fractions; the Islamic calendar against adding up month lengths."""

import datetime as dt
import math
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from stocklens.functions import exact_sum, limbs, recombine
from stocklens.functions.hijri import hijri, hijri_date
from stocklens.operators import features, forecast

money = st.one_of(st.floats(-1e9, 1e9).map(lambda x: round(x, 2)), st.floats(-1e12, 1e12), st.sampled_from([0.1, 0.2, 1e-9, -1e-9, 1e11, 0.0, -0.0]))


def expected(values):
    total = sum((Fraction(round(Fraction(v) * 2**70), 2**70) for v in values), Fraction(0))
    return float(total)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(money, min_size=1, max_size=12), min_size=1, max_size=30))
def test_sums_are_the_rounded_exact_totals(spark, groups):
    rows = [(g, v) for g, vs in enumerate(groups) for v in vs]
    got = dict(map(tuple, spark.createDataFrame(rows, "g int, v double").groupBy("g").agg(exact_sum("v")).collect()))
    assert got == {g: expected(vs) for g, vs in enumerate(groups)}


def test_same_bits_over_any_partitions(spark):
    odd = [1e15, 1e-9, -1e15, 0.1, 123456.78, 3e18, -7.77e20, 1e25, 2e-13]
    rows = spark.range(20_000).select((F.col("id") % 3).alias("g"), F.element_at(F.array(*[F.lit(x) for x in odd]), (F.col("id") % 9 + 1).cast("int")).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(7, 1e15), (7, float("inf")), (8, float("-inf")), (8, 1e-9), (9, None), (10, float("nan")), (10, 1.0),
                                                   (11, float("inf")), (11, float("-inf")), (12, 4e30), (12, 1.0)], "g long, v double"))
    seen = set()
    for n in (1, 7, 200):
        df = rows.repartition(n, F.rand(n))
        out = df.groupBy("g").agg(exact_sum("v").alias("s")).collect()
        seen.add(tuple(sorted((r.g, r.s.hex() if r.s is not None else None) for r in out)))
    assert len(seen) == 1
    got = {g: s and float.fromhex(s) for g, s in seen.pop()}
    assert got[7] == math.inf and got[8] == -math.inf and got[9] is None and math.isnan(got[10]) and math.isnan(got[11]) and got[12] == math.inf
    assert got[0] == pytest.approx(sum(v for i, v in enumerate(odd * 2223) if i < 20_000 and i % 3 == 0), rel=1e-12)


def test_running_digits_recombine(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([0.1] * 10 + [1e12, -1e12, 0.7])], "i int, v double")
    from pyspark.sql import Window
    w = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    got = [r.s for r in df.select("i", recombine([F.sum(x).over(w) for x in limbs("v")]).alias("s")).orderBy("i").collect()]
    values = [0.1] * 10 + [1e12, -1e12, 0.7]
    assert got == [math.fsum(values[:k + 1]) for k in range(13)]


def test_islamic_dates_of_four_centuries(spark):
    days = spark.sql("select explode(sequence(date'1600-01-01', date'2077-12-31')) as d")
    got = {r.d: (r.h.year, r.h.month, r.h.day, r.back) for r in days.select("d", hijri(F.col("d")).alias("h")).withColumn(
        "back", hijri_date(F.col("h.year"), F.col("h.month"), F.col("h.day"))).collect()}
    day, leap = dt.date(622, 7, 19), {2, 5, 7, 10, 13, 16, 18, 21, 24, 26, 29}
    seen = 0
    for year in range(1, 1502):
        for month in range(1, 13):
            for n in range(1, (30 if month % 2 or month == 12 and year % 30 in leap else 29) + 1):
                if day in got:
                    assert got[day] == (year, month, n, day)
                    seen += 1
                day += dt.timedelta(days=1)
    assert seen == len(got)
    assert spark.range(1).select(hijri(F.lit("0622-07-18").cast("date")).alias("h")).first().h is None


def test_movable_holidays_of_known_years(spark):
    table = {(r.holiday_date, r.name) for r in features.holiday_table(spark, 2020, 2026).collect()}
    assert {(dt.date(2024, 4, 10), "Eid al-Fitr"), (dt.date(2024, 4, 13), "Eid al-Fitr"), (dt.date(2023, 6, 28), "Arafat Day"),
            (dt.date(2023, 6, 29), "Eid al-Adha"), (dt.date(2022, 2, 22), "Founding Day")} <= table
    rule = features.HolidayRule(2020, 2026)
    days = spark.sql("select explode(sequence(date'2019-01-01', date'2027-12-31')) as d")
    by_rule = {(r.d, r.name) for r in days.select("d", rule.name(F.col("d")).alias("name")).filter("name is not null").collect()}
    assert by_rule == table and len(table) == 7 + 5 + 7 * 8


def test_a_client_with_odd_values_has_no_forecast_and_others_keep_theirs(spark):
    rows = [(c, dt.date(2024, 1, 1) + dt.timedelta(days=i), v) for c, odd in ((1, 0.0), (2, 1e15), (3, float("inf")), (4, float("nan")))
            for i in range(40) for v in [float(i % 7) + (odd if i == 20 else 0.0)]]
    df = spark.createDataFrame(rows, "client_id long, sale_date date, daily_sales double")
    for out in (forecast.seasonal_naive(df, "sale_date", "daily_sales", 7, 14), forecast.trend_seasonal(df, "sale_date", "daily_sales", 7, 14, 14)):
        got = out.collect()
        assert {r.client_id for r in got} == {1, 2} and len(got) == 28
        assert all(r.lower_ci <= r.forecast <= r.upper_ci for r in got)
