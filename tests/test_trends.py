"""Trend scores by hand."""

import math

import pytest

from tidemark.operators import trends

KEYS = ["k"]
ORDER = ["day"]


def series(spark, **days):
    rows = [(k, d, n) for k, counts in days.items() for d, n in enumerate(counts, 1)]
    return spark.createDataFrame(rows, "k STRING, day INT, n LONG")


def scores(df, *columns):
    return {r.k: tuple(r[c] for c in columns) for r in df.collect()}


def test_level_and_slope(spark):
    df = series(spark, one=[7], flat=[3, 3, 3], up=[1, 2, 3, 4], bent=[1, 5, 3])
    found = scores(trends.trend_level_slope(df, KEYS, ORDER), "popularity", "trend")
    assert found["one"] == (7.0, 0.0)
    assert found["flat"] == (3.0, 0.0)
    assert found["up"] == (2.5, 1.0)
    assert found["bent"] == (3.0, pytest.approx(1.0))


def test_gaps_are_skipped_unless_filled(spark):
    rows = [("a", 2024, 1, 1, 2), ("a", 2024, 1, 4, 8)]
    df = spark.createDataFrame(rows, "k STRING, year INT, month INT, day INT, n LONG")
    order = ["year", "month", "day"]
    assert scores(trends.trend_level_slope(df, KEYS, order), "trend")["a"] == (6.0,)
    filled = trends.fill_gaps(df, KEYS)
    assert sorted((r.day, r.n) for r in filled.collect()) == [(1, 2), (2, 0), (3, 0), (4, 8)]
    assert scores(trends.trend_level_slope(filled, KEYS, order), "trend")["a"][0] == pytest.approx(1.8)


@pytest.mark.parametrize("counts", [[5], [5, 9], [1, 2, 3, 4, 5, 6, 7, 20], [100, 1, 2, 3, 4, 5, 6, 7, 20]])
def test_burst(spark, counts):
    recent = counts[-8:]
    rise = recent[0] if len(recent) == 1 else recent[-1] - sum(recent[:-1]) / (len(recent) - 1)
    expected = rise * (1 + math.log(1 + sum(recent)))
    found = scores(trends.burst_score(series(spark, a=counts), KEYS, ORDER), "score")
    assert found["a"][0] == pytest.approx(expected)


def test_monthly_and_daily(spark):
    long = list(range(1, 41))
    df = series(spark, long=long, short=[4, 6])
    assert scores(trends.monthly_trend(df, KEYS, ORDER), "trend") == {
        "long": (float(sum(long[-15:]) - sum(long[-30:-15])),), "short": (10.0,)}
    daily = scores(trends.daily_trend(df, KEYS, ORDER), "trend", "error")
    assert daily["long"][0] == pytest.approx(7 * (1 + math.log(1 + sum(long[-8:-1]))))
    assert daily["long"][1] == pytest.approx(1 / math.sqrt(sum(long)))
    assert daily["short"][0] is None


def test_ratio_needs_both_periods(spark):
    df = spark.createDataFrame([("a", 1, 4), ("a", 2, 6), ("b", 1, 5), ("c", 2, 5), (None, 1, 1), (None, 2, 1),
                                ("z", 1, 0), ("z", 2, 3)], "k STRING, day INT, n LONG")
    found = scores(trends.trend_ratio(df, df.day == 1, df.day == 2, KEYS), "score")
    assert found == {"a": (1.5,), "z": (None,)}


def test_one_exchange_for_the_fit(spark):
    df = trends.trend_level_slope(series(spark, a=[1, 2]), KEYS, ORDER)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
