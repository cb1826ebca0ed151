"""Trend scores over daily counts per key.

Series rows are one per key and day (the output of a daily count), so a key holds
at most as many rows as there are days, whatever its traffic. Scores work on the
days present; :func:`fill_gaps` adds the days without views.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.numbers import ratio
from tidemark.operators.pageviews import DAILY_KEYS

DAY = ("year", "month", "day")


def _latest_first(series: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    newest = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return series.withColumn("_age", F.row_number().over(newest))


def trend_level_slope(series: DataFrame, keys: Sequence[str] = DAILY_KEYS,
                      order: Sequence[str] = DAY, n: str = "n") -> DataFrame:
    """Mean and least-squares slope of each key's series.

    The days present are numbered 0, 1, ...; one day or a constant series has
    slope 0. One exchange on the keys serves both the numbering and the fit.
    """
    in_order = W.partitionBy(*keys).orderBy(*order)
    numbered = series.withColumn("_x", (F.row_number().over(in_order) - 1).cast("double"))
    y = F.col(n).cast("double")
    return numbered.groupBy(*keys).agg(
        F.avg(y).alias("popularity"),
        F.coalesce(F.regr_slope(y, F.col("_x")), F.lit(0.0)).alias("trend"))


def burst_score(series: DataFrame, keys: Sequence[str] = DAILY_KEYS,
                order: Sequence[str] = DAY, n: str = "n", days: int = 8) -> DataFrame:
    """Latest day against the mean of up to seven before it, weighted by volume."""
    recent = _latest_first(series, keys, order).where(F.col("_age") <= days)
    last = F.max(F.when(F.col("_age") == 1, F.col(n))).cast("double")
    total = F.sum(n).cast("double")
    present = F.count(F.lit(1))
    earlier = F.try_divide(total - last, (present - 1).cast("double"))
    rise = F.when(present == 1, last).otherwise(last - earlier)
    return recent.groupBy(*keys).agg((rise * (1.0 + F.log(1.0 + total))).alias("score"))


def monthly_trend(series: DataFrame, keys: Sequence[str] = DAILY_KEYS,
                  order: Sequence[str] = DAY, n: str = "n", half: int = 15) -> DataFrame:
    """Sum of the last 15 days less the sum of the 15 before."""
    recent = _latest_first(series, keys, order).where(F.col("_age") <= 2 * half)
    signed = F.when(F.col("_age") <= half, F.col(n)).otherwise(-F.col(n))
    return recent.groupBy(*keys).agg(F.sum(signed).cast("double").alias("trend"))


def daily_trend(series: DataFrame, keys: Sequence[str] = DAILY_KEYS,
                order: Sequence[str] = DAY, n: str = "n") -> DataFrame:
    """Latest day against the same day a week before, weighted by that week.

    Fewer than eight days give a NULL trend. The error falls with all views.
    """
    aged = _latest_first(series, keys, order)
    last = F.max(F.when(F.col("_age") == 1, F.col(n))).cast("double")
    week_ago = F.max(F.when(F.col("_age") == 8, F.col(n))).cast("double")
    week = F.sum(F.when(F.col("_age").between(2, 8), F.col(n))).cast("double")
    total = F.sum(n).cast("double")
    return aged.groupBy(*keys).agg(
        ((last - week_ago) * (1.0 + F.log(1.0 + week))).alias("trend"),
        F.try_divide(F.lit(1.0), F.sqrt(total)).alias("error"))


def trend_ratio(series: DataFrame, earlier: Column, later: Column,
                keys: Sequence[str] = DAILY_KEYS, n: str = "n") -> DataFrame:
    """Views of the later period over views of the earlier one.

    Keys seen in both periods only. Both sums come from one pass over the series.
    """
    sums = series.where(earlier | later).dropna(subset=list(keys)).groupBy(*keys).agg(
        F.sum(F.when(earlier, F.col(n))).alias("_before"),
        F.sum(F.when(later, F.col(n))).alias("_after"))
    both = sums.where(F.col("_before").isNotNull() & F.col("_after").isNotNull())
    return both.select(*keys, ratio(F.col("_after"), F.col("_before")).alias("score"))


def top_scored(scores: DataFrame, k: int, score: str = "score",
               tiebreak: Sequence[str] = ("page_title",), **equal: str) -> DataFrame:
    """The k best rows among those with the given values."""
    for column, value in equal.items():
        scores = scores.where(F.col(column) == value)
    return scores.orderBy(F.desc(score), *tiebreak).limit(k)


def series_of_top(series: DataFrame, top: DataFrame, key: str = "page_title",
                  order: Sequence[str] = DAY, n: str = "n") -> DataFrame:
    """Daily sums of the keys in ``top``, a limited list."""
    return (series.join(top.select(key), key, "left_semi")
            .groupBy(key, *order).agg(F.sum(n).alias(n)))


def country_panel(series: DataFrame, page_title: str, project: str, variant: str,
                  countries: Sequence[str], order: Sequence[str] = DAY) -> DataFrame:
    """Daily sums of one page in a list of countries."""
    wanted = series.where(
        (F.col("page_title") == page_title) & (F.col("project") == project)
        & (F.col("variant") == variant) & F.col("country").isin(list(countries)))
    return wanted.groupBy(*DAILY_KEYS, *order).agg(F.sum("n").alias("n"))


def first_rows(df: DataFrame, order: Sequence[str | Column], k: int) -> DataFrame:
    """First k rows in a unique order."""
    return df.orderBy(*order).limit(k)


def in_key_order(series: DataFrame, keys: Sequence[str] = DAILY_KEYS,
                 order: Sequence[str] = DAY) -> DataFrame:
    """Places each key in one partition, sorted by key and date, for writing out."""
    return series.repartition(*keys).sortWithinPartitions(*keys, *order)


def fill_gaps(series: DataFrame, keys: Sequence[str] = DAILY_KEYS, n: str = "n") -> DataFrame:
    """Adds zero rows for the days between a key's first and last day."""
    dated = series.withColumn("_day", F.make_date("year", "month", "day"))
    spine = dated.groupBy(*keys).agg(
        F.sequence(F.min("_day"), F.max("_day")).alias("_days")
    ).select(*[F.col(k).alias(f"_spine_{k}") for k in keys], F.explode("_days").alias("_spine_day"))
    on = F.col("_day") == F.col("_spine_day")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_spine_{k}"))
    return spine.join(dated, on, "left").select(
        *[F.col(f"_spine_{k}").alias(k) for k in keys],
        F.year("_spine_day").alias("year"), F.month("_spine_day").alias("month"),
        F.dayofmonth("_spine_day").alias("day"),
        F.coalesce(F.col(n), F.lit(0).cast("long")).alias(n))
