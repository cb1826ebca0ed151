"""The scheduled jobs: one call publishes one partition."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed
from tidemark.functions import requests as rq
from tidemark.operators import pageviews, trends
from tidemark.operators.traffic import map_field
from tidemark.sources import slots
from tidemark.sources.requests import read_requests, sample_bucket
from tidemark.sources.tables import drop_expired_slots, publish_partition


class IncompleteInput(RuntimeError):
    """Hours of the log that a job needs are not there yet."""


def require_hours(spark: SparkSession, log: str, start: datetime, hours: int,
                  sources: Sequence[str] = fixed.REQUEST_SOURCES) -> None:
    """Raises if the log lacks any of the hours of any source, before anything is published.

    Partitions are looked up by name. One without rows is complete; see ``slots.mark_slot``.
    """
    for moment in (start + timedelta(hours=n) for n in range(hours)):
        for source in sources:
            hour = {"year": moment.year, "month": moment.month, "day": moment.day, "hour": moment.hour}
            if not slots.has_slot(spark, log, webrequest_source=source, **hour):
                raise IncompleteInput(f"{log} lacks the hour {tuple(hour.values())} of {source}")


def daily_job(spark: SparkSession, log: str, table: str, day: date, keep_days: int = 60,
              **options) -> None:
    """One run of the daily job: complete input, publication, retention."""
    require_hours(spark, log, datetime.combine(day, time()), 24)
    publish_daily_pageviews(spark, log, table, day, **options)
    drop_expired_slots(spark, table, day, keep_days)


def hourly_job(spark: SparkSession, log: str, table: str, hour: datetime, ranges: DataFrame,
               keep_days: int = 7, **options) -> None:
    """One run of the hourly job: complete input, publication, retention."""
    require_hours(spark, log, hour, 1)
    publish_hourly_pageviews(spark, log, table, hour, ranges, **options)
    drop_expired_slots(spark, table, hour.date(), keep_days)


def _sampled(log: DataFrame, one_in: int, key: str | None, seed: int | None) -> DataFrame:
    return log if one_in == 1 else sample_bucket(log, one_in, key, seed=seed)


def publish_daily_pageviews(spark: SparkSession, log: str, table: str, day: date,
                            one_in: int = fixed.SAMPLE_ONE_IN, key: str | None = None,
                            seed: int | None = None) -> None:
    """Counts one day of the request log, scaled up from a sample, by located country."""
    start = datetime.combine(day, time())
    requests = read_requests(spark, log, start, start + timedelta(days=1), fixed.REQUEST_SOURCES)
    counts = pageviews.geo_pageviews_daily(
        _sampled(requests, one_in, key, seed), one_in, map_field("geocoded_data", "country"), ())
    publish_partition(counts, table, year=day.year, month=day.month, day=day.day)


def publish_hourly_pageviews(spark: SparkSession, log: str, table: str, hour: datetime,
                             ranges: DataFrame, one_in: int = fixed.SAMPLE_ONE_IN,
                             key: str | None = None, seed: int | None = None,
                             access: Column | None = None) -> None:
    """Counts one hour of a sample of the log, unscaled, by the country of the client address."""
    requests = _sampled(read_requests(spark, log, hour, hour + timedelta(hours=1)), one_in, key, seed)
    located = pageviews.locate(pageviews.readers_only(requests),
                               rq.client_ip("ip", "x_forwarded_for"), ranges)
    counts = pageviews.geo_pageviews_hourly(located, access=access, dates=())
    publish_partition(counts, table, year=hour.year, month=hour.month, day=hour.day, hour=hour.hour)


def publish_trends(spark: SparkSession, daily: str, table: str, day: date, since_year: int = 2015,
                   project: str = "wikipedia") -> None:
    """Scores the daily counts of one project up to a day."""
    known = spark.read.parquet(daily).where(
        (F.col("year") >= since_year) & (F.make_date("year", "month", "day") <= F.lit(day))
        & (F.col("project") == project))
    publish_partition(trends.trend_level_slope(known), table,
                      year=day.year, month=day.month, day=day.day)
