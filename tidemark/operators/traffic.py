"""Hourly traffic by protocol, host, country and agent around dated incidents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed
from tidemark.functions import requests as rq

DIMENSIONS = ("uri_host", "country", "https", "http_status", "access_method", "agent_type",
              "year", "month", "day", "hour")


def map_field(column: Column | str, key: str) -> Column:
    """Value of a map at a key, NULL where the key is missing."""
    return F.try_element_at(F.col(column) if isinstance(column, str) else column, F.lit(key))


def traffic_by_dimensions(df: DataFrame, keys: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Requests per combination of the dimensions."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def scale_counts(df: DataFrame, one_in: int = fixed.SAMPLE_ONE_IN, column: str = "n") -> DataFrame:
    """Multiplies sampled counts up to the population."""
    return df.withColumn(column, F.col(column) * F.lit(one_in).cast("long"))


def with_hour(df: DataFrame, name: str = "date") -> DataFrame:
    """Adds the hour as a timestamp."""
    return df.withColumn(name, rq.hour_of_parts("year", "month", "day", "hour"))


def successful(df: DataFrame, status: str = fixed.OK_STATUS, after=None) -> DataFrame:
    """Keeps one status, compared as text, and optionally hours after a moment."""
    df = df.where(F.col("http_status").cast("string") == status)
    return df if after is None else df.where(F.col("date") > F.lit(str(after)).cast("timestamp"))


def slice_traffic(df: DataFrame, agent: str | None = None, host: str | None = None,
                  country: str | None = None, access: str | None = None) -> DataFrame:
    """Applies each filter that is given."""
    wanted = {"agent_type": agent, "uri_host": host, "country": country, "access_method": access}
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def protocol_series(df: DataFrame, date: str = "date", n: str = "n") -> DataFrame:
    """Per hour: encrypted, other and all traffic in one pass.

    A missing protocol flag counts as not encrypted. A side without rows in an
    hour is NULL.
    """
    encrypted = F.col("https").try_cast("double").eqNullSafe(F.lit(1.0))
    return df.groupBy(date).agg(
        F.sum(F.when(encrypted, F.col(n))).alias("https"),
        F.sum(F.when(~encrypted, F.col(n))).alias("http"),
        F.sum(n).alias("combined"),
    )


def top_totals(df: DataFrame, key: str, k: int, n: str = "n") -> DataFrame:
    """The k keys with the largest totals."""
    return (df.groupBy(key).agg(F.sum(n).alias(n))
            .orderBy(F.desc(n), F.col(key)).limit(k))


def probe_map(df: DataFrame, field: str, key: str, text: str, k: int = 100,
              order: Sequence[str] = ()) -> DataFrame:
    """First k values of one map key among rows whose raw text is not trivial."""
    found = df.where(F.length(text) > 1)
    if order:
        found = found.orderBy(*order)
    return found.limit(k).select(*order, map_field(field, key).alias(key))


def annotate_events(series: DataFrame, events: DataFrame, ts: str = "date",
                    hours_around: int = 0) -> DataFrame:
    """Tags each row with the named windows that hold its moment.

    ``events`` has ``label``, ``start_ts``, ``end_ts`` (end open). With
    ``hours_around`` the hours just before and after a window are tagged too.
    Windows are laid out by hour and met on it, an equi join at any number of
    windows; rows outside all windows keep a NULL label.
    """
    around = F.expr(f"INTERVAL {int(hours_around)} HOURS")
    hour = F.expr("INTERVAL 1 HOUR")
    laid_out = (
        events.select("label", F.col("start_ts").cast("timestamp").alias("start_ts"),
                      F.col("end_ts").cast("timestamp").alias("end_ts"))
        .withColumn("_slot", F.explode(F.sequence(
            F.date_trunc("hour", F.col("start_ts") - around),
            F.date_trunc("hour", F.col("end_ts") + around), hour)))
    )
    at = F.col(ts).cast("timestamp")
    on = ((F.date_trunc("hour", at) == F.col("_slot"))
          & (at >= F.col("start_ts") - around) & (at < F.col("end_ts") + around))
    phase = (F.when(F.col("label").isNull(), F.lit(None))
             .when(at < F.col("start_ts"), "before")
             .when(at < F.col("end_ts"), "during").otherwise("after"))
    return series.join(laid_out, on, "left").select(
        *series.columns, "label", phase.alias("phase"))
