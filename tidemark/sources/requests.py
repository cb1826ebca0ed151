"""The partitioned request log: pruned scans, samples and completeness."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import fixed_values as fixed
from tidemark.functions import requests as rq

GRAINS = {"day": ("year", "month", "day"), "hour": ("year", "month", "day", "hour")}

REQUEST_SCHEMA = T.StructType([
    T.StructField("uri_host", T.StringType()),
    T.StructField("uri_path", T.StringType()),
    T.StructField("uri_query", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("ip", T.StringType()),
    T.StructField("x_forwarded_for", T.StringType()),
    T.StructField("http_status", T.StringType()),
    T.StructField("is_pageview", T.BooleanType()),
    T.StructField("geocoded_data", T.MapType(T.StringType(), T.StringType())),
    T.StructField("x_analytics_map", T.MapType(T.StringType(), T.StringType())),
    T.StructField("x_analytics", T.StringType()),
    T.StructField("access_method", T.StringType()),
    T.StructField("agent_type", T.StringType()),
    T.StructField("webrequest_source", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("day", T.IntegerType()),
    T.StructField("hour", T.IntegerType()),
])


def in_period(df: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Rows whose partition hour lies in [start, end).

    The year and day bounds use partition columns only, so files outside them are not
    read, whether or not the hour is a partition column too. (A path is listed as a
    whole; a catalog table lists the partitions of the period only.)
    """
    zero = F.lit(0)
    hour = F.make_timestamp_ntz(F.col("year"), F.col("month"), F.col("day"), F.col("hour"), zero, zero)
    return df.where(
        F.col("year").between(start.year, end.year)
        & rq.day_of_parts("year", "month", "day").between(F.lit(start.date()), F.lit(end.date()))
        & (hour >= rq.wall_clock(start)) & (hour < rq.wall_clock(end)))


def read_requests(spark: SparkSession, path: str, start: datetime, end: datetime,
                  sources: Sequence[str] | None = None,
                  schema: T.StructType | None = None) -> DataFrame:
    """Requests of a period, from a Parquet table partitioned by source and hour."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = in_period(reader.parquet(path), start, end)
    return df if sources is None else df.where(F.col("webrequest_source").isin(list(sources)))


def sample_bucket(df: DataFrame, one_in: int = fixed.SAMPLE_ONE_IN, key: str | None = None,
                  bucket: int = 0, hashed: bool = True, seed: int | None = None) -> DataFrame:
    """One row in ``one_in``: random, or by a key so that reruns pick the same rows."""
    if key is None:
        return df.sample(fraction=1.0 / one_in, seed=seed)
    number = F.xxhash64(key) if hashed else F.col(key)
    return df.where(F.pmod(number, F.lit(one_in)) == bucket)


def missing_partitions(observed: DataFrame, first: datetime, last: datetime,
                       grain: str = "hour", sources: Sequence[str] | None = None,
                       source_column: str = "webrequest_source") -> DataFrame:
    """Expected slots (inclusive period) without any row.

    ``observed`` may be the whole table: only its partition columns are read, for the
    days of the period, and they are reduced to distinct slots before the anti join.
    """
    columns = list(GRAINS[grain])
    day = F.make_date("year", "month", "day")
    observed = observed.where(F.col("year").between(first.year, last.year)
                              & (day >= F.lit(first.date())) & (day <= F.lit(last.date())))
    step = F.expr(f"INTERVAL 1 {grain.upper()}")
    expected = observed.sparkSession.range(1).select(F.explode(F.sequence(
        rq.wall_clock(first), rq.wall_clock(last), step)).alias("slot"))
    expected = expected.select(*[getattr(F, part)("slot").alias(part) for part in columns])
    if sources is not None:
        expected = expected.select("*", F.explode(
            F.array(*[F.lit(s) for s in sources])).alias(source_column))
        columns = [*columns, source_column]
    return expected.join(observed.select(*columns).distinct(), columns, "left_anti")
