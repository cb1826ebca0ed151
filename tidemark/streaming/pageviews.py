"""Page-view counts over a stream of requests, and their publication."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import requests as rq
from tidemark.operators.pageviews import DAILY_KEYS, HOURLY_KEYS, readers_only
from tidemark.session import adaptive
from tidemark.sources.tables import drop_expired_slots, newest_day, publish_partitions

PARTS = {"1 day": ("year", "month", "day"), "1 hour": ("year", "month", "day", "hour")}


def with_event_time(stream: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as a zoned timestamp, the only kind that takes a watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_pageviews(stream: DataFrame, grain: str = "1 hour", delay: str = "1 day", scale: int = 1,
                     ts: str = "ts", country: Column | None = None,
                     access: Column | None = None) -> DataFrame:
    """Page views per hour or day of event time, each window emitted once it is closed.

    Windows follow UTC, so the session has to as well. A window closes when the
    latest event is ``delay`` past its end; later rows of it are dropped. Partial sums
    are taken before the shuffle and kept in the state store per key and open window.
    """
    keys = HOURLY_KEYS if grain == "1 hour" else DAILY_KEYS
    columns = {
        "project": rq.project("uri_host"), "variant": rq.variant("uri_host"),
        "page_title": rq.page_title("uri_path"),
        "access_method": access if access is not None else rq.access_method("uri_host", "user_agent"),
        "country": country if country is not None else F.col("country"),
    }
    timed = with_event_time(readers_only(stream), ts).withWatermark(ts, delay)
    counted = timed.select(ts, *[columns[k].alias(k) for k in keys]).groupBy(
        F.window(ts, grain), *keys).agg((F.lit(scale).cast("long") * F.count(F.lit(1))).alias("n"))
    start = F.col("window.start")
    parts = {"year": F.year(start), "month": F.month(start), "day": F.dayofmonth(start),
             "hour": F.hour(start)}
    return counted.select(*keys, *[parts[p].alias(p) for p in PARTS[grain]], "n")


def publish_open_slots(requests: DataFrame, path: str, grain: str = "1 hour", ts: str = "ts",
                       **counting) -> None:
    """Publishes what the stream still holds open, counted anew from the stored requests.

    The stream publishes a slot once it is closed, so at the end of a replay, or whenever
    readers want the current slots, its last ones are missing. They are the slots behind
    the last published one; the stream replaces them when it closes them.
    """
    columns = list(PARTS[grain])
    hour = F.col("hour") if "hour" in columns else F.lit(0)
    slot = F.make_timestamp(F.col("year"), F.col("month"), F.col("day"), hour, F.lit(0), F.lit(0))
    spark = requests.sparkSession
    try:
        last = spark.read.parquet(path).select(slot.alias("slot")).agg(F.max("slot")).first()[0]
    except AnalysisException:  # nothing is published yet
        last = None
    timed = with_event_time(requests, ts)
    if last is not None:
        timed = timed.where(F.col(ts) >= F.lit(last) + F.expr(f"INTERVAL {grain.upper()}"))
    publish_partitions(stream_pageviews(timed, grain, ts=ts, **counting), path, columns)


def publish_stream(counts: DataFrame, path: str, checkpoint: str, grain: str = "1 hour",
                   after: Callable[[DataFrame, int], None] | None = None,
                   keep_days: int | None = None, **trigger) -> StreamingQuery:
    """Publishes closed windows as partitions of a table.

    A window is emitted in one batch and is one partition, so a batch that is run
    again after a failure replaces its own partitions. With ``keep_days`` each batch
    drops the days that are so far behind the newest one, which a repeated batch does
    to the same end. ``after`` runs behind each batch.
    """
    columns: Sequence[str] = PARTS[grain]

    def publish(batch: DataFrame, number: int) -> None:
        # Its rows are already planned, so the state keeps its partitions; the rebalancing in
        # front of the write needs to be adaptive, or every task has a file in every slot.
        with adaptive(batch.sparkSession):
            publish_partitions(batch, path, columns)
        newest = newest_day(batch.sparkSession, path) if keep_days is not None else None
        if newest is not None:
            drop_expired_slots(batch.sparkSession, path, newest, keep_days)
        if after is not None:
            after(batch, number)

    return (counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            .foreachBatch(publish).trigger(**(trigger or {"availableNow": True})).start())
