"""Checked queries over streams: the test tables are replayed as file streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.pageviews import DAILY_KEYS, HOURLY_KEYS
from tidemark.plans.experiment_queries import WELCH, sql_tidy
from tidemark.plans.views import table, view_of, with_views
from tidemark.plans.web_queries import HOST_PARTS, READERS, tidied
from tidemark.session import scratch_path
from tidemark.streaming import monitor, pageviews

QUERIES = {}
CHECKS = {}


def checked(name, sql=None, views=("requests",)):
    def register(query):
        QUERIES[name] = query
        if sql is not None:
            CHECKS[name] = with_views(sql, *views)
        return query
    return register


def event_stream(spark, folder, **options):
    """The event table as a file stream."""
    schema = table(spark, folder, "events").schema
    return spark.readStream.schema(schema).options(**options).parquet(f"{folder}/events*.parquet")


def published(spark, folder, grain, scale, delay):
    requests = view_of(spark, "requests", events=event_stream(spark, folder))
    counts = pageviews.stream_pageviews(requests, grain, delay, scale)
    path = scratch_path(spark, "published")
    query = pageviews.publish_stream(counts, path, scratch_path(spark, "state"), grain)
    query.awaitTermination()
    stored = view_of(spark, "requests", events=table(spark, folder, "events"))
    pageviews.publish_open_slots(stored, path, grain, scale=scale)
    parts = pageviews.PARTS[grain]
    keys = HOURLY_KEYS if grain == "1 hour" else DAILY_KEYS
    return spark.read.parquet(path).select(*keys, *parts, "n")


@checked("streamed_daily_pageviews", f"""
WITH {HOST_PARTS}, readers AS (SELECT * FROM named WHERE {READERS})
SELECT project, variant, page_title, country, year, month, day, CAST(64 * count(*) AS BIGINT) AS n
FROM readers GROUP BY ALL""")
def streamed_daily_pageviews(spark, folder):
    return published(spark, folder, "1 day", 64, "1 day")


@checked("streamed_daily_retention", f"""
WITH {HOST_PARTS}, readers AS (SELECT * FROM named WHERE {READERS}),
closed AS (SELECT max(ts) - INTERVAL 1 DAY AS watermark FROM readers)
SELECT project, variant, page_title, country, year, month, day, count(*) AS n FROM readers, closed
WHERE make_date(year, month, day) + 1 <= watermark AND make_date(year, month, day) > (
  SELECT max(make_date(year, month, day)) - 7 FROM readers, closed WHERE make_date(year, month, day) + 1 <= watermark)
GROUP BY ALL""")
def streamed_daily_retention(spark, folder):
    """Closed days of the stream, of which each batch keeps a week."""
    requests = view_of(spark, "requests", events=event_stream(spark, folder))
    path = scratch_path(spark, "published")
    pageviews.publish_stream(pageviews.stream_pageviews(requests, "1 day", "1 day"), path,
                             scratch_path(spark, "state"), "1 day", keep_days=7).awaitTermination()
    return spark.read.parquet(path).select(*DAILY_KEYS, *pageviews.PARTS["1 day"], "n")


@checked("streamed_hourly_pageviews", f"""
WITH {HOST_PARTS}, readers AS (SELECT * FROM named WHERE {READERS})
SELECT project, variant, page_title, country, year, month, day, hour,
  CASE WHEN user_agent LIKE '%WikipediaApp%' THEN 'mobile app'
       WHEN uri_host LIKE '%.m.%' THEN 'mobile web' ELSE 'desktop' END AS access_method,
  count(*) AS n
FROM readers GROUP BY ALL""")
def streamed_hourly_pageviews(spark, folder):
    return published(spark, folder, "1 hour", 1, "6 hours")


# The monitor's checkpoints: what was recorded up to the end of these days.
LAST_DAYS = (8, 15, 23, 31)


def monitored(spark, folder):
    """Runs the monitor over the event table as it grows, in one micro-batch a stretch of
    days; its result folder."""
    files, path, state = (scratch_path(spark, n) for n in ("records", "monitor", "state"))
    events = table(spark, folder, "events")
    for first, last in zip((0, *LAST_DAYS), LAST_DAYS):
        events.where((F.dayofmonth("ts") > first) & (F.dayofmonth("ts") <= last)).write.mode(
            "append").parquet(files)
        stream = spark.readStream.schema(events.schema).parquet(files)
        monitor.monitor_experiments(view_of(spark, "impressions", events=stream), path, state,
                                    0.05, 1000).awaitTermination()
    return path


MONITORED = f"""
days AS (SELECT unnest({list(LAST_DAYS)}) AS last_day),
sums AS (SELECT experiment, variant, last_day, count(*) AS n, avg(amount) AS mean,
  var_pop(amount) * count(*) AS ssd FROM impressions JOIN days ON day(ts) <= last_day GROUP BY ALL),
paired AS (SELECT experiment, last_day, max(n) FILTER (variant = 'A') AS a_n,
  max(n) FILTER (variant = 'B') AS b_n, max(mean) FILTER (variant = 'A') AS a_mean,
  max(mean) FILTER (variant = 'B') AS b_mean, max(ssd) FILTER (variant = 'A') AS a_ssd,
  max(ssd) FILTER (variant = 'B') AS b_ssd FROM sums GROUP BY ALL),
{WELCH},
judged AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY last_day) AS checkpoint,
  CASE WHEN p < 0.05 AND a_mean > b_mean THEN 'A' WHEN p < 0.05 THEN 'B'
  WHEN greatest(a_n, b_n) > 1000 THEN 'unknown' ELSE 'continue' END AS result FROM valued),
results AS (SELECT * FROM judged QUALIFY checkpoint <= coalesce(min(checkpoint)
  FILTER (result <> 'continue') OVER (PARTITION BY experiment), checkpoint))
"""


@checked("monitored_totals", f"""
WITH {MONITORED} SELECT experiment, checkpoint, a_n, b_n, round(a_mean, 6) AS a_mean, round(b_mean, 6) AS b_mean,
  {sql_tidy('t')} AS t, {sql_tidy('p')} AS p, result FROM results""", ("impressions",))
def monitored_totals(spark, folder):
    results = monitor.monitored_results(spark, monitored(spark, folder))
    return tidied(results, "a_mean", "b_mean", "t", "p").select(
        "experiment", "checkpoint", "a_n", "b_n", "a_mean", "b_mean", "t", "p", "result")


@checked("monitored_decisions", f"""
WITH {MONITORED} SELECT experiment, checkpoint, result, greatest(a_n, b_n) AS records
FROM results WHERE result <> 'continue'""", ("impressions",))
def monitored_decisions(spark, folder):
    return monitor.decisions(spark, monitored(spark, folder))
