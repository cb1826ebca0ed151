"""Checked queries: page views, geography, sources and traffic."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed
from tidemark.functions import requests as rq
from tidemark.functions.numbers import tidy
from tidemark.operators import pageviews, traffic, trends
from tidemark.plans import jobs
from tidemark.plans.views import table, view, with_views
from tidemark.session import scratch_path
from tidemark.sources import requests as request_log
from tidemark.sources import slots, tables

QUERIES = {}
CHECKS = {}


def checked(name, sql=None, views=("requests",)):
    def register(query):
        QUERIES[name] = query
        if sql is not None:
            CHECKS[name] = with_views(sql, *views)
        return query
    return register


def sql_list(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# Host rules spelled out with string functions: the check engine's regular
# expressions have no look-ahead.
HOST_PARTS = f"""
labelled AS (SELECT *, string_split(uri_host, '.') AS labels FROM requests),
hosted AS (SELECT *,
  CASE WHEN len(labels) >= 2 THEN labels[len(labels) - 1] END AS project,
  CASE WHEN len(labels) >= 4 AND labels[len(labels) - 2] IN {sql_list(fixed.MOBILE_MARKERS)}
       THEN labels[len(labels) - 3] WHEN len(labels) >= 3 THEN labels[len(labels) - 2]
       ELSE '' END AS language_label
  FROM labelled),
named AS (SELECT *,
  CASE WHEN project NOT IN {sql_list(fixed.PROJECTS)} THEN ''
       WHEN language_label = 'www' OR regexp_matches(language_label, '(m|zero|wap|mobile)$') THEN ''
       ELSE language_label END AS variant,
  regexp_extract(url_decode(uri_path), '^/[^/]*/(.*)', 1) AS page_title
  FROM hosted)
"""
READERS = """
is_pageview AND NOT regexp_matches(uri_path, '^/w/')
AND NOT regexp_matches(user_agent, '(?i)(bot|crawler|spider|slurp|https?://)')
AND NOT regexp_matches(user_agent, '(?i)(bot\\b|bot/|crawler|spider|slurp)')
"""
DAILY = f"""
daily AS (SELECT project, variant, page_title, country, year, month, day,
  CAST(64 * count(*) AS BIGINT) AS n
  FROM named WHERE {READERS} GROUP BY ALL)
"""
PAGEVIEW_RULES = f"""
content_type IN {sql_list(fixed.PAGE_CONTENT_TYPES)}
AND http_status = '{fixed.OK_STATUS}'
AND regexp_matches(uri_host, '{fixed.PRODUCTION_HOST}')
AND (NOT regexp_matches(uri_path, '{fixed.API_PATH}')
     OR (regexp_matches(user_agent, '{fixed.APP_AGENT}')
         AND regexp_matches(uri_host || uri_path || uri_query, '{fixed.APP_PAGE_QUERY}')))
AND regexp_matches(uri_path || uri_query, '{fixed.CONTENT_PATH}')
AND NOT regexp_matches(user_agent, '{fixed.INTERNAL_AGENT}')
AND NOT regexp_matches(uri_path, '{fixed.SPECIAL_PAGE}')
AND NOT regexp_matches(uri_path || uri_query, '{fixed.SEARCH_QUERY}')
"""


def daily_series(spark, folder):
    return pageviews.geo_pageviews_daily(view(spark, folder, "requests"))


@checked("pageview_requests", f"SELECT event_id, uri_host, uri_path FROM requests WHERE {PAGEVIEW_RULES}")
def pageview_requests(spark, folder):
    return pageviews.is_pageview_request(view(spark, folder, "requests")).select(
        "event_id", "uri_host", "uri_path")


@checked("pageviews_without_spiders", f"""
SELECT event_id, user_agent FROM requests
WHERE {PAGEVIEW_RULES} AND NOT regexp_matches(user_agent, '(?i)(bot\\b|bot/|crawler|spider|slurp)')""")
def pageviews_without_spiders(spark, folder):
    return pageviews.drop_spiders(pageviews.is_pageview_request(
        view(spark, folder, "requests"))).select("event_id", "user_agent")


@checked("crawlers_dropped", """
SELECT user_agent, count(*) AS n FROM requests
WHERE NOT regexp_matches(user_agent, '(?i)(bot|crawler|spider|slurp|https?://)') GROUP BY user_agent""")
def crawlers_dropped(spark, folder):
    return pageviews.drop_crawlers(view(spark, folder, "requests")).groupBy("user_agent").agg(
        F.count(F.lit(1)).alias("n"))


@checked("flagged_content_requests", """
SELECT event_id, uri_path FROM requests WHERE is_pageview AND NOT regexp_matches(uri_path, '^/w/')""")
def flagged_content_requests(spark, folder):
    return pageviews.drop_script_paths(pageviews.flagged_pageviews(
        view(spark, folder, "requests"))).select("event_id", "uri_path")


@checked("heavy_users_dropped", """
WITH heavy AS (SELECT user_agent, ip, x_forwarded_for, year, month, day FROM requests
  GROUP BY ALL HAVING count(*) >= 3)
SELECT event_id FROM requests r WHERE NOT EXISTS (SELECT 1 FROM heavy h
  WHERE h.user_agent = r.user_agent AND h.ip = r.ip
  AND h.x_forwarded_for IS NOT DISTINCT FROM r.x_forwarded_for
  AND h.year = r.year AND h.month = r.month AND h.day = r.day)""")
def heavy_users_dropped(spark, folder):
    # The test log is sparse, so the limit is 3 hits a day instead of 200 an hour.
    return pageviews.drop_heavy_users(view(spark, folder, "requests"), 3,
                                      per=("year", "month", "day")).select("event_id")


@checked("host_parts", f"WITH {HOST_PARTS} SELECT event_id, project, variant, page_title FROM named")
def host_parts(spark, folder):
    return view(spark, folder, "requests").select(
        "event_id", rq.project("uri_host").alias("project"),
        rq.variant("uri_host").alias("variant"), rq.page_title("uri_path").alias("page_title"))


@checked("client_attributes", r"""
SELECT event_id, coalesce(string_split(x_forwarded_for, ',')[1], ip) AS client_ip,
  CASE WHEN user_agent LIKE '%WikipediaApp%' THEN 'mobile app'
       WHEN uri_host LIKE '%.m.%' THEN 'mobile web' ELSE 'desktop' END AS access,
  regexp_matches(user_agent, '(?i)(bot|crawler|spider|slurp|https?://)') AS crawler,
  CASE WHEN regexp_matches(user_agent, '(?i)(bot\b|bot/|crawler|spider|slurp)') THEN 'Spider'
       ELSE 'Other' END AS device
FROM requests""")
def client_attributes(spark, folder):
    return view(spark, folder, "requests").select(
        "event_id", rq.client_ip("ip", "x_forwarded_for").alias("client_ip"),
        rq.access_method("uri_host", "user_agent").alias("access"),
        rq.is_crawler("user_agent").alias("crawler"),
        rq.device_family("user_agent").alias("device"))


@checked("page_url_parts", r"""
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
  string_split(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.')[-2] AS second_label,
  CAST(length(url) AS BIGINT) AS url_length, reverse(url) AS reversed,
  url_encode(regexp_replace(url, '[^A-Za-z0-9_]', '', 'g')) AS encoded,
  regexp_matches(url, '^https://') AS secure
FROM pages""", views=())
def page_url_parts(spark, folder):
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    return table(spark, folder, "pages").select(
        "page_id", host.alias("host"), rq.project(host).alias("second_label"),
        F.length("url").cast("long").alias("url_length"), F.reverse("url").alias("reversed"),
        rq.encoded_title(F.regexp_replace("url", "[^A-Za-z0-9_]", "")).alias("encoded"),
        F.col("url").rlike("^https://").alias("secure"))


@checked("dates_of_parts", """
SELECT event_id, CAST(make_timestamp(year, month, day, hour, 0, 0) AS TIMESTAMP) AS hour_start,
  make_date(year, month, day) AS day_date,
  concat(year, '-', month, '-', day) AS day_text,
  CAST(make_date(year, month, day) - 7 AS DATE) AS week_before,
  strptime(strftime(ts, '%Y-%m-%d %H:%M'), '%Y-%m-%d %H:%M') AS minute_start
FROM requests""")
def dates_of_parts(spark, folder):
    day = rq.day_of_parts("year", "month", "day")
    return view(spark, folder, "requests").select(
        "event_id",
        rq.hour_of_parts("year", "month", "day", "hour").cast("timestamp_ntz").alias("hour_start"),
        day.alias("day_date"), F.concat_ws("-", "year", "month", "day").alias("day_text"),
        rq.days_before(day).alias("week_before"),
        rq.moment(F.date_format("ts", "yyyy-MM-dd HH:mm")).cast("timestamp_ntz").alias("minute_start"))


@checked("country_of_address", """
WITH numbered AS (SELECT event_id, coalesce(x_forwarded_for, ip) AS client,
    string_split(coalesce(x_forwarded_for, ip), '.') AS o FROM requests),
valued AS (SELECT event_id, client, CAST(o[1] AS BIGINT) * 16777216 + CAST(o[2] AS BIGINT) * 65536
    + CAST(o[3] AS BIGINT) * 256 + CAST(o[4] AS BIGINT) AS number FROM numbered)
SELECT event_id, client, country FROM valued LEFT JOIN ip_ranges ON number BETWEEN first_ip AND last_ip""",
         views=("requests", "ip_ranges"))
def country_of_address(spark, folder):
    requests = view(spark, folder, "requests").drop("country").select(
        "event_id", rq.client_ip("ip", "x_forwarded_for").alias("client"))
    return pageviews.locate(requests, F.col("client"), view(spark, folder, "ip_ranges"))


@checked("country_of_any_address", """
SELECT event_id, client, CASE WHEN event_id % 10 = 9 THEN NULL
  WHEN event_id % 3 = 0 THEN CASE WHEN user_id % 8 = 6 THEN 'Cascara' WHEN user_id % 8 >= 4 THEN 'Borduria'
    ELSE 'Aland' END
  WHEN user_id % 3 = 1 THEN 'Elbonia' ELSE 'Dawsbergen' END AS country FROM addresses""", views=("addresses",))
def country_of_any_address(spark, folder):
    """IPv4, IPv6 and mapped addresses, by the longest block."""
    clients = view(spark, folder, "addresses").select("event_id", "client")
    return pageviews.locate_by_block(clients, F.col("client"), view(spark, folder, "blocks"))


@checked("geo_pageviews_daily", f"WITH {HOST_PARTS}, {DAILY} SELECT * FROM daily")
def geo_pageviews_daily(spark, folder):
    return daily_series(spark, folder)


@checked("mobile_web_pageviews", f"""
WITH {HOST_PARTS}, rows AS (SELECT event_id, project, variant, page_title,
  CASE WHEN user_agent LIKE '%WikipediaApp%' THEN 'mobile app'
       WHEN uri_host LIKE '%.m.%' THEN 'mobile web' ELSE 'desktop' END AS access_method, country
  FROM named WHERE {READERS})
SELECT * FROM rows WHERE access_method = 'mobile web' ORDER BY event_id LIMIT 10""")
def mobile_web_pageviews(spark, folder):
    rows = pageviews.geo_rows(view(spark, folder, "requests"), ["event_id"])
    return trends.first_rows(rows.where("access_method = 'mobile web'"), ["event_id"], 10)


@checked("geo_pageviews_hourly", f"""
WITH {HOST_PARTS}
SELECT project, variant, page_title, country, year, month, day, hour,
  CASE WHEN user_agent LIKE '%WikipediaApp%' THEN 'mobile app'
       WHEN uri_host LIKE '%.m.%' THEN 'mobile web' ELSE 'desktop' END AS access_method,
  count(*) AS n
FROM named WHERE {READERS} GROUP BY ALL""")
def geo_pageviews_hourly(spark, folder):
    return pageviews.geo_pageviews_hourly(view(spark, folder, "requests"))


@checked("geo_pageviews_hourly_by_address", f"""
WITH {HOST_PARTS},
numbered AS (SELECT *, string_split(coalesce(x_forwarded_for, ip), '.') AS o FROM named WHERE {READERS}),
placed AS (SELECT numbered.* EXCLUDE (country), ip_ranges.country FROM numbered LEFT JOIN ip_ranges
  ON CAST(o[1] AS BIGINT) * 16777216 + CAST(o[2] AS BIGINT) * 65536 + CAST(o[3] AS BIGINT) * 256
     + CAST(o[4] AS BIGINT) BETWEEN first_ip AND last_ip)
SELECT project, variant, page_title, country, access_method, year, month, day, hour, count(*) AS n
FROM placed GROUP BY ALL""", views=("requests", "ip_ranges"))
def geo_pageviews_hourly_by_address(spark, folder):
    located = pageviews.locate(
        pageviews.readers_only(view(spark, folder, "requests")),
        rq.client_ip("ip", "x_forwarded_for"), view(spark, folder, "ip_ranges"))
    return pageviews.geo_pageviews_hourly(located, access=F.col("access_method"))


# Sources and sinks.

@checked("sampled_requests", "SELECT event_id, uri_host FROM requests WHERE event_id % 64 = 0")
def sampled_requests(spark, folder):
    return request_log.sample_bucket(view(spark, folder, "requests"), 64, "event_id",
                                     hashed=False).select("event_id", "uri_host")


@checked("random_sample")
def random_sample(spark, folder):
    return request_log.sample_bucket(view(spark, folder, "requests"), 64, seed=7)


@checked("requests_of_period", """
SELECT event_id, CAST(year AS BIGINT) AS year, CAST(month AS BIGINT) AS month,
  CAST(day AS BIGINT) AS day, CAST(hour AS BIGINT) AS hour, webrequest_source
FROM requests WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-07 00:00:00'
AND webrequest_source IN ('text')""")
def requests_of_period(spark, folder):
    path = scratch_path(spark, "requests")
    slots = ["webrequest_source", "year", "month", "day"]
    tables.publish_partitions(view(spark, folder, "requests"), path, slots)
    found = request_log.read_requests(spark, path, datetime(2024, 1, 5, 6), datetime(2024, 1, 7),
                                      ["text"])
    numbers = [F.col(c).cast("long").alias(c) for c in ("year", "month", "day", "hour")]
    return found.select("event_id", *numbers, "webrequest_source")


@checked("recent_pageviews", f"""
WITH {HOST_PARTS}, {DAILY}
SELECT * FROM daily WHERE make_date(year, month, day) > DATE '2024-01-13'
AND make_date(year, month, day) <= DATE '2024-01-20'""")
def recent_pageviews(spark, folder):
    return tables.keep_recent(daily_series(spark, folder), date(2024, 1, 20), 7)


@checked("missing_hours", """
WITH slots AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00',
    TIMESTAMP '2024-01-31 23:00:00', INTERVAL 1 HOUR)) AS slot),
expected AS (SELECT slot, s AS webrequest_source FROM slots, unnest(['text', 'mobile']) u(s))
SELECT CAST(year(slot) AS INT) AS year, CAST(month(slot) AS INT) AS month,
  CAST(day(slot) AS INT) AS day, CAST(hour(slot) AS INT) AS hour, webrequest_source
FROM expected e WHERE NOT EXISTS (SELECT 1 FROM requests r WHERE r.webrequest_source = e.webrequest_source
  AND r.year = year(slot) AND r.month = month(slot) AND r.day = day(slot) AND r.hour = hour(slot))""")
def missing_hours(spark, folder):
    return request_log.missing_partitions(
        view(spark, folder, "requests"), datetime(2024, 1, 1), datetime(2024, 1, 31, 23),
        "hour", ["text", "mobile"])


@checked("missing_days", """
WITH slots AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-28 00:00:00',
    TIMESTAMP '2024-02-03 00:00:00', INTERVAL 1 DAY)) AS slot)
SELECT CAST(year(slot) AS INT) AS year, CAST(month(slot) AS INT) AS month, CAST(day(slot) AS INT) AS day
FROM slots WHERE NOT EXISTS (SELECT 1 FROM requests r
  WHERE r.year = year(slot) AND r.month = month(slot) AND r.day = day(slot))""")
def missing_days(spark, folder):
    return request_log.missing_partitions(
        view(spark, folder, "requests"), datetime(2023, 12, 28), datetime(2024, 2, 3), "day")


@checked("published_daily_pageviews", f"WITH {HOST_PARTS}, {DAILY} SELECT * FROM daily")
def published_daily_pageviews(spark, folder):
    path = scratch_path(spark, "daily")
    daily = daily_series(spark, folder)
    tables.publish_partitions(daily, path, ["year", "month", "day"])
    # A rerun of one day replaces that day and leaves the others.
    rerun = daily.where("year = 2024 AND month = 1 AND day = 9").drop("year", "month", "day")
    tables.publish_partition(rerun, path, year=2024, month=1, day=9)
    return spark.read.parquet(path)


JOB_DAYS = (9, 10, 11)


@checked("daily_job_pageviews", f"""
WITH {HOST_PARTS}, {DAILY} SELECT * FROM daily WHERE year = 2024 AND month = 1 AND day IN (10, 11)""")
def daily_job_pageviews(spark, folder):
    """The daily job on three days of the log, each with a check of its hours and retention of
    two days. The whole log is written as the table of hours that the job reads; hours in which
    a source has no request are marked as complete."""
    log, path = scratch_path(spark, "log"), scratch_path(spark, "job")
    parts = ["webrequest_source", "year", "month", "day", "hour"]
    rows = view(spark, folder, "requests").withColumn(
        "geocoded_data", F.create_map(F.lit("country"), F.col("country"))).drop("country")
    known = {f.name for f in request_log.REQUEST_SCHEMA}
    tables.publish_partitions(rows.select(*[c for c in rows.columns if c in known]), log, parts)
    for day in JOB_DAYS:
        for source in fixed.REQUEST_SOURCES:
            for hour in range(24):
                slots.mark_slot(spark, log, webrequest_source=source, year=2024, month=1, day=day, hour=hour)
        jobs.daily_job(spark, log, path, date(2024, 1, day), keep_days=2, one_in=1)
    return spark.read.parquet(path).withColumn("n", F.col("n") * fixed.SAMPLE_ONE_IN)


@checked("kept_daily_pageviews", f"""
WITH {HOST_PARTS}, {DAILY} SELECT * FROM daily
WHERE make_date(year, month, day) > DATE '2024-01-20' - 7 AND make_date(year, month, day) <> DATE '2024-01-18'""")
def kept_daily_pageviews(spark, folder):
    """Publication, a rerun that finds nothing for a day, and retention of a week."""
    path = scratch_path(spark, "kept")
    daily = daily_series(spark, folder)
    tables.publish_partitions(daily, path, ["year", "month", "day"])
    tables.publish_partition(daily.where("false").drop("year", "month", "day"), path, year=2024, month=1, day=18)
    tables.drop_expired_slots(spark, path, date(2024, 1, 20), 7)
    return spark.read.parquet(path)


@checked("delimited_round_trip", f"WITH {HOST_PARTS}, {DAILY} SELECT * FROM daily")
def delimited_round_trip(spark, folder):
    path = scratch_path(spark, "delimited")
    daily = daily_series(spark, folder)
    tables.write_delimited(daily, path)
    return tables.read_delimited(spark, path, daily.schema)


# Traffic around incidents.

TRAFFIC = """
traffic AS (SELECT uri_host, country, https, http_status, access_method, agent_type, year, month, day, hour,
  make_timestamp(year, month, day, hour, 0, 0) AS date, CAST(64 * count(*) AS BIGINT) AS n
  FROM requests WHERE webrequest_source IN ('text', 'mobile') AND is_pageview
  AND regexp_matches(uri_host, '(ca|en|zh|it|ug|he)\\.(m\\.)?wikipedia') GROUP BY ALL)
"""


def traffic_rows(spark, folder):
    requests = pageviews.allowed_hosts(pageviews.flagged_pageviews(view(spark, folder, "requests")))
    return traffic.with_hour(traffic.scale_counts(traffic.traffic_by_dimensions(requests)))


@checked("traffic_by_dimensions", f"WITH {TRAFFIC} SELECT * EXCLUDE (date) FROM traffic")
def traffic_by_dimensions(spark, folder):
    return traffic_rows(spark, folder).drop("date")


@checked("protocol_series", f"""
WITH {TRAFFIC}
SELECT date, CAST(sum(n) FILTER (https IS NOT DISTINCT FROM 1) AS BIGINT) AS https,
  CAST(sum(n) FILTER (https IS DISTINCT FROM 1) AS BIGINT) AS http, CAST(sum(n) AS BIGINT) AS combined
FROM traffic WHERE http_status = '200' AND date > TIMESTAMP '2024-01-04 00:00:00'
AND access_method = 'desktop' AND agent_type = 'user' AND uri_host = 'zh.wikipedia.org'
GROUP BY date""")
def protocol_series(spark, folder):
    rows = traffic.successful(traffic_rows(spark, folder), after=datetime(2024, 1, 4))
    rows = traffic.slice_traffic(rows, agent="user", host="zh.wikipedia.org", access="desktop")
    series = traffic.protocol_series(rows)
    return series.withColumn("date", F.col("date").cast("timestamp_ntz"))


@checked("protocol_series_all", f"""
WITH {TRAFFIC}
SELECT date, CAST(sum(n) FILTER (https IS NOT DISTINCT FROM 1) AS BIGINT) AS https,
  CAST(sum(n) FILTER (https IS DISTINCT FROM 1) AS BIGINT) AS http, CAST(sum(n) AS BIGINT) AS combined
FROM traffic WHERE http_status = '200' GROUP BY date""")
def protocol_series_all(spark, folder):
    series = traffic.protocol_series(traffic.successful(traffic_rows(spark, folder)))
    return series.withColumn("date", F.col("date").cast("timestamp_ntz"))


@checked("top_countries", f"""
WITH {TRAFFIC}
SELECT country, CAST(sum(n) AS BIGINT) AS n FROM traffic WHERE uri_host = 'en.wikipedia.org'
GROUP BY country ORDER BY n DESC, country LIMIT 5""")
def top_countries(spark, folder):
    rows = traffic.slice_traffic(traffic_rows(spark, folder), host="en.wikipedia.org")
    return traffic.top_totals(rows, "country", 5)


@checked("map_field_probe", """
SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE length(props) > 1
ORDER BY event_id LIMIT 100""", views=())
def map_field_probe(spark, folder):
    events = table(spark, folder, "events").withColumn(
        "fields", F.from_json("props", "MAP<STRING, STRING>"))
    return traffic.probe_map(events, "fields", "k", "props", 100, ["event_id"])


@checked("annotated_hours", """
WITH hourly AS (SELECT make_timestamp(year, month, day, hour, 0, 0) AS date, count(*) AS n
  FROM requests GROUP BY ALL)
SELECT date, n, label, CASE WHEN label IS NULL THEN NULL WHEN date < start_ts THEN 'before'
  WHEN date < end_ts THEN 'during' ELSE 'after' END AS phase
FROM hourly LEFT JOIN incidents
ON date >= start_ts - INTERVAL 6 HOUR AND date < end_ts + INTERVAL 6 HOUR""",
         views=("requests", "incidents"))
def annotated_hours(spark, folder):
    hourly = traffic.with_hour(traffic.traffic_by_dimensions(
        view(spark, folder, "requests"), ("year", "month", "day", "hour"))).select("date", "n")
    marked = traffic.annotate_events(hourly, view(spark, folder, "incidents"), hours_around=6)
    return marked.withColumn("date", F.col("date").cast("timestamp_ntz"))


# Trends.

SCORED = f"""
{HOST_PARTS}, {DAILY},
ordered AS (SELECT *, row_number() OVER w - 1 AS x, row_number() OVER v AS age FROM daily
  WINDOW w AS (PARTITION BY project, variant, page_title, country ORDER BY year, month, day),
         v AS (PARTITION BY project, variant, page_title, country ORDER BY year DESC, month DESC, day DESC)),
scored AS (SELECT project, variant, page_title, country, avg(n) AS popularity,
  CASE WHEN count(*) = 1 THEN 0 ELSE regr_slope(n, x) END AS trend
  FROM ordered GROUP BY project, variant, page_title, country)
"""


def sql_tidy(expression):
    return (f"CASE WHEN round({expression}, 6) = 0 THEN CAST(0 AS DOUBLE) "
            f"ELSE round({expression}, 6) END")


def tidied(df, *columns):
    for column in columns:
        df = df.withColumn(column, tidy(column))
    return df


@checked("trend_level_slope", f"""
WITH {SCORED} SELECT project, variant, page_title, country, {sql_tidy('popularity')} AS popularity,
{sql_tidy('trend')} AS trend FROM scored""")
def trend_level_slope(spark, folder):
    return tidied(trends.trend_level_slope(daily_series(spark, folder)), "popularity", "trend")


@checked("most_trending_pages", f"""
WITH {SCORED}, shown AS (SELECT project, variant, page_title, country,
  {sql_tidy('popularity')} AS popularity, {sql_tidy('trend')} AS trend FROM scored)
SELECT * FROM shown ORDER BY trend DESC, project, variant, page_title, country LIMIT 100""")
def most_trending_pages(spark, folder):
    scores = trend_level_slope(spark, folder)
    return trends.top_scored(scores, 100, "trend", pageviews.DAILY_KEYS)


@checked("published_trends", f"""
WITH {HOST_PARTS}, {DAILY},
ordered AS (SELECT *, row_number() OVER (PARTITION BY project, variant, page_title, country
  ORDER BY year, month, day) - 1 AS x FROM daily
  WHERE project = 'wikipedia' AND make_date(year, month, day) <= DATE '2024-01-20'),
scored AS (SELECT project, variant, page_title, country, avg(n) AS popularity,
  CASE WHEN count(*) = 1 THEN 0 ELSE regr_slope(n, x) END AS trend FROM ordered GROUP BY ALL)
SELECT project, variant, page_title, country, {sql_tidy('popularity')} AS popularity,
  {sql_tidy('trend')} AS trend, 2024 AS year, 1 AS month, 20 AS day FROM scored""")
def published_trends(spark, folder):
    daily, scores = scratch_path(spark, "daily"), scratch_path(spark, "trends")
    tables.publish_partitions(daily_series(spark, folder), daily, ["year", "month", "day"])
    jobs.publish_trends(spark, daily, scores, date(2024, 1, 20), since_year=2015)
    return tidied(spark.read.parquet(scores), "popularity", "trend")


@checked("burst_score", f"""
WITH {SCORED}, recent AS (SELECT project, variant, page_title, country, count(*) AS days,
  CAST(max(n) FILTER (age = 1) AS DOUBLE) AS last, CAST(sum(n) AS DOUBLE) AS total
  FROM ordered WHERE age <= 8 GROUP BY project, variant, page_title, country),
burst AS (SELECT *, CASE WHEN days = 1 THEN last ELSE last - (total - last) / (days - 1) END
  * (1 + ln(1 + total)) AS score FROM recent)
SELECT project, variant, page_title, country, {sql_tidy('score')} AS score FROM burst""")
def burst_score(spark, folder):
    return tidied(trends.burst_score(daily_series(spark, folder)), "score")


@checked("monthly_trend", f"""
WITH {SCORED} SELECT project, variant, page_title, country,
  CAST(coalesce(sum(n) FILTER (age <= 15), 0) - coalesce(sum(n) FILTER (age BETWEEN 16 AND 30), 0)
  AS DOUBLE) AS trend
FROM ordered GROUP BY project, variant, page_title, country""")
def monthly_trend(spark, folder):
    return trends.monthly_trend(daily_series(spark, folder))


@checked("daily_trend", f"""
WITH {SCORED}, parts AS (SELECT project, variant, page_title, country,
  CAST(max(n) FILTER (age = 1) AS DOUBLE) AS y2, CAST(max(n) FILTER (age = 8) AS DOUBLE) AS y1,
  CAST(sum(n) FILTER (age BETWEEN 2 AND 8) AS DOUBLE) AS w, CAST(sum(n) AS DOUBLE) AS total
  FROM ordered GROUP BY project, variant, page_title, country),
valued AS (SELECT *, (y2 - y1) * (1 + ln(1 + w)) AS trend, 1 / sqrt(total) AS error FROM parts)
SELECT project, variant, page_title, country, {sql_tidy('trend')} AS trend,
  {sql_tidy('error')} AS error FROM valued""")
def daily_trend(spark, folder):
    return tidied(trends.daily_trend(daily_series(spark, folder)), "trend", "error")


RATIO = f"""
{HOST_PARTS}, {DAILY},
before AS (SELECT project, variant, page_title, country, sum(n) AS n FROM daily
  WHERE day <= 15 GROUP BY ALL),
after AS (SELECT project, variant, page_title, country, sum(n) AS n FROM daily
  WHERE day > 15 GROUP BY ALL),
ratios AS (SELECT after.project, after.variant, after.page_title, after.country,
  round(CAST(after.n AS DOUBLE) / CAST(before.n AS DOUBLE), 6) AS score FROM before JOIN after
  USING (project, variant, page_title, country))
"""
TOP_RATIO = f"""
{RATIO}, top AS (SELECT page_title, score FROM ratios
  WHERE variant = 'en' AND project = 'wikipedia' AND country = 'US'
  ORDER BY score DESC, page_title LIMIT 5)
"""


def ratio_scores(spark, folder):
    scores = trends.trend_ratio(daily_series(spark, folder), F.col("day") <= 15, F.col("day") > 15)
    return tidied(scores, "score")


def top_ratio(spark, folder):
    return trends.top_scored(ratio_scores(spark, folder), 5, variant="en", project="wikipedia",
                             country="US").select("page_title", "score")


@checked("trend_ratio", f"WITH {RATIO} SELECT project, variant, page_title, country, score FROM ratios")
def trend_ratio(spark, folder):
    return ratio_scores(spark, folder)


@checked("top_trend_ratio", f"WITH {TOP_RATIO} SELECT * FROM top")
def top_trend_ratio(spark, folder):
    return top_ratio(spark, folder)


@checked("series_of_top_pages", f"""
WITH {TOP_RATIO} SELECT page_title, year, month, day, CAST(sum(n) AS BIGINT) AS n FROM daily
WHERE variant = 'en' AND project = 'wikipedia' AND country = 'US'
AND page_title IN (SELECT page_title FROM top) GROUP BY page_title, year, month, day""")
def series_of_top_pages(spark, folder):
    series = daily_series(spark, folder).where(
        "variant = 'en' AND project = 'wikipedia' AND country = 'US'")
    return trends.series_of_top(series, top_ratio(spark, folder))


@checked("country_panel", f"""
WITH {HOST_PARTS}, {DAILY}
SELECT project, variant, page_title, country, year, month, day, CAST(sum(n) AS BIGINT) AS n FROM daily
WHERE page_title = 'Café_0' AND project = 'wikipedia' AND variant = 'en'
AND country IN ('US', 'CN', 'DE', 'IT', 'EG') GROUP BY ALL
ORDER BY country, year, month, day LIMIT 100""")
def country_panel(spark, folder):
    panel = trends.country_panel(daily_series(spark, folder), "Café_0", "wikipedia", "en",
                                 ["US", "CN", "DE", "IT", "EG"])
    return trends.first_rows(panel, ["country", "year", "month", "day"], 100)


@checked("rows_in_key_order", f"WITH {HOST_PARTS}, {DAILY} SELECT * FROM daily WHERE project = 'wikipedia'")
def rows_in_key_order(spark, folder):
    return trends.in_key_order(daily_series(spark, folder).where("project = 'wikipedia'"))


@checked("daily_series_without_gaps", f"""
WITH {HOST_PARTS}, {DAILY},
dated AS (SELECT *, make_date(year, month, day) AS d FROM daily),
spans AS (SELECT project, variant, page_title, country, min(d) AS lo, max(d) AS hi FROM dated GROUP BY ALL),
spine AS (SELECT project, variant, page_title, country,
  CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM spans)
SELECT project, variant, page_title, country, CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month,
  CAST(day(d) AS INT) AS day, coalesce(n, 0) AS n
FROM spine LEFT JOIN (SELECT project, variant, page_title, country, d, n FROM dated) x
USING (project, variant, page_title, country, d)""")
def daily_series_without_gaps(spark, folder):
    return trends.fill_gaps(daily_series(spark, folder))
