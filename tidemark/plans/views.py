"""Views that give the test tables the shape of the library's inputs.

One SQL text per view. Spark runs it on the tables of a folder; the check SQL uses
the same text as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REQUESTS = """
SELECT event_id, ts, user_id, event_type, k,
  CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month,
  CAST(day(ts) AS INT) AS day, CAST(hour(ts) AS INT) AS hour,
  CASE WHEN user_id % 2 = 1 THEN 'mobile' ELSE 'text' END AS webrequest_source,
  concat(CASE user_id % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'zh' WHEN 2 THEN 'it' WHEN 3 THEN 'he' ELSE 'am' END,
         CASE WHEN user_id % 2 = 1 THEN '.m' ELSE '' END,
         CASE WHEN event_id % 10 = 0 THEN '.wiktionary.org' ELSE '.wikipedia.org' END) AS uri_host,
  CASE WHEN event_type = 'error' THEN '/w/index.php'
       ELSE concat('/wiki/Caf%C3%A9_', CAST(k % 20 AS STRING)) END AS uri_path,
  CASE WHEN event_id % 13 = 0 THEN '?action=raw' ELSE '' END AS uri_query,
  CASE WHEN event_id % 7 = 0 THEN 'image/png' ELSE 'text/html; charset=utf-8' END AS content_type,
  CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN '404' ELSE '200' END AS http_status,
  CASE user_id % 11 WHEN 0 THEN 'Spiderbot/2.1' WHEN 1 THEN 'MediaWiki/1.24' WHEN 2 THEN 'WikipediaApp/2.0' ELSE 'Mozilla/5.0' END AS user_agent,
  concat('10.0.', CAST(user_id % 3 AS STRING), '.', CAST(user_id % 250 AS STRING)) AS ip,
  CASE WHEN event_id % 4 = 0 THEN concat('192.0.2.', CAST(user_id % 8 AS STRING)) END AS x_forwarded_for,
  CASE user_id % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'CN' WHEN 2 THEN 'IT' WHEN 3 THEN 'EG' WHEN 4 THEN 'IR' ELSE 'DE' END AS country,
  CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS https,
  CASE WHEN user_id % 11 = 0 THEN 'spider' ELSE 'user' END AS agent_type,
  CASE WHEN user_id % 2 = 1 THEN 'mobile web' ELSE 'desktop' END AS access_method,
  event_type IN ('view', 'click', 'purchase') AS is_pageview
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e
"""

PAGES = """
SELECT p_partkey AS page_id, concat('Page_', CAST(p_partkey AS STRING)) AS page_title,
  CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END AS page_namespace,
  CASE WHEN p_size % 10 = 0 THEN 1 ELSE 0 END AS page_is_redirect
FROM {part}
"""

CLICKS = """
SELECT concat('Page_', CAST(a.l_partkey AS STRING)) AS prev,
  concat('Page_', CAST(b.l_partkey % 20 AS STRING)) AS curr,
  CAST(a.l_quantity AS BIGINT) AS n
FROM {lineitem} a JOIN {lineitem} b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
"""

LINKS = """
SELECT l_orderkey AS pl_from, CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END AS pl_from_namespace,
  concat('Page_', CAST(l_partkey AS STRING)) AS pl_title,
  CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END AS pl_namespace
FROM {lineitem}
"""

REVISIONS = """
SELECT o_custkey AS rev_user, l_partkey AS rev_page
FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey
"""

PREFS = """
SELECT DISTINCT o_custkey AS user_id, l_partkey AS item_id
FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey
"""

IMPRESSIONS = """
SELECT event_id AS impression_id, ts, concat('e', CAST(user_id % 3 AS STRING)) AS experiment,
  CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS variant,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS converted,
  CASE WHEN event_type = 'purchase' THEN CAST(5 * (1 + CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 5) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS amount,
  CASE WHEN event_type = 'purchase' THEN value ELSE CAST(0 AS DOUBLE) END AS revenue,
  value
FROM {events}
"""

ACTIVITY = """
SELECT o_custkey AS user_id, last_day(CAST(o_orderdate AS DATE)) AS month,
  COUNT(CASE WHEN o_orderpriority LIKE '1%' THEN 1 END) AS cla_0,
  COUNT(CASE WHEN o_orderpriority LIKE '2%' THEN 1 END) AS cla_1,
  COUNT(CASE WHEN o_orderpriority LIKE '3%' THEN 1 END) AS cla_2,
  COUNT(CASE WHEN o_orderpriority LIKE '4%' THEN 1 END) AS cla_3,
  COUNT(*) AS cla_tot,
  COUNT(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS cala_0,
  COUNT(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS crla_0,
  MAX(12 * (year(o_orderdate) - 1992) + month(o_orderdate)) AS v_no_months,
  MAX(12 * (year(o_orderdate) - 1992) + month(o_orderdate)) - o_custkey % 7 AS aeb_no_months,
  COUNT(CASE WHEN o_totalprice > 250000 THEN 1 END) AS talk_counts,
  MAX(o_orderkey % 9) AS friend_count
FROM {orders} GROUP BY o_custkey, last_day(CAST(o_orderdate AS DATE))
"""

INCIDENTS = """
SELECT * FROM (VALUES ('rollout', TIMESTAMP '2024-01-09 21:00:00', TIMESTAMP '2024-01-12 09:00:00'),
  ('outage', TIMESTAMP '2024-01-12 08:43:00', TIMESTAMP '2024-01-12 10:40:00')) v(label, start_ts, end_ts)
"""

IP_RANGES = """
SELECT * FROM (VALUES (167772160, 167772415, 'Aland'), (167772416, 167837695, 'Borduria'),
  (3221225984, 3221226239, 'Cascara')) v(first_ip, last_ip, country)
"""

ADDRESSES = """
SELECT event_id, user_id, CASE WHEN event_id % 10 = 9 THEN concat('host', CAST(user_id AS STRING))
  WHEN event_id % 3 = 0 THEN concat('2001:DB8:', CAST(user_id % 8 AS STRING), '::', CAST(event_id % 7 AS STRING))
  WHEN event_id % 3 = 1 THEN concat('10.0.', CAST(user_id % 3 AS STRING), '.', CAST(user_id % 250 AS STRING))
  ELSE concat('::ffff:10.0.', CAST(user_id % 3 AS STRING), '.', CAST(user_id % 250 AS STRING)) END AS client
FROM {events}
"""

BLOCKS = """
SELECT * FROM (VALUES ('2001:db8::/32', 'Aland'), ('2001:db8:4::/46', 'Borduria'),
  ('2001:db8:6::/48', 'Cascara'), ('10.0.0.0/16', 'Dawsbergen'), ('10.0.1.0/24', 'Elbonia'),
  ('fe80::/10', 'Freedonia')) v(block, country)
"""

TEXTS = {
    "requests": REQUESTS, "page_dim": PAGES, "clicks": CLICKS, "links": LINKS,
    "revisions": REVISIONS, "prefs": PREFS, "impressions": IMPRESSIONS,
    "activity": ACTIVITY, "incidents": INCIDENTS, "ip_ranges": IP_RANGES,
    "addresses": ADDRESSES, "blocks": BLOCKS,
}
TABLES = ("events", "part", "lineitem", "orders")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A view over the tables of a folder."""
    text = TEXTS[name]
    used = {t: table(spark, folder, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def view_of(spark: SparkSession, name: str, **tables: DataFrame) -> DataFrame:
    """A view over given DataFrames, streaming ones included."""
    return spark.sql(TEXTS[name], **tables)


def with_views(body: str, *names: str) -> str:
    """Check SQL: the body behind the named views as common table expressions."""
    ctes = [f"{n} AS ({TEXTS[n].format(**{t: t for t in TABLES}).strip()})" for n in names]
    body = body.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join([*ctes, body[5:]])
    return "WITH " + ",\n".join(ctes) + "\n" + body
