"""From web requests to page views and their counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed
from tidemark.functions import requests as rq
from tidemark.session import written

CLIENT = ("user_agent", "ip", "x_forwarded_for")
DAILY_KEYS = ("project", "variant", "page_title", "country")
HOURLY_KEYS = ("project", "variant", "page_title", "access_method", "country")


def is_pageview_request(df: DataFrame) -> DataFrame:
    """Keeps requests for content pages.

    A missing field never passes the rules that use it.
    """
    target = F.concat("uri_path", "uri_query")
    app_read = F.col("user_agent").rlike(fixed.APP_AGENT) & F.concat(
        "uri_host", target).rlike(fixed.APP_PAGE_QUERY)
    rules = [
        F.col("content_type").isin(fixed.PAGE_CONTENT_TYPES),
        F.col("http_status") == fixed.OK_STATUS,
        F.col("uri_host").rlike(fixed.PRODUCTION_HOST),
        target.rlike(fixed.CONTENT_PATH),
        ~F.col("uri_path").rlike(fixed.SPECIAL_PAGE),
        ~target.rlike(fixed.SEARCH_QUERY),
        ~F.col("user_agent").rlike(fixed.INTERNAL_AGENT),
        ~F.col("uri_path").rlike(fixed.API_PATH) | app_read,
    ]
    for rule in rules:
        df = df.where(rule)
    return df


def drop_spiders(df: DataFrame, rules=rq.DEVICE_RULES) -> DataFrame:
    """Drops requests whose device family is 'Spider'."""
    return df.where(rq.device_family("user_agent", rules) != "Spider")


def drop_crawlers(df: DataFrame, pattern: str = rq.CRAWLER_AGENT) -> DataFrame:
    """Drops requests of self-declared crawlers."""
    return df.where(~rq.is_crawler("user_agent", pattern))


def flagged_pageviews(df: DataFrame) -> DataFrame:
    """Keeps requests already flagged as page views."""
    return df.where(F.col("is_pageview"))


def drop_script_paths(df: DataFrame) -> DataFrame:
    """Drops requests to the script directory."""
    return df.where(~F.col("uri_path").rlike(fixed.SCRIPT_PATH))


def allowed_hosts(df: DataFrame, pattern: str = fixed.TRANSITION_HOST,
                  sources: Sequence[str] | None = fixed.REQUEST_SOURCES) -> DataFrame:
    """Keeps requests to hosts that contain the pattern, from the given sources."""
    if sources is not None:
        df = df.where(F.col("webrequest_source").isin(list(sources)))
    return df.where(F.col("uri_host").rlike(pattern))


def drop_heavy_users(df: DataFrame, max_hits: int = fixed.HEAVY_USER_HITS,
                     client: Sequence[str] = CLIENT,
                     per: Sequence[str] = ("year", "month", "day", "hour")) -> DataFrame:
    """Drops all requests of a client with ``max_hits`` or more in one hour.

    A client is one combination of ``client``, a missing field included. The
    heavy clients are counted with map-side partial sums and anti-joined: they
    are at most 1 in ``max_hits`` of the rows, so this side is the small one, and
    Spark broadcasts it only if its measured size allows.
    """
    keys = [*client, *per]
    heavy = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_hits"))
        .where(F.col("_hits") >= max_hits)
        .select(*[F.col(k).alias(f"_heavy_{k}") for k in keys])
    )
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_heavy_{k}"))
        on = same if on is None else on & same
    return df.join(heavy, on, "left_anti")


def readers_only(df: DataFrame) -> DataFrame:
    """The row filters shared by all page-view counts."""
    return drop_spiders(drop_crawlers(flagged_pageviews(drop_script_paths(df))))


def geo_rows(df: DataFrame, keep: Sequence[str] = (), country: Column | None = None,
             access: Column | None = None) -> DataFrame:
    """One row per page view with its project, language, title, access method and country."""
    return readers_only(df).select(
        *keep,
        rq.project("uri_host").alias("project"),
        rq.variant("uri_host").alias("variant"),
        rq.page_title("uri_path").alias("page_title"),
        (rq.access_method("uri_host", "user_agent") if access is None else access).alias("access_method"),
        (F.col("country") if country is None else country).alias("country"),
    )


def geo_pageviews_daily(df: DataFrame, scale: int = fixed.SAMPLE_ONE_IN,
                        country: Column | None = None,
                        dates: Sequence[str] = ("year", "month", "day")) -> DataFrame:
    """Page views per day, project, language, title and country.

    ``scale`` undoes the sampling of the scan.
    """
    return geo_rows(df, dates, country).groupBy(*DAILY_KEYS, *dates).agg(
        (F.lit(scale).cast("long") * F.count(F.lit(1))).alias("n"))


def geo_pageviews_hourly(df: DataFrame, scale: int = 1, country: Column | None = None,
                         access: Column | None = None,
                         dates: Sequence[str] = ("year", "month", "day", "hour")) -> DataFrame:
    """Page views per hour, split by access method as well."""
    return geo_rows(df, dates, country, access).groupBy(*HOURLY_KEYS, *dates).agg(
        (F.lit(scale).cast("long") * F.count(F.lit(1))).alias("n"))


def locate(df: DataFrame, ip: Column, ranges: DataFrame, name: str = "country") -> DataFrame:
    """Adds the country of an address from a table of disjoint address ranges.

    ``ranges`` has ``first_ip``, ``last_ip`` (numbers) and ``country``. Both sides
    meet on the upper 16 bits, so the join is an equi join that shuffles by prefix
    (skewed prefixes are split by adaptive execution) and needs no broadcast; a
    range is repeated once per prefix it covers, at most 65,536 times.
    """
    by_prefix = ranges.select(
        F.col("first_ip").cast("long").alias("_first"),
        F.col("last_ip").cast("long").alias("_last"),
        F.col("country").alias("_country"),
    ).withColumn("_prefix", F.explode(F.sequence(
        F.shiftright("_first", 16), F.shiftright("_last", 16))))
    numbered = df.withColumn("_ip", rq.ip_number(ip))
    on = ((F.shiftright("_ip", 16) == F.col("_prefix"))
          & (F.col("_ip") >= F.col("_first")) & (F.col("_ip") <= F.col("_last")))
    kept = [c for c in df.columns if c != name]
    return numbered.join(by_prefix, on, "left").select(*kept, F.col("_country").alias(name))


def locate_by_block(df: DataFrame, ip: Column, blocks: DataFrame, name: str = "country") -> DataFrame:
    """Adds the country of an address, IPv4 or IPv6, by the longest block that holds it.

    ``blocks`` has ``block`` ('2001:db8::/32') and ``country``; blocks may lie inside each
    other. Of a block that is listed twice the first country counts; what is no address has
    none. Each distinct address is looked up once: it meets the blocks on its leading bits,
    at every length that blocks have (129 at most), so the join is an equi join whatever the
    blocks cover. Then the log is joined to its addresses.
    """
    cut = F.split("block", "/")
    size = F.get(cut, F.lit(1)).try_cast("int") + F.when(F.contains("block", F.lit(":")), 0).otherwise(96)
    listed = blocks.select(rq.address_digits(F.get(cut, F.lit(0))).alias("_digits"),
                           size.alias("_length"), F.col("country").alias("_country")).where(
        F.col("_length").between(0, 128) & F.col("_digits").isNotNull())
    keyed = written(listed.groupBy(rq.leading_bits(F.col("_digits"), F.col("_length")).alias("_bits"),
                                   "_length").agg(F.min("_country").alias("_country")), "blocks")
    lengths = sorted(r[0] for r in keyed.select("_length").distinct().collect())
    addresses = df.select(ip.alias("_address")).distinct().withColumn(
        "_digits", rq.address_digits("_address")).where("_digits IS NOT NULL")
    probes = addresses.withColumn(
        "_length", F.explode(F.lit(lengths) if lengths else F.array().cast("array<int>"))).withColumn(
        "_bits", rq.leading_bits(F.col("_digits"), F.col("_length")))
    located = written(probes.join(keyed.drop("_length"), "_bits").groupBy("_address").agg(
        F.max_by("_country", "_length").alias("_country")), "located")
    kept = [c for c in df.columns if c != name]
    return df.withColumn("_ip", ip).join(located, F.col("_ip") == F.col("_address"), "left").select(
        *kept, F.col("_country").alias(name))
