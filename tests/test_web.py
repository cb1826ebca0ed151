"""Requests, page views, sources and traffic, by hand-made cases."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import requests as rq
from tidemark.operators import pageviews, traffic
from tidemark.sources import requests as request_log
from tidemark.sources import tables


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize("host, project, variant", [
    ("en.wikipedia.org", "wikipedia", "en"),
    ("en.m.wikipedia.org", "wikipedia", "en"),
    ("www.wikidata.org", "wikidata", ""),
    ("www.en.wikipedia.org", "wikipedia", "en"),
    ("de.zero.wiktionary.org:80", "wiktionary", "de"),
    ("m.wikipedia.org", "wikipedia", ""),
    ("am.wikipedia.org", "wikipedia", ""),
    ("wikipedia.org", "wikipedia", ""),
    ("commons.wikimedia.org", "wikimedia", "commons"),
    ("localhost", None, ""),
    ("example.com", "example", ""),
])
def test_hosts(spark, host, project, variant):
    df = spark.createDataFrame([(host,)], "h STRING")
    assert values(df, rq.project("h"), rq.variant("h")) == [(project, variant)]


@pytest.mark.parametrize("path, title", [
    ("/wiki/Main_Page", "Main_Page"),
    ("/wiki/Caf%C3%A9", "Café"),
    ("/wiki/a/b", "a/b"),
    ("/wiki/C%2B%2B+x", "C++ x"),
    ("/wiki/100%", None),
    ("/wiki/%zz", None),
    ("/", ""),
])
def test_titles(spark, path, title):
    assert values(spark.createDataFrame([(path,)], "p STRING"), rq.page_title("p")) == [(title,)]


def test_encoding_follows_forms(spark):
    df = spark.createDataFrame([("a b*c",)], "t STRING")
    assert values(df, rq.encoded_title("t"), rq.decoded_title(rq.encoded_title("t"))) == [("a+b*c", "a b*c")]


def test_addresses(spark):
    df = spark.createDataFrame([
        ("10.0.0.1", None), ("10.0.0.1", "-"), ("10.0.0.1", "192.0.2.5, 10.1.1.1"), ("x", None),
        ("1.2.3", None), ("1.2.3.256", None)], "ip STRING, xff STRING")
    found = values(df, rq.client_ip("ip", "xff"), rq.ip_number(rq.client_ip("ip", "xff")))
    assert found == [("10.0.0.1", 167772161), ("10.0.0.1", 167772161), ("192.0.2.5", 3221225989),
                     ("x", None), ("1.2.3", None), ("1.2.3.256", None)]


def test_access_and_devices(spark):
    df = spark.createDataFrame([
        ("en.wikipedia.org", "Mozilla/5.0"), ("en.m.wikipedia.org", "Mozilla/5.0 iPhone"),
        ("en.m.wikipedia.org", "WikipediaApp/2"), ("en.wikipedia.org", "Googlebot/2.1")],
        "h STRING, ua STRING")
    found = values(df, rq.access_method("h", "ua"), rq.device_family("ua"), rq.is_crawler("ua"))
    assert found == [("desktop", "Other", False), ("mobile web", "iPhone", False),
                     ("mobile app", "Other", False), ("desktop", "Spider", True)]


def request(**changes):
    row = dict(uri_host="en.wikipedia.org", uri_path="/wiki/A", uri_query="", content_type="text/html",
               http_status="200", user_agent="Mozilla/5.0")
    row.update(changes)
    return row


@pytest.mark.parametrize("changes, kept", [
    ({}, True),
    ({"content_type": "text/html; charset=UTF-8"}, True),
    ({"content_type": "image/png"}, False),
    ({"uri_host": "example.org"}, False),
    ({"uri_host": "commons.m.wikimedia.org"}, True),
    ({"uri_path": "/w/api.php", "uri_query": "?sections=0"}, False),
    ({"uri_path": "/w/api.php", "uri_query": "?sections=0", "user_agent": "WikipediaApp/1"}, True),
    ({"uri_path": "/w/api.php", "user_agent": "WikipediaApp/1"}, False),
    ({"uri_path": "/about"}, False),
    ({"uri_path": "/zh-tw/A"}, True),
    ({"uri_path": "/wiki", "uri_query": "?curid=3"}, True),
    ({"http_status": "301"}, False),
    ({"http_status": "-"}, False),
    ({"user_agent": "MediaWiki/1.24"}, False),
    ({"uri_path": "/wiki/Special:Search"}, False),
    ({"uri_path": "/w/index.php", "uri_query": "?search=a"}, False),
    ({"user_agent": None}, False),
    ({"uri_query": None}, False),
])
def test_pageview_rules(spark, changes, kept):
    schema = ", ".join(f"{k} STRING" for k in request())
    df = spark.createDataFrame([request(**changes)], schema)
    assert pageviews.is_pageview_request(df).count() == int(kept)


def test_heavy_users_at_the_limit(spark):
    rows = [("ua", "1.1.1.1", None)] * 199 + [("ua", "2.2.2.2", None)] * 200 + [("ua", "2.2.2.2", "x")]
    df = spark.createDataFrame(rows, "user_agent STRING, ip STRING, x_forwarded_for STRING").select(
        "*", *[F.lit(1).alias(c) for c in ("year", "month", "day", "hour")])
    left = pageviews.drop_heavy_users(df)
    assert values(left.groupBy("ip", "x_forwarded_for").count().orderBy("ip"),
                  "ip", "x_forwarded_for", "count") == [("1.1.1.1", None, 199), ("2.2.2.2", "x", 1)]


def test_country_ranges_meet_across_prefixes(spark):
    ranges = spark.createDataFrame([(0, 16777215, "low"), (16777216, 33554431 + 70000, "wide")],
                                   "first_ip LONG, last_ip LONG, country STRING")
    df = spark.createDataFrame([("0.1.2.3",), ("1.0.0.0",), ("2.0.255.255",), ("2.9.0.0",), ("?",)], "ip STRING")
    found = dict(values(pageviews.locate(df, F.col("ip"), ranges), "ip", "country"))
    assert found == {"0.1.2.3": "low", "1.0.0.0": "wide", "2.0.255.255": "wide", "2.9.0.0": None, "?": None}


def test_scan_prunes_partitions(spark, tmp_path):
    rows = [(i, "text" if i % 2 else "mobile", 2024, 1, 1 + i % 5, i % 24) for i in range(200)]
    df = spark.createDataFrame(rows, "id INT, webrequest_source STRING, year INT, month INT, day INT, hour INT")
    path = str(tmp_path / "log")
    tables.publish_partitions(df, path, ["webrequest_source", "year", "month", "day", "hour"])
    found = request_log.read_requests(spark, path, datetime(2024, 1, 2, 6), datetime(2024, 1, 4), ["text"])
    expected = {r[0] for r in rows if r[1] == "text" and datetime(2024, 1, 2, 6)
                <= datetime(*r[2:5], r[5]) < datetime(2024, 1, 4)}
    assert {r.id for r in found.collect()} == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Every filter is a partition filter, so no file outside the period is opened.
    assert "DataFilters: []" in plan and "Filter (" not in plan


def test_rerun_replaces_one_partition(spark, tmp_path):
    path = str(tmp_path / "table")
    first = spark.createDataFrame([("a", 1, 2024, 1, 1), ("b", 2, 2024, 1, 2)],
                                  "k STRING, n LONG, year INT, month INT, day INT")
    tables.publish_partitions(first, path, ["year", "month", "day"])
    again = spark.createDataFrame([("c", 9)], "k STRING, n LONG")
    for _ in range(2):
        tables.publish_partition(again, path, year=2024, month=1, day=2)
    assert sorted(values(spark.read.parquet(path), "k", "n", "day")) == [("a", 1, 1), ("c", 9, 2)]


def test_delimited_keeps_empty_and_missing_apart(spark, tmp_path):
    df = spark.createDataFrame([("", 1), (None, 2), ("a\"b", 3), ("ü", None)], "t STRING, n LONG")
    path = str(tmp_path / "text")
    tables.write_delimited(df, path)
    back = tables.read_delimited(spark, path, df.schema)
    assert sorted(values(back, "t", "n"), key=repr) == sorted(values(df, "t", "n"), key=repr)


def test_expired_partitions_are_dropped(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS kept_days")
    rows = [(i, 2024, 1, i) for i in range(1, 11)]
    (spark.createDataFrame(rows, "n INT, year INT, month INT, day INT").write
     .partitionBy("year", "month", "day").option("path", str(tmp_path / "days")).saveAsTable("kept_days"))
    assert tables.drop_expired(spark, "kept_days", date(2024, 1, 10), 7) == 3
    assert sorted(r.day for r in spark.table("kept_days").collect()) == [4, 5, 6, 7, 8, 9, 10]
    recent = tables.keep_recent(spark.table("kept_days"), date(2024, 1, 9), 2)
    assert sorted(r.day for r in recent.collect()) == [8, 9]
    spark.sql("DROP TABLE kept_days")


def test_missing_slots(spark):
    seen = spark.createDataFrame([(2024, 1, 1, h, "text") for h in range(24) if h != 5] +
                                 [(2024, 1, 1, h, "mobile") for h in range(24)],
                                 "year INT, month INT, day INT, hour INT, webrequest_source STRING")
    missing = request_log.missing_partitions(seen, datetime(2024, 1, 1), datetime(2024, 1, 1, 23), "hour",
                                             ["text", "mobile"])
    assert values(missing, "hour", "webrequest_source") == [(5, "text")]


def test_samples(spark):
    df = spark.range(64_000)
    assert 800 < request_log.sample_bucket(df, 64, seed=1).count() < 1200
    keyed = request_log.sample_bucket(df, 64, "id")
    assert 800 < keyed.count() < 1200
    assert keyed.exceptAll(request_log.sample_bucket(df, 64, "id")).count() == 0


@pytest.mark.parametrize("sep", ["\t", ","])
def test_every_text_comes_back(spark, tmp_path, sep):
    texts = [" blanks ", "a\tb", "two\nlines", "\r\n", '"quoted"', "back\\slash", "\\N", "\\", "\\\\n", "",
             None, "\0", "\\e", "\\s,", "#x", "é"]
    rows = [(i, t, i / 3) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "n LONG, t STRING, d DOUBLE")
    tables.write_delimited(df, str(tmp_path / "text"), sep)
    back = tables.read_delimited(spark, str(tmp_path / "text"), df.schema, sep)
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_an_empty_rerun_empties_its_slot(spark, tmp_path):
    df = spark.createDataFrame([(1, 2024, 1, 1), (2, 2024, 1, 2)], "n LONG, year INT, month INT, day INT")
    path = str(tmp_path / "table")
    tables.publish_partitions(df, path, ["year", "month", "day"])
    tables.publish_partition(df.where("false"), path, year=2024, month=1, day=2)
    assert [r.n for r in spark.read.parquet(path).collect()] == [1]


def test_import_query_is_split(spark, monkeypatch):
    asked = {}

    class Reader:
        def jdbc(self, url, table, **options):
            asked.update(url=url, table=table, **options)

    class Session:
        read = Reader()

    tables.read_jdbc_partitioned(Session(), "jdbc:x", "SELECT id FROM t", "id", 1, 100, 8, {"user": "u"})
    assert asked == {"url": "jdbc:x", "table": "(SELECT id FROM t) imported", "column": "id",
                     "lowerBound": 1, "upperBound": 100, "numPartitions": 8, "properties": {"user": "u"}}


def test_import_queries():
    sent = tables.import_query("page", ["page_id", "page_title"], "page_id > 3")
    assert sent == "SELECT page_id, page_title FROM page WHERE page_id > 3"


def test_binary_text_is_decoded(spark):
    df = spark.sql("SELECT 1 AS page_id, encode('Café', 'UTF-8') AS page_title")
    assert tables.as_text(df, ["page_title"]).collect() == [(1, "Café")]
    assert tables.as_text(df.select("page_id"), []).collect() == [(1,)]


def test_moments(spark):
    df = spark.createDataFrame([("2015-06-09 21:23",), ("soon",)], "t STRING")
    assert values(df, rq.moment("t")) == [(datetime(2015, 6, 9, 21, 23),), (None,)]


def test_protocols_with_missing_flag(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 0, 5), (1, None, 2), (2, None, 3)], "date INT, https INT, n LONG")
    for kind in ("int", "double", "string"):
        series = traffic.protocol_series(df.withColumn("https", F.col("https").cast(kind)))
        found = values(series.orderBy("date"), "date", "https", "http", "combined")
        assert found == [(1, 10, 7, 17), (2, None, 3, 3)]


def test_status_is_text(spark):
    df = spark.createDataFrame([("200",), ("-",), (None,)], "http_status STRING")
    assert traffic.successful(df).count() == 1


def test_events_tag_before_during_after(spark):
    hours = spark.createDataFrame([(datetime(2024, 1, 1, h),) for h in range(8)], "date TIMESTAMP")
    window = spark.createDataFrame([("w", datetime(2024, 1, 1, 2, 30), datetime(2024, 1, 1, 4))],
                                   "label STRING, start_ts TIMESTAMP, end_ts TIMESTAMP")
    tagged = traffic.annotate_events(hours, window, hours_around=1).orderBy("date")
    assert [r.phase for r in tagged.collect()] == [None, None, "before", "during", "after", None, None, None]
    assert tagged.count() == 8


def test_address_digits_against_the_standard_library(spark):
    import ipaddress
    import random
    rng = random.Random(7)
    texts = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "::ffff:1.2.3.4",
             "1:2:3:4:5:6:1.2.3.4", "64:ff9b::192.0.2.33", "10.0.0.1", "FE80::A", "2001:db8::0:1",
             "", ":", ":::", "1:2", "1::2::3", "1:2:3:4:5:6:7:8:9", "::12345", "g::", "1.2.3", "1.2.3.256", "::1.2.3",
             "1:2:3:4:5:6:7:1.2.3.4", "1:2:3:4:5:6:7:8::", ":1:2:3:4:5:6:7", "host", " ::1", "::1 "]
    for _ in range(300):
        number = rng.getrandbits(128) & rng.getrandbits(128) & rng.choice([-1, ~0xffffffff0000, 0xffff])
        texts.append(str(ipaddress.IPv6Address(number)))

    def plain(text):
        try:
            address = ipaddress.ip_address(text)
        except ValueError:
            return None
        number = int(address) + (0xffff00000000 if address.version == 4 else 0)
        return f"{number:032x}"

    df = spark.createDataFrame([(t,) for t in [*texts, None]], "ip STRING")
    found = {r.ip: r.digits for r in df.select("ip", rq.address_digits("ip").alias("digits")).collect()}
    assert found == {t: plain(t) for t in texts} | {None: None}


def test_longest_block_against_brute_force(spark):
    import ipaddress
    import random
    rng = random.Random(9)
    blocks = {}
    for n in range(60):
        if n % 3:
            net = ipaddress.ip_network((rng.getrandbits(16) << 112 >> rng.choice([0, 3]) & ~7 << 100, rng.randint(0, 20)),
                                       strict=False)
        else:
            net = ipaddress.ip_network((rng.getrandbits(32) & 0xc0ff0000, rng.randint(0, 24)), strict=False)
        blocks[str(net)] = f"c{n}"
    clients = [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(150)]
    clients += [str(ipaddress.IPv4Address(rng.getrandbits(32) & 0xc0ff00ff)) for _ in range(150)]
    clients += ["nothing", None, clients[0], clients[-1]]

    def wide(net):
        if net.version == 6:
            return net
        return ipaddress.ip_network((0xffff00000000 + int(net.network_address), net.prefixlen + 96))

    nets = [(wide(ipaddress.ip_network(b)), c) for b, c in blocks.items()]

    def plain(text):
        try:
            one = ipaddress.ip_address(text)
        except ValueError:
            return None
        six = ipaddress.IPv6Address(int(one) + (0xffff00000000 if one.version == 4 else 0))
        held = [(n.prefixlen, c) for n, c in nets if six in n]
        return max(held)[1] if held else None

    df = spark.createDataFrame([(n, c) for n, c in enumerate(clients)], "n INT, ip STRING")
    table = spark.createDataFrame([*blocks.items(), ("bad/8", "x"), ("1::/200", "x")], "block STRING, country STRING")
    found = pageviews.locate_by_block(df, F.col("ip"), table)
    assert {r.n: r.country for r in found.collect()} == {n: plain(c) for n, c in enumerate(clients)}
    assert pageviews.locate_by_block(df, F.col("ip"), table.limit(0)).where("country IS NOT NULL").count() == 0
