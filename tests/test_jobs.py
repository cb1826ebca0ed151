"""The scheduled jobs on a small log."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.plans import jobs
from tidemark.sources import slots, tables
from tidemark.sources.requests import REQUEST_SCHEMA


def write_log(spark, path):
    def row(day, hour, title, ip, **changes):
        values = dict.fromkeys(REQUEST_SCHEMA.names)
        values.update(uri_host="en.m.wikipedia.org", uri_path=f"/wiki/{title}", uri_query="", user_agent="Mozilla",
                      ip=ip, is_pageview=True, geocoded_data={"country": "US" if ip < "2" else "CA"},
                      webrequest_source="text", year=2024, month=1, day=day, hour=hour)
        values.update(changes)
        return values
    rows = [row(1, 0, "A", "1.0.0.1"), row(1, 5, "A", "1.0.0.2"), row(1, 5, "A", "2.0.0.1"),
            row(1, 5, "B", "9.9.9.9", x_forwarded_for="1.0.0.9"), row(2, 0, "A", "1.0.0.1"),
            row(1, 6, "A", "1.0.0.1", is_pageview=False), row(1, 7, "A", "1.0.0.1", user_agent="Spider/1"),
            row(1, 8, "A", "1.0.0.1", webrequest_source="upload")]
    tables.publish_partitions(spark.createDataFrame(rows, REQUEST_SCHEMA), path,
                              ["webrequest_source", "year", "month", "day", "hour"])


def test_daily_hourly_and_trends(spark, tmp_path):
    log, daily, hourly, scores = (str(tmp_path / n) for n in ("log", "daily", "hourly", "scores"))
    write_log(spark, log)
    for day in (1, 2, 2):
        jobs.publish_daily_pageviews(spark, log, daily, date(2024, 1, day), one_in=1)
    found = {(r.page_title, r.country, r.day): r.n for r in spark.read.parquet(daily).collect()}
    assert found == {("A", "US", 1): 2, ("A", "CA", 1): 1, ("B", "CA", 1): 1, ("A", "US", 2): 1}

    ranges = spark.createDataFrame([(16777216, 33554431, "One")], "first_ip LONG, last_ip LONG, country STRING")
    jobs.publish_hourly_pageviews(spark, log, hourly, datetime(2024, 1, 1, 5), ranges, one_in=1)
    rows = {(r.page_title, r.country, r.access_method, r.hour): r.n for r in spark.read.parquet(hourly).collect()}
    assert rows == {("A", "One", "mobile web", 5): 1, ("A", None, "mobile web", 5): 1,
                    ("B", "One", "mobile web", 5): 1}

    jobs.publish_trends(spark, daily, scores, date(2024, 1, 2))
    trend = {(r.page_title, r.country): (r.popularity, r.trend) for r in spark.read.parquet(scores).collect()}
    assert trend == {("A", "US"): (1.5, -1.0), ("A", "CA"): (1.0, 0.0), ("B", "CA"): (1.0, 0.0)}


def test_daily_sample_is_scaled(spark, tmp_path):
    log, daily = (str(tmp_path / n) for n in ("log", "daily"))
    write_log(spark, log)
    jobs.publish_daily_pageviews(spark, log, daily, date(2024, 1, 1), one_in=2, key="ip")
    assert {r.n % 2 for r in spark.read.parquet(daily).collect()} <= {0}


def test_jobs_wait_for_input_and_drop_old_slots(spark, tmp_path):
    log, daily, hourly = (str(tmp_path / n) for n in ("log", "daily", "hourly"))
    write_log(spark, log)
    with pytest.raises(jobs.IncompleteInput, match="lacks the hour"):
        jobs.daily_job(spark, log, daily, date(2024, 1, 1), one_in=1)
    assert not (tmp_path / "daily").exists()
    ranges = spark.createDataFrame([(16777216, 33554431, "One")], "first_ip LONG, last_ip LONG, country STRING")
    with pytest.raises(jobs.IncompleteInput, match="of mobile"):  # one source is not enough
        jobs.hourly_job(spark, log, hourly, datetime(2024, 1, 1, 5), ranges, one_in=1)
    for day, hour in ((1, 5), (2, 0)):
        slots.mark_slot(spark, log, webrequest_source="mobile", year=2024, month=1, day=day, hour=hour)
    jobs.hourly_job(spark, log, hourly, datetime(2024, 1, 1, 5), ranges, one_in=1)
    jobs.hourly_job(spark, log, hourly, datetime(2024, 1, 2, 0), ranges, keep_days=1, one_in=1)
    assert {r.day for r in spark.read.parquet(hourly).collect()} == {2}


def test_a_slot_is_swapped_in_whole(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([(1,), (2,)], "n INT")
    tables.publish_partition(rows, path, year=2024, month=1, day=1)
    failing = rows.select(F.raise_error("no").cast("int").alias("n"))
    with pytest.raises(Exception):
        tables.publish_partition(failing, path, year=2024, month=1, day=1)
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == [1, 2]  # the old one stays
    tables.publish_partition(rows.where("n = 2"), path, year=2024, month=1, day=1)
    assert [r.n for r in spark.read.parquet(path).collect()] == [2]
    with pytest.raises(OSError):
        slots.swap_in(spark, f"{path}/_nothing", path, year=2024, month=1, day=1)
    assert [r.n for r in spark.read.parquet(path).collect()] == [2]
    assert not [p.name for p in (tmp_path / "table").iterdir() if p.name.startswith("_replaced")]


def test_slots_are_listed_by_name(spark, tmp_path):
    path = str(tmp_path / "table")
    assert slots.listed_slots(spark, path, ["year", "month", "day"]) == [] and tables.newest_day(spark, path) is None
    for day in (1, 2, 9, 10):
        slots.mark_slot(spark, path, year=2024, month=1, day=day, hour=0)
        slots.mark_slot(spark, path, year=2024, month=1, day=day, hour=7)
    assert slots.has_slot(spark, path, year=2024, month=1, day=9, hour=7)
    assert not slots.has_slot(spark, path, year=2024, month=1, day=9, hour=8)
    assert tables.newest_day(spark, path) == date(2024, 1, 10)
    assert tables.drop_expired_slots(spark, path, date(2024, 1, 10), 2) == 2  # empty ones too
    assert sorted(int(s["day"]) for s in slots.listed_slots(spark, path, ["year", "month", "day"])) == [9, 10]
