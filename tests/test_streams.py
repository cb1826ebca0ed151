"""Streams give what the batch forms give."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import experiments as ex
from tidemark.operators import pageviews as batch
from tidemark.streaming import monitor, pageviews

REQUEST = ("ts TIMESTAMP, uri_host STRING, uri_path STRING, user_agent STRING, country STRING, is_pageview BOOLEAN")


def requests(spark, hours):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(hours=h, minutes=5 * i), "en.wikipedia.org", f"/wiki/P{i % 2}", "Mozilla", "US", True)
            for h in hours for i in range(3)]
    return spark.createDataFrame(rows, REQUEST)


def test_closed_hours_are_published_once_and_late_rows_dropped(spark, tmp_path):
    log, table, state = (str(tmp_path / n) for n in ("log", "table", "state"))
    schema = requests(spark, [0]).schema

    def run():
        stream = spark.readStream.schema(schema).parquet(log)
        counts = pageviews.stream_pageviews(stream, "1 hour", "2 hours")
        pageviews.publish_stream(counts, table, state).awaitTermination()

    requests(spark, range(0, 10)).write.mode("append").parquet(log)
    run()
    requests(spark, [1]).write.mode("append").parquet(log)  # behind the watermark
    requests(spark, range(10, 14)).write.mode("append").parquet(log)
    run()
    published = spark.read.parquet(table)
    columns = [*batch.HOURLY_KEYS, "year", "month", "day", "hour", "n"]
    whole = requests(spark, range(0, 14)).select("*", *[
        f("ts").alias(n) for n, f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour))])
    expected = batch.geo_pageviews_hourly(whole).where("hour < 11").select(columns)
    assert published.select(columns).exceptAll(expected).count() == 0
    assert expected.exceptAll(published.select(columns)).count() == 0


def test_monitor_equals_batch_at_each_step(spark, tmp_path):
    files, out, state = (str(tmp_path / n) for n in ("files", "out", "state"))
    schema = "experiment STRING, variant STRING, amount LONG"
    steps = [[("x", v, 5 * int(i % (3 if v == "A" else 4 + s) == 0)) for v in "AB" for i in range(40 + 30 * s)]
             for s in range(4)]
    seen, results = [], []
    for rows in steps:
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(files)
        stream = spark.readStream.schema(schema).parquet(files)
        monitor.monitor_experiments(stream, out, state, alpha=0.2).awaitTermination()
        seen += rows
        found = monitor.monitored_results(spark, out).orderBy(F.desc("checkpoint")).first()
        if "continue" not in results[-1:] and results:
            assert found.checkpoint == len(results)  # decided: no further test
            continue
        stats = ex.sufficient_statistics(spark.createDataFrame(seen, schema), "amount")
        expected = ex.stop_ttest(ex.welch_t(ex.pair_variants(stats)), 0.2).first()
        results.append(expected.result)
        assert (found.a_n, found.b_n, found.result) == (expected.a_n, expected.b_n, expected.result)
        assert abs(found.t - expected.t) < 1e-9 and abs(found.p - expected.p) < 1e-9
    first = next((r for r in results if r != "continue"), None)
    decided = monitor.decisions(spark, out).collect()
    assert [r.result for r in decided] == ([] if first is None else [first])


def test_monitor_closes_experiments_that_stay_open(spark, tmp_path):
    files, out, state = (str(tmp_path / n) for n in ("files", "out", "state"))
    schema = "experiment STRING, variant STRING, amount LONG, ts TIMESTAMP"
    day = datetime(2024, 1, 1)
    for n, name in enumerate(("slow", "later", "later")):
        rows = [(name, v, i % 3, day + timedelta(days=4 * n)) for v in "AB" for i in range(12)]
        rows += [(None, "A", 1, day), (name, None, 1, day + timedelta(days=4 * n)), (name, "A", None, None)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(files)
        stream = spark.readStream.schema(schema).parquet(files)
        monitor.monitor_experiments(stream, out, state, ts="ts", patience_ms=3 * 86_400_000).awaitTermination()
    found = {(r.experiment, r.result): r.checkpoint for r in monitor.monitored_results(spark, out).collect()}
    assert found["slow", "unknown"] == 1 and ("slow", "continue") in found
    assert ("later", "continue") in found
    assert {r.experiment for r in monitor.decisions(spark, out).collect()} >= {"slow"}


def test_batch_sums_merge_to_the_whole():
    rng = np.random.default_rng(3)
    parts = [1e9 + rng.normal(size=n) for n in (1, 7, 300, 2)]
    total = (0, 0.0, 0.0)
    for x in parts:
        total = monitor.merged(total, (len(x), x.mean(), ((x - x.mean()) ** 2).sum()))
    whole = np.concatenate(parts)
    assert total[0] == len(whole) and abs(total[1] - whole.mean()) < 1e-6
    assert abs(total[2] / ((whole - whole.mean()) ** 2).sum() - 1) < 1e-6
    assert monitor.merged((0, 0.0, 0.0), (0, 0.0, 0.0)) == (0, 0.0, 0.0)


def test_open_slots_complete_the_stream(spark, tmp_path):
    from tidemark.plans.views import view
    rows = view(spark, "/root/testdata/sf0.001", "requests")
    path = str(tmp_path / "table")
    pageviews.publish_open_slots(rows.where("day <= 5"), path, "1 day")
    first = spark.read.parquet(path).count()
    pageviews.publish_open_slots(rows, path, "1 day")
    everything = str(tmp_path / "all")
    pageviews.publish_open_slots(rows, everything, "1 day")
    both = [sorted(tuple(r) for r in spark.read.parquet(p).select(
        "project", "page_title", "country", "day", "n").collect()) for p in (path, everything)]
    assert 0 < first < len(both[0]) and both[0] == both[1]


def test_a_closed_slot_is_not_cut_into_a_file_of_each_state_partition(spark, tmp_path):
    log, table, state = (str(tmp_path / n) for n in ("log", "table", "state"))
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(hours=h, minutes=i), "en.wikipedia.org", f"/wiki/P{i}", "Mozilla", "US", True)
            for h in range(8) for i in range(40)]
    spark.createDataFrame(rows, REQUEST).write.parquet(log)
    settings = []
    stream = spark.readStream.schema(spark.read.parquet(log).schema).parquet(log)
    pageviews.publish_stream(
        pageviews.stream_pageviews(stream, "1 hour", "1 hour"), table, state,
        after=lambda batch, number: settings.append(batch.sparkSession.conf.get("spark.sql.adaptive.enabled")),
    ).awaitTermination()
    published = spark.read.parquet(table)
    files = published.select("hour", F.input_file_name().alias("file")).distinct().groupBy("hour").count()
    assert {r.hour: r["count"] for r in files.collect()} == {h: 1 for h in range(6)}
    assert published.count() == 6 * 40
    assert len(settings) > 1 and set(settings) == {"false"}  # the stream itself stays as it was
