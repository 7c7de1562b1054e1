"""Counters of a stream in a versioned table: batches add up, and a replayed batch changes nothing."""

from __future__ import annotations

import datetime

from platewise.session import work_path
from platewise.streaming import monitor
from platewise.streaming.versions import VersionedTable, run_merged

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark, first, n):
    at = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, at + datetime.timedelta(seconds=i * 700), i % 3, "view" if i % 4 else "click", float(i % 11), f'{{"k": {i % 2}}}') for i in range(first, first + n)], EVENT)


def report(table):
    return sorted(tuple(r) for r in monitor.request_report(table.latest()).collect())


def test_batches_add_up_and_a_replay_changes_nothing(spark):
    table = VersionedTable(spark, work_path(spark, "t"))
    add = lambda v, rows: table.add(monitor.request_counts(rows), v, monitor.merged_counts)
    parts = [events(spark, i * 40, 40) for i in range(4)]
    for v, rows in enumerate(parts):
        add(v, rows)
    whole = sorted(tuple(r) for r in monitor.request_report(monitor.request_counts(events(spark, 0, 160))).collect())
    assert report(table) == whole and table.versions() == [2, 3]
    add(3, parts[3])
    assert report(table) == whole


def test_a_stream_that_goes_on_reads_new_files_only(spark):
    source, checkpoint = work_path(spark, "in"), work_path(spark, "cp")
    table = VersionedTable(spark, work_path(spark, "t"))
    for first in (0, 50, 100):
        events(spark, first, 50).write.mode("append").parquet(source)
        run_merged(spark.readStream.schema(EVENT).parquet(source), table, monitor.request_counts, monitor.merged_counts, checkpoint)
    assert report(table) == sorted(tuple(r) for r in monitor.request_report(monitor.request_counts(events(spark, 0, 150))).collect())


def test_no_events(spark):
    source = work_path(spark, "in")
    events(spark, 0, 3).limit(0).write.parquet(source)
    assert monitor.request_stats_stream(spark, source).count() == 0 and monitor.cache_ttl_stream(spark, source, 60).count() == 0
