"""What the two engines must read alike."""

from __future__ import annotations

import duckdb

from platewise.functions.dialect import DUCK, SPARK


def test_seconds_with_a_fraction_round_alike(spark):
    times = ["2024-01-01 00:00:00.4", "2024-01-01 00:00:00.5", "2024-01-01 00:00:01.5", "2024-01-01 00:30:00.926187", "1969-12-31 23:59:58.5", "1969-12-31 23:59:58.2"]
    values = ", ".join(f"(timestamp '{t}')" for t in times)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    got = [r[0] for r in spark.sql(f"select {SPARK.epoch('ts')} from values {values} as t(ts)").collect()]
    want = [r[0] for r in duckdb.connect().execute(f"select {DUCK.epoch('ts')} from (values {values}) t(ts)").fetchall()]
    assert sorted(got) == sorted(want)
