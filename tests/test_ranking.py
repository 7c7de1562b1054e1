"""Ranks over whole tables, held against SQL windows and plain sums."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from platewise.operators.ranking import running_total

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["wave_plan", "percentile_rank_blend", "mixed_sort_nulls", "round_robin_select"])
def test_ranks_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "orders", "customer"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = __spark_entry__.queries()[name](spark, SF).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_running_total_odd_rows(spark):
    rows = [(1, 5), (2, None), (3, 2), (4, 0), (5, 7)]
    df = spark.createDataFrame(rows, "k int, w int")
    got = {r.k: r.t for r in running_total(df, [F.col("k").desc()], "t", "w").collect()}
    assert got == {5: 7, 4: 7, 3: 9, 2: 9, 1: 14}
    assert running_total(df.limit(0), [F.col("k").asc()], "t").count() == 0
