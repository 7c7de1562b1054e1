"""wave_plan beyond 99 waves, where its SQL twin cuts the number."""

from __future__ import annotations

from platewise.plans import load, ranks


def test_wave_numbers_of_three_digits_are_whole(spark, tmp_path):
    load()
    spark.range(1, 2502).selectExpr("id as p_partkey", "cast(id as double) as p_retailprice").write.parquet(f"file://{tmp_path}/part.parquet")
    got = [(r.wave_id, r.lo) for r in ranks._wave_plan(spark, f"file://{tmp_path}").collect()]
    assert sorted(got, key=lambda r: r[1]) == [(f"wave_{i + 1:02d}", 25 * i + 1) for i in range(101)]
