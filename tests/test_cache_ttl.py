"""Cache expiry by stream, held against a batch computation."""

from __future__ import annotations

from collections import defaultdict
from datetime import datetime, timedelta

from platewise.streaming import monitor


def test_all_stored_keys_come_out(spark, tmp_path):
    start = datetime(2024, 1, 1, 23)
    stores = [(0, "a"), (100, "a"), (1700, "b"), (1900, "a"), (3599, "c")]
    rows = [(start + timedelta(seconds=s), f'{{"k": "{k}"}}') for s, k in stores]
    spark.createDataFrame(rows, "ts timestamp, props string").write.parquet(f"file://{tmp_path}/events")
    want = defaultdict(list)
    for (ts, _), (s, k) in zip(rows, stores, strict=True):
        want[s // 1800, k].append(ts)
    got = monitor.cache_ttl_stream(spark, f"file://{tmp_path}/events", 1800).collect()
    assert sorted((r.key, r.sets, r.expires_at) for r in got) == sorted((k, len(v), max(v) + timedelta(seconds=1800)) for (_, k), v in want.items())
