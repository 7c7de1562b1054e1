"""Runs and seeds in the store."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from test_recommend import dish, frame

from platewise.operators import encoders
from platewise.operators.recommend import Request
from platewise.session import work_path
from platewise.sources import recommendation_store as store


def test_a_run_holds_its_request_rows_and_combinations(spark):
    items = frame(spark, dish("a", "Chicken Rice", price=5.0), dish("b", "Chicken Soup", price=6.0))
    request, path = Request(craving_text="chicken é", combo_budget=20, top_k=2), work_path(spark, "runs")
    for run in ("1", "2"):
        store.append_run(encoders.recommend_all(items, request), request, 2, path, run, "s")
    rows = {r.recommendation_id: r for r in spark.read.parquet(path).collect()}
    assert set(rows) == {"1", "2"} and rows["1"].engine_used == "tfidf" and rows["1"].session_id == "s"
    assert json.loads(rows["1"].request_payload)["craving_text"] == "chicken é"
    assert [r["rank"] for r in json.loads(rows["1"].recommendation_rows)] == [1, 2] and json.loads(rows["1"].combo_rows)[0]["item_ids"]
    store.append_run(encoders.recommend_all(items.limit(0), request), request, 0, path, "3")
    assert spark.read.parquet(path).where("recommendation_id = '3'").first().recommendation_rows == "[]"


def test_seed_is_skipped_replaced_or_written(spark):
    rows = spark.createDataFrame([("m", "Soup", None, None, 1.0), ("m", "Pie", "hot", None, None), (None, None, None, None, 2.0)], "menu_id string, dish_name string, description string, section string, price_value double")
    path = work_path(spark, "store")
    assert not store.seed_gold(rows.limit(0), path, 2)
    assert store.seed_gold(rows.where("dish_name = 'Soup'"), path, 2)
    user = spark.read.parquet(f"{path}/sessions").withColumns({"source_kind": F.lit("upload"), "session_id": F.lit("u")})
    user.write.mode("append").partitionBy("source_kind").parquet(f"{path}/sessions")
    assert store.seed_gold(rows, path, 2) and not store.seed_gold(rows, path, 2)
    assert sorted((r.menu_id or "", r.n_items, r.source_kind) for r in spark.read.parquet(f"{path}/sessions").collect()) == [("", 1, store.SEED), ("m", 1, "upload"), ("m", 2, store.SEED)]
    assert spark.read.parquet(f"{path}/embeddings").count() == 2
