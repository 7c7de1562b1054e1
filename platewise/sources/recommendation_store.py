"""Recommendation runs and the gold seed in the store.

A store is a folder of Parquet tables. Sessions, items and embeddings are partitioned by ``source_kind``, so a seed is replaced without touching what users stored.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.operators.encoders import Recommendation
from platewise.operators.enrich import item_text
from platewise.operators.recommend import Request
from platewise.operators.retrieval import hashed_vector
from platewise.sources.files import exists

SEED = "gold_dataset_seed"  # fixed value
RUN = "recommendation_id string, session_id string, request_payload string, engine_used string, n_candidates long"


def append_run(found: Recommendation, request: Request, candidates: int, path: str, recommendation_id: str, session_id: str | None = None) -> None:
    """Append one run: the request, the engine, the ranked rows and the combinations as JSON lists in the order of their ranks. Rows are top_k at most."""
    spark = found.rows.sparkSession
    listed = lambda rows, name: rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct("rank", *(c for c in rows.columns if c != "rank")))), {"ignoreNullFields": "false"}).alias(name))
    run = spark.createDataFrame([(recommendation_id, session_id, json.dumps(asdict(request), ensure_ascii=False), found.engine, candidates)], RUN)
    plain = found.rows.withColumn("diet_flags", F.sort_array("diet_flags"))
    one = run.crossJoin(listed(plain, "recommendation_rows")).crossJoin(listed(found.combinations, "combo_rows"))  # one row each
    one.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def _part(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    at = f"{path}/{name}"
    return spark.read.parquet(at) if exists(spark, at) else None


def seed_gold(rows: DataFrame, path: str, least: int = 1200) -> bool:
    """Store the gold dishes (menu_id, dish_name, description, section, price_value) as a session a menu, unless that was done and the store has ``least`` embeddings; True if it was written.

    An incomplete seed is replaced, other sources stay. Session ids follow from the menu ids (a null menu_id is one menu); local ids count the dishes of a menu by name. No rows: nothing is written.
    """
    spark = rows.sparkSession
    sessions, embeddings = _part(spark, path, "sessions"), _part(spark, path, "embeddings")
    seeded = 0 if sessions is None else sessions.where(F.col("source_kind") == SEED).count()
    if seeded and embeddings is not None and embeddings.limit(least).count() >= least:
        return False
    if rows.isEmpty():
        return False
    menu = F.coalesce(F.col("menu_id").cast("string"), F.lit(""))
    session_id = F.md5(F.concat(F.lit(f"{SEED}:"), menu))
    named = rows.select(session_id.alias("session_id"), "menu_id", "dish_name", "description", "section", "price_value")
    ordered = named.withColumn("place", F.expr("row_number() over (partition by session_id order by dish_name, description, section, price_value)"))
    items = ordered.withColumn("local_id", F.format_string("seed_%04d", "place")).drop("place").withColumn("source_kind", F.lit(SEED))
    text = item_text(F.col("dish_name"), F.col("description"), F.col("section"))
    tables = {
        "sessions": items.groupBy("session_id", "source_kind").agg(F.first("menu_id").alias("menu_id"), F.count("*").alias("n_items")),
        "items": items.drop("menu_id"),
        "embeddings": items.where(text != "").select("session_id", "local_id", text.alias("item_text"), hashed_vector(text).alias("embedding"), "source_kind"),
    }
    for name, table in tables.items():
        table.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("source_kind").parquet(f"{path}/{name}")
    return True
