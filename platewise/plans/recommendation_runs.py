"""Recommendation runs and the gold seed in the store; each SQL twin is a text of its own."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.catalog import query
from platewise.functions.dialect import DUCK
from platewise.operators import encoders, recommend
from platewise.plans.base import statement
from platewise.plans.menu import REQUEST, TOP, dishes, ranked
from platewise.session import table, work_path
from platewise.sources import recommendation_store as store


@query("recommendation_runs", statement(DUCK, lambda d: f"""{ranked(d)}, {TOP}, n as (select count(*) as n from blend)
select run, 'tfidf' as engine_used, n as n_candidates, rank, id as local_id, score from (select *, cast(rnk as int) as rank from top) t cross join n cross join (values ('run-1', 3), ('run-2', 5)) r(run, k) where rank <= k"""))  # fmt: skip
def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs with three and five rows, stored and read back."""
    items, path = dishes(spark, sf_dir), work_path(spark, "runs")
    candidates = recommend.allowed(items, REQUEST).count()
    for run, k in (("run-1", 3), ("run-2", 5)):
        request = replace(REQUEST, top_k=k)
        store.append_run(encoders.recommend_all(items, request), request, candidates, path, run)
    back = spark.read.parquet(path)
    rows = back.select(F.col("recommendation_id").alias("run"), "engine_used", "n_candidates", F.explode(F.from_json("recommendation_rows", "array<struct<rank: int, local_id: long, score: double>>")).alias("r"))
    return rows.select("run", "engine_used", "n_candidates", "r.*")


@query("seed_gold", statement(DUCK, lambda d: "select p_brand as menu_id, count(*) as n_items, count(*) as n_embeddings from (select p_brand from items) i group by p_brand"))
def _seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dishes of each brand seeded as a session: an incomplete seed is replaced by the whole one, and a third call changes nothing."""
    items, path = dishes(spark, sf_dir).withColumnRenamed("p_brand", "menu_id"), work_path(spark, "store")
    total = table(spark, sf_dir, "part").count()
    for rows in (items.where("local_id < 50"), items, items.where("local_id < 9")):
        store.seed_gold(rows, path, least=total)
    sessions, embeddings = (spark.read.parquet(f"{path}/{n}") for n in ("sessions", "embeddings"))
    counted = embeddings.groupBy("session_id").agg(F.count("*").alias("n_embeddings"))
    return sessions.join(counted, "session_id").select("menu_id", "n_items", "n_embeddings")
