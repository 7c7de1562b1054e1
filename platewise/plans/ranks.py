"""Queries that rank a whole table: Spark runs them by running totals over ranges, the SQL twin by a window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.catalog import QUERIES
from platewise.functions.dialect import SPARK
from platewise.operators.ranking import running_total
from platewise.plans.base import sql_query
from platewise.session import table

sql_query("wave_plan", lambda d: f"with r as (select p_partkey, row_number() over (order by p_retailprice desc, p_partkey) as rnk from part), w as (select *, {d.idiv('(rnk - 1)', '25')} + 1 as wave from r) select concat('wave_', {d.format_int('wave', 2)}) as wave_id, count(*) as size, min(rnk) as lo, max(rnk) as hi from w group by wave")
_RANK = "case when {c} is null then 0e0 else (rank() over (order by {c} nulls last) + (count(*) over (partition by {c}) - 1) / 2e0) / count({c}) over () end"
sql_query("percentile_rank_blend", lambda d: f"""
with i as (select p_partkey, p_size * floor(p_retailprice) as area, case when p_size % 10 <> 0 then p_retailprice end as bytes, case when p_size % 7 <> 0 then p_size / p_retailprice end as aspect from part)
select p_partkey, round(0.55e0 * {_RANK.format(c='area')} + 0.25e0 * {_RANK.format(c='bytes')} + 0.20e0 * {_RANK.format(c='aspect')} + 1e-10, 6) as blend from i""")
sql_query("mixed_sort_nulls", lambda d: "select o_orderkey, c_acctbal, cast(row_number() over (order by c_acctbal desc nulls last, o_orderkey) as int) as pos from orders left join (select * from customer where c_acctbal > 0) c on o_custkey = c_custkey")


def _wave_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = running_total(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), [F.col("p_retailprice").desc(), F.col("p_partkey").asc()], "rnk")
    waves = ranked.withColumn("wave", F.expr(SPARK.idiv("(rnk - 1)", "25")) + 1)
    sized = waves.groupBy("wave").agg(F.count(F.lit(1)).alias("size"), F.min("rnk").alias("lo"), F.max("rnk").alias("hi"))
    return sized.select(F.format_string("wave_%02d", "wave").alias("wave_id"), "size", "lo", "hi")


def _percentiles(rows: DataFrame, column: str) -> DataFrame:
    """(key, share): the average rank of each value as a share of the rows that have one; null has no rank."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    upto = running_total(counts, [F.col("key").asc()], "upto", "n")
    known = rows.agg(F.count(column)).first()[0]
    return upto.select("key", (F.expr("(upto - n + 1) + (n - 1) / 2e0") / F.lit(max(1, known))).alias("share"))


def _percentile_rank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images by size, bytes and shape: 0.55, 0.25 and 0.20 of their percentile ranks; an unknown measure counts 0."""
    part = table(spark, sf_dir, "part")
    size, price = F.col("p_size"), F.col("p_retailprice")
    rows = part.select("p_partkey", (size * F.floor(price)).alias("area"), F.when(size % 10 != 0, price).alias("bytes"), F.when(size % 7 != 0, size / price).alias("aspect"))
    out, blend = rows, F.lit(0.0)
    for column, share in (("area", 0.55), ("bytes", 0.25), ("aspect", 0.20)):
        ranks = _percentiles(rows, column).toDF(f"{column}_key", f"{column}_share")
        out = out.join(ranks, F.col(column) == F.col(f"{column}_key"), "left")
        blend = blend + share * F.coalesce(f"{column}_share", F.lit(0.0))
    return out.select("p_partkey", F.round(blend + 1e-10, 6).alias("blend"))


def _mixed_sort_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    paying = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_acctbal")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = orders.join(paying, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_acctbal")
    ranked = running_total(joined, [F.col("c_acctbal").desc_nulls_last(), F.col("o_orderkey").asc()], "pos")
    return ranked.select("o_orderkey", "c_acctbal", F.col("pos").cast("int").alias("pos"))


QUERIES.update({"wave_plan": _wave_plan, "percentile_rank_blend": _percentile_rank_blend, "mixed_sort_nulls": _mixed_sort_nulls})
