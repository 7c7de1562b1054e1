"""Profiles by exact quantiles: box sizes, latencies of two runs, quartile and fixed-edge buckets; each SQL twin is a text of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.catalog import query
from platewise.operators.quantiles import exact_quantiles
from platewise.session import table


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as fractions of their images, over lineitem and part."""
    images = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 20).alias("img_w"), F.floor("p_retailprice").alias("img_h"))
    boxes = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", F.col("l_discount").alias("bw"), F.col("l_tax").alias("bh"))
    return boxes.join(images, F.col("l_partkey") == F.col("p_partkey"), "left")


@query("box_profile", """
with b as (
  select l_returnflag, l_discount * l_tax as area, l_discount * p_size * 20 as w, l_tax * floor(p_retailprice) as h from lineitem left join part on l_partkey = p_partkey
)
select l_returnflag as class_name, count(*) as n, round(avg(area), 6) as mean_area, round(quantile_cont(area, 0.5), 6) as median_area, round(quantile_cont(area, 0.95), 6) as p95_area,
       round(avg(w), 4) as mean_w_px, round(avg(h), 4) as mean_h_px from b group by l_returnflag
""")  # fmt: skip
def _box_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir).withColumnRenamed("l_returnflag", "class_name").withColumn("area", F.col("bw") * F.col("bh"))
    means = boxes.groupBy("class_name").agg(
        F.count("*").alias("n"), F.round(F.avg("area"), 6).alias("mean_area"), F.round(F.avg(F.col("bw") * F.col("img_w")), 4).alias("mean_w_px"), F.round(F.avg(F.col("bh") * F.col("img_h")), 4).alias("mean_h_px")
    )
    q = exact_quantiles(boxes, ["class_name"], "area", (0.5, 0.95)).select("class_name", *(F.round(F.col("quantiles")[i], 6).alias(c) for i, c in enumerate(("median_area", "p95_area"))))
    return means.join(q, "class_name").select("class_name", "n", "mean_area", "median_area", "p95_area", "mean_w_px", "mean_h_px")


RUNS = ("base", "hit")
FIGURES = ("mean", "p50", "p95")


def hundredths(x: Column) -> Column:
    """Two decimals; what is a tie in decimals goes up, whatever its last bit is."""
    return F.round(x + 1e-9, 2)


def speedup(base: Column, hit: Column) -> Column:
    """How many times the first run took; 0 where the second took nothing."""
    return F.when(hit <= 0, F.lit(0.0)).otherwise(hundredths(base / hit))


@query("latency_speedup", """
with s as (
  select event_type, user_id % 2 as run, round(avg(value) + 1e-9, 2) as mean, round(quantile_cont(value, 0.5) + 1e-9, 2) as p50, round(quantile_cont(value, 0.95) + 1e-9, 2) as p95 from events group by event_type, user_id % 2
), b as (
  select event_type, coalesce(max(mean) filter (where run = 0), 0) as base_mean, coalesce(max(p50) filter (where run = 0), 0) as base_p50, coalesce(max(p95) filter (where run = 0), 0) as base_p95,
         coalesce(max(mean) filter (where run = 1), 0) as hit_mean, coalesce(max(p50) filter (where run = 1), 0) as hit_p50, coalesce(max(p95) filter (where run = 1), 0) as hit_p95 from s group by event_type
)
select *, case when hit_mean > 0 then round(base_mean / hit_mean + 1e-9, 2) else 0 end as mean_x, case when hit_p50 > 0 then round(base_p50 / hit_p50 + 1e-9, 2) else 0 end as p50_x,
       case when hit_p95 > 0 then round(base_p95 / hit_p95 + 1e-9, 2) else 0 end as p95_x from b
""")
def _latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs (users with even and with odd numbers) side by side, and their ratios."""
    events = table(spark, sf_dir, "events").select("event_type", "value", (F.col("user_id") % 2).alias("run"))
    means = events.groupBy("event_type", "run").agg(hundredths(F.avg("value")).alias("mean"))
    q = exact_quantiles(events, ["event_type", "run"], "value", (0.5, 0.95)).select("event_type", "run", hundredths(F.col("quantiles")[0]).alias("p50"), hundredths(F.col("quantiles")[1]).alias("p95"))
    both = means.join(q, ["event_type", "run"]).groupBy("event_type")
    wide = both.agg(*(F.coalesce(F.max(F.when(F.col("run") == i, F.col(f))), F.lit(0.0)).alias(f"{run}_{f}") for i, run in enumerate(RUNS) for f in FIGURES))
    return wide.withColumns({f"{f}_x": speedup(F.col(f"base_{f}"), F.col(f"hit_{f}")) for f in FIGURES})


# Right-closed edges of the shapes, the lowest included, and the names of quartiles.
EDGES = ((0.6, "very_tall"), (0.75, "tall"), (0.95, "balanced"), (1.2, "wide"), (10.0, "very_wide"))
QUARTILES = ("small", "medium", "large", "xlarge")


def edge_bucket(x: Column) -> Column:
    """The label of the first edge that x doesn't exceed; null below 0 and above the last."""
    out = F.lit(None).cast("string")
    for edge, label in reversed(EDGES):
        out = F.when((x >= 0) & (x <= edge), F.lit(label)).otherwise(out)
    return out


def quartile_bucket(x: Column, quartiles: Column) -> Column:
    out = F.when(x > quartiles[2], F.lit(QUARTILES[3]))
    for i in (2, 1, 0):
        out = F.when(x <= quartiles[i], F.lit(QUARTILES[i])).otherwise(out)
    return out


@query("bucket_summary", """
with q as (select quantile_cont(n_chars, 0.25) as q1, quantile_cont(n_chars, 0.5) as q2, quantile_cont(n_chars, 0.75) as q3 from documents)
select case when a <= 0.6 then 'very_tall' when a <= 0.75 then 'tall' when a <= 0.95 then 'balanced' when a <= 1.2 then 'wide' when a <= 10 then 'very_wide' end as aspect_bucket,
       case when n_chars <= q1 then 'small' when n_chars <= q2 then 'medium' when n_chars <= q3 then 'large' when n_chars > q3 then 'xlarge' end as area_bucket, lang, count(*) as n
from (select n_chars, lang, case when n_chars % 100 < 90 then (n_chars % 100) / 60.0 else 11.0 end as a from documents) d cross join q group by all
""")
def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by shape, size and language, the largest group first; the quartiles are one row."""
    rest = F.col("n_chars") % 100
    docs = table(spark, sf_dir, "documents").select("n_chars", "lang", F.when(rest < 90, rest / 60.0).otherwise(11.0).alias("aspect"))
    quartiles = exact_quantiles(docs, [], "n_chars", (0.25, 0.5, 0.75)).select("quantiles")
    placed = docs.crossJoin(F.broadcast(quartiles))
    out = placed.groupBy(edge_bucket(F.col("aspect")).alias("aspect_bucket"), quartile_bucket(F.col("n_chars"), F.col("quantiles")).alias("area_bucket"), "lang").agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "aspect_bucket", "area_bucket", "lang")
