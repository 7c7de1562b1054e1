"""Queries that write, stream or fold lines: parsers, sinks and sources, streaming statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.catalog import query
from platewise.operators import menus, parse
from platewise.session import table, work_path
from platewise.sources import files
from platewise.streaming import monitor


def _lines(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = docs.select("doc_id", *keep, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_order", "text"))
    start = (F.col("line_order") * 37 % 500).cast("double")
    return at.select(
        F.col("doc_id").cast("string").alias("menu_id"), F.lit("p1").alias("page_id"), "line_order", "text", start.alias("bbox_x1"), (F.col("line_order") * 20.0).alias("bbox_y1"),
        (start + F.length("text")).alias("bbox_x2"), (F.col("line_order") * 20.0 + 12).alias("bbox_y2"), *keep,
    )


for _version in ("v1", "v2", "v3"):
    query(f"parse_{_version}")(lambda spark, sf_dir, v=_version: parse.parse_pages(_lines(spark, sf_dir), v))


def _roles(lines: DataFrame) -> DataFrame:
    return lines.select("menu_id", "page_id", "line_order", "text", F.when(F.length("text") < 60, "item_name").otherwise("description").alias("label"), ((F.length("text") % 100) / 100).alias("score"))


@query("parse_cascade")
def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return parse.cascade(lines, _roles(lines))


@query("parse_menu")
def _menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return menus.parse_menu(lines, "v3", _roles(lines))


@query("scan_formats_roundtrip", "select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from part")
def _formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    csv, jsonl = work_path(spark, "csv"), work_path(spark, "jsonl")
    files.write_csv(part, csv)
    files.write_jsonl(files.read_csv(spark, csv, part.schema), jsonl)
    return files.read_jsonl(spark, jsonl, part.schema)


@query("append_and_scan", "select c_custkey, c_name, 1 as run from customer union all select c_custkey, c_name, 2 as run from customer where c_acctbal > 5000")
def _append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), work_path(spark, "runs")
    for run, part in ((1, rows), (2, rows.where("c_acctbal > 5000"))):
        part.select("c_custkey", "c_name", F.lit(run).alias("run")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("snapshot_roundtrip", "select 'orders' as name, count(*) as n, cast(sum(o_orderkey) as bigint) as checksum from orders union all select 'customer', count(*), cast(sum(c_custkey) as bigint) from customer")
def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "snapshot")
    files.export_snapshot({n: table(spark, sf_dir, n) for n in ("orders", "customer")}, path)
    back = files.import_snapshot(spark, path, ("orders", "customer"))
    one = lambda n, key: back[n].agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("checksum")).select(F.lit(n).alias("name"), "n", "checksum")
    return one("orders", "o_orderkey").union(one("customer", "c_custkey"))


@query("seed_idempotent", "select p_partkey, p_name from part")
def _seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = work_path(spark, "seed"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    for _ in range(2):
        files.seed_once(rows, path, least=1)
    return spark.read.parquet(path)


@query("scan_label_text", "select p_partkey, cast(p_size as double) / 100 as xc, cast(p_size as double) / 200 as bw from part")
def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(" ", F.lit("3"), (F.col("p_size") / 100).cast("string"), F.lit("0.5"), (F.col("p_size") / 200).cast("string"), F.lit("0.25"))
    boxes = files.parse_boxes(table(spark, sf_dir, "part").select("p_partkey", line.alias("value")), "value")
    return boxes.select("p_partkey", "xc", "bw")


STATS = """
with r as (select *, 'GET /' || event_type as path, case when value > 9 then 500 when value > 8 then 404 else 200 end as status from events),
h as (select path, status, count(*) as n from r group by path, status)
select path, count(*) as n, count(*) filter (where status >= 400) as errors, (select string_agg(status || ':' || h.n, '|' order by status) from h where h.path = r.path) as histogram,
       round(cast(sum(cast(value as decimal(38, 6))) as double) / count(*), 4) as mean, max(value) as most, arg_max(value, {'ts': ts, 'event_id': event_id}) as last from r group by path
"""


@query("stream_request_stats", STATS)
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.request_stats_stream(spark, f"{sf_dir}/events.parquet")


@query("stream_cache_ttl", """
select json_extract_string(props, '$.k') as key, count(*) as sets, strftime(max(ts) + interval 1800 seconds, '%Y-%m-%d %H:%M:%S') as expires_at
from events group by json_extract_string(props, '$.k'), floor(epoch_us(ts) / 1800000000)
""")
def _ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.cache_ttl_stream(spark, f"{sf_dir}/events.parquet", 1800).withColumn("expires_at", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss"))


@query("stage_timer")
def _timer(spark: SparkSession, sf_dir: str) -> DataFrame:
    with monitor.StageTimer("catalog", "count") as timer:
        n = table(spark, sf_dir, "part").count()
    return spark.createDataFrame([(timer.stage, n, timer.seconds >= 0)], "stage string, rows long, timed boolean")
