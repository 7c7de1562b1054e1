"""Structured Streaming forms of the request statistics and of cache expiry, and a stage timer."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.session import work_path
from platewise.streaming.versions import VersionedTable, run_merged


def _read(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a Parquet folder, or over one file by its folder and name."""
    batch = spark.read.parquet(path)
    reader = spark.readStream.schema(batch.schema)
    parent, _, name = path.rstrip("/").rpartition("/")
    if any(f.rstrip("/").endswith("/" + name) for f in batch.inputFiles()):
        return reader.option("pathGlobFilter", name).parquet(parent)
    return reader.parquet(path)


def status() -> Column:
    """A request's status: events carry none, so slow ones count as failed."""
    return F.when(F.col("value") > 9, 500).when(F.col("value") > 8, 404).otherwise(200)


def request_counts(events: DataFrame) -> DataFrame:
    """Counters of one batch by path and status."""
    rows = events.select(F.concat(F.lit("GET /"), "event_type").alias("path"), status().alias("status"), "value", "ts", "event_id")
    last = F.max(F.struct("ts", "event_id", "value")).alias("last")
    return rows.groupBy("path", "status").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(38,6)")).cast("decimal(38,6)").alias("total"), F.max("value").alias("most"), last)


def merged_counts(counts: DataFrame) -> DataFrame:
    """Counters that add up batches."""
    return counts.groupBy("path", "status").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,6)").alias("total"), F.max("most").alias("most"), F.max("last").alias("last"))


def request_report(counts: DataFrame) -> DataFrame:
    """One row a path: n, errors, status histogram, mean, most and last duration. A path has few statuses."""
    entry = F.concat(F.col("status").cast("string"), F.lit(":"), F.col("n").cast("string"))
    histogram = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("status", entry.alias("e")))), lambda x: x["e"]), "|")
    rows = counts.groupBy("path").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("status") >= 400, F.col("n")).otherwise(0)).alias("errors"), histogram.alias("histogram"), F.sum("total").alias("total"), F.max("most").alias("most"), F.max("last").alias("last")
    )
    return rows.select("path", "n", "errors", "histogram", F.round(F.col("total").cast("double") / F.col("n"), 4).alias("mean"), "most", F.col("last.value").alias("last"))


def request_stats_stream(spark: SparkSession, path: str) -> DataFrame:
    """Running counters by path and status, as the stream leaves them when all files are read."""
    found = run_merged(_read(spark, path), VersionedTable(spark, work_path(spark, "counters")), request_counts, merged_counts)
    return request_report(request_counts(spark.read.parquet(path).limit(0)) if found is None else found)


def cache_ttl_stream(spark: SparkSession, path: str, ttl: int) -> DataFrame:
    """All stored keys by event-time windows of the TTL, as the stream leaves them when all files are read; the newest windows, which can be live, are among them."""

    def count(batch: DataFrame) -> DataFrame:
        rows = batch.select(F.get_json_object("props", "$.k").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
        window = F.floor(F.col("us") / F.lit(ttl * 1_000_000)).alias("span")
        return rows.groupBy(window, "key").agg(F.count("*").alias("sets"), F.max("us").alias("us"))

    merge = lambda rows: rows.groupBy("span", "key").agg(F.sum("sets").alias("sets"), F.max("us").alias("us"))
    found = run_merged(_read(spark, path), VersionedTable(spark, work_path(spark, "ttl")), count, merge)
    rows = count(spark.read.parquet(path).limit(0)) if found is None else found
    return rows.select("key", "sets", F.timestamp_micros(F.col("us") + F.lit(ttl * 1_000_000)).alias("expires_at"))


class StageTimer:
    """Wall-clock time of a stage."""

    def __init__(self, component: str, operation: str):
        self.stage, self.seconds = f"{component}:{operation}", 0.0

    def __enter__(self) -> StageTimer:
        self._start = time.perf_counter()
        return self

    def __exit__(self, *_) -> None:
        self.seconds = time.perf_counter() - self._start
