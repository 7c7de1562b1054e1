"""Running totals over a whole table without a window that brings all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.session import materialize


def running_total(df: DataFrame, order: list[Column], name: str, weight: str | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``weight`` (None: the number of rows) over all rows up to this one in ``order``.

    Rows are dealt to ranges of the order, totalled within each range, and the totals of the ranges
    before are added; only those, one row a shuffle partition, meet in one task. ``order`` must tell all
    rows apart. A null weight counts as 0; an empty table stays empty.
    """
    number = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = materialize(df.repartitionByRange(number, *order).withColumn("rt_part", F.spark_partition_id()), "ranges")
    add = F.lit(1).cast("long") if weight is None else F.coalesce(F.col(weight).cast("long"), F.lit(0).cast("long"))
    own = Window.partitionBy("rt_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy("rt_at").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy(F.col("rt_part").alias("rt_at")).agg(F.sum(add).alias("rt_sum"))
    before = totals.select("rt_at", F.coalesce(F.sum("rt_sum").over(earlier), F.lit(0)).alias("rt_before"))
    within = ranges.withColumn(name, F.sum(add).over(own))
    joined = within.join(F.broadcast(before), F.col("rt_part") == F.col("rt_at"))  # at most one row a shuffle partition
    return joined.withColumn(name, F.col(name) + F.col("rt_before")).drop("rt_part", "rt_at", "rt_before")
