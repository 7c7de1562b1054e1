"""Bounded, seeded samples of labelled rows: what the trained operators learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seeded_order(doc_id: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), doc_id.cast("string"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, seed: int = 7, only: Column | None = None) -> DataFrame:
    """At most ``most`` labelled documents in seeded hash order, with the column sm_label (0 or 1).

    A doc_id that is labelled more than once counts with its largest label; null labels are
    left out. The sample of ids is bounded, so it is broadcast; texts are not shuffled.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if only is not None:
        marks = marks.where(only)
    marks = marks.groupBy("doc_id").agg(F.max(label).cast("int").alias("sm_label")).orderBy(seeded_order(F.col("doc_id"), seed), "doc_id").limit(most)
    return docs.join(F.broadcast(marks.withColumnRenamed("doc_id", "sm_id")), F.col("doc_id") == F.col("sm_id")).drop("sm_id")


def unlabelled_sample(docs: DataFrame, labels: DataFrame, most: int, seed: int = 11) -> DataFrame:
    """At most ``most`` documents, in seeded hash order, that have no label."""
    known = labels.select(F.col("doc_id").alias("sm_id")).distinct()
    ids = docs.select("doc_id").join(known, F.col("doc_id") == F.col("sm_id"), "left_anti").orderBy(seeded_order(F.col("doc_id"), seed), "doc_id").limit(most)
    return docs.join(F.broadcast(ids.select(F.col("doc_id").alias("sm_id")).distinct()), F.col("doc_id") == F.col("sm_id")).drop("sm_id")
