"""Which columns an operator carries through, and joins on keys that may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one in so many of all rows; so there are fewer hot keys than that.
SHARE = 1000


def carried(docs: DataFrame, added: list[str] | tuple[str, ...], *left_out: str) -> list[str]:
    """The columns of ``docs`` that stay: all but ``left_out`` and those whose names the operator's own columns take."""
    gone = {c.lower() for c in (*added, *left_out)}
    return [c for c in docs.columns if c.lower() not in gone]


def schema_of(docs: DataFrame, columns: list[str]) -> list[str]:
    """``c0 type``, ``c1 type``, ... for mapInArrow; neutral names never clash."""
    return [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns)]


def join_counted(left: DataFrame, right: DataFrame, on: str, count: str, share: int = SHARE, how: str = "inner") -> DataFrame:
    """Inner or left join with a table of unique keys of bounded width that holds the number of ``left`` rows of each key.

    Fewer than ``share`` keys hold more than one in ``share`` of the rows: these are broadcast, so a hot key
    stays spread as it is. What goes through the shuffle is free of hot keys; they are left out by a filter, not by another join.
    """
    total = right.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    limit = max(1, int(total) // share)
    hot = right.where(F.col(count) > limit)
    keys = [r[0] for r in hot.select(on).collect()]  # fewer than ``share``
    if not keys:
        return left.join(right, on, how)
    spread = left.join(F.broadcast(hot), on)
    rest = left.where(~F.coalesce(F.col(on).isin(keys), F.lit(False))).join(right.where(F.col(count) <= limit), on, how)
    return spread.unionByName(rest)
