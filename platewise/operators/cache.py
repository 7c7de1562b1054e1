"""Cache keys and outcomes, and name-based ids, over tables of requests."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed value: the name space of URLs for name-based ids.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


@F.pandas_udf(StringType())
def _sorted_json(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else json.dumps(json.loads(v), ensure_ascii=False, sort_keys=True, separators=(",", ":")))


def canonical_json(value: Column) -> Column:
    """JSON text of any shape with the keys of every object in order and no blanks; null stays null, bad JSON raises."""
    return _sorted_json(value)


def cache_key(space: str, category: str, payload: Column, context: Column | None = None) -> Column:
    """``space:category:sha256`` of the canonical payload, or of payload and context under their names."""
    body = canonical_json(payload)
    if context is not None:
        body = F.concat(F.lit('{"key_context":'), canonical_json(context), F.lit(',"payload":'), body, F.lit("}"))
    return F.concat_ws(":", F.lit(space), F.lit(category), F.sha2(body, 256))


def cache_outcomes(operations: DataFrame, ttl_seconds: int) -> DataFrame:
    """(seq, key, at, hit): what each get finds; operations: seq, key, at timestamp, kind ('get' or 'set'), enabled boolean.

    A get hits if the last enabled set of its key before it (by at, then seq) is younger than the TTL; at the end of the TTL it misses.
    A TTL of 0 or less stores nothing. Time is cut into spans of one TTL: a set is seen by its own span and the next, so a key that
    holds much of the table is spread over its spans and no task reads all of it.
    """
    ttl = F.lit(int(ttl_seconds) * 1_000_000)
    rows = operations.select("seq", "key", "at", "kind", F.coalesce("enabled", F.lit(True)).alias("enabled"), F.unix_micros(F.col("at").cast("timestamp")).alias("us"))
    if ttl_seconds <= 0:
        return rows.where("kind = 'get'").select("seq", "key", "at", F.lit(False).alias("hit"))
    span = F.floor(F.col("us") / ttl)
    seen = F.when(F.col("kind") == "set", F.array(span, span + 1)).otherwise(F.array(span))
    spread = rows.where("kind = 'get' or (kind = 'set' and enabled)").withColumn("span", F.explode(seen))
    before = Window.partitionBy("key", "span").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") == "set", F.col("us")), ignorenulls=True).over(before)
    return spread.withColumn("stored", last).where("kind = 'get'").select("seq", "key", "at", F.coalesce(F.col("us") < F.col("stored") + ttl, F.lit(False)).alias("hit"))


def name_uuid(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """The version-5 id of a name: the same name has the same id everywhere."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.split(F.lit("8 9 a b"), " "), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
    part = lambda start, n: F.substring(digest, start, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def difference_hash(pixels: Column, size: int = 8) -> Column:
    """Hex of the signs of the steps along each row of (size + 1) * size grey values, row by row; null for another number of values."""
    at = lambda i: F.get(pixels, i)
    steps = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: i + F.floor(i / size).cast("int"))
    bits = F.array_join(F.transform(steps, lambda i: F.when(at(i + 1) > at(i), "1").otherwise("0")), "")
    nibbles = F.transform(F.sequence(F.lit(0), F.lit(size * size // 4 - 1)), lambda i: F.lower(F.conv(F.substr(bits, i * 4 + 1, F.lit(4)), 2, 16)))
    return F.when(F.size(pixels) == size * (size + 1), F.array_join(nibbles, ""))
