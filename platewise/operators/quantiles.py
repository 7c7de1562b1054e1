"""Exact quantiles of groups of any size, by distributed selection.

``percentile`` keeps every distinct value of a group in one buffer. Here only groups of at most ``most`` rows do; for a larger one the
wanted ranks are selected: mergeable sketches propose two values around each rank, an exact count tells on which side
of them, on them or between them the rank lies, and the rows between them are all that the next round reads. Each round keeps about
a sixtieth of the rows at most, so a trillion rows take five. A sketch that is wrong costs a round, never a wrong result. Aggregations are partial
before they are shuffled, so a hot group stays spread over all tasks.

Quantiles interpolate linearly between the two nearest ranks. Nulls are left out, NaN counts as larger than all numbers; a group without values gives no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.session import Scratch

GRID = 256  # steps of the sketch's proposals
ACCURACY = 10_000
ROUNDS = 40


def _between(value: str) -> Column:
    """Whether a value lies inside the open interval (lo, hi); a null end is none."""
    v = F.col(value)
    return (F.col("lo").isNull() | (v > F.col("lo"))) & (F.col("hi").isNull() | (v < F.col("hi")))


def _selected(values: DataFrame, sizes: DataFrame, probs: Sequence[float], most: int, scratch: Scratch) -> DataFrame:
    """(qn_key, qn_rank, qn_value) for the ranks around each quantile. values: qn_key, qn_value; sizes: qn_key, n."""
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(F.lit(p) * (F.col("n") - 1)), F.ceil(F.lit(p) * (F.col("n") - 1))) for p in probs])))
    none = F.lit(None).cast("double")
    open_ = scratch.table(sizes.select("qn_key", F.explode(ranks).alias("qn_rank"), F.lit(0).cast("long").alias("below"), F.col("n").alias("m"), none.alias("lo"), none.alias("hi")), "open0")
    found: list[DataFrame] = []
    group = ["qn_key"]
    rows = values.join(sizes.select("qn_key"), "qn_key")
    for k in range(ROUNDS):
        few = scratch.table(open_.where(F.col("m") <= most), f"few{k}")
        many = scratch.table(open_.where(F.col("m") > most), f"many{k}")
        if few.head(1):
            inside = (rows.join(few, group).where(_between("qn_value")) if k == 0 else rows.join(few, group)).select("qn_key", "qn_rank", "below", "qn_value")
            # an interval holds at most ``most`` rows, so its sorted array does
            own = inside.groupBy("qn_key", "qn_rank", "below").agg(F.array_sort(F.collect_list("qn_value")).alias("vs"))
            found.append(own.select("qn_key", "qn_rank", F.element_at("vs", (F.col("qn_rank") - F.col("below") + 1).cast("int")).alias("qn_value")))
        if not many.head(1):
            break
        grid = F.percentile_approx("qn_value", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]), F.lit(ACCURACY))
        sketched = rows.groupBy(*group).agg(grid.alias("grid"))
        step = F.floor((F.col("qn_rank") - F.col("below")) * F.lit(float(GRID)) / F.col("m"))
        at = lambda i: F.element_at("grid", (F.least(F.greatest(i, F.lit(0)), F.lit(GRID)) + 1).cast("int"))
        aimed = scratch.table(many.join(sketched, group).select("qn_key", "qn_rank", "below", "lo", "hi", at(step - 1).alias("low"), at(step + 2).alias("high")), f"aimed{k}")
        v, low, high = F.col("qn_value"), F.col("low"), F.col("high")
        part = lambda cond: F.count(F.when(cond, 1))
        counted = (
            rows.join(aimed, group)
            .groupBy("qn_key", "qn_rank", "below", "lo", "hi", "low", "high")
            .agg(part(v < low).alias("c0"), part(v == low).alias("c1"), part((v > low) & (v < high)).alias("c2"), part((v == high) & (high > low)).alias("c3"), part(v > high).alias("c4"))
        )
        counted = scratch.table(counted, f"counted{k}")
        r, edge, settled = F.col("qn_rank") - F.col("below"), F.lit(0), []
        for i in range(5):
            settled.append((r >= edge) & (r < edge + F.col(f"c{i}")))
            edge = edge + F.col(f"c{i}")
        found.append(counted.where(settled[1] | settled[3]).select("qn_key", "qn_rank", F.when(settled[1], low).otherwise(high).alias("qn_value")))
        inner = counted.where(settled[0] | settled[2] | settled[4])
        below = F.col("below") + F.when(settled[0], 0).when(settled[2], F.col("c0") + F.col("c1")).otherwise(F.col("c0") + F.col("c1") + F.col("c2") + F.col("c3"))
        new_lo = F.when(settled[0], F.col("lo")).when(settled[2], low).otherwise(high)
        new_hi = F.when(settled[0], low).when(settled[2], high).otherwise(F.col("hi"))
        open_ = scratch.table(
            inner.select("qn_key", "qn_rank", below.alias("below"), F.when(settled[0], F.col("c0")).when(settled[2], F.col("c2")).otherwise(F.col("c4")).alias("m"), new_lo.alias("lo"), new_hi.alias("hi")), f"open{k + 1}"
        )
        if not open_.head(1):
            break
        ends = open_.select("qn_key", "qn_rank", "lo", "hi")
        kept = rows.join(ends, group).where(_between("qn_value")).select("qn_key", "qn_rank", "qn_value")
        rows, group = scratch.table(kept, f"rows{k + 1}"), ["qn_key", "qn_rank"]
    else:
        raise RuntimeError("quantiles: the selection does not end")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str | Column, probs: Sequence[float], most: int = 500_000) -> DataFrame:
    """The keys, ``n`` (values) and ``quantiles`` (one for each of ``probs``) of each group; no keys: one row for all."""
    key = F.struct(*(F.col(k) for k in keys)) if keys else F.struct(F.lit(0).alias("all"))
    column = F.col(value) if isinstance(value, str) else value
    values = rows.select(key.alias("qn_key"), column.cast("double").alias("qn_value")).where("qn_value is not null")
    scratch = Scratch(rows.sparkSession, "quantiles")
    sizes = scratch.table(values.groupBy("qn_key").agg(F.count("*").alias("n")), "sizes")
    large = sizes.where(F.col("n") > most)
    small = values
    many = large.count()
    if many:
        small = values.join(large.select("qn_key"), "qn_key", "left_anti")
    plain = small.groupBy("qn_key").agg(F.count("*").alias("n"), F.percentile("qn_value", F.array(*map(F.lit, probs))).alias("quantiles"))
    out = plain
    if many:
        ranked = _selected(values, large, probs, most, scratch)
        each = large.select("qn_key", "n", F.posexplode(F.array(*map(F.lit, probs))).alias("place", "p"))
        each = each.withColumn("at", F.col("p") * (F.col("n") - 1)).withColumns({"r0": F.floor("at").cast("long"), "r1": F.ceil("at").cast("long")})
        one = ranked.select("qn_key", F.col("qn_rank").alias("r0"), F.col("qn_value").alias("v0"))
        two = ranked.select("qn_key", F.col("qn_rank").alias("r1"), F.col("qn_value").alias("v1"))
        met = each.join(one, ["qn_key", "r0"]).join(two, ["qn_key", "r1"])
        between = F.when(F.col("r0") == F.col("r1"), F.col("v0")).otherwise((F.col("r1") - F.col("at")) * F.col("v0") + (F.col("at") - F.col("r0")) * F.col("v1"))
        listed = met.groupBy("qn_key", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", between.alias("q")))), lambda x: x["q"]).alias("quantiles"))
        out = plain.unionByName(listed)
    return out.select(*(F.col("qn_key")[k].alias(k) for k in keys), "n", "quantiles")
