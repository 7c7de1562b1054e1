"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them), so the
flow network has one node a pattern and one a source, however many documents there are.
Token capacity runs pattern -> repetition layer -> source quota; the cost of a layer is
convex in the repetition, so no document is taken twice while a first copy is left. The flow is
exact for overlapping sources. Patterns go to the driver; documents never do.

Whole documents are then selected in seeded hash order. Within a pattern they fall into four
size classes; from the largest class to the smallest each takes its share and passes what
it missed on. Then, ``REPAIRS`` times, each pattern takes or gives back the one document that brings it
nearest to its flow, so that small sources come near their targets too. Running totals are taken within
hash buckets and lifted by bucket offsets, so a hot source is not one task.

Defined cases: a null or empty text has size 0 and is not taken; a null source is the last
source; rows that repeat a doc_id are separate documents; a table without words has targets
of 0; further columns are carried through.
"""

from __future__ import annotations

import heapq
import json
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Lower bounds of the size classes in words, largest first.
CLASSES = (4096, 512, 64, 0)
#: Documents that each pattern may exchange at the end.
REPAIRS = 4


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2, total: int | None = None) -> dict[str | None, float]:
    """Share ``share`` of the total size by weight; a target stops at ``most`` times its source's size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left = Fraction(total if total is not None else sum(sizes.values())) * share
    target: dict[str | None, Fraction] = {}
    open_ = list(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not full:
            target |= {s: unit * weight[s] for s in open_}
            break
        for s in full:
            target[s] = Fraction(most * sizes[s])
            left -= target[s]
        open_ = [s for s in open_ if s not in target]
    return {s: float(target[s]) for s in names}


def min_cost_flow(capacity: dict[str, int], members: dict[str, list], quota: dict, layers: int = 2) -> dict[tuple[str, object, int], int]:
    """Successive cheapest augmenting paths (Dijkstra with potentials).

    capacity: tokens of each pattern; members: its sources; quota: tokens wanted by each source.
    Returns the flow by (pattern, source, layer); layer r costs (r + 1) ** 2 a token.
    """
    graph: dict[object, list[list]] = {}

    def edge(a, b, cap: int, cost: int) -> None:
        forward, back = [b, cap, cost, None], [a, 0, -cost, None]
        forward[3], back[3] = back, forward
        graph.setdefault(a, []).append(forward)
        graph.setdefault(b, []).append(back)

    for p, cap in capacity.items():
        for r in range(layers):
            edge("source", ("layer", p, r), cap, (r + 1) ** 2)
            for s in members[p]:
                edge(("layer", p, r), ("quota", s), cap, 0)
    for s, want in quota.items():
        edge(("quota", s), "sink", want, 0)
    potential = dict.fromkeys(graph, 0)
    while "source" in graph and "sink" in graph:
        best, via, queue, order = {"source": 0}, {}, [(0, 0, "source")], 0
        while queue:
            d, _, at = heapq.heappop(queue)
            if d > best[at]:
                continue
            for e in graph[at]:
                reach = d + e[2] + potential[at] - potential[e[0]]
                if e[1] > 0 and reach < best.get(e[0], float("inf")):
                    best[e[0]], via[e[0]], order = reach, e, order + 1
                    heapq.heappush(queue, (reach, order, e[0]))
        if "sink" not in best:
            break
        for node in graph:
            potential[node] += best.get(node, best["sink"])
        path, at = [], "sink"
        while at != "source":
            path.append(via[at])
            at = via[at][3][0]
        amount = min(e[1] for e in path)
        for e in path:
            e[1] -= amount
            e[3][1] += amount
    out = {}
    for at, edges in graph.items():
        if isinstance(at, tuple) and at[0] == "layer":
            out |= {(at[1], e[0][1], at[2]): e[3][1] for e in edges if e[0] != "source" and e[3][1] > 0}
    return out


def _swapped(placed: DataFrame, swaps: list[tuple[str, int, int]]) -> DataFrame:
    """mx_extra turned over for the documents in ``swaps``, which pattern, class and words before name; an even number of times is none."""
    odd = sorted({s for s in swaps if swaps.count(s) % 2})
    if not odd:
        return placed
    marks = placed.sparkSession.createDataFrame(odd, "s_pattern string, s_class int, s_before long")
    same = (F.col("mx_pattern") == F.col("s_pattern")) & (F.col("mx_class") == F.col("s_class")) & (F.col("mx_before") == F.col("s_before")) & (F.col("mx_size") > 0)
    return placed.join(F.broadcast(marks), same, "left").withColumn("mx_extra", F.col("mx_extra") != F.col("s_pattern").isNotNull()).drop("s_pattern", "s_class", "s_before")


def mix_to_targets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 42) -> DataFrame:
    """(mx_id, mx_size, mx_pattern, mx_source_size, mx_target, mx_copies) for each row of ``docs``.

    ``source`` is a string column or an array of strings for documents in several sources;
    mx_source_size and mx_target are those of the first source of the pattern.
    """
    spark = docs.sparkSession
    kind = docs.schema[source].dataType.typeName()
    pattern = F.to_json(F.array_sort(F.array_distinct(F.col(source))) if kind == "array" else F.array(F.col(source).cast("string")))
    sized = docs.select(F.col(doc_id).alias("mx_id"), n_words(F.col(text)).alias("mx_size"), pattern.alias("mx_pattern"))
    order = F.xxhash64(F.lit(seed), "mx_id", "mx_size")
    cls = F.lit(len(CLASSES) - 1)
    for i in reversed(range(len(CLASSES) - 1)):
        cls = F.when(F.col("mx_size") >= CLASSES[i], F.lit(i)).otherwise(cls)
    sized = materialize(sized.withColumns({"mx_order": order, "mx_class": cls}).withColumn("mx_bucket", F.shiftrightunsigned("mx_order", 54).cast("int")), "sizes")

    totals = sized.groupBy("mx_pattern", "mx_class").agg(F.sum("mx_size").alias("n")).collect()
    capacity: dict[str, int] = {}
    by_class: dict[tuple[str, int], int] = {}
    for r in totals:
        capacity[r.mx_pattern] = capacity.get(r.mx_pattern, 0) + r.n
        by_class[r.mx_pattern, r.mx_class] = r.n
    capacity = dict(sorted(capacity.items()))
    members = {p: json.loads(p) or [None] for p in capacity}
    sizes: dict[str | None, int] = {}
    for p, cap in capacity.items():
        for s in members[p]:
            sizes[s] = sizes.get(s, 0) + cap
    target = source_targets(sizes, weights, share, most, sum(capacity.values()))
    flow = min_cost_flow(capacity, members, {s: round(t) for s, t in target.items()}, most)
    wanted = dict.fromkeys(capacity, 0)
    for (p, _, _), f in flow.items():
        wanted[p] += f

    key = ["mx_pattern", "mx_class", "mx_bucket"]
    inside = Window.partitionBy(*key).orderBy("mx_order", "mx_id", "mx_size").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.groupBy(*key).agg(F.sum("mx_size").alias("b")).withColumn(
        "mx_offset", F.coalesce(F.sum("b").over(Window.partitionBy("mx_pattern", "mx_class").orderBy("mx_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    placed = sized.withColumn("mx_before", F.coalesce(F.sum("mx_size").over(inside), F.lit(0))).join(offsets.drop("b"), key)
    placed = materialize(placed.select("mx_id", "mx_size", "mx_pattern", "mx_class", (F.col("mx_before") + F.col("mx_offset")).alias("mx_before")), "placed")

    full = {p: wanted[p] // cap if cap else 0 for p, cap in capacity.items()}
    part = {p: wanted[p] - full[p] * cap for p, cap in capacity.items()}
    carry = dict.fromkeys(capacity, Fraction(0))
    bounds: list[tuple[str, int, int, int]] = []
    for c in range(len(CLASSES)):
        now = []
        for p, cap in capacity.items():
            size = by_class.get((p, c))
            if size is not None:
                want = min(Fraction(size), max(Fraction(0), (Fraction(part[p]) * size / cap if cap else Fraction(0)) + carry[p]))
                now.append((p, c, full[p], int(want)))
                carry[p] += (Fraction(part[p]) * size / cap if cap else 0)
        if not now:
            continue
        bounds += now
        limits = spark.createDataFrame(now, "mx_pattern string, mx_class int, mx_full int, mx_want long")
        got = placed.where(F.col("mx_class") == c).join(F.broadcast(limits), ["mx_pattern", "mx_class"]).where(2 * F.col("mx_before") + F.col("mx_size") <= 2 * F.col("mx_want")).groupBy("mx_pattern").agg(F.sum("mx_size").alias("n"))
        for r in got.collect():
            carry[r.mx_pattern] -= r.n
    limits = spark.createDataFrame(bounds, "mx_pattern string, mx_class int, mx_full int, mx_want long")
    chosen = placed.join(F.broadcast(limits), ["mx_pattern", "mx_class"]).where("mx_size > 0")
    chosen = chosen.withColumn("mx_extra", 2 * F.col("mx_before") + F.col("mx_size") <= 2 * F.col("mx_want"))
    swaps: list[tuple[str, int, int]] = []
    for _ in range(REPAIRS):
        missing = [(p, float(r)) for p, r in carry.items() if r]
        if not missing:
            break
        now = _swapped(chosen, swaps).join(F.broadcast(spark.createDataFrame(missing, "mx_pattern string, mx_missing double")), "mx_pattern")
        change = F.when(F.col("mx_extra"), -F.col("mx_size")).otherwise(F.col("mx_size"))
        left = F.abs(F.col("mx_missing") - change)
        best = now.where(left < F.abs("mx_missing")).groupBy("mx_pattern").agg(F.min(F.struct(left.alias("left"), "mx_class", "mx_before", change.alias("change"))).alias("b")).select("mx_pattern", "b.*").collect()
        for r in best:
            carry[r.mx_pattern] -= r.change
            swaps.append((r.mx_pattern, r.mx_class, r.mx_before))
        if not best:
            break
    rows = [(p, c, f, w, sizes[members[p][0]], target[members[p][0]]) for p, c, f, w in bounds]
    limits = spark.createDataFrame(rows, "mx_pattern string, mx_class int, mx_full int, mx_want long, mx_source_size long, mx_target double")
    taken = (F.col("mx_size") > 0) & F.col("mx_extra")
    placed = placed.join(F.broadcast(limits), ["mx_pattern", "mx_class"])
    return _swapped(placed.withColumn("mx_extra", 2 * F.col("mx_before") + F.col("mx_size") <= 2 * F.col("mx_want")), swaps).select(
        "mx_id", "mx_size", "mx_pattern", "mx_source_size", "mx_target", F.when(F.col("mx_size") > 0, F.col("mx_full") + taken.cast("int")).otherwise(0).cast("int").alias("mx_copies")
    )
