"""Hard-negative mining: anchors in clusters share candidate lists, which are walked until a bound certifies the rest away.

Vectors are integers (each component x becomes floor(scale * x)), a row's score is its inner product with the anchor;
higher scores come first, ties by smaller id. An anchor's positives are its first rows of the same label. For
each positive, the first rows of other labels whose score lies in a window below the positive's are its hard negatives.

* **Clusters.** Centroids come from a bounded sample of anchors (``SAMPLE``, spherical k-means); every anchor belongs to the nearest one.
  Neighbouring clusters are packed into blocks of at most ``BLOCK`` anchors; a larger cluster takes several blocks.
* **Shards.** Rows are dealt to shards of about ``16 * sqrt(rows)``, so that what shards return to be merged grows with
  the rows to the power of 1.5, not 2. Each pair of a block and a shard is one bounded group; rows travel once a block, anchors once a shard.
* **Shared lists.** In a group, for each cluster, candidates are sorted once by |x| * cos(max(0, angle to the centroid - radius of the cluster)),
  which no member's score divided by the member's length exceeds. All members walk that list together, some hundreds of rows at a time;
  a member leaves when nothing that follows can enter its result: its k-th best score is above the bound (strictly, so ties by id
  are met), or the bound is below its windows. The bound is rounded up, scores are whole numbers and exact.

The first walk finds positives (members of one label walk that label's part of the list), the second negatives, now that the windows are known.
Anchors are a stated query set; all rows are candidates.

Defined cases: rows with a null label, a null vector or any null or non-finite component take no part; repeated rows are rows of
their own (an anchor's copy is one of its other rows); rows without an id are no anchors, and come last in ties; vectors of different lengths
are compared over the shorter length; an empty table, or one without anchors, gives an empty result; positives below 0 have no window; columns
of the input that aren't named are not read. Scores are exact up to 2**53.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from platewise.session import Scratch

SAMPLE = 4096  # anchors from which centroids are learned
MEMBERS = 64  # anchors a cluster, on average
CLUSTERS = 256  # at most
BLOCK = 8192  # anchors a block, at most
SHARD = 65536  # rows a shard, about, at most
STRIDE = 512  # rows of a list walked at once
_LAST = np.iinfo(np.int64).max


def quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def prepared(rows: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """hn_row (a number of its own for each row), hn_id, hn_label, hn_vector of the rows that take part."""
    usable = F.col(label).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    picked = rows.where(usable).select(F.col(vec_id).cast("long").alias("hn_id"), F.col(label).cast("long").alias("hn_label"), quantised(F.col(vector), scale).alias("hn_vector"))
    return picked.withColumn("hn_row", F.monotonically_increasing_id())


# --- vectors of a batch
def matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix of whole numbers; shorter lists end in zeros, which add nothing to a product."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max()) if len(sizes) else 0
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


def exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """Doubles where all products and sums are exact in them, else 64-bit integers."""
    high = max(float(np.abs(a).max(initial=0)), 1.0) * max(float(np.abs(b).max(initial=0)), 1.0) * max(a.shape[1], 1)
    return np.float64 if high < 2**53 else np.int64


def unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def learned_centroids(m: np.ndarray, many: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Spherical k-means."""
    x = unit(m)
    centre = x[np.random.default_rng(seed).choice(len(x), min(many, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        filled = np.linalg.norm(total, axis=1) > 0
        centre[filled] = unit(total[filled])
    return centre


# --- the walk
def shared_list(members: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The candidates' order by falling upper bound, and the bounds, for members of length one."""
    own = unit(members)
    centre = unit(own.sum(axis=0, keepdims=True))[0]
    radius = np.arccos(np.clip(own @ centre, -1, 1)).max()
    length = np.linalg.norm(candidates.astype(np.float64), axis=1)
    angle = np.arccos(np.clip(unit(candidates) @ centre, -1, 1))
    bound = length * np.cos(np.maximum(0, angle - radius - 1e-7))  # arccos is good to about 1e-8 near 0
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


def kept_best(group: np.ndarray, score: np.ndarray, tie: np.ndarray, most: int) -> np.ndarray:
    """Positions of the first ``most`` of each group, by falling score, then by tie."""
    order = np.lexsort((tie, -score, group))
    g = group[order]
    begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(begin, np.diff(np.append(begin, len(g))))
    return order[rank < most]


def walk(members: np.ndarray, candidates: np.ndarray, ties: np.ndarray, order: np.ndarray, bound: np.ndarray, low: np.ndarray, high: np.ndarray, most: int, skip) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, window, candidate, score) of the first ``most`` candidates in each of the members' windows.

    ``low`` and ``high`` are members x windows, both ends inside; an empty window has low above high.
    ``skip(members, candidates)`` marks the pairs that are none.
    """
    windows = low.shape[1]
    need = low.astype(np.float64)  # what a score must reach to matter; grows as results fill
    need[low > high] = np.inf
    length = np.linalg.norm(members.astype(np.float64), axis=1)
    exact = exact_type(members, candidates)
    members, candidates = members.astype(exact), candidates.astype(exact)
    group, found, score = (np.zeros(0, np.int64) for _ in range(3))
    for at in range(0, len(order), STRIDE):
        reach = length * bound[at]
        reach = reach + np.abs(reach) * 1e-9 + 0.5
        active = np.flatnonzero(reach >= need.min(axis=1))
        if not len(active):
            break
        here = order[at : at + STRIDE]
        product = members[active] @ candidates[here].T
        open_ = (product >= need[active].min(axis=1)[:, None]) & (product <= high[active].max(axis=1)[:, None]) & ~skip(active, here)
        i, j = np.nonzero(open_)
        value = product[i, j].astype(np.int64)
        i, j = active[i], here[j]
        fits = (value[:, None] >= need[i]) & (value[:, None] <= high[i])
        pair, window = np.nonzero(fits)
        if not len(pair):
            continue
        group = np.concatenate([group, i[pair] * windows + window])
        found, score = np.concatenate([found, j[pair]]), np.concatenate([score, value[pair]])
        keep = kept_best(group, score, ties[found], most)
        group, found, score = group[keep], found[keep], score[keep]
        full, count = np.unique(group, return_counts=True)
        last = np.cumsum(count) - 1
        done = count == most
        need.ravel()[full[done]] = np.maximum(need.ravel()[full[done]], score[last[done]])
    return group, found, score


def _walked(positives: bool, most: int, low_share: int, high_share: int):
    """For a cogroup of one block of anchors and one shard of rows: the shard's share of the anchors' results."""
    names = ["anchor_row", "window", "score", "hn_row", "hn_id"]

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[] for _ in names]
        if anchors.num_rows and rows.num_rows:
            a, b = same_width(matrix(anchors["hn_vector"]), matrix(rows["hn_vector"]))
            cluster, a_row, a_label = (anchors[c].to_numpy() for c in ("cluster", "hn_row", "hn_label"))
            row, label = rows["hn_row"].to_numpy(), rows["hn_label"].to_numpy()
            ids = rows["hn_id"].fill_null(_LAST).to_numpy()
            if positives:
                low = np.full((len(a), 1), np.iinfo(np.int64).min // 2)
                high = np.full((len(a), 1), np.iinfo(np.int64).max // 2)
            else:
                scores = matrix(anchors["positives"])
                sizes = np.diff(anchors["positives"].combine_chunks().offsets.to_numpy())
                low, high = -((-low_share * scores) // 100), (high_share * scores) // 100
                low[np.arange(scores.shape[1]) >= sizes[:, None]] = 1
                high[np.arange(scores.shape[1]) >= sizes[:, None]] = 0
            for c in np.unique(cluster):
                of = np.flatnonzero(cluster == c)
                order, bound = shared_list(a[of], b)
                parts = np.unique(a_label[of]) if positives else [None]
                for part in parts:
                    mine = of if part is None else of[a_label[of] == part]
                    stay = np.ones(len(order), bool) if part is None else label[order] == part

                    def skip(i: np.ndarray, j: np.ndarray, mine: np.ndarray = mine) -> np.ndarray:
                        return (a_row[mine[i]][:, None] == row[j]) if positives else (a_label[mine[i]][:, None] == label[j])

                    group, found, score = walk(a[mine], b, ids, order[stay], bound[stay], low[mine], high[mine], most, skip)
                    for column, value in zip(out, (a_row[mine[group // low.shape[1]]], group % low.shape[1], score, row[found], ids[found]), strict=True):
                        column.append(value)
        columns = [pa.array(np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64)) for c in out]
        columns[4] = pa.array(columns[4].to_numpy(), mask=columns[4].to_numpy() == _LAST)
        return pa.Table.from_arrays(columns, names)

    return run


_RESULT = "anchor_row long, window long, score long, hn_row long, hn_id long"


def _placed(centroids: np.ndarray, blocks: dict[int, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, c = same_width(matrix(batch.column("hn_vector")), centroids)
            near = np.argmax(unit(m) @ c.T, axis=1)
            row = batch.column("hn_row").to_numpy()
            if blocks:
                first = np.array([blocks.get(k, (0, 1))[0] for k in range(len(centroids))])
                many = np.array([blocks.get(k, (0, 1))[1] for k in range(len(centroids))])
                block = first[near] + row % many[near]
            else:
                block = np.zeros(len(row), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(block)], [*batch.schema.names, "cluster", "block"])

    return run


def clustered(anchors: DataFrame, many: int) -> tuple[DataFrame, int]:
    """The anchors with their cluster and block, and the number of blocks."""
    sample = anchors.orderBy(F.xxhash64("hn_row"), "hn_row").limit(SAMPLE).select("hn_vector").toArrow()
    clusters = int(min(CLUSTERS, max(1, many // MEMBERS)))
    centroids = learned_centroids(matrix(sample["hn_vector"]), clusters)
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema.fields)
    schema = f"{names}, cluster long, block long"
    sizes = {r.cluster: r["count"] for r in anchors.mapInArrow(_placed(centroids, {}), schema).groupBy("cluster").count().collect()}
    blocks: dict[int, tuple[int, int]] = {}
    at, room = -1, 0
    # clusters whose centroids are close stand next to each other, by their place along the first centroid's direction
    for c in sorted(sizes, key=lambda c: (-float(centroids[c] @ centroids[0]), c)):
        if sizes[c] > BLOCK:
            pieces = math.ceil(sizes[c] / (BLOCK // 2))
            blocks[c] = (at + 1, pieces)
            at, room = at + pieces, 0
            continue
        if sizes[c] > room:
            at, room = at + 1, BLOCK
        blocks[c] = (at, 1)
        room -= sizes[c]
    return anchors.mapInArrow(_placed(centroids, blocks), schema), at + 1


def _grid(anchors: DataFrame, rows: DataFrame, blocks: int, shards: int, run) -> DataFrame:
    left = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("block", F.col("block").cast("int"))
    right = rows.withColumn("shard", F.pmod(F.xxhash64("hn_row"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(run, _RESULT)


def _merged(parts: DataFrame, most: int, rank: str) -> DataFrame:
    order = Window.partitionBy("anchor_row", "window").orderBy(F.desc("score"), F.asc_nulls_last("hn_id"), "hn_row")
    return parts.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= most)


def mine(
    rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is over hn_id; a negative's score is from ``low`` to ``high`` percent of the positive's, both inside.
    The result reads intermediate tables of the shared folder.
    """
    scratch = Scratch(rows.sparkSession, "negatives")
    table = scratch.table(prepared(rows, vec_id, vector, label, scale), "rows")
    anchors = table.where(F.coalesce(is_anchor, F.lit(False)))
    total, many = table.count(), anchors.count()
    if not many:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    shards = math.ceil(total / min(SHARD, 16 * math.sqrt(total)))
    placed, blocks = clustered(anchors, many)
    placed = scratch.table(placed, "anchors")
    first = _merged(_grid(placed, table, blocks, shards, _walked(True, positives, low, high)), positives, "place")
    first = scratch.table(first.select("anchor_row", "place", F.col("hn_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    own = first.groupBy("anchor_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda p: p["positive_score"]).alias("positives"))
    wanted = placed.join(own.withColumnRenamed("anchor_row", "hn_row"), "hn_row")
    found = _merged(_grid(wanted, table, blocks, shards, _walked(False, negatives, low, high)), negatives, "rank")
    named = first.join(placed.select(F.col("hn_row").alias("anchor_row"), F.col("hn_id").alias("anchor_id")), "anchor_row")
    out = found.select("anchor_row", (F.col("window") + 1).cast("int").alias("place"), "rank", F.col("hn_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return out.join(named, ["anchor_row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
