"""Nearest neighbours by cosine for many queries: an exact search in blocks, and an inverted file with measured recall.

Exact: queries in blocks and rows in shards form a grid of bounded groups; each group is one matrix product that keeps k rows a query, and the
shards' lists are merged. Shards grow with the square root of the rows, so what is merged grows with rows to the power of 1.5 and no
join has a side that is broadcast. A row travels once a block of queries, a block once a shard.

Inverted file: centroids learned from a bounded sample, every row in the list of its nearest centroid, queries against the lists of
their ``probes`` nearest centroids. A list that holds many rows is split in parts, so a hot list is spread. ``tuned`` doubles the probes until
the recall against the exact search, on a sample of queries, reaches what is asked; with all lists the search is exact.

The cosine is 0 where either vector has length 0. Rows with a null id or vector take no part; null components count as 0, vectors of different lengths are
compared over the shorter one. Ties stand by id. Ids are whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from platewise.session import Scratch

BLOCK = 4096  # queries a block
SHARD = 65536  # rows a shard, at most about
SAMPLE = 20_000  # rows from which centroids are learned
CELLS = 1 << 22  # cells of a product that stand in memory at once
_FOUND = "query_id long, row_id long, cosine double"


def unit_rows(column: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """A list column as rows of length one (or zero)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    values = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = max(width, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1.0)


def _widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


def best_rows(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, digits: int | None, self_too: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, row ids, cosines) of the k best rows of each query, some queries at a time."""
    queries, rows = _widened(queries, rows)
    step = max(1, CELLS // max(1, len(rows)))
    for at in range(0, len(queries), step):
        product = np.clip(queries[at : at + step] @ rows.T, -1, 1)
        if digits is not None:
            product = np.round(product, digits)
        if not self_too:
            product[query_ids[at : at + step, None] == ids] = -np.inf
        least = np.partition(product, max(0, product.shape[1] - k), axis=1)[:, max(0, product.shape[1] - k)]
        i, j = np.nonzero((product >= least[:, None]) & np.isfinite(product))
        value = product[i, j]
        order = np.lexsort((ids[j], -value, i))
        i, j, value = i[order], j[order], value[order]
        begin = np.searchsorted(i, np.arange(len(product)))
        keep = np.arange(len(i)) - begin[i] < k
        yield query_ids[at + i[keep]], ids[j[keep]], value[keep]


def _product(k: int, digits: int | None, self_too: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if queries.num_rows and rows.num_rows:
            found = list(best_rows(unit_rows(queries["v"]), queries["id"].to_numpy(), unit_rows(rows["v"]), rows["id"].to_numpy(), k, digits, self_too))
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found or [empty], strict=True)], ["query_id", "row_id", "cosine"])

    return run


def _merged(parts: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "row_id")
    return parts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _vectors(rows: DataFrame, row_id: str, vector: str) -> DataFrame:
    return rows.where(F.col(row_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def knn(rows: DataFrame, queries: DataFrame, k: int, row_id: str, vector: str, digits: int | None = None, self_too: bool = False) -> DataFrame:
    """query_id, row_id, cosine, place: the k nearest rows of each query, exactly.

    Both tables have the columns ``row_id`` and ``vector``. ``digits``: order by the rounded cosine. Unless ``self_too``, rows of the query's own id are left out.
    """
    scratch = Scratch(rows.sparkSession, "knn")
    base, asked = scratch.table(_vectors(rows, row_id, vector), "rows"), scratch.table(_vectors(queries, row_id, vector), "queries")
    n, m = base.count(), asked.count()
    shards, blocks = max(1, math.ceil(n / min(SHARD, 16 * math.sqrt(max(n, 1))))), max(1, math.ceil(m / BLOCK))
    number = lambda many: F.pmod(F.xxhash64("id", F.lit(17)), F.lit(many)).cast("int")
    left = asked.select("id", "v", number(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    right = base.select("id", "v", number(shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return _merged(left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(_product(k, digits, self_too), _FOUND), k)


def _blocks(rows: DataFrame, size: int, many: int) -> DataFrame:
    """Rows (id, v) as blocks of at most ``size`` rows of length one (zero where a component is null), in ``many`` partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                unit, v = unit_rows(part.column("v")), part.column("v")
                unit[np.repeat(np.arange(len(v)), np.diff(v.offsets.to_numpy()))[v.flatten().is_null().to_numpy(zero_copy_only=False)]] = 0.0
                yield pa.RecordBatch.from_arrays([pa.array([part.column("id").to_numpy().tobytes()], pa.binary()), pa.array([unit.tobytes()], pa.binary())], ["ids", "vectors"])

    return rows.mapInArrow(run, "ids binary, vectors binary").repartition(many)


def _all_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each two blocks that met, one pair of blocks at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            asked, one, ids, two = (batch.column(c)[i].as_buffer() for c in ("q_ids", "q_vectors", "ids", "vectors"))
            asked, ids = np.frombuffer(asked, np.int64), np.frombuffer(ids, np.int64)
            one, two = _widened(np.frombuffer(one).reshape(len(asked), -1), np.frombuffer(two).reshape(len(ids), -1))
            apart = asked[:, None] != ids
            product = one @ two.T
            cosine = np.copysign(np.floor(np.abs(product * 1e4) + 0.5), product) / 1e4 + 0.0
            left, right = (np.broadcast_to(x, apart.shape)[apart] for x in (asked[:, None], ids))
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(cosine[apart])], ["query_id", "row_id", "cosine"])


def cosine_pairs(rows: DataFrame, queries: DataFrame, row_id: str, vector: str, cells: int = 1 << 20) -> DataFrame:
    """query_id, row_id, cosine (four decimals, halves away from zero) of each query with each row of another id; a vector that is null or has a null component has cosine 0 with all.

    Blocks of queries and shards of rows of about ``cells`` pairs meet in a cartesian product: each side is shuffled once, a task fetches the two parts that it
    multiplies, so disk grows with the rows and memory is bounded; the pairs themselves are the result.
    """
    plain = lambda df: df.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).select("id", F.coalesce("v", F.array().cast("array<double>")).alias("v"))
    base, asked = plain(rows), plain(queries)
    n, m = base.count(), asked.count()
    block = max(1, min(m, math.isqrt(cells) // 2))
    shard = max(1, cells // block)
    # a task holds a part of the queries and streams a part of the rows; what it returns is far more than what it reads
    left = _blocks(base, shard, min(4_000, max(1, math.ceil(n / shard))))
    right = _blocks(asked, block, min(25, max(1, math.ceil(m / block)))).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    return left.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(_all_pairs, _FOUND)


class InvertedFile:
    """Rows in the lists of their nearest centroids."""

    def __init__(self, rows: DataFrame, row_id: str, vector: str, lists: int | None = None, seed: int = 3):
        self.scratch = Scratch(rows.sparkSession, "ivf")
        base = _vectors(rows, row_id, vector)
        self.row_id, self.vector, self.source = row_id, vector, rows
        sample = base.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).toArrow()
        many = lists or max(1, round(math.sqrt(sample.num_rows)))
        self.centroids = self._learned(unit_rows(sample["v"]), many, seed)
        self.rows = self.scratch.table(base.mapInArrow(self._nearest(1), "id long, v array<double>, list int"), "lists")
        self.sizes = {r["list"]: r["count"] for r in self.rows.groupBy("list").count().collect()}  # one row a list

    @staticmethod
    def _learned(x: np.ndarray, many: int, seed: int, rounds: int = 8) -> np.ndarray:
        if not len(x):
            return np.zeros((1, max(1, x.shape[1])))
        centre = x[np.random.default_rng(seed).choice(len(x), min(many, len(x)), replace=False)]
        for _ in range(rounds):
            near, total = np.argmax(x @ centre.T, axis=1), np.zeros_like(centre)
            np.add.at(total, near, x)
            norm = np.linalg.norm(total, axis=1, keepdims=True)
            centre = np.where(norm > 0, total / np.where(norm > 0, norm, 1.0), centre)
        return centre

    def _nearest(self, probes: int):
        centroids = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, c = _widened(unit_rows(batch.column("v")), centroids)
                near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes]
                taken = np.repeat(np.arange(len(x)), near.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(taken)), batch.column("v").take(pa.array(taken)), pa.array(near.ravel().astype(np.int32))], ["id", "v", "list"])

        return run

    def search(self, queries: DataFrame, k: int, probes: int, digits: int | None = None, self_too: bool = False) -> DataFrame:
        """query_id, row_id, cosine, place: the k nearest rows in the lists of the ``probes`` nearest centroids."""
        limit = min(SHARD, 16 * math.sqrt(max(1, sum(self.sizes.values()))))
        parts = {c: math.ceil(n / limit) for c, n in self.sizes.items()}
        many = F.coalesce(F.create_map(*(F.lit(x) for c, p in parts.items() for x in (c, p)))[F.col("list")], F.lit(1)) if parts else F.lit(1)
        asked = _vectors(queries, self.row_id, self.vector).mapInArrow(self._nearest(min(probes, len(self.centroids))), "id long, v array<double>, list int")
        # all queries may probe one list: blocks bound a group whatever the lists are
        blocks = max(1, math.ceil(queries.count() / BLOCK))
        block = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(blocks)).cast("int")
        left = asked.select("id", "v", "list", block.alias("block"), F.explode(F.sequence(F.lit(0), many - 1)).alias("part"))
        right = self.rows.select("id", "v", "list", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("id", F.lit(17)), many.cast("long")).cast("int").alias("part"))
        keys = ["list", "block", "part"]
        return _merged(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_product(k, digits, self_too), _FOUND), k)

    def recall(self, queries: DataFrame, k: int, probes: int, exact: DataFrame | None = None) -> float:
        """Share of the exact k nearest rows that the search finds."""
        exact = knn(self.source, queries, k, self.row_id, self.vector) if exact is None else exact
        wanted = exact.select("query_id", "row_id")
        both = wanted.join(self.search(queries, k, probes).select("query_id", "row_id", F.lit(1).alias("hit")), ["query_id", "row_id"], "left")
        got = both.agg(F.count("hit").alias("hits"), F.count("*").alias("all")).first()
        return got.hits / got.all if got.all else 1.0

    def tuned(self, queries: DataFrame, k: int, least: float = 0.9, sample: int = 200) -> int:
        """The fewest probes, by doubling, whose recall on a sample of the queries is ``least``."""
        some = self.scratch.table(queries.orderBy(F.xxhash64(self.row_id, F.lit(5)), self.row_id).limit(sample), "asked")
        exact = self.scratch.table(knn(self.source, some, k, self.row_id, self.vector), "exact")
        probes = 1
        while probes < len(self.centroids) and self.recall(some, k, probes, exact) < least:
            probes = min(2 * probes, len(self.centroids))
        return probes
