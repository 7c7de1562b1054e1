"""Folds over sorted runs: state that depends on all rows before, in bounded memory.

Rows of a key are brought together and sorted by Spark (which spills), then streamed through a fold that
holds only its own state. A key may span any number of Arrow batches, so a run of millions of rows never stands in memory as a
whole, as it would in a grouped pandas function. One key's rows pass through one task: the fold is sequential by nature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that leave a fold together.
BATCH = 4096


class Fold(Protocol):
    """The state of one run; rows are tuples without the key."""

    def add(self, row: tuple) -> Iterable[tuple]: ...

    def end(self) -> Iterable[tuple]: ...


def _values(column: pa.Array) -> list:
    """As ``to_pylist``, which makes an object of Arrow's for each value first."""
    if pa.types.is_nested(column.type) or (column.null_count and not pa.types.is_string(column.type)):
        return column.to_pylist()
    return column.to_numpy(zero_copy_only=False).tolist()


def sorted_runs(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """All rows of a key in one partition, next to each other, in order."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def fold_runs(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], fold: Callable[[], Fold], schema: str) -> DataFrame:
    """Fold the runs of ``rows``, which :func:`sorted_runs` (and narrow steps since) made; ``schema`` is that of the fold's rows.

    The result has the keys and the fold's columns, in the order of the runs: it is sorted as its input was.
    """
    n = len(keys)
    key_fields = [rows.schema[k] for k in keys]
    out_schema = StructType(key_fields + list(StructType.fromDDL(schema).fields))
    arrow = to_arrow_schema(out_schema)

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key, found = None, None, []
        for batch in batches:
            for row in zip(*map(_values, batch.columns), strict=True):
                if state is None or row[:n] != key:
                    if state is not None:
                        found += (key + r for r in state.end())
                    state, key = fold(), row[:n]
                found += (key + r for r in state.add(row[n:]))
                if len(found) >= BATCH:
                    yield batch_of(found)
                    found = []
        if state is not None:
            found += (key + r for r in state.end())
        if found:
            yield batch_of(found)

    return rows.select(*keys, *columns).mapInArrow(run, out_schema)
