"""The best likeness of each asked text to any line.

Lines are met where they are: a task compares its Arrow batches with the asked texts and keeps one number for each of them. Some thousand texts travel to
every task; more of them meet the lines in blocks, by a cartesian product that holds neither side whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines that meet the asked texts at once (a parameter of memory, not of the result).
LINES = 2048
#: Asked texts that are compared at once, and that may travel to every task.
TEXTS, ASKED = 256, 4096


def _compared(asked: list[str]) -> Callable[[pa.Array], np.ndarray]:
    """What finds the best likeness of each asked text to lines that are not empty."""
    words = [sorted(set(q.split(" ")) - {""}) for q in asked]
    known = sorted({w for ws in words for w in ws})
    place = {w: i for i, w in enumerate(known)}
    holds = np.zeros((len(known) + 1, len(asked)), np.int32)  # the last row stands for all other words
    for i, ws in enumerate(words):
        holds[[place[w] for w in ws], i] = 1
    n_words = np.array([len(ws) for ws in words])
    vocabulary, together = pa.array(known, pa.string()), "\n".join(asked)

    def of_lines(lines: pa.Array) -> np.ndarray:
        n, split = len(lines), pc.split_pattern(lines, " ")
        rows = np.repeat(np.arange(n), pc.list_value_length(split).to_numpy())
        found = pc.dictionary_encode(split.flatten())
        codes, listed = found.indices.to_numpy().astype(np.int64), found.dictionary
        real = pc.not_equal(listed, "").to_numpy(zero_copy_only=False)[codes]
        pairs = np.unique(rows[real] * len(listed) + codes[real])  # each word of a line once
        rows, codes = pairs // len(listed), pairs % len(listed)
        at = pc.fill_null(pc.index_in(listed, vocabulary), len(known)).to_numpy()[codes]
        size, over = np.bincount(rows, minlength=n), pc.utf8_length(lines).to_numpy()
        hit = at < len(known)
        both = np.zeros((n, len(asked)))
        first = np.flatnonzero(np.append(True, rows[hit][1:] != rows[hit][:-1])) if hit.any() else []
        if len(first):
            both[rows[hit][first]] = np.add.reduceat(holds[at[hit]], first)
        likeness = 2.0 * both / (size[:, None] + n_words)
        # a text that holds the other has another likeness, which may be lower
        short = np.flatnonzero(over <= max(map(len, asked)))
        inside = [(j, t) for j, t in zip(short, lines.take(pa.array(short)).to_pylist(), strict=True) if t in together]
        for i, q in enumerate(asked):
            # of a text that a line holds, all words but the first and the last are words of the line
            near = pa.array(np.flatnonzero(both[:, i] >= n_words[i] - 2))
            holding = near.filter(pc.match_substring(lines.take(near), q)).to_numpy(zero_copy_only=False)
            likeness[holding, i] = len(q) / over[holding]
            held = np.array([j for j, t in inside if t in q], np.int64)
            likeness[held, i] = over[held] / max(len(q), 1)
        return likeness.max(axis=0)

    return of_lines


def _keys(lines: pa.Array) -> pa.Array:
    lines = pc.utf8_trim(pc.replace_substring_regex(lines, "[^a-z0-9 ]+", " "), " ")
    return lines.filter(pc.not_equal(lines, ""))


def _best(asked: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_compared(asked[i : i + TEXTS]) for i in range(0, len(asked), TEXTS)]
        best = None
        for batch in batches:
            for at in range(0, batch.num_rows, LINES):
                lines = _keys(batch.column(0).slice(at, LINES))
                if not len(lines):
                    continue
                own = np.concatenate([part(lines) for part in parts])
                best = own if best is None else np.maximum(best, own)
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(asked), dtype=np.int32)), pa.array(best)], ["place", "best"])

    return run


def _listed(rows: DataFrame, name: str, size: int) -> DataFrame:
    """The strings of the only column as lists of at most ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.column(0).slice(at, size)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.concat_arrays([part]))], [name])

    return rows.mapInArrow(run, f"{name} array<string>")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            asked, lines = batch.column("asked")[i].values, _keys(batch.column("lows")[i].values)
            if len(lines):
                yield pa.RecordBatch.from_arrays([asked, pa.array(_compared(asked.to_pylist())(lines))], ["q", "best"])


def best_overlap(asked: DataFrame, lines: DataFrame) -> DataFrame:
    """(item_id, best): the largest likeness of each asked text (item_id, q) to the lines (low, lower-cased).

    Texts are words a-z, 0-9 between spaces; a run of other signs counts as one space, lines without words do not count. If one holds the other the likeness is the share of the longer one, else Dice of their words. An id's texts count together; no lines, no rows.
    """
    distinct = asked.select("q").where("q is not null").distinct()
    texts = sorted(r.q for r in distinct.limit(ASKED + 1).collect())
    if len(texts) > ASKED:
        # parts of the texts are few, as the lines are read once for each
        blocks, low = _listed(distinct.repartition(8), "asked", TEXTS), _listed(lines.select("low").where("low is not null"), "lows", LINES)
        found = low.crossJoin(blocks.hint("shuffle_replicate_nl")).mapInArrow(_met, "q string, best double").groupBy("q").agg(F.max("best").alias("best"))
        return asked.join(found, "q").groupBy("item_id").agg(F.max("best").alias("best"))
    place = asked.sparkSession.createDataFrame(list(enumerate(texts)), "place int, q string")
    best = lines.select("low").mapInArrow(_best(texts), "place int, best double") if texts else asked.sparkSession.createDataFrame([], "place int, best double")
    found = best.groupBy("place").agg(F.max("best").alias("best")).join(F.broadcast(place), "place")
    return asked.join(found, "q").groupBy("item_id").agg(F.max("best").alias("best"))
