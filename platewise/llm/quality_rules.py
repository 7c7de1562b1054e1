"""Quality rules: exact rule statistics and an isolation forest over them.

One pass computes the statistics of whole texts in vectorised blocks; words are compared by 64-bit hashes, repeated lines also
by their bytes. The statistics are written once, in place of the texts. The forest is grown on all labelled rows, a job a level: Spark
brings the extent and mass of each node together, the driver holds the trees only. Each tree splits the rows at
random values of those statistics that separate the labels best, and a document that is isolated after few splits is
anomalous. The threshold on the mean path length comes from the labels of all rows: the highest share of bad
rows among those thresholds that lose at most ``clean_loss`` of the good ones.

Defined cases: a null or empty text has no words and fails the base rule; without labelled
rows of both kinds nothing but the base rule rejects; repeated rows get equal results; further
columns are carried through, but those that have the name of an added column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.columns import carried, schema_of
from platewise.llm.text_arrays import WHITE as _WHITE
from platewise.llm.text_arrays import blocks, mix, span_hash, word_spans
from platewise.session import materialize

#: The symbols that are counted, the window of the repetition rule, the base limits.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbols a word", "duplicate lines", "repeated words", "characters a word", "upper-case share", "digit share", "stops a word", "distinct words")

_IS_SYMBOL, _IS_UPPER, _IS_DIGIT, _IS_STOP = (np.zeros(256, bool) for _ in range(4))
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_UPPER[65:91] = True
_IS_DIGIT[48:58] = True
_IS_STOP[list(b"!?;:.,")] = True


def _by_row(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """For each row, the words in windows of eight that stand twice or more in the row."""
    m = len(hashes) - WINDOW + 1
    if m <= 0:
        return np.zeros(n, np.int64)
    whole = np.flatnonzero(rows[:m] == rows[WINDOW - 1 :])
    if not len(whole):
        return np.zeros(n, np.int64)
    key = rows[whole].astype(np.uint64)
    for j in range(WINDOW):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + hashes[whole + j])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    at = whole[twice]
    edges[at] += 1
    edges[at + WINDOW] -= 1
    covered = np.cumsum(edges[:-1]) > 0
    return np.bincount(rows[covered], minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x COUNTS integers, rows x FEATURES floats) of one block of texts."""
    n = len(offsets) - 1
    starts, ends, rows = word_spans(data, offsets)
    words = span_hash(data, starts, ends)
    n_words = np.bincount(rows, minlength=n)
    word_chars = _by_row(((data & 0xC0) != 0x80) & ~_WHITE[data], offsets)
    symbols = _by_row(_IS_SYMBOL[data], offsets)
    cuts = np.flatnonzero(data == 10)
    line_from = np.sort(np.concatenate([offsets[:-1], cuts + 1]), kind="stable")
    inside = np.searchsorted(offsets[:-1], line_from, "right") - 1
    # an empty text shares its start with the next one; lines without words don't count, so either row will do
    line_to = np.minimum(np.append(line_from[1:], len(data)), offsets[1:][inside])
    first_word = np.searchsorted(starts, line_from)
    filled = (first_word < len(starts)) & (np.append(starts, len(data) + 1)[first_word] < line_to)
    line_to -= (line_to > line_from) & (data[np.maximum(line_to - 1, 0)] == 10) if len(data) else 0
    keys = mix(span_hash(data, line_from, line_to)[filled] + inside[filled].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(keys, return_index=True)
    lines = np.bincount(inside[filled], minlength=n)
    dup_lines = lines - np.bincount(inside[filled][first], minlength=n)
    for r in np.flatnonzero(dup_lines):  # what the hashes call equal is confirmed by bytes
        own = filled & (inside == r)
        dup_lines[r] = lines[r] - len({data[x:y].tobytes() for x, y in zip(line_from[own], line_to[own], strict=True)})
    repeat = repeated_words(words, rows, n)
    distinct = np.zeros(n)
    pairs = np.unique(mix(words + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    distinct += np.bincount(rows[pairs], minlength=n)
    counts = np.column_stack([n_words, word_chars, symbols, dup_lines, repeat]).astype(np.int64)
    w, size = np.maximum(n_words, 1), np.maximum(np.diff(offsets), 1)
    features = np.column_stack([
        symbols / w, dup_lines / np.maximum(lines, 1), repeat / w, word_chars / w, _by_row(_IS_UPPER[data], offsets) / size,
        _by_row(_IS_DIGIT[data], offsets) / size, _by_row(_IS_STOP[data], offsets) / w, np.log1p(distinct) / np.log1p(w),
    ])
    return counts, features


class IsolationForest:
    """Isolation trees over all rows, grown level by level from the extent and the mass of each node.

    Node v of a tree has the children 2v and 2v + 1. A node is split at a random value of a random statistic within the extent
    of its rows; it is a leaf at ``DEPTH``, or once its mass is one row in ``ROWS``. Rows are only asked for sums and extremes, so they
    may be anywhere, and their order does not matter.
    """

    ROWS, DEPTH = 128, 7

    def __init__(self, trees: int = 100, seed: int = 5, columns: list[int] | None = None):
        self.trees, self.seed, self.columns = trees, seed, columns
        size = (trees, 2 << self.DEPTH)
        self.feature, self.value, self.length = np.full(size, -1), np.zeros(size), np.zeros(size)
        self.open = np.zeros(size, bool)
        self.open[:, 1] = True
        self.whole = 0.0

    @staticmethod
    def expected(n: float) -> float:
        """The mean path length of a failed search among n rows."""
        return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def own(self, x: np.ndarray) -> np.ndarray:
        return x if self.columns is None else x[:, self.columns]

    def place(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The node of each row (of own columns) in a tree, as far as it is grown."""
        feature, value = self.feature[tree], self.value[tree]
        rows, at = np.arange(len(x)), np.ones(len(x), np.int64)
        for _ in range(self.DEPTH):
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            at = np.where(inner, 2 * at + (x[rows, np.maximum(f, 0)] >= value[at]), at)
        return at

    def summary(self, x: np.ndarray, good: np.ndarray) -> np.ndarray:
        """A line for each open node: tree, node, good rows, bad rows, lows, highs (of own columns)."""
        x, out = self.own(x), []
        for tree in range(self.trees):
            at = self.place(x, tree)
            rows = np.flatnonzero(self.open[tree][at])
            rows = rows[np.argsort(at[rows], kind="stable")]
            if not len(rows):
                continue
            node = at[rows]
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            n, n_good = np.diff(np.append(first, len(rows))), np.add.reduceat(good[rows].astype(np.int64), first)
            out.append(np.column_stack([np.full(len(first), tree), node[first], n_good, n - n_good, np.minimum.reduceat(x[rows], first), np.maximum.reduceat(x[rows], first)]))
        return np.vstack(out) if out else np.zeros((0, 4 + 2 * x.shape[1]))

    def deepen(self, lines: np.ndarray) -> None:
        """Split or end every open node, given its line over all rows."""
        n = (lines.shape[1] - 4) // 2
        if not self.whole and len(lines):
            n_good, n_bad = lines[0, 2:4]
            self.bad_weight = min(1.0, BAD_SHARE * n_good / n_bad) if n_good and n_bad else 1.0
            self.whole = n_good + self.bad_weight * n_bad
        self.open[:] = False
        scale = min(self.ROWS, self.whole) / max(self.whole, 1e-9)
        for line in lines:
            tree, node, low, high = int(line[0]), int(line[1]), line[4 : 4 + n], line[4 + n :]
            depth, mass = node.bit_length() - 1, scale * (line[2] + self.bad_weight * line[3])
            apart = np.flatnonzero(high > low)
            if depth >= self.DEPTH or mass <= 1 or not len(apart):
                self.length[tree, node] = depth + self.expected(mass)
                continue
            rng = np.random.default_rng((self.seed, tree, node))
            f = int(rng.choice(apart))
            self.feature[tree, node], self.value[tree, node] = f, rng.uniform(low[f], high[f])
            self.open[tree, 2 * node : 2 * node + 2] = True

    def fit(self, x: np.ndarray) -> IsolationForest:
        """Grow on rows at hand, all of them good."""
        while self.open.any() and len(x):
            self.deepen(self.summary(x, np.ones(len(x), bool)))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; higher is more anomalous."""
        x = self.own(x)
        total = np.zeros(len(x))
        for tree in range(self.trees):
            total += self.length[tree][self.place(x, tree)]
        return 2.0 ** (-total / max(1, self.trees) / max(self.expected(min(self.ROWS, self.whole)), 1e-9))


#: The weight of all bad rows that grow the forest, against that of the good ones: so little that they stay anomalous.
BAD_SHARE = 0.03
#: Scores are counted in this many steps; a threshold lies at a step, or half way to the next filled one.
STEPS = 1 << 14


def _each(rows: DataFrame, lines, schema: str, forests: list[IsolationForest]) -> DataFrame:
    """``lines(forest, features, good)`` of every Arrow batch and forest, the forest's number before them."""
    shared = rows.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                good = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
                for i, forest in enumerate(shared.value):
                    found = lines(forest, x, good)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), float(i))), *(pa.array(c) for c in found.T)], ["forest", *(f"c{j}" for j in range(found.shape[1]))])

    return rows.select("good", "features").mapInArrow(run, schema)


def grow(rows: DataFrame, forests: list[IsolationForest]) -> list[IsolationForest]:
    """Grow forests with equally many columns on all rows (good, features), a job a level."""
    n = len(forests[0].columns)
    columns = [f"c{j}" for j in range(4 + 2 * n)]
    schema = ", ".join(f"{c} double" for c in ("forest", *columns))
    merged = [F.sum(c).alias(c) for c in columns[2:4]] + [F.min(c).alias(c) for c in columns[4 : 4 + n]] + [F.max(c).alias(c) for c in columns[4 + n :]]
    while any(f.open.any() for f in forests):
        lines = _each(rows, lambda forest, x, good: forest.summary(x, good), schema, forests).groupBy("forest", "c0", "c1").agg(*merged).toArrow()
        if not lines.num_rows:
            break
        lines = np.column_stack([c.to_numpy() for c in lines.columns])
        for i, forest in enumerate(forests):
            forest.deepen(lines[lines[:, 0] == i][:, 1:])
    return forests


def _score_steps(forest: IsolationForest, x: np.ndarray, good: np.ndarray) -> np.ndarray:
    step = np.minimum((forest.score(x) * STEPS).astype(np.int64), STEPS)
    used, where = np.unique(step, return_inverse=True)
    return np.column_stack([used, np.bincount(where, good), np.bincount(where, ~good)]).astype(float)


def calibrate(rows: DataFrame, forests: list[IsolationForest], clean_loss: float) -> list[tuple[float, float]]:
    """For each forest the lowest threshold that rejects at most ``clean_loss`` of all good rows, and the share of bad rows that it rejects less that of the good ones."""
    found = _each(rows, _score_steps, "forest double, c0 double, c1 double, c2 double", forests).groupBy("forest", "c0").agg(F.sum("c1"), F.sum("c2")).toArrow()
    lines = np.column_stack([c.to_numpy() for c in found.columns]) if found.num_rows else np.zeros((0, 4))
    out = []
    for i in range(len(forests)):
        counts = np.zeros((STEPS + 2, 2))
        own = lines[lines[:, 0] == i]
        counts[own[:, 1].astype(int)] = own[:, 2:]
        n_good, n_bad = counts.sum(axis=0)
        above = counts[::-1].cumsum(axis=0)[::-1]  # rows at this step or higher
        at = int(np.flatnonzero(above[:, 0] <= int(clean_loss * n_good))[0])
        filled = np.flatnonzero(counts[at:].sum(axis=1))
        if not n_good or not n_bad or not len(filled):
            out.append((float("inf"), 0.0))
            continue
        out.append(((at + filled[0] / 2) / STEPS, above[at, 1] / n_bad - above[at, 0] / n_good))
    return out


def separating(rows: DataFrame, clean_loss: float, most: int = 4, trees: int = 24) -> list[int]:
    """The statistics whose small forest rejects the most bad rows, found one by one; those of one step grow together."""
    chosen, best = [], -1.0
    while len(chosen) < most:
        left = [k for k in range(len(FEATURES)) if k not in chosen]
        forests = grow(rows, [IsolationForest(trees, columns=[*chosen, k]) for k in left])
        value, k = max((gain, -k) for k, (_, gain) in zip(left, calibrate(rows, forests, clean_loss), strict=True))
        if value <= best + 0.002:
            break
        chosen, best = [*chosen, -k], value
    return sorted(chosen)


def _statistics_batches(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(0)):
                counts, features = statistics(data, offsets)
                failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
                out = [c.slice(a, b - a) for c in batch.columns[1:]]
                out += [pa.array(counts[:, i]) for i in range(len(COUNTS))] + [pa.array(failed)]
                out.append(pa.FixedSizeListArray.from_arrays(pa.array(features.ravel()), len(FEATURES)).cast(pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays(out, names)

    return run


#: What :func:`measure` and :func:`judge` add.
_FEATURES, _FAILED = "qr_features", "base_failed"
ADDED = (*COUNTS, _FAILED, "anomaly", "kept")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text and those that have the name of an added one, with the statistics, base_failed and qr_features."""
    rest = carried(docs, (*ADDED, _FEATURES), text)
    inner = [f"c{i}" for i in range(len(rest))]
    tail = [*COUNTS, _FAILED, _FEATURES]
    schema = ", ".join([*schema_of(docs, rest), *(f"{c} long" for c in COUNTS), f"{_FAILED} boolean", f"{_FEATURES} array<double>"])
    out = docs.select(F.col(text).alias("qr_text"), *(F.col(c).alias(n) for n, c in zip(inner, rest, strict=True))).mapInArrow(_statistics_batches([*inner, *tail]), schema)
    return out.toDF(*rest, *tail)


def fit_rules(measured: DataFrame, labels: DataFrame, trees: int = 100, clean_loss: float = 0.002) -> tuple[IsolationForest, float]:
    """Choose the statistics, grow the forest and set its threshold on all labelled rows of :func:`measure` that pass the base rule.

    A doc_id that is labelled more than once counts with its largest label; null labels are left out.
    """
    marks = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("qr_id")).agg(F.max("quality").cast("int").alias("mark"))
    known = measured.where(f"not {_FAILED}").select("doc_id", F.col(_FEATURES).alias("features"))
    rows = materialize(known.join(marks.hint("merge"), F.col("doc_id") == F.col("qr_id")).select((F.col("mark") == 1).alias("good"), "features"), "labelled")
    kinds = {r.good: r["count"] for r in rows.groupBy("good").count().collect()}
    if not kinds:
        return IsolationForest(0), float("inf")
    columns = separating(rows, clean_loss) if len(kinds) == 2 else list(range(len(FEATURES)))
    forest = grow(rows, [IsolationForest(trees, columns=columns)])
    return forest[0], calibrate(rows, forest, clean_loss)[0][0]


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of ``docs`` but the text, with counts, base_failed, anomaly and kept."""
    measured = materialize(measure(docs), "measured")
    model = docs.sparkSession.sparkContext.broadcast(fit_rules(measured, labels))

    @F.pandas_udf("double")
    def anomaly(features: pd.Series) -> pd.Series:
        return pd.Series(model.value[0].score(np.vstack(features))) if len(features) else pd.Series([], dtype=float)

    out = measured.withColumn("anomaly", anomaly(_FEATURES))
    return out.withColumn("kept", ~F.col(_FAILED) & (F.col("anomaly") < F.lit(model.value[1]))).drop(_FEATURES)
