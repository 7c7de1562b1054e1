"""Quality classifier by co-training.

Two views of a document: its text content (rule statistics and the histogram of pairs of byte
classes) and its page metadata (language, source, length). Each view has a logistic classifier. In
each round a classifier labels the unlabelled documents that it is most sure of for the
other one, and both are fitted again. Finally both views are calibrated on labelled rows that
neither was trained on, and a logistic combination of the calibrated views scores all documents.

The classifiers learn from bounded, seeded samples (``labelled`` and ``unlabelled`` rows are
parameters); features are computed on the executors, so no text reaches the driver. Scoring is one
pass without a shuffle.

Defined cases: a null or empty text has the features of an empty one; unknown or null
metadata are a value of their own; without labels of both kinds every document is kept with
score 1; repeated rows get equal results; further columns are carried through, but for those with the name of an
added column, which are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.columns import carried, schema_of
from platewise.llm.logistic import Logistic, sigmoid
from platewise.llm.quality_rules import FEATURES, statistics
from platewise.llm.sampling import labelled_sample, unlabelled_sample
from platewise.llm.text_arrays import blocks, code_points, released

#: Classes of bytes: letters by case, digits, blanks, line ends, non-ASCII, signs in small groups.
_CLASS = np.full(256, 5, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 3, 4
for _i, _signs in enumerate((b".,", b"!?", b"#*", b"$%", b"&|", b"<>=/", b"'\"`", b"()[]{}", b"-_", b":;@^~+\\")):
    _CLASS[list(_signs)] = 6 + _i
CLASSES = 16
ADDED = ("ct_text_score", "ct_meta_score", "ct_score", "ct_kept")
META = 32
N_TEXT, N_META = len(FEATURES) + CLASSES * CLASSES, 2 * META + 2


def text_view(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    kinds = _CLASS[data]
    rows = np.repeat(np.arange(n), np.diff(offsets))
    pair = kinds[:-1] * CLASSES + kinds[1:]
    same = rows[:-1] == rows[1:]
    cells = np.bincount((rows[:-1] * (CLASSES * CLASSES) + pair)[same], minlength=n * CLASSES * CLASSES) if len(data) > 1 else np.zeros(n * CLASSES * CLASSES)
    histogram = cells.reshape(n, -1) / np.maximum(1, np.diff(offsets))[:, None]
    return np.hstack([statistics(data, offsets)[1], np.sqrt(histogram)])


def meta_view(lang: list, source: list, chars: np.ndarray) -> np.ndarray:
    out = np.zeros((len(lang), N_META))
    for base, values in ((0, lang), (META, source)):
        out[np.arange(len(values)), [base + zlib.crc32(repr(v).encode()) % META for v in values]] = 1
    out[:, -2], out[:, -1] = np.log1p(chars), np.minimum(chars, 2000) / 2000
    return out


class CoTrained:
    """The two fitted views, their calibrations, and the combination."""

    def __init__(self, rounds: int = 4, growth: int = 60, clean_loss: float = 0.002):
        self.rounds, self.growth, self.clean_loss = rounds, growth, clean_loss

    def fit(self, views: tuple[np.ndarray, np.ndarray], y: np.ndarray, free: tuple[np.ndarray, np.ndarray]) -> CoTrained:
        held = np.arange(len(y)) % 4 == 3
        known = [[v[~held]] for v in views]
        labels = [[y[~held].astype(float)] for _ in views]
        open_ = np.ones(len(free[0]), bool)
        share = float(np.clip(y.mean(), 0.05, 0.95))
        for turn in range(self.rounds + 1):
            self.models = [Logistic().fit(np.vstack(x), np.concatenate(z)) for x, z in zip(known, labels, strict=True)]
            if turn == self.rounds or not open_.any():
                break
            for own, other in ((0, 1), (1, 0)):
                at = np.flatnonzero(open_)
                p = sigmoid(self.models[own].logit(free[own][at]))
                order = np.argsort(p, kind="stable")
                low, high = order[: max(1, int(self.growth * (1 - share)))], order[::-1][: max(1, int(self.growth * share))]
                low, high = low[p[low] < 0.1], high[p[high] > 0.9]
                for part, value in ((low, 0.0), (high, 1.0)):
                    known[other].append(free[other][at[part]])
                    labels[other].append(np.full(len(part), value))
                    open_[at[part]] = False
        test = [v[held] for v in views]
        self.calibrations = [Logistic(steps=150).fit(m.logit(v)[:, None], y[held]) for m, v in zip(self.models, test, strict=True)]
        self.final = Logistic(penalty=1e-4).fit(self._calibrated(test), y[held])
        good = np.sort(self.score(views)[y == 1])
        self.threshold = min(0.5, float(good[int(self.clean_loss * len(good))])) if len(good) else 0.0
        return self

    def _calibrated(self, views) -> np.ndarray:
        return np.column_stack([c.logit(m.logit(v)[:, None]) for c, m, v in zip(self.calibrations, self.models, views, strict=True)])

    def view_scores(self, views) -> list[np.ndarray]:
        return [sigmoid(c) for c in self._calibrated(views).T]

    def score(self, views) -> np.ndarray:
        return sigmoid(self.final.logit(self._calibrated(views)))


def _prepare(docs: DataFrame, rest: list[str]) -> DataFrame:
    string = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("text").cast("string").alias("ct_text"), string("lang").alias("ct_lang"), string("source").alias("ct_source"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(rest)))


def _views(batch: pa.RecordBatch, a: int, b: int, data: np.ndarray, offsets: np.ndarray):
    lang, source = (batch.column(i).slice(a, b - a).to_pylist() for i in (1, 2))
    return text_view(data, offsets), meta_view(lang, source, code_points(data, offsets))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in blocks(batch.column(0)):
            own, meta = _views(batch, a, b, data, offsets)
            cols = [batch.column(3).slice(a, b - a), batch.column(4).slice(a, b - a)]
            cols += [pa.array([r.tobytes() for r in v.astype(np.float32)], pa.binary()) for v in (own, meta)]
            yield pa.RecordBatch.from_arrays(cols, ["c0", "c1", "own", "meta"])


def _collect(sample: DataFrame) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = _prepare(sample, ["doc_id", "sm_label"]).mapInArrow(released(_feature_batches), f"c0 {kind}, c1 int, own binary, meta binary").collect()
    rows.sort(key=lambda r: (str(r.c0), bytes(r.own), bytes(r.meta)))
    view = lambda name, n: np.array([np.frombuffer(bytes(r[name]), np.float32) for r in rows], np.float64).reshape(len(rows), n)
    return np.array([r.c1 if r.c1 is not None else -1 for r in rows]), (view("own", N_TEXT), view("meta", N_META))


def fit_quality(docs: DataFrame, labels: DataFrame, labelled: int = 3000, unlabelled: int = 2000) -> CoTrained | None:
    """The co-trained model, or None where the labels don't hold both kinds."""
    y, views = _collect(labelled_sample(docs, labels, "quality", labelled))
    if len(set(y.tolist())) < 2 or min((y == 0).sum(), (y == 1).sum()) < 4:
        return None
    _, free = _collect(unlabelled_sample(docs, labels, unlabelled).withColumn("sm_label", F.lit(None).cast("int")))
    order = np.argsort(np.random.default_rng(3).random(len(y)), kind="stable")
    return CoTrained().fit((views[0][order], views[1][order]), y[order], free)


def classify_quality(docs: DataFrame, labels: DataFrame, labelled: int = 3000, unlabelled: int = 2000) -> DataFrame:
    """All columns of ``docs``, then ct_text_score, ct_meta_score, ct_score (higher is better) and ct_kept."""
    inputs = docs.select(*(c for c in ("doc_id", "text", "lang", "source") if c in docs.columns))
    held = docs.sparkSession.sparkContext.broadcast(fit_quality(inputs, labels, labelled, unlabelled))
    columns = carried(docs, ADDED)
    fields = schema_of(docs, columns)
    names = [*(f"c{i}" for i in range(len(columns))), *ADDED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(0)):
                if model is None:
                    one, two, score, kept = (np.ones(b - a),) * 3 + (np.ones(b - a, bool),)
                else:
                    views = _views(batch, a, b, data, offsets)
                    one, two = model.view_scores(views)
                    score = model.score(views)
                    kept = score >= model.threshold
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[3:]), pa.array(one), pa.array(two), pa.array(score), pa.array(kept)], names)

    schema = ", ".join([*fields, "ct_text_score double", "ct_meta_score double", "ct_score double", "ct_kept boolean"])
    return _prepare(docs, columns).mapInArrow(released(run), schema).toDF(*columns, *ADDED)
