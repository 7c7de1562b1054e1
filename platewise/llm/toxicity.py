"""Toxicity: a convolutional text classifier in numpy.

Words (letters and digits, lower-cased) are hashed to embeddings. Filters of widths 1, 2 and 3
slide over the whole text; each filter's maximum over all positions feeds a logistic output.
Only the position of a maximum gets a gradient, so a step costs little beyond the forward
pass. For scoring, embeddings times filter columns are tables, and a convolution is a sum of
table rows. One coordinate of the embedding starts at the log-odds of its bucket in the training
rows; all weights are then trained with Adam.

The score is calibrated on held-back training rows so that 0.5 is the threshold that serves
best; for each language a further threshold is calibrated on the same rows (``tx_threshold``, ``tx_flagged``). Language
never enters the score.

The sample is bounded (parameter) and seeded; labelled texts of more than ``LONGEST`` words are not learned from. Scoring is one pass without a shuffle.

Defined cases: a text without words has the score that an empty text has; without
labels of both kinds all scores are 0; a language without enough rows uses 0.5; repeated rows get
equal results; further columns are carried through, but for those with the name of an added column, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.columns import carried, schema_of
from platewise.llm.logistic import Logistic, sigmoid
from platewise.llm.sampling import labelled_sample
from platewise.llm.text_arrays import LOWER, blocks, row_starts, word_hashes

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 8, (1, 2, 3), 6
ADDED = ("tx_score", "tx_threshold", "tx_flagged")
#: Words of the longest labelled text that is learned from; every text is scored whole.
LONGEST = 200_000
#: Rows that a bucket is taken to have seen at the overall rate.
SMOOTH = 3
_LETTERS = LOWER.copy()
_LETTERS[[b for b in range(33, 128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)]] = 32


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, rows = word_hashes(_LETTERS[data], offsets)
    return (hashes % np.uint64(BUCKETS)).astype(np.int32), rows


class ConvClassifier:
    """Embeddings, filters of several widths, max pooling and a logistic output."""

    def __init__(self, seed: int = 13, epochs: int = 10, batch: int = 256, rate: float = 0.02):
        self.seed, self.epochs, self.batch, self.rate = seed, epochs, batch, rate
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out, self.shift = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), np.float32(0)
        self.scale = (1.0, 0.0)

    def tables(self) -> list[list[np.ndarray]]:
        return [[np.ascontiguousarray(self.embed @ f[k]) for k in range(len(f))] for f in self.filters]

    def pooled(self, ids: np.ndarray, starts: np.ndarray, tables, argmax: bool = False):
        """(rows x filters) maxima; a row with fewer words than a width pools zeros for it."""
        n = len(starts) - 1
        top = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        where = np.full(top.shape, -1, np.int64)
        for i, width in enumerate(WIDTHS):
            full = np.flatnonzero(np.diff(starts) >= width)
            if not len(full):
                continue
            m = len(ids) - width + 1
            value = tables[i][0][ids[:m]].copy()
            for k in range(1, width):
                value += tables[i][k][ids[k : k + m]]
            # windows that run into the next row start after end - width
            over = np.concatenate([starts[1:-1] - k for k in range(1, width)]) if width > 1 else np.zeros(0, np.int64)
            value[over[(over >= 0) & (over < m)]] = -np.inf
            at = slice(i * FILTERS, (i + 1) * FILTERS)
            top[full, at] = np.maximum.reduceat(value, starts[:-1][full], axis=0)
            if argmax:
                for j, r in enumerate(full):
                    a, b = starts[r], min(starts[r + 1], m)
                    where[r, at] = a + np.argmax(value[a:b], axis=0)
        return (top, where) if argmax else top

    def logit(self, ids: np.ndarray, starts: np.ndarray, tables=None) -> np.ndarray:
        top = self.pooled(ids, starts, tables or self.tables())
        return np.maximum(top + self.bias, 0) @ self.out + self.shift

    def fit(self, docs: list[np.ndarray], y: np.ndarray) -> ConvClassifier:
        rng = np.random.default_rng(self.seed)
        found = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
        for ids, label in zip(docs, y, strict=True):
            found[int(label)][np.unique(ids)] += 1
        share = (y == 1).mean()
        self.embed[:, 0] = np.log((found[1] + SMOOTH) / ((found[0] + found[1]) * share + SMOOTH))
        for f in self.filters:
            f[:, 0, :] = np.abs(f[:, 0, :]) + 0.3
        self.out = np.abs(self.out)
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        state = {k: [0.0, 0.0] for k in ("f0", "f1", "f2", "bias", "out", "shift", "embed")}
        step = 0
        for _ in range(self.epochs):
            order = rng.permutation(len(docs))
            for lo in range(0, len(docs), self.batch):
                pick = order[lo : lo + self.batch]
                ids = np.concatenate([docs[i] for i in pick]) if len(pick) else np.zeros(0, np.int32)
                starts = np.concatenate([[0], np.cumsum([len(docs[i]) for i in pick])])
                top, where = self.pooled(ids, starts, self.tables(), argmax=True)
                act = top + self.bias
                hidden = np.maximum(act, 0)
                error = (sigmoid(hidden @ self.out + self.shift) - y[pick]) * weight[pick] / len(pick)
                back = np.where((act > 0) & (where >= 0), error[:, None] * self.out, 0).astype(np.float32)
                grads = {"bias": back.sum(axis=0), "out": hidden.T @ error + 1e-4 * self.out, "shift": error.sum()}
                wide = np.zeros_like(self.embed)
                for i, width in enumerate(WIDTHS):
                    at = slice(i * FILTERS, (i + 1) * FILTERS)
                    g, pos = back[:, at], where[:, at]
                    own = np.zeros_like(self.filters[i])
                    ok = pos >= 0
                    for k in range(width):
                        word = ids[np.where(ok, pos + k, 0)] if len(ids) else np.zeros(pos.shape, np.int32)
                        for j in range(FILTERS):
                            own[k, :, j] = (self.embed[word[:, j]] * g[:, j : j + 1]).sum(axis=0)
                            np.add.at(wide, word[:, j], g[:, j : j + 1] * self.filters[i][k, :, j])
                    grads[f"f{i}"] = own + 1e-4 * self.filters[i]
                grads["embed"] = wide
                step += 1
                for name, g in grads.items():
                    m, v = state[name]
                    m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                    state[name] = [m, v]
                    move = (self.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
                    if name[0] == "f":
                        self.filters[int(name[1])] -= move
                    elif name == "embed":
                        self.embed -= move * (np.abs(g) > 0)
                    else:
                        setattr(self, name, getattr(self, name) - move)
        return self


def _best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best F1; in the middle of the gap between two scores."""
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + max(1, y.sum()))
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(np.argmax(f1))
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else s[k] - 1)) / 2)


class Calibrated:
    """A fitted network, the map from its logit to the score, and thresholds by language."""

    def __init__(self, net: ConvClassifier | None, cut: float = 0.0, slope: float = 1.0, by_lang: dict | None = None):
        self.net, self.cut, self.slope, self.by_lang = net, cut, slope, by_lang or {}

    def score(self, ids: np.ndarray, starts: np.ndarray, tables) -> np.ndarray:
        return sigmoid(self.slope * (self.net.logit(ids, starts, tables) - self.cut))


def _id_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in blocks(batch.column(0)):
            ids, rows = word_buckets(data, offsets)
            starts = row_starts(rows, b - a)
            held = pa.array([ids[starts[k] : starts[k + 1]].astype(np.int32).tobytes() for k in range(b - a)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[1:]), held], ["doc_id", "lang", "label", "ids"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 12000, only: Column | None = None) -> Calibrated:
    """Train on at most ``sample`` labelled rows; a fifth of them calibrates."""
    drawn = labelled_sample(docs, labels, "toxic", sample, only=only)
    kind = docs.schema["doc_id"].dataType.simpleString()
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = drawn.select("text", "doc_id", lang, "sm_label").mapInArrow(_id_batches, f"doc_id {kind}, lang string, label int, ids binary").where(F.octet_length("ids") <= 4 * LONGEST).collect()
    rows.sort(key=lambda r: (str(r.doc_id), bytes(r.ids)))
    y = np.array([r.label for r in rows])
    if len(rows) < 10 or len(set(y.tolist())) < 2:
        return Calibrated(None)
    ids = [np.frombuffer(bytes(r.ids), np.int32) for r in rows]
    held = np.random.default_rng(17).random(len(rows)) < 0.2
    net = ConvClassifier().fit([i for i, h in zip(ids, held, strict=True) if not h], y[~held])
    own = np.flatnonzero(held)
    if len(set(y[own].tolist())) < 2:
        own = np.arange(len(y))
    starts = np.concatenate([[0], np.cumsum([len(ids[i]) for i in own])])
    logit = net.logit(np.concatenate([ids[i] for i in own]), starts)
    cut = _best_threshold(logit, y[own])
    slope = float(np.clip(Logistic(steps=150).fit((logit - cut)[:, None], y[own]).w[0] / max(1e-6, logit.std()), 0.2, 5))
    model = Calibrated(net, cut, slope)
    score = sigmoid(slope * (logit - cut))
    langs = np.array([str(rows[i].lang) for i in own])
    for name in sorted(set(langs.tolist())):
        at = langs == name
        model.by_lang[name] = _best_threshold(score[at], y[own][at]) if y[own][at].sum() >= 5 else 0.5
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 12000, only: Column | None = None) -> DataFrame:
    """All columns of ``docs`` but the text, then tx_score, tx_threshold (of the language) and tx_flagged."""
    inputs = docs.select(*(c for c in ("doc_id", "text", "lang") if c in docs.columns))
    held = docs.sparkSession.sparkContext.broadcast(fit_toxicity(inputs, labels, sample, only))
    rest = carried(docs, ADDED, "text")
    fields = schema_of(docs, rest)
    names = [*(f"c{i}" for i in range(len(rest))), *ADDED]
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        tables = model.net.tables() if model.net else None
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(0)):
                if model.net is None:
                    score = np.zeros(b - a)
                else:
                    ids, rows = word_buckets(data, offsets)
                    score = model.score(ids, row_starts(rows, b - a), tables).astype(np.float64)
                limit = np.array([model.by_lang.get(str(x), 0.5) for x in batch.column(1).slice(a, b - a).to_pylist()], np.float64)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[2:]), pa.array(score), pa.array(limit), pa.array(score >= limit)], names)

    schema = ", ".join([*fields, "tx_score double", "tx_threshold double", "tx_flagged boolean"])
    plain = docs.select(F.col("text").alias("tx_text"), lang.alias("tx_lang"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(rest)))
    return plain.mapInArrow(run, schema).toDF(*rest, *ADDED)
