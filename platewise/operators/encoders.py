"""Semantic scores by a chain of encoders: the first that is available scores, why others weren't is recorded.

``DenseEncoder`` runs any batch encoder of texts (given as a loader) inside Arrow batches; ``TfidfEncoder`` and ``BagOfWords`` are Spark jobs.
An engine asked for by name must be available, ``auto`` falls through the chain; without a query there is nothing to encode and the engine is ``none``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.operators.recommend import Request, combinations_of, dish_text, ranked_scores, scored_by, tfidf_scores, top
from platewise.operators.rerank import rerank, rerank_features


class Encoder(Protocol):
    name: str

    def probe(self) -> None:
        """Raises where the encoder can't run."""

    def scores(self, texts: DataFrame, query: str) -> DataFrame:
        """(local_id, semantic_score) of (local_id, text); texts that are missing from the result score 0."""


@dataclass
class DenseEncoder:
    """Cosine of vectors that ``load()`` computes: a function from texts to a matrix. ``load`` runs once in each task; it must be picklable."""

    load: Callable[[], Callable[[list[str]], np.ndarray]]
    name: str = "sentence_transformer"

    def probe(self) -> None:
        self.load()(["probe"])

    def scores(self, texts: DataFrame, query: str) -> DataFrame:
        load = self.load
        asked = np.asarray(load()([query]), float)[0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode = load()
            for batch in batches:
                if batch.num_rows:
                    m = np.asarray(encode([t or "" for t in batch.column("text").to_pylist()]), float)
                    norm = np.linalg.norm(m, axis=1) * np.linalg.norm(asked)
                    yield pa.RecordBatch.from_arrays([batch.column("local_id"), pa.array(np.where(norm > 0, m @ asked / np.where(norm > 0, norm, 1.0), 0.0))], ["local_id", "semantic_score"])

        return texts.select("local_id", "text").mapInArrow(run, f"local_id {texts.schema['local_id'].dataType.simpleString()}, semantic_score double")


@dataclass
class TfidfEncoder:
    """Cosine of TF-IDF rows of words and pairs, fitted on the texts and the query."""

    name: str = "tfidf"

    def probe(self) -> None:
        pass

    def scores(self, texts: DataFrame, query: str) -> DataFrame:
        return tfidf_scores(texts, query)


@dataclass
class BagOfWords:
    """Cosine of counts of the words between white space."""

    name: str = "bag_of_words"

    def probe(self) -> None:
        pass

    def scores(self, texts: DataFrame, query: str) -> DataFrame:
        asked = Counter(query.lower().split())
        if not asked:
            return texts.select("local_id", F.lit(0.0).alias("semantic_score")).limit(0)
        words = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), "")
        # only texts that share a word have a score; a word's number is what its removal takes away
        own = texts.select("local_id", words.alias("words")).where(F.arrays_overlap("words", F.array(*map(F.lit, sorted(asked)))))
        dot = F.lit(0.0)
        for word, n in sorted(asked.items()):
            dot = dot + (F.size("words") - F.size(F.array_remove("words", word))) * float(n)
        # over sorted words, a word that is the n-th of its kind adds n^2 - (n - 1)^2
        run = lambda s, w: F.when(s["word"] == w, s["run"] + 1).otherwise(1)
        start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).cast("long").alias("square"))
        square = F.aggregate(F.array_sort("words"), start, lambda s, w: F.struct(w.alias("word"), run(s, w).alias("run"), (s["square"] + 2 * run(s, w) - 1).alias("square")), lambda s: s["square"])
        norm = F.sqrt(square.cast("double")) * float(sum(n * n for n in asked.values()) ** 0.5)
        return own.select("local_id", (dot / norm).alias("semantic_score"))


@dataclass
class Choice:
    """Which encoder scored, and why those before it did not."""

    used: str
    skipped: list[tuple[str, str]] = field(default_factory=list)


def choose(chain: Sequence[Encoder], engine: str, query: str) -> tuple[Encoder | None, Choice]:
    """The encoder of ``engine`` (a name, or ``auto`` for the first that is available)."""
    if not query:
        return None, Choice("none")
    if engine != "auto":
        named = [e for e in chain if e.name == engine]
        if not named:
            raise ValueError(f"unknown engine {engine}")
        try:
            named[0].probe()
        except Exception as why:
            raise RuntimeError(f"the engine {engine} is not available: {why}") from why
        return named[0], Choice(engine)
    skipped: list[tuple[str, str]] = []
    for encoder in chain:
        try:
            encoder.probe()
        except Exception as why:  # whatever stops one encoder, the next is tried and the reason kept
            skipped.append((encoder.name, f"{type(why).__name__}: {why}"))
            continue
        return encoder, Choice(encoder.name, skipped)
    raise RuntimeError(f"no engine is available: {skipped}")


def semantic_scores(texts: DataFrame, query: str, chain: Sequence[Encoder], engine: str = "auto") -> tuple[DataFrame, Choice]:
    encoder, choice = choose(chain, engine, query)
    if encoder is None:
        return texts.select("local_id", F.lit(0.0).alias("semantic_score")).limit(0), choice
    return encoder.scores(texts, query), choice


DEFAULT_CHAIN: tuple[Encoder, ...] = (TfidfEncoder(), BagOfWords())


@dataclass
class Recommendation:
    """Ranked dishes, combinations over the same scores, and how they came about."""

    engine: str
    choice: Choice
    rows: DataFrame
    combinations: DataFrame


def recommend_all(items: DataFrame, request: Request, chain: Sequence[Encoder] = DEFAULT_CHAIN, engine: str = "auto", reranker=None) -> Recommendation:
    """Filter, score by the chosen engine, rank, rerank if a fitted model is given and there is a query, then combine the best by the final scores.

    ``reranker`` is a fitted model over the columns of ``rerank_features`` whose ``prediction`` is a raw score.
    """
    query = request.query_text()
    encoder, choice = choose(chain, engine, query)
    scored = scored_by(items, request, (lambda texts: encoder.scores(texts, query)) if encoder else None)
    used = choice.used
    if reranker is not None and query:
        scored = rerank(reranker.transform(rerank_features(scored, request)), "prediction").drop("match_label")
        scored, used = scored.withColumn("raw", F.col("score")), "reranker"
    return Recommendation(used, choice, ranked_scores(top(scored, request.top_k)), combinations_of(scored, request))


def dish_texts(items: DataFrame) -> DataFrame:
    return items.select("local_id", dish_text().alias("text"))
