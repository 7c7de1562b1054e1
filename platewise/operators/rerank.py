"""The reranker: eleven features of a scored dish, a model of trees over them, and the blend of its score with the dish's own.

The features are one projection over the scored dishes. TF-IDF of a dish and the query alone needs no corpus: a term of
both texts has idf 1, any other ln(1.5) + 1.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.operators.cleanup import bound, plain
from platewise.operators.recommend import Request, dish_text, match_label, query_terms
from platewise.operators.retrieval import with_pairs

FEATURES = [
    "semantic_score", "tfidf_score", "rule_score", "jaccard", "query_coverage", "item_coverage", "section_match", "liked_ingredients", "has_description", "has_price", "name_overlap",
]
# Fixed value: a token of the lexical features.
TOKEN = "[A-Za-z][A-Za-z'-]+"


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(plain(text), F.lit(TOKEN), F.lit(0)), F.lower))


def _words(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def _asked(text: str) -> list[str]:
    return sorted({t.lower() for t in re.findall(TOKEN, text)})


def pair_tfidf(text: Column, query: str) -> Column:
    """The cosine of the TF-IDF rows of a text and the query, fitted on those two."""
    asked = query_terms(query)
    if not asked:
        return F.lit(0.0)
    rare = math.log(1.5) + 1
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    return bound(words, lambda w: bound(with_pairs(w), lambda terms: _cosine(terms, asked, rare * rare)))


def _cosine(terms: Column, asked: Counter, rare: float) -> Column:
    """``rare`` is the squared idf of a term that only one of the two texts has."""
    occurs = lambda t: F.size(F.filter(terms, lambda x: x == t))
    known = _words(sorted(asked))
    dot, query_length = F.lit(0.0), F.lit(0.0)
    for term, n in asked.items():
        count = occurs(F.lit(term))
        dot = dot + count * float(n)
        query_length = query_length + F.when(count > 0, 1.0).otherwise(rare) * float(n * n)
    own = F.transform(F.array_distinct(terms), lambda t: F.pow(occurs(t), 2) * F.when(F.array_contains(known, t), 1.0).otherwise(rare))
    item_length = F.aggregate(own, F.lit(0.0), lambda s, v: s + v)
    return F.when(item_length > 0, dot / F.sqrt(item_length) / F.sqrt(query_length)).otherwise(0.0)


def rerank_features(rows: DataFrame, request: Request) -> DataFrame:
    """``rows`` of :func:`platewise.operators.recommend.scored` with the columns of ``FEATURES``; ingredient_hints may be missing."""
    query = request.query_text()
    asked = _asked(query)
    mine, name = _tokens(dish_text()), _tokens(F.col("dish_name"))
    hints = _tokens(F.array_join("ingredient_hints", " ")) if "ingredient_hints" in rows.columns else _words([])
    overlap = F.size(F.array_intersect(mine, _words(asked)))
    union = F.size(F.array_union(mine, _words(asked)))
    sections = sorted({" ".join(s.split()).lower() for s in request.preferred_sections})
    return rows.withColumns({
        "tfidf_score": pair_tfidf(dish_text(), query), "jaccard": overlap / F.greatest(union, F.lit(1)), "query_coverage": overlap / F.lit(max(1, len(asked))),
        "item_coverage": overlap / F.greatest(F.size(mine), F.lit(1)),
        "section_match": F.lower(plain(F.col("section"))).isin(*sections).cast("double") if sections else F.lit(0.0),
        "liked_ingredients": F.size(F.array_intersect(hints, _words(_asked(" ".join(request.liked_terms))))).cast("double"),
        "has_description": (plain(F.col("description")) != "").cast("double"), "has_price": F.col("price_value").isNotNull().cast("double"),
        "name_overlap": F.size(F.array_intersect(name, _words(asked))).cast("double"),
    })


def train_reranker(rows: DataFrame, label: str, trees: int = 20, depth: int = 4, seed: int = 7) -> PipelineModel:
    """A gradient-boosted model of ``label`` over the features; its ``prediction`` is the raw score."""
    model = GBTRegressor(featuresCol="rerank_vector", labelCol=label, maxIter=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="rerank_vector"), model]).fit(rows)


def rerank(rows: DataFrame, raw: str, reason: str = "learned reranker") -> DataFrame:
    """Rows with score 0.65 * score + 0.35 * the raw score between its least and greatest value (0.5 where all are equal), label and reason; no rows stay no rows."""
    ends = rows.agg(F.min(raw).alias("raw_low"), F.max(raw).alias("raw_high"))
    place = F.when(F.col("raw_high") > F.col("raw_low"), (F.col(raw) - F.col("raw_low")) / (F.col("raw_high") - F.col("raw_low"))).otherwise(0.5)
    blended = rows.crossJoin(F.broadcast(ends)).withColumn("blended", 0.65 * F.col("score") + 0.35 * place)
    out = blended.withColumns({"score": F.round("blended", 4), "match_label": match_label(F.col("blended")), "reasons": F.array_append("reasons", F.lit(reason))})
    return out.drop("raw_low", "raw_high", "blended")
