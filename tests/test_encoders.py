"""The encoder chain: availability, fallback with reasons, engines by name, and recommendations over its scores."""

from __future__ import annotations

import numpy as np
import pytest

from platewise.operators import encoders
from platewise.operators.recommend import Request
from test_recommend import dish, frame


def broken():
    raise OSError("no such model")


CHAIN = (encoders.DenseEncoder(broken), encoders.TfidfEncoder(), encoders.BagOfWords())


def texts(spark):
    return spark.createDataFrame([(1, "spicy chicken rice"), (2, "Chicken chicken soup"), (3, None), (4, "")], "local_id long, text string")


def test_the_first_available_encoder_scores_and_reasons_stay(spark):
    scores, choice = encoders.semantic_scores(texts(spark), "chicken rice", CHAIN)
    assert choice.used == "tfidf" and choice.skipped == [("sentence_transformer", "OSError: no such model")]
    assert {r.local_id for r in scores.collect()} == {1, 2}
    got, choice = encoders.semantic_scores(texts(spark), "chicken rice", (CHAIN[0], CHAIN[2]))
    assert choice.used == "bag_of_words"
    assert {r.local_id: round(r.semantic_score, 6) for r in got.collect()} == {1: round(2 / 6**0.5, 6), 2: round(2 / 10**0.5, 6)}


def test_dense_vectors_score_by_cosine(spark):
    def letters():
        return lambda texts: np.array([[t.lower().count("a"), t.lower().count("e")] for t in texts], float)

    scores, choice = encoders.semantic_scores(texts(spark), "a e", (encoders.DenseEncoder(letters), *CHAIN[1:]))
    assert choice == encoders.Choice("sentence_transformer")
    got = {r.local_id: r.semantic_score for r in scores.collect()}
    assert got[2] == pytest.approx(2 / (2**0.5 * 4**0.5)) and got[3] == got[4] == 0.0


def test_engines_by_name(spark):
    assert encoders.choose(CHAIN, "bag_of_words", "x")[1].used == "bag_of_words"
    assert encoders.choose(CHAIN, "auto", "")[1].used == "none"
    with pytest.raises(RuntimeError, match="no such model"):
        encoders.choose(CHAIN, "sentence_transformer", "x")
    with pytest.raises(ValueError):
        encoders.choose(CHAIN, "no such engine", "x")
    with pytest.raises(RuntimeError):
        encoders.choose(CHAIN[:1], "auto", "x")


class ByPrice:
    def transform(self, rows):
        return rows.withColumn("prediction", rows["price_value"])


def test_combinations_use_the_reranked_scores(spark):
    items = frame(spark, dish("a", "Chicken Rice", price=5.0), dish("b", "Chicken Soup", price=20.0), dish("c", "Chicken Pie", price=12.0))
    request = Request(craving_text="chicken", combo_budget=50, combo_max_items=2, top_k=3)
    plain, again = (encoders.recommend_all(items, request, CHAIN, reranker=m) for m in (None, ByPrice()))
    assert (plain.engine, again.engine) == ("tfidf", "reranker")
    assert next(r.local_id for r in again.rows.orderBy("rank").collect()) == "b"
    best = again.combinations.orderBy("rank").first()
    assert set(best.item_ids) == {"b", "c"}
    assert encoders.recommend_all(items.limit(0), request, CHAIN).rows.count() == 0


def test_bag_of_words_counts_repeats_and_skips_texts_without_a_word_of_the_query(spark):
    rows = spark.createDataFrame([(1, "rice Rice beans  rice"), (2, "soup"), (3, " "), (4, "a rice a")], "local_id long, text string")
    got = encoders.BagOfWords().scores(rows, "rice rice tea")
    assert "filter(" not in got._jdf.queryExecution().optimizedPlan().toString().replace("Filter (", "")
    assert {r.local_id: r.semantic_score for r in got.collect()} == pytest.approx({1: 6 / (10**0.5 * 5**0.5), 4: 2 / (5**0.5 * 5**0.5)})
