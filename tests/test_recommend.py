from __future__ import annotations

import itertools
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from platewise.functions import lexicon as L
from platewise.operators import enrich, recommend
from platewise.operators.recommend import Request

SCHEMA = (
    "local_id string, dish_name string, description string, section string, price_value double, calories_low double, calories_mid double, nutrition_confidence double, "
    "parser_confidence double, explicit_allergens array<string>, diet_flags map<string,boolean>, ingredient_hints array<string>"
)


def dish(local_id, name, description=None, section=None, price=None, low=None, mid=None, nutrition=None, parser=None, allergens=(), flags=None, hints=()):
    return (local_id, name, description, section, price, low, mid, nutrition, parser, list(allergens), flags or {}, list(hints))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def ids(df):
    return sorted(r.local_id for r in df.collect())


def test_calorie_limit_minds_the_confidence(spark):
    rows = frame(spark, dish("unsure", "House Pasta", low=430.0, mid=560.0, nutrition=0.45), dish("sure", "Loaded Pasta", low=430.0, mid=560.0, nutrition=0.92), dish("above", "Big Pasta", low=510.0, mid=560.0, nutrition=0.1), dish("open", "Pasta"))
    got = {r.local_id: r for r in recommend.allowed(rows, Request(max_calories=500)).collect()}
    assert set(got) == {"unsure", "open"}
    assert "possible calorie fit" in got["unsure"].reasons and got["open"].calorie_status == "unknown"


def test_constraints_of_a_request(spark):
    rows = frame(
        spark,
        dish("egg", "Omelette", allergens=["EGG"]),
        dish("promo", "Soup", section="Promo"),
        dish("tofu", "Noodles", description="with TOFU"),
        dish("dear", "Steak", price=30.0, flags={"vegan": True, "vegetarian": True}),
        dish("free", "Salad", flags={"vegan": True, "vegetarian": True}),
        dish("half", "Salad", flags={"vegan": False, "vegetarian": True}),
    )
    asked = Request(excluded_allergens=("egg",), excluded_sections=("PROMO",), disliked_terms=("tofu",), max_price=20)
    assert ids(recommend.allowed(rows, asked)) == ["free", "half"]
    assert ids(recommend.allowed(rows, Request(required_diet_flags=("vegan", "vegetarian")))) == ["dear", "free"]


def tfidf(texts, query):
    def grams(t):
        w = re.findall(r"\b\w\w+\b", t.lower())
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    bags = [grams(t) for t in [*texts, query]]
    df = Counter(t for b in bags for t in b)
    rows = [{t: n * (math.log((1 + len(bags)) / (1 + df[t])) + 1) for t, n in b.items()} for b in bags]
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    q = rows[-1]
    return [sum(x * q.get(t, 0) for t, x in v.items()) / ((size(v) * size(q)) or 1) for v in rows[:-1]]


TEXTS = ["Spicy chicken rice", "chicken salad", "", "a b c", "plain noodles with egg", "rice rice rice pudding", "Crème brûlée with rice"]


def test_semantic_scores_equal_brute_force(spark):
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "local_id string, text string")
    query = "spicy rice salad unseen words"
    got = {r.local_id: r.semantic_score for r in recommend.tfidf_scores(rows, query).collect()}
    assert [got.get(str(i), 0.0) for i in range(len(TEXTS))] == pytest.approx(tfidf(TEXTS, query))
    assert recommend.tfidf_scores(rows, "").count() == 0


def test_ranking_and_combinations_equal_brute_force(spark):
    rows = [dish(f"d{i}", f"{TEXTS[i % 2]} {i}", "fresh" if i % 3 else None, ["Mains", "Soups", None][i % 3], None if i == 4 else 5.0 + i, 100.0, None if i == 5 else 200.0 + 10 * i, 0.1 * i, 0.5) for i in range(10)]
    asked = Request(craving_text="spicy rice", liked_terms=("chicken",), preferred_sections=("soups",), max_price=13, combo_budget=20, combo_max_calories=700, top_k=4)
    semantic = tfidf([" ".join(p for p in r[1:4] if p) for r in rows if r[4] is None or r[4] <= 13], asked.query_text())
    kept = [r for r in rows if r[4] is None or r[4] <= 13]
    want = []
    for r, s in zip(kept, semantic, strict=True):
        rule = (0.15 if (r[3] or "").lower() == "soups" else 0) + (0.05 if r[2] else 0) + 0.15 * r[8] + (0.10 if r[4] is not None else 0) + 0.10 * r[7] + 0.20
        want.append((round(0.6 * s + 0.4 * rule, 4), r))
    want.sort(key=lambda x: (-x[0], x[1][0]))
    got = recommend.recommend(frame(spark, *rows), asked).orderBy("rank").collect()
    assert [(g.local_id, g.score) for g in got] == [(r[0], pytest.approx(s, abs=1e-4)) for s, r in want[:4]]
    combos = []
    for size in (2, 3):
        for own in itertools.combinations(want[: recommend.POOL], size):
            prices, calories = [r[4] for _, r in own], [r[6] for _, r in own]
            if None in prices or None in calories or sum(prices) > 20 or sum(calories) > 700:
                continue
            score = sum(s for s, _ in own) / size + 0.12 + 0.10 + 0.05 * sum(r[7] for _, r in own) / size
            score += (0.06 if len({r[3] for _, r in own if r[3]}) >= 2 else 0) + (0.05 if 0.65 <= sum(prices) / 20 <= 1 else 0)
            combos.append((round(score, 4), [r[0] for _, r in own]))
    combos.sort(key=lambda x: -x[0])
    mixed = recommend.combinations(frame(spark, *rows), asked).orderBy("rank").collect()
    assert combos and [m.score for m in mixed] == pytest.approx([s for s, _ in combos[:4]], abs=1e-4)
    assert [m.item_ids for m in mixed][0] == combos[0][1]
    assert recommend.combinations(frame(spark, *rows), Request()).count() == 0
    assert recommend.recommend(frame(spark, *rows).limit(0), asked).count() == 0


def test_enrichment_is_conservative_and_follows_markers(spark):
    rows = frame(spark, dish("none", "Chef Special"), dish("vegan", "Vegan Tomato Soup", "Tomato, basil, and olive oil", "Soups"), dish("cake", "Surprise", None, "Desserts"), dish("meat", "Beef Burger", "with cheddar", "Mains", allergens=["Nuts"]))
    got = {r.local_id: r for r in enrich.enrich(rows, references={}).collect()}
    assert not any(got["none"].diet_flags.values()) and len(got["none"].diet_flags) == 4
    assert all(got["vegan"].diet_flags[f] for f in ("vegetarian", "vegan", "dairy_free"))
    assert (got["cake"].calories_low, got["cake"].calories_mid, got["cake"].calories_high) == (300.0, 480.0, 790.0)  # the section also names sugar
    assert got["meat"].explicit_allergens == ["milk", "nuts", "wheat"] and got["meat"].ingredient_hints == ["beef", "wheat", "milk"]
    assert got["none"].enrichment_notes[-1] == "description missing, estimate may be broad"


def test_references_draw_the_estimate(spark):
    rows = frame(spark, dish("weak", "Rice Bowl", parser=0.1), dish("strong", "Rice Bowl", "Rice with tomato and herbs", "Mains", parser=0.95))
    plain = {r.local_id: r for r in enrich.enrich(rows, references={}).collect()}
    known = {r.local_id: r for r in enrich.enrich(rows, versions=["seed:v1"]).collect()}
    assert known["strong"].nutrition_confidence > known["weak"].nutrition_confidence
    reference = sum(c * g / 100 for c, g in (L.NUTRITION["rice"], (L.NUTRITION["tomato"][0] * 0.82, L.NUTRITION["tomato"][1])))
    assert abs(known["strong"].calories_mid - reference) < abs(plain["strong"].calories_mid - reference)
    assert "nutrition source versions: seed:v1" in known["strong"].enrichment_notes


def test_similar_dishes(spark):
    rows = [dish("a", "Chicken Rice", price=5.0), dish("b", "chicken  rice", price=6.0), dish("c", "Soup", price=1.0), dish("d", "xY", price=1.0), dish("e", "McFish", price=1.0), dish("f", "One, two, three")]
    vectors = {"a": [1.0, 0.0], "b": [0.9, 0.1], "c": [0.1, 1.0], "d": [1.0, 0.0], "e": [1.0, 0.0], "f": [1.0, 0.0]}
    items = frame(spark, *rows).withColumn("embedding", F.element_at(F.create_map(*(x for k, v in vectors.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.col("local_id")))
    got = recommend.similar_dishes(items, [1.0, 0.0], "chicken rice", 3).orderBy("rank").collect()
    assert [(r.local_id, r.similarity) for r in got] == [("a", 1.0)]


def test_tfidf_never_broadcasts_its_counts(spark, tmp_path):
    # a small file may hold many rows: what is broadcast is the right side only, terms of the query and hot ones
    rows = [(i, f"hot soup number{i} with rice") for i in range(400)]
    spark.createDataFrame(rows, "local_id long, text string").write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    scores = recommend.tfidf_scores(texts, "hot rice number7")
    assert "BuildLeft" not in scores._jdf.queryExecution().executedPlan().toString()
    want = tfidf([t for _, t in rows], "hot rice number7")
    got = {r.local_id: r.semantic_score for r in scores.collect()}
    assert got == pytest.approx({i: s for i, s in enumerate(want) if s > 0})
