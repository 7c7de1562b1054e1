"""The cascade, held against scores and keep rules that are worked out by hand."""

from __future__ import annotations

from platewise.operators import parse

LINE = "menu_id string, page_id string, line_order int, text string, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double"


def run(spark, texts, named, boxed=True):
    box = lambda i: (10.0, 20.0 * i, 200.0, 20.0 * i + 12) if boxed else (None,) * 4
    lines = spark.createDataFrame([("m", "p", i, t, *box(i)) for i, t in enumerate(texts)], LINE)
    roles = spark.createDataFrame([("m", "p", i, t, "item_name" if t in named else "description", 0.9) for i, t in enumerate(texts)], "menu_id string, page_id string, line_order int, text string, label string, score double")
    return {r.dish_name: r.parser_confidence for r in parse.cascade(lines, roles).collect()}


def test_price_on_the_name_line_is_no_mismatch(spark):
    texts = ["STARTERS", "Tomato Soup 120", "Garlic Toast 90"]
    # 11 of 15 letters: 0.733 + 0.2; the other name is unlike all candidates
    assert run(spark, texts, {"Tomato Soup 120"}) == {"Tomato Soup": 0.933}


def test_dice_and_the_three_thresholds(spark):
    # Dice 2/5 with a price is kept; 2/7 = 0.286 in a section is kept as a short name only
    assert run(spark, ["Tomato Soup 120", "Tomato Rice Bowl"], {"Tomato Rice Bowl"}).keys() == {"Tomato Soup", "Tomato Rice Bowl"}
    assert run(spark, ["STARTERS", "Tomato Soup", "Tomato Rice Bowl And Bread"], {"Tomato Rice Bowl And Bread"}).keys() == {"Tomato Soup"}


def test_noise_names_and_pages_left_empty(spark):
    assert run(spark, ["Service 10", "Tomato Soup 120"], {"Service 10", "Tomato Soup 120"}).keys() == {"Tomato Soup"}
    texts = ["Tomato Soup 120", "Garlic Toast 90"]
    assert run(spark, texts, set()) == run(spark, texts, {"Tomato Soup 120"}, boxed=False) == {"Tomato Soup": 0.7, "Garlic Toast": 0.7}
