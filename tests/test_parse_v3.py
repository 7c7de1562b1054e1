"""Continuation lines and header noise of the layout parser, on pages worked out by hand."""

from __future__ import annotations

from platewise.operators import parse

LINE = "menu_id string, page_id string, line_order int, text string, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double"


def run(spark, rows):
    lines = spark.createDataFrame([("m", "p", i, t, x, y, x + 100.0, y + 12.0) for i, (t, x, y) in enumerate(rows)], LINE)
    found = parse.parse_pages(lines, "v3").orderBy("local_id").collect()
    return [(r.dish_name, r.description, r.section, r.price_value) for r in found]


def test_a_name_over_two_lines_is_one_dish(spark):
    rows = [("Slow Grilled Chicken Breast", 10.0, 200.0), ("with Rice", 10.0, 214.0), ("12.50", 10.0, 240.0), ("Apple Pie 6", 300.0, 300.0), ("with cream, nuts and honey", 300.0, 330.0)]
    # the last line begins with a bridge word, but is 18 below, and stays a description
    assert run(spark, rows) == [("Slow Grilled Chicken Breast with Rice", None, None, 12.5), ("Apple Pie", "with cream, nuts and honey", None, 6.0)]


def test_lines_of_the_other_column_are_not_merged(spark):
    assert [r[0] for r in run(spark, [("Grilled Chicken 9", 10.0, 200.0), ("of Autumn", 300.0, 200.0), ("6", 300.0, 240.0)])] == ["Grilled Chicken", "of Autumn"]


def test_header_noise_is_no_dish(spark):
    rows = [("Trattoria Bella", 10.0, 5.0), ("Menu", 10.0, 150.0), ("Desserts", 10.0, 180.0), ("Tomato Soup 120", 10.0, 210.0), ("Consuming raw fish is a risk to your own health", 10.0, 240.0), ("served in a bowl, hot", 10.0, 270.0)]
    assert run(spark, rows) == [("Tomato Soup", "served in a bowl, hot", "Desserts", 120.0)]
