"""Matching, the six kinds of errors and the metrics of a parser, on pages worked out by hand."""

from __future__ import annotations

from platewise.operators import evaluation

DISH = "page string, position int, dish_name string, section string, price_value string, description string"


def test_errors_and_metrics(spark):
    gold = spark.createDataFrame([
        ("p", 0, "Soup", "Starters", "5", "hot"), ("p", 1, "soup ", "Mains", "6,00", None), ("p", 2, "Pie", None, None, None), ("p", 3, None, "x", "1", None), ("q", 0, "Soup", None, "7", "cold"),
    ], DISH)
    predicted = spark.createDataFrame([
        ("p", 0, " SOUP", "starters", "5.001", "HOT"), ("p", 1, "soup", "Sides", "6.5", "more"), ("p", 2, "Soup", None, "9", None), ("p", 3, "", None, None, None), ("q", 0, "Soup", "x", "no", "warm"),
    ], DISH)
    matched = evaluation.match_items(predicted, gold, ["page"])
    errors = sorted((r.page, r.error_type, r.pred_name or "", r.gold_name or "") for r in evaluation.parser_errors(matched, ["page"]).collect())
    assert errors == [
        ("p", "empty_pred_name", "", ""), ("p", "false_positive_item", "Soup", ""), ("p", "missed_gold_item", "", "Pie"), ("p", "wrong_price", "soup", "soup "), ("p", "wrong_section", "soup", "soup "),
        ("q", "wrong_description", "Soup", "Soup"), ("q", "wrong_price", "Soup", "Soup"),
    ]
    m = evaluation.parser_metrics(matched).first()
    assert (m.item_tp, m.item_fp, m.item_fn) == (3, 2, 1) and (m.item_precision, m.item_recall, m.item_f1) == (0.6, 0.75, 0.6667)
    assert (m.section_accuracy, m.price_accuracy, m.description_exact_match, m.price_mae) == (0.5, 0.3333, 0.5, 0.25)


def test_no_dishes(spark):
    none = spark.createDataFrame([], DISH)
    m = evaluation.parser_metrics(evaluation.match_items(none, none, ["page"])).first()
    assert (m.item_tp, m.item_f1, m.section_accuracy, m.price_mae) == (0, 0.0, None, None)
