"""Input columns, choice of the parser, and the rows that repair and removal leave."""

from __future__ import annotations

import pytest

from platewise.operators import menus

ROLE = "menu_id string, page_id string, line_order int, text string, label string, score double"
LINES = ["STARTERS", "Tomato Soup 120", "Served with warm bread", "Garlic Toast 90"]


def bare(spark, texts, column="text"):
    return spark.createDataFrame(list(enumerate(texts, 1)), f"line_order int, {column} string")


def dishes(rows):
    return sorted((r.dish_name, r.section, r.price_value) for r in rows.collect())


def test_bare_lines_become_one_page(spark):
    want = [("Garlic Toast", "STARTERS", 90.0), ("Tomato Soup", "STARTERS", 120.0)]
    for parser in ("v2", "v3", "cascade", "no such parser", None):
        assert dishes(menus.parse_menu(bare(spark, LINES, "line_text"), parser)) == want


def test_fallbacks(spark):
    assert [menus.parser_for(n, None) for n in ("v1", "cascade", "x", None)] == ["v1", "v2", "v3", "v3"]
    assert menus.parser_for("cascade", bare(spark, [])) == "cascade"


def test_removal_by_roles(spark):
    texts = ["STARTERS", "Tomato Soup 120", "Tomato Rice Bowl"]
    assert [d[0] for d in dishes(menus.parse_menu(bare(spark, texts), "v2"))] == ["Tomato Rice Bowl", "Tomato Soup"]
    roles = spark.createDataFrame([("", "", 3, "Tomato Rice Bowl", "section", 0.9), ("", "", 2, "Tomato Soup", "section", 0.9)], ROLE)
    assert [d[0] for d in dishes(menus.parse_menu(bare(spark, texts), "v2", roles))] == ["Tomato Soup"]


def test_null_texts_no_lines_and_missing_columns(spark):
    assert menus.parse_menu(bare(spark, [None, "", " "])).count() == 0
    assert menus.parse_menu(bare(spark, [])).count() == 0
    with pytest.raises(ValueError):
        menus.parse_menu(spark.createDataFrame([("Soup",)], "text string"))
