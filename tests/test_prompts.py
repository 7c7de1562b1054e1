"""Prompts are JSON that holds the items again; answers are aligned, cleaned and replaced by the rules, worked out by hand."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from platewise.operators import prompts

ITEM = (
    "menu string, position int, local_id string, dish_name string, section string, description string, ingredient_hints array<string>, explicit_allergens array<string>, "
    "diet_flags map<string,boolean>, calories_mid double, nutrition_confidence double"
)
ANSWER = "menu string, position int, usable boolean, local_id string, id string, summary string, llm_summary string"


def items(spark, *ids, menu="m"):
    return spark.createDataFrame([(menu, i, x, f"Dish {x}", "Soups", None, ["leek"], [], {"vegan": True}, 300.0, None) for i, x in enumerate(ids)], ITEM)


def aligned(spark, ids, answers):
    rows = spark.createDataFrame([("m", i, *a) for i, a in enumerate(answers)], ANSWER)
    out = prompts.align_answers(items(spark, *ids), rows, "menu").collect()
    return {r.local_id: (r.aligned_by, r.answer.summary if r.answer else None) for r in out}


def test_ids_count_alone_where_there_are_as_many(spark):
    got = aligned(spark, ["a", "b"], [(True, " b ", None, "for b", None), (True, None, "a", "for a", None), (True, None, None, "no id", None)])
    assert got == {"a": ("id", "for a"), "b": ("id", "for b")}
    # two ids, one of no item: still as many, so nothing goes by position
    assert aligned(spark, ["a", "b"], [(True, "a", None, "for a", None), (True, "x", None, "for x", None)]) == {"a": ("id", "for a"), "b": (None, None)}


def test_position_where_ids_are_missing(spark):
    rows = [(True, None, None, "first", None), (True, "b", None, "for b", None), (False, None, None, "not an object", None)]
    assert aligned(spark, ["a", "b", "c"], rows) == {"a": ("position", "first"), "b": ("id", "for b"), "c": (None, None)}
    assert aligned(spark, ["a", "b", "c"], [*rows, (True, None, None, "surplus", None)]) == {"a": (None, None), "b": ("id", "for b"), "c": (None, None)}
    assert aligned(spark, ["a"], []) == {"a": (None, None)}


def test_the_last_row_of_an_id_counts(spark):
    assert aligned(spark, ["a", "b"], [(True, "a", None, "old", None), (True, "a", None, "new", None)])["a"] == ("id", "new")


def test_texts(spark):
    answers = spark.createDataFrame([("m", 0, True, "a", None, "second", "  The user context: no nuts. Warm ,  green soup - "), ("m", 1, True, "b", None, "  ", None)], ANSWER)
    out = {r.local_id: r for r in prompts.enriched_texts(items(spark, "a", "b", "c"), answers, "menu", "no nuts").collect()}
    assert out["a"].llm_summary == "The Warm, green soup"  # the shorter lead is taken out first
    assert out["b"].llm_summary == "Dish b from the soups section with likely ingredients such as leek; 300 kcal estimate."
    assert out["b"].llm_why_it_fits == "Parsed menu signals suggest vegan. Its calorie estimate sits on the lighter side."
    assert out["c"].llm_caution_note == "Description is missing, so some details may be uncertain."
    odd = "a.*b (c) \\E end"
    got = spark.createDataFrame([(f"x user context: {odd}. y {odd} z",)], "t string").select(prompts.cleaned_text(F.col("t"), odd)).first()[0]
    assert got == "x y z"


def test_prompts_hold_the_first_items_and_their_evidence(spark):
    rows = items(spark, "b", "a", "c").unionByName(items(spark, "d", menu="n"))
    evidence = spark.createDataFrame([("a", "gold", str(i), 'say "é"', i / 10, None) for i in range(5)], "local_id string, source_type string, source_id string, title string, similarity double, content_preview string")
    out = {r.menu: r for r in prompts.page_prompts(prompts.prompt_items(rows, evidence, 2), "menu", 2, " wish ").collect()}
    body = json.loads(out["m"].prompt)
    assert out["m"].n_items == 2 and body["user_context"] == "wish"
    assert [i["local_id"] for i in body["items"]] == ["a", "b"] and list(body["items"][0]) == [*prompts.ITEM_FIELDS, "retrieved_evidence"]
    assert [e["source_id"] for e in body["items"][0]["retrieved_evidence"]] == ["4", "3"] and body["items"][0]["retrieved_evidence"][0]["title"] == 'say "é"'
    assert body["items"][1]["retrieved_evidence"] == [] and body["items"][1]["calories_low"] is None
    assert body["output_format"] == {"items": [prompts.OUTPUT_FORMAT]}
    assert json.loads(out["n"].prompt)["items"][0]["local_id"] == "d"


def test_schema():
    schema = prompts.menu_schema()
    dish = schema["properties"]["sections"]["items"]["properties"]["items"]["items"]
    assert dish["required"] == list(prompts.PARSED_DISH) and not dish["additionalProperties"]
    assert dish["properties"]["price_value"] == {"type": ["number", "null"]} and dish["properties"]["dish_name"] == {"type": "string"}
