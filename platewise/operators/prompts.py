"""Prompts about dishes and what comes back: nested items with evidence, alignment of answers, cleaned and fallback texts.

A prompt takes the first ``limit`` dishes of its page and at most ``evidence_limit`` rows of evidence a dish, so what is collected is bounded by
these parameters and not by the page. Answers meet dishes by id; by position only where they can't be told apart otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.operators.cleanup import plain

# The fields of a prompt's item and of its evidence, in order, and the names under which an answer may carry a field.
ITEM_FIELDS = [
    "local_id", "dish_name", "section", "description", "ingredient_hints", "explicit_allergens", "diet_flags", "calories_low", "calories_mid", "calories_high", "nutrition_confidence", "parser_confidence",
]
EVIDENCE_FIELDS = ["source_type", "source_id", "title", "similarity", "content_preview"]
ID_ALIASES = ("local_id", "item_local_id", "id")
SUMMARY_ALIASES = ("llm_summary", "summary", "short_summary")
FIT_ALIASES = ("llm_why_it_fits", "why_it_fits", "fit_reason")
CAUTION_ALIASES = ("llm_caution_note", "caution_note", "caution")
# The form of an answer, and the fields of the schema for parsed pages with their types.
OUTPUT_FORMAT = {"local_id": "same as input", "llm_summary": "short grounded summary", "llm_why_it_fits": "short grounded fit explanation", "llm_caution_note": "short grounded caution note"}
PARSED_DISH = {"dish_name": "string", "description": "string?", "price_value": "number?", "price_currency": "string?", "explicit_allergens": "strings"}


def prompt_items(items: DataFrame, evidence: DataFrame, evidence_limit: int = 6) -> DataFrame:
    """The items with ``prompt_item``: JSON of ``ITEM_FIELDS`` and retrieved_evidence, the most similar rows first; nulls are written.

    evidence: local_id, ``EVIDENCE_FIELDS``; ties of similarity by source_id. Fields that the items lack are null.
    """
    order = Window.partitionBy("local_id").orderBy(F.desc_nulls_last("similarity"), "source_id")
    few = evidence.withColumn("pr_place", F.row_number().over(order)).where(F.col("pr_place") <= evidence_limit)
    listed = few.groupBy("local_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pr_place", *EVIDENCE_FIELDS))), lambda e: F.struct(*(e[f].alias(f) for f in EVIDENCE_FIELDS))).alias("retrieved_evidence"))
    none = F.array().cast(listed.schema["retrieved_evidence"].dataType)
    fields = [F.col(f) if f in items.columns else F.lit(None).cast("string").alias(f) for f in ITEM_FIELDS]
    body = F.struct(*fields, F.coalesce("retrieved_evidence", none).alias("retrieved_evidence"))
    return items.join(listed, "local_id", "left").withColumn("prompt_item", F.to_json(body, {"ignoreNullFields": "false"})).drop("retrieved_evidence")


def page_prompts(items: DataFrame, page: str, limit: int = 8, user_context: str | None = None) -> DataFrame:
    """(page, n_items, prompt): one prompt a page over its first ``limit`` items by local_id. items: page, local_id, prompt_item."""
    first = items.withColumn("pr_place", F.row_number().over(Window.partitionBy(page).orderBy("local_id"))).where(F.col("pr_place") <= max(1, limit))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pr_place", "prompt_item"))), lambda x: x["prompt_item"]), ",")
    context = F.to_json(F.struct(F.lit((user_context or "").strip() or None).cast("string").alias("user_context")), {"ignoreNullFields": "false"})
    form = F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in OUTPUT_FORMAT.items())))
    prompt = F.concat(F.regexp_replace(context, r"\}$", ""), F.lit(',"items":['), listed, F.lit('],"output_format":{"items":['), form, F.lit("]}}"))
    return first.groupBy(page).agg(F.count("*").alias("n_items"), prompt.alias("prompt"))


def _typed(kind: str) -> dict:
    if kind == "strings":
        return {"type": "array", "items": {"type": "string"}}
    return {"type": [kind[:-1], "null"]} if kind.endswith("?") else {"type": kind}


def _closed(properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}


def menu_schema() -> dict:
    """The JSON schema that a parsed page must have: sections of dishes; all fields are required, no others allowed."""
    dish = _closed({k: _typed(v) for k, v in PARSED_DISH.items()})
    section = _closed({"section_name": _typed("string?"), "items": {"type": "array", "items": dish}})
    return _closed({"language": _typed("string?"), "currency": _typed("string?"), "sections": {"type": "array", "items": section}})


def first_field(row: str, names: tuple[str, ...], known: list[str]) -> Column:
    """The first of the names whose value isn't blank, trimmed; names that the row lacks are passed over."""
    options = [F.nullif(F.trim(F.col(f"{row}.{n}").cast("string")), F.lit("")) for n in names if n in known]
    return F.coalesce(*options) if options else F.lit(None).cast("string")


def align_answers(items: DataFrame, answers: DataFrame, page: str) -> DataFrame:
    """Items (page, position, local_id, ...) with ``answer`` (the row that is theirs, or null) and ``aligned_by``: id, position or null.

    answers: page, position and fields, among them one of ``ID_ALIASES``; a row whose ``usable`` is false counts, but can't be an answer. Of rows with one id the last counts. Where a
    page has as many different ids as items, only ids count; else, where it has as many rows as items, an item whose id is missing takes the row at its position.
    Positions begin alike in both tables and are unique in a page.
    """
    fields = [c for c in answers.columns if c not in (page, "position", "usable")]
    usable = F.coalesce(F.col("usable"), F.lit(False)) if "usable" in answers.columns else F.lit(True)
    rows = answers.select(F.col(page).alias("al_page"), F.col("position").alias("al_position"), usable.alias("al_usable"), F.struct(*fields).alias("answer"))
    rows = rows.withColumn("al_id", F.when(F.col("al_usable"), first_field("answer", ID_ALIASES, fields)))
    counted = rows.groupBy("al_page").agg(F.count("*").alias("al_rows"), F.count_distinct("al_id").alias("al_ids"))
    sizes = items.groupBy(F.col(page).alias("al_page")).agg(F.count("*").alias("al_items")).join(counted, "al_page", "left")
    by_position = (F.coalesce("al_ids", F.lit(0)) != F.col("al_items")) & (F.col("al_rows") == F.col("al_items"))
    pages = sizes.select("al_page", F.coalesce(by_position, F.lit(False)).alias("al_by_position"))
    by_id = rows.where("al_id is not null").groupBy("al_page", "al_id").agg(F.max_by("answer", "al_position").alias("al_named"))
    placed = rows.where("al_usable").select("al_page", "al_position", F.col("answer").alias("al_placed"))
    out = items.withColumns({"al_page": F.col(page), "al_id": F.col("local_id").cast("string"), "al_position": F.col("position")})
    out = out.join(by_id, ["al_page", "al_id"], "left").join(pages, "al_page", "left").join(placed, ["al_page", "al_position"], "left")
    second = F.when(F.col("al_by_position"), F.col("al_placed"))
    kind = F.when(F.col("al_named").isNotNull(), "id").when(second.isNotNull(), "position")
    return out.withColumns({"answer": F.coalesce("al_named", second), "aligned_by": kind}).drop("al_page", "al_id", "al_position", "al_named", "al_by_position", "al_placed")


def cleaned_text(text: Column, user_context: str | None) -> Column:
    """A text without echoes of the context, with single spaces, none before punctuation and no punctuation at its ends; null where nothing is left."""
    out = plain(text)
    context = (user_context or "").strip()
    if context:
        exact = "\\Q" + context.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        for lead in (r"\band the user context:\s*", r"\buser context:\s*", r"\bthe user context:\s*"):
            out = F.regexp_replace(out, f"(?i){lead}{exact}\\.?", "")
        out = F.replace(out, F.lit(context), F.lit(""))
    out = F.regexp_replace(F.regexp_replace(out, r"\s{2,}", " "), r"\s+([,.;:])", "$1")
    return F.nullif(F.btrim(out, F.lit(" -:;,.")), F.lit(""))


# Words of a guest's wish, and what they ask for.
GOALS = [
    (("vegetarian", "vegan", "plant-based", "plant based"), "plant-based preferences"), (("gluten", "gluten-free", "gf"), "gluten-aware filtering"),
    (("dairy", "lactose", "milk-free", "milk free"), "dairy-aware filtering"), (("allergy", "allergen", "safe", "avoid"), "allergen-aware filtering"),
    (("light", "lighter", "low calorie", "not too heavy", "healthy"), "lighter meal preferences"), (("protein", "high-protein", "high protein", "gym", "post-workout"), "protein-focused choices"),
]


def goals(user_context: str | None) -> list[str]:
    low = (user_context or "").strip().lower()
    return [goal for words, goal in GOALS if any(w in low for w in words)]


def _some(names: Column, most: int) -> Column:
    return F.array_join(F.slice(names, 1, most), ", ")


# The sentences of the three functions below are fixed values.
def fallback_summary(has_evidence: Column) -> Column:
    section = F.lower(F.coalesce(F.nullif(F.col("section"), F.lit("")), F.lit("menu")))
    calories = F.when(F.col("calories_mid").isNotNull(), F.concat(F.col("calories_mid").cast("bigint").cast("string"), F.lit(" kcal estimate"))).otherwise("broad calorie estimate")
    head = F.concat("dish_name", F.lit(" from the "), section, F.lit(" section"))
    hints = F.size("ingredient_hints") > 0
    return (
        F.when(hints, F.concat(head, F.lit(" with likely ingredients such as "), _some(F.col("ingredient_hints"), 3), F.lit("; "), calories, F.lit(".")))
        .when(has_evidence, F.concat(head, F.lit(", grounded with similar annotated menu examples; "), calories, F.lit(".")))
        .otherwise(F.concat(head, F.lit(" with "), calories, F.lit(".")))
    )


def fallback_why(user_context: str | None) -> Column:
    flags = F.transform(F.map_keys(F.map_filter("diet_flags", lambda _, v: F.coalesce(v, F.lit(False)))), lambda k: F.replace(k, F.lit("_"), F.lit(" ")))
    asked = goals(user_context)
    goal = F.lit(f"It aligns with {', '.join(asked[:2])}.") if asked else F.when(F.size("ingredient_hints") > 0, F.concat(F.lit("It highlights likely ingredients such as "), _some(F.col("ingredient_hints"), 2), F.lit(".")))
    notes = F.array_compact(F.array(
        F.when(F.size(flags) > 0, F.concat(F.lit("Parsed menu signals suggest "), _some(flags, 3), F.lit("."))),
        F.when(F.col("calories_mid") <= 450, "Its calorie estimate sits on the lighter side.").when(F.col("calories_mid") <= 650, "Its calorie estimate stays in a moderate range."),
        goal,
    ))
    return F.when(F.size(notes) > 0, F.array_join(F.slice(notes, 1, 2), " ")).otherwise("It is included because the parsed menu text produced a usable structured dish entry.")


def fallback_caution() -> Column:
    notes = F.array_compact(F.array(
        F.when(F.size("explicit_allergens") > 0, F.concat(F.lit("Possible allergens: "), _some(F.col("explicit_allergens"), 4), F.lit("."))),
        F.when(F.col("nutrition_confidence") < 0.75, "Nutrition estimate is heuristic and may be broad."),
        F.when(F.coalesce("description", F.lit("")) == "", "Description is missing, so some details may be uncertain."),
    ))
    return F.when(F.size(notes) > 0, F.array_join(notes, " ")).otherwise("Use the menu text or staff confirmation for exact ingredients and allergen handling.")


def enriched_texts(items: DataFrame, answers: DataFrame, page: str, user_context: str | None = None, has_evidence: Column | None = None) -> DataFrame:
    """Items with aligned_by, llm_summary, llm_why_it_fits and llm_caution_note: what the answers say once cleaned, else texts from the item itself."""
    fields = [c for c in answers.columns if c not in (page, "position", "usable")]
    rows = align_answers(items, answers, page)
    said = lambda names: cleaned_text(first_field("answer", names, fields), user_context)
    evidence = F.lit(False) if has_evidence is None else has_evidence
    return rows.withColumns({
        "llm_summary": F.coalesce(said(SUMMARY_ALIASES), fallback_summary(evidence)), "llm_why_it_fits": F.coalesce(said(FIT_ALIASES), fallback_why(user_context)), "llm_caution_note": F.coalesce(said(CAUTION_ALIASES), fallback_caution()),
    }).drop("answer")


