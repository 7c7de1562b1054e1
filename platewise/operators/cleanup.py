"""Repair and removal of parsed dishes.

Column expressions over items (dish_name, description, section, price_value, price_text); only the roles of lines cost a
join, by page and text. Null, blank and no-break white space are handled as by :func:`plain`: they never make a field.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Section names that are no dish, compared after everything but letters became a space.
GENERIC_SECTIONS = [
    "appetizer", "appetizers", "beverage", "beverages", "breakfast", "dessert", "desserts", "dinner", "drink", "drinks", "lunch",
    "main course", "main courses", "menu", "pasta", "pizza", "salad", "salads", "small plates", "soup", "soups", "special", "specials", "starter", "starters",
]
# Fixed value: the form of a section line.
SECTION_FORM = r"^[A-Za-z][A-Za-z&/' +.-]{2,}$"


def plain(text: Column) -> Column:
    """Runs of white space (no-break spaces too) as one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\u00A0]+", " "))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def word_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def section_like(text: Column) -> Column:
    """Up to six words of the section form, mostly in capitals or each with its first letter a capital; text is plain."""
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    titled = ~text.rlike("(?<![A-Za-z])[a-z]") & ~text.rlike("[A-Za-z][A-Z]")
    return text.rlike(SECTION_FORM) & (word_count(text) <= 6) & ((capitals >= 0.55 * letters) | titled)


def names_a_dish(section: Column) -> Column:
    """A section that is too specific to be one."""
    words = F.trim(F.regexp_replace(F.lower(section), "[^a-z]+", " "))
    return section_like(section) & ~words.isin(*GENERIC_SECTIONS)


def has_price(items: DataFrame) -> Column:
    value = F.col("price_value").isNotNull() if "price_value" in items.columns else F.lit(False)
    return value | (plain(F.col("price_text")) != "") if "price_text" in items.columns else value


def repair_misaligned(items: DataFrame) -> DataFrame:
    """Where a list of ingredients became the name, the section is the dish: they change places and the list leads the description."""
    name, description, section = (plain(F.col(c)) for c in ("dish_name", "description", "section"))
    wrong = (section != "") & ~has_price(items) & F.contains(name, F.lit(",")) & (word_count(name) >= 4) & names_a_dish(section)
    merged = F.trim(F.concat_ws(" ", name, F.when(description != "", description)))
    return items.withColumns({
        "dish_name": F.when(wrong, section).otherwise(F.col("dish_name")), "description": F.when(wrong, merged).otherwise(F.col("description")),
        "section": F.when(wrong, F.lit(None).cast("string")).otherwise(F.col("section")),
    })


def removal(items: DataFrame, role: Column) -> Column:
    """Why an item is no dish, or null: the first rule that holds. ``role`` is the label that the line of its name has, or null."""
    name, description, section = (plain(F.col(c)) for c in ("dish_name", "description", "section"))
    bare, label = ~has_price(items) & (description == ""), F.lower(F.coalesce(role, F.lit("")))
    words, listed = word_count(name), F.contains(name, F.lit(","))
    return (
        F.when(name == "", "no name")
        .when(bare & (section != "") & (F.lower(name) == F.lower(section)), "names its section")
        .when(bare & (label == "section"), "section line")
        .when(bare & (label == "description") & (listed | (words >= 5)), "description line")
        .when(bare & listed & (words >= 4), "list of ingredients")
        .when(bare & section_like(name) & (section == ""), "heading")
        .when(bare & (words >= 10), "long line")
    )


def best_roles(roles: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, role_text, role): the label of each text with the best score; of equal scores the last line counts, no score is 0."""
    text = F.lower(plain(F.col("text")))
    order = F.struct(F.coalesce("score", F.lit(0.0)), F.col("line_order"))
    return roles.where(text != "").groupBy(*keys, text.alias("role_text")).agg(F.max_by("label", order).alias("role"))


def judge_items(items: DataFrame, roles: DataFrame | None = None, keys: tuple[str, ...] = ("menu_id", "page_id")) -> DataFrame:
    """Repaired items with ``removal`` (null: stays). roles: keys, line_order, text, label, score; their texts meet items of the same keys only."""
    fixed = repair_misaligned(items)
    if roles is None:
        return fixed.withColumn("removal", removal(fixed, F.lit(None).cast("string")))
    known = best_roles(roles, keys)
    named = fixed.withColumn("role_text", F.lower(plain(F.col("dish_name"))))
    joined = named.join(known, [*keys, "role_text"], "left")
    return joined.withColumn("removal", removal(joined, F.col("role"))).drop("role", "role_text")


def clean_items(items: DataFrame, roles: DataFrame | None = None, keys: tuple[str, ...] = ("menu_id", "page_id")) -> DataFrame:
    """What a parser's items are after repair and removal."""
    judged = judge_items(items, roles, keys)
    # a filter would be pushed below the repair and spelled out there with all that it reads, too large to compile
    stays = F.explode(F.when(F.col("removal").isNull(), F.array(F.lit(True))))
    return judged.withColumn("removal", stays).drop("removal")
