"""Enrichment of dishes as column expressions: ingredients, allergens, diet flags, calories, notes.

Every function takes columns or a DataFrame of dishes (dish_name, description, section, parser_confidence,
explicit_allergens array<string>) and adds columns; there is no join and no shuffle, so the whole enrichment is one
projection over the scan. The nutrition references are a small literal table (a parameter).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions import lexicon as L

NOTE_HEURISTIC = "heuristic nutrition estimate from dish title, section and description"
NOTE_REFERENCE = "nutrition reference lookup matched ingredient-level records in PostgreSQL"  # fixed value
#: Decimal ties round up, whatever the last bit of a sum is.
TIE = 1e-9
_CALORIES = "struct<low:double,mid:double,high:double>"


def field_text(value: Column) -> Column:
    """Lower-cased, with runs of white space as one space; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"\s+", " "))


def item_text(name: Column, description: Column, section: Column) -> Column:
    """The non-empty parts, each trimmed, joined by spaces."""
    parts = [F.when(F.coalesce(p, F.lit("")) != "", F.trim(p)) for p in (name, description, section)]
    return F.trim(F.concat_ws(" ", *parts))


def mentions(text: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def ingredient_evidence(name: Column, description: Column, section: Column) -> Column:
    """array<struct<rank, ingredient, strength>>, the strongest first, then by name; the place of a keyword gives its strength."""
    found = [
        F.struct(
            F.when(mentions(name, words), -1.0).when(mentions(description, words), -0.82).when(mentions(section, words), -0.58).otherwise(0.0).alias("rank"),
            F.lit(ingredient).alias("ingredient"),
        )
        for ingredient, words in L.INGREDIENT_KEYWORDS.items()
    ]
    kept = F.filter(F.array(*found), lambda x: x["rank"] < 0)
    return F.transform(F.array_sort(kept), lambda x: F.struct(x["ingredient"].alias("ingredient"), (-x["rank"]).alias("strength")))


def allergens(existing: Column, hints: Column) -> Column:
    """The existing allergens, lower-cased, with those of the ingredients, in order."""
    known = F.array(*(F.lit(a) for a in L.ALLERGENS))
    own = F.transform(F.coalesce(existing, F.array().cast("array<string>")), lambda a: F.lower(a))
    return F.array_sort(F.array_union(own, F.array_intersect(hints, known)))


def diet_flags(hints: Column, all_allergens: Column, text: Column) -> Column:
    """map<string, boolean> of the four flags; a flag needs a marker or some ingredient evidence, and no conflict."""
    any_hint = F.size(hints) > 0
    overlaps = lambda group: F.arrays_overlap(hints, F.array(*(F.lit(x) for x in group)))
    says = {flag: mentions(text, words) for flag, words in L.DIET_MARKERS.items()}
    milk, wheat = F.array_contains(all_allergens, "milk"), F.array_contains(all_allergens, "wheat")
    meatless = ~overlaps([*L.MEAT, *L.SEAFOOD])
    flags = {
        "vegetarian": meatless & (says["vegetarian"] | says["vegan"] | any_hint),
        "vegan": ~(overlaps(L.ANIMAL) | milk) & (says["vegan"] | any_hint),
        "gluten_free": ~(overlaps(L.GLUTEN) | wheat) & (says["gluten_free"] | (any_hint & ~mentions(text, L.GLUTEN_RISK))),
        "dairy_free": ~(milk | F.array_contains(hints, "milk")) & (says["dairy_free"] | (any_hint & ~mentions(text, L.DAIRY_RISK))),
    }
    return F.create_map(*(x for flag, value in flags.items() for x in (F.lit(flag), value)))


def _triple(values: tuple) -> Column:
    return F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("low", "mid", "high"), values, strict=True)))


def base_range(text: Column, section: Column) -> Column:
    """The calorie range of the first category whose keyword stands in the text; then by the section alone."""
    place = F.lower(F.coalesce(section, F.lit("")))
    out = F.when(F.lit(False), _triple(L.DEFAULT_RANGE))
    for words, values in L.CATEGORY_RULES:
        out = out.when(mentions(text, words), _triple(values))
    for words, values in L.SECTION_RANGES:
        out = out.when(mentions(place, words), _triple(values))
    return out.otherwise(_triple(L.DEFAULT_RANGE)).cast(_CALORIES)


def _gains(hints: Column, gain: Column) -> Column:
    return F.transform(hints, lambda h: F.coalesce(F.element_at(gain, h), F.lit(0.0)))


def heuristic_range(base: Column, hints: Column, text: Column) -> Column:
    """The base range with what ingredients and words add to it; monotone, 40 at least, rounded to one digit."""
    sums = []
    for i, n in enumerate(("low", "mid", "high")):
        gain = F.create_map(*(x for k, v in L.CALORIE_ADJUSTMENTS.items() for x in (F.lit(k), F.lit(float(v[i])))))
        total = base[n] + F.aggregate(_gains(hints, gain), F.lit(0.0), lambda s, x: s + x)
        for words, values in L.TEXT_MODIFIERS:
            total = total + F.when(mentions(text, words), float(values[i])).otherwise(0.0)
        sums.append(total)
    low = F.greatest(F.lit(40.0), sums[0])
    mid = F.greatest(low, sums[1])
    return F.struct(F.round(low, 1).alias("low"), F.round(mid + TIE, 1).alias("mid"), F.round(F.greatest(mid, sums[2]), 1).alias("high"))


def filled(value: Column) -> Column:
    return (F.coalesce(value, F.lit("")) != "").cast("double")


def heuristic_confidence(hints: Column, description: Column, section: Column) -> Column:
    return F.least(F.lit(0.95), 0.45 + F.least(F.lit(0.25), 0.05 * F.size(hints)) + 0.15 * filled(description) + 0.10 * filled(section))


def reference_estimate(evidence: Column, references: dict[str, tuple[float, float]]) -> Column:
    """struct<matched, weight, low, mid, high, bonus> from kcal in 100 g and grams in a serving; null without a match."""
    kcal = F.create_map(*(x for k, (c, g) in references.items() for x in (F.lit(k), F.lit(c * g / 100.0)))) if references else F.create_map().cast("map<string,double>")
    known = F.filter(evidence, lambda e: F.element_at(kcal, e["ingredient"]).isNotNull())
    weights = F.transform(known, lambda e: F.greatest(F.lit(0.35), F.least(F.lit(1.0), e["strength"])))
    add = lambda column: F.aggregate(column, F.lit(0.0), lambda s, x: s + x)
    mid = add(F.transform(known, lambda e: F.element_at(kcal, e["ingredient"]) * F.greatest(F.lit(0.35), F.least(F.lit(1.0), e["strength"]))))
    out = F.struct(
        F.array_sort(F.transform(known, lambda e: e["ingredient"])).alias("matched"),
        F.round(add(weights) / F.size(known), 3).alias("weight"),
        F.round(F.greatest(F.lit(40.0), mid * 0.8) + TIE, 1).alias("low"),
        F.round(mid + TIE, 1).alias("mid"),
        F.round(mid * 1.25 + TIE, 1).alias("high"),
        F.least(F.lit(0.2), 0.05 * F.size(known)).alias("bonus"),
    )
    return F.when((F.size(known) > 0) & (mid > 0), out)


def _sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def enrich(items: DataFrame, references: dict[str, tuple[float, float]] | None = None, versions: Iterable[str] = ()) -> DataFrame:
    """Add ingredient_hints, explicit_allergens, diet_flags, calories_low, calories_mid, calories_high, nutrition_confidence and enrichment_notes.

    references: ingredient -> (kcal in 100 g, grams in a serving); the built-in table by default, an empty
    one for heuristics only. versions: what the notes name as the references' sources.
    """
    references = L.NUTRITION if references is None else references
    name, description, section = (F.col(c).cast("string") for c in ("dish_name", "description", "section"))
    # each step is a projection of its own, so that Spark evaluates the long keyword tests once
    step = items.withColumns({"en_name": field_text(name), "en_description": field_text(description), "en_section": field_text(section), "en_text": F.lower(item_text(name, description, section))})
    step = step.withColumn("en_evidence", ingredient_evidence(F.col("en_name"), F.col("en_description"), F.col("en_section")))
    step = step.withColumn("ingredient_hints", F.transform("en_evidence", lambda e: e["ingredient"]))
    step = step.withColumn("explicit_allergens", allergens(F.col("explicit_allergens"), F.col("ingredient_hints")))
    hints, text = F.col("ingredient_hints"), F.col("en_text")
    confidence = F.coalesce(F.col("parser_confidence").cast("double"), F.lit(0.0))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(confidence == 0, 0.5).otherwise(confidence)))
    step = step.withColumns({
        "diet_flags": diet_flags(hints, F.col("explicit_allergens"), text),
        "en_base": base_range(text, section),
        "en_reference": reference_estimate(F.col("en_evidence"), references),
        "en_floor": heuristic_confidence(hints, description, section),
        "en_parser": confidence,
    })
    step = step.withColumn("en_heuristic", heuristic_range(F.col("en_base"), hints, text))
    reference = F.col("en_reference")
    matched, weight = F.coalesce(F.size(reference["matched"]), F.lit(0)), F.coalesce(reference["weight"], F.lit(0.0))
    matched = F.when(reference.isNull(), 0).otherwise(matched)
    context = 0.22 * filled(description) + 0.18 * filled(section)
    blend = F.round(F.greatest(F.lit(0.2), F.least(F.lit(0.92), _sigmoid(-1.15 + 0.52 * matched + 0.85 * weight + context + 0.35 * F.col("en_parser")))), 3)
    calibrated = _sigmoid(-0.7 + 0.14 * F.size("en_evidence") + 0.48 * matched + 0.75 * weight + context + 0.55 * F.col("en_parser"))
    floor = F.when(reference.isNull(), F.col("en_floor")).otherwise(F.least(F.lit(0.98), F.col("en_floor") + reference["bonus"]))
    step = step.withColumns({"en_blend": F.when(reference.isNull(), 0.0).otherwise(blend), "nutrition_confidence": F.round(F.least(F.lit(0.98), F.greatest(floor, calibrated)), 3)})
    share = F.col("en_blend")
    calories = {f"calories_{n}": F.when(reference.isNull(), F.col("en_heuristic")[n]).otherwise(F.round((1.0 - share) * F.col("en_heuristic")[n] + share * reference[n] + TIE, 1)) for n in ("low", "mid", "high")}
    named = ", ".join(sorted(versions))
    notes = [
        F.lit(NOTE_HEURISTIC),
        F.when(reference.isNotNull(), NOTE_REFERENCE),
        F.when(reference.isNotNull(), F.concat(F.lit("reference-backed estimate used matched ingredients: "), F.array_join(reference["matched"], ", "))),
        F.when(reference.isNotNull() & F.lit(bool(named)), F.lit(f"nutrition source versions: {named}")),
        F.when(reference.isNotNull(), F.concat(F.lit("reference blend weight: "), share.cast("string"))),
        F.when(F.size(hints) > 0, "ingredient hints detected from menu text").otherwise("no strong ingredient hints detected, dietary flags remain conservative"),
        F.when(filled(description) == 0, "description missing, estimate may be broad"),
    ]
    step = step.withColumns({**calories, "enrichment_notes": F.array_compact(F.array(*notes))})
    return step.drop("en_name", "en_description", "en_section", "en_text", "en_evidence", "en_base", "en_reference", "en_floor", "en_parser", "en_heuristic", "en_blend")
