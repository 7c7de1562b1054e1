"""The whole enrichment of dishes by its operator; the SQL twin is a text of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.catalog import query
from platewise.functions import lexicon as L
from platewise.functions.dialect import DUCK
from platewise.operators import enrich
from platewise.plans.base import any_of, evidence, statement
from platewise.plans.menu import FULL, dishes

_listed = lambda words: ", ".join(f"'{w}'" for w in words)
_overlaps = lambda words: f"list_has_any(hints, [{_listed(words)}])"
_mod = lambda i: " + ".join(f"case when {any_of('txt', list(words))} then {values[i]} else 0 end" for words, values in L.TEXT_MODIFIERS)


def _base(i: int) -> str:
    rules = " ".join(f"when {any_of('txt', list(words))} then {values[i]}" for words, values in L.CATEGORY_RULES)
    sections = " ".join(f"when {any_of('place', list(words))} then {values[i]}" for words, values in L.SECTION_RANGES)
    return f"case {rules} {sections} else {L.DEFAULT_RANGE[i]} end + ({_mod(i)})"


_GAINS = ", ".join(f"('{k}', {a}, {b}, {c})" for k, (a, b, c) in L.CALORIE_ADJUSTMENTS.items())
_FOOD = ", ".join(f"('{k}', {c}::double, {g}::double)" for k, (c, g) in L.NUTRITION.items())
_BLENDED = lambda n: f"case when matched is null then round({n}, 1) else round((1.0::double - blend) * round({n}, 1) + blend * ref_{n} + 1e-9, 1) end"

ORACLE = statement(DUCK, lambda d: f"""with e as ({evidence(d)}), g as (select * from (values {_GAINS}) as g(ingredient, ga, gb, gc)), food as (select * from (values {_FOOD}) as n(ingredient, kcal, serving)),
s as (
  select id, list(ingredient order by strength desc, ingredient) as hints, sum(coalesce(ga, 0)) as ga, sum(coalesce(gb, 0)) as gb, sum(coalesce(gc, 0)) as gc from e left join g using (ingredient) group by id
), r as (
  select id, list(ingredient order by ingredient) as matched, round(sum(greatest(0.35, least(1.0, strength))) / count(*), 3) as weight, sum(kcal * serving / 100 * greatest(0.35, least(1.0, strength))) as food, least(0.2, 0.05 * count(*)) as bonus
  from e join food using (ingredient) group by id having sum(kcal * serving) > 0
), t as (
  select i.id, description, section, allergen, {FULL} as txt, lower(coalesce(section, '')) as place, coalesce(hints, []) as hints, coalesce(ga, 0) as ga, coalesce(gb, 0) as gb, coalesce(gc, 0) as gc, matched, weight, food, bonus,
    case when coalesce(description, '') <> '' then 1.0::double else 0 end as described, case when coalesce(section, '') <> '' then 1.0::double else 0 end as placed, case when coalesce(conf, 0) = 0 then 0.5 else conf end as conf
  from items i left join s on i.id = s.id left join r on i.id = r.id
), a as (
  select *, list_sort(list_distinct(list_concat(list_filter([lower(allergen)], lambda x: x <> ''), list_filter(hints, lambda h: h in ({_listed(L.ALLERGENS)}))))) as allergens,
    greatest(40, {_base(0)} + ga) as low0, {_base(1)} + gb as mid0, {_base(2)} + gc as high0, {', '.join(f"{any_of('txt', words)} as says_{k}" for k, words in L.DIET_MARKERS.items())} from t
), b as (
  select *, low0 as low, greatest(low0, mid0) as mid, greatest(low0, mid0, high0) as high, len(hints) > 0 as anyhint, list_contains(allergens, 'milk') as milk, list_contains(allergens, 'wheat') as wheat,
    round(greatest(40.0, food * 0.8) + 1e-9, 1) as ref_low, round(food + 1e-9, 1) as ref_mid, round(food * 1.25 + 1e-9, 1) as ref_high,
    round(greatest(0.2, least(0.92, 1 / (1 + exp(-(-1.15 + 0.52 * len(matched) + 0.85 * weight + 0.22 * described + 0.18 * placed + 0.35 * conf))))), 3) as blend,
    least(0.95, 0.45 + least(0.25, 0.05 * len(hints)) + 0.15 * described + 0.10 * placed) as floor0,
    1 / (1 + exp(-(-0.7 + 0.14 * len(hints) + 0.48 * coalesce(len(matched), 0) + 0.75 * coalesce(weight, 0) + 0.22 * described + 0.18 * placed + 0.55 * conf))) as calibrated from a
)
select id, array_to_string(hints, ',') as hints, array_to_string(allergens, ',') as allergens,
  not {_overlaps([*L.MEAT, *L.SEAFOOD])} and (says_vegetarian or says_vegan or anyhint) as vegetarian, not ({_overlaps(L.ANIMAL)} or milk) and (says_vegan or anyhint) as vegan,
  not ({_overlaps(L.GLUTEN)} or wheat) and (says_gluten_free or (anyhint and not {any_of('txt', L.GLUTEN_RISK)})) as gluten_free, not milk and (says_dairy_free or (anyhint and not {any_of('txt', L.DAIRY_RISK)})) as dairy_free,
  {', '.join(f"{_BLENDED(n)} as calories_{n}" for n in ('low', 'mid', 'high'))}, round(least(0.98, greatest(case when matched is null then floor0 else least(0.98, floor0 + bonus) end, calibrated)), 3) as confidence,
  concat_ws('|', '{enrich.NOTE_HEURISTIC}', case when matched is not null then '{enrich.NOTE_REFERENCE}' end, case when matched is not null then 'reference-backed estimate used matched ingredients: ' || array_to_string(matched, ', ') end,
    case when matched is not null then 'nutrition source versions: seed 1' end, case when matched is not null then 'reference blend weight: ' || blend end,
    case when anyhint then 'ingredient hints detected from menu text' else 'no strong ingredient hints detected, dietary flags remain conservative' end, case when described = 0 then 'description missing, estimate may be broad' end) as notes from b""")  # fmt: skip


@query("enrich_dishes", ORACLE)
def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingredients, united allergens, diet flags, blended calories, confidence and notes of every dish."""
    items = dishes(spark, sf_dir).drop("calories_mid", "calories_low", "diet_flags").withColumn("explicit_allergens", F.filter(F.array("allergen"), lambda a: a != ""))
    out = enrich.enrich(items, versions=["seed 1"])
    flags = [F.col("diet_flags")[f].alias(f) for f in ("vegetarian", "vegan", "gluten_free", "dairy_free")]
    join = lambda c, by: F.array_join(c, by).alias({"ingredient_hints": "hints", "explicit_allergens": "allergens", "enrichment_notes": "notes"}[c])
    return out.select(
        F.col("local_id").alias("id"), join("ingredient_hints", ","), join("explicit_allergens", ","), *flags, "calories_low", "calories_mid", "calories_high", F.col("nutrition_confidence").alias("confidence"), join("enrichment_notes", "|")
    )
