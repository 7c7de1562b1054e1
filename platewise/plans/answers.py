"""Prompts and answers about dishes; each SQL twin is a text of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platewise.catalog import query
from platewise.functions.dialect import DUCK
from platewise.operators import prompts
from platewise.plans.base import statement
from platewise.plans.menu import dishes
from platewise.session import table

CONTEXT = "light lunch"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    hints = F.when(F.col("local_id") % 6 == 0, F.array()).otherwise(F.array_compact(F.array(F.when(F.contains(F.lower("dish_name"), F.lit("chicken")), F.lit("chicken")), F.when(F.contains(F.lower("dish_name"), F.lit("salad")), F.lit("salad")), F.lit("salt"))))
    rows = dishes(spark, sf_dir).withColumns({"ingredient_hints": hints, "explicit_allergens": F.filter(F.array(F.lower("allergen")), lambda a: a != "")})
    return rows.withColumn("position", (F.row_number().over(Window.partitionBy("p_brand").orderBy("local_id")) - 1).cast("int"))


_ITEMS = """i as (
  select *, row_number() over (partition by p_brand order by id) - 1 as position, list_filter([lower(allergen)], lambda a: a <> '') as allergens,
    case when id % 6 = 0 then [] else list_filter([case when contains(lower(dish_name), 'chicken') then 'chicken' end, case when contains(lower(dish_name), 'salad') then 'salad' end, 'salt'], lambda h: h is not null) end as hints from items
)"""
_WHY = """coalesce(nullif(array_to_string(list_filter([
    case when vegetarian or vegan then 'Parsed menu signals suggest ' || concat_ws(', ', case when vegetarian then 'vegetarian' end, case when vegan then 'vegan' end) || '.' end,
    case when cal_mid <= 450 then 'Its calorie estimate sits on the lighter side.' when cal_mid <= 650 then 'Its calorie estimate stays in a moderate range.' end, {goal}], lambda n: n is not null)[1:2], ' '), ''),
  'It is included because the parsed menu text produced a usable structured dish entry.')"""
_CALORIES = "case when cal_mid is not null then cast(cast(cal_mid as bigint) as varchar) || ' kcal estimate' else 'broad calorie estimate' end"
_SUMMARY = f"""dish_name || ' from the ' || lower(coalesce(nullif(section, ''), 'menu')) || ' section' || case when len(hints) > 0 then ' with likely ingredients such as ' || array_to_string(hints[1:3], ', ') || '; ' || {_CALORIES}
    when evidence then ', grounded with similar annotated menu examples; ' || {_CALORIES} else ' with ' || {_CALORIES} end || '.'"""
_CAUTION = """coalesce(nullif(concat_ws(' ', case when len(allergens) > 0 then 'Possible allergens: ' || array_to_string(allergens[1:4], ', ') || '.' end, case when nut_conf < 0.75 then 'Nutrition estimate is heuristic and may be broad.' end,
    case when coalesce(description, '') = '' then 'Description is missing, so some details may be uncertain.' end), ''), 'Use the menu text or staff confirmation for exact ingredients and allergen handling.')"""
_HIGHLIGHT = "case when len(hints) > 0 then 'It highlights likely ingredients such as ' || array_to_string(hints[1:2], ', ') || '.' end"


@query("llm_fallback_text", statement(DUCK, lambda d: f"""with {_ITEMS}, e as (select *, id % 2 = 0 as evidence from i)
select id, {_SUMMARY} as summary, {_WHY.format(goal=_HIGHLIGHT)} as fit, {_WHY.format(goal="'It aligns with lighter meal preferences.'")} as fit_goal, {_CAUTION} as caution from e"""))  # fmt: skip
def _fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of a dish without an answer, for a guest without and with a wish."""
    summary = prompts.fallback_summary(F.col("local_id") % 2 == 0)
    return _items(spark, sf_dir).select(F.col("local_id").alias("id"), summary.alias("summary"), prompts.fallback_why(None).alias("fit"), prompts.fallback_why(CONTEXT).alias("fit_goal"), prompts.fallback_caution().alias("caution"))


# answers as a model sends them: in another order, without ids, with rows missing or too many, by kinds of pages
ANSWERS = """
select p_brand, case when kind = 0 then 100000 - position else position end as position, case when id % 5 = 0 or (kind in (1, 3) and id % 3 = 0) then '  ' else cast(id as varchar(20)) end as local_id,
  case when id % 5 = 0 and not (kind in (1, 3) and id % 3 = 0) then concat(' ', cast(id as varchar(20))) end as item_local_id,
  case id % 4 when 1 then ' - Nice  dish , User Context: light lunch. ; ' when 2 then 'light lunch' when 3 then concat('Dish ', cast(id as varchar(20)), ' :  warm .') end as summary, case when id % 7 = 0 then 'fits well' end as fit_reason
from (select *, cast(right(p_brand, 1) as int) % 4 as kind from i) k where not (kind = 2 and id % 3 = 0)
union all select p_brand, max(position) + 1, null, null, 'one too many', null from i where cast(right(p_brand, 1) as int) % 4 = 3 group by p_brand"""


@query("answers_aligned", statement(DUCK, lambda d: f"""with {_ITEMS}, a as ({ANSWERS}), r as (
  select *, coalesce(nullif(trim(local_id), ''), nullif(trim(item_local_id), '')) as key from a
), n as (
  select p_brand, n_items, n_rows, n_ids from (select p_brand, count(*) as n_items from i group by p_brand) x left join (select p_brand, count(*) as n_rows, count(distinct key) as n_ids from r group by p_brand) y using (p_brand)
), j as (
  select i.*, false as evidence, b.key is not null as by_id, p.p_brand is not null and n_ids <> n_items and n_rows = n_items as by_place, b.summary as s1, p.summary as s2, b.fit_reason as f1, p.fit_reason as f2
  from i join n using (p_brand) left join (select * from r where key is not null qualify row_number() over (partition by p_brand, key order by position desc) = 1) b on b.p_brand = i.p_brand and b.key = cast(i.id as varchar)
  left join r p on p.p_brand = i.p_brand and p.position = i.position
), t as (
  select *, case when by_id then s1 when by_place then s2 end as s, case when by_id then f1 when by_place then f2 end as f from j
), c as (
  select *, nullif(trim(regexp_replace(regexp_replace(replace(regexp_replace(trim(regexp_replace(s, '\\s+', ' ', 'g')), '(?i)\\buser context:\\s*light lunch\\.?', '', 'g'), 'light lunch', ''), '\\s{{2,}}', ' ', 'g'), '\\s+([,.;:])', '\\1', 'g'), ' -:;,.'), '') as clean from t
)
select id, case when by_id then 'id' when by_place then 'position' end as aligned_by, coalesce(clean, {_SUMMARY}) as summary, coalesce(f, {_WHY.format(goal="'It aligns with lighter meal preferences.'")}) as fit from c"""))  # fmt: skip
def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    items.withColumnRenamed("local_id", "id").createOrReplaceTempView("i")
    out = prompts.enriched_texts(items, spark.sql(ANSWERS), "p_brand", CONTEXT)
    return out.select(F.col("local_id").alias("id"), "aligned_by", F.col("llm_summary").alias("summary"), F.col("llm_why_it_fits").alias("fit"))


@query("prompt_payloads", statement(DUCK, lambda d: f"""with {_ITEMS}, ev as (
  select l_partkey, l_returnflag as source_type, cast(l_orderkey * 10 + l_linenumber as varchar) as source_id, l_returnflag || l_linestatus as title, l_discount as similarity, l_returnflag || l_linestatus as content_preview from lineitem
  qualify row_number() over (partition by l_partkey order by similarity desc, source_id) <= 3
), g as (select l_partkey, list({{'source_type': source_type, 'source_id': source_id, 'title': title, 'similarity': similarity, 'content_preview': content_preview}} order by similarity desc, source_id) as found from ev group by l_partkey),
f as (select * from i qualify row_number() over (partition by p_brand order by id) <= 8),
p as (select p_brand, id, to_json({{'local_id': id, 'dish_name': dish_name, 'section': section, 'description': description, 'ingredient_hints': hints, 'explicit_allergens': allergens, 'diet_flags': {{'vegetarian': vegetarian, 'vegan': vegan}},
  'calories_low': cal_low, 'calories_mid': cal_mid, 'calories_high': null, 'nutrition_confidence': nut_conf, 'parser_confidence': conf, 'retrieved_evidence': coalesce(found, [])}}) as item from f left join g on id = l_partkey)
select p_brand, count(*) as n_items, '{{"user_context":"light lunch","items":[' || string_agg(item, ',' order by id) ||
  '],"output_format":{{"items":[{{"local_id":"same as input","llm_summary":"short grounded summary","llm_why_it_fits":"short grounded fit explanation","llm_caution_note":"short grounded caution note"}}]}}}}' as prompt from p group by p_brand"""))  # fmt: skip
def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt a page (brand) over its first eight dishes, each with three rows of evidence out of its orders."""
    lines = table(spark, sf_dir, "lineitem")
    note = F.concat("l_returnflag", "l_linestatus")
    evidence = lines.select(
        F.col("l_partkey").alias("local_id"), F.col("l_returnflag").alias("source_type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("source_id"), note.alias("title"), F.col("l_discount").alias("similarity"), F.substring(note, 1, 20).alias("content_preview")
    )
    items = _items(spark, sf_dir).where("position < 8")
    return prompts.page_prompts(prompts.prompt_items(items, evidence, 3), "p_brand", 8, CONTEXT)
