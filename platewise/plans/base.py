"""Shared pieces of the query plans: registration for both engines, and the menu views over the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from platewise.catalog import ORACLES, QUERIES
from platewise.functions import lexicon as L
from platewise.functions.dialect import DUCK, SPARK, Spark
from platewise.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
FOODS = ["chicken salad", "beef burger", "grilled steak", "veggie pizza", "fish soup", "egg biryani", "chocolate cake", "tofu noodles", "coffee", "lamb wrap", "shrimp pasta", "peanut brownie"]
SIDES = ["fries", "cheddar cream", "spinach and corn", "sesame rice", "almond butter", "mushroom", "tomato"]

#: Dishes over ``part``: name, description, section, price, calories and confidences by fixed arithmetic.
ITEMS = lambda d: f"""
select p_partkey as id, concat(p_name, ' ', {d.pick(FOODS, 'p_partkey % 12')}) as dish_name,
  case when p_partkey % 5 = 0 then null else concat('with ', {d.pick(SIDES, 'p_partkey % 7')}) end as description,
  case when p_partkey % 9 = 0 then null when p_partkey % 9 = 1 then '' else lower(p_type) end as section,
  case when p_partkey % 11 = 0 then null else round(p_retailprice / 50, 2) end as price,
  case when p_partkey % 13 = 0 then null else cast(200 + p_size * 12 as double) end as cal_mid,
  case when p_partkey % 13 = 0 then null else cast(120 + p_size * 12 as double) end as cal_low,
  cast(p_partkey % 10 as double) / 10 as nut_conf, cast(p_partkey % 7 as double) / 8 as conf,
  case when p_partkey % 4 = 0 then 'Milk' when p_partkey % 4 = 1 then 'Egg' else '' end as allergen,
  p_partkey % 3 = 0 as vegan, p_partkey % 2 = 0 as vegetarian, p_size, p_brand
from part"""  # noqa: E731

#: Text lines of the documents.
LINES = lambda d: f"""
select doc_id, line_order, text, length(text) as n from (
  select doc_id, {d.posexplode(d.split("coalesce(text, '')", chr(10)), 'line_order', 'text')} from documents) t where length(text) > 0"""  # noqa: E731

VIEWS = {"items": ITEMS, "lines": LINES}


def views(spark: SparkSession, sf_dir: str) -> None:
    """Register the tables as views; a plan that is analysed keeps the tables it was analysed with."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def statement(d: Spark, sql: Callable[[Spark], str]) -> str:
    body = sql(d).strip()
    used = [f"{n} as ({v(d)})" for n, v in VIEWS.items() if f" {n}" in body]
    rest = body[5:] if body.lower().startswith("with ") else None
    if not used:
        return body
    return f"with {', '.join(used)}" + (f", {rest}" if rest else f" {body}")


def sql_query(name: str, sql: Callable[[Spark], str], oracle: bool = True) -> None:
    """Register a query that both engines run, each in its own dialect."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir)
        return spark.sql(statement(SPARK, sql))

    run.__name__ = name
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = statement(DUCK, sql)


def any_of(x: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, '{w}')" for w in words) + ")"


def evidence(d: Spark) -> str:
    """(id, ingredient, strength): the strongest place in which a keyword of the ingredient stands.

    Spark tests the keywords in a projection over the items; the other engine joins them with a table of keywords.
    """
    if d.name == "spark":
        strength = lambda ws: f"case when {any_of('n', ws)} then 1e0 when {any_of('t', ws)} then 0.82e0 when {any_of('s', ws)} then 0.58e0 end"
        found = ", ".join(f"struct('{k}' as ingredient, {strength(ws)} as strength)" for k, ws in L.INGREDIENT_KEYWORDS.items())
        fields = "lower(dish_name) as n, lower(coalesce(description, '')) as t, lower(coalesce(section, '')) as s"
        return f"select id, inline(filter(array({found}), e -> e.strength is not null)) as (ingredient, strength) from (select id, {fields} from items) i"
    values = ", ".join(f"('{k}', '{w}')" for k, ws in L.INGREDIENT_KEYWORDS.items() for w in ws)
    return f"""
select id, ingredient, max(case when contains(lower(dish_name), word) then 1e0 when contains(lower(coalesce(description, '')), word) then 0.82e0 else 0.58e0 end) as strength
from items join (select * from (values {values}) as k(ingredient, word)) k
  on contains(lower(dish_name), word) or contains(lower(coalesce(description, '')), word) or contains(lower(coalesce(section, '')), word)
group by id, ingredient"""


def category(x: str, place: int) -> str:
    cases = " ".join(f"when {any_of(x, list(words))} then {values[place]}" for words, values in L.CATEGORY_RULES)
    return f"cast(case {cases} else {L.DEFAULT_RANGE[place]} end as double)"
