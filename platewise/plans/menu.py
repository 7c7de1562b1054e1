"""Enrichment, constraints, ranking and combination of dishes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.catalog import QUERIES
from platewise.functions import lexicon as L
from platewise.functions.dialect import SPARK
from platewise.operators import recommend
from platewise.operators.recommend import Request
from platewise.plans.base import any_of, category, evidence, sql_query, statement, views

FULL = "lower(concat_ws(' ', nullif(trim(dish_name), ''), nullif(trim(description), ''), nullif(trim(section), '')))"

sql_query("concat_item_text", lambda d: f"select id, {FULL} as item_text, concat_ws(' ', 'spicy craving', 'chicken rice', 'mains') as query_text from items")
sql_query("safe_cast_prices", lambda d: f"""
select p_partkey, case when isnan(v) then null else round(v, 2) end as price from (
  select p_partkey, {d.try_double("replace(case when p_partkey % 7 = 0 then 'nan' when p_partkey % 7 = 1 then '' when p_partkey % 7 = 2 then 'abc' else cast(p_partkey as varchar(20)) || ',5' end, ',', '.')")} as v from part) t""")
sql_query("allergen_keywords", lambda d: f"""
select id, {d.gather_set('ingredient', ',')} as allergens, count(distinct ingredient) as n from ({evidence(d)}) e
where ingredient in ({', '.join(repr(a) for a in L.ALLERGENS)}) group by id""")
sql_query("evidence_order", lambda d: f"""
select id, {d.gather('ingredient', 'rn', ',')} as hints from (
  select id, ingredient, row_number() over (partition by id order by strength desc, ingredient) as rn from ({evidence(d)}) e) r group by id""")
sql_query("calorie_reference", lambda d: f"""
with e as ({evidence(d)}), n as (select * from (values {', '.join(f"('{k}', {c}e0, {g}e0)" for k, (c, g) in L.NUTRITION.items())}) as n(ingredient, kcal, serving))
select id, count(*) as matched, round(avg(greatest(0.35e0, least(1e0, strength))), 4) as mean_weight,
  round(greatest(40e0, 0.8e0 * sum(kcal * serving / 100 * greatest(0.35e0, least(1e0, strength)))) + 1e-7, 3) as cal_low,
  round(sum(kcal * serving / 100 * greatest(0.35e0, least(1e0, strength))) + 1e-7, 3) as cal_mid,
  round(1.25e0 * sum(kcal * serving / 100 * greatest(0.35e0, least(1e0, strength))) + 1e-7, 3) as cal_high,
  round(least(0.2e0, 0.05e0 * count(*)), 4) as bonus
from e join n using (ingredient) group by id""")


def heuristic(d) -> str:
    values = ", ".join(f"('{k}', {a}, {b}, {c})" for k, (a, b, c) in L.CALORIE_ADJUSTMENTS.items())
    text = "lower(concat_ws(' ', dish_name, description, section))"
    mod = lambda i: " + ".join(f"case when {any_of(text, list(w))} then {v[i]} else 0 end" for w, v in ((("fried", "crispy"), (60, 100, 160)), (("double", "loaded"), (80, 130, 200)), (("mini", "small"), (-40, -50, -60))))
    return f"""
select i.id, greatest(40e0, b0 + a0) as low, greatest(greatest(40e0, b0 + a0), b1 + a1) as mid, greatest(greatest(greatest(40e0, b0 + a0), b1 + a1), b2 + a2) as high, m,
  least(0.95e0, 0.45e0 + least(0.25e0, 0.05e0 * m) + case when coalesce(description, '') <> '' then 0.15e0 else 0e0 end + case when coalesce(section, '') <> '' then 0.10e0 else 0e0 end) as hconf
from (select id, description, section, {', '.join(f"{category(text, i)} + ({mod(i)}) as b{i}" for i in range(3))} from items) i
join (select items.id, coalesce(sum(a), 0) as a0, coalesce(sum(b), 0) as a1, coalesce(sum(c), 0) as a2, count(e.ingredient) as m from items
  left join ({evidence(d)}) e on items.id = e.id left join (select * from (values {values}) as v(ingredient, a, b, c)) v on e.ingredient = v.ingredient group by items.id) s on i.id = s.id"""


sql_query("calorie_heuristic", lambda d: f"select id, round(low, 1) as cal_low, round(mid, 1) as cal_mid, round(high, 1) as cal_high, round(hconf, 3) as conf from ({heuristic(d)}) h")


def flags(d) -> str:
    has = lambda group: f"max(case when ingredient in ({', '.join(repr(g) for g in group)}) then 1 else 0 end)"
    return f"""
select i.id, n, meat, sea, animal, gluten, dairy, {', '.join(f"{any_of('txt', w)} as m_{k}" for k, w in L.DIET_MARKERS.items())}, {any_of('txt', L.GLUTEN_RISK)} as g_risk, {any_of('txt', L.DAIRY_RISK)} as d_risk
from (select id, {FULL} as txt from items) i left join (
  select id, count(*) as n, {has(L.MEAT)} as meat, {has(L.SEAFOOD)} as sea, {has(L.ANIMAL)} as animal, {has(L.GLUTEN)} as gluten, {has(['milk'])} as dairy from ({evidence(d)}) e group by id) e on i.id = e.id"""


sql_query("diet_flags", lambda d: f"""
select id, (m_vegetarian or m_vegan or coalesce(n, 0) > 0) and coalesce(meat, 0) = 0 and coalesce(sea, 0) = 0 as vegetarian,
  (m_vegan or coalesce(n, 0) > 0) and coalesce(animal, 0) = 0 as vegan,
  (m_gluten_free or coalesce(n, 0) > 0) and coalesce(gluten, 0) = 0 and (m_gluten_free or not g_risk) as gluten_free,
  (m_dairy_free or coalesce(n, 0) > 0) and coalesce(dairy, 0) = 0 and (m_dairy_free or not d_risk) as dairy_free
from ({flags(d)}) f""")
sql_query("enrich_items", lambda d: f"""
with h as ({heuristic(d)}), r as (
  select id, count(*) as m, avg(strength) as w, sum(kcal * serving / 100 * greatest(0.35e0, strength)) as rmid from ({evidence(d)}) e
  join (select * from (values {', '.join(f"('{k}', {c}e0, {g}e0)" for k, (c, g) in L.NUTRITION.items())}) as n(ingredient, kcal, serving)) n using (ingredient) group by id
), z as (
  select h.id, low, mid, high, hconf, r.m, rmid,
    case when r.m is null then 0e0 else round(least(0.92e0, greatest(0.2e0, 1 / (1 + exp(-(-1.15e0 + 0.52e0 * r.m + 0.85e0 * w + case when coalesce(description, '') <> '' then 0.22e0 else 0e0 end
      + case when coalesce(section, '') <> '' then 0.18e0 else 0e0 end + 0.35e0 * case when conf = 0 then 0.5e0 else conf end))))), 3) end as blend,
    1 / (1 + exp(-(-0.7e0 + 0.14e0 * h.m + 0.48e0 * coalesce(r.m, 0) + 0.75e0 * coalesce(w, 0) + case when coalesce(description, '') <> '' then 0.22e0 else 0e0 end
      + case when coalesce(section, '') <> '' then 0.18e0 else 0e0 end + 0.55e0 * case when conf = 0 then 0.5e0 else conf end))) as logistic
  from h join items on h.id = items.id left join r on h.id = r.id
)
select id, blend, round(mid + blend * (coalesce(rmid, mid) - mid), 1) as cal_mid, round(low + blend * (coalesce(greatest(40e0, 0.8e0 * rmid), low) - low), 1) as cal_low,
  round(high + blend * (coalesce(1.25e0 * rmid, high) - high), 1) as cal_high,
  round(case when m is null then hconf else least(0.98e0, greatest(logistic, least(0.98e0, hconf + least(0.2e0, 0.05e0 * m)))) end, 3) as conf from z""")
sql_query("seed_enrichment", lambda d: f"""
select id, count(*) as n, round(sum(kcal * serving / 100), 3) as mid, 'seeded from gold data' as note from ({evidence(d)}) e
join (select * from (values {', '.join(f"('{k}', {c}e0, {g}e0)" for k, (c, g) in L.NUTRITION.items())}) as n(ingredient, kcal, serving)) n using (ingredient) group by id""")

#: What the ranking queries ask for; their SQL spells it out.
REQUEST = Request(
    craving_text="spicy chicken rice salad", liked_terms=("chicken", "rice"), disliked_terms=("tofu",), excluded_allergens=("egg",), required_diet_flags=("vegetarian", "vegan"),
    preferred_sections=("economy", "small"), excluded_sections=("promo",), max_price=20, max_calories=600,
)


def dishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dishes over ``part`` with the columns that the recommendation takes."""
    views(spark, sf_dir)
    items = spark.sql(statement(SPARK, lambda d: "select * from items"))
    names = {"id": "local_id", "price": "price_value", "cal_mid": "calories_mid", "cal_low": "calories_low", "nut_conf": "nutrition_confidence", "conf": "parser_confidence"}
    return items.withColumnsRenamed(names).withColumns({"explicit_allergens": F.array("allergen"), "diet_flags": F.create_map(F.lit("vegetarian"), "vegetarian", F.lit("vegan"), "vegan")})


def by_request(name: str, run) -> None:
    """Run a query by the operators; the SQL that is registered for it checks them in the other engine."""
    QUERIES[name] = lambda spark, sf_dir: run(dishes(spark, sf_dir))


CALORIES = "case when cal_mid is null then 'unknown' when cal_mid <= 600 then 'within' when nut_conf >= 0.75e0 then 'exceeds' when cal_low > 600 then 'exceeds' else 'uncertain' end"
KEEP = f"""lower(allergen) <> 'egg' and not (coalesce(lower(section), '') in ('promo')) and not contains({FULL}, 'tofu')
  and coalesce(price <= 20, true) and {CALORIES} <> 'exceeds' and vegetarian and vegan"""
sql_query("filter_constraints", lambda d: f"select id, {CALORIES} as calorie_status, price from items where {KEEP}")


by_request("filter_constraints", lambda items: recommend.allowed(items, REQUEST).select(F.col("local_id").alias("id"), "calorie_status", F.col("price_value").alias("price")))


def scored(d) -> str:
    """Filtered candidates with the rule score and its reasons."""
    parts = [
        ("coalesce(section, '') in ('economy', 'small')", "0.15e0", "preferred section"),
        ("coalesce(description, '') <> ''", "0.05e0", "has description"),
        ("conf is not null", "0.15e0 * conf", "parser confidence"),
        ("price <= 20", "0.10e0", "within budget"),
        ("cal_mid is not null and status = 'within'", "0.14e0", "within calorie target"),
        ("cal_mid is not null and status = 'uncertain'", "0.05e0", "possible calorie fit"),
        ("nut_conf is not null", "0.10e0 * nut_conf", "nutrition estimate available"),
        ("vegetarian", "0.18e0", "diet filter match"),
        (f"{any_of(FULL, ['chicken', 'rice'])}", "0.20e0", "liked terms match"),
    ]
    return f"""select *, {' + '.join(f"case when {c} then {v} else 0e0 end" for c, v, _ in parts)} as rule,
  {d.join(d.compact(*(f"case when {c} then '{r}' end" for c, _, r in parts)), '|')} as reasons
from (select *, {CALORIES} as status from items where {KEEP}) c"""


def tfidf(d, source: str, query: str = "spicy chicken rice salad") -> str:
    """(id, semantic): cosine of TF-IDF rows, 1- and 2-grams, smooth idf, the query being one of the texts."""
    words = d.every("t", "[a-z0-9][a-z0-9]+")
    return f"""
docs as (select id, {FULL} as t from {source} union all select -1 as id, '{query}' as t),
w as (select id, {d.posexplode(words, 'pos', 'term')} from docs),
g as (select id, term from w union all select a.id, concat(a.term, ' ', b.term) as term from w a join w b on a.id = b.id and a.pos + 1 = b.pos),
tf as (select id, term, count(*) as n from g group by id, term),
df as (select term, ln((1e0 + (select count(*) from docs)) / (1e0 + count(*))) + 1 as idf from tf group by term),
v as (select id, term, n * idf as x from tf join df using (term)),
norm as (select id, sqrt(sum(x * x)) as len from v group by id),
q as (select term, x / len as y from v join norm using (id) where id = -1),
semantic as (select v.id, sum(x / len * y) as s from v join norm on v.id = norm.id join q on v.term = q.term where v.id >= 0 group by v.id)"""


sql_query("rule_score", lambda d: f"select id, round(rule + 1e-9, 4) as rule, reasons, case when rule >= 0.68e0 then 'Strong match' when rule >= 0.40e0 then 'Good match' else 'Weak match' end as label from ({scored(d)}) s")
by_request("rule_score", lambda items: recommend.allowed(items, REQUEST).select(F.col("local_id").alias("id"), F.round(F.col("rule_score") + 1e-9, 4).alias("rule"), F.array_join("reasons", "|").alias("reasons"), recommend.match_label(F.col("rule_score")).alias("label")))
sql_query("tfidf_scores", lambda d: f"with {tfidf(d, 'items')} select id, round(s, 6) as score from semantic")
by_request("tfidf_scores", lambda items: recommend.tfidf_scores(items.select("local_id", recommend.dish_text().alias("text")), "spicy chicken rice salad").select(F.col("local_id").alias("id"), F.round("semantic_score", 6).alias("score")))


def ranked(d) -> str:
    return f"""with cand as ({scored(d)}), {tfidf(d, 'cand', REQUEST.query_text())}, blend as (
  select cand.id, dish_name, section, price, cal_mid, nut_conf, reasons, round(0.60e0 * coalesce(s, 0e0) + 0.40e0 * rule, 4) as score, 0.60e0 * coalesce(s, 0e0) + 0.40e0 * rule as raw, rule
  from cand left join semantic on cand.id = semantic.id)"""


sql_query("score_blend", lambda d: f"{ranked(d)} select id, score from blend")
by_request("score_blend", lambda items: recommend.scored(items, REQUEST).select(F.col("local_id").alias("id"), "score"))
TOP = "top as (select *, row_number() over (order by score desc, id) as rnk from (select * from blend order by score desc, id limit 8) b)"
sql_query("recommend_topk", lambda d: f"""{ranked(d)}, {TOP}
select cast(rnk as int) as rnk, id, dish_name, score, case when raw >= 0.68e0 then 'Strong match' when raw >= 0.40e0 then 'Good match' else 'Weak match' end as label, reasons from top where rnk <= 5""")
by_request("recommend_topk", lambda items: recommend.recommend(items, REQUEST).select(F.col("rank").alias("rnk"), F.col("local_id").alias("id"), "dish_name", "score", F.col("match_label").alias("label"), F.array_join("reasons", "|").alias("reasons")))


#: The combinations of the pool of eight, all 84 of them that fit.
COMBO_REQUEST = replace(REQUEST, combo_budget=60, combo_max_calories=1500, top_k=84)
sql_query("combos", lambda d: f"""{ranked(d)}, {TOP}, sets as (
  select 2 as n, a.id as a, b.id as b, -1 as c, a.price + b.price as price, a.cal_mid + b.cal_mid as cal, a.score + b.score as total, a.nut_conf + b.nut_conf as nc,
    nullif(a.section, '') as s1, nullif(b.section, '') as s2, cast(null as varchar(99)) as s3 from top a join top b on a.rnk < b.rnk
  union all
  select 3, a.id, b.id, c.id, a.price + b.price + c.price, a.cal_mid + b.cal_mid + c.cal_mid, a.score + b.score + c.score, a.nut_conf + b.nut_conf + c.nut_conf,
    nullif(a.section, ''), nullif(b.section, ''), nullif(c.section, '') from top a join top b on a.rnk < b.rnk join top c on b.rnk < c.rnk),
fit as (select *, round(price, 2) as total_price, coalesce(s1 <> s2, false) or coalesce(s1 <> s3, false) or coalesce(s2 <> s3, false) as varied from sets where price <= 60 and cal <= 1500)
select a, b, c, total_price, round(cal, 1) as total_calories, round(total / n + case when varied then 0.06e0 else 0e0 end + case when total_price <= 60 then 0.12e0 else 0e0 end
  + case when total_price / 60e0 between 0.65e0 and 1e0 then 0.05e0 else 0e0 end + 0.10e0 + coalesce(0.05e0 * nc / n, 0e0) + 1e-9, 4) as score, varied from fit""")
by_request("combos", lambda items: recommend.combinations(items, COMBO_REQUEST).select(
    F.element_at("item_ids", 1).alias("a"), F.element_at("item_ids", 2).alias("b"), F.coalesce(F.try_element_at("item_ids", F.lit(3)), F.lit(-1)).alias("c"),
    "total_price", "total_calories", "score", F.array_contains("reasons", "section diversity").alias("varied"),
))
sql_query("hybrid_rank", lambda d: f"""
select id, concat_ws(' | ', dish_name, 'section: ' || nullif(section, ''), description) as item_text,
  round(case when contains({FULL}, 'chicken') then 0.15e0 else 0e0 end - case when contains({FULL}, 'coffee') then 0.35e0 else 0e0 end
    + case when cal_mid <= 600 then 0.10e0 when cal_mid > 600 then -0.50e0 else 0e0 end + case when price <= 20 then 0.08e0 when price > 20 then -0.40e0 else 0e0 end, 4) as score
from items where lower(allergen) <> 'egg'""")
sql_query("group_by_section", lambda d: """
with s as (select coalesce(nullif(section, ''), 'Unsorted') as section, id from items), g as (select section, min(id) as first_seen, count(*) as n from s group by section)
select section, first_seen, n, id from s join g using (section)""")
sql_query("rule_documents", lambda d: f"""
select concat('ingredient:', ingredient) as doc_key, concat(ingredient, ' is found by ', {d.gather('word', 'word', ', ')}) as content from (values {', '.join(f"('{k}', '{w}')" for k, ws in L.INGREDIENT_KEYWORDS.items() for w in ws)}) as k(ingredient, word) group by ingredient""")
