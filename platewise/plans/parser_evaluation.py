"""A parser's dishes against gold ones by the full rules; each SQL twin is a text of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.catalog import query
from platewise.functions.dialect import DUCK, SPARK
from platewise.operators import evaluation
from platewise.plans.base import statement, views

PAGE = ["menu_id"]
#: Gold dishes of a brand's page; several of a page have one name.
GOLD = """select p_brand as menu_id, id as position, case when id % 41 = 0 then ' ' when id % 3 = 0 then substr(dish_name, 1, 9) else dish_name end as dish_name, section, price as price_value, description from items"""
#: What a parser makes of them: dishes lost, doubled, unnamed, renamed, and with other sections, prices and descriptions.
PREDICTED = f"""
select menu_id, position, case when position % 31 = 0 then null when position % 29 = 0 then concat('x', dish_name) else concat('  ', upper(dish_name)) end as dish_name, case when position % 7 = 0 then 'other' else upper(section) end as section,
  case when position % 5 = 0 then price_value + 1 else price_value end as price_value, case when position % 6 = 0 then concat(description, '!') else description end as description
from ({GOLD}) g where position % 19 <> 0
union all select menu_id, position + 1000000, dish_name, section, price_value, description from ({GOLD}) h where position % 23 = 0"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    gold, predicted = (spark.sql(statement(SPARK, lambda d, q=q: q)) for q in (GOLD, PREDICTED))
    return evaluation.match_items(predicted, gold, PAGE)


_NORMAL = "trim(regexp_replace(lower(coalesce({x}, '')), '\\s+', ' ', 'g'))"
_PAIRS = f"""g as (select *, {_NORMAL.format(x='dish_name')} as n from ({GOLD}) x), p as (select *, {_NORMAL.format(x='dish_name')} as n from ({PREDICTED}) x),
gk as (select *, row_number() over (partition by menu_id, n order by position) as k from g where n <> ''), pk as (select *, row_number() over (partition by menu_id, n order by position) as k from p),
m as (select coalesce(pk.menu_id, gk.menu_id) as menu_id, pk.menu_id is not null as has_pred, gk.menu_id is not null as has_gold, coalesce(pk.n, gk.n) as n, pk.dish_name as pn, gk.dish_name as gn, {_NORMAL.format(x='pk.section')} as ps, {_NORMAL.format(x='gk.section')} as gs,
  round(pk.price_value, 2) as pp, round(gk.price_value, 2) as gp, {_NORMAL.format(x='pk.description')} as pd, {_NORMAL.format(x='gk.description')} as gd
  from pk full join gk on pk.menu_id = gk.menu_id and pk.n = gk.n and pk.k = gk.k and pk.n <> '')"""


@query("greedy_match", statement(DUCK, lambda d: f"""with {_PAIRS}
select menu_id, 'empty_pred_name' as error_type, null::varchar as pred_name, null::varchar as gold_name from m where has_pred and n = ''
union all select menu_id, 'false_positive_item', pn, null from m where has_pred and not has_gold and n <> '' union all select menu_id, 'missed_gold_item', null, gn from m where not has_pred
union all select menu_id, 'wrong_section', pn, gn from m where has_pred and has_gold and gs <> '' and gs <> ps
union all select menu_id, 'wrong_price', pn, gn from m where has_pred and has_gold and gp is not null and gp is distinct from pp
union all select menu_id, 'wrong_description', pn, gn from m where has_pred and has_gold and gd <> '' and gd <> pd"""))  # fmt: skip
def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.parser_errors(_matched(spark, sf_dir), PAGE)


@query("parser_metrics", statement(DUCK, lambda d: f"""with {_PAIRS}, s as (
  select count(*) filter (where has_pred and has_gold) as tp, count(*) filter (where has_pred and not has_gold) as fp, count(*) filter (where not has_pred) as fn,
    count(*) filter (where has_pred and has_gold and gs <> '') as ns, count(*) filter (where has_pred and has_gold and gs <> '' and gs = ps) as os,
    count(*) filter (where has_pred and has_gold and gp is not null) as np, count(*) filter (where has_pred and has_gold and gp = pp) as op,
    count(*) filter (where has_pred and has_gold and gd <> '') as nd, count(*) filter (where has_pred and has_gold and gd <> '' and gd = pd) as od from m
)
select tp as item_tp, fp as item_fp, fn as item_fn, round(tp / (tp + fp), 4) as item_precision, round(tp / (tp + fn), 4) as item_recall, round(2 * tp / (2 * tp + fp + fn), 4) as item_f1,
  round(os / nullif(ns, 0), 4) as section_accuracy, round(op / nullif(np, 0), 4) as price_accuracy, round(od / nullif(nd, 0), 4) as description_exact_match from s"""))  # fmt: skip
def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.parser_metrics(_matched(spark, sf_dir)).drop("price_mae")


@query("price_mae", statement(DUCK, lambda d: f"with {_PAIRS} select round(avg(abs(pp - gp)), 4) as price_mae from m where has_pred and has_gold"))
def _mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over matched pairs that both have a price."""
    return evaluation.parser_metrics(_matched(spark, sf_dir)).select(F.col("price_mae"))
