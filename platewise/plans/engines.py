"""The encoder chain and the whole recommendation; each SQL twin is a text of its own."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.catalog import query
from platewise.functions.dialect import DUCK
from platewise.operators import encoders, recommend
from platewise.plans.base import statement
from platewise.plans.menu import FULL, REQUEST, TOP, dishes, ranked, tfidf

QUERY = "spicy chicken rice salad"


def _missing():
    raise FileNotFoundError("no model of sentences on this machine")


class _Unavailable(encoders.TfidfEncoder):
    def probe(self) -> None:
        raise ImportError("switched off")


@query("encoder_chain", statement(DUCK, lambda d: f"""with {tfidf(d, 'items', QUERY)}, b as (
  select id, list_filter(regexp_split_to_array(lower({FULL}), '\\s+'), lambda w: w <> '') as ws from items
), n as (
  select id, len(list_filter(ws, lambda w: w = 'spicy')) + len(list_filter(ws, lambda w: w = 'chicken')) + len(list_filter(ws, lambda w: w = 'rice')) + len(list_filter(ws, lambda w: w = 'salad')) as dot,
    list_sum(list_transform(list_distinct(ws), lambda k: len(list_filter(ws, lambda w: w = k)) ** 2)) as square from b
)
select 'tfidf' as engine, 1 as skipped, id, round(s, 6) as score from semantic
union all select 'bag_of_words', 2, id, round(dot / sqrt(square) / 2.0, 6) from n where dot > 0"""))  # fmt: skip
def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain whose first encoder lacks its model falls to TF-IDF, and to the bag of words where that is switched off."""
    texts, out = encoders.dish_texts(dishes(spark, sf_dir)), None
    dense = encoders.DenseEncoder(_missing)
    for chain in ((dense, encoders.TfidfEncoder(), encoders.BagOfWords()), (dense, _Unavailable(), encoders.BagOfWords())):
        scores, choice = encoders.semantic_scores(texts, QUERY, chain)
        rows = scores.select(F.lit(choice.used).alias("engine"), F.lit(len(choice.skipped)).alias("skipped"), F.col("local_id").alias("id"), F.round("semantic_score", 6).alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return out


class _RuleModel:
    """Stands for a fitted reranker: the raw score is the rule score, so SQL can follow it."""

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", F.col("rule_score"))


COMBO_REQUEST = replace(REQUEST, combo_budget=60, combo_max_calories=1500, combo_max_items=2, top_k=28)
_RERANKED = """blend0 as (select * from blend), ends as (select min(rule) as lo, max(rule) as hi from blend0),
again as (select b.* replace (round(0.65 * b.score + 0.35 * case when hi = lo then 0.5 else (rule - lo) / (hi - lo) end, 4) as score) from blend0 b cross join ends)"""


@query("recommend_reranked", statement(DUCK, lambda d: f"""{ranked(d)}, {_RERANKED}, {TOP.replace('blend', 'again')}, fit as (
  select a.id as a, b.id as b, round(a.price + b.price, 2) as total_price, round(a.cal_mid + b.cal_mid, 1) as cal, a.score + b.score as total, a.nut_conf + b.nut_conf as nc,
    coalesce(nullif(a.section, '') <> nullif(b.section, ''), false) as varied from top a join top b on a.rnk < b.rnk where a.price + b.price <= 60 and a.cal_mid + b.cal_mid <= 1500
)
select 'dish' as kind, id as a, -1 as b, score from (select * from again order by score desc, id limit 28) t
union all select 'combination', a, b, round(total / 2 + case when varied then 0.06 else 0 end + 0.12 + case when total_price / 60 between 0.65 and 1 then 0.05 else 0 end + 0.10 + coalesce(0.05 * nc / 2, 0) + 1e-9, 4) from fit"""))  # fmt: skip
def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dishes by the reranked scores, and combinations over these scores."""
    found = encoders.recommend_all(dishes(spark, sf_dir), COMBO_REQUEST, reranker=_RuleModel())
    rows = found.rows.select(F.lit("dish").alias("kind"), F.col("local_id").alias("a"), F.lit(-1).cast("long").alias("b"), "score")
    return rows.unionByName(found.combinations.select(F.lit("combination").alias("kind"), F.element_at("item_ids", 1).alias("a"), F.element_at("item_ids", 2).alias("b"), "score"))


@query("rerank_minmax", statement(DUCK, lambda d: f"{ranked(d)}, {_RERANKED} select id, score as final from again"))
def _minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    from platewise.operators.rerank import rerank

    return rerank(recommend.scored(dishes(spark, sf_dir), REQUEST), "rule_score").select(F.col("local_id").alias("id"), F.col("score").alias("final"))
