"""Vector search: exact and indexed nearest neighbours, and similar dishes by the full rule; each SQL twin is a text of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.catalog import QUERIES, query
from platewise.functions.dialect import DUCK
from platewise.operators import recommend, vectors
from platewise.plans import text as _text  # noqa: F401  registers the SQL of vector_knn and cosine_pairs
from platewise.plans.base import statement
from platewise.plans.menu import dishes
from platewise.session import table


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of each row whose id is divisible by 20."""
    rows = _embeddings(spark, sf_dir)
    found = vectors.knn(rows, rows.where("vec_id % 20 = 0"), 5, "vec_id", "embedding", digits=4)
    return found.select(F.col("query_id").alias("q"), F.col("row_id").alias("v"), (F.col("cosine") + 0.0).alias("cosine"), F.col("place").alias("rn"))


QUERIES["vector_knn"] = _knn


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a row whose id is divisible by 20 with another row."""
    rows = _embeddings(spark, sf_dir)
    found = vectors.cosine_pairs(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding")
    return found.select(F.col("query_id").alias("a"), F.col("row_id").alias("b"), "cosine")


QUERIES["cosine_pairs"] = _pairs


@query("vector_knn_index")
def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search in an inverted file, with as many probes as a recall of 0.95 takes on a sample of the queries."""
    rows = _embeddings(spark, sf_dir)
    asked = rows.where("vec_id % 20 = 0")
    index = vectors.InvertedFile(rows, "vec_id", "embedding")
    found = index.search(asked, 5, index.tuned(asked, 5, least=0.95), digits=4)
    return found.select(F.col("query_id").alias("q"), F.col("row_id").alias("v"), (F.col("cosine") + 0.0).alias("cosine"), F.col("place").alias("rn"))


def _dishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dishes(spark, sf_dir).withColumn("ingredient_hints", F.array().cast("array<string>"))


_PLAIN = "trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"
_VALID = f"""(length(n) >= 3 and length(regexp_replace(n, '[^\\p{{L}}]', '', 'g')) >= 3
  and not (not contains(n, ' ') and regexp_matches(n, '\\p{{Lu}}') and regexp_matches(n, '\\p{{Ll}}') and n <> upper(n[1]) || lower(n[2:]))
  and not (coalesce(section, '') <> '' and lower(n) = lower({_PLAIN.format(x='section')}))
  and not (price is null and {_PLAIN.format(x='description')} = '' and (contains(n, ',') or len(string_split(n, ' ')) >= 6)))"""


# names of parsers: single words in mixed case, headings and bare lists are no candidates
_NAMED = "case when id % 23 = 0 then concat('Mc', upper(p_brand)) when id % 29 = 0 then section when id % 31 = 0 then concat(dish_name, ', plain') else dish_name end"


@query("similarity_validity", statement(DUCK, lambda d: f"with c as (select id, {_PLAIN.format(x=_NAMED)} as n, section, description, price from items) select id, {_VALID} as valid from c"))
def _validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _dishes(spark, sf_dir)
    name = F.when(F.col("local_id") % 23 == 0, F.concat(F.lit("Mc"), F.upper("p_brand"))).when(F.col("local_id") % 29 == 0, F.col("section")).when(F.col("local_id") % 31 == 0, F.concat("dish_name", F.lit(", plain"))).otherwise(F.col("dish_name"))
    return items.withColumn("dish_name", name).select(F.col("local_id").alias("id"), recommend.valid_candidate().alias("valid"))


@query("knn_rerank_dedupe", statement(DUCK, lambda d: f"""with e as (
  select id, dish_name, {_PLAIN.format(x='dish_name')} as n, section, description, price, cast(embedding as double[]) as v from items join embeddings on id = vec_id
), c as (
  select q.id as query_id, q.dish_name as query_text, e.*, list_cosine_similarity(q.v, e.v) as cosine from e join e q on q.id % 20 = 0 and q.id <> e.id
), f as (
  select * from c qualify row_number() over (partition by query_id order by cosine desc, id) <= 60
), o as (
  select *, list_distinct(regexp_extract_all(lower(query_text), '[a-z0-9]{{2,}}')) as asked, list_distinct(regexp_extract_all(lower(concat_ws(' ', dish_name, description)), '[a-z0-9]{{2,}}')) as own from f where {_VALID}
), s as (
  select *, len(list_intersect(own, asked)) / greatest(1, len(asked)) as overlap from o
), r as (
  select *, round(0.75 * cosine + 0.25 * overlap, 4) as similarity from s where overlap > 0 or cosine >= 0.45
), u as (
  select * from r qualify row_number() over (partition by query_id, lower(n), lower({_PLAIN.format(x='section')}) order by similarity desc, cosine desc, id) = 1
)
select query_id, cast(row_number() over (partition by query_id order by similarity desc, cosine desc, id) as int) as rank, id as local_id, dish_name, section, similarity
from u qualify row_number() over (partition by query_id order by similarity desc, cosine desc, id) <= 5"""))  # fmt: skip
def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each dish whose id is divisible by 20, the five most similar dishes that have vectors."""
    items = _dishes(spark, sf_dir).join(_embeddings(spark, sf_dir), F.col("local_id") == F.col("vec_id"))
    asked = items.where("local_id % 20 = 0").select("local_id", F.col("dish_name").alias("query_text"), "embedding")
    return recommend.similar_for_queries(items, asked, 5)
