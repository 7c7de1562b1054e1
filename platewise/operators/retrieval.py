"""Evidence for dishes: rule and gold documents, hashed embeddings, the nearest documents of each dish.

Embeddings are column expressions (md5 buckets of words and word pairs). Documents are scanned once for each block of
queries: a task multiplies its batches with the block's matrix and keeps the best few a query, so only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from platewise.functions import lexicon as L
from platewise.operators.cleanup import bound, plain
from platewise.session import Scratch, work_path

BUCKETS = 256
#: Queries whose vectors are in memory at once (a parameter of memory, not of the result).
BLOCK = 4096
#: Vectors that meet a block at once (memory as well).
ROWS = 1024
DOCUMENT = "doc_key string, source_type string, source_id string, title string, content string"
# Fixed value: the policy that the diet flags follow.
DIET_POLICY = (
    "Vegetarian excludes meat and seafood ingredients. Vegan excludes all vegetarian conflicts plus milk, egg, and honey. "
    "Gluten_free excludes wheat. Dairy_free excludes milk."
)
# What an ingredient's rule adds for the groups that it is in.
CONFLICTS = [
    (L.MEAT, "This ingredient is not vegetarian or vegan."),
    (L.SEAFOOD, "This ingredient is seafood and not vegetarian or vegan."),
    (L.GLUTEN, "This ingredient conflicts with gluten_free."),
    (["milk"], "This ingredient conflicts with dairy_free and vegan."),
    (["egg"], "This ingredient conflicts with vegan."),
]


def _rule(kind: str, key: str, title: str, content: str) -> tuple[str, ...]:
    return f"{kind}:{key}", {"diet_policy": "policy_rule"}.get(kind, kind), {"diet_policy": "derived_diet_flags"}.get(kind, key), title, content


def rules() -> list[tuple[str, ...]]:
    """The documents that the word lists give: ingredients, the diet policy, calorie ranges and adjustments."""
    out = []
    for name in sorted(L.INGREDIENT_KEYWORDS):
        parts = [f"Ingredient keyword rule for {name}.", f"Detect this ingredient when menu text mentions: {', '.join(L.INGREDIENT_KEYWORDS[name])}."]
        parts += [f"This ingredient implies allergen flag: {name}."] if name in L.ALLERGENS else []
        parts += [said for group, said in CONFLICTS if name in group]
        out.append(_rule("ingredient_rule", name, f"Ingredient rule: {name}", " ".join(parts)))
    out.append(_rule("diet_policy", "derived_flags", "Diet flag derivation policy", DIET_POLICY))
    for words, (low, mid, high) in L.CATEGORY_RULES:
        listed = ", ".join(words)
        out.append(_rule("calorie_rule", "_".join(words), f"Calorie base range: {listed}", f"Base calorie heuristic for dishes matching keywords {listed} is low={low}, mid={mid}, high={high}."))
    for name, (low, mid, high) in sorted(L.CALORIE_ADJUSTMENTS.items()):
        said = f"When ingredient hint {name} is present, add approximately low={low}, mid={mid}, high={high} calories to the base estimate."
        out.append(_rule("calorie_adjustment", name, f"Calorie adjustment: {name}", said))
    return out


def rule_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rules(), DOCUMENT)


def cleaned(text: Column) -> Column:
    """Trimmed; null, blank and ``nan`` are empty."""
    trimmed = F.trim(F.coalesce(text.cast("string"), F.lit("")))
    return F.when(F.lower(trimmed) == "nan", "").otherwise(trimmed)


def gold_documents(rows: DataFrame, order: str) -> DataFrame:
    """One document an annotated dish; rows without a name give none, of equal keys the first by ``order`` counts.

    rows: menu_id, item_id, dish_name, section, description, explicit_ingredients and explicit_allergens array<string>,
    price_text, qa_note, review_reason; missing columns count as empty.
    """
    text = lambda c: cleaned(F.col(c)) if c in rows.columns else F.lit("")
    listed = lambda c: F.array_join(F.filter(F.transform(F.col(c), lambda v: F.trim(v)), lambda v: v != ""), ", ") if c in rows.columns else F.lit("")
    said = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value, F.lit(".")))
    name, section = text("dish_name"), text("section")
    source = F.when(text("item_id") != "", text("item_id")).otherwise(F.concat(text("menu_id"), F.lit(":"), name))
    content = F.concat_ws(
        " ", F.lit("Annotated menu dish example."), said("Dish name", name), said("Section", section), said("Description", text("description")),
        said("Explicit ingredients", listed("explicit_ingredients")), said("Explicit allergens", listed("explicit_allergens")),
        said("Observed menu price text", text("price_text")), said("QA note", text("qa_note")), said("Review note", text("review_reason")),
    )
    title = F.concat(name, F.lit(" ("), F.when(section != "", section).otherwise("menu item"), F.lit(")"))
    docs = rows.where(name != "").select(
        F.col(order).alias("place"), F.concat(F.lit("annotated_menu_item:"), source).alias("doc_key"), F.lit("annotated_menu_item").alias("source_type"), source.alias("source_id"), title.alias("title"), content.alias("content")
    )
    first = docs.groupBy("doc_key").agg(F.min_by(F.struct("source_type", "source_id", "title", "content"), F.struct("place", "content")).alias("d"))
    return first.select("doc_key", "d.*")


def all_documents(spark: SparkSession, gold: DataFrame) -> DataFrame:
    """Rules and gold documents; of equal keys the rule counts. The rules are a fixed short list, so they are broadcast."""
    fixed = rule_documents(spark)
    return fixed.unionByName(gold.join(F.broadcast(fixed.select("doc_key")), "doc_key", "left_anti"))


def query_text() -> Column:
    """What a dish asks for: its name twice, section, description and the labelled lists that aren't empty.

    Columns: dish_name, section, description, ingredient_hints, explicit_allergens array<string>, diet_flags map<string, boolean>.
    """
    part = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.trim(c))
    listed = lambda label, a: F.when(F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0, F.concat(F.lit(label), F.array_join(a, ", ")))
    flags = F.map_keys(F.map_filter("diet_flags", lambda _, v: F.coalesce(v, F.lit(False))))
    flagged = F.when(F.size(F.coalesce(F.map_keys("diet_flags"), F.array().cast("array<string>"))) > 0, F.trim(F.concat(F.lit("diet flags: "), F.array_join(flags, ", "))))
    name = part(F.col("dish_name"))
    return F.trim(F.concat_ws(" ", name, name, part(F.col("section")), part(F.col("description")), listed("ingredients: ", F.col("ingredient_hints")), listed("allergens: ", F.col("explicit_allergens")), flagged))


def unit(vector: Column) -> Column:
    """The vector over its length, in doubles; a vector of zeros stays as it is."""
    length = lambda w: F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, v: s + v * v))
    over = lambda w: bound(length(w), lambda n: F.transform(w, lambda v: v / F.when(n == 0, 1.0).otherwise(n)))
    return bound(F.transform(vector, lambda v: v.cast("double")), over)


def with_pairs(words: Column) -> Column:
    """The words, then each word with the next one."""
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    return F.concat(words, F.zip_with(F.slice(words, 1, rest), F.slice(words, 2, rest), lambda a, b: F.concat_ws(" ", a, b)))


def hashed_vector(text: Column) -> Column:
    """Counts of the md5 buckets of words and pairs of words, over their length; a text without words gives zeros."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    bucket = lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % BUCKETS).cast("int")
    return _counted(bound(words, lambda w: F.transform(with_pairs(w), lambda t: bucket(t))))


@F.pandas_udf(ArrayType(DoubleType()))
def _counted(found: pd.Series) -> pd.Series:
    """Counts of each bucket over their length, by row; some rows at a time."""
    out = []
    for at in range(0, len(found), ROWS):
        some = found.iloc[at : at + ROWS]
        sizes = np.array([len(x) for x in some])
        place = np.repeat(np.arange(len(some)) * BUCKETS, sizes) + np.concatenate(some.to_list()).astype(np.int64)
        counts = np.bincount(place, minlength=len(some) * BUCKETS).reshape(-1, BUCKETS).astype(float)
        length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        out += list(counts / np.where(length > 0, length, 1.0))
    return pd.Series(out, index=found.index, dtype=object)


def _best(ids: np.ndarray, matrix: np.ndarray, k: int):
    """A task's k best vectors of each query, and those equal to the last of them; some rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, near, key = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        least = np.full(len(matrix), -np.inf)
        for batch in batches:
            column = batch.column("embedding")
            vectors = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            keys = batch.column("vector_id").to_numpy()
            for at in range(0, len(vectors), ROWS):
                product = matrix @ vectors[at : at + ROWS].T
                if product.shape[1] > k:
                    least = np.maximum(least, np.partition(product, -k, axis=1)[:, -k])
                i, j = np.nonzero(product >= least[:, None])
                q, near, key = np.append(q, i), np.append(near, product[i, j]), np.append(key, keys[at + j])
                if len(q) > 4 * k * len(matrix):
                    q, near, key, least = _kept(q, near, key, k, least)
        q, near, key, _ = _kept(q, near, key, k, least)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(near), pa.array(key)], ["query_id", "similarity", "vector_id"])

    return run


def _kept(q: np.ndarray, near: np.ndarray, key: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query and what equals the last of them, and these last values."""
    order = np.lexsort((-near, q))
    q, near, key = q[order], near[order], key[order]
    begin = np.searchsorted(q, np.arange(len(least)))
    full = np.searchsorted(q, np.arange(len(least)), "right") - begin >= k
    least = least.copy()
    least[full] = np.maximum(least[full], near[begin[full] + k - 1])
    use = near >= least[q]
    return q[use], near[use], key[use], least


def retrieve(documents: DataFrame, queries: DataFrame, top_k: int = 3, block: int = BLOCK) -> DataFrame:
    """(local_id, rank, source_type, source_id, title, similarity, content_preview): the nearest documents of each query text.

    queries: local_id (without repeats), query_text; a blank text finds nothing. ``top_k`` is kept between 1 and 6; the preview has 280 characters.
    Of equal similarities the smaller doc_key comes first. Equal texts have one vector: only different texts of queries meet different texts of
    documents, and of the documents of one text the first k by doc_key can be found. Each block of texts of queries scans these vectors once.
    """
    scratch, k = Scratch(documents.sparkSession, "evidence"), max(1, min(int(top_k), 6))
    spark = documents.sparkSession
    asked = scratch.table(queries.where(plain(F.col("query_text")) != "").select("local_id", F.unhex(F.md5("query_text")).alias("asked"), "query_text"), "asked")
    own = scratch.table(documents.select("doc_key", F.unhex(F.md5(F.coalesce("content", F.lit("")))).alias("said"), F.coalesce("content", F.lit("")).alias("content")), "said")
    vectors = own.groupBy("said").agg(F.first("content").alias("content")).select("said", F.monotonically_increasing_id().alias("vector_id"), hashed_vector(F.col("content")).alias("embedding"))
    vectors = scratch.table(vectors, "vectors")
    texts = asked.groupBy("asked").agg(F.first("query_text").alias("query_text")).select("asked", F.monotonically_increasing_id().alias("query_id"), hashed_vector(F.col("query_text")).alias("vector"))
    texts = scratch.table(texts, "texts")
    blocks = max(1, -(-texts.count() // block))
    texts = scratch.table(texts.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).repartition(blocks, "part"), "blocks")
    path = work_path(spark, "nearest")
    schema = "query_id long, similarity double, vector_id long"
    spark.createDataFrame([], schema).write.parquet(path)
    for part in range(blocks):
        rows = texts.where(F.col("part") == part).select("query_id", "vector").toArrow()
        if rows.num_rows:
            matrix = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
            shared = spark.sparkContext.broadcast((rows["query_id"].to_numpy(), matrix))
            vectors.select("vector_id", "embedding").mapInArrow(lambda batches, shared=shared: _best(*shared.value, k)(batches), schema).write.mode("append").parquet(path)
            shared.unpersist()
    # of one text's documents the first k, then the first k of all of a query's documents
    first = Window.partitionBy("said").orderBy("doc_key")
    members = own.select("said", "doc_key").withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).join(vectors.select("said", "vector_id"), "said").select("vector_id", "doc_key")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_key")
    found = spark.read.schema(schema).parquet(path).hint("merge").join(members, "vector_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("vector_id")
    each = asked.select("local_id", "asked").join(texts.select("asked", "query_id").hint("merge"), "asked").join(best.hint("merge"), "query_id")
    said = documents.select("doc_key", "source_type", "source_id", "title", F.substring("content", 1, 280).alias("content_preview"))
    return each.join(said.hint("merge"), "doc_key").select("local_id", "rank", "source_type", "source_id", "title", F.round("similarity", 4).alias("similarity"), "content_preview")
