"""Recommendation of dishes for a request: constraints, rule and semantic scores, rank, combinations, vector search.

``recommend`` and ``combinations`` take a DataFrame of enriched dishes and a :class:`Request`; filters and the rule score
are one projection over the scan. The semantic score is TF-IDF: terms are aggregated once by (dish, term), document
frequencies once by term, and only the terms of the query enter the dot product. Only the top rows, whose number is a parameter
of the request, are ranked in one task.

Columns of dishes: local_id, dish_name, description, section, price_value, calories_low, calories_mid,
nutrition_confidence, parser_confidence, explicit_allergens array<string>, diet_flags map<string, boolean>. Equal
scores keep the order of local_id.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.operators import vectors
from platewise.operators.enrich import item_text
from platewise.session import Scratch

#: Dishes that combinations are built from.
POOL = 8
#: A term is hot when it holds more than one in so many of all counts.
HOT_SHARE = 1000
_TERM = r"(?U)\b\w\w+\b"


@dataclass(frozen=True)
class Request:
    """What a guest asks for; empty fields ask for nothing."""

    craving_text: str | None = None
    liked_terms: tuple[str, ...] = ()
    disliked_terms: tuple[str, ...] = ()
    excluded_allergens: tuple[str, ...] = ()
    required_diet_flags: tuple[str, ...] = ()
    preferred_sections: tuple[str, ...] = ()
    excluded_sections: tuple[str, ...] = ()
    max_price: float | None = None
    max_calories: float | None = None
    combo_budget: float | None = None
    combo_max_calories: float | None = None
    combo_min_items: int = 2
    combo_max_items: int = 3
    top_k: int = 5

    def query_text(self) -> str:
        return " ".join(p for p in (self.craving_text, " ".join(self.liked_terms), " ".join(self.preferred_sections)) if p).strip()


def _strings(values) -> Column:
    return F.array(*(F.lit(v.lower()) for v in values)) if values else F.array().cast("array<string>")


def dish_text() -> Column:
    return item_text(F.col("dish_name"), F.col("description"), F.col("section"))


def calorie_status(request: Request) -> Column:
    """unknown, within, exceeds or uncertain: a doubtful estimate is not held against a dish."""
    if request.max_calories is None:
        return F.lit("unknown")
    limit = F.lit(float(request.max_calories))
    sure = F.coalesce(F.col("nutrition_confidence"), F.lit(0.0)) >= 0.75
    return F.when(F.col("calories_mid").isNull(), "unknown").when(F.col("calories_mid") <= limit, "within").when(sure | F.coalesce(F.col("calories_low") > limit, F.lit(False)), "exceeds").otherwise("uncertain")


def constraints(request: Request) -> Column:
    """True for the dishes that the request allows."""
    text, keep = F.lower(dish_text()), F.lit(True)
    if request.excluded_allergens:
        own = F.transform(F.coalesce("explicit_allergens", F.array().cast("array<string>")), lambda a: F.lower(a))
        keep = keep & ~F.arrays_overlap(own, _strings(request.excluded_allergens))
    if request.excluded_sections:
        keep = keep & ~F.lower(F.coalesce("section", F.lit(""))).isin(*(s.lower() for s in request.excluded_sections))
    for term in request.disliked_terms:
        keep = keep & ~F.contains(text, F.lit(term.lower()))
    if request.max_price is not None:
        keep = keep & F.coalesce(F.col("price_value") <= float(request.max_price), F.lit(True))
    keep = keep & (calorie_status(request) != "exceeds")
    if request.required_diet_flags:
        on = F.map_keys(F.map_filter(F.coalesce("diet_flags", F.create_map().cast("map<string,boolean>")), lambda _, v: F.coalesce(v, F.lit(False))))
        on = F.transform(on, lambda f: F.lower(f))
        keep = keep & (F.size(F.array_except(_strings(request.required_diet_flags), on)) == 0)
    return keep


def rule_parts(request: Request) -> list[tuple[Column, Column | float, str]]:
    """(condition, points, reason) of each rule."""
    text, status = F.lower(dish_text()), F.col("calorie_status")
    section = F.coalesce("section", F.lit(""))
    parts: list[tuple[Column, Column | float, str]] = []
    if request.preferred_sections:
        parts.append(((section != "") & F.lower(section).isin(*(s.lower() for s in request.preferred_sections)), 0.15, "preferred section"))
    parts.append((F.coalesce("description", F.lit("")) != "", 0.05, "has description"))
    parts.append((F.col("parser_confidence").isNotNull(), 0.15 * F.col("parser_confidence"), "parser confidence"))
    if request.max_price is not None:
        parts.append((F.col("price_value") <= float(request.max_price), 0.10, "within budget"))
    if request.max_calories is not None:
        parts += [(status == "within", 0.14, "within calorie target"), (status == "uncertain", 0.05, "possible calorie fit")]
    parts.append((F.col("nutrition_confidence").isNotNull(), 0.10 * F.col("nutrition_confidence"), "nutrition estimate available"))
    if request.required_diet_flags:
        has = F.lit(False)
        for flag in request.required_diet_flags:
            has = has | F.coalesce(F.element_at("diet_flags", flag), F.lit(False))
        parts.append((has, 0.18, "diet filter match"))
    if request.liked_terms:
        liked = F.lit(False)
        for term in request.liked_terms:
            liked = liked | F.contains(text, F.lit(term.lower()))
        parts.append((liked, 0.20, "liked terms match"))
    return parts


def allowed(items: DataFrame, request: Request) -> DataFrame:
    """The dishes that the request allows, with calorie_status, rule_score and reasons."""
    kept = items.where(constraints(request)).withColumn("calorie_status", calorie_status(request))
    parts = rule_parts(request)
    score = F.lit(0.0)
    for condition, points, _ in parts:
        score = score + F.when(condition, points).otherwise(0.0)
    return kept.withColumns({"rule_score": score, "reasons": F.array_compact(F.array(*(F.when(c, r) for c, _, r in parts)))})


def query_terms(query: str) -> Counter:
    """Words of two characters and more, and pairs of neighbouring ones."""
    words = re.findall(r"\b\w\w+\b", query.lower())
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)])


def tfidf_scores(texts: DataFrame, query: str) -> DataFrame:
    """(local_id, semantic_score) of each (local_id, text) that shares a term with the query: the cosine of TF-IDF rows.

    1- and 2-grams, smooth idf, the query being one of the texts. Counts of (dish, term) and of terms are written once, and no join broadcasts them: a small
    file may hold many rows. Only terms that hold more than one in ``HOT_SHARE`` of the counts, so fewer than that, are broadcast; the others are shuffled.
    """
    own = query_terms(query)
    if not own:
        return texts.select("local_id", F.lit(0.0).alias("semantic_score")).limit(0)
    words = F.regexp_extract_all(F.lower("text"), F.lit(_TERM), F.lit(0))
    split = texts.select("local_id", words.alias("words"))
    rest = F.greatest(F.size("words") - 1, F.lit(0))
    grams = F.concat("words", F.zip_with(F.slice("words", F.lit(1), rest), F.slice("words", F.lit(2), rest), lambda a, b: F.concat_ws(" ", a, b)))
    scratch = Scratch(texts.sparkSession, "tfidf")
    tf = scratch.table(split.select("local_id", F.explode(grams).alias("term")).groupBy("local_id", "term").agg(F.count(F.lit(1)).alias("tf")), "tf")
    df = scratch.table(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    n = texts.count()
    asked = texts.sparkSession.createDataFrame(sorted(own.items()), "term string, q long")
    # the query is one more text: one more document for each of its terms
    idf = F.log((2.0 + n) / (1.0 + F.coalesce("df", F.lit(0)) + F.when(F.col("q").isNotNull(), 1).otherwise(0))) + 1.0
    weights = df.join(F.broadcast(asked), "term", "left").select("term", "df", idf.alias("idf"), F.coalesce("q", F.lit(0)).alias("q"))
    # one row of one number
    known = df.where(F.col("term").isin(*own))
    length = asked.join(F.broadcast(known), "term", "left").agg(F.sqrt(F.sum((F.col("q") * idf) * (F.col("q") * idf))).alias("length"))
    limit = max(1, (df.agg(F.sum("df")).first()[0] or 0) // HOT_SHARE)
    hot = weights.where(F.col("df") > limit)
    spread = tf.join(F.broadcast(hot), "term")
    shuffled = tf.join(F.broadcast(hot.select("term")), "term", "left_anti").join(weights.where(F.col("df") <= limit).hint("merge"), "term")
    x = F.col("tf") * F.col("idf")
    by_dish = spread.unionByName(shuffled).groupBy("local_id").agg(F.sqrt(F.sum(x * x)).alias("norm"), F.sum(x * F.col("q") * F.col("idf")).alias("dot"))
    return by_dish.where("dot > 0").crossJoin(F.broadcast(length)).select("local_id", (F.col("dot") / F.col("norm") / F.col("length")).alias("semantic_score"))


def match_label(score: Column) -> Column:
    return F.when(score >= 0.68, "Strong match").when(score >= 0.40, "Good match").otherwise("Weak match")


def scored_by(items: DataFrame, request: Request, semantic: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Allowed dishes with semantic_score, raw (the blend) and score (rounded to four digits).

    ``semantic`` gives (local_id, semantic_score) of (local_id, text); without it, and for dishes it leaves out, the semantic score is 0.
    """
    kept = allowed(items, request)
    if semantic is None:
        kept = kept.withColumn("semantic_score", F.lit(0.0))
    else:
        kept = kept.join(semantic(kept.select("local_id", dish_text().alias("text"))), "local_id", "left").withColumn("semantic_score", F.coalesce("semantic_score", F.lit(0.0)))
    kept = kept.withColumn("raw", 0.60 * F.col("semantic_score") + 0.40 * F.col("rule_score"))
    return kept.withColumn("score", F.round("raw", 4))


def scored(items: DataFrame, request: Request) -> DataFrame:
    """:func:`scored_by` with TF-IDF."""
    query = request.query_text()
    return scored_by(items, request, (lambda texts: tfidf_scores(texts, query)) if query else None)


def top(rows: DataFrame, k: int) -> DataFrame:
    """The first k rows by score, with their rank; Spark keeps k rows a task."""
    best = rows.orderBy(F.desc("score"), "local_id").limit(max(1, k))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "local_id")))


def recommend(items: DataFrame, request: Request) -> DataFrame:
    """The top_k rows: rank, local_id, dish_name, section, price_value, calories_mid, diet_flags (enabled), match_label, scores, reasons."""
    return ranked_scores(top(scored(items, request), request.top_k))


def ranked_scores(best: DataFrame) -> DataFrame:
    """What is shown of ranked rows."""
    return best.select(
        "rank", "local_id", "dish_name", "section", "price_value", "calories_mid",
        F.map_keys(F.map_filter("diet_flags", lambda _, v: F.coalesce(v, F.lit(False)))).alias("diet_flags"),
        match_label(F.col("raw")).alias("match_label"), "score", F.round("semantic_score", 4).alias("semantic_score"), F.round("rule_score", 4).alias("rule_score"), "reasons",
    )


def combinations(items: DataFrame, request: Request) -> DataFrame:
    """:func:`combinations_of` the scored dishes."""
    return combinations_of(scored(items, request), request)


def combinations_of(rows: DataFrame, request: Request) -> DataFrame:
    """Sets of dishes out of the ``POOL`` best ones within the combination's limits: rank, item_ids, dish_names, sections, totals, score, label, reasons.

    rows: scored dishes, reranked or not. The pool is one row; its subsets are bit masks, so no dish is joined with another.
    """
    pool = top(rows, POOL).agg(F.array_sort(F.collect_list(F.struct("rank", "local_id", "dish_name", "section", "price_value", "calories_mid", "nutrition_confidence", "score"))).alias("pool"))
    least = max(2, request.combo_min_items)
    most = max(least, request.combo_max_items)
    if request.combo_budget is None and request.combo_max_calories is None:
        pool = pool.limit(0)
    masks = pool.select("pool", F.expr("explode(filter(sequence(0, shiftleft(1, size(pool)) - 1), m -> m > 0)) as mask"))
    masks = masks.where(F.bit_count("mask").between(least, most))
    own = masks.select(F.expr("filter(pool, (e, i) -> (mask & shiftleft(1, i)) > 0)").alias("own"))
    values = lambda n: F.transform("own", lambda e: e[n])
    full = lambda n: ~F.exists("own", lambda e: e[n].isNull())
    add = lambda n: F.aggregate(values(n), F.lit(0.0), lambda s, x: s + x)
    sized = own.withColumns({"price": F.when(full("price_value"), add("price_value")), "calories": F.when(full("calories_mid"), add("calories_mid"))})
    if request.combo_budget is not None:
        sized = sized.where(F.col("price") <= float(request.combo_budget))
    if request.combo_max_calories is not None:
        sized = sized.where(F.col("calories") <= float(request.combo_max_calories))
    sized = sized.withColumns({"total_price": F.round("price", 2), "total_calories": F.round("calories", 1), "sections": F.filter(values("section"), lambda s: F.coalesce(s, F.lit("")) != "")})
    parts: list[tuple[Column, Column | float, str]] = [(F.size(F.array_distinct("sections")) >= 2, 0.06, "section diversity")]
    if request.combo_budget is not None:
        ratio = F.col("total_price") / float(request.combo_budget) if request.combo_budget > 0 else F.lit(0.0)
        parts += [(F.col("total_price") <= float(request.combo_budget), 0.12, "within combo budget"), (ratio.between(0.65, 1.0), 0.05, "good budget usage")]
    if request.combo_max_calories is not None:
        parts.append((F.col("total_calories") <= float(request.combo_max_calories), 0.10, "within combo calorie target"))
    parts.append((full("nutrition_confidence"), 0.05 * add("nutrition_confidence") / F.size("own"), "nutrition estimates available"))
    raw = add("score") / F.size("own")
    for condition, points, _ in parts:
        raw = raw + F.when(condition, points).otherwise(0.0)
    # decimal ties round up, whatever the order of the sum
    done = sized.withColumns({"raw": raw, "reasons": F.array_compact(F.array(*(F.when(c, r) for c, _, r in parts)))}).withColumn("score", F.round(F.col("raw") + 1e-9, 4))
    order = [F.desc("score"), F.size("own"), values("rank")]
    best = done.orderBy(*order).limit(max(1, request.top_k)).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return best.select("rank", values("local_id").alias("item_ids"), values("dish_name").alias("dish_names"), "sections", "total_price", "total_calories", "score", match_label(F.col("raw")).alias("match_label"), "reasons")


def valid_candidate() -> Column:
    """Dishes that a vector search may return: a name of three letters that is neither a camel-case token, nor its section, nor a bare list."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), " ", " "), r"\s+", " "))
    name = plain(F.col("dish_name"))
    words = F.size(F.split(name, " "))
    mixed = name.rlike(r"\p{Lu}") & name.rlike(r"\p{Ll}") & (name != F.initcap(name))
    bare = F.col("price_value").isNull() & (plain(F.col("description")) == "") & (F.size(F.coalesce("ingredient_hints", F.array().cast("array<string>"))) == 0)
    section = F.coalesce("section", F.lit(""))
    return (
        (F.length(name) >= 3)
        & (F.length(F.regexp_replace(name, r"[^\p{L}]", "")) >= 3)
        & ~((words == 1) & mixed)
        & ~((section != "") & (F.lower(name) == F.lower(plain(section))))
        & ~(bare & (F.contains(name, F.lit(",")) | (words >= 6)))
    )


def similar_dishes(items: DataFrame, query_vector: list[float], query_text: str, top_k: int = 5) -> DataFrame:
    """(rank, local_id, dish_name, section, similarity) of one query, as in :func:`similar_for_queries`.

    items: dishes with ``embedding array<double>``. max(10, 12 * top_k) rows are fetched, so what follows is small.
    """
    query = F.array(*(F.lit(float(v)) for v in query_vector))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    vector = F.transform("embedding", lambda v: v.cast("double"))
    norm = F.sqrt(total(F.transform(vector, lambda v: v * v))) * float(sum(v * v for v in query_vector) ** 0.5)
    cosine = F.when(norm > 0, total(F.zip_with(vector, query, lambda a, b: a * b)) / norm).otherwise(0.0)
    found = items.withColumn("cosine", cosine).orderBy(F.desc("cosine"), "local_id").limit(fetched(top_k))
    return reranked(found.withColumns({"query_id": F.lit(0), "query_text": F.lit(query_text)}), top_k).drop("query_id")


def fetched(top_k: int) -> int:
    """How many rows are fetched by vector alone."""
    return max(10, 12 * int(top_k))


def similar_for_queries(items: DataFrame, queries: DataFrame, top_k: int = 5) -> DataFrame:
    """(query_id, rank, local_id, dish_name, section, similarity): over-fetch by cosine, filter, blend with token overlap, keep one of each (name, section).

    items: dishes with whole-number ``local_id`` and ``embedding``; queries: local_id (of the query; a dish of that id is left out), query_text, embedding.
    """
    near = vectors.knn(items, queries, fetched(top_k), "local_id", "embedding").drop("place")
    texts = queries.select(F.col("local_id").alias("query_id"), "query_text")
    found = near.join(texts, "query_id").join(items, near["row_id"] == items["local_id"])
    return reranked(found, top_k)


def reranked(found: DataFrame, top_k: int) -> DataFrame:
    """The top_k rows of each query out of those that its vector fetched: query_id, query_text, cosine and the dish's columns."""
    tokens = lambda text: F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0)))
    own, asked = tokens(F.concat_ws(" ", "dish_name", "description")), tokens(F.col("query_text"))
    overlap = F.size(F.array_intersect(own, asked)) / F.greatest(F.lit(1), F.size(asked))
    rows = found.where(valid_candidate()).withColumn("overlap", overlap).where("not (overlap = 0 and cosine < 0.45)")
    rows = rows.withColumn("similarity", F.round(0.75 * F.col("cosine") + 0.25 * F.col("overlap"), 4))
    key = [F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\u00A0]+", " "))) for c in ("dish_name", "section")]
    order = [F.desc("similarity"), F.desc("cosine"), F.col("local_id")]
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id", *key).orderBy(*order))).where("place = 1")
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= max(1, top_k))
    return best.select("query_id", "rank", "local_id", "dish_name", "section", "similarity")
