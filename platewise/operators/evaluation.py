"""Classification metrics and row validation.

Metrics start from the counts of (label, pred), one aggregation over the rows; all that follows has a row a class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion_matrix(rows: DataFrame) -> DataFrame:
    """(label, pred, n) of rows with ``label`` and ``pred``."""
    return rows.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """label, tp, fp, fn, support, prec, rec, f1 of each class that is a label or a prediction; 0 where undefined."""
    sides = F.explode(F.array(F.struct(F.col("label").alias("k"), F.lit(1).alias("gold")), F.struct(F.col("pred").alias("k"), F.lit(0).alias("gold"))))
    sums = lambda keep: F.coalesce(F.sum(F.when(keep, F.col("n"))), F.lit(0))
    hit, gold = F.col("label") == F.col("pred"), F.col("s.gold") == 1
    by_class = matrix.withColumn("s", sides).groupBy(F.col("s.k").alias("k")).agg(sums(hit & gold).alias("tp"), sums(~hit & ~gold).alias("fp"), sums(~hit & gold).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return by_class.select(F.col("k").alias("label"), "tp", "fp", "fn", (tp + fn).alias("support"), _share(tp, tp + fp).alias("prec"), _share(tp, tp + fn).alias("rec"), _share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def summary(metrics: DataFrame) -> DataFrame:
    """n, accuracy, macro_f1 and weighted_f1 (by support) in one row."""
    n = F.sum("support")
    return metrics.agg(n.alias("n"), _share(F.sum("tp"), n).alias("accuracy"), F.avg("f1").alias("macro_f1"), _share(F.sum(F.col("f1") * F.col("support")), n).alias("weighted_f1"))


def validation_issues(rows: DataFrame) -> DataFrame:
    """One row an issue: the rows' columns and ``issue``.

    rows: dish_name, price_text, review_reason (blank counts as missing), price_value, confidence, needs_review.
    """
    filled = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    value, review = F.col("price_value").isNotNull(), F.coalesce("needs_review", F.lit(False))
    issues = [
        (~filled("dish_name"), "missing dish_name"),
        (~F.coalesce(F.col("confidence").between(0, 1), F.lit(True)), "confidence out of range"),
        (review & ~filled("review_reason"), "needs_review without review_reason"),
        (~filled("price_text") & value, "price_value without price_text"),
        (filled("price_text") & ~value & ~review, "price_text without price_value and no review flag"),
        (filled("dish_name") & (F.length(F.trim("dish_name")) <= 2), "dish_name too short"),
    ]
    return rows.withColumn("issue", F.explode(F.array_compact(F.array(*(F.when(c, i) for c, i in issues)))))


def _key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\s\u00A0]+", " "))


def normal_price(value: Column) -> Column:
    """A price with two decimals; a comma is a point, what is no number is null."""
    return F.round(F.trim(F.replace(value.cast("string"), F.lit(","), F.lit("."))).try_cast("double"), 2)


def match_items(predicted: DataFrame, gold: DataFrame, page: list[str]) -> DataFrame:
    """Predicted and gold dishes side by side: the k-th of a name on a page meets the k-th; what has no partner stands alone.

    Both: the columns ``page``, position, dish_name, section, price_value, description. Names compare in lower case with single spaces. Gold dishes
    without a name don't count, predicted ones meet nothing. Result: page, ``pred`` and ``gold`` (structs, null where there is none), ``name``.
    """
    fields = ["position", "dish_name", "section", "price_value", "description"]

    def numbered(rows: DataFrame, side: str) -> DataFrame:
        order = Window.partitionBy(*page, "name").orderBy("position")
        return rows.select(*page, _key(F.col("dish_name")).alias("name"), "position", F.struct(*fields).alias(side)).withColumn("place", F.row_number().over(order)).drop("position")

    named = numbered(gold, "gold").where("name <> ''")
    rows = numbered(predicted, "pred")
    met = rows.where("name <> ''").join(named, [*page, "name", "place"], "full")
    empty = rows.where("name = ''").withColumn("gold", F.lit(None).cast(named.schema["gold"].dataType))
    return met.select(*page, "name", "pred", "gold").unionByName(empty.select(*page, "name", "pred", "gold"))


def _verdicts() -> dict[str, Column]:
    """What a matched pair is asked: whether the gold dish has a section, price or description, and whether the predicted one has the same."""
    both = F.col("pred").isNotNull() & F.col("gold").isNotNull()
    out = {"both": both}
    for part, field, value in (("section", "section", _key), ("price", "price_value", normal_price), ("description", "description", _key)):
        want, got = value(F.col(f"gold.{field}")), value(F.col(f"pred.{field}"))
        has = both & (want.isNotNull() if part == "price" else (want != ""))
        out |= {f"has_{part}": has, f"same_{part}": has & want.eqNullSafe(got)}
    return out


def parser_errors(matched: DataFrame, page: list[str]) -> DataFrame:
    """One row an error: page, error_type (six of them), pred_name, gold_name."""
    v = _verdicts()
    pred, gold = F.col("pred.dish_name"), F.col("gold.dish_name")
    none = F.lit(None).cast("string")
    error = lambda kind, a, b: F.struct(F.lit(kind).alias("error_type"), a.alias("pred_name"), b.alias("gold_name"))
    empty = F.col("pred").isNotNull() & (F.col("name") == "")
    kinds = [
        F.when(empty, error("empty_pred_name", none, none)), F.when(~empty & F.col("gold").isNull(), error("false_positive_item", pred, none)), F.when(F.col("pred").isNull(), error("missed_gold_item", none, gold)),
        *(F.when(v[f"has_{p}"] & ~v[f"same_{p}"], error(f"wrong_{p}", pred, gold)) for p in ("section", "price", "description")),
    ]
    return matched.select(*page, F.explode(F.array_compact(F.array(*kinds))).alias("e")).select(*page, "e.*")


def parser_metrics(matched: DataFrame) -> DataFrame:
    """item_tp, item_fp, item_fn, precision, recall and F1, shares of equal sections, prices and descriptions (null where no gold dish has one), and the mean price error of matched pairs."""
    v = _verdicts()
    n = lambda c: F.count(F.when(c, 1))
    error = F.abs(normal_price(F.col("pred.price_value")) - normal_price(F.col("gold.price_value")))
    sums = matched.agg(
        n(v["both"]).alias("item_tp"), n(F.col("pred").isNotNull() & F.col("gold").isNull()).alias("item_fp"), n(F.col("pred").isNull()).alias("item_fn"),
        *(n(v[f"{k}_{p}"]).alias(f"{k}_{p}") for p in ("section", "price", "description") for k in ("has", "same")), F.avg(F.when(v["both"], error)).alias("mae"),
    )
    tp, precision, recall = F.col("item_tp"), _share(F.col("item_tp"), F.col("item_tp") + F.col("item_fp")), _share(F.col("item_tp"), F.col("item_tp") + F.col("item_fn"))
    rate = lambda p: F.round(F.try_divide(F.col(f"same_{p}").cast("double"), F.col(f"has_{p}")), 4)
    f1 = _share(2 * tp, 2 * tp + F.col("item_fp") + F.col("item_fn"))
    return sums.select(
        "item_tp", "item_fp", "item_fn", F.round(precision, 4).alias("item_precision"), F.round(recall, 4).alias("item_recall"), F.round(f1, 4).alias("item_f1"),
        rate("section").alias("section_accuracy"), rate("price").alias("price_accuracy"), rate("description").alias("description_exact_match"), F.round("mae", 4).alias("price_mae"),
    )
