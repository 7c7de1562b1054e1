"""Resources of the menu engine: class names as rows, and page rows by local number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from platewise.sources.store import read_class_names


def class_rows(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, class_name) of a label configuration, numbered from 0."""
    return spark.createDataFrame(list(enumerate(read_class_names(spark, path))), "class_id int, class_name string")


def page_number(page_id: Column) -> Column:
    """The number of a local page id (``p7`` or ``7``), null for others."""
    return F.nullif(F.regexp_extract(F.trim(page_id), r"^p?(\d{1,9})$", 1), F.lit("")).cast("int")


def numbered_pages(pages: DataFrame, batch: str, *order: str) -> DataFrame:
    """Pages with ``page_number``, from 1 within their batch by ``order``."""
    return pages.withColumn("page_number", F.row_number().over(Window.partitionBy(batch).orderBy(*order)))


def attach_pages(rows: DataFrame, pages: DataFrame, batch: str, page_id: str) -> DataFrame:
    """Rows with the columns of the page that their local page id numbers; rows without such a page are dropped."""
    own = rows.withColumn("page_number", page_number(F.col(page_id)))
    return own.join(pages, [batch, "page_number"])
