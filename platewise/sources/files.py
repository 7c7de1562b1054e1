"""File sources and sinks with declared schemas; every path may be any that Spark reads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType, tag: str | None = None) -> DataFrame:
    """CSV with a header and a declared schema; ``tag`` adds the name of the source file."""
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("escape", '"').csv(path)
    return df.withColumn(tag, F.col("_metadata.file_name")) if tag else df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One record a line; blank lines are skipped by the reader."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_json_items(spark: SparkSession, path: str, item_ddl: str) -> DataFrame:
    """Rows of JSON files that hold a list, an object with a list ``items``, or one object; anything else raises, as does bad JSON."""
    whole = spark.read.text(path, wholetext=True)
    parsed = F.parse_json("value")
    kind, inner = F.schema_of_variant(parsed), F.schema_of_variant(F.try_variant_get(parsed, "$.items", "variant"))
    rows = f"array<struct<{item_ddl}>>"
    bad = F.raise_error(F.lit("a file of items holds neither a list nor an object")).cast(rows)
    listed = (
        F.when(kind.startswith("ARRAY"), F.from_json("value", rows, {"mode": "FAILFAST"}))
        .when(kind.startswith("OBJECT") & inner.startswith("ARRAY"), F.from_json("value", f"struct<items: {rows}>", {"mode": "FAILFAST"})["items"])
        .when(kind.startswith("OBJECT"), F.array(F.from_json("value", f"struct<{item_ddl}>", {"mode": "FAILFAST"})))
        .otherwise(bad)
    )
    return whole.select(F.explode(listed).alias("r")).select("r.*")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads it from."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_if_present(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A report of JSON lines, or no rows where the path is missing; a file that doesn't fit the schema raises when it is read."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_images(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("jpg", "jpeg", "png", "webp", "bmp")) -> DataFrame:
    """Image files by suffix; the content column is only read where it is used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*suffixes))


def parse_boxes(df: DataFrame, line: str) -> DataFrame:
    """Label lines: five tokens are a box; more of odd number are a polygon, reduced to its bounding box."""
    t = F.transform(F.split(F.trim(line), r"\s+"), lambda x: x.cast("double"))
    points = F.slice(t, 2, F.size(t) - 1)
    xs, ys = F.filter(points, lambda _, i: i % 2 == 0), F.filter(points, lambda _, i: i % 2 == 1)
    poly = (F.size(t) > 5) & (F.size(t) % 2 == 1)
    low_x, high_x, low_y, high_y = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    pick = lambda i, other: F.when(F.size(t) == 5, F.get(t, F.lit(i))).when(poly, other).otherwise(F.raise_error(F.concat(F.lit("bad label line: "), line)).cast("double"))
    return df.withColumns({"class_id": F.get(t, F.lit(0)).cast("int"), "xc": pick(1, (low_x + high_x) / 2), "yc": pick(2, (low_y + high_y) / 2), "bw": pick(3, high_x - low_x), "bh": pick(4, high_y - low_y)})


def export_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Write all tables of a snapshot side by side."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")


def import_snapshot(spark: SparkSession, path: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def seed_once(rows: DataFrame, path: str, least: int) -> bool:
    """Write a seed unless the path already holds ``least`` rows; True if it was written."""
    spark = rows.sparkSession
    try:
        if spark.read.parquet(path).limit(least).count() >= least:
            return False
    except AnalysisException:
        pass
    rows.write.mode("overwrite").parquet(path)
    return True


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
