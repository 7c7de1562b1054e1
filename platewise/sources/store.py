"""The store of menu sessions: appends, replace-all import, snapshots with an envelope, versioned references, file discovery."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.operators.enrich import item_text
from platewise.operators.retrieval import hashed_vector

SCHEMA_VERSION = 1
# The names of reviewed annotation files.
GOLD_FILES = ("menu_gold_batch_*_final_reviewed.csv", "menu_gold_batch_*_final.csv", "menu_gold_batch_*_fixed.csv")


def append_session(path: str, sessions: DataFrame, items: DataFrame) -> None:
    """Append sessions (session_id, ...) and their items (session_id, local_id, dish_name, description, section, ...) below ``path``.

    Items with text get a row in ``embeddings``; an item without any has none.
    """
    text = item_text(F.col("dish_name"), F.col("description"), F.col("section"))
    sessions.write.mode("append").parquet(f"{path}/sessions")
    items.write.mode("append").parquet(f"{path}/items")
    # a small file may hold many rows: they are dealt to all tasks before the vectors are made
    items = items.repartition("session_id", "local_id")
    embedded = items.where(text != "").select("session_id", "local_id", text.alias("item_text"), hashed_vector(text).alias("embedding"))
    embedded.write.mode("append").parquet(f"{path}/embeddings")


def export_with_envelope(tables: dict[str, DataFrame], path: str, backend: str = "parquet") -> dict[str, int]:
    """Write the tables below ``path`` and an envelope beside them; the counts are of what was written."""
    counts = {}
    for name, df in tables.items():
        df.write.parquet(f"{path}/tables/{name}")
        counts[name] = df.sparkSession.read.parquet(f"{path}/tables/{name}").count()
    spark = next(iter(tables.values())).sparkSession
    envelope = spark.createDataFrame([(SCHEMA_VERSION, backend, counts)], "schema_version int, vector_backend string, row_counts map<string, long>")
    envelope.withColumn("exported_at", F.current_timestamp()).coalesce(1).write.json(f"{path}/envelope")
    return counts


def import_all(spark: SparkSession, snapshot: str, target: str, defaults: dict[str, dict[str, object]]) -> dict[str, int]:
    """Replace every table of ``defaults`` at ``target`` by the snapshot's; a column that is missing or null takes its default. Returns the counts.

    A table that the snapshot lacks is an error, before anything is replaced.
    """
    read = {name: spark.read.parquet(f"{snapshot}/tables/{name}") for name in defaults}
    counts = {}
    for name, df in read.items():
        for column, value in defaults[name].items():
            df = df.withColumn(column, F.coalesce(F.col(column), F.lit(value)) if column in df.columns else F.lit(value))
        df.write.mode("overwrite").parquet(f"{target}/{name}")
        counts[name] = spark.read.parquet(f"{target}/{name}").count()
    return counts


def refresh_reference(rows: DataFrame, path: str, source_name: str, source_version: str, force: bool = False) -> dict[str, object]:
    """Store a version of the reference unless it is there; ``force`` replaces that version and no other.

    rows: ingredient_key, display_name and figures. Keys are trimmed and lower-cased; rows without a key are left out; no rows at all is an error.
    """
    spark = rows.sparkSession
    at = f"{path}/source_name={source_name}/source_version={source_version}"
    result = {"source_name": source_name, "source_version": source_version}
    if rows.isEmpty():
        raise ValueError("the reference has no items")
    try:
        found = spark.read.parquet(at).count()
    except AnalysisException:
        found = None
    if found is not None and not force:
        return result | {"record_count": found, "skipped": True}
    key = F.lower(F.trim(F.coalesce("ingredient_key", F.lit(""))))
    shown = F.trim(F.coalesce("display_name", F.lit("")))
    kept = rows.withColumns({"ingredient_key": key, "display_name": F.when(shown != "", shown).otherwise(key)}).where("ingredient_key <> ''")
    kept.write.mode("overwrite").parquet(at)
    return result | {"record_count": spark.read.parquet(at).count(), "skipped": False}


def find_files(spark: SparkSession, folder: str, patterns: tuple[str, ...] = GOLD_FILES) -> list[str]:
    """The files below ``folder`` whose name fits one of the patterns, each once, in order; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    fits = F.lit(False)
    for pattern in patterns:
        fits = fits | name.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$")
    return [r.path for r in files.where(fits).distinct().orderBy("path").collect()]


def read_class_names(spark: SparkSession, path: str) -> list[str]:
    """The ``names`` of a label configuration: a list, or names by number in the order of the numbers; none if the key is missing."""
    lines = [r.value for r in spark.read.text(path, wholetext=True).collect()][0].splitlines()
    start = next((i for i, line in enumerate(lines) if re.match(r"names\s*:", line)), None)
    if start is None:
        return []
    bare = lambda v: v.strip().strip("'\"")
    inline = lines[start].split(":", 1)[1].split(" #")[0].strip()
    if inline:
        parts = [p for p in inline.strip("[]{} ").split(",") if p.strip()]
        return [bare(p) for p in parts] if inline.startswith("[") else [bare(v) for _, v in sorted((int(k), v) for k, v in (p.split(":", 1) for p in parts))]
    listed, numbered = [], {}
    for line in lines[start + 1 :]:
        if item := re.match(r"\s*-\s+(.*)", line):
            listed.append(bare(item[1]))
        elif pair := re.match(r"\s+['\"]?(\d+)['\"]?\s*:\s*(.*)", line):
            numbered[int(pair[1])] = bare(pair[2])
        elif line.strip() and not line.lstrip().startswith("#"):
            break
    return listed or [numbered[k] for k in sorted(numbered)]


def last_page_paths(pages: DataFrame, order: str) -> DataFrame:
    """(menu_id, page_id, image_path): the path that the last row of each page by ``order`` has; ids and paths are trimmed."""
    ids = [F.trim(F.col(c).cast("string")).alias(c) for c in ("menu_id", "page_id")]
    return pages.groupBy(*ids).agg(F.max_by(F.trim("image_path"), order).alias("image_path"))


def response_items(text: str, item_ddl: str):
    """Items of a model's answer, as an array column: an object's ``items`` or a list; an object without them and a single value give none, bad JSON raises."""
    body = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.col(text)), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    none = F.array().cast(f"array<struct<{item_ddl}>>")
    parsed = F.try_parse_json(body)
    kind = F.schema_of_variant(parsed)
    listed = F.from_json(body, f"array<struct<{item_ddl}>>")
    held = F.from_json(body, f"struct<items: array<struct<{item_ddl}>>>")["items"]
    bad = F.raise_error(F.lit("the answer is not JSON or its items are no list")).cast(f"array<struct<{item_ddl}>>")
    shape = F.schema_of_variant(F.try_variant_get(parsed, "$.items", "variant"))
    return (
        F.when(parsed.isNull(), bad).when(kind.startswith("ARRAY"), listed)
        .when(kind.startswith("OBJECT") & shape.isNull(), none).when(kind.startswith("OBJECT") & shape.startswith("ARRAY"), held)
        .when(kind.startswith("OBJECT"), bad).otherwise(none)
    )
