"""Readers over files that are written from the tables first; each SQL twin reads the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from platewise.catalog import query
from platewise.session import table, work_path
from platewise.sources import files, resources

ITEM = "id long, name string, size int"


@query("read_json_items", "select p_partkey as id, p_name as name, p_size as size from part")
def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a brand: lists, objects with items, and for one brand an object a file."""
    path = work_path(spark, "items")
    rows = table(spark, sf_dir, "part").select(F.substring("p_brand", 7, 9).cast("int").alias("k"), F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size")).alias("r"))
    single = F.col("k") == 11
    listed = rows.where(~single).groupBy("k", F.pmod("r.id", F.lit(16)).alias("part")).agg(F.collect_list("r").alias("rs"))
    text = F.when(F.col("k") % 2 == 0, F.to_json("rs")).otherwise(F.to_json(F.struct(F.col("rs").alias("items"))))
    # a file is one text: each row goes to a folder of its own
    named = listed.select(F.concat_ws("-", "k", "part").alias("file"), text.alias("value"))
    named = named.unionByName(rows.where(single).select(F.concat(F.lit("one-"), F.col("r.id").cast("string")).alias("file"), F.to_json("r").alias("value")))
    named.repartition("file").write.partitionBy("file").text(path)
    return files.read_json_items(spark, f"{path}/*/*.txt", ITEM)


@query("read_class_names", "select cast(row_number() over (order by r_name desc) - 1 as int) as class_id, r_name as class_name from region")
def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label configuration out of the regions, read back as numbered classes."""
    path = work_path(spark, "classes")
    names = F.array_join(F.transform(F.sort_array(F.collect_list("r_name"), asc=False), lambda n: F.concat(F.lit("  - "), n)), "\n")
    table(spark, sf_dir, "region").agg(F.concat(F.lit("nc: 5\nnames:\n"), names, F.lit("\npath: x")).alias("value")).write.text(path)
    return resources.class_rows(spark, path)


@query("load_json_resource", "select p_partkey as ingredient, p_size * 10.0::double as kcal, round(p_retailprice / 10, 2) as serving, round(p_size * 10.0::double * round(p_retailprice / 10, 2) / 100, 3) as portion from part")
def _resource(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nutrition resource as a JSON file, read back with the portion of a serving."""
    path = work_path(spark, "resource")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ingredient"), (F.col("p_size") * F.lit(10.0)).alias("kcal"), F.round(F.col("p_retailprice") / 10, 2).alias("serving"))
    rows.groupBy(F.pmod("ingredient", F.lit(64)).alias("k")).agg(F.to_json(F.collect_list(F.struct("ingredient", "kcal", "serving"))).alias("value")).repartition("k").write.partitionBy("k").text(path)
    back = files.read_json_items(spark, f"{path}/*/*.txt", "ingredient long, kcal double, serving double")
    return back.withColumn("portion", F.round(F.col("kcal") * F.col("serving") / 100, 3))


@query("read_reports", "select event_type, count(*) as n, true as found from events group by event_type union all select 'no such report', 0, false")
def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report that is there and one that isn't."""
    path, schema = work_path(spark, "report"), StructType.fromDDL("event_type string, n long")
    files.write_jsonl(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")), path)
    missing = files.read_if_present(spark, f"{path}-missing", schema).agg(F.lit("no such report").alias("event_type"), F.count("*").alias("n"), F.lit(False).alias("found"))
    return files.read_if_present(spark, path, schema).withColumn("found", F.lit(True)).unionByName(missing)


@query("pages_by_number", """
with p as (select l_orderkey, l_suppkey, row_number() over (partition by l_orderkey order by min(l_linenumber), l_suppkey) as page_number from lineitem group by l_orderkey, l_suppkey)
select l.l_orderkey, l.l_linenumber, p.l_suppkey as page_supplier from lineitem l join p on l.l_orderkey = p.l_orderkey and l.l_linenumber + l.l_quantity % 3 - 1 = p.page_number where l.l_linenumber % 4 <> 3
""")
def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows meet the page that their local number names; numbers beyond the batch and bad ids are dropped."""
    lines = table(spark, sf_dir, "lineitem")
    pages = lines.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("first"))
    numbered = resources.numbered_pages(pages, "l_orderkey", "first", "l_suppkey").select("l_orderkey", "page_number", F.col("l_suppkey").alias("page_supplier"))
    number = (F.col("l_linenumber") + F.col("l_quantity") % 3 - 1).cast("int").cast("string")
    page_id = F.when(F.col("l_linenumber") % 4 == 3, F.concat(F.lit("page "), number)).when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" p"), number)).otherwise(number)
    return resources.attach_pages(lines.select("l_orderkey", "l_linenumber", page_id.alias("page_id")), numbered, "l_orderkey", "page_id").select("l_orderkey", "l_linenumber", "page_supplier")
