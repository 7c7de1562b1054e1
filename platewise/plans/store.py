"""Queries of the store, the cache, retrieval, the reranker and the cleaning of items; each SQL twin is a text of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.catalog import ORACLES, query
from platewise.functions.dialect import DUCK, SPARK
from platewise.operators import cache, cleanup, recommend, rerank, retrieval
from platewise.operators.prompts import GOALS
from platewise.plans.base import sql_query, statement, views
from platewise.plans.menu import REQUEST, dishes
from platewise.session import materialize, table, work_path
from platewise.sources import files, store

#: Dishes with the faults of a parser: lists in place of names, headings, dishes as sections.
PARSED = lambda d: """
select id, p_brand as menu_id, case when id % 3 = 0 then concat(dish_name, ', ', coalesce(description, 'plain')) when id % 17 = 0 then upper(p_brand) when id % 19 = 0 then 'House Specials' else dish_name end as dish_name,
  case when id % 2 = 0 then description end as description,
  case when id % 4 = 0 then upper(coalesce(section, '')) when id % 4 = 1 then 'Grilled  Chicken' when id % 4 = 2 then 'Soups' else section end as section, case when id % 5 = 0 then price end as price_value from items"""  # noqa: E731
ROLES = "select menu_id, id as line_order, dish_name as text, case when id % 5 < 2 then 'Section' when id % 5 < 4 then 'description' else 'item_name' end as label, cast(id % 7 as double) / 7 as score from parsed"
GENERIC = ", ".join(f"'{s}'" for s in cleanup.GENERIC_SECTIONS)


def _shape(x: str) -> str:
    return f"""(regexp_full_match({x}, '[A-Za-z][A-Za-z&/'' +.-]{{2,}}') and len(string_split({x}, ' ')) <= 6
    and (length(regexp_replace({x}, '[^A-Z]', '', 'g')) >= 0.55 * length(regexp_replace({x}, '[^A-Za-z]', '', 'g')) or not regexp_matches({x}, '(^|[^A-Za-z])[a-z]') and not regexp_matches({x}, '[A-Za-z][A-Z]')))"""


_plain = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"
FIXED = f"""parsed as ({PARSED(DUCK)}),
p as (select *, {_plain('dish_name')} as n, {_plain('description')} as e, {_plain('section')} as s from parsed),
w as (select *, s <> '' and price_value is null and contains(n, ',') and len(string_split(n, ' ')) >= 4 and {_shape('s')} and trim(regexp_replace(lower(s), '[^a-z]+', ' ', 'g')) not in ({GENERIC}) as wrong from p),
fixed as (select id, menu_id, price_value, case when wrong then s else dish_name end as dish_name, case when wrong then n || case when e <> '' then ' ' || e else '' end else description end as description, case when not wrong then section end as section from w)"""


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql(statement(SPARK, PARSED))


@query("misaligned_repair", statement(DUCK, lambda d: f"with {FIXED} select id, dish_name, description, section from fixed -- items".replace(" -- items", "")))
def _repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.repair_misaligned(_parsed(spark, sf_dir)).select("id", "dish_name", "description", "section")


@query("drop_rules", statement(DUCK, lambda d: f"""with {FIXED}, roles as ({ROLES}),
r as (select menu_id, key, label, row_number() over (partition by menu_id, key order by score desc, line_order desc) as rn from (select *, lower({_plain('text')}) as key from roles) t),
f as (select fixed.*, {_plain('dish_name')} as n, {_plain('section')} as s, price_value is null and {_plain('description')} = '' as bare, coalesce(lower(label), '') as role
  from fixed left join r on r.rn = 1 and r.menu_id = fixed.menu_id and r.key = lower({_plain('dish_name')}) and r.key <> '')
select id, case when n = '' then 'no name' when bare and s <> '' and lower(n) = lower(s) then 'names its section' when bare and role = 'section' then 'section line'
  when bare and role = 'description' and (contains(n, ',') or len(string_split(n, ' ')) >= 5) then 'description line' when bare and contains(n, ',') and len(string_split(n, ' ')) >= 4 then 'list of ingredients'
  when bare and s = '' and {_shape('n')} then 'heading' when bare and len(string_split(n, ' ')) >= 10 then 'long line' else 'keep' end as verdict from f"""))
def _drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _parsed(spark, sf_dir)
    items.createOrReplaceTempView("parsed")
    return cleanup.judge_items(items, spark.sql(ROLES), ("menu_id",)).select("id", F.coalesce("removal", F.lit("keep")).alias("verdict"))


KEYS = "concat('{{\"key_context\":{{\"engine\":\"tfidf\",\"model\":null}},\"payload\":{{\"event\":\"', event_type, '\",\"props\":', {props}, ',\"user\":', cast(user_id as varchar), '}}}}')"


@query("cache_keys", f"select event_id, 'dishes:menu:' || sha256({KEYS.format(props=chr(39) + '{' + chr(34) + 'k' + chr(34) + ':' + chr(39) + ' || json_extract_string(props, ' + chr(39) + '$.k' + chr(39) + ') || ' + chr(39) + '}' + chr(39))}) as cache_key from events")
def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.concat(F.lit('{"user": '), F.col("user_id").cast("string"), F.lit(', "props": '), F.col("props"), F.lit(', "event": "'), F.col("event_type"), F.lit('"}'))
    context = F.lit('{"model": null, "engine": "tfidf"}')
    return table(spark, sf_dir, "events").select("event_id", cache.cache_key("dishes", "menu", payload, context).alias("cache_key"))


@query("cache_lookup", """
with o as (select event_id, user_id, epoch_us(ts) as us, event_type = 'view' as store from events where event_type <> 'view' or user_id % 10 <> 0),
l as (select *, last_value(case when store then us end ignore nulls) over (partition by user_id order by us, event_id rows between unbounded preceding and 1 preceding) as stored from o)
select event_id, user_id, coalesce(us < stored + 1800000000, false) as hit from l where not store""")
def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "set").otherwise("get")
    operations = events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.col("ts").alias("at"), kind.alias("kind"), (F.col("user_id") % 10 != 0).alias("enabled"))
    return cache.cache_outcomes(operations, 1800).select(F.col("seq").alias("event_id"), F.col("key").alias("user_id"), "hit")


@query("name_ids", f"""
with h as (select p_partkey, sha1(unhex('{cache.NAMESPACE_URL}') || encode('dish:' || cast(p_partkey as varchar))) as x from part)
select p_partkey, concat_ws('-', x[1:8], x[9:12], '5' || x[14:16], ['8', '9', 'a', 'b'][cast('0x' || x[17:17] as int) % 4 + 1] || x[18:20], x[21:32]) as dish_id from h""")
def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", cache.name_uuid(F.concat(F.lit("dish:"), F.col("p_partkey").cast("string"))).alias("dish_id"))


PART_OF = "select id, p_brand, case when id % 10 <> 0 then dish_name end as dish_name, case when id % 10 <> 0 then description end as description, case when id % 10 <> 0 then section end as section from items"


@query("session_store", statement(DUCK, lambda d: f"select p_brand as session_id, 2 as n_sessions, 2 * count(*) as n_items, 2 * count(case when concat(dish_name, description, section) <> '' then 1 end) as n_embeddings from ({PART_OF}) i group by p_brand"))
def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    items = spark.sql(statement(SPARK, lambda d: PART_OF)).withColumnsRenamed({"p_brand": "session_id", "id": "local_id"})
    path = work_path(spark, "store")
    for run in (1, 2):
        store.append_session(path, items.select("session_id").distinct().withColumn("run", F.lit(run)), items.withColumn("run", F.lit(run)))
    n = lambda name: spark.read.parquet(f"{path}/{name}").groupBy("session_id").agg(F.count(F.lit(1)).alias(f"n_{name}"))
    return n("sessions").join(n("items"), "session_id").join(n("embeddings"), "session_id", "left").fillna(0, ["n_embeddings"])


@query("replace_all_import", "select 'customer' as name, count(*) as n, cast(sum(c_custkey) as bigint) as checksum, count(*) as defaulted from customer union all select 'supplier', count(*), cast(sum(s_suppkey) as bigint), 0 from supplier")
def _replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot, target = work_path(spark, "snapshot"), work_path(spark, "restored")
    store.export_with_envelope({"customer": table(spark, sf_dir, "customer").drop("c_acctbal"), "supplier": table(spark, sf_dir, "supplier")}, snapshot)
    defaults = {"customer": {"c_acctbal": -1.0}, "supplier": {"s_name": "unknown"}}
    for _ in range(2):
        store.import_all(spark, snapshot, target, defaults)
    back = lambda name, key, value, default: spark.read.parquet(f"{target}/{name}").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(key).alias("checksum"), F.count(F.when(F.col(value) == default, 1)).alias("defaulted"))
    return back("customer", "c_custkey", "c_acctbal", -1.0).unionByName(back("supplier", "s_suppkey", "s_name", "unknown")).select("name", "n", "checksum", "defaulted")


@query("versioned_refresh", "select 'v1' as source_version, lower(p_name) as ingredient_key, count(*) as n, max(p_size) + 1 as most from part group by 2 union all select 'v2', lower(p_name), count(*), max(p_size) from part where p_size > 25 group by 2")
def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, path = table(spark, sf_dir, "part"), work_path(spark, "reference")
    rows = part.select(F.concat(F.lit(" "), F.upper("p_name")).alias("ingredient_key"), F.lit(None).cast("string").alias("display_name"), "p_size")
    store.refresh_reference(rows, path, "curated", "v1")
    store.refresh_reference(rows.where("p_size > 25"), path, "curated", "v2")
    store.refresh_reference(rows.limit(1), path, "curated", "v2")
    store.refresh_reference(rows.withColumn("p_size", F.col("p_size") + 1), path, "curated", "v1", force=True)
    return spark.read.parquet(path).groupBy("source_version", "ingredient_key").agg(F.count(F.lit(1)).alias("n"), F.max("p_size").alias("most"))


@query("upsert_documents", "select doc_id, case when doc_id % 4 = 0 then 'v2:' || md5(text) else md5(text) end as body from documents union all select doc_id + 1000000000000, 'new:' || md5(text) from documents where doc_id % 6 = 1")
def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("body"))
    changed = old.where("doc_id % 4 = 0").withColumn("body", F.concat(F.lit("v2:"), "body"))
    added = old.where("doc_id % 6 = 1").select((F.col("doc_id") + 1000000000000).alias("doc_id"), F.concat(F.lit("new:"), "body").alias("body"))
    return files.upsert(old, changed.unionByName(added), "doc_id")


@query("vector_normalize", """
with w as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings), l as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as len from w)
select vec_id, len(e) as dims, round(e[1] / case when len = 0 then 1 else len end, 6) as first, round(e[len(e)] / case when len = 0 then 1 else len end, 6) as last,
  round(sqrt(list_sum(list_transform(e, lambda x: x * x))) / case when len = 0 then 1 else len end, 6) as length from l""")
def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", retrieval.unit(F.col("embedding")).alias("u"))
    length = F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, v: s + v * v))
    return rows.select("vec_id", F.size("u").cast("long").alias("dims"), F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.element_at("u", -1), 6).alias("last"), F.round(length, 6).alias("length"))


RULES = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in r) + ")" for r in retrieval.rules())


@query("retrieval_documents", statement(DUCK, lambda d: f"""
with gold as (select 'annotated_menu_item:' || id as doc_key, 'annotated_menu_item' as source_type, cast(id as varchar) as source_id, dish_name || ' (' || coalesce(nullif(section, ''), 'menu item') || ')' as title,
  'Annotated menu dish example. Dish name: ' || dish_name || '.' || coalesce(' Section: ' || nullif(section, '') || '.', '') || coalesce(' Description: ' || description || '.', '') || coalesce(' Explicit allergens: ' || nullif(allergen, '') || '.', '') as content from items)
select doc_key, source_type, source_id, md5(title) as title, md5(content) as content from (select * from gold union all select * from (values {RULES}) r) a"""))
def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence_documents(spark, sf_dir).select("doc_key", "source_type", "source_id", F.md5("title").alias("title"), F.md5("content").alias("content"))


def _evidence_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dishes(spark, sf_dir).withColumn("item_id", F.col("local_id").cast("string"))
    return retrieval.all_documents(spark, retrieval.gold_documents(rows, "local_id"))


@query("retrieve_evidence")
def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dish whose id is divisible by 20 asks, all documents answer."""
    asked = dishes(spark, sf_dir).where("local_id % 20 = 0").withColumn("ingredient_hints", F.array().cast("array<string>"))
    return retrieval.retrieve(_evidence_documents(spark, sf_dir), asked.select("local_id", retrieval.query_text().alias("query_text")))


@query("rerank_learned")
def _rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole recommendation with a model of trees: it learns here to tell dishes that name a liked term."""
    rows = materialize(rerank.rerank_features(recommend.scored(dishes(spark, sf_dir), REQUEST), REQUEST), "features")
    liked = F.lit(0.0)
    for term in REQUEST.liked_terms:
        liked = liked + F.contains(F.lower("dish_name"), F.lit(term)).cast("double")
    labelled = rows.withColumn("label", liked)
    model = rerank.train_reranker(labelled, "label", trees=5, depth=3)
    best = rerank.rerank(model.transform(labelled), "prediction")
    return recommend.top(best, REQUEST.top_k).select("rank", F.col("local_id").alias("id"), "dish_name", "score", "match_label", F.array_join("reasons", "|").alias("reasons"))


sql_query("image_rules", lambda d: f"""
with i as (select p_partkey, p_size * 60 as w, cast(floor(p_retailprice) as int) as h, p_size % 15 as n_lines, cast(p_partkey % 100 as double) / 100 as conf, p_partkey % 3 <> 0 as ok, cast(p_size as double) / 64 as bw, cast(p_partkey % 7 as double) / 8 as bh from part)
select p_partkey, round(w * bw, 4) as box_w, round(h * bh, 4) as box_h, round(bw * bh, 6) as box_share, greatest(w, h) > 2200 or w * h > 2200000 as large,
  (n_lines >= 12 and conf >= 0.55e0) or (n_lines >= 8 and (conf >= 0.68e0 or w * h >= 2000000)) as accepted, ok and least(w, h) >= 320 as eligible from i""")
_goal = lambda words, said: "case when " + " or ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in words) + f" then '{said}' end"
sql_query("goal_snippets", lambda d: f"select conv_id, turn, {d.join(d.compact(*(_goal(w, s) for w, s in GOALS)), '; ')} as snippets from conversations")
sql_query("import_stats", lambda d: "select source, count(*) as n_rows, count(distinct concat(lang, ':', cast(n_chars as varchar(20)))) as n_pages from documents group by source")
