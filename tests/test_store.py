from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise import catalog, plans
from platewise.operators import cache, cleanup, recommend, rerank, retrieval
from platewise.plans.base import TABLES
from platewise.sources import files, store

SF = "/root/testdata/sf0.001"
plans.load()
TWINS = ["misaligned_repair", "drop_rules", "cache_keys", "cache_lookup", "name_ids", "session_store", "replace_all_import", "versioned_refresh", "upsert_documents", "vector_normalize", "retrieval_documents", "image_rules", "goal_snippets", "import_stats", "semi_join_composite", "cascade_accept"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", TWINS)
def test_query_equals_its_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF), duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    plain = lambda v: None if v is None else round(v, 6) if isinstance(v, float) else str(v)
    a = sorted(str([plain(v) for v in r]) for r in got.collect())
    assert a == sorted(str([plain(r[i]) for i in order]) for r in want.fetchall()) and a


ITEM = "dish_name string, description string, section string, price_value double, price_text string"


def test_a_list_in_place_of_a_name_is_repaired(spark):
    rows = [
        ("rice, beans, salsa and corn", None, "Burrito Bowl", None, None), ("rice, beans, salsa and corn", "hot", "Burrito  Bowl", None, " "), ("rice, beans, salsa and corn", None, "Soups", None, None),
        ("rice, beans, salsa and corn", None, "Burrito Bowl", 9.0, None), ("rice, beans, salsa and corn", None, "Burrito Bowl", None, "9"), ("rice, beans", None, "Burrito Bowl", None, None), (None, None, None, None, None),
    ]
    got = [tuple(r)[:3] for r in cleanup.repair_misaligned(spark.createDataFrame(rows, ITEM).coalesce(1)).collect()]
    assert got[0] == ("Burrito Bowl", "rice, beans, salsa and corn", None) and got[1] == ("Burrito Bowl", "rice, beans, salsa and corn hot", None)
    assert got[2:] == [r[:3] for r in rows[2:]]


def test_items_that_are_no_dishes_go(spark):
    names = [("Starters", "starters", "names its section"), ("Chef Picks", None, "heading"), ("Tomato soup", "Soups", None), ("with basil, cream", "Soups", "description line"), ("from our garden", "Soups", "section line"), ("a b c d e f g h i j", "Soups", "long line"), ("a, b c d", "Soups", "list of ingredients"), (" ", "Soups", "no name")]
    items = spark.createDataFrame([("m", "p", n, None, s, None, None) for n, s, _ in names], "menu_id string, page_id string, " + ITEM)
    roles = spark.createDataFrame([("m", "p", 1, "with basil,  cream", "description", 0.4), ("m", "p", 2, "From our garden", "item_name", 0.2), ("m", "p", 3, "from our garden", "section", 0.2), ("x", "p", 4, "Tomato soup", "section", 0.9)], "menu_id string, page_id string, line_order int, text string, label string, score double")
    got = {r.dish_name: r.removal for r in cleanup.judge_items(items, roles).collect()}
    assert got == {n: why for n, _, why in names}
    assert [r.dish_name for r in cleanup.clean_items(items, roles).collect()] == ["Tomato soup"]
    assert cleanup.clean_items(items.limit(0), roles.limit(0)).count() == 0


def test_keys_do_not_depend_on_the_order_of_json(spark):
    rows = spark.createDataFrame([('{"b": [1, {"z": "é", "a": null}], "a": 1.5}',), ('{"a":1.5,"b":[1,{"a":null,"z":"é"}]}',), (None,)], "v string")
    got = [r[0] for r in rows.select(cache.canonical_json(F.col("v"))).collect()]
    assert got == ['{"a":1.5,"b":[1,{"a":null,"z":"é"}]}'] * 2 + [None]
    key = rows.limit(1).select(cache.cache_key("s", "c", F.col("v"))).first()[0]
    assert key == "s:c:" + hashlib.sha256(json.dumps(json.loads(got[0]), ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_ids_and_hashes(spark):
    row = spark.createDataFrame([("menu:é", list(range(9)) * 4 + list(range(9, 0, -1)) * 4, [1])], "name string, px array<int>, few array<int>")
    got = row.select(cache.name_uuid(F.col("name")), cache.difference_hash(F.col("px")), cache.difference_hash(F.col("few"))).first()
    assert tuple(got) == (str(uuid.uuid5(uuid.NAMESPACE_URL, "menu:é")), "ffffffff00000000", None)


def test_a_cached_value_lives_one_ttl(spark):
    rows = [(1, "k", 0, "set"), (2, "k", 59, "get"), (3, "k", 60, "get"), (4, "k", 100, "set"), (5, "k", 159, "get"), (6, "k", 161, "get"), (7, "j", 5, "get"), (8, "k", 100, "get")]
    at = spark.createDataFrame(rows, "seq long, key string, s long, kind string").select("seq", "key", F.timestamp_seconds("s").alias("at"), "kind", F.lit(None).cast("boolean").alias("enabled"))
    assert {r.seq: r.hit for r in cache.cache_outcomes(at, 60).collect()} == {2: True, 3: False, 5: True, 6: False, 7: False, 8: True}
    assert not any(r.hit for r in cache.cache_outcomes(at, 0).collect())


def bucket_vector(text):
    words = text.lower().split()
    out = np.zeros(retrieval.BUCKETS)
    for term in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
        out[int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % retrieval.BUCKETS] += 1
    return out / (np.linalg.norm(out) or 1)


def test_retrieval_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    words = ["soup", "rice", "milk", "egg", "corn", "fish", "cake"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 6))) for _ in range(60)]
    docs = spark.createDataFrame([(f"d{i:02}", "t", str(i), f"T{i}", t) for i, t in enumerate(texts)], retrieval.DOCUMENT).repartition(3)
    asked = {i: " ".join(rng.choice(words, 3)) for i in range(7)} | {99: " "}
    queries = spark.createDataFrame(list(asked.items()), "local_id long, query_text string")
    got = {(r.local_id, r["rank"]): (r.source_id, r.similarity) for r in retrieval.retrieve(docs, queries, 9, block=3).collect()}
    assert len(got) == 7 * 6
    for q in range(7):
        near = sorted((-float(bucket_vector(texts[i]) @ bucket_vector(asked[q])), i) for i in range(60))
        for place in range(6):
            found, similarity = got[q, place + 1]
            assert abs(similarity + near[place][0]) < 1e-3 and abs(float(bucket_vector(texts[int(found)]) @ bucket_vector(asked[q])) - similarity) < 1e-3
    assert retrieval.retrieve(docs.limit(0), queries).count() == 0 and retrieval.retrieve(docs, queries.limit(0)).count() == 0


def test_documents_of_rules_and_gold(spark):
    rules = {r.doc_key: r.content for r in retrieval.rule_documents(spark).collect()}
    assert rules["ingredient_rule:milk"].endswith("This ingredient implies allergen flag: milk. This ingredient conflicts with dairy_free and vegan.")
    rows = [(1, "m", "a", "Soup", "nan", ["leek", " "]), (2, "m", "a", "Other", None, None), (3, "m", None, "Cake", "Sweet", []), (4, "m", "b", "nan", None, None)]
    gold = retrieval.gold_documents(spark.createDataFrame(rows, "n int, menu_id string, item_id string, dish_name string, section string, explicit_ingredients array<string>"), "n")
    assert sorted((r.source_id, r.title, r.content) for r in gold.collect()) == [
        ("a", "Soup (menu item)", "Annotated menu dish example. Dish name: Soup. Explicit ingredients: leek."), ("m:Cake", "Cake (Sweet)", "Annotated menu dish example. Dish name: Cake. Section: Sweet."),
    ]
    item = spark.createDataFrame([("Soup ", None, "hot", ["leek", "milk"], [], {"vegan": False, "vegetarian": True})], "dish_name string, section string, description string, ingredient_hints array<string>, explicit_allergens array<string>, diet_flags map<string, boolean>")
    assert item.select(retrieval.query_text()).first()[0] == "Soup Soup hot ingredients: leek, milk diet flags: vegetarian"


def test_reranker_features_and_blend(spark):
    request = recommend.Request(craving_text="chicken rice", liked_terms=("chicken",), preferred_sections=("Bowls",))
    rows = spark.createDataFrame([(1, "Chicken rice bowl", "with chicken", "bowls", 5.0, 0.5, 0.2, 0.4, ["a"], ["chicken"]), (2, "Tea", None, None, None, 0.0, 0.1, 0.2, [], [])], "local_id int, dish_name string, description string, section string, price_value double, semantic_score double, rule_score double, score double, reasons array<string>, ingredient_hints array<string>")
    got = {r.local_id: r for r in rerank.rerank_features(rows, request).collect()}
    query, text = "chicken rice chicken Bowls".lower().split(), "chicken rice bowl with chicken bowls".split()
    grams = lambda w: Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])
    a, b = grams(query), grams(text)
    idf = lambda t: 1.0 if t in a and t in b else math.log(1.5) + 1
    norm = lambda c: math.sqrt(sum((n * idf(t)) ** 2 for t, n in c.items()))
    assert abs(got[1].tfidf_score - sum(n * a[t] for t, n in b.items()) / norm(a) / norm(b)) < 1e-9
    assert [got[1][c] for c in rerank.FEATURES[3:]] == [3 / 5, 1.0, 3 / 5, 1.0, 1.0, 1.0, 1.0, 2.0]
    assert [got[2][c] for c in rerank.FEATURES[1:]] == [0.0, 0.1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    best = {r.local_id: (r.score, r.reasons) for r in rerank.rerank(rows, "rule_score").collect()}
    assert best == {1: (0.61, ["a", "learned reranker"]), 2: (0.13, ["learned reranker"])}
    assert {r.score for r in rerank.rerank(rows.withColumn("raw", F.lit(3.0)), "raw").collect()} == {0.435, 0.305}
    assert rerank.rerank(rows.limit(0), "rule_score").count() == 0


def test_learned_reranking_runs_to_its_end(spark):
    got = catalog.QUERIES["rerank_learned"](spark, SF).collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and all(r.reasons.endswith("learned reranker") for r in got)


def test_files_are_found_once_and_in_order(spark, tmp_path):
    for name in ("b/menu_gold_batch_2_final.csv", "menu_gold_batch_1_final_reviewed.csv", "menu_gold_batch_1_fixed.csv", "other.csv"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("a,b\n1,x\n")
    found = store.find_files(spark, f"file://{tmp_path}")
    assert [f.rsplit("/", 1)[1] for f in found] == ["menu_gold_batch_2_final.csv", "menu_gold_batch_1_final_reviewed.csv", "menu_gold_batch_1_fixed.csv"]
    schema = spark.createDataFrame([], "a int, b string").schema
    assert sorted(r.source for r in files.read_csv(spark, f"file://{tmp_path}/menu*.csv", schema, tag="source").collect()) == ["menu_gold_batch_1_final_reviewed.csv", "menu_gold_batch_1_fixed.csv"]


@pytest.mark.parametrize("text", ["names: [dish, 'price']\n", "path: x\nnames:\n  - dish\n  - price\nnc: 2\n", "names:\n  1: price\n  0: dish\n", "names: {1: price, 0: dish}\n"])
def test_class_names(spark, tmp_path, text):
    (tmp_path / "data.yaml").write_text(text)
    assert store.read_class_names(spark, f"file://{tmp_path}/data.yaml") == ["dish", "price"]


def test_last_path_of_a_page_counts(spark):
    rows = spark.createDataFrame([(1, " m", "p", "old"), (2, "m", "p ", "new "), (3, "m", "q", None)], "n int, menu_id string, page_id string, image_path string")
    assert sorted((r.page_id, r.image_path) for r in store.last_page_paths(rows, "n").collect()) == [("p", "new"), ("q", None)]


def test_answers_of_all_shapes(spark):
    rows = spark.createDataFrame([('```json\n{"items": [{"id": 1}]}\n```',), ('[{"id": 2}, {"id": 3}]',), ('{"note": 1}',), ("7",)], "t string").coalesce(1)
    assert [[i.id for i in r[0]] for r in rows.select(store.response_items("t", "id int")).collect()] == [[1], [2, 3], [], []]
    for bad in ("{items", '{"items": 4}'):
        with pytest.raises(Exception, match="no list"):
            spark.createDataFrame([(bad,)], "t string").select(store.response_items("t", "id int")).collect()


def test_equal_texts_are_compared_once_and_all_are_answered(spark, monkeypatch):
    docs = spark.createDataFrame([(f"k{i:02d}", "t", f"s{i}", "n", "rice soup" if i % 2 else "beef stew") for i in range(20)], retrieval.DOCUMENT)
    queries = spark.createDataFrame([(i, "rice soup") for i in range(9)], "local_id long, query_text string")
    scans, share = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: scans.append(1) or share(self, value))
    got = retrieval.retrieve(docs, queries, 3, block=1)
    assert len(scans) == 1
    assert {(r.local_id, r["rank"]): (r.source_id, r.similarity) for r in got.collect()} == {(i, n + 1): (s, 1.0) for i in range(9) for n, s in enumerate(["s1", "s3", "s5"])}
