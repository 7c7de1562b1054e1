from __future__ import annotations

import duckdb
import pytest

from platewise import catalog, plans
from platewise.operators import parse
from platewise.sources import files
from platewise.plans.base import TABLES

SF = "/root/testdata/sf0.001"
plans.load()
#: One or two of each family; the driver compares all of them.
CHECKED = ["recommend_topk", "tfidf_scores", "score_blend", "enrich_items", "diet_flags", "filter_constraints", "line_features", "section_predicates", "greedy_match", "latest_per_key", "vector_knn", "scan_formats_roundtrip", "stream_request_stats"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF), duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    plain = lambda v: None if v is None else round(v, 6) if isinstance(v, float) else str(v)
    a = sorted(str([plain(v) for v in r]) for r in got.collect())
    assert a == sorted(str([plain(r[i]) for i in order]) for r in want.fetchall())


def page(spark, texts):
    rows = [("m", "p", i, t, 10.0, 20.0 * i, 200.0, 20.0 * i + 12) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "menu_id string, page_id string, line_order int, text string, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double")


def test_text_parser_builds_dishes(spark):
    got = parse.parse_pages(page(spark, ["STARTERS", "Tomato Soup 120", "with basil, cream and bread", "Garlic Toast", "90", None]), "v2").orderBy("local_id").collect()
    assert [(r.dish_name, r.section, r.price_value) for r in got] == [("Tomato Soup", "STARTERS", 120.0), ("Garlic Toast", "STARTERS", 90.0)]
    assert got[0].description == "with basil, cream and bread" and got[0].parser_confidence == 0.9


def test_layout_parser_reads_columns(spark):
    got = parse.parse_pages(page(spark, ["Desserts", "Chocolate Cake 7.50", "Apple Pie 6"]), "v3").collect()
    assert sorted((r.dish_name, r.price_value) for r in got) == [("Apple Pie", 6.0), ("Chocolate Cake", 7.5)]


def test_boxes_and_polygons(spark):
    rows = files.parse_boxes(spark.createDataFrame([("1 0.5 0.5 0.2 0.1",), ("2 0 0 0.4 0 0.4 0.2",)], "value string"), "value").collect()
    assert (rows[0].class_id, rows[0].bw) == (1, 0.2)
    assert (rows[1].xc, rows[1].yc, rows[1].bw, rows[1].bh) == (0.2, 0.1, 0.4, 0.2)


def test_seed_is_written_once(spark, tmp_path):
    rows = spark.range(5)
    assert files.seed_once(rows, f"file://{tmp_path}/seed", 5) and not files.seed_once(rows, f"file://{tmp_path}/seed", 5)


def test_upsert_replaces_by_key(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, files.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
