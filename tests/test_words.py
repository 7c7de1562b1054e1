"""Word measures inside Arrow batches, against the SQL text and by hand."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__

ODD = ["Soup", "soup", "", " - ", "12345678.90 USD ", "€ 5,5", "a 1234", "1234 rub", "x  99999.5£", "the 3 Kelvin K", "with  rice\tand rice", "12,345", "7 8", "naïve café 5\r", "1000", "9999.", "a" * 60, "no price 12 eur x"]


def twin(spark, name, tables):
    """Rows of a query and of its SQL over given tables."""
    for n, frame in tables.items():
        frame.createOrReplaceTempView(n)
    con = duckdb.connect()
    for n, frame in tables.items():
        con.register(n, frame.toArrow())
    return sorted(map(str, con.sql(__spark_entry__.oracle_sql()[name]).fetchall()))


@pytest.fixture
def odd(spark, tmp_path):
    docs = [(i, "\n".join(ODD[i:] + ODD[:i])) for i in range(4)] + [(0, "the\nSoup"), (0, "xyz\nno"), (99, None)]
    tables = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string"),
        "benchmark": spark.createDataFrame([(20, "Soup"), (40, "rice and with beans"), (60, "--"), (80, "naïve"), (20, "kelvin"), (5, "x")], "item_id long, text string"),
        "part": spark.createDataFrame([(1, "soup soup", "B#1"), (1, "rice", "B#2 x"), (2, None, "b"), (3, "", ""), (None, "kelvin", "B")], "p_partkey long, p_name string, p_brand string"),
    }
    for n, frame in tables.items():
        frame.write.parquet(f"{tmp_path}/{n}.parquet")
    return tmp_path, tables


@pytest.mark.parametrize("name", ["price_extraction", "dice_similarity", "hashing_embeddings"])
def test_odd_rows_as_in_sql(spark, odd, name, monkeypatch):
    path, tables = odd
    monkeypatch.setattr("platewise.plans.base.TABLES", tuple(tables))
    got = sorted(str(tuple(r)) for r in __spark_entry__.queries()[name](spark, str(path)).collect())
    assert got == twin(spark, name, tables)


@pytest.mark.parametrize("many", [1, 4096])
def test_every_text_is_asked(spark, odd, monkeypatch, many):
    path, tables = odd
    monkeypatch.setattr("platewise.plans.base.TABLES", tuple(tables))
    monkeypatch.setattr("platewise.operators.overlap.ASKED", many)  # few texts travel, many meet the lines in blocks
    asked = [(20, "Soup"), (3, "rice and rice with beans"), (7, "--"), (8, "naïve café"), (9, "12345678 90 usd"), (9, "kelvin"), (5, "x"), (1, "th"), (2, "h rice and r"), (4, "the 3 kelvin k or so"), (6, None)]
    tables["benchmark"] = spark.createDataFrame(asked, "item_id long, text string")
    tables["benchmark"].write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    got = sorted(str(tuple(r)) for r in __spark_entry__.queries()["dice_similarity"](spark, str(path)).collect())
    assert got == twin(spark, "dice_similarity", tables)
    assert len(got) >= 9 and "item_id % 20" not in __spark_entry__.oracle_sql()["dice_similarity"]


def test_words_and_pairs_of_texts_are_no_rows(spark):
    plan = lambda name: __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan("dice_similarity") and "Join Inner" not in plan("dice_similarity").split("MapInArrow")[-1]
    assert " Join " not in plan("hashing_embeddings")
    assert plan("price_extraction").count("regexp_extract(") == 2
    from pyspark.sql import functions as F

    from platewise.operators.retrieval import hashed_vector

    assert "array_remove" not in spark.range(1).select(hashed_vector(F.lit("a b")))._jdf.queryExecution().analyzed().toString()
