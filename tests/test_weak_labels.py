"""Labels of lines by their words, against the SQL text: no row a word, on odd rows and with more words than travel to the tasks."""

from __future__ import annotations

import pytest

import __spark_entry__
from tests.test_words import twin

LINES = ["Large RING", "", "-", "a b", "x-the.y", "thé the", "de\tnoise", "R2D2", "noise only", "éring", "ring_é", "n", " ", "Kelvin", "rings", "x\r", " A ", "日本 soup", "theN"]


@pytest.fixture
def odd(spark, tmp_path, monkeypatch):
    docs = [(i, "\n".join(LINES[i:] + LINES[:i])) for i in range(0, len(LINES), 4)]
    # lines of one id count together, those without an id are noise; text and all lines may be empty
    docs += [(0, "noise\nring\n\nde"), (0, None), (1, "\n\n"), (2, ""), (None, "ring\nA"), (None, "ring"), (3, "\n" + "noise the " * 3000 + "ring\n")] + [(1000 + i, "x\n" * (i % 5) + "soup") for i in range(600)]
    tables = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string"),
        "part": spark.createDataFrame([(1, "Large ring"), (2, "the soup"), (3, None), (4, ""), (5, "Kelvin-x 9"), (6, "large RING")], "p_partkey long, p_name string"),
        "lineitem": spark.createDataFrame([(1, "A"), (2, "A"), (3, "N"), (4, None), (5, "a-b"), (6, "")], "l_orderkey long, l_returnflag string"),
    }
    for n, frame in tables.items():
        frame.write.parquet(f"{tmp_path}/{n}.parquet")
    monkeypatch.setattr("platewise.plans.base.TABLES", tuple(tables))
    return str(tmp_path), tables


@pytest.mark.parametrize("words", [100_000, 3])
def test_odd_rows_as_in_sql(spark, odd, words, monkeypatch):
    path, tables = odd
    monkeypatch.setattr("platewise.plans.text.SOURCE_WORDS", words, raising=False)
    got = sorted(str(tuple(r)) for r in __spark_entry__.queries()["weak_labels"](spark, path).collect())
    assert got == twin(spark, "weak_labels", tables)
    assert {"section", "item_name", "description", "noise"} == {eval(r)[2] for r in got}


def test_words_of_lines_are_no_rows(spark, odd):
    plan = __spark_entry__.queries()["weak_labels"](spark, odd[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
