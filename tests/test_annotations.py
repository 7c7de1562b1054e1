"""List readers, metrics and row validation, against brute force on small rows."""

from __future__ import annotations

import subprocess
import sys

from pyspark.sql import functions as F

from platewise.operators import evaluation, lists


def test_list_readers(spark):
    cases = {
        None: ([], [], [], []),
        " ": ([], [], [], []),
        "nan": ([], ["nan"], ["nan"], ["nan"]),
        '["a", " b ", ""]': (["a", "b"], ["a", "b"], ["a", "b"], ["a", " b ", ""]),
        "['a', 'b|c']": (["['a', 'b|c']"], ["['a', 'b", "c']"], ["a", "b|c"], ["a", "b|c"]),
        "a;b, c|d": (["a;b, c|d"], ["a;b, c", "d"], ["a;b, c", "d"], ["a", "b, c|d"]),
        "a; ,b": (["a; ,b"], ["a", ",b"], ["a; ,b"], ["a", ",b"]),
        "a, ,b": (["a, ,b"], ["a", "b"], ["a, ,b"], ["a", "b"]),
        "12": (["12"], ["12"], ["12"], ["12"]),
        '"x"': (['"x"'], ['"x"'], ["x"], ['"x"']),
        "[open": (["[open"], ["[open"], ["[open"], ["[open"]),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "x string")
    readers = (lists.storage_list, lists.import_list, lists.validation_list, lists.gold_list)
    got = {r[0]: tuple(r[1:]) for r in rows.select("x", *(f(F.col("x")) for f in readers)).collect()}
    assert got == cases


def test_metrics(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")] + [("b", "d")]
    matrix = evaluation.confusion_matrix(spark.createDataFrame(pairs, "label string, pred string"))
    assert {(r.label, r.pred): r.n for r in matrix.collect()} == {("a", "a"): 3, ("a", "b"): 1, ("b", "b"): 2, ("c", "a"): 1, ("b", "d"): 1}
    by_class, f1 = evaluation.class_metrics(matrix), {}
    for r in by_class.collect():
        tp = sum(x == y == r.label for x, y in pairs)
        fp, fn = sum(y == r.label for _, y in pairs) - tp, sum(x == r.label for x, _ in pairs) - tp
        f1[r.label] = 2 * tp / (2 * tp + fp + fn)
        assert (r.tp, r.fp, r.fn, r.support) == (tp, fp, fn, tp + fn) and abs(r.f1 - f1[r.label]) < 1e-12
    assert set(f1) == {"a", "b", "c", "d"}
    s = evaluation.summary(by_class).first()
    assert (s.n, s.accuracy) == (8, 5 / 8) and abs(s.macro_f1 - sum(f1.values()) / 4) < 1e-12
    assert abs(s.weighted_f1 - sum(f1[x] for x, _ in pairs) / 8) < 1e-12


def test_metrics_of_no_rows(spark):
    empty = spark.createDataFrame([], "label string, pred string")
    assert evaluation.class_metrics(evaluation.confusion_matrix(empty)).count() == 0


def test_validation_rules(spark):
    rows = [
        (0, "Soup", "12", 12.0, 0.5, False, None),
        (1, " ", None, 3.0, 1.5, True, ""),
        (2, "ab", "9", None, None, None, None),
        (3, None, "9", None, -0.1, True, "blurred"),
    ]
    schema = "id int, dish_name string, price_text string, price_value double, confidence double, needs_review boolean, review_reason string"
    got = {(r.id, r.issue) for r in evaluation.validation_issues(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        (1, "missing dish_name"), (1, "confidence out of range"), (1, "needs_review without review_reason"), (1, "price_value without price_text"),
        (2, "price_text without price_value and no review flag"), (2, "dish_name too short"), (3, "missing dish_name"), (3, "confidence out of range"),
    }


def test_registry_needs_no_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0
