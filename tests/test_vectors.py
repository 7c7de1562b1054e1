"""Blocked nearest neighbours and the inverted file against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from platewise.operators import vectors


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")


def brute_force(x, asked, k, self_too=False):
    x = np.array(x)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(norm > 0, norm, 1)
    out = {}
    for q in asked:
        c = u @ u[q]
        out[q] = [(i, round(float(c[i]), 9)) for i in sorted((i for i in range(len(x)) if self_too or i != q), key=lambda i: (-round(float(c[i]), 9), i))[:k]]
    return out


def found(frame):
    got = {}
    for r in sorted(frame.collect(), key=lambda r: r.place):
        got.setdefault(r.query_id, []).append((r.row_id, round(r.cosine, 9)))
    return got


@pytest.mark.parametrize("cells", [64, 1 << 22])
def test_knn_equals_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(vectors, "CELLS", cells)
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 6))
    x[5] = 0
    x[100:400] = x[7]  # a third of the rows are copies: ties by id
    rows = table(spark, x)
    asked = list(range(0, 900, 30)) + [5]
    queries = rows.where(rows["id"].isin(asked)).repartition(3)
    assert found(vectors.knn(rows, queries, 4, "id", "v", digits=9)) == brute_force(x, asked, 4)
    assert found(vectors.knn(rows, queries, 3, "id", "v", digits=9, self_too=True)) == brute_force(x, asked, 3, True)


def test_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [1.0]), (3, [1.0]), (4, [0.0, 0.0]), (5, [1.0, None])], "id long, v array<double>")
    assert found(vectors.knn(rows, rows.where("id = 1"), 9, "id", "v")) == {1: [(3, 1.0), (5, 1.0), (4, 0.0)]}
    assert vectors.knn(rows.limit(0), rows, 2, "id", "v").count() == 0
    assert vectors.knn(rows, rows.limit(0), 2, "id", "v").count() == 0


def test_inverted_file_covers_all_rows_and_reaches_its_recall(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 100)  # hot lists take several parts
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 8))[rng.integers(0, 20, 1500)] + 0.4 * rng.normal(size=(1500, 8))
    x[:500] = x[0] + 0.01 * rng.normal(size=(500, 8))
    rows = table(spark, x)
    queries = rows.where("id % 15 = 0")
    index = vectors.InvertedFile(rows, "id", "v", lists=16)
    assert sum(index.sizes.values()) == 1500 and index.rows.select("id").distinct().count() == 1500
    probes = index.tuned(queries, 5, 0.9)
    assert probes < 16 and index.recall(queries, 5, probes) >= 0.9
    assert found(index.search(queries, 5, 16, digits=9)) == brute_force(x, range(0, 1500, 15), 5)


def test_cosine_pairs_in_many_groups_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    values = [[float(x) for x in rng.normal(size=5)] for _ in range(70)] + [None, [0.0] * 5, [1.0, None, 0.0, 0.0, 1.0]]
    rows = spark.createDataFrame([*enumerate(values), (None, [1.0] * 5)], "vec_id long, embedding array<float>")
    found = vectors.cosine_pairs(rows, rows.where("vec_id % 6 = 0"), "vec_id", "embedding", cells=64)
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()  # pairs are no interpreted folds
    got = {(r.query_id, r.row_id): r.cosine for r in found.collect()}
    x = np.array([v if v is not None and None not in v else [0.0] * 5 for v in values], np.float32).astype(float)
    norm = np.linalg.norm(x, axis=1)
    want = {(a, b): float(x[a] @ x[b] / (norm[a] * norm[b])) if norm[a] * norm[b] else 0.0 for a in range(0, len(x), 6) for b in range(len(x)) if a != b}
    assert got == pytest.approx(want, abs=5.1e-5)


def test_cosine_pairs_shuffle_each_row_once(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(120)], "vec_id long, embedding array<float>")
    found = vectors.cosine_pairs(rows, rows.where("vec_id % 5 = 0"), "vec_id", "embedding", cells=64)
    plan = found._jdf.queryExecution()
    assert "CartesianProduct" in plan.executedPlan().toString() and "Generate" not in plan.optimizedPlan().toString()  # no row travels once a block
    assert found.count() == 24 * 119
