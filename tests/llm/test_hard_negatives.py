from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.llm import hard_negatives

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute_force(rows, every, positives=5, negatives=3, scale=256):
    """Rows are (id, vector, label); those that take no part are left out."""
    usable = [(i, [math.floor(scale * x) for x in v], c) for i, v, c in rows if v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (ai, av, ac) in enumerate(usable):
        if ai is None or ai % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, bv, strict=False)), math.inf if bi is None else bi, bc) for b, (bi, bv, bc) in enumerate(usable) if b != a)
        own = [s for s in scored if s[2] == ac][:positives]
        for ps, pi, _ in own:
            ns = [s for s in scored if s[2] != ac and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:negatives]
            out += [(ai, pi, k + 1, ni, -ps, -s) for k, (s, ni, _) in enumerate(ns)]
    return sorted(out, key=str)


def result(frame):
    return sorted((tuple(math.inf if r[c] is None else r[c] for c in COLUMNS) for r in frame.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def clumps(n, dims, labels, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(labels, dims))
    label = rng.integers(0, labels, n)
    x = centre[label] + 0.7 * rng.normal(size=(n, dims))
    x[: n // 3] = x[0] + 0.05 * rng.normal(size=(n // 3, dims))  # one group holds a third of the rows
    x[n // 2] = 0
    return [(i, [float(v) for v in x[i]], int(label[i])) for i in range(n)]


@pytest.mark.parametrize(("stride", "members"), [(7, 4), (512, 64)])
def test_equals_brute_force(spark, monkeypatch, stride, members):
    monkeypatch.setattr(hard_negatives, "STRIDE", stride)
    monkeypatch.setattr(hard_negatives, "MEMBERS", members)
    monkeypatch.setattr(hard_negatives, "BLOCK", 20)  # several blocks, and a cluster that takes more than one
    rows = clumps(400, 8, 4, stride)
    assert result(hard_negatives.mine(frame(spark, rows).repartition(3), F.col("hn_id") % 5 == 0)) == brute_force(rows, 5)


def test_walk_ends_before_the_list_does():
    rng = np.random.default_rng(0)
    candidates = rng.integers(-50, 50, (4000, 4))
    members = candidates[:6] * 3
    order, bound = hard_negatives.shared_list(members[:1], candidates)
    seen = []
    low, high = np.full((1, 1), -(1 << 60)), np.full((1, 1), 1 << 60)
    group, found, score = hard_negatives.walk(members[:1], candidates, np.arange(4000), order, bound, low, high, 5, lambda i, j: seen.append(len(j)) or np.zeros((len(i), len(j)), bool))
    product = candidates @ members[0]
    want = sorted(range(4000), key=lambda k: (-product[k], k))[:5]
    assert sorted(found.tolist()) == sorted(want) and sum(seen) < 2000
    every, bounds = hard_negatives.shared_list(members, candidates)
    units = members / np.linalg.norm(members, axis=1, keepdims=True)
    assert ((units @ candidates[every].T).max(axis=0) <= bounds + 1e-6).all()


def test_ties_repeated_rows_and_odd_values(spark):
    rows = [
        (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 2), (3, [0.9, 0.3], 2), (4, [0.9, 0.3], 2), (5, [0.6, 0.0], 3), (6, None, 1), (7, [1.0, None], 1),
        (8, [float("nan"), 1.0], 2), (9, [1.0, 1.0], None), (10, [0.5], 4), (11, [0.5, 0.0, 7.0], 4), (None, [0.9, 0.3], 2), (12, [], 1), (13, [-1.0, 0.0], 1), (100, [0.0, 0.0], 7), (101, [0.0, 0.0], 7),
        (102, [float("inf"), 0.0], 7), (103, [-0.001, 0.0], 5),
    ]
    got = result(hard_negatives.mine(frame(spark, rows), F.col("hn_id") % 50 == 0))
    assert got == brute_force(rows, 50)
    assert any(r[:4] == (0, 1, 1, 2) for r in got)


def test_big_values_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.integers(-(1 << 14), 1 << 14, 6)], i % 3) for i in range(60)]
    assert result(hard_negatives.mine(frame(spark, rows), F.col("hn_id") % 10 == 0)) == brute_force(rows, 10)


def test_empty_and_without_anchors(spark):
    rows = frame(spark, [(1, [1.0], 1), (2, [1.0], 2)]).withColumn("hn_row", F.lit("x"))
    assert hard_negatives.mine(rows.limit(0), F.col("hn_id") % 50 == 0).count() == 0
    out = hard_negatives.mine(rows, F.col("hn_id") % 50 == 0)
    assert out.count() == 0 and tuple(out.columns) == COLUMNS
