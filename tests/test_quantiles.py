"""Exact quantiles against numpy, with groups far beyond what one buffer may hold."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators.quantiles import exact_quantiles

PROBS = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)


def groups():
    rng = np.random.default_rng(3)
    return {
        "normal": rng.normal(size=3000), "tied": rng.integers(0, 3, 2000).astype(float), "one value": np.full(1500, 7.0), "heavy tail": 10 ** rng.uniform(-200, 200, 2500), "few": rng.normal(size=9), "single": np.array([4.0]),
        "half ties": np.concatenate([np.full(1000, 1.0), rng.normal(size=1000)]), None: rng.normal(size=500),
    }


@pytest.mark.parametrize("most", [20, 100_000])
def test_equal_to_numpy(spark, most):
    want = groups()
    rows = spark.createDataFrame([(k, float(v)) for k, vs in want.items() for v in vs] + [("few", None), ("no values", None)], "k string, v double").repartition(4)
    got = {r.k: r for r in exact_quantiles(rows, ["k"], "v", PROBS, most).collect()}
    assert got.keys() == want.keys()
    for k, vs in want.items():
        assert got[k].n == len(vs)
        np.testing.assert_allclose(got[k].quantiles, np.quantile(vs, PROBS), rtol=1e-9)


def test_all_rows_and_no_rows(spark):
    rows = spark.range(5001).withColumn("v", (F.col("id") * 7919 % 5001).cast("double"))
    assert exact_quantiles(rows, [], "v", (0.5, 0.999), 50).first().quantiles == pytest.approx([2500.0, 4995.0])
    assert exact_quantiles(rows.limit(0), ["id"], "v", (0.5,)).count() == 0
