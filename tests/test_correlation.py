"""Correlations from products of batches against NumPy."""

import numpy as np
import pytest

from matchframe.operators.metrics import correlation


def test_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4)) + [0, 1e4, -3, 0]
    x[:, 3] = 7.5
    x[:, 2] += x[:, 0]
    rows = [[None if rng.random() < 0.1 else float(v) for v in row] for row in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, flat double").repartition(5)
    got = {(r.a, r.b): r.corr for r in correlation(df, ["a", "b", "c", "flat"]).collect()}
    names = ["a", "b", "c", "flat"]
    assert set(got) == {(p, q) for p in names for q in names if p != q}
    table = np.array([[np.nan if v is None else v for v in row] for row in rows])
    for (p, q), r in got.items():
        u, v = table[:, names.index(p)], table[:, names.index(q)]
        both = ~np.isnan(u) & ~np.isnan(v)
        assert r is None if "flat" in (p, q) else r == pytest.approx(np.corrcoef(u[both], v[both])[0, 1], abs=1e-9)
    some = correlation(df, ["a"], ["b", "c"]).collect()
    assert sorted((r.a, r.b) for r in some) == [("a", "b"), ("a", "c")]
    assert correlation(df.limit(0), ["a", "b"]).count() == correlation(df.where("a > 1e9"), ["a", "b"]).count() == 0


def test_many_columns_in_one_pass(spark):
    """500 columns: the plan holds one scan and one aggregate, and no expression for a pair."""
    names = [f"c{k}" for k in range(500)]
    df = spark.range(400).selectExpr(*[f"cast(pmod(id * {2 * k + 3}, {k % 50 + 7}) AS double) AS {n}" for k, n in enumerate(names)])
    out = correlation(df, names)
    assert out.count() == 500 * 499
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
