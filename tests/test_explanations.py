"""Permutations and path contributions against plain computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchframe.functions.probs import P
from matchframe.operators import ml

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)).round(2)
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=300) > 0.4, 0, np.where(x[:, 1] > 0, 1, 2))
    cells = [(i, int(t), *map(float, r)) for i, (t, r) in enumerate(zip(y, x, strict=True))]
    cells[7] = (*cells[7][:3], None, cells[7][4])
    return spark.createDataFrame(cells, "match_id long, target int, a double, b double, c double")


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_paths_add_up_to_the_score(rows, kind):
    model = ml.fit_outcome_model(rows, COLUMNS, kind=kind, rounds=12)
    got = {(r["match_id"], r["class"]): r["base"] + sum(r["contributions"]) for r in ml.path_contributions(model, rows).collect()}
    assert len(got) == 900
    plain = rows.na.fill(0.0)
    for k, name in enumerate(ml.CLASSES):
        if kind == "boosted":
            want = {r["match_id"]: r["_rawp"][1] for r in model.stages[k].transform(plain).collect()}
        else:
            want = {r["match_id"]: r[P[k]] for r in model.transform(plain).collect()}
        assert all(math.isclose(got[i, name], w, abs_tol=1e-9) for i, w in want.items())
    mean = ml.additive_contributions(model, rows).collect()
    assert len(mean) == 9 and max(mean, key=lambda r: r["mean_abs_contribution"])["feature"] in ("a", "b")


def test_contributions_of_one_tree():
    """A root split on column 1 with values 0.5 -> 0.2 or 0.9, then one on column 0 below its right child."""
    grid = lambda *x: np.array([x])
    left, right = grid(1, 1, 3, 3, 4), grid(2, 1, 4, 3, 4)
    tree = ml.Trees(grid(1, 0, 0, 0, 0), grid(0.0, np.inf, 2.0, np.inf, np.inf), left, right, grid(0.5, 0.2, 0.9, 0.7, 1.0), 3)
    got = tree.contributions(np.array([[5.0, -1.0], [2.0, 1.0], [3.0, 1.0], [np.nan, 1.0]]))
    assert tree.base == 0.5 and np.allclose(got, [[0.0, -0.3], [-0.2, 0.4], [0.1, 0.4], [0.1, 0.4]])


def test_logistic_models_have_no_paths(rows):
    model = ml.fit_outcome_model(rows, COLUMNS, kind="logistic")
    with pytest.raises(ValueError):
        ml.path_contributions(model, rows)
    assert ml.additive_contributions(model, rows).count() == 9


def test_partners_are_permutations(rows):
    got = ml.shuffled_partners(rows.select("match_id", F.col("match_id").alias("v")), ["match_id"], "v", 4).collect()
    for rep in range(4):
        pairs = {r["match_id"]: r["_from"] for r in got if r["rep"] == rep}
        assert sorted(pairs) == sorted(pairs.values()) == list(range(300))
        assert all(a != b for a, b in pairs.items())
    assert len({tuple(sorted((r["match_id"], r["_from"]) for r in got if r["rep"] == p)) for p in range(4)}) == 4
    one = ml.shuffled_partners(rows.where("match_id = 3").select("match_id", F.col("match_id").alias("v")), ["match_id"], "v", 2)
    assert [(r["match_id"], r["_from"]) for r in one.collect()] == [(3, 3)] * 2
    assert ml.shuffled_partners(rows.limit(0).withColumn("v", F.lit(1)), ["match_id"], "v", 2).count() == 0


def test_permutation_importance_equals_a_plain_loop(rows):
    model = ml.fit_outcome_model(rows, COLUMNS, kind="logistic", reg=0.1)
    got = {r["feature"]: (r["importance"], r["std"]) for r in ml.permutation_importance(model, rows, reps=3).collect()}
    plain = rows.na.fill(0.0)
    cells = plain.select("match_id", F.struct(*COLUMNS).alias("v"))
    moved = ml.shuffled_partners(cells, ["match_id"], "v", 3).select("match_id", "rep", "_from").collect()

    def loss(df):
        scored = model.transform(df).collect()
        return float(np.mean([-math.log(r[P[r["target"]]]) for r in scored]))

    before = loss(plain)
    for f in COLUMNS:
        rises = []
        for rep in range(3):
            other = rows.sparkSession.createDataFrame([(r["match_id"], r["_from"][f]) for r in moved if r["rep"] == rep], "match_id long, _new double")
            rises.append(loss(plain.join(other, "match_id").withColumn(f, F.col("_new"))) - before)
        assert math.isclose(got[f][0], np.mean(rises), abs_tol=1e-9) and math.isclose(got[f][1], np.std(rises), abs_tol=1e-9)
    assert got["a"][0] > got["c"][0]
