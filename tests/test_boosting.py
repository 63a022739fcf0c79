"""Boosters of all classes at once against Spark's own, one class after another."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from matchframe.functions.probs import P
from matchframe.operators import ml
from matchframe.operators import boosting as B
from matchframe.operators.boosting import fit_boosters

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 12, size=(400, 3)).astype(float)
    y = np.where(x[:, 0] + rng.integers(0, 5, 400) > 9, 0, np.where(x[:, 1] * x[:, 2] > 30, 1, 2))
    cells = [(i, int(t), 1.0 + i % 3, *map(float, r)) for i, (t, r) in enumerate(zip(y, x, strict=True))]
    return spark.createDataFrame(cells, "match_id long, target int, w double, a double, b double, c double").repartition(3)


@pytest.mark.parametrize("weight", [None, "w"])
def test_equals_sparks_own(rows, weight):
    ours = fit_boosters(rows, COLUMNS, weight=weight, rounds=4, share=1.0)
    for k, one in enumerate(ours):
        gbt = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=4, maxDepth=3, stepSize=0.05, subsamplingRate=1.0, seed=42)
        if weight:
            gbt.setWeightCol(weight)
        given = VectorAssembler(inputCols=COLUMNS, outputCol="_x").transform(rows.withColumn("_y", (F.col("target") == k).cast("double")))
        model = gbt.fit(given)
        want = {r["match_id"]: r["rawPrediction"][1] for r in model.transform(given).collect()}
        got = {r["match_id"]: r["_rawp"][1] for r in one.transform(rows).collect()}
        assert all(math.isclose(got[i], want[i], abs_tol=1e-9) for i in want)
        assert np.allclose(one.gains / one.gains.sum(), model.featureImportances.toArray(), atol=1e-9)


def test_a_pass_serves_all_classes(rows, spark):
    """The jobs of a fit are its levels, and few others; a booster a class took three times as many."""
    spark.sparkContext.setJobGroup("boosted", "")
    model = ml.fit_outcome_model(rows.select("match_id", "target", *COLUMNS), COLUMNS, kind="boosted", rounds=9)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosted"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(model.stages) == 3 and jobs < 2 * 9 * 3


def test_same_rows_are_drawn_however_they_lie(rows):
    one, other = (fit_boosters(df, COLUMNS, rounds=12, share=0.6) for df in (rows, rows.orderBy(F.rand(3)).repartition(1)))
    assert all(np.allclose(a.value, b.value) for a, b in zip(one, other, strict=True))
    every = fit_boosters(rows, COLUMNS, rounds=12, share=1.0)
    assert not np.allclose(one[0].value, every[0].value)


def test_no_rows_and_one_outcome(rows):
    model = ml.fit_outcome_model(rows.limit(0), COLUMNS, kind="boosted", rounds=2)
    assert all(math.isclose(r[p], 1 / 3) for r in model.transform(rows.limit(5)).collect() for p in P)
    only = ml.fit_outcome_model(rows.where("target = 1"), COLUMNS, kind="boosted", rounds=3)
    assert all(r["p_draw"] > 0.7 for r in only.transform(rows).collect())


def test_moved_columns_equal_a_plain_loop(rows):
    model = ml.fit_outcome_model(rows, COLUMNS, kind="boosted", rounds=6)
    got = {r["feature"]: r["importance"] for r in ml.permutation_importance(model, rows, reps=2).collect()}
    moved = ml.shuffled_partners(rows.select("match_id", F.struct(*COLUMNS).alias("v")), ["match_id"], "v", 2).select("match_id", "rep", "_from")
    loss = lambda df: np.mean([-math.log(r[P[r["target"]]]) for r in model.transform(df).collect()])
    before = loss(rows)
    for f in COLUMNS:
        after = [loss(rows.join(moved.where(f"rep = {r}"), "match_id").withColumn(f, F.col(f"_from.{f}"))) for r in range(2)]
        assert math.isclose(got[f], np.mean(after) - before, abs_tol=1e-9)


def _few_values(spark, n=4000):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (n, 4)).astype(float)
    y = (x[:, 0] + x[:, 1] + rng.integers(0, 5, n)) // 7
    return spark.createDataFrame([(*map(float, r), int(min(t, 2))) for r, t in zip(x, y, strict=True)], "a double, b double, c double, d double, target int")


def test_sums_of_one_child_of_every_node_give_the_same_trees(spark, monkeypatch):
    rows = _few_values(spark)
    whole = fit_boosters(rows, ["a", "b", "c", "d"], rounds=9)
    monkeypatch.setattr(B, "HALVED_ROWS", 1)
    half = fit_boosters(rows, ["a", "b", "c", "d"], rounds=9)
    for one, other in zip(whole, half, strict=True):
        assert (one.feature == other.feature).all() and (one.threshold == other.threshold).all()
        assert np.allclose(one.value, other.value, atol=1e-12) and np.allclose(one.gains, other.gains)


def test_a_fit_leaves_at_most_its_last_blocks(spark, monkeypatch):
    from pathlib import Path

    from matchframe.plans.stages import checkpoint_dir

    monkeypatch.setattr(B, "HALVED_ROWS", 1)
    place = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(place.glob("rdd-*"))
    fit_boosters(_few_values(spark), ["a", "b"], rounds=9)
    assert len(set(place.glob("rdd-*")) - before) <= 1


def test_quantiles_of_sorted_chunks_keep_their_ranks(spark, monkeypatch):
    monkeypatch.setattr(B, "HALVED_ROWS", 1)
    monkeypatch.setattr(B, "CHUNK_ROWS", 3000)
    rows = spark.range(40_000).selectExpr("CAST(pow(id * 7919 % 40000, 2) AS double) AS a", "CAST(id % 3 AS double) AS b", "CAST(-id AS double) AS c")
    a, b, c = B._cuts(rows, ["a", "b", "c"], 40_000)
    assert len(a) == len(c) == B.BINS - 1 and b.tolist() == [0.0, 1.0, 2.0]
    even = np.linspace(0, B.LOOKS, B.BINS + 1)[1:-1].astype(int) / B.LOOKS
    assert np.abs(np.sqrt(a) / 40_000 - even).max() < 2 * B.RANK_ERROR
    assert np.abs(1 + c / 40_000 - even).max() < 2 * B.RANK_ERROR


def test_moved_margins_equal_plain_margins_of_moved_columns():
    rng = np.random.default_rng(3)
    cut = rng.normal(size=(20, 15))
    cut[::4, 2] = np.inf
    booster = B.Booster(("a", "b", "c"), rng.integers(0, 3, (20, 15)), cut, rng.normal(size=(20, 15)), np.zeros(3), 3)
    own, given = rng.normal(size=(2, 3, 500))
    found = B.moved_margins([booster], own, given, [0, 1, 2])
    for j in range(3):
        mixed = own.copy()
        mixed[j] = given[j]
        plain = np.zeros(500)
        for t in range(20):
            node = np.zeros(500, int)
            for _ in range(3):
                node = 2 * node + 1 + (mixed[booster.feature[t, node], np.arange(500)] > cut[t, node])
            plain += booster.value[t, node]
        assert np.allclose(found[0, j], plain)
