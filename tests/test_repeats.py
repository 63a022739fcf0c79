"""Rows that share a key: fixtures of one day, line-up rows of one rank."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from matchframe.operators import manyfits as N
from matchframe.operators import ml as M
from matchframe.operators import rolling as R
from matchframe.operators import tactics as K
from matchframe.operators import windows as W
from matchframe.plans.registry import rounded
from matchframe.plans.tables import Tables
from matchframe.sources import lineups as L

QUERIES = entry.queries()


def test_a_score_belongs_to_its_own_fixture(spark, tmp_path):
    # Both orders are the same two teams on the same day; 35438 has no readable score.
    orders = spark.read.parquet("/root/testdata/sf0.1/orders.parquet").where("o_orderkey IN (35438, 115276)")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["S8_read_fixtures"](spark, str(tmp_path)).collect()
    assert len({(r.match_date, r.home, r.away) for r in got}) == 1
    assert {r.matchweek: r.completed for r in got} == {35438 % 38 + 1: 0, 115276 % 38 + 1: 1}


def test_of_tied_lineup_rows_the_first_read_stays(spark):
    rows = [(1, f"m{m}", f"2020-01-{d:02d}", "T", f"P{d}", f"4-{d}", f"C{d % 7}") for d in range(1, 29) for m in range(50)]
    rows = spark.createDataFrame(rows, "rank_id long, match_id string, date string, team string, player string, formation string, captain string")
    raw = rows.union(rows).repartition(1).sortWithinPartitions(F.col("date").desc())
    got = L.normalize_lineups(raw, "export", "rank_id")
    for name in ("lineups", "formations"):
        assert {(r.match_id, r.formation) for r in got[name].collect()} == {(f"m{m}", "4-28") for m in range(50)}


def test_strength_of_the_last_seasons_reaches_the_query(spark):
    sf = "/root/testdata/sf0.01"
    sizes = Tables(spark, sf).league.groupBy("pool", "season").count()
    assert sizes.where("count >= 80").count() > 0
    got = QUERIES["N11_long_term_strength"](spark, sf)
    teams = got.groupBy("pool").agg({"strength": "max"}).where("`max(strength)` > 0.15 * 4")
    assert teams.count() > 0


def test_profiles_are_computed_once_for_all_rounds(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = spark.range(300).selectExpr("id AS team", "2000 AS season", "CAST(id * 37 % 101 AS double) AS a", "CAST(id * 53 % 97 AS double) AS b")
    got = K.style_embeddings(rows.mapInPandas(counted, rows.schema), ["a", "b"])
    assert got.groupBy("team_style_cluster").count().count() == 6
    assert read.value == 300


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_prices_are_joined_once_for_all_modes(spark):
    got = QUERIES["P2_select_odds"](spark, "/root/testdata/sf0.001")
    assert _plan(got).count("Join ") == 1
    assert got.count() == 4 * spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


def test_lineup_checks_part_the_rows_by_match_in_small_parts(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    monkeypatch.setattr(W, "PART_ROWS", 1_000)
    parts = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 1_000)
    got = QUERIES["D5_validate_lineups"](spark, sf)
    assert "RepartitionByExpression [l_orderkey" in _plan(got) and f", {parts}\n" in _plan(got)
    monkeypatch.undo()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, QUERIES["D5_validate_lineups"](spark, sf).collect()))


def test_short_histories_are_profiled_whole(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    names = K.TACTICAL_MEASURES[:3]
    whole = K.tactical_profiles(t.long, t.measures, names)
    assert _plan(whole).count("RepartitionByExpression") == 1 and "Window" not in _plan(whole)
    spark.conf.set("spark.matchframe.chunkDays", 60)
    try:
        sliced = K.tactical_profiles(t.long, t.tactics, names)
        last = K.tactical_profiles(t.long, t.tactics, names, ["last10"])
        want = sorted(map(tuple, sliced.collect()))
    finally:
        spark.conf.unset("spark.matchframe.chunkDays")
    assert _plan(sliced).count("Window") > 0
    assert sorted(map(tuple, whole.collect())) == want
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, sliced.select(last.columns).collect()))


def test_only_asked_frames_and_measures_are_computed(spark, monkeypatch):
    made, plain = [], K._profiles
    monkeypatch.setattr(K, "_profiles", lambda width, names, *rest: made.append(names) or plain(width, names, *rest))
    for name, measures in (("W27_tactical_matchups", K.TACTICAL_MEASURES), ("W28_style_cluster_rule", K.STYLE_MEASURES)):
        QUERIES[name](spark, "/root/testdata/sf0.001")
        assert made.pop() == [f"{m}_last10" for m in measures]


def test_rounding_by_arithmetic_equals_decimal_rounding(spark):
    x = F.expr("CASE id % 5 WHEN 0 THEN (rand(1) - 0.5) * 100 WHEN 1 THEN (id - 5000) / 2e6D WHEN 2 THEN (id - 5000) / 2e6D + 1e-16 WHEN 3 THEN (rand(2) - 0.5) * pow(10D, id % 40 - 20) ELSE element_at(array(double('NaN'), double('Infinity'), NULL, -1e-9D), CAST(id % 4 AS int) + 1) END")
    rows = spark.range(10_000).select(x.alias("x"))
    for places in (1, 6):
        assert rows.where(~F.round("x", places).eqNullSafe(rounded(F.col("x"), places))).count() == 0


def test_form_and_shots_are_one_pass_where_histories_are_short(spark):
    long = Tables(spark, "/root/testdata/sf0.001").long
    both = R.match_and_shot_features(long)
    want = R.match_features(long).join(R.shot_volume_features(long), "match_id")
    assert both.columns == [c for c in both.columns if c in want.columns] and set(both.columns) == set(want.columns)
    assert _plan(both).count("Join ") == 0
    want = sorted(map(tuple, want.select(both.columns).collect()))
    assert sorted(map(tuple, both.collect())) == want
    spark.conf.set("spark.matchframe.chunkDays", 90)
    try:
        assert len(want) == R.match_and_shot_features(long).count()
    finally:
        spark.conf.unset("spark.matchframe.chunkDays")


def test_results_are_computed_once_for_their_deltas(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = spark.createDataFrame([(n, x, x, x) for n, x in (("base", 1.0), ("a", 2.0))], "model_version string, log_loss double, brier_score double, ece double")
    got = M.with_deltas(rows.mapInPandas(counted, rows.schema), "base").collect()
    assert {r.model_version: r.log_loss_delta for r in got} == {"base": 0.0, "a": 1.0}
    assert read.value == 2


def test_a_fit_multiplies_its_own_columns_only():
    rng = np.random.default_rng(1)
    x = rng.random((50, 3))
    batch = pa.RecordBatch.from_arrays([pa.array(list(x)), pa.array(rng.integers(0, 3, 50)), pa.array([[1.0, 1.0]] * 50)], ["x", "y", "w"])
    free = np.array([[True, True, True, True], [False, True, False, True]])
    (out,) = N._sums(np.zeros((2, 4, 2)), [0, 1], [0, 1], np.zeros(3), np.ones(3), False, free)([batch])
    whole, part = (np.array(v) for v in out.column(1).to_pylist())
    there = np.concatenate([[True] * 2, np.tile(free[1], 2), np.tile(np.outer(free[1], free[1]).ravel(), 3)])
    assert np.allclose(part[there], whole[there]) and (part[~there] == 0).all() and (whole != 0).all()
