"""Dropping later rows never changes the features of earlier matches."""

import pytest

from matchframe.operators import lineups as L
from matchframe.operators import managers as M
from matchframe.operators import quality as Q
from matchframe.operators import ratings as E
from matchframe.operators import rolling as R
from matchframe.plans import catalog  # noqa: F401  (registers the derived views)
from matchframe.plans.tables import Tables

CUT = "1998-07-01"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, "/root/testdata/sf0.001")


LONG = {
    "match": R.match_features, "shots": R.shot_volume_features, "efficiency": R.shot_efficiency, "load": R.fatigue_features,
    "recency": R.recency_weighted, "venue": R.venue_features, "draws": R.draw_propensity,
}


@pytest.mark.parametrize("name", LONG)
def test_long_features(t, name):
    assert Q.leakage_check(LONG[name], t.long, CUT).count() == 0


@pytest.mark.parametrize("build", [R.head_to_head, E.elo_features, E.opponent_adjusted_xg])
def test_match_features(t, build):
    assert Q.leakage_check(build, t.matches, CUT).count() == 0


def test_lineups_and_coaches(t):
    assert Q.leakage_check(lambda df: L.lineup_continuity(df, t.lineup_days), t.long, CUT).count() == 0
    coached = t.coached.withColumn("elo_trend", t.coached.xgf)
    assert Q.leakage_check(M.manager_features, coached, CUT).count() == 0


def test_the_check_finds_a_leak(t):
    from pyspark.sql import functions as F

    def leaky(df):
        return df.select("match_id", "team").join(df.groupBy("team").agg(F.sum("gf").alias("all_goals")), "team")

    assert Q.leakage_check(leaky, t.long, CUT).count() > 0


def test_a_later_row_with_the_key_of_an_earlier_one_is_no_leak(spark):
    rows = spark.createDataFrame([(1, "1998-01-01", "a"), (1, "1999-01-01", "b"), (2, "1998-02-01", "a"), (9, "2000-01-01", "b")], "match_id long, d string, pool string")
    rows = rows.selectExpr("match_id", "CAST(d AS DATE) AS match_date", "pool")
    assert Q.leakage_check(lambda df: df.select("match_id", "pool", "match_date"), rows, CUT).count() == 0
    named = rows.selectExpr("CAST(match_id AS STRING) AS match_id", "match_date", "pool")
    assert Q.leakage_check(lambda df: df.select("match_id", "pool"), named, CUT).count() == 0


def test_all_rows_are_built_once_for_several_cutoffs_and_no_built_row_travels(spark, t):
    from matchframe.plans.stages import FREE_KEY

    sizes = []

    def build(df):
        sizes.append(df.count())
        return R.form_features(df)

    before = spark.conf.get(FREE_KEY)
    found = Q.leakage_checks(build, t.long, ["1996-02-11", CUT, "2000-10-30"])
    assert [x.count() for x in found] == [0, 0, 0]
    assert len(sizes) == 4 and sizes.count(t.long.count()) == 1
    assert spark.conf.get(FREE_KEY) == before


def test_changed_rows_are_named_with_nulls_repeats_and_shared_keys(spark):
    rows = [(1, "1998-01-01"), (1, "1998-01-01"), (2, "1998-02-01"), (3, "1998-03-01"), (None, "1998-03-01"), (3, "1999-03-01"), (4, None), (4, "1998-04-01"), (5, "2001-01-01")]
    rows = spark.createDataFrame(rows, "match_id long, d string").selectExpr("match_id", "CAST(d AS DATE) AS match_date")

    def build(df):
        last = df.selectExpr("year(max(match_date)) AS last")
        cells = "match_id", "CASE WHEN match_id % 2 = 1 THEN last END AS a", "CASE WHEN match_id = 2 THEN last END AS b"
        return df.crossJoin(last).selectExpr(*cells)

    early, late = ({(r.side, r.match_id, r.a, r.b): n for r, n in found.groupBy(*found.columns).count().rdd.map(lambda r: (r, r["count"])).collect()} for found in Q.leakage_checks(build, rows, [CUT, "2000-01-01"]))
    assert early == {
        ("full", 1, 2001, None): 2, ("truncated", 1, 1998, None): 2, ("full", 2, None, 2001): 1, ("truncated", 2, None, 1998): 1,
        ("full", 3, 2001, None): 1, ("truncated", 3, 1998, None): 1, ("truncated", None, None, None): 1,
    }
    assert late == {
        ("full", 1, 2001, None): 2, ("truncated", 1, 1999, None): 2, ("full", 2, None, 2001): 1, ("truncated", 2, None, 1999): 1,
        ("full", 3, 2001, None): 2, ("truncated", 3, 1999, None): 2, ("truncated", None, None, None): 1,
    }
