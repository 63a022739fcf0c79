"""Spells: the interval index lists few rows, and the sweep equals sums over the true pairs."""

import datetime as dt
import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from matchframe.operators import managers as MG
from matchframe.operators import windows as W
from matchframe.operators.joins import FIRST_DAY, active_interval_join, interval_blocks, spell_totals
from matchframe.settings import CHUNK_DAYS_KEY

DAY0 = dt.date(2020, 1, 1)
SPELL = "fact long, team long, who long, report_date date, unavailable_from date, expected_return_date date, x double, flag boolean"


def day(n):
    return DAY0 + dt.timedelta(days=n)


def spells(n, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = rng.randrange(0, 900)
        length = rng.choice([0, 2, 7, 8, 9, 30, 64, 65, 200, 600])
        end = None if i % 9 == 0 else day(start + length) if i % 31 else day(start - 1)
        x = None if i % 13 == 0 else rng.randrange(-40, 100) / 8
        flag = None if i % 17 == 0 else rng.random() < 0.5
        who = None if i % 11 == 0 else rng.randrange(6)
        team = 0 if i % 3 == 0 else rng.randrange(5)
        out.append((i, team, who, day(start - rng.randrange(-4, 4)), day(start), end, x, flag))
    return out


def test_few_rows_a_spell(spark):
    df = spark.createDataFrame(spells(3000), SPELL).where("expected_return_date >= unavailable_from OR expected_return_date IS NULL")
    low = F.unix_date("unavailable_from") - FIRST_DAY
    stop = F.unix_date("expected_return_date") - FIRST_DAY + 1
    rows = df.select("fact", "expected_return_date", F.size(interval_blocks(low, stop)).alias("n"))
    closed = rows.where("expected_return_date IS NOT NULL").agg(F.max("n")).first()[0]
    assert closed <= 2 and rows.agg(F.max("n")).first()[0] <= 40


def test_totals_against_pairs(spark):
    facts = spells(500)
    events = [(k, k % 2, None if k % 50 == 0 else k % 5, day(random.Random(k).randrange(-5, 1200))) for k in range(400)]
    asks = spark.createDataFrame(events, "match_id long, is_home int, team long, match_date date")
    df = spark.createDataFrame(facts, SPELL)
    got = spell_totals(
        asks, df, who="who", sums={"x": F.col("x"), "neg": F.when(F.col("flag"), -F.col("x"))},
        present={"n": F.lit(True), "flagged": F.col("flag")},
    )
    assert got.columns == ["match_id", "is_home", "team", "match_date", "x", "neg", "n", "flagged"]
    got = {r.match_id: (r.x, r.neg, r.n, r.flagged) for r in got.collect()}
    pairs = set()
    for m, _, team, d in events:
        on = [f for f in facts if f[1] == team and team is not None and max(f[3], f[4]) <= d and (f[5] is None or max(f[3], f[4], d) <= f[5])]
        pairs |= {(m, f[0]) for f in on}
        want = (
            sum(f[6] or 0 for f in on), -sum(f[6] or 0 for f in on if f[7]),
            len({f[2] for f in on}), len({f[2] for f in on if f[7]}),
        )
        assert got[m] == want
    hit = active_interval_join(asks, df).select("match_id", "fact").collect()
    assert len(hit) == len(pairs) and {tuple(r) for r in hit} == pairs


def test_open_spells_make_no_pairs(spark):
    """10,000 open spells of one team and 1,000 matches after them: rows stay linear in the spells, not in pairs."""
    facts = spark.range(10_000).select(
        F.col("id").alias("fact"), F.lit(0).cast("long").alias("team"), (F.col("id") % 30).alias("who"),
        F.date_add(F.lit(DAY0), (F.col("id") % 400).cast("int")).alias("report_date"), F.lit(None).cast("date").alias("expected_return_date"), F.lit(1.0).alias("x"),
    )
    asks = spark.range(1000).select(
        F.col("id").alias("match_id"), F.lit(1).alias("is_home"), F.lit(0).cast("long").alias("team"),
        F.date_add(F.lit(DAY0), 500 + (F.col("id") % 300).cast("int")).alias("match_date"),
    )
    args = {"start": "report_date", "who": "who", "sums": {"x": F.col("x")}, "present": {"n": F.lit(True)}}
    out = spell_totals(asks, facts, **args)
    assert {(r.x, r.n) for r in out.collect()} == {(10_000.0, 30)}
    plan = out._jdf.queryExecution().executedPlan()
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert plan is not None


def test_nothing(spark):
    facts, asks = spark.createDataFrame([], SPELL), spark.createDataFrame([(1, 1, 2, DAY0)], "match_id long, is_home int, team long, match_date date")
    one = spell_totals(asks, facts, who="who", sums={"x": F.col("x")}, present={"n": F.lit(True)}).collect()
    assert [(r.x, r.n) for r in one] == [(0.0, 0)]
    assert spell_totals(asks.limit(0), facts, sums={"x": F.col("x")}).count() == 0


def _exchanges(df) -> int:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning")


def test_absences_and_asks_travel_once_before_they_become_changes(spark, monkeypatch):
    monkeypatch.setattr(W, "PART_ROWS", 1_000)
    got = entry.queries()["W17_absence_features"](spark, "/root/testdata/sf0.001")
    # Facts and asks by team, then the sides of a match.
    assert _exchanges(got) == 3


def test_coach_features_shuffle_a_team_once(spark):
    got = entry.queries()["W24_manager_features"](spark, "/root/testdata/sf0.001")
    assert _exchanges(got) == 2


def test_coach_features_of_whole_teams_equal_sliced_ones(spark):
    rows = spark.range(400).selectExpr(
        "id AS match_id", "IF(id % 7 = 3, NULL, date_add(DATE '2000-01-01', CAST(id * 5 - id % 3 * 5 AS int))) AS match_date", "IF(id % 11 = 2, NULL, id % 4) AS team",
        "1 AS is_home", "IF(id % 13 = 1, NULL, concat('m', CAST(id / 40 AS int) % 3)) AS manager", "id % 4 AS points", "CAST(id % 5 AS double) AS xgf", "CAST(id % 3 AS double) AS xga",
        "IF(id % 17 = 0, NULL, CAST(id % 9 AS double)) AS elo_trend",
    )
    rows = rows.unionByName(rows.where("match_id % 50 = 7"))
    whole = MG.manager_features(rows)
    plain = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*whole.columns).na.fill(-1).collect())
    one = plain(whole)
    spark.conf.set(CHUNK_DAYS_KEY, "182")
    try:
        assert one == plain(MG.manager_features(rows))
    finally:
        spark.conf.unset(CHUNK_DAYS_KEY)
