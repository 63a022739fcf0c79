"""Ratings by hand, against a plain loop, and continued from a saved state."""

import math
import random

import pytest
from pyspark.sql import functions as F

from matchframe.operators import ratings as E


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for i in range(240):
        h, a = rng.sample(range(8), 2)
        out.append((i, i % 2, 2000 + i // 80, f"{2000 + i // 80}-0{1 + (i % 80) // 10}-1{i % 10}", h, a, rng.randrange(4), rng.randrange(4), 0.2 + rng.random(), 0.2 + rng.random()))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    df = spark.createDataFrame(rows, "match_id long, pool long, season int, d string, home long, away long, hg int, ag int, hxg double, axg double")
    return df.withColumn("match_date", F.col("d").cast("date")).drop("d").repartition(4).cache()


def test_one_match_by_hand(spark):
    m = spark.createDataFrame([(1, 0, 1, 1, 2, 1, 0), (2, 0, 1, 1, 2, 0, 0)], "match_id long, pool long, season int, home long, away long, hg int, ag int")
    m = m.withColumn("match_date", F.lit("2020-01-01").cast("date"))
    r = E.elo_features(m, E.EloConfig(k=30, home_advantage=75)).where("match_id = 2").first()
    change = 30 * (1 - 1 / (1 + 10 ** (-75 / 400)))
    assert r.home_elo == pytest.approx(1500 + change) and change == pytest.approx(11.81, abs=0.01)


@pytest.mark.parametrize("cfg", [E.EloConfig(), E.EloConfig(k=30, home_advantage=75, margin=True, carryover=0.75)])
def test_state_continues_the_fold(table, cfg):
    whole = {r.match_id: r for r in E.elo_features(table, cfg).collect()}
    first, rest = table.where("season < 2002"), table.where("season = 2002")
    state = E.elo_state(first, cfg)
    for r in E.elo_features(rest, cfg, state=state).collect():
        assert r.home_elo == pytest.approx(whole[r.match_id].home_elo)
        assert r.away_elo_trend == pytest.approx(whole[r.match_id].away_elo_trend)
    both = {(r.pool, r.team): r.rating for r in E.elo_state(rest, cfg, state).collect()}
    want = {(r.pool, r.team): r.rating for r in E.elo_state(table, cfg).collect()}
    for k, v in both.items():
        assert v == pytest.approx(want[k])


def test_grid_equals_single_runs(table):
    configs = [E.EloConfig(), E.EloConfig(k=40, home_advantage=25, margin=True)]
    grid = E.elo_grid(table, configs).collect()
    for n, cfg in enumerate(configs):
        alone = {r.match_id: r.home_elo for r in E.elo_features(table, cfg).collect()}
        assert {r.match_id: r.home_elo for r in grid if r.config == n} == pytest.approx(alone)


def plain_xg(rows):
    """Direct reading of the definition, whole histories in lists."""
    out, hist, league = {}, {}, []
    mean = lambda xs, d: sum(xs) / len(xs) if xs else d

    def block(h, season, avg):
        def rel(sel):
            return mean([x[1] for x in sel], avg) / avg, mean([x[2] for x in sel], avg) / avg

        ewm = None
        for _, a, d in h:
            ewm = (a, d) if ewm is None else (0.35 * a + 0.65 * ewm[0], 0.35 * d + 0.65 * ewm[1])
        ewm = ewm or (avg, avg)
        return [(ewm[0] / avg, ewm[1] / avg), rel(h[-5:]), rel(h[-10:]), rel([x for x in h if x[0] == season])]

    for mid, _, season, _, home, away, _, _, hx, ax in sorted(rows, key=lambda r: (r[3], r[0])):
        avg = mean([x for p in league for x in p], 1.35)
        lh, la = mean([p[0] for p in league], 1.45), mean([p[1] for p in league], 1.20)
        hb, ab = block(hist.setdefault(home, []), season, avg), block(hist.setdefault(away, []), season, avg)
        eh = min(max(lh * hb[0][0] * ab[0][1] * 1.08, 0.15), 4.5)
        out[mid] = (hb, ab, eh)
        hist[home].append((season, hx / max(ab[0][1], 0.25), ax / max(ab[0][0], 0.25)))
        hist[away].append((season, ax / max(hb[0][1], 0.25), hx / max(hb[0][0], 0.25)))
        league.append((hx, ax))
    return out


def test_opponent_adjusted_xg(table, rows):
    got = {r.match_id: r for r in E.opponent_adjusted_xg(table).collect()}
    for pool in (0, 1):
        for mid, (hb, ab, eh) in plain_xg([r for r in rows if r[1] == pool]).items():
            r = got[mid]
            for i, suffix in enumerate(("", "_last5", "_last10", "_season")):
                assert r[f"home_xg_attack_rating{suffix}"] == pytest.approx(hb[i][0])
                assert r[f"away_xg_defense_rating{suffix}"] == pytest.approx(ab[i][1])
            assert r.expected_home_goals_model == pytest.approx(eh)
            lam = [r.expected_home_goals_model, r.expected_away_goals_model]
            p = [[math.exp(-x) * x**k / math.factorial(k) for k in range(11)] for x in lam]
            win = sum(p[0][i] * p[1][j] for i in range(11) for j in range(i))
            assert r.poisson_home_win_prob == pytest.approx(win / (sum(p[0]) * sum(p[1])))


def test_unknown_teams_start_at_the_default(spark, table):
    f = spark.createDataFrame([(1, 0, 0, 999)], "match_id long, pool long, home long, away long")
    # Teams of the same names in another pool do not answer.
    state = E.elo_state(table.where("pool = 0"))
    twice = state.unionByName(state.withColumns({"pool": F.col("pool") + 7, "rating": F.col("rating") + 99}))
    (r,) = E.elo_prediction_rows(f, twice).collect()
    assert r.away_elo == 1500.0 and r.away_elo_trend == 0.0


def test_grid_equals_single_configurations(table):
    configs = [
        E.EloConfig(), E.EloConfig(k=30.0, home_advantage=75.0), E.EloConfig(margin=True),
        E.EloConfig(margin=True, carryover=0.75), E.EloConfig(k=40.0, carryover=0.5),
    ]
    got = {(r.config, r.match_id): r for r in E.elo_grid(table, configs).collect()}
    assert len(got) == len(configs) * table.count()
    for n, cfg in enumerate(configs):
        for r in E.elo_features(table, cfg).collect():
            one = got[n, r.match_id]
            assert one.config_name == cfg.name
            for c in ("home_elo", "away_elo", "home_elo_trend", "away_elo_trend"):
                assert one[c] == pytest.approx(r[c])


def spread_rows():
    """One pool of three separate leagues and a late cup that links two of them."""
    rng = random.Random(4)
    out = []
    for i in range(300):
        block = rng.randrange(3)
        teams = [block * 6 + k for k in range(6)] if i < 240 else [0, 1, 6, 7]
        h, a = rng.sample(teams, 2)
        day = f"{2000 + i // 100}-{1 + (i % 100) // 10:02d}-{10 + i % 10}"
        out.append((i, 0, 2000 + i // 100, day, h, a, rng.randrange(4), rng.randrange(4), 0.2 + rng.random(), 0.2 + rng.random()))
    return out


@pytest.mark.parametrize(("step_rows", "cfg"), [(150, E.EloConfig()), (60, E.EloConfig(k=30, home_advantage=75, margin=True, carryover=0.75))])
def test_steps_equal_the_whole_fold(spark, table, step_rows, cfg):
    wide = spark.createDataFrame(spread_rows(), "match_id long, pool long, season int, d string, home long, away long, hg int, ag int, hxg double, axg double")
    wide = wide.withColumn("match_date", F.col("d").cast("date")).drop("d")
    for df in (wide, table):
        whole = {r.match_id: tuple(r)[2:6] for r in E.elo_features(df, cfg).collect()}
        got = {r.match_id: tuple(r)[2:6] for r in E.elo_features(df, cfg, step_rows=step_rows if df is wide else 110).collect()}
        assert got.keys() == whole.keys()
        for k in whole:
            assert got[k] == pytest.approx(whole[k], abs=1e-9)
    states = [{(r.pool, r.team): (r.rating, r.season, *r.past) for r in E.elo_state(wide, cfg, step_rows=n).collect()} for n in (10**6, step_rows)]
    assert states[0].keys() == states[1].keys()
    for k, v in states[0].items():
        assert states[1][k] == pytest.approx(v, abs=1e-9)
    first, rest = wide.where("season < 2002"), wide.where("season = 2002")
    saved = E.elo_state(first, cfg, step_rows=step_rows)
    whole = {r.match_id: r.home_elo for r in E.elo_features(wide, cfg).where("match_id >= 200").collect()}
    assert {r.match_id: r.home_elo for r in E.elo_features(rest, cfg, state=saved, step_rows=step_rows).collect()} == pytest.approx(whole)


def test_xg_steps_equal_the_whole_fold(spark, table):
    whole = {r.match_id: tuple(r)[2:20] for r in E.opponent_adjusted_xg(table).collect()}
    got = {r.match_id: tuple(r)[2:20] for r in E.opponent_adjusted_xg(table, step_rows=70).collect()}
    assert got.keys() == whole.keys()
    for k in whole:
        assert got[k] == pytest.approx(whole[k], abs=1e-9)


def test_linked_groups(spark):
    from matchframe.operators.waves import linked_groups, with_step

    chain = [(0, k, k + 1) for k in range(20, 60)] + [(0, 5, 3), (0, 3, 9), (1, 3, 20)]
    df = spark.createDataFrame(chain, "pool long, home long, away long")
    got = {(r.pool, r.team): r._group for r in linked_groups(df).collect()}
    assert got == {(0, k): 20 for k in range(20, 61)} | {(0, k): 3 for k in (3, 5, 9)} | {(1, 3): 3, (1, 20): 3}
    days = spark.range(100).selectExpr("0L AS pool", "date_add(date'2020-01-01', cast(id / 4 AS int)) AS match_date", "id")
    sizes = [r["count"] for r in with_step(days, 20).groupBy("_step").count().collect()]
    assert sizes == [20] * 5


@pytest.mark.parametrize("step_rows", [E.STEP_ROWS, 1])
def test_a_league_without_chances_so_far_keeps_its_start_value(spark, step_rows):
    m = spark.createDataFrame(
        [(1, 0, 1, "2020-01-01", 1, 2, 0.0, 0.0), (2, 0, 1, "2020-01-02", 3, 4, 1.0, 0.5), (3, 0, 1, "2020-01-03", 1, 3, 1.0, 1.0)],
        "match_id long, pool long, season int, d string, home long, away long, hxg double, axg double",
    )
    got = {r.match_id: r for r in E.opponent_adjusted_xg(m.withColumn("match_date", F.col("d").cast("date")), step_rows=step_rows).collect()}
    assert got[2].home_xg_attack_rating == got[2].away_xg_defense_rating == 1.0
    assert got[2].expected_home_goals_model == E.XgConfig().low
    assert got[3].home_xg_attack_rating == 0.0 and got[3].away_xg_attack_rating == pytest.approx(1.0 / (1.5 / 4))
