"""Small inputs with known results."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from matchframe import schema as S
from matchframe.functions import clean as C
from matchframe.functions import probs as X
from matchframe.operators import availability as V
from matchframe.operators import context as K
from matchframe.operators import quality as D
from matchframe.operators import rolling as R
from matchframe.operators import scoreline as G
from matchframe.operators import season as Q
from matchframe.operators import strength as N
from matchframe.operators import tuning as T
from matchframe.operators.longform import to_long
from matchframe.sources import absences as A
from matchframe.sources import readers as RD
from matchframe.sources import sinks

D0 = dt.date


def matches(spark, rows):
    """(day, home, away, hg, ag, hs, as_, hst, ast)"""
    data = [
        (i, "p", f"{d.year}" if d.month >= 7 else f"{d.year - 1}", d, h, a, hg, ag, "H" if hg > ag else "A" if ag > hg else "D", float(hg), float(ag), *shots)
        for i, (d, h, a, hg, ag, *shots) in enumerate(rows)
    ]
    return spark.createDataFrame(
        data,
        "match_id long, pool string, season string, match_date date, home string, away string, hg int, ag int, result string, "
        "hxg double, axg double, hs int, as_ int, hst int, ast int",
    )


def one(df):
    return df.first().asDict()


def test_shot_season_fallback_and_null_skip(spark):
    early = [(D0(2025, 8, 1 + i), "A", "B", 1, 0, v, 3, 4, 1) for i, v in enumerate((10, 12, 11, 13, 9))]
    thin = matches(spark, [*early, (D0(2026, 8, 1), "A", "B", 0, 0, 20, 3, 4, 1), (D0(2026, 8, 9), "A", "B", 0, 0, None, 3, None, 1), (D0(2026, 8, 20), "A", "B", 1, 1, 5, 5, 5, 5)])
    got = {r.match_id: r for r in R.shot_volume_features(to_long(thin)).collect()}
    assert got[7].home_shots_avg_season == pytest.approx(12.5)
    assert got[7].home_shots_avg_last5 == pytest.approx((12 + 11 + 13 + 9 + 20) / 5)
    full = matches(spark, [*early, *[(D0(2026, 8, 1 + i), "A", "B", 0, 0, v, 3, 4, 1) for i, v in enumerate((20, 21, 19, 18, 22))], (D0(2026, 9, 1), "A", "B", 0, 0, 1, 1, 1, 1)])
    assert {r.match_id: r for r in R.shot_volume_features(to_long(full)).collect()}[10].home_shots_avg_season == pytest.approx(20.0)


def test_draw_propensity(spark):
    m = matches(spark, [(D0(2025, 8, 21), "A", "B", 1, 1, 9, 9, 3, 3), (D0(2025, 8, 28), "A", "C", 2, 0, 9, 9, 3, 3)])
    got = {r.match_id: r for r in R.draw_propensity(to_long(m)).collect()}
    assert got[0].combined_draw_rate_last10 == 0
    assert (got[1].home_draw_rate_last10, got[1].away_draw_rate_last10) == (1.0, 0.0)
    assert 0 <= got[1].draw_propensity_score <= 1


def nonleague(spark, rows):
    return spark.createDataFrame(
        [(t, d, i, c, float(p), float(g), float(s)) for i, (t, d, c, p, g, s) in enumerate(rows)],
        "team string, match_date date, row_id long, competition string, points double, goals_for double, shots_for double",
    ).withColumn("weight", C.competition_weight("competition"))


def test_non_league_context(spark):
    m = matches(spark, [(D0(2026, 8, 15), "A", "B", 0, 0, 1, 1, 1, 1)])
    rows = nonleague(spark, [("A", D0(2026, 8, 10), "Friendly", 3, 4, 9), ("A", D0(2026, 8, 16), "Friendly", 3, 4, 9)])
    got = one(K.non_league_context(to_long(m), rows))
    assert (got["home_non_pl_context_available"], got["home_preseason_matches_last_60_days"]) == (1, 1)
    assert (got["home_non_pl_points_equiv_last5"], got["home_non_pl_goals_equiv_avg_last5"]) == (0.75, 1.0)
    assert (got["away_non_pl_context_available"], got["away_days_since_any_match"]) == (0, 14)
    rows = nonleague(spark, [("A", D0(2026, 8, 5), "Championship", 3, 2, 10), ("A", D0(2026, 8, 8), "Championship", 1, 1, 8)])
    got = one(K.non_league_context(to_long(m), rows))
    assert got["home_non_pl_points_equiv_last5"] == pytest.approx(2.20)
    assert got["home_non_pl_goals_equiv_avg_last5"] == pytest.approx(0.825)
    assert got["home_non_pl_shots_equiv_avg_last5"] == pytest.approx(4.95)
    assert got["home_competitive_non_pl_matches_last_30_days"] == 2
    late = matches(spark, [(D0(2026, 8, 23), "A", "B", 0, 0, 1, 1, 1, 1)])
    got = one(K.non_league_context(to_long(late), nonleague(spark, [("A", D0(2026, 8, 12), "UEFA Super Cup", 3, 2, 8)])))
    assert (got["home_competitive_non_pl_matches_last_30_days"], got["home_preseason_matches_last_60_days"]) == (1, 0)
    assert got["home_non_pl_points_equiv_last5"] == pytest.approx(2.10)
    empty = one(K.non_league_context(to_long(late), rows.limit(0)))
    assert empty["home_days_since_any_match"] == 0


def test_absence_feeds(spark):
    day = F.lit("2026-08-01").cast("date")
    payload = {"response": [
        {"player": {"name": "P1"}, "team": {"name": "A"}, "fixture": {"date": "2026-09-01T15:00:00+00:00"}, "type": "Missing", "reason": "Hamstring"},
        {"player": {"name": "P2"}, "team": {"name": "A"}, "fixture": {"date": "2026-09-01T15:00:00+00:00"}, "type": "Missing", "reason": "Red card suspension"},
    ]}
    rows = A.from_fixture_feed(spark.createDataFrame([(json.dumps(payload),)], "j string"), "j", day).orderBy("player").collect()
    assert [(r.status_type, r.is_suspended) for r in rows] == [("injury", 0.0), ("suspension", 1.0)]
    item = {"participant": {"name": "A"}, "player": {"display_name": "P"}, "type": {"name": "Muscle"},
            "sideline": {"category": "injury", "start_date": "2026-09-01", "end_date": "2026-10-01"}}
    for data in ({"id": 1, "sidelined": [item]}, [{"id": 1, "sidelined": {"data": [item]}}]):
        r = A.from_sidelined_feed(spark.createDataFrame([(json.dumps({"data": data}),)], "j string"), "j", day).first()
        assert (r.team, r.player, str(r.unavailable_from), str(r.expected_return_date), r.status_type) == ("A", "P", "2026-09-01", "2026-10-01", "injury")


def test_suspension_shift_and_cap(spark):
    m = matches(spark, [(D0(2026, 9, 12), "A", "B", 0, 0, 1, 1, 1, 1)])
    p = m.withColumns({"p_home": F.lit(0.55), "p_draw": F.lit(0.25), "p_away": F.lit(0.20)})
    s = spark.createDataFrame(
        [("A", "x", D0(2026, 9, 1), None, 1.0, 1.0, 1.0), ("A", "back", D0(2026, 8, 1), D0(2026, 9, 1), 1.0, 1.0, 1.0), ("A", "served", D0(2026, 9, 1), None, 0.0, 1.0, 1.0)],
        "team string, player string, suspended_from date, suspended_until date, matches_remaining double, expected_starter double, importance_score double",
    )
    assert [r.player for r in V.active_suspensions(to_long(m), s).collect()] == ["x"]
    r = V.suspension_adjust(p, to_long(m), s).first()
    assert r.home_impact == pytest.approx(0.04)
    assert r.adj_p_home < 0.55 and r.adj_p_draw > 0.25 and r.adj_p_away > 0.20
    assert r.adj_p_home + r.adj_p_draw + r.adj_p_away == pytest.approx(1.0)
    cap = spark.range(1).select(V.suspension_impact(F.lit(1.0), F.lit(5.0), F.lit(3.0)).alias("i")).first().i
    assert cap == pytest.approx(0.04)


def test_probability_algebra(spark):
    lit = lambda *v: tuple(F.lit(x) for x in v)
    b = X.blend(lit(0.6, 0.3, 0.1), lit(0.2, 0.3, 0.5), F.lit(0.5))
    t = X.temperature_scale(lit(0.7, 0.2, 0.1), F.lit(1.5))
    r = spark.range(1).select(*[c.alias(f"b{i}") for i, c in enumerate(b)], *[c.alias(f"t{i}") for i, c in enumerate(t)]).first()
    assert (r.b0, r.b1, r.b2) == pytest.approx((0.4, 0.3, 0.3))
    assert r.t0 < 0.7 and r.t2 > 0.1 and r.t0 + r.t1 + r.t2 == pytest.approx(1)


def test_scorelines(spark):
    df = spark.createDataFrame([(1, 2.0, 1.1, 1.0, 1.8, 0.58, 0.30, 0.12)],
                               "match_id long, home_xg_avg double, away_xg_avg double, home_xga_avg double, away_xga_avg double, p_home double, p_draw double, p_away double")
    est = G.estimate_scorelines(df)
    b = G.bucket_probabilities(G.scoreline_grid(est)).first()
    assert (b.home, b.draw, b.away) == pytest.approx((0.58, 0.30, 0.12), abs=1e-8)
    r = est.first()
    assert r.pred_h > r.pred_a
    tops = G.top_scorelines(est).where("bucket = 'home'").collect()
    assert len(tops) == 3 and all(x.h > x.a for x in tops)
    bare = G.with_cells(G.expected_goals(df.select("match_id", "p_home", "p_draw", "p_away")))
    assert sum(c.p for c in bare.first().cells) == pytest.approx(1.0, abs=1e-8)


def test_fixture_context_with_cup_ties(spark):
    league = spark.createDataFrame([(1, D0(2026, 11, 2), "Arsenal", "B")], "match_id long, match_date date, home string, away string")
    cup = spark.createDataFrame([("29/10/2026", "Arsenal", "B")], "Date string, HomeTeam string, AwayTeam string")
    whole = K.add_supplemental_fixtures(league.withColumnRenamed("match_date", "date"), cup)
    got = one(K.fixture_schedule_context(league, whole))
    assert (got["home_days_rest"], got["away_days_rest"], got["home_midweek_fixture_flag"]) == (4, 4, 1)


def test_fixture_list_is_valid(spark):
    teams = [f"T{i:02d}" for i in range(20)]
    rows = [("2026/27", 1, "2026-08-21", "20:00", "21:00", h, a, "s", "u", "scheduled", "now") for h in teams for a in teams if h != a]
    checks = D.validate_fixtures(spark.createDataFrame(rows, S.FIXTURES.names))
    assert {r.status for r in checks.collect()} == {"pass"}
    assert D.fixture_mode(checks).first().mode == "Official fixtures loaded"
    assert "fail" in {r.status for r in D.validate_fixtures(spark.createDataFrame(rows[:-1], S.FIXTURES.names)).collect()}


def promoted_case(spark, current, points):
    tier = matches(spark, [(D0(2026, 4, 1 + i), "Coventry", f"O{i}", hg, ag, 12, 8, 5, 2) for i, (hg, ag) in enumerate([(2, 0), (1, 1), (3, 1), (2, 0), (1, 0)])])
    teams = spark.createDataFrame([("p", "Coventry")], "pool string, team string")
    hist = matches(spark, [(D0(2025, 9, 1 + i), "X", "Y", 1, 0, 10, 8, 4, 3) for i in range(6)])
    own = [(D0(2026, 8, 20 + i), "Coventry", "X", *((2, 0) if i * 3 < points - points % 3 else (1, 1) if i < points // 3 + points % 3 else (0, 1)), 9, 9, 3, 3) for i in range(current)]
    league = hist if not own else hist.unionByName(matches(spark, own).withColumn("match_id", F.col("match_id") + 100))
    snap = K.team_snapshot(to_long(league))
    return N.adjusted_features(
        teams, snap, N.feature_medians(snap), N.promoted_baseline(league), N.tier_summary(tier), N.current_records(league, "2026"),
        N.promoted_teams(league).where("season = '2026'"),
    ).first()


def test_promoted_adjustment(spark):
    r = promoted_case(spark, 0, 0)
    assert r.adj_points_last_5 == pytest.approx(7.15)
    assert r.adj_xg_avg == pytest.approx(9 / 5 * 0.75) and r.adj_xga_avg == pytest.approx(2 / 5 * 1.35)
    r = promoted_case(spark, 4, 0)
    assert r.current_season_blend_weight == pytest.approx(0.8) and r.adj_points_last_5 == pytest.approx(7.15 * 0.2)
    r = promoted_case(spark, 5, 8)
    assert (r.promotion_adjustment_applied, r.adj_points_last_5) == (0, 8.0)


def test_squad_strength(spark):
    s = spark.createDataFrame([("s", "A", 1e9), ("s", "B", 1e8), ("s", "C", None)], "season string, team string, squad_market_value_eur double")
    got = {r.team: r for r in N.normalize_squad_strength(s).collect()}
    assert got["A"].squad_strength_rank == 1 and got["A"].squad_strength_score > got["B"].squad_strength_score
    assert got["C"].squad_strength_bucket == "Missing" and got["C"].squad_strength_score is None
    p = matches(spark, [(D0(2026, 8, 20), "A", "B", 0, 0, 1, 1, 1, 1)]).withColumns({"p_home": F.lit(0.4), "p_draw": F.lit(0.3), "p_away": F.lit(0.3)})
    scores = spark.createDataFrame([("A", 1.0), ("B", 0.0)], "team string, score double")
    r = T.squad_prior(p, scores).first()
    assert 0.40 < r.adj_p_home < 0.45 and r.adj_p_away < 0.30


def weeks(spark, played):
    fx = [("p", f"H{w}{i}", f"A{w}{i}", w) for w in range(1, 5) for i in range(10)]
    fixtures = spark.createDataFrame(fx, "pool string, home string, away string, matchweek int")
    done = spark.createDataFrame([f[:3] for f in fx][:played], "pool string, home string, away string")
    return Q.matchweek_progress(done, fixtures).first()


def test_matchweek_progress(spark):
    r = weeks(spark, 39)
    assert (r.latest_full, r.latest_started, r.reference, r.first_open) == (3, 4, None, 4)
    r = weeks(spark, 40)
    assert (r.latest_full, r.latest_started, r.reference) == (4, 4, 3)


def test_position_movement(spark):
    rows = lambda a, b: [("p", "A", a), ("p", "B", b), ("q", "A", 7)]
    of = lambda a, b: spark.createDataFrame(rows(a, b), "pool string, team string, projected_position int")
    moved = Q.position_movement(of(2, 1), of(1, 2), of(3, 1))
    assert moved.count() == 3
    got = {r.team: r for r in moved.where("pool = 'p'").collect()}
    assert (got["A"].position_change_since_season_start, got["A"].position_change_since_previous_round) == (-1, 1)
    assert (got["B"].position_change_since_season_start, got["B"].position_change_since_previous_round) == (1, 0)


def test_short_season_is_ignored_for_long_term_strength(spark):
    rows = [(D0(2024, 8, 1) + dt.timedelta(days=i % 200), "A", "B", 3, 0, 1, 1, 1, 1) for i in range(300)]
    rows += [(D0(2026, 8, 1) + dt.timedelta(days=i), "B", "A", 3, 0, 1, 1, 1, 1) for i in range(20)]
    m = matches(spark, rows)
    teams = spark.createDataFrame([("p", "A"), ("p", "B")], "pool string, team string")
    state = spark.createDataFrame([("p", "A", 1500.0), ("q", "A", 900.0)], "pool string, team string, rating double")
    got = {r.team: r.strength for r in N.long_term_strength(m, teams, state).collect()}
    assert got["A"] > 0 > got["B"]


def test_seasons_below_the_rule_leave_the_rating_alone(spark):
    """Without a season of 300 matches points and differences are even, so the strength is the rating's part."""
    m = matches(spark, [(D0(2024, 8, 1) + dt.timedelta(days=i % 200), "A", "B", 3, 0, 1, 1, 1, 1) for i in range(299)])
    teams = spark.createDataFrame([("p", "A"), ("p", "B")], "pool string, team string")
    state = spark.createDataFrame([("p", "A", 1400.0), ("p", "B", 1600.0)], "pool string, team string, rating double")
    got = {r.team: r.strength for r in N.long_term_strength(m, teams, state).collect()}
    assert got == pytest.approx({"A": -0.15, "B": 0.15})


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,HS\n21/08/2020,A,B,1,0,H,9\nbad,A,B,1,0,H,9\n")
    (tmp_path / "b.csv").write_text("Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR\n2021-08-21,A,C,0,0,D\n")
    m = RD.read_matches(spark, {"2021": str(tmp_path / "a.csv"), "2122": str(tmp_path / "b.csv")})
    assert sorted((r.season, str(r.match_date), r.hg, r.hs) for r in m.collect()) == [("2021", "2020-08-21", 1, 9.0), ("2122", "2021-08-21", 0, None)]
    body = {"dates": [{"id": "1", "isResult": True, "datetime": "2020-08-21 19:00:00", "h": {"title": "Manchester City"}, "a": {"title": "B"},
                       "goals": {"h": "1", "a": "0"}, "xG": {"h": "1.5", "a": "0.5"}}, {"id": "2", "isResult": False}]}
    (tmp_path / "x.json").write_text(json.dumps(body, indent=1))
    xg = RD.read_xg_json(spark, str(tmp_path / "x.json"), "2021").collect()
    assert [(r.home, r.hxg, str(r.match_date)) for r in xg] == [("Man City", 1.5, "2020-08-21")]
    (tmp_path / "s.csv").write_text("team,player,suspended_from,matches_remaining\nA,P,2026-09-01,x\n,Q,2026-09-01,1\n")
    s = RD.read_table_with_defaults(spark, str(tmp_path / "s.csv"), S.SUSPENSIONS, required=["team", "player", "suspended_from"])
    assert [(r.player, r.matches_remaining, r.importance_score) for r in s.collect()] == [("P", 0.0, 0.0)]
    sub = tmp_path / "dir"
    sub.mkdir()
    for n in ("u", "v"):
        (sub / f"{n}.csv").write_text(f"k\n{n}1\n")
    assert sorted((r.k, r.source_file) for r in RD.read_csv_dir(spark, str(sub)).collect()) == [("u1", "u.csv"), ("v1", "v.csv")]


def test_require_complete_names_the_rows(spark):
    df = spark.createDataFrame([("2021", D0(2020, 8, 21), "A", "B", None)], "season string, match_date date, home string, away string, hxg double")
    with pytest.raises(ValueError, match="missing values"):
        RD.require_complete(df, ["hxg"])


def test_duplicate_join_key_raises(spark):
    from matchframe.operators.joins import join_one_to_one

    left = spark.createDataFrame([(1,)], "k int")
    right = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="join key is not unique"):
        join_one_to_one(left, right, ["k"]).collect()


def test_logs_grow_and_latest_is_replaced(spark, tmp_path):
    p = spark.createDataFrame([(1, 0.5, 0.3, 0.2)], "match_id long, p_home double, p_draw double, p_away double")
    log, latest = str(tmp_path / "log"), str(tmp_path / "latest")
    for at in ("t1", "t2"):
        sinks.append_snapshot(sinks.forecast_snapshot(p, F.lit(at), "v1"), log, latest)
    assert spark.read.parquet(log).count() == 2
    assert [r.snapshot_time_utc for r in spark.read.parquet(latest).collect()] == ["t2"]
    sinks.append_experiment(spark, {"name": "x", "metrics": {"a": 1}}, str(tmp_path / "exp"))
    sinks.append_experiment(spark, {"name": "y"}, str(tmp_path / "exp"))
    assert spark.read.parquet(str(tmp_path / "exp")).count() == 2
    for fmt in ("parquet", "csv", "json"):
        sinks.write_table(p, str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).option("header", True).load(str(tmp_path / fmt)).count() == 1


def test_calibration_needs_the_same_columns(spark):
    from matchframe.operators.ml import Calibrator, apply_calibration

    p = spark.createDataFrame([(0.5, 0.3, 0.2)], "p_home double, p_draw double, p_away double")
    layer = Calibrator(("a", "b"), "sigmoid", ())
    for given in (layer, None):
        r = apply_calibration(p, given, ["a", "c"]).first()
        assert (r.method, r.p_home) == ("raw", 0.5)


def test_calibration_and_bootstrap(spark):
    from matchframe.operators import ml as M

    rows = [(i, float(i % 7), float(i % 3), 0 if i % 7 > 4 else 1 if i % 3 == 0 else 2) for i in range(400)]
    df = spark.createDataFrame(rows, "match_id long, x double, y double, target int")
    train, test = df.where("match_id < 300"), df.where("match_id >= 300")
    model = M.fit_outcome_model(train, ["x", "y"], kind="logistic")
    scored = model.transform(test)
    assert all(abs(r.p_home + r.p_draw + r.p_away - 1) < 1e-9 for r in scored.collect())
    prior = -sum(n / 300 * math.log(n / 300) for n in [train.where(f"target = {k}").count() for k in range(3)])
    assert M.metrics_of(scored.withColumn("model_version", F.lit("m"))).first().log_loss < prior
    layer = M.fit_calibrator(scored, ["x", "y"], "isotonic")
    got = M.apply_calibration(scored, layer, ["x", "y"]).first()
    assert got.method == "isotonic" and abs(got.p_home + got.p_draw + got.p_away - 1) < 1e-9
    spread = M.bootstrap_models(train, test, ["x", "y"], n=3, kind="logistic")
    assert spread.count() == 300 and spread.where("lower_95 > mean + 1e-9 OR upper_95 < mean - 1e-9").count() == 0
    drops = {r.feature: r.importance for r in M.permutation_importance(model, test, reps=2).collect()}
    assert drops["x"] > 0
    shares = M.additive_contributions(model, test).groupBy("feature").agg(F.sum("mean_abs_contribution").alias("s"))
    assert {r.feature for r in shares.where("s > 0").collect()} == {"x", "y"}


def test_same_name_in_two_pools(spark):
    """Snapshots, tier summaries and overrides keep the pools apart."""
    rows = [(D0(2026, 4, 1 + i), "A", "B", 1 + i % 2, 0, 9, 8, 4, 3) for i in range(6)]
    one = matches(spark, rows)
    other = matches(spark, [(d, h, a, hg + 3, 1, *r) for d, h, a, hg, _, *r in rows]).withColumns(
        {"pool": F.lit("q"), "match_id": F.col("match_id") + 100}
    )
    both = one.unionByName(other)
    snap = {(r.pool, r.team): r for r in K.team_snapshot(to_long(both)).collect()}
    assert len(snap) == 4 and snap["p", "A"].match_count == 6
    assert snap["q", "A"].goals_scored_avg == pytest.approx(snap["p", "A"].goals_scored_avg + 3)
    tier = {(r.pool, r.team): r.goals_for_avg_last5 for r in N.tier_summary(both).collect()}
    assert len(tier) == 4 and tier["q", "A"] == pytest.approx(tier["p", "A"] + 3)
    audit = spark.createDataFrame([("p", "A", 1, 1), ("q", "A", 1, 1)], "pool string, team string, fallback_used int, promotion_adjustment_applied int")
    audit = audit.withColumns({"adj_" + c: F.when(F.col("pool") == "p", 1.0).otherwise(2.0) for c in N.OVERRIDES})
    fixtures = spark.createDataFrame([(1, "p", "A", "B", 9.0), (2, "q", "A", "B", 9.0)], "match_id long, pool string, home string, away string, home_xg_avg double")
    got = {r.match_id: r.home_xg_avg for r in N.apply_overrides(fixtures, N.feature_overrides(audit)).collect()}
    assert got == {1: 1.0, 2: 2.0}


def test_page_text_is_decoded(spark):
    payload = '{"h_shot":"16","a_shot":"13","h_shotOnTarget":"9","a_shotOnTarget":"5"}'
    spelled = [
        payload.replace('"', '\\"'), payload.replace('"', "\\x22").replace("_", "\\x5F"), payload.replace('"', "\\u0022"), payload,
        "\\x7B" + payload[1:-1].replace(":", "\\x3A") + "\\x7D",
    ]
    rows = [(i, f"var match_info = JSON.parse('{p}')") for i, p in enumerate(spelled)] + [(9, "none"), (10, None)]
    got = {r.k: (r.hs, r.as_, r.hst, r.ast) for r in RD.extract_match_info(spark.createDataFrame(rows, "k int, html string")).collect()}
    assert all(got[i] == (16, 13, 9, 5) for i in range(5)) and got[9] == got[10] == (None,) * 4
    texts = ["<b>a&amp;b</b>", "&#39;x&#x27; &eacute;&Eacute; &nope; & &#128512;", "&lt;i&gt;", "plain", "\\uD83D\\uDE00 \\\\ \\n|"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.s for r in df.select(RD.strip_tags(F.col("t")).alias("s")).collect()]
    assert got[:4] == ["a&b", "'x' \u00e9\u00c9 &nope; & \U0001f600", "<i>", "plain"]
    assert df.select(RD.unescape_string(F.col("t")).alias("s")).collect()[4].s == "\U0001f600 \\ \n|"


def test_drawdown_by_days(spark):
    rows = [(1, D0(2020, 1, 1 + i // 3), "home", float(p)) for i, p in enumerate([2, -1, -1, -1, 3, -1, -1, -1, -1, 5, -1])]
    rows = [("k", i, d, t, p) for i, (_, d, t, p) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k string, match_id int, match_date date, bet_type string, profit double")
    from matchframe.operators.betting import max_drawdown

    total = peak = worst = 0.0
    for r in rows:
        total += r[4]
        peak = max(peak, total)
        worst = max(worst, peak - total)
    assert max_drawdown(df, ["k"]).first().maximum_drawdown == worst
