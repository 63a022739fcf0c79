"""Season-start strength (N) and season projection (Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchframe.operators import context as X
from matchframe.operators import rolling as R
from matchframe.operators import season as Q
from matchframe.operators import strength as N
from matchframe.operators import tuning as T
from matchframe.plans.feature_queries import _SNAP_SQL
from matchframe.plans.registry import query
from matchframe.plans.stages import staged
from matchframe.plans.tables import CTES, LATEST, Tables

# Of each league's twenty teams, sixteen play in the top tier in a given season.
_TOP = "(home * 7 + season * 3) % 5 <> 0 AND (away * 7 + season * 3) % 5 <> 0"
CTES["league"] = f"SELECT * FROM @matches WHERE {_TOP}"
CTES["tier"] = f"SELECT * FROM @matches WHERE NOT ({_TOP}) AND season < {LATEST}"


def long_sql(src: str) -> str:
    return f"""SELECT match_id, pool, season, match_date, home AS team, hg AS gf, ag AS ga, hxg AS xgf, axg AS xga, hs AS sf, as_ AS sa, hst AS sotf, ast AS sota,
      CASE WHEN hg > ag THEN 3 WHEN hg = ag THEN 1 ELSE 0 END AS points FROM {src}
    UNION ALL SELECT match_id, pool, season, match_date, away, ag, hg, axg, hxg, as_, hs, ast, hst, CASE WHEN ag > hg THEN 3 WHEN hg = ag THEN 1 ELSE 0 END FROM {src}"""


_TABLE = f"""lt AS ({long_sql("@league")}), st AS (SELECT pool, season, team, count(*) AS played, sum(points) AS points, sum(gf) AS gf, sum(ga) AS ga, sum(gf) - sum(ga) AS gd FROM lt GROUP BY ALL),
  tb AS (SELECT *, row_number() OVER (PARTITION BY pool, season ORDER BY points DESC, gd DESC, gf DESC, team) AS position FROM st)"""


@query("N1_season_table", "pool:i season:i team:i played:i points:i gf:i ga:i gd:i position:i", f"WITH {_TABLE} SELECT * FROM tb")
def n1(t: Tables):
    return N.season_table(t.league)


_PROMOTED = """sn AS (SELECT pool, season, lag(season) OVER (PARTITION BY pool ORDER BY season) AS prev FROM (SELECT DISTINCT pool, season FROM st) AS d),
  pr AS (SELECT st.pool, st.season, st.team FROM st JOIN sn USING (pool, season) WHERE prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM st b WHERE b.pool = st.pool AND b.season = sn.prev AND b.team = st.team))"""


@query("N2_promoted_teams", "pool:i season:i team:i", f"WITH {_TABLE}, {_PROMOTED} SELECT * FROM pr")
def n2(t: Tables):
    return N.promoted_teams(t.league)


_BASE = """bl AS (SELECT pool, avg(points) AS average_points, median(points) AS median_points, avg(position) AS average_position, median(position) AS median_position,
  avg(CASE WHEN position >= 18 THEN 1.0 ELSE 0 END) AS relegation_rate, avg(gf / 38.0) AS goals_for_per_match, avg(ga / 38.0) AS goals_against_per_match FROM tb JOIN pr USING (pool, season, team) GROUP BY pool)"""


@query(
    "N3_promoted_baseline",
    "pool:i average_points:d6 median_points:d4 average_position:d6 median_position:d4 relegation_rate:d6 goals_for_per_match:d8 goals_against_per_match:d8",
    f"WITH {_TABLE}, {_PROMOTED}, {_BASE} SELECT * FROM bl",
)
def n3(t: Tables):
    return N.promoted_baseline(t.league)


@query("N4_current_records", "pool:i team:i matches:i points:i", f"WITH {_TABLE} SELECT pool, team, played AS matches, points FROM tb WHERE season = {LATEST}")
def n4(t: Tables):
    return N.current_records(t.league, t.latest)


_TIER_COLS = "points_last5 goals_for_avg_last5 goals_against_avg_last5 shots_avg_last5 shots_on_target_avg_last5 shots_avg_last10 shots_on_target_avg_last10 xg_avg_last5 xga_avg_last5 shots_avg_season shots_on_target_avg_season".split()
_TIER = f"""tl AS ({long_sql("@tier")}), tn AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) AS rn FROM tl),
  tr AS (SELECT team, count(*) AS source_matches, max(match_date) AS tier_latest, sum(points) FILTER (WHERE rn <= 5) AS points_last5, avg(gf) FILTER (WHERE rn <= 5) AS goals_for_avg_last5,
    avg(ga) FILTER (WHERE rn <= 5) AS goals_against_avg_last5, coalesce(avg(sf) FILTER (WHERE rn <= 5), 0) AS shots_avg_last5, coalesce(avg(sotf) FILTER (WHERE rn <= 5), 0) AS shots_on_target_avg_last5,
    coalesce(avg(sf) FILTER (WHERE rn <= 10), 0) AS shots_avg_last10, coalesce(avg(sotf) FILTER (WHERE rn <= 10), 0) AS shots_on_target_avg_last10, avg(xgf) FILTER (WHERE rn <= 5) AS xg_avg_last5,
    avg(xga) FILTER (WHERE rn <= 5) AS xga_avg_last5, coalesce(avg(sf), 0) AS shots_avg_season, coalesce(avg(sotf), 0) AS shots_on_target_avg_season FROM tn GROUP BY team)"""


@query("N5_tier_summary", "team:i source_matches:i " + " ".join(c + ":d6" for c in _TIER_COLS), f"WITH {_TIER} SELECT * FROM tr")
def n5(t: Tables):
    return N.tier_summary(t.tier)


def _snapshot(t: Tables):
    from matchframe.operators.longform import to_long

    return X.team_snapshot(to_long(t.league))


_MEDIANS = ", ".join(f"median({c}) AS med_{c}" for c in N.ADJUSTED)
_HIST = f"hist AS ({long_sql('@league')}), {_SNAP_SQL}, md AS (SELECT floor(team / 20)::BIGINT AS pool, {_MEDIANS} FROM snap WHERE match_count >= 5 GROUP BY ALL)"


@query("N6_feature_medians", "pool:i " + " ".join(f"med_{c}:d6" for c in N.ADJUSTED), f"WITH {_HIST} SELECT * FROM md")
def n6(t: Tables):
    return N.feature_medians(_snapshot(t))


def _adjusted(t: Tables):
    """Season table, snapshot and second-tier summary are made once and staged."""
    now = F.col("season") == t.latest
    teams = t.matches.where(now).select("pool", F.explode(F.array("home", "away")).alias("team")).distinct()
    table, snap = staged(N.season_table(t.league)), staged(_snapshot(t))
    records = table.where(now).select("pool", "team", F.col("played").alias("matches"), "points")
    rows = N.adjusted_features(
        teams, snap, N.feature_medians(snap), N.promoted_baseline(t.league, table=table), N.tier_summary(t.tier),
        records, N.promoted_in(table).where(now),
    )
    return staged(rows)


def _adjusted_sql() -> str:
    raw = ", ".join(f"coalesce(snap.{c}, 0) AS {c}" for c in N.ADJUSTED)
    med = ", ".join(f"coalesce(md.med_{c}, {N.MEDIAN_FALLBACK[c]}) AS med_{c}" for c in N.ADJUSTED)
    cautious = {
        "points_last_5": "least(med_points_last_5 * 0.85, median_points / 38 * 5)", "goals_scored_avg": "least(med_goals_scored_avg * 0.85, gfm)",
        "xg_avg": "least(med_xg_avg * 0.82, gfm * 0.95)", "xga_avg": "greatest(med_xga_avg * 1.18, gam * 0.95)",
        **{c: f"med_{c} * 0.82" for c in N.ADJUSTED if c.startswith("shots")},
    }
    src = dict(N.ADJUSTED)
    adj = ", ".join(
        f"CASE WHEN own THEN {c} ELSE (1 - w) * CASE WHEN has_tier THEN t_{s} * {f} ELSE {cautious[c]} END + w * {c} END AS adj_{c}" for c, (s, f) in src.items()
    )
    tier = ", ".join(f"tr.{s} AS t_{s}" for s in dict.fromkeys(s for s, _ in src.values()))
    return f"""{_TABLE}, {_PROMOTED}, {_BASE}, {_TIER}, {_HIST},
    tm AS (SELECT DISTINCT pool, team FROM @t WHERE season = {LATEST}),
    rc AS (SELECT team, played, points FROM tb WHERE season = {LATEST}), pt AS (SELECT DISTINCT team FROM pr WHERE season = {LATEST}),
    jn AS (SELECT tm.pool, tm.team, coalesce(snap.match_count, 0) AS match_count, {raw}, {tier}, tr.team IS NOT NULL AS has_tier, coalesce(rc.played, 0) AS season_matches, coalesce(rc.points, 0) AS season_points,
      CASE WHEN pt.team IS NOT NULL THEN 1 ELSE 0 END AS is_promoted, {med}, coalesce(bl.median_points, 34.0) AS median_points, coalesce(bl.goals_for_per_match, 1.05) AS gfm, coalesce(bl.goals_against_per_match, 1.7) AS gam
      FROM tm LEFT JOIN snap ON snap.team = tm.team LEFT JOIN tr ON tr.team = tm.team LEFT JOIN rc ON rc.team = tm.team LEFT JOIN pt ON pt.team = tm.team LEFT JOIN md ON md.pool = tm.pool LEFT JOIN bl ON bl.pool = tm.pool),
    ow AS (SELECT *, is_promoted = 1 AND season_matches < 5 AS nw, match_count >= 5 AND NOT (is_promoted = 1 AND season_matches < 5) AS own FROM jn),
    wt AS (SELECT *, CASE WHEN own THEN 1.0 WHEN nw AND season_matches > 0 THEN least(1.0, season_matches / 5.0) ELSE 0.0 END::DOUBLE AS w FROM ow),
    ad AS (SELECT *, {adj}, CASE WHEN own THEN '{N.PL}' WHEN has_tier THEN '{N.TIER}' ELSE '{N.BASE}' END AS source_league, CASE WHEN own THEN 0 ELSE 1 END AS promotion_adjustment_applied,
      CASE WHEN NOT own AND NOT has_tier THEN 1 ELSE 0 END AS fallback_used FROM wt)"""


_ADJ = [f"adj_{c}" for c in N.ADJUSTED]


@query(
    "N7_adjusted_features",
    "pool:i team:i match_count:i current_season_blend_weight:d4 source_league:s promotion_adjustment_applied:i fallback_used:i " + " ".join(c + ":d6" for c in _ADJ),
    f"WITH {_adjusted_sql()} SELECT *, w AS current_season_blend_weight FROM ad",
)
def n7(t: Tables):
    return _adjusted(t)


_AUDIT_SQL = f"""{_adjusted_sql()}, au AS (SELECT *, CASE WHEN is_promoted = 1 THEN season_matches ELSE match_count END AS act FROM ad),
  fl AS (SELECT *, concat_ws(', ', CASE WHEN act = 0 THEN 'no_premier_league_history' END, CASE WHEN act > 0 AND act < 5 THEN 'limited_recent_form' END,
    CASE WHEN act < 5 THEN 'xg_fallback' END, CASE WHEN act < 5 THEN 'shot_volume_fallback' END) AS f FROM au)"""


@query(
    "N8_season_start_audit",
    "team:i fallback_flags:s promoted_team_uncertainty_flag:i fallback_reason:s",
    f"""WITH {_AUDIT_SQL} SELECT team, CASE WHEN f = '' THEN 'none' ELSE f END AS fallback_flags, CASE WHEN act < 5 THEN 1 ELSE 0 END AS promoted_team_uncertainty_flag,
      CASE WHEN own THEN 'none' WHEN has_tier THEN 'Championship recent form, xG/xGA and shot volume converted to Premier League-equivalent values.'
      ELSE 'No local Premier League history; Championship data is not treated as Premier League-equivalent.' END
      || CASE WHEN NOT own AND w > 0 THEN ' Current-season Premier League form is blended in at ' || CAST(CAST(round(w * 100) AS INT) AS VARCHAR) || '% until five PL matches are available.' ELSE '' END AS fallback_reason FROM fl""",
)
def n8(t: Tables):
    return N.season_start_audit(_adjusted(t))


@query(
    "N9_feature_overrides",
    "match_id:i home_points_last_5:d6 away_points_last_5:d6 home_xg_avg:d6 away_xg_avg:d6",
    f"""WITH {_adjusted_sql()}, ov AS (SELECT team, adj_points_last_5 AS p, adj_xg_avg AS x FROM ad WHERE fallback_used = 1 OR promotion_adjustment_applied = 1)
    SELECT m.match_id, coalesce(h.p, 1) AS home_points_last_5, coalesce(a.p, 2) AS away_points_last_5, coalesce(h.x, hxg) AS home_xg_avg, coalesce(a.x, axg) AS away_xg_avg
    FROM @matches m LEFT JOIN ov h ON h.team = m.home LEFT JOIN ov a ON a.team = m.away WHERE season = {LATEST}""",
)
def n9(t: Tables):
    f = t.matches.where(F.col("season") == t.latest).select(
        "match_id", "pool", "home", "away", F.lit(1.0).alias("home_points_last_5"), F.lit(2.0).alias("away_points_last_5"),
        F.col("hxg").alias("home_xg_avg"), F.col("axg").alias("away_xg_avg"),
    )
    return N.apply_overrides(f, N.feature_overrides(N.season_start_audit(_adjusted(t))))


@query(
    "N10_validate_projection_inputs",
    "pool:i status:s teams:i",
    f"""WITH {_adjusted_sql()}, vv AS (SELECT pool, CASE WHEN match_count < 5 AND fallback_used = 0 AND promotion_adjustment_applied = 0 THEN 3 WHEN fallback_used = 1 THEN 2 WHEN promotion_adjustment_applied = 1 THEN 1 ELSE 0 END AS l FROM ad)
    SELECT pool, (['Ready', 'Adjusted', 'Fallback', 'Error'])[max(l) + 1] AS status, count(*) AS teams FROM vv GROUP BY pool""",
)
def n10(t: Tables):
    v = N.validate_projection_inputs(N.season_start_audit(_adjusted(t)))
    return N.projection_status(v, ["pool"])


@query(
    "N11_long_term_strength",
    "pool:i team:i strength:d6",
    f"""WITH {_TABLE}, full_ AS (SELECT pool, season, count(*) AS n FROM @league GROUP BY ALL HAVING count(*) >= 80),
    rs AS (SELECT pool, season FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY season DESC) AS rn FROM full_) AS x WHERE rn <= 2),
    s AS (SELECT pool, team, sum(points) / sum(played) AS ppg, sum(gd) / sum(played) AS gdm FROM tb JOIN rs USING (pool, season) GROUP BY ALL),
    tm AS (SELECT DISTINCT pool, team FROM @t), j AS (SELECT tm.pool, tm.team, s.ppg, s.gdm, (tm.team % 31) * 10 + 1350.0 AS elo FROM tm LEFT JOIN s ON s.pool = tm.pool AND s.team = tm.team),
    f AS (SELECT pool, team, elo, coalesce(ppg, median(ppg) OVER (PARTITION BY pool), 1) AS ppg, coalesce(gdm, median(gdm) OVER (PARTITION BY pool), 0) AS gdm FROM j)
    SELECT pool, team, {" + ".join(f"{w} * CASE WHEN stddev_pop({c}) OVER q > 0 THEN ({c} - avg({c}) OVER q) / stddev_pop({c}) OVER q ELSE 0 END" for w, c in ((0.55, "ppg"), (0.3, "gdm"), (0.15, "elo")))} AS strength
    FROM f WINDOW q AS (PARTITION BY pool)""",
)
def n11(t: Tables):
    teams = t.long.select("pool", "team").distinct()
    state = teams.select("pool", "team", ((F.col("team") % 31) * 10 + 1350.0).alias("rating"))
    return N.long_term_strength(t.league, teams, state, least=80)


_SQUADS = """SELECT season, team, CASE WHEN team % 9 = 0 THEN NULL ELSE 1000000.0 * (1 + (team * 37 + season) % 400) END AS squad_market_value_eur,
  CASE WHEN team % 5 = 0 THEN 1.0 ELSE 0.0 END AS promoted_team_flag FROM (SELECT DISTINCT season, team FROM @t) AS s"""


@query(
    "N12_normalize_squad_strength",
    "season:i team:i squad_strength_score:d8 squad_strength_rank:d1 squad_strength_percentile:d8 squad_strength_bucket:s",
    f"""WITH s AS ({_SQUADS}), r AS (SELECT *, ln(squad_market_value_eur) AS lg, CASE WHEN squad_market_value_eur IS NOT NULL THEN rank() OVER (PARTITION BY season ORDER BY squad_market_value_eur DESC NULLS LAST) END AS rk,
      min(ln(squad_market_value_eur)) OVER q AS lo, max(ln(squad_market_value_eur)) OVER q AS hi, count(squad_market_value_eur) OVER q AS n FROM s WINDOW q AS (PARTITION BY season))
    SELECT season, team, (lg - lo) / greatest(hi - lo, 1e-9) AS squad_strength_score, rk AS squad_strength_rank, 1 - (rk - 1.0) / greatest(n - 1, 1) AS squad_strength_percentile,
      CASE WHEN rk IS NULL THEN 'Missing' WHEN promoted_team_flag > 0 AND rk > 12 THEN 'Promoted / uncertain' WHEN rk <= 4 THEN 'Elite' WHEN rk <= 8 THEN 'Strong' WHEN rk <= 14 THEN 'Mid-table' ELSE 'Lower-table' END AS squad_strength_bucket FROM r""",
)
def n12(t: Tables):
    return N.normalize_squad_strength(t.sql(_SQUADS))


@query(
    "N13_feature_parity",
    "feature:s rows:i differing:i max_abs_diff:d6",
    """WITH f AS (SELECT match_id, is_home, coalesce(sum(points) OVER w, 0) AS pts, coalesce(avg(xgf) OVER w, 0) AS xg FROM @t WINDOW w AS (PARTITION BY team ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
    d AS (SELECT 'home_points_last_5' AS feature, CASE WHEN match_id % 10 = 0 THEN 1.0 ELSE 0 END AS d FROM f WHERE is_home = 1 UNION ALL SELECT 'home_xg_avg', 0 FROM f WHERE is_home = 1)
    SELECT feature, count(*) AS rows, count(*) FILTER (WHERE d > 0) AS differing, max(d) AS max_abs_diff FROM d GROUP BY feature""",
)
def n13(t: Tables):
    a = R.match_features(t.long)
    b = R.form_features(t.long).join(R.xg_features(t.long), "match_id")
    b = b.withColumn("home_points_last_5", F.col("home_points_last_5") + F.when(F.col("match_id") % 10 == 0, 1).otherwise(0))
    long = N.feature_parity(a, b, ["home_points_last_5", "home_xg_avg"])
    return long.groupBy("feature").agg(
        F.count("*").alias("rows"), F.sum((F.col("abs_diff") > 1e-9).cast("long")).alias("differing"), F.max("abs_diff").alias("max_abs_diff")
    )


# --- Q ---------------------------------------------------------------------

# The 2001 season: one fixture per pairing, the early ones already played.
CTES["fixture_list"] = f"""SELECT pool, season, home, away, min(match_id) AS match_id, min(match_id) % 12 + 1 AS matchweek, min(match_date) AS match_date
FROM @matches WHERE season = {LATEST} GROUP BY pool, season, home, away"""
CTES["fixture_probs"] = "SELECT p.* FROM @probs AS p JOIN @fixture_list AS f ON f.match_id = p.match_id"
CTES["played"] = "SELECT m.* FROM @matches AS m JOIN @fixture_list AS f ON f.match_id = m.match_id WHERE f.matchweek <= 4 OR (f.matchweek = 5 AND m.match_id % 2 = 0)"
SIMS = 40


@query(
    "Q1_expected_points",
    "pool:i team:i expected_points_deterministic:d6",
    f"""WITH s AS ({long_sql("@played")}), x AS (SELECT pool, home AS team, 3 * p_home + p_draw AS x FROM @fixture_probs UNION ALL SELECT pool, away, 3 * p_away + p_draw FROM @fixture_probs
      UNION ALL SELECT pool, team, points FROM s) SELECT pool, team, sum(x) AS expected_points_deterministic FROM x GROUP BY ALL""",
)
def q1(t: Tables):
    return Q.expected_points(t.fixture_probs, Q.starting_points(t.played))


_SIMS = f"""u AS (SELECT p.*, sim, CAST(('0x' || substr(md5(concat_ws('-', '42', CAST(sim AS VARCHAR), CAST(match_id AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
    FROM {{probs}} AS p, (SELECT unnest(range({SIMS})) AS sim) AS g),
  o AS (SELECT *, CASE WHEN u < p_home / (p_home + p_draw + p_away) THEN 0 WHEN u < p_home / (p_home + p_draw + p_away) + p_draw / (p_home + p_draw + p_away) THEN 1 ELSE 2 END AS r FROM u),
  pp AS (SELECT pool, sim, home AS team, CASE r WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 0 END AS x FROM o UNION ALL SELECT pool, sim, away, CASE r WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE 3 END FROM o),
  sm AS (SELECT pool, sim, team, sum(x) AS points FROM pp GROUP BY ALL),
  rk AS (SELECT *, row_number() OVER (PARTITION BY pool, sim ORDER BY points DESC, team) AS pos, count(*) OVER (PARTITION BY pool, sim) AS n FROM sm),
  ps AS (SELECT pool, team, avg(points) AS expected_points, avg(pos) AS expected_position, avg(CASE WHEN pos = 1 THEN 1.0 ELSE 0 END) AS title_probability, avg(CASE WHEN pos <= 4 THEN 1.0 ELSE 0 END) AS top_4_probability,
    avg(CASE WHEN pos <= 6 THEN 1.0 ELSE 0 END) AS top_6_probability, avg(CASE WHEN pos >= n - 2 THEN 1.0 ELSE 0 END) AS relegation_probability FROM rk GROUP BY pool, team)"""
_SIM_PLAIN = _SIMS.format(probs="@fixture_probs")


@query("Q2_sample_seasons", "pool:i sim:i team:i points:d1", f"WITH {_SIM_PLAIN} SELECT * FROM sm")
def q2(t: Tables):
    return Q.sample_seasons(t.fixture_probs, SIMS)


_POS_COLS = "expected_points:d6 expected_position:d6 title_probability:d6 top_4_probability:d6 top_6_probability:d6 relegation_probability:d6"


@query("Q3_position_probabilities", "pool:i team:i " + _POS_COLS, f"WITH {_SIM_PLAIN} SELECT * FROM ps")
def q3(t: Tables):
    return Q.position_probabilities(Q.sample_seasons(t.fixture_probs, SIMS))


@query("Q4_project_season", "pool:i team:i projected_position:i expected_points_deterministic:d4 " + _POS_COLS)
def q4(t: Tables):
    """Anti-join the played fixtures, blend the long-term and squad priors, sample the rest."""
    long_term = T.long_term_prior(t.fixture_probs, t.team_scores)
    base = long_term.drop("p_home", "p_draw", "p_away", "home_strength", "away_strength")
    probs = base.withColumnsRenamed({"adj_" + c: c for c in ("p_home", "p_draw", "p_away")})
    squad = T.squad_prior(probs, t.team_scores).drop("p_home", "p_draw", "p_away")
    probs = squad.withColumnsRenamed({"adj_" + c: c for c in ("p_home", "p_draw", "p_away")})
    return Q.project_season(probs, t.played, SIMS)


_WEEKS = """pl AS (SELECT pool, matchweek, count(*) AS n FROM @fixture_list GROUP BY ALL), dn AS (SELECT f.pool, f.matchweek, count(*) AS d FROM @played p JOIN @fixture_list f USING (pool, home, away) GROUP BY ALL),
  w AS (SELECT pl.*, dn.d FROM pl LEFT JOIN dn USING (pool, matchweek)),
  pg AS (SELECT pool, max(matchweek) FILTER (WHERE d >= n) AS latest_full, max(matchweek) FILTER (WHERE d IS NOT NULL) AS latest_started,
    coalesce(min(matchweek) FILTER (WHERE coalesce(d, 0) < n), max(matchweek)) AS first_open FROM w GROUP BY pool)"""


@query(
    "Q5_matchweek_progress",
    "pool:i latest_full:d0 latest_started:d0 first_open:d0 reference:d0",
    f"WITH {_WEEKS} SELECT *, CASE WHEN latest_full > 1 AND latest_full = latest_started THEN latest_full - 1 END AS reference FROM pg",
)
def q5(t: Tables):
    return Q.matchweek_progress(t.played, t.fixture_list)


@query(
    "Q5_through_matchweek",
    "match_id:i pool:i",
    f"WITH {_WEEKS} SELECT p.match_id, p.pool FROM @played p JOIN @fixture_list f USING (pool, home, away) JOIN pg USING (pool) WHERE latest_full > 1 AND latest_full = latest_started AND f.matchweek <= latest_full - 1",
)
def q5_rows(t: Tables):
    return Q.through_matchweek(t.played, t.fixture_list, Q.matchweek_progress(t.played, t.fixture_list))


@query(
    "Q6_position_movement",
    "team:i projected_position:i position_change_since_season_start:d0 position_change_since_previous_round:d0",
    f"""WITH {_TABLE}, c AS (SELECT team, position AS projected_position FROM tb WHERE season = {LATEST} - 1), b AS (SELECT team, position AS bp FROM tb WHERE season = {LATEST} - 2), v AS (SELECT team, position AS vp FROM tb WHERE season = {LATEST} - 3)
    SELECT c.team, c.projected_position, bp - c.projected_position AS position_change_since_season_start, vp - c.projected_position AS position_change_since_previous_round FROM c LEFT JOIN b USING (team) LEFT JOIN v USING (team)""",
)
def q6(t: Tables):
    table = N.season_table(t.league).withColumnRenamed("position", "projected_position")
    of = lambda y: table.where(F.col("season") == y).select("pool", "team", "projected_position")
    return Q.position_movement(of(t.latest - 1), of(t.latest - 2), of(t.latest - 3))


# A forecast per season: the table of the season before, jittered by the team number, in two variants.
_FORECAST = """SELECT pool, season, team, 'current_without_elo' AS model_variant, CAST((team * 13 + season) % 12 + 3 AS DOUBLE) / 2 AS expected_position, CAST((team * 7 + season) % 40 AS DOUBLE) AS expected_points FROM (SELECT DISTINCT pool, season, team FROM @t) AS x
UNION ALL SELECT pool, season, team, 'current_plus_elo', CAST((team * 11 + season) % 20 + 1 AS DOUBLE), CAST((team * 5 + season) % 30 AS DOUBLE) FROM (SELECT DISTINCT pool, season, team FROM @t) AS y"""


def _errors(t: Tables):
    f = t.sql(_FORECAST)
    both = N.season_table(t.league)
    actual = both.withColumn("model_variant", F.explode(F.array(F.lit("current_without_elo"), F.lit("current_plus_elo"))))
    keys = ["pool", "season", "model_variant"]
    return Q.season_errors(f, actual, keys).where("actual_position IS NOT NULL")


_ERR = f"""{_TABLE}, fc AS ({_FORECAST}), er AS (SELECT fc.*, tb.points, tb.position AS actual_position, abs(expected_position - tb.position) AS position_error, abs(expected_points - tb.points) AS points_error
  FROM fc JOIN tb USING (pool, season, team))"""


@query("Q7_season_errors", "pool:i season:i team:i model_variant:s position_error:d4 points_error:d4", f"WITH {_ERR} SELECT * FROM er")
def q7(t: Tables):
    return _errors(t)


_VAL = f"""{_ERR}, rr AS (SELECT *, row_number() OVER (PARTITION BY pool, season, model_variant ORDER BY expected_position, team) AS f, row_number() OVER (PARTITION BY pool, season, model_variant ORDER BY actual_position, team) AS a,
    count(*) OVER (PARTITION BY pool, season, model_variant) AS n, rank() OVER (PARTITION BY pool, season, model_variant ORDER BY expected_position) + (count(*) OVER (PARTITION BY pool, season, model_variant, expected_position) - 1) / 2.0 AS rf FROM er),
  vl AS (SELECT pool, season, model_variant, avg(position_error) AS average_position_error, avg(points_error) AS average_points_error, corr(rf::DOUBLE, actual_position::DOUBLE) AS rank_correlation,
    sum(CASE WHEN f = 1 AND a = 1 THEN 1.0 ELSE 0 END) AS champion_prediction_accuracy, sum(CASE WHEN f <= 4 AND a <= 4 THEN 1.0 ELSE 0 END) / 4 AS top_4_prediction_accuracy,
    sum(CASE WHEN f > n - 3 AND a > n - 3 THEN 1.0 ELSE 0 END) / 3 AS relegation_prediction_accuracy FROM rr GROUP BY ALL)"""
_VAL_COLS = " ".join(c + ":d6" for c in Q.VALIDATION)


@query("Q8_season_validation", "pool:i season:i model_variant:s " + _VAL_COLS, f"WITH {_VAL} SELECT * FROM vl")
def q8(t: Tables):
    return Q.season_validation(_errors(t), ["pool", "season", "model_variant"])


@query("Q8_aggregate_validation", "model_variant:s seasons:i " + _VAL_COLS, f"WITH {_VAL} SELECT model_variant, count(*) AS seasons, {', '.join(f'avg({c}) AS {c}' for c in Q.VALIDATION)} FROM vl GROUP BY model_variant")
def q8_mean(t: Tables):
    return Q.aggregate_validation(Q.season_validation(_errors(t), ["pool", "season", "model_variant"]), ["model_variant"])


@query(
    "Q9_misranked",
    "model_variant:s team:i seasons:i mean_position_error:d6 mean_points_error:d6 mean_expected_position:d6 mean_actual_position:d6",
    f"""WITH {_ERR} SELECT model_variant, team, count(DISTINCT season) AS seasons, avg(position_error) AS mean_position_error, avg(points_error) AS mean_points_error,
      avg(expected_position) AS mean_expected_position, avg(actual_position) AS mean_actual_position FROM er GROUP BY ALL""",
)
def q9(t: Tables):
    return Q.misranked(_errors(t), ["model_variant"])


# Two forecasts of the latest season: expected points from the prices with and without a shift by team.
_TWO_FORECASTS = """SELECT pool, team, sum(x) AS before, sum(x + CAST(team % 7 AS DOUBLE) / 10) AS after FROM (
  SELECT pool, home AS team, 3 * p_home + p_draw AS x FROM @fixture_probs UNION ALL SELECT pool, away, 3 * p_away + p_draw FROM @fixture_probs) AS u
GROUP BY pool, team"""


@query(
    "Q10_projection_delta",
    "pool:i team:i expected_points_delta:d6 relegation_probability_delta:d6",
    f"SELECT pool, team, after - before AS expected_points_delta, 1 / (1 + after) - 1 / (1 + before) AS relegation_probability_delta FROM ({_TWO_FORECASTS}) AS f",
)
def q10(t: Tables):
    both = t.sql(_TWO_FORECASTS)
    one = lambda c: both.select("pool", "team", F.col(c).alias("expected_points"), (1 / (1 + F.col(c))).alias("relegation_probability"))
    return Q.projection_delta(one("after"), one("before"))
