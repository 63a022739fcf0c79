"""Ratings, context, absences, line-ups, coaches and tactics (W12-W35)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from matchframe.functions.clean import COMPETITION_WEIGHTS
from matchframe.functions.probs import with_poisson_1x2
from matchframe.operators import availability as V
from matchframe.operators import context as X
from matchframe.operators import lineups as L
from matchframe.operators import managers as M
from matchframe.operators import ratings as E
from matchframe.operators import rolling as R
from matchframe.operators import tactics as K
from matchframe.operators.longform import to_wide
from matchframe.plans.clean_queries import case_map
from matchframe.plans.registry import both_sides, query, wide_sql
from matchframe.plans.stages import staged
from matchframe.plans.tables import CTES, LATEST, Tables
from matchframe.plans.windows_queries import MIDWEEK, days, recency_sql

# --- ratings ---------------------------------------------------------------

PRODUCTION = E.EloConfig(k=30.0, home_advantage=75.0)
MARGIN = E.EloConfig(k=20.0, home_advantage=50.0, margin=True, carryover=0.75)
ELO_COLUMNS = (
    "home_elo away_elo elo_difference elo_ratio elo_gap_bucket elo_recent_change home_elo_trend away_elo_trend rolling_elo_form"
).split()


def elo_sql(cfg: E.EloConfig, source: str = "@matches") -> str:
    """Recursive twin: one step plays the n-th match of every pool."""
    carry = f"1500.0 + {cfg.carryover} * (x - 1500.0)"
    mult = "CASE WHEN abs(gd) > 1 THEN ln(abs(gd) + 1) * (2.2 / (abs(he + {ha} - ae) * 0.001 + 2.2)) ELSE 1.0 END" if cfg.margin else "1.0"
    mult = mult.format(ha=cfg.home_advantage)
    trend = "CASE WHEN len(g[{i}]) >= 5 THEN q[{i}] - g[{i}][len(g[{i}]) - 4] ELSE 0.0 END"
    return f"""WITH RECURSIVE m AS (
      SELECT *, row_number() OVER (PARTITION BY pool ORDER BY match_date, match_id) AS rn, home - pool * 20 + 1 AS hi, away - pool * 20 + 1 AS ai, hg - ag AS gd,
        season <> lag(season, 1, season) OVER (PARTITION BY pool ORDER BY match_date, match_id) AS fresh FROM {source}),
    s AS (
      SELECT pool, 0::BIGINT AS rn, list_transform(range(20), lambda x: 1500.0::DOUBLE) AS r, list_transform(range(20), lambda x: []::DOUBLE[]) AS h,
        NULL::BIGINT AS match_id, 0.0::DOUBLE AS he, 0.0::DOUBLE AS ae, 0.0::DOUBLE AS ht, 0.0::DOUBLE AS at_ FROM (SELECT DISTINCT pool FROM m)
      UNION ALL
      SELECT pool, rn, list_transform(q, lambda x, i: CASE WHEN i = hi THEN x + ch WHEN i = ai THEN x - ch ELSE x END),
        list_transform(g, lambda x, i: CASE WHEN i = hi THEN list_append(x[-5:], he + ch) WHEN i = ai THEN list_append(x[-5:], ae - ch) ELSE x END),
        match_id, he, ae, ht, at_
      FROM (SELECT *, {cfg.k} * {mult} * (CASE WHEN gd > 0 THEN 1.0 WHEN gd < 0 THEN 0.0 ELSE 0.5 END - 1.0 / (1.0 + pow(10.0, -(he + {cfg.home_advantage} - ae) / 400.0)))::DOUBLE AS ch
        FROM (SELECT *, q[hi] AS he, q[ai] AS ae, {trend.format(i="hi")} AS ht, {trend.format(i="ai")} AS at_
          FROM (SELECT p.pool, p.rn, p.match_id, p.hi, p.ai, p.gd, p.q, CASE WHEN p.fresh AND {cfg.carryover} < 1 THEN
              list_transform(p.h, lambda x, i: CASE WHEN len(x) > 0 THEN list_append(x, p.q[i]) ELSE x END) ELSE p.h END AS g
            FROM (SELECT m.pool, m.rn, m.match_id, m.hi, m.ai, m.gd, m.fresh, s.h, CASE WHEN m.fresh THEN list_transform(s.r, lambda x: {carry}) ELSE s.r END AS q
              FROM s JOIN m ON m.pool = s.pool AND m.rn = s.rn + 1) AS p) AS o) AS n) AS c)
    SELECT match_id, he AS home_elo, ae AS away_elo, he - ae AS elo_difference, he / ae AS elo_ratio,
      CASE WHEN abs(he - ae) < 50 THEN 0 ELSE CASE WHEN abs(he - ae) < 100 THEN 1 WHEN abs(he - ae) < 200 THEN 2 ELSE 3 END * sign(he - ae) END AS elo_gap_bucket,
      ht - at_ AS elo_recent_change, ht AS home_elo_trend, at_ AS away_elo_trend, ht - at_ AS rolling_elo_form FROM s WHERE rn > 0"""


_ELO_SPEC = "match_id:i " + " ".join(c + ":d6" for c in ELO_COLUMNS)


@query("W12_elo_features", _ELO_SPEC, elo_sql(PRODUCTION))
def w12(t: Tables):
    return E.elo_features(t.matches, PRODUCTION)


@query("W12_elo_margin_carryover", _ELO_SPEC, elo_sql(MARGIN))
def w12_margin(t: Tables):
    return E.elo_features(t.matches, MARGIN)


CTES["past"] = f"SELECT * FROM @matches WHERE season < {LATEST}"


def state_sql(source: str) -> str:
    """Twin of the state: each team's last rating and its change over five matches."""
    won = "(CASE result WHEN 'H' THEN 1.0 WHEN 'A' THEN 0.0 ELSE 0.5 END - 1 / (1 + pow(10, -(elo_difference + 75) / 400)))::DOUBLE"
    return f"""WITH e AS ({elo_sql(PRODUCTION, source)}),
    x AS (SELECT m.pool, m.match_date, m.match_id, home AS team, home_elo + 30.0 * {won} AS r FROM e JOIN {source} m USING (match_id)
      UNION ALL SELECT m.pool, m.match_date, m.match_id, away, away_elo - 30.0 * {won} FROM e JOIN {source} m USING (match_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) AS rn FROM x)
    SELECT pool, team, max(r) FILTER (WHERE rn = 1) AS rating,
      CASE WHEN count(*) >= 5 THEN max(r) FILTER (WHERE rn = 1) - max(r) FILTER (WHERE rn = 5) ELSE 0 END AS trend FROM k GROUP BY pool, team"""


@query("W13_elo_state", "pool:i team:i rating:d6 trend:d6", state_sql("@matches"))
def w13(t: Tables):
    s = E.elo_state(t.matches, PRODUCTION)
    trend = F.when(F.size("past") == E.TREND, F.col("rating") - F.col("past")[0]).otherwise(0.0)
    return s.select("pool", "team", "rating", trend.alias("trend"))


@query(
    "W13_elo_prediction_rows",
    _ELO_SPEC,
    f"""WITH st AS ({state_sql("@past")}),
    f AS (SELECT match_id, coalesce(h.rating, 1500) AS he, coalesce(a.rating, 1500) AS ae, coalesce(h.trend, 0) AS ht, coalesce(a.trend, 0) AS at_
      FROM @matches m LEFT JOIN st h ON h.pool = m.pool AND h.team = m.home LEFT JOIN st a ON a.pool = m.pool AND a.team = m.away WHERE season = {LATEST})
    SELECT match_id, he AS home_elo, ae AS away_elo, he - ae AS elo_difference, he / ae AS elo_ratio,
      CASE WHEN abs(he - ae) < 50 THEN 0 ELSE CASE WHEN abs(he - ae) < 100 THEN 1 WHEN abs(he - ae) < 200 THEN 2 ELSE 3 END * sign(he - ae) END AS elo_gap_bucket,
      ht - at_ AS elo_recent_change, ht AS home_elo_trend, at_ AS away_elo_trend, ht - at_ AS rolling_elo_form FROM f""",
)
def w13_rows(t: Tables):
    """The latest season's fixtures rated from the state of the seasons before it."""
    state = E.elo_state(t.past, PRODUCTION)
    return E.elo_prediction_rows(t.matches.where(F.col("season") == t.latest).select("match_id", "pool", "home", "away"), state)


XG_COLUMNS = [
    *E.XG_RATING_COLUMNS, "home_attack_vs_away_defense", "away_attack_vs_home_defense", "attack_defense_matchup_score",
    "expected_home_goals_model", "expected_away_goals_model", "expected_goal_diff_model", "poisson_home_win_prob",
    "poisson_draw_prob", "poisson_away_win_prob",
]


def _xg_sql() -> str:
    """Recursive twin of the opponent-adjusted ratings: one step plays the n-th match of every pool.

    A team's past is its list of (season, attack, defence); the weighted mean is kept beside it.
    """
    c = E.XgConfig()
    mean = lambda xs: f"coalesce(list_avg({xs}), lg)"
    part = lambda i, f: f"list_transform(h[{i}], lambda x: x.{f})"
    blocks = []
    for side, i in (("home", "hi"), ("away", "ai")):
        for name, f in (("attack", "a"), ("defense", "d")):
            now = f"list_transform(list_filter(h[{i}], lambda x: x.s = season), lambda x: x.{f})"
            blocks += [
                f"coalesce(w[{i}].{f}, lg) / lg AS {side}_xg_{name}_rating",
                f"{mean(f'list_slice({part(i, f)}, -5, -1)')} / lg AS {side}_xg_{name}_rating_last5",
                f"{mean(f'list_slice({part(i, f)}, -10, -1)')} / lg AS {side}_xg_{name}_rating_last10",
                f"CASE WHEN h[{i}][-1].s = season THEN list_avg({now}) ELSE lg END / lg AS {side}_xg_{name}_rating_season",
            ]
    names = [x.rsplit(" AS ", 1)[1] for x in blocks]
    keep = ", ".join(names)
    kind = "STRUCT(s BIGINT, a DOUBLE, d DOUBLE)"
    ewm = lambda f, v: f"CASE WHEN x IS NULL THEN {v} ELSE {c.alpha} * {v} + {1 - c.alpha} * x.{f} END"
    new_w = lambda p: f"{{'s': 0::BIGINT, 'a': ({ewm('a', p + 'a_')})::DOUBLE, 'd': ({ewm('d', p + 'd_')})::DOUBLE}}"
    new_h = lambda p: f"list_append(x, {{'s': season, 'a': {p}a_, 'd': {p}d_}})"
    clip = lambda x: f"least(greatest({x}, {c.low}), {c.high})"
    top = c.max_goals
    cell = lambda lam, k: f"exp(-{lam}) * pow({lam}, {k}) / {float(math.factorial(k))}"
    grid = {k: " + ".join(f"({cell('eh', i)}) * ({cell('ea', j)})" for i in range(top + 1) for j in range(top + 1) if k(i, j)) for k in (lambda i, j: i > j, lambda i, j: i == j, lambda i, j: i < j)}
    win, draw, loss = grid.values()
    return f"""WITH RECURSIVE m AS (
      SELECT *, row_number() OVER (PARTITION BY pool ORDER BY match_date, match_id) AS rn, home - pool * 20 + 1 AS hi, away - pool * 20 + 1 AS ai FROM @matches),
    s AS (
      SELECT pool, 0::BIGINT AS rn, list_transform(range(20), lambda x: NULL::{kind}) AS w, list_transform(range(20), lambda x: []::{kind}[]) AS h,
        0.0::DOUBLE AS sh, 0.0::DOUBLE AS sa, NULL::BIGINT AS match_id, {", ".join(f"0.0::DOUBLE AS {n}" for n in names)}, 0.0::DOUBLE AS lh, 0.0::DOUBLE AS la
      FROM (SELECT DISTINCT pool FROM m)
      UNION ALL
      SELECT pool, rn, list_transform(w, lambda x, i: CASE WHEN i = hi THEN {new_w("h")} WHEN i = ai THEN {new_w("a")} ELSE x END),
        list_transform(h, lambda x, i: CASE WHEN i = hi THEN {new_h("h")} WHEN i = ai THEN {new_h("a")} ELSE x END), sh + hxg, sa + axg, match_id, {keep}, lh, la
      FROM (SELECT *, hxg / greatest(away_xg_defense_rating, {c.floor}) AS ha_, axg / greatest(away_xg_attack_rating, {c.floor}) AS hd_,
          axg / greatest(home_xg_defense_rating, {c.floor}) AS aa_, hxg / greatest(home_xg_attack_rating, {c.floor}) AS ad_
        FROM (SELECT *, {", ".join(blocks)}
          FROM (SELECT m.pool, m.rn, m.match_id, m.season, m.hi, m.ai, m.hxg, m.axg, s.w, s.h, s.sh, s.sa,
              CASE WHEN s.rn > 0 THEN (s.sh + s.sa) / (2 * s.rn) ELSE {c.league[0]} END AS lg, CASE WHEN s.rn > 0 THEN s.sh / s.rn ELSE {c.league[1]} END AS lh,
              CASE WHEN s.rn > 0 THEN s.sa / s.rn ELSE {c.league[2]} END AS la
            FROM s JOIN m ON m.pool = s.pool AND m.rn = s.rn + 1) AS p) AS o) AS n),
    g AS (SELECT *, home_xg_attack_rating * away_xg_defense_rating AS hv, away_xg_attack_rating * home_xg_defense_rating AS av FROM s WHERE rn > 0),
    r AS (SELECT *, {clip(f"lh * hv * {c.home_factor}")} AS eh, {clip(f"la * av * {c.away_factor}")} AS ea FROM g),
    q AS (SELECT *, {win} AS pw, {draw} AS pd, {loss} AS pl FROM r)
    SELECT pool, match_id, {keep}, hv AS home_attack_vs_away_defense, av AS away_attack_vs_home_defense, hv - av AS attack_defense_matchup_score,
      eh AS expected_home_goals_model, ea AS expected_away_goals_model, eh - ea AS expected_goal_diff_model, pw / (pw + pd + pl) AS poisson_home_win_prob,
      pd / (pw + pd + pl) AS poisson_draw_prob, pl / (pw + pd + pl) AS poisson_away_win_prob FROM q"""


@query("W14_opponent_adjusted_xg", "match_id:i " + " ".join(c + ":d6" for c in XG_COLUMNS), _xg_sql())
def w14(t: Tables):
    return E.opponent_adjusted_xg(t.matches)


_RATED = [f"{m}_weighted_{w}" for w in R.RECENCY_SCHEMES for m in ("attack_rating", "defense_rating")]
_RATED_SOURCE = f"""SELECT t.match_id, t.is_home, t.team, t.match_date, CASE WHEN is_home = 1 THEN home_xg_attack_rating ELSE away_xg_attack_rating END AS attack_rating,
  CASE WHEN is_home = 1 THEN home_xg_defense_rating ELSE away_xg_defense_rating END AS defense_rating FROM @t t JOIN ({_xg_sql()}) AS x USING (match_id)"""


@query(
    "W7_recency_weighted_ratings",
    "match_id:i " + both_sides(" ".join(c + ":d6" for c in _RATED)),
    recency_sql(f"({_RATED_SOURCE}) AS rated", {"attack_rating": "attack_rating", "defense_rating": "defense_rating"}, _RATED),
)
def w7_ratings(t: Tables):
    """The recency schemes over the opponent-adjusted ratings."""
    return R.recency_weighted(t.long, E.rating_rows(E.opponent_adjusted_xg(t.matches), t.matches))


@query(
    "W15_poisson_1x2",
    "match_id:i p_home:d8 p_draw:d8 p_away:d8",
    """WITH l AS (SELECT match_id, greatest(hxg, 0.05) AS h, greatest(axg, 0.05) AS a FROM @matches),
    g AS (SELECT match_id, i, j, exp(-h) * pow(h, i) / factorial(i::INT) * exp(-a) * pow(a, j) / factorial(j::INT) AS p
      FROM l, generate_series(0, 10) AS x(i), generate_series(0, 10) AS y(j))
    SELECT match_id, sum(p) FILTER (WHERE i > j) / sum(p) AS p_home, sum(p) FILTER (WHERE i = j) / sum(p) AS p_draw, sum(p) FILTER (WHERE i < j) / sum(p) AS p_away
    FROM g GROUP BY match_id""",
)
def w15(t: Tables):
    return with_poisson_1x2(t.matches.select("match_id", "hxg", "axg"), "hxg", "axg")


# --- context ---------------------------------------------------------------

CTES["weighted_nonleague"] = f"SELECT *, CAST({case_map('competition', COMPETITION_WEIGHTS, '0.5')} AS DOUBLE) AS weight FROM @nonleague"
_POS5 = "(PARTITION BY team ORDER BY k RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING)"


@query(
    "W16_non_league_context",
    "match_id:i " + both_sides(" ".join(c + ":d6" for c in X.NON_LEAGUE)),
    f"""WITH u AS (SELECT team, match_date, match_id, is_home, 0 AS q, 0 AS row_id, NULL AS competition, NULL AS p, NULL AS g, NULL AS s FROM @t
      UNION ALL SELECT team, match_date, NULL, NULL, 1, row_id, competition, points * weight, goals_for * weight, shots_for * weight FROM @weighted_nonleague),
    k AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY team ORDER BY match_date, q, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS k,
      count(*) FILTER (WHERE q = 1) {days(14)} AS any_matches_last_14_days, count(*) FILTER (WHERE competition = 'Friendly') {days(60)} AS preseason_matches_last_60_days,
      count(*) FILTER (WHERE competition <> 'Friendly') {days(30)} AS competitive_non_pl_matches_last_30_days,
      CASE WHEN count(*) FILTER (WHERE competition = 'Champions League') {days(7)} > 0 THEN 1 ELSE 0 END AS europe_qualifier_last_7_days,
      max(match_date) FILTER (WHERE q = 1) {days(100000)} AS last_day FROM u),
    f AS (SELECT *, coalesce(sum(p) OVER {_POS5}, 0) AS non_pl_points_equiv_last5, coalesce(avg(g) OVER {_POS5}, 0) AS non_pl_goals_equiv_avg_last5,
      coalesce(avg(s) OVER {_POS5}, 0) AS non_pl_shots_equiv_avg_last5, coalesce(match_date - last_day, 14) AS days_since_any_match,
      CASE WHEN last_day IS NULL THEN 0 ELSE 1 END AS non_pl_context_available FROM k),
    r AS (SELECT * FROM f WHERE q = 0) {wide_sql("r", " ".join(X.NON_LEAGUE))}""",
)
def w16(t: Tables):
    return X.non_league_context(t.long, t.weighted_nonleague)


_TOTALS = """SELECT t.match_id, t.is_home, t.team, t.match_date, a.*EXCLUDE (team) FROM @t t JOIN @absences a ON a.team = t.team AND a.report_date <= t.match_date
  AND a.unavailable_from <= t.match_date AND (a.expected_return_date IS NULL OR a.expected_return_date >= t.match_date)"""
_SUS, _INJ = "status_type = 'suspension'", "status_type <> 'suspension'"


def _absence_sql() -> str:
    cols = [
        f"count(DISTINCT player) FILTER (WHERE {_INJ}) AS injured_players_count",
        f"count(DISTINCT player) FILTER (WHERE {_INJ} AND is_expected_starter >= 1) AS injured_starters_count",
        f"count(DISTINCT player) FILTER (WHERE {_INJ} AND is_expected_starter >= 1) AS injured_expected_starters",
        f"count(DISTINCT player) FILTER (WHERE {_SUS}) AS suspended_players_count",
        f"count(DISTINCT player) FILTER (WHERE {_SUS} AND is_expected_starter >= 1) AS suspended_expected_starters",
        "count(DISTINCT player) FILTER (WHERE is_expected_starter >= 1) AS number_of_injured_starters",
    ]
    for p, cond in (("injured_", _INJ), ("suspended_", _SUS), ("", "true")):
        cols += [f"coalesce(sum({c}) FILTER (WHERE {cond}), 0) AS {p}missing_{c}" for c in V.ABSENT_SUMS]
    return f"""WITH j AS ({_TOTALS}), g AS (SELECT match_id, is_home, {", ".join(cols)} FROM j GROUP BY match_id, is_home),
    w AS ({wide_sql("g", " ".join(V.ABSENCE_FEATURES))})
    SELECT m.match_id, {", ".join(f"coalesce({s}_{c}, 0) AS {s}_{c}" for c in V.ABSENCE_FEATURES for s in ("home", "away"))} FROM @matches m LEFT JOIN w USING (match_id)"""


@query("W17_absence_features", "match_id:i " + both_sides(" ".join(c + ":d4" for c in V.ABSENCE_FEATURES)), _absence_sql())
def w17(t: Tables):
    return V.absence_features(t.long, t.absences)


def _avail(side: str) -> str:
    v = lambda c: f"{side}_{c}"
    base = f"6.0 * {v('injured_starters_count')} + {v('missing_minutes')} / 450.0 + 3.0 * ({v('missing_xg')} + {v('missing_xa')})"
    sev = f"{base} + 1.5 * greatest(0, {v('injured_players_count')} - {v('injured_starters_count')}) + {v('missing_market_value')} / 15000000.0"
    return (
        f"least(greatest(100 - ({sev}), 0), 100) AS {side}_availability_score, least(greatest(100 - ({base}), 0), 100) AS {side}_lineup_strength_score, "
        f"{sev} AS {side}_injury_severity_score"
    )


@query(
    "W18_availability_scores",
    "match_id:i " + both_sides("availability_score:d4 lineup_strength_score:d4 injury_severity_score:d4"),
    f"WITH f AS ({_absence_sql()}) SELECT match_id, {_avail('home')}, {_avail('away')} FROM f",
)
def w18(t: Tables):
    return V.availability_scores(V.absence_features(t.long, t.absences))


# --- line-ups --------------------------------------------------------------

# Every fourth match has an expected line-up published the day before; others are known a day later.
CTES["lineup_rows"] = """SELECT *, CASE WHEN match_id % 4 = 0 THEN 'expected' ELSE 'actual' END AS lineup_type,
  CASE WHEN match_id % 4 = 0 THEN match_date - CAST(1 AS INT) ELSE match_date END AS source_collected_at FROM @appearances"""
# One line-up per team and day: of several matches on a day, the first one's.
CTES["lineup_days"] = """SELECT l.* FROM @lineup_rows AS l JOIN (SELECT team, match_date, min(match_id) AS match_id FROM @lineup_rows GROUP BY team, match_date) AS f
  ON f.team = l.team AND f.match_date = l.match_date AND f.match_id = l.match_id"""
_LINEUP_SQL = """WITH s AS (SELECT team, match_date, list(player) FILTER (WHERE started = 1) AS raw, list(player) FILTER (WHERE started = 1 AND position_group = 'defender') AS d,
    list(player) FILTER (WHERE started = 1 AND position_group = 'midfielder') AS m, list(player) FILTER (WHERE started = 1 AND position_group = 'attacker') AS a,
    max(lineup_type) AS lt, max(source_collected_at) AS c FROM @lineup_days GROUP BY team, match_date),
  x AS (SELECT team, match_date, coalesce(raw, []) AS xi, coalesce(d, []) AS d, coalesce(m, []) AS m, coalesce(a, []) AS a, lt FROM s),
  q AS (SELECT match_id, is_home, team, match_date, max(CASE WHEN points = 3 THEN match_date END) OVER (PARTITION BY team ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS win_day FROM @t),
  l AS (SELECT q.*, CASE WHEN e.team IS NOT NULL THEN e.match_date WHEN len(p.xi) > 0 THEN p.match_date END AS lineup_day,
      CASE WHEN e.team IS NOT NULL THEN e.xi ELSE p.xi END AS xi, CASE WHEN e.team IS NOT NULL THEN e.d ELSE p.d END AS d,
      CASE WHEN e.team IS NOT NULL THEN e.m ELSE p.m END AS m, CASE WHEN e.team IS NOT NULL THEN e.a ELSE p.a END AS a
    FROM q LEFT JOIN x e ON e.team = q.team AND e.match_date = q.match_date AND e.lt = 'expected' AND len(e.xi) > 0 ASOF LEFT JOIN x p ON p.team = q.team AND p.match_date < q.match_date),
  c AS (SELECT l.*, v.xi AS pxi, v.d AS pd, v.m AS pm, v.a AS pa FROM l ASOF LEFT JOIN x v ON v.team = l.team AND v.match_date < l.lineup_day),
  """


@query(
    "W19_lineup_continuity",
    "match_id:i " + both_sides(" ".join(c + ":d6" for c in L.CONTINUITY)),
    _LINEUP_SQL
    + f"""f AS (SELECT c.*, coalesce(len(list_intersect(c.xi, pxi)), 0) AS rep, coalesce(len(list_intersect(c.xi, w.xi)), 0) AS sh,
      coalesce(len(list_intersect(c.d, pd)), 0) AS fd, coalesce(len(list_intersect(c.m, pm)), 0) AS fm, coalesce(len(list_intersect(c.a, pa)), 0) AS fa
      FROM c LEFT JOIN x w ON w.team = c.team AND w.match_date = c.win_day),
    g AS (SELECT match_id, is_home, rep AS starting_xi_repeat_count, rep / 11.0 AS starting_xi_repeat_pct, greatest(0, 11 - rep) AS lineup_changes, fd AS same_back_four,
      fm AS same_midfield, fa AS same_attack, sh AS starters_from_last_win, sh / 11.0 AS lineup_similarity_last_win, coalesce(match_date - win_day, 365) AS days_since_last_win
      FROM f WHERE lineup_day IS NOT NULL UNION ALL SELECT match_id, is_home, 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM f WHERE lineup_day IS NULL)
    {wide_sql("g", " ".join(L.CONTINUITY))}""",
)
def w19(t: Tables):
    return L.lineup_continuity(t.long, t.lineup_days)


@query(
    "W20_lineup_familiarity",
    "match_id:i " + both_sides(" ".join(c + ":d6" for c in L.FAMILIARITY)),
    _LINEUP_SQL
    + f"""o AS (SELECT team, match_date, player, max(minutes) AS minutes FROM @lineup_days WHERE started = 1 GROUP BY ALL),
    pr AS (SELECT u.team, u.match_date, u.player AS a, w.player AS b, least(u.minutes, w.minutes) AS mins FROM o u JOIN o w ON u.team = w.team AND u.match_date = w.match_date AND u.player < w.player),
    cu AS (SELECT DISTINCT match_id, is_home, team, match_date, p1, p2 FROM (SELECT match_id, is_home, team, match_date, unnest(xi) AS p1, xi FROM c WHERE lineup_day IS NOT NULL) AS y,
      LATERAL (SELECT unnest(y.xi) AS p2) AS z WHERE p1 < p2),
    k AS (SELECT cu.match_id, cu.is_home, count(*) AS n, sum(mins) AS ms FROM cu JOIN pr ON pr.team = cu.team AND pr.a = cu.p1 AND pr.b = cu.p2 AND pr.match_date < cu.match_date GROUP BY ALL),
    g AS (SELECT c.match_id, c.is_home, coalesce(n, 0) AS shared_starts_score, coalesce(ms, 0) AS shared_minutes_score,
      ln(1 + coalesce(n, 0)) + ln(1 + coalesce(ms, 0)) / 10 AS lineup_familiarity_score FROM c LEFT JOIN k USING (match_id, is_home))
    {wide_sql("g", " ".join(L.FAMILIARITY))}""",
)
def w20(t: Tables):
    return L.lineup_familiarity(t.long, t.lineup_days)


@query(
    "W21_lineup_rotation",
    "match_id:i " + both_sides(" ".join(c + ":d6" for c in L.ROTATION)),
    _LINEUP_SQL
    + f"""ch AS (SELECT team, match_date, CASE WHEN lag(xi) OVER o IS NOT NULL THEN greatest(0, 11 - len(list_intersect(xi, lag(xi) OVER o))) END AS ch FROM x WHERE len(xi) > 0
      WINDOW o AS (PARTITION BY team ORDER BY match_date)),
    rt AS (SELECT team, match_date, avg(ch) OVER (PARTITION BY team ORDER BY match_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rot FROM ch),
    z AS (SELECT c.*, rt.rot FROM c ASOF LEFT JOIN rt ON rt.team = c.team AND rt.match_date < c.match_date),
    g AS (SELECT match_id, is_home, CASE WHEN lineup_day IS NULL THEN 0 ELSE coalesce(rot, 0) END AS lineup_rotation_rate, CASE WHEN lineup_day IS NULL THEN 0
      ELSE greatest(0, 100 - 7 * coalesce(rot, 0) + 20 * coalesce(len(list_intersect(xi, pxi)), 0) / 11.0) END AS squad_consistency_score FROM z)
    {wide_sql("g", " ".join(L.ROTATION))}""",
)
def w21(t: Tables):
    return L.lineup_rotation(t.long, t.lineup_days)


# --- coaches ---------------------------------------------------------------

_RUNS = """o AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY match_date, match_id) AS rn,
    CASE WHEN manager = lag(manager) OVER (PARTITION BY team ORDER BY match_date, match_id) THEN 0 ELSE 1 END AS chg FROM @coached),
  r AS (SELECT *, sum(chg) OVER (PARTITION BY team ORDER BY rn)::BIGINT AS run FROM o),
  sp AS (SELECT team, manager, match_date AS start_date, lead(match_date) OVER (PARTITION BY team ORDER BY rn) - 1 AS end_date FROM r WHERE chg = 1)"""


@query(
    "W22_manager_stability",
    "match_id:i is_home:i manager_stability_score:i",
    f"""WITH {_RUNS}, a AS (SELECT r.match_id, r.is_home, r.team, r.rn, max(sp.start_date) AS st FROM r LEFT JOIN sp ON sp.team = r.team AND sp.start_date <= r.match_date
      AND (sp.end_date IS NULL OR sp.end_date >= r.match_date) GROUP BY ALL)
    SELECT a.match_id, a.is_home, count(r.rn) AS manager_stability_score FROM a LEFT JOIN r ON r.team = a.team AND r.rn < a.rn AND r.match_date >= a.st GROUP BY a.match_id, a.is_home""",
)
def w22(t: Tables):
    return M.manager_stability(t.long, M.manager_spells(t.coached))


@query("W23_manager_spells", "team:i manager:s start_date:s end_date:s", f"WITH {_RUNS} SELECT * FROM sp")
def w23(t: Tables):
    return M.manager_spells(t.coached)


@query(
    "W24_manager_features",
    "match_id:i " + both_sides(" ".join(c + ":d6" for c in M.MANAGER)) + " " + " ".join(c + ":d6" for c in M.GAPS),
    f"""WITH {_RUNS}, e AS (SELECT *, (match_id % 41 - 20) / 4.0 AS el FROM r),
    pv AS (SELECT e.*, p.run AS prun, p.manager AS pm, p.rn AS prn FROM e LEFT JOIN LATERAL (SELECT run, manager, rn FROM e z WHERE z.team = e.team AND z.match_date < e.match_date ORDER BY z.rn DESC LIMIT 1) AS p ON true),
    st AS (SELECT pv.match_id, pv.is_home, any_value(pv.pm IS NOT NULL AND pv.pm <> pv.manager) AS chg, any_value(pv.match_date) AS d, min(b.match_date) AS s0, count(b.rn) AS n,
      avg(b.points) AS ppg, avg(b.xgf - b.xga) AS xd, avg(b.points) FILTER (WHERE b.rn > pv.prn - 5) AS fm, sum(b.el) AS es
      FROM pv LEFT JOIN e b ON b.team = pv.team AND b.run = pv.prun AND b.rn <= pv.prn AND pv.pm = pv.manager GROUP BY pv.match_id, pv.is_home),
    t1 AS (SELECT *, coalesce(d - s0, 0) AS td FROM st),
    g AS (SELECT match_id, is_home, td AS manager_tenure_days, n AS manager_matches_in_charge, CASE WHEN chg OR td <= 30 THEN 1 ELSE 0 END AS manager_change_last_30d,
      CASE WHEN chg OR td <= 60 THEN 1 ELSE 0 END AS manager_change_last_60d, CASE WHEN n < 5 THEN 1 ELSE 0 END AS new_manager_first_5_matches,
      CASE WHEN n < 10 THEN 1 ELSE 0 END AS new_manager_first_10_matches, 0 AS caretaker_manager,
      CASE WHEN td <= 0 THEN 0 WHEN td <= 30 THEN 1 WHEN td <= 90 THEN 2 WHEN td <= 365 THEN 3 ELSE 4 END AS manager_tenure_bucket, 1 AS manager_data_available,
      coalesce(ppg, 0) AS manager_points_per_game_before_match, coalesce(xd, 0) AS manager_xg_diff_before_match, coalesce(fm, 0) AS manager_team_form_since_appointment,
      coalesce(es, 0) AS manager_elo_change_since_appointment FROM t1),
    w AS ({wide_sql("g", " ".join(M.MANAGER))})
    SELECT *, {", ".join(f"home_{c} - away_{c} AS {g}" for g, c in M.GAPS.items())} FROM w""",
)
def w24(t: Tables):
    return M.manager_features(t.coached.withColumn("elo_trend", (F.col("match_id") % 41 - 20) / F.lit(4.0)))


_STUDY = [f"{w}_{m}" for w in ("before_5", "after_5", "after_10") for m in ("matches", "ppg", "goal_diff_per_match", "xg_diff_per_match")]


def _study_sql() -> str:
    conds = {"before_5": "b AND rn <= 5", "after_5": "NOT b AND rn <= 5", "after_10": "NOT b AND rn <= 10"}
    cols = []
    for w, c in conds.items():
        cols.append(f"count(*) FILTER (WHERE {c}) AS {w}_matches")
        for label, v in (("ppg", "points"), ("goal_diff_per_match", "gf - ga"), ("xg_diff_per_match", "xgf - xga")):
            cols.append(f"coalesce(avg({v}) FILTER (WHERE {c}), 0) AS {w}_{label}")
    return f"""WITH {_RUNS}, ev AS (SELECT team, max_by(manager, start_date) AS manager, max(start_date) AS start_date FROM sp GROUP BY team),
    j AS (SELECT t.*, ev.manager, ev.start_date, t.match_date < ev.start_date AS b FROM @t t JOIN ev USING (team)),
    k AS (SELECT *, CASE WHEN b THEN row_number() OVER (PARTITION BY team, b ORDER BY match_date DESC, match_id DESC) ELSE row_number() OVER (PARTITION BY team, b ORDER BY match_date, match_id) END AS rn FROM j)
    SELECT team, manager, start_date, {", ".join(cols)} FROM k GROUP BY team, manager, start_date"""


@query("W25_event_study", "team:i manager:s start_date:s " + " ".join(c + ":d6" for c in _STUDY), _study_sql())
def w25(t: Tables):
    return M.event_study(t.long, M.latest_changes(M.manager_spells(t.coached)))


# --- tactics ---------------------------------------------------------------

METRICS = list(K.TACTICAL_MEASURES)
_PROFILE_COLS = [f"{m}_{w}" for m in METRICS for w in ("last5", "last10", "season")]
# A day's own matches are not visible: look back from the first row of the day.
_PROFILE_SQL = f"""o AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY match_date, match_id) AS rn FROM @tactics),
  q AS (SELECT *, min(rn) OVER (PARTITION BY team, match_date) - 1 AS k FROM o),
  p AS (SELECT q.match_id, q.is_home, any_value(q.team) AS team, any_value(q.season) AS season, {", ".join(
      f"avg(b.{m}) FILTER (WHERE b.rn > q.k - 5) AS {m}_last5, avg(b.{m}) FILTER (WHERE b.rn > q.k - 10) AS {m}_last10, avg(b.{m}) FILTER (WHERE b.season = q.season) AS {m}_season"
      for m in METRICS)} FROM q LEFT JOIN o b ON b.team = q.team AND b.rn <= q.k GROUP BY q.match_id, q.is_home)"""


@query("W26_tactical_profiles", "match_id:i is_home:i " + " ".join(c + ":d6" for c in _PROFILE_COLS), f"WITH {_PROFILE_SQL} SELECT * FROM p")
def w26(t: Tables):
    return K.tactical_profiles(t.long, t.measures, METRICS)


_PAIRS = K.MATCHUPS
_LAST10 = " ".join(f"{m}_last10" for m in METRICS)


@query(
    "W27_tactical_matchups",
    "match_id:i style_distance_score:d6 " + " ".join(c + ":d6" for c in _PAIRS),
    f"""WITH {_PROFILE_SQL}, w AS ({wide_sql("p", _LAST10)}) SELECT match_id, sqrt({" + ".join(f"pow(coalesce(home_{m}_last10, 0) - coalesce(away_{m}_last10, 0), 2)" for m in METRICS)}) AS style_distance_score,
    {", ".join(f"coalesce({a}_{x}_last10, 0) - coalesce({b}_{y}_last10, 0) AS {n}" for n, (a, x, b, y) in _PAIRS.items())} FROM w""",
)
def w27(t: Tables):
    """A side's measures meet the other side's as one array."""
    names = _LAST10.split()
    p = K.tactical_profiles(t.long, t.measures, METRICS, ["last10"])
    wide = to_wide(p.select("match_id", "is_home", F.array(*names).alias("style")), ["style"])
    cells = [F.get(f"{side}_style", F.lit(k)).alias(f"{side}_{c}") for side in ("home", "away") for k, c in enumerate(names)]
    return K.tactical_matchups(wide.select("match_id", *cells), METRICS, _PAIRS)


_STYLE = K.STYLE_MEASURES


def _style_sql(prefix: str = "") -> str:
    v = [f"coalesce({prefix}{m}_last10, 0)" for m in _STYLE]
    whens = []
    for i, x in enumerate(v):
        rest = v[i + 1 :]
        whens.append(f"WHEN {x} > 0" + (f" AND {x} >= greatest({', '.join(rest)})" if rest else "") + f" THEN {i + 1}")
    return f"CASE {' '.join(whens)} ELSE 0 END"


@query("W28_style_cluster_rule", "match_id:i is_home:i style:i", f"WITH {_PROFILE_SQL} SELECT match_id, is_home, {_style_sql()} AS style FROM p")
def w28(t: Tables):
    p = K.tactical_profiles(t.long, t.measures, _STYLE, ["last10"])
    return p.select("match_id", "is_home", K.style_cluster_rule("", _STYLE).alias("style"))


@query(
    "W29_style_history_points",
    "match_id:i team:i style_history_points:d6",
    """WITH a AS (SELECT x.match_id, x.match_date, x.team, x.points, (y.match_id * 3 + y.team) % 6 AS opp FROM @t x JOIN @t y ON x.match_id = y.match_id AND x.opponent = y.team)
    SELECT match_id, team, coalesce(avg(points) OVER (PARTITION BY team, opp ORDER BY match_date, match_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS style_history_points FROM a""",
)
def w29(t: Tables):
    rows = t.long.withColumn("opponent_cluster", (F.col("match_id") * 3 + F.col("opponent")) % 6)
    return K.style_history_points(rows.select("match_id", "match_date", "team", "opponent_cluster", "points"))


def _profiles(t: Tables):
    """Mean measures per season and team; rows meet before their measures are computed, so few columns are shuffled."""
    rows = t.sql(CTES["tactics"], t=t.long.repartition("season", "team"))
    return rows.groupBy("season", "team").agg(*[F.avg(m).alias(m) for m in METRICS])


@query("W30_style_embeddings", "season:i team:i team_style_cluster:i team_style_archetype:s")
def w30(t: Tables):
    return K.style_embeddings(_profiles(t), METRICS)


@query(
    "W30_style_facts",
    "profiles:i clusters:i misplaced:i misnamed:i",
    "SELECT count(DISTINCT (season, team)) AS profiles, 6 AS clusters, 0 AS misplaced, 0 AS misnamed FROM @tactics",
)
def w30_facts(t: Tables):
    """What holds of settled clusters: six of them are in use, and no profile is nearer to another one's mean."""
    rows = staged(K.style_embeddings(_profiles(t), METRICS, vector="z").select("team_style_cluster", "team_style_archetype", "z"))
    places = range(len(METRICS))
    means = rows.groupBy("team_style_cluster").agg(F.array(*[F.avg(F.col("z")[i]) for i in places]).alias("mean"))
    # Six rows, whatever the size of the data.
    centres = means.agg(F.collect_list(F.struct("team_style_cluster", "mean")).alias("centres"), F.count("*").alias("clusters"))
    away = lambda c: F.aggregate(F.zip_with("z", c["mean"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    gap = F.transform("centres", lambda c: F.struct(away(c).alias("d"), c["team_style_cluster"].alias("k")))
    own = F.filter(gap, lambda g: g["k"] == F.col("team_style_cluster"))[0]["d"]
    wrong = F.array_min(gap)["d"] < own - 1e-9
    named = F.array(*[F.lit(a) for a in K.ARCHETYPES])[F.col("team_style_cluster")] == F.col("team_style_archetype")
    return rows.crossJoin(F.broadcast(centres)).agg(
        F.count("*").alias("profiles"), F.max("clusters").alias("clusters"),
        F.sum(wrong.cast("long")).alias("misplaced"), F.sum((~named).cast("long")).alias("misnamed"),
    )


# --- calendar --------------------------------------------------------------


def ahead(n: int) -> str:
    return f"OVER (PARTITION BY team ORDER BY match_date RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL {n} DAY FOLLOWING)"


_CONTEXT_SQL = f"""SELECT *, coalesce(match_date - max(match_date) FILTER (WHERE n = 1) {days(100000)}, 14) AS days_rest, count(*) FILTER (WHERE n = 1) {days(7)} AS matches_last_7_days,
  count(*) FILTER (WHERE n = 1) {days(14)} AS matches_last_14_days, count(*) FILTER (WHERE n = 1) {ahead(7)} AS matches_next_7_days, count(*) FILTER (WHERE n = 1) {ahead(14)} AS matches_next_14_days,
  CASE WHEN count(*) FILTER (WHERE n = 1 AND {MIDWEEK}) {days(7)} > 0 THEN 1 ELSE 0 END AS midweek_fixture_flag,
  CASE WHEN (month(match_date) = 12 AND day(match_date) >= 20) OR (month(match_date) = 1 AND day(match_date) <= 4) THEN 1 ELSE 0 END AS festive_congestion_flag"""


@query(
    "W31_fixture_schedule_context",
    "match_id:i " + both_sides(" ".join(c + ":d1" for c in X.CONTEXT)),
    f"""WITH u AS (SELECT match_id, is_home, team, match_date, 1 AS n FROM @t UNION ALL SELECT NULL, NULL, team, match_date, 1 FROM @extra),
    c AS ({_CONTEXT_SQL} FROM u), g AS (SELECT *, CASE WHEN days_rest < 5 THEN 1 ELSE 0 END AS short_rest_flag FROM c WHERE match_id IS NOT NULL)
    {wide_sql("g", " ".join(X.CONTEXT))}""",
)
def w31(t: Tables):
    dates = t.long.select("team", "match_date").unionByName(t.extra.select("team", "match_date"))
    return to_wide(X.schedule_context(t.long.select("match_id", "is_home", "team", "match_date"), dates), X.CONTEXT)


@query(
    "W32_add_supplemental_fixtures",
    "match_date:s home:s away:s source:i",
    """WITH u AS (SELECT match_date, CAST(home AS VARCHAR) AS home, CAST(away AS VARCHAR) AS away, 0 AS source FROM @matches
      UNION ALL SELECT match_date, CAST(team AS VARCHAR), CAST((team + 1) % 50 AS VARCHAR), 1 FROM @extra
      UNION ALL SELECT m.match_date, CAST(home AS VARCHAR), CAST(away AS VARCHAR), 2 FROM @result_text r JOIN @matches m ON m.match_id = r.rid WHERE r.rid % 31 <> 0)
    SELECT match_date, home, away, min(source) AS source FROM u GROUP BY ALL""",
)
def w32(t: Tables):
    league = t.matches.select(F.col("match_date").alias("date"), "home", "away")
    cup = t.extra.select(F.date_format("match_date", "dd/MM/yyyy").alias("date"), F.col("team"), ((F.col("team") + 1) % 50).alias("opponent"))
    again = t.result_text.select(
        F.col("Date").alias("date"), F.regexp_replace("HomeTeam", "Team ", "").alias("HomeTeam"), F.regexp_replace("AwayTeam", "Team ", "").alias("AwayTeam")
    )
    return X.add_supplemental_fixtures(league, cup, again)


_SNAP_COLS = "points_last_5 goals_scored_avg xg_avg xga_avg xg_diff shots_avg_last5 shots_avg_last10 shots_avg_season shots_on_target_avg_last5 shots_on_target_avg_last10 shots_on_target_avg_season".split()
_SNAP_SQL = """o AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) AS rn FROM hist),
  v AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY match_date DESC, match_id DESC) AS rn FROM hist WHERE sf IS NOT NULL AND sotf IS NOT NULL),
  f AS (SELECT team, sum(points) FILTER (WHERE rn <= 5) AS points_last_5, avg(gf) FILTER (WHERE rn <= 5) AS goals_scored_avg, avg(xgf) FILTER (WHERE rn <= 5) AS xg_avg,
    avg(xga) FILTER (WHERE rn <= 5) AS xga_avg, count(*) AS match_count, max(match_date) AS latest_match FROM o GROUP BY team),
  s5 AS (SELECT team, avg(sf) FILTER (WHERE rn <= 5) AS a, avg(sf) FILTER (WHERE rn <= 10) AS b, avg(sotf) FILTER (WHERE rn <= 5) AS c, avg(sotf) FILTER (WHERE rn <= 10) AS d,
    max(season) FILTER (WHERE rn = 1) AS ls FROM v GROUP BY team),
  ss AS (SELECT team, season, count(*) AS n, avg(sf) AS a, avg(sotf) AS c FROM v GROUP BY ALL),
  snap AS (SELECT f.*, xg_avg - xga_avg AS xg_diff, coalesce(s5.a, 0) AS shots_avg_last5, coalesce(s5.b, 0) AS shots_avg_last10,
    coalesce(CASE WHEN ss.n >= 5 THEN ss.a ELSE s5.b END, 0) AS shots_avg_season, coalesce(s5.c, 0) AS shots_on_target_avg_last5, coalesce(s5.d, 0) AS shots_on_target_avg_last10,
    coalesce(CASE WHEN ss.n >= 5 THEN ss.c ELSE s5.d END, 0) AS shots_on_target_avg_season FROM f LEFT JOIN s5 USING (team) LEFT JOIN ss ON ss.team = f.team AND ss.season = s5.ls)"""


@query(
    "W33_team_snapshot",
    "team:i match_count:i latest_match:s " + " ".join(c + ":d6" for c in _SNAP_COLS),
    f"WITH hist AS (SELECT * FROM @t), {_SNAP_SQL} SELECT * FROM snap",
)
def w33(t: Tables):
    return X.team_snapshot(t.long)


_PRED_COLS = [*_SNAP_COLS, "days_rest", "matches_last_14_days", "had_midweek_match"]


@query(
    "W33_prediction_features",
    "match_id:i home_advantage:i " + both_sides(" ".join(c + ":d6" for c in _PRED_COLS)),
    f"""WITH hist AS (SELECT * FROM @t WHERE season < {LATEST}), {_SNAP_SQL},
    fx AS (SELECT match_id, is_home, team, least(match_date, (SELECT max(match_date) FROM hist) + 7) AS match_date FROM @t WHERE season = {LATEST}),
    u AS (SELECT match_id, is_home, team, match_date, 0 AS n FROM fx UNION ALL SELECT NULL, NULL, team, match_date, 1 FROM hist),
    c AS ({_CONTEXT_SQL} FROM u),
    g AS (SELECT c.match_id, c.is_home, c.days_rest, c.matches_last_14_days, c.midweek_fixture_flag AS had_midweek_match, {", ".join(f"coalesce(snap.{x}, 0) AS {x}" for x in _SNAP_COLS)}
      FROM c LEFT JOIN snap USING (team) WHERE c.match_id IS NOT NULL), w AS ({wide_sql("g", " ".join(_PRED_COLS))}) SELECT *, 1 AS home_advantage FROM w""",
)
def w33_rows(t: Tables):
    return X.prediction_features(t.matches.where(F.col("season") == t.latest), t.long.where(F.col("season") < t.latest))


@query(
    "W34_rolling_time_mean",
    "pool:i match_date:s rolling_mean:d8 rows:i",
    """WITH d AS (SELECT pool, match_date, sum(hxg) AS s, count(*) AS n FROM @matches GROUP BY ALL)
    SELECT pool, match_date, sum(s) OVER w / sum(n) OVER w AS rolling_mean, n AS rows FROM d
    WINDOW w AS (PARTITION BY pool ORDER BY match_date RANGE BETWEEN INTERVAL 59 DAY PRECEDING AND CURRENT ROW)""",
)
def w34(t: Tables):
    return X.rolling_time_mean(t.matches, "hxg", ["pool"])


@query(
    "W35_freshness",
    "team:i latest:s dataset_latest:s days_behind:i stale:i",
    """SELECT team, max(match_date) AS latest, (SELECT max(match_date) FROM @t) AS dataset_latest, (SELECT max(match_date) FROM @t) - max(match_date) AS days_behind,
      CASE WHEN (SELECT max(match_date) FROM @t) - max(match_date) > 370 THEN 1 ELSE 0 END AS stale FROM @t GROUP BY team""",
)
def w35(t: Tables):
    return X.freshness(t.long)
