"""Rolling and calendar features (W1-W11)."""

from __future__ import annotations

from matchframe.operators import rolling as R
from matchframe.plans.registry import both_sides, query, wide_sql
from matchframe.plans.tables import Tables

_W = "OVER (PARTITION BY team ORDER BY match_date, match_id ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"
W5, W10 = _W.format(5), _W.format(10)
SEASON = (
    "OVER (PARTITION BY team, season ORDER BY match_date, match_id "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
)


def days(n: int) -> str:
    return (
        f"OVER (PARTITION BY team ORDER BY match_date "
        f"RANGE BETWEEN INTERVAL {n} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"
    )


MIDWEEK = "isodow(match_date) IN (2, 3, 4)"
LABELS = "SELECT match_id, 1 AS home_advantage, CASE result WHEN 'H' THEN 0 WHEN 'D' THEN 1 ELSE 2 END AS target FROM @matches"


@query(
    "W1_form_features",
    "match_id:i home_advantage:i target:i " + both_sides("points_last_5:i goals_scored_avg:d6"),
    f"""WITH f AS (SELECT match_id, is_home, coalesce(sum(points) {W5}, 0) AS points_last_5,
      coalesce(avg(gf) {W5}, 0) AS goals_scored_avg FROM @t),
    w AS ({wide_sql("f", "points_last_5 goals_scored_avg")}), l AS ({LABELS})
    SELECT * FROM w JOIN l USING (match_id)""",
)
def form(t: Tables):
    return R.form_features(t.long)


@query(
    "W2_xg_features",
    "match_id:i " + both_sides("xg_avg:d6 xga_avg:d6 xg_diff:d6"),
    f"""WITH f AS (SELECT match_id, is_home, coalesce(avg(xgf) {W5}, 0) AS xg_avg, coalesce(avg(xga) {W5}, 0) AS xga_avg,
      coalesce(avg(xgf) {W5}, 0) - coalesce(avg(xga) {W5}, 0) AS xg_diff FROM @t)
    {wide_sql("f", "xg_avg xga_avg xg_diff")}""",
)
def xg(t: Tables):
    return R.xg_features(t.long)


_SCHED = f"""SELECT match_id, is_home,
  coalesce(match_date - lag(match_date) OVER (PARTITION BY team ORDER BY match_date, match_id), 14) AS days_rest,
  coalesce(match_date - lag(match_date) OVER (PARTITION BY team ORDER BY match_date, match_id), 14) AS days_since_last_match,
  count(*) {days(14)} AS matches_last_14_days,
  CASE WHEN count(*) FILTER (WHERE {MIDWEEK}) {days(7)} > 0 THEN 1 ELSE 0 END AS had_midweek_match FROM @t"""


@query(
    "W3_schedule_features",
    "match_id:i " + both_sides("days_rest:d1 matches_last_14_days:i had_midweek_match:i days_since_last_match:d1"),
    f"WITH f AS ({_SCHED}) {wide_sql('f', 'days_rest matches_last_14_days had_midweek_match days_since_last_match')}",
)
def schedule(t: Tables):
    return R.schedule_features(t.long)


_VALID = "sf IS NOT NULL AND sotf IS NOT NULL"
_SHOT_SQL = f"""WITH k AS (
  SELECT *, coalesce(count(*) FILTER (WHERE {_VALID}) OVER (PARTITION BY team ORDER BY match_date, match_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM @t),
v AS (SELECT team, k + 1 AS j, sf, sotf FROM k WHERE {_VALID}),
r AS (SELECT k.match_id, k.is_home,
  coalesce(avg(v.sf) FILTER (WHERE v.j > k.k - 5), 0) AS s5, coalesce(avg(v.sotf) FILTER (WHERE v.j > k.k - 5), 0) AS t5,
  coalesce(avg(v.sf), 0) AS s10, coalesce(avg(v.sotf), 0) AS t10
  FROM k LEFT JOIN v ON v.team = k.team AND v.j BETWEEN k.k - 9 AND k.k GROUP BY ALL),
s AS (SELECT match_id, is_home, count(*) FILTER (WHERE {_VALID}) {SEASON} AS n,
  avg(sf) FILTER (WHERE {_VALID}) {SEASON} AS ss, avg(sotf) FILTER (WHERE {_VALID}) {SEASON} AS ts FROM @t),
f AS (SELECT match_id, is_home, s5 AS shots_avg_last5, s10 AS shots_avg_last10, t5 AS shots_on_target_avg_last5,
  t10 AS shots_on_target_avg_last10, CASE WHEN n >= 5 THEN ss ELSE s10 END AS shots_avg_season,
  CASE WHEN n >= 5 THEN ts ELSE t10 END AS shots_on_target_avg_season FROM r JOIN s USING (match_id, is_home))
{wide_sql("f", " ".join(R.SHOT_VOLUME))}"""


@query("W4_shot_volume_features", "match_id:i " + both_sides(" ".join(c + ":d6" for c in R.SHOT_VOLUME)), _SHOT_SQL)
def shot_volume(t: Tables):
    return R.shot_volume_features(t.long)


_LOAD = f"""WITH u AS (
  SELECT team, match_date, match_id, is_home, 0 AS x FROM @t
  UNION ALL SELECT team, match_date, NULL, NULL, 1 FROM (SELECT DISTINCT team, match_date FROM @extra)),
f AS (SELECT *,
  coalesce(match_date - max(match_date) {days(100000)}, 14) AS days_rest,
  count(*) {days(14)} AS matches_last_14_days, count(*) {days(30)} AS matches_last_30_days,
  coalesce(match_date - max(match_date) FILTER (WHERE x = 1) {days(100000)}, 60) AS days_since_europe_match,
  count(*) FILTER (WHERE x = 1) {days(30)} AS european_fixture_load,
  CASE WHEN count(*) FILTER (WHERE x = 1 AND {MIDWEEK}) {days(7)} > 0 THEN 1 ELSE 0 END AS played_europe_midweek
  FROM u),
g AS (SELECT *, days_rest AS days_since_last_match, CASE WHEN days_rest <= 4 THEN 1 ELSE 0 END AS had_midweek_match,
  greatest(0, 7 - days_rest) + 1.5 * matches_last_14_days + 0.5 * matches_last_30_days AS fixture_congestion_score
  FROM f WHERE x = 0)
"""


@query(
    "W5_fatigue_features",
    "match_id:i " + both_sides(" ".join(c + ":d3" for c in R.FATIGUE)),
    _LOAD + wide_sql("g", " ".join(R.FATIGUE)),
)
def fatigue(t: Tables):
    return R.fatigue_features(t.long, t.extra)


@query(
    "W6_europe_features",
    "match_id:i " + both_sides(" ".join(c + ":d3" for c in R.EUROPE)),
    _LOAD + wide_sql("g", " ".join(R.EUROPE)),
)
def europe(t: Tables):
    return R.europe_features(t.long, t.extra)


def recency_sql(source: str, measures: dict[str, str], columns: list[str]) -> str:
    o = "OVER (PARTITION BY team ORDER BY match_date, match_id)"
    weights = {
        "linear": lambda a: f"(n - {a})",
        "exponential": lambda a: f"pow(0.75, {a})",
        "halflife3": lambda a: f"pow(0.5, {a} / 3.0)",
        "halflife5": lambda a: f"pow(0.5, {a} / 5.0)",
    }
    lags = ", ".join(
        f"lag({src}, {a + 1}) {o} AS {name}_{a}" for name, src in measures.items() for a in range(5)
    )
    out = []
    for s, wt in weights.items():
        den = " + ".join(f"CASE WHEN n > {a} THEN {wt(a)} ELSE 0 END" for a in range(5))
        for name in measures:
            num = " + ".join(f"CASE WHEN n > {a} THEN {wt(a)} * {name}_{a} ELSE 0 END" for a in range(5))
            out.append(f"coalesce(CASE WHEN n > 0 THEN ({num})::DOUBLE / ({den}) END, 0) AS {name}_weighted_{s}")
    first = ", ".join(out)
    diffs = ", ".join(["*", *[f"xg_weighted_{s} - xga_weighted_{s} AS xg_diff_weighted_{s}" for s in weights if "xg" in measures]])
    return f"""WITH a AS (SELECT match_id, is_home, least(row_number() {o} - 1, 5) AS n, {lags} FROM {source}),
    b AS (SELECT match_id, is_home, {first} FROM a), f AS (SELECT {diffs} FROM b)
    {wide_sql("f", " ".join(columns))}"""


RECENCY_COLUMNS = [f"{m}_weighted_{s}" for s in R.RECENCY_SCHEMES for m in [*R.RECENCY_MEASURES, "xg_diff"]]


@query("W7_recency_weighted", "match_id:i " + both_sides(" ".join(c + ":d6" for c in RECENCY_COLUMNS)), recency_sql("@t", R.RECENCY_MEASURES, RECENCY_COLUMNS))
def recency(t: Tables):
    return R.recency_weighted(t.long)


def _efficiency_sql() -> str:
    cols = []
    for suffix, w in (("last5", W5), ("last10", W10), ("season", SEASON)):
        s = {k: f"coalesce(sum(coalesce({v}, 0)) {w}, 0)" for k, v in
             {"s": "sf", "t": "sotf", "g": "gf", "x": "xgf", "sa": "sa", "ta": "sota", "xa": "xga"}.items()}
        n = f"count(*) {w}"
        pairs = [(s["s"], n), (s["t"], n), (s["t"], s["s"]), (s["g"], s["s"]), (s["g"], s["t"]), (s["x"], s["s"]),
                 (f"({s['g']} - {s['x']})", n), (s["sa"], n), (s["ta"], n), (s["ta"], s["sa"]), (s["xa"], s["sa"])]
        cols += [
            f"CASE WHEN {d} > 0 THEN {a}::DOUBLE / {d} ELSE 0 END AS {name}_{suffix}"
            for name, (a, d) in zip(R.EFFICIENCY, pairs, strict=True)
        ]
    return f"WITH f AS (SELECT match_id, is_home, {', '.join(cols)} FROM @t) {wide_sql('f', ' '.join(EFF_COLUMNS))}"


EFF_COLUMNS = [f"{m}_{w}" for w in ("last5", "last10", "season") for m in R.EFFICIENCY]


@query("W8_shot_efficiency", "match_id:i " + both_sides(" ".join(c + ":d12" for c in EFF_COLUMNS)), _efficiency_sql())
def efficiency(t: Tables):
    return R.shot_efficiency(t.long)


_V5 = W5.replace("PARTITION BY team", "PARTITION BY team, is_home")


def _venue_picks(side: str, flag: int) -> str:
    return ", ".join(
        f"max(CASE WHEN is_home = {flag} THEN {c} END) AS {side}_{label}_{side}_matches"
        for c, label in (("p", "points_last_5"), ("x", "xg_last_5"), ("y", "xga_last_5"), ("g", "goal_diff"))
    )


@query(
    "W9_venue_features",
    "match_id:i "
    + " ".join(f"{s}_{c}_{s}_matches:d6" for s in ("home", "away") for c in ("points_last_5", "xg_last_5", "xga_last_5", "goal_diff")),
    f"""WITH f AS (SELECT match_id, is_home, coalesce(sum(points) {_V5}, 0) AS p, coalesce(avg(xgf) {_V5}, 0) AS x,
      coalesce(avg(xga) {_V5}, 0) AS y, coalesce(avg(gf - ga) {_V5}, 0) AS g FROM @t)
    SELECT match_id, {_venue_picks("home", 1)}, {_venue_picks("away", 0)} FROM f GROUP BY match_id""",
)
def venue(t: Tables):
    return R.venue_features(t.long)


_H2H_SQL = """WITH p AS (
  SELECT a.match_id, b.match_id AS prior_id, b.result = 'D' AS d, b.home = a.home AS same,
    CASE WHEN b.result = 'D' THEN 1 WHEN (b.result = 'H') = (b.home = a.home) THEN 3 ELSE 0 END AS pts,
    CASE WHEN b.home = a.home THEN b.hg - b.ag ELSE b.ag - b.hg END AS gd,
    CASE WHEN b.home = a.home THEN b.hxg - b.axg ELSE b.axg - b.hxg END AS xd,
    row_number() OVER (PARTITION BY a.match_id ORDER BY b.match_date DESC, b.match_id DESC) AS rn
  FROM @matches a JOIN @matches b ON least(a.home, a.away) = least(b.home, b.away)
    AND greatest(a.home, a.away) = greatest(b.home, b.away)
    AND (b.match_date < a.match_date OR (b.match_date = a.match_date AND b.match_id < a.match_id))),
g AS (SELECT match_id, count(*) AS n, count(*) FILTER (WHERE pts = 3) AS w, count(*) FILTER (WHERE d) AS dr,
  count(*) FILTER (WHERE pts = 0) AS l, sum(pts) AS pt,
  sum(CASE pts WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 3 END) AS pa,
  sum(pts) FILTER (WHERE rn <= 3) AS p3, sum(pts) FILTER (WHERE rn <= 5) AS p5,
  sum(gd) FILTER (WHERE rn <= 3) AS g3, sum(gd) FILTER (WHERE rn <= 5) AS g5,
  sum(xd) FILTER (WHERE rn <= 3) AS x3, sum(xd) FILTER (WHERE rn <= 5) AS x5,
  sum(pts) FILTER (WHERE same) AS vp, sum(gd) FILTER (WHERE same) AS vg, sum(xd) FILTER (WHERE same) AS vx
  FROM p GROUP BY match_id)
SELECT m.match_id, coalesce(n, 0) AS h2h_matches_count, coalesce(w, 0) AS h2h_home_wins, coalesce(dr, 0) AS h2h_draws,
  coalesce(l, 0) AS h2h_away_wins, coalesce(pt, 0) AS h2h_points_home_team, coalesce(pa, 0) AS h2h_points_away_team,
  CASE WHEN coalesce(n, 0) <= 0 THEN 0 WHEN n <= 2 THEN 0.25 WHEN n <= 5 THEN 0.6 ELSE 1 END AS h2h_data_strength_score,
  coalesce(p3, 0) AS h2h_last_3_points_home, coalesce(p5, 0) AS h2h_last_5_points_home_team,
  coalesce(g3, 0) AS h2h_last_3_goal_diff, coalesce(g5, 0) AS h2h_last_5_goal_diff,
  coalesce(x3, 0) AS h2h_last_3_xg_diff, coalesce(x5, 0) AS h2h_last_5_xg_diff,
  coalesce(vp, 0) AS h2h_home_venue_points, coalesce(vg, 0) AS h2h_home_venue_goal_diff,
  coalesce(vx, 0) AS h2h_home_venue_xg_diff
FROM @matches m LEFT JOIN g USING (match_id)"""
H2H_COLUMNS = (
    "h2h_matches_count h2h_home_wins h2h_draws h2h_away_wins h2h_points_home_team h2h_points_away_team "
    "h2h_data_strength_score h2h_last_3_points_home h2h_last_5_points_home_team h2h_last_3_goal_diff "
    "h2h_last_5_goal_diff h2h_last_3_xg_diff h2h_last_5_xg_diff h2h_home_venue_points "
    "h2h_home_venue_goal_diff h2h_home_venue_xg_diff"
).split()


@query("W10_head_to_head", "match_id:i " + " ".join(c + ":d6" for c in H2H_COLUMNS), _H2H_SQL)
def head_to_head(t: Tables):
    return R.head_to_head(t.matches)


DRAW_COLUMNS = (
    "home_draw_rate_last10 away_draw_rate_last10 combined_draw_rate_last10 home_draw_rate_season "
    "away_draw_rate_season combined_draw_rate_season team_strength_similarity xg_diff_similarity "
    "form_points_similarity low_total_xg_profile low_total_goals_profile low_total_shots_on_target_profile "
    "draw_propensity_score"
).split()
_DRAW_SQL = f"""WITH f AS (SELECT match_id, is_home, coalesce(avg(is_draw) {W10}, 0) AS r10,
  coalesce(avg(is_draw) {SEASON}, 0) AS rs, coalesce(avg(xgf) {W5}, 0) - coalesce(avg(xga) {W5}, 0) AS xd,
  coalesce(avg(points) {W5}, 0) AS pt, coalesce(avg(xgf) {W5}, 0) AS xg, coalesce(avg(gf) {W5}, 0) AS gl,
  CASE WHEN count(*) FILTER (WHERE sotf IS NULL) {W5} > 0 THEN NULL ELSE coalesce(avg(sotf) {W5}, 0) END AS st FROM @t),
w AS ({wide_sql("f", "r10 rs xd pt xg gl st")}),
s AS (SELECT *, 1 / (1 + abs(home_xd - away_xd)) AS sim, 1 / (1 + (home_xg + away_xg) / 2.5) AS lx,
  1 / (1 + (home_gl + away_gl) / 2.5) AS lg, (home_r10 + away_r10) / 2 AS c10, (home_rs + away_rs) / 2 AS cs FROM w)
SELECT match_id, home_r10 AS home_draw_rate_last10, away_r10 AS away_draw_rate_last10, c10 AS combined_draw_rate_last10,
  home_rs AS home_draw_rate_season, away_rs AS away_draw_rate_season, cs AS combined_draw_rate_season,
  sim AS team_strength_similarity, 1 / (1 + abs(home_xd - away_xd) / 0.75) AS xg_diff_similarity,
  1 / (1 + abs(home_pt - away_pt) / 1.25) AS form_points_similarity, lx AS low_total_xg_profile,
  lg AS low_total_goals_profile, coalesce(1 / (1 + (home_st + away_st) / 8.0), 0) AS low_total_shots_on_target_profile,
  (c10 + cs + sim + lx + lg) / 5 AS draw_propensity_score FROM s"""


@query("W11_draw_propensity", "match_id:i " + " ".join(c + ":d6" for c in DRAW_COLUMNS), _DRAW_SQL)
def draw(t: Tables):
    return R.draw_propensity(t.long)
