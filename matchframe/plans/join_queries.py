"""Joins, reshapes, set operations, ordering (J1-J19) and data quality (D1-D14)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchframe.operators import joins as J
from matchframe.operators import quality as Q
from matchframe.operators import ratings as E
from matchframe.operators import rolling as R
from matchframe.operators.longform import to_long, to_wide
from matchframe.operators.windows import parts_for
from matchframe.plans.registry import query, wide_sql
from matchframe.plans.tables import CTES, LATEST, Tables


@query("J1_join_one_to_one", "match_id:i hs:d1", "SELECT m.match_id, s.hs FROM @matches m LEFT JOIN (SELECT match_id, hs FROM @matches WHERE match_id % 2 = 0) s USING (match_id)")
def j1(t: Tables):
    right = t.matches.where("match_id % 2 = 0").select("match_id", "hs")
    return J.join_one_to_one(t.matches.select("match_id"), right, ["match_id"])


@query(
    "J2_lookup_join",
    "match_id:i region:s",
    """SELECT m.match_id, r.r_name AS region FROM @matches m LEFT JOIN (SELECT n_nationkey, n_regionkey FROM nation) n ON n.n_nationkey = m.home % 30
      LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""",
)
def j2(t: Tables):
    m = t.matches.select("match_id", (F.col("home") % 30).alias("n_nationkey"))
    named = J.lookup_join(m, t.nation.select("n_nationkey", F.col("n_regionkey").alias("r_regionkey")), ["n_nationkey"])
    return J.lookup_join(named, t.region, ["r_regionkey"]).withColumnRenamed("r_name", "region")


_ACTIVE = """SELECT t.match_id, t.is_home, a.row_id, a.player FROM @t t JOIN @absences a ON a.team = t.team AND a.report_date <= t.match_date
  AND a.unavailable_from <= t.match_date AND (a.expected_return_date IS NULL OR a.expected_return_date >= t.match_date)"""


@query("J3_active_interval_join", "match_id:i is_home:i row_id:i player:i", _ACTIVE)
def j3(t: Tables):
    events = t.long.select("match_id", "is_home", "team", "match_date")
    facts = t.absences.select("row_id", "team", "player", "report_date", "unavailable_from", "expected_return_date")
    return J.active_interval_join(events, facts)


CTES["suspensions"] = """SELECT row_id, team, player, unavailable_from AS suspended_from, expected_return_date AS suspended_until,
  CAST(row_id % 4 AS DOUBLE) AS matches_remaining, is_expected_starter AS expected_starter, CAST(row_id % 11 AS DOUBLE) / 8 AS importance_score
  FROM @absences WHERE status_type = 'suspension'"""


@query(
    "J4_active_suspensions",
    "match_id:i is_home:i row_id:i",
    """SELECT t.match_id, t.is_home, a.row_id FROM @t t JOIN @suspensions a ON a.team = t.team AND a.suspended_from <= t.match_date
      AND a.matches_remaining > 0 AND (a.suspended_until IS NULL OR a.suspended_until >= t.match_date)""",
)
def j4(t: Tables):
    from matchframe.operators.availability import active_suspensions

    return active_suspensions(t.long.select("match_id", "is_home", "team", "match_date"), t.suspensions)


CTES["team_days"] = "SELECT team, match_date, max(match_id) AS last_id, count(*) AS n, max(CASE WHEN match_id % 3 = 0 THEN match_date + 20 END) AS collected FROM @t GROUP BY team, match_date"


@query(
    "J5_asof_last",
    "match_id:i is_home:i asof_day:s last_id:d0 known_day:s",
    """WITH a AS (SELECT t.match_id, t.is_home, t.team, t.match_date, f.match_date AS asof_day, f.last_id FROM @t t ASOF LEFT JOIN @team_days f
      ON f.team = t.team AND f.match_date < t.match_date),
    k AS (SELECT t.match_id, t.is_home, max(f.match_date) AS known_day FROM @t t JOIN @team_days f ON f.team = t.team AND f.match_date < t.match_date
      AND (f.collected IS NULL OR f.collected < t.match_date) GROUP BY ALL)
    SELECT a.match_id, a.is_home, a.asof_day, a.last_id, k.known_day FROM a LEFT JOIN k USING (match_id, is_home)""",
)
def j5(t: Tables):
    left = t.long.select("match_id", "is_home", "team", "match_date")
    one = J.asof_last(left, t.team_days, value=["last_id"])
    two = J.asof_last(left, t.team_days, value=["n"], known="collected").select(
        "match_id", "is_home", F.col("asof_day").alias("known_day")
    )
    return one.join(two, ["match_id", "is_home"])


@query(
    "J6_anti_join_played",
    "match_id:i",
    f"SELECT match_id FROM @matches WHERE season = {LATEST} AND (home, away) NOT IN (SELECT (home, away) FROM @matches WHERE season = {LATEST} - 1)",
)
def j6(t: Tables):
    return J.anti_join_played(t.matches.where(F.col("season") == t.latest), t.matches.where(F.col("season") == t.latest - 1)).select("match_id")


@query(
    "J7_semi_join",
    "match_id:i",
    "SELECT match_id FROM @matches WHERE home IN (SELECT team FROM @extra WHERE match_date < DATE '1995-06-01')",
)
def j7(t: Tables):
    early = t.extra.where("match_date < DATE '1995-06-01'").select(F.col("team").alias("home"))
    return J.semi_join(t.matches, early, ["home"]).select("match_id")


@query(
    "J8_lineup_pairs",
    "team:i a:i b:i starts:i minutes:d1",
    """WITH s AS (SELECT * FROM @appearances WHERE started = 1)
    SELECT x.team, x.player AS a, y.player AS b, count(*) AS starts, sum(least(x.minutes, y.minutes)) AS minutes
    FROM s x JOIN s y ON x.match_id = y.match_id AND x.team = y.team AND x.player < y.player GROUP BY ALL""",
)
def j8(t: Tables):
    s = t.appearances.where("started = 1").select("match_id", "team", "player", "minutes")
    pairs = J.lineup_pairs(s, ["match_id", "team"])
    return pairs.groupBy("team", F.col("player_a").alias("a"), F.col("player_b").alias("b")).agg(
        F.count("*").alias("starts"), F.sum(F.least("minutes_a", "minutes_b")).alias("minutes")
    )


@query(
    "J9_dedupe_keep",
    "team:i match_date:s first_id:i last_id:i",
    "SELECT team, match_date, min(match_id) AS first_id, max(match_id) AS last_id FROM @t GROUP BY team, match_date",
)
def j9(t: Tables):
    rows = t.long.select("team", "match_date", "match_id")
    key = ["team", "match_date"]
    first = J.dedupe_keep(rows, key, ["match_id"]).withColumnRenamed("match_id", "first_id")
    last = J.dedupe_keep(rows, key, ["match_id"], keep="last").withColumnRenamed("match_id", "last_id")
    return first.join(last, key)


@query(
    "J10_to_long_to_wide",
    "match_id:i home_team:i away_team:i home_gf:i away_gf:i home_points:i away_points:i",
    wide_sql("@t", "team gf points"),
)
def j10(t: Tables):
    return to_wide(to_long(t.matches), ["team", "gf", "points"])


@query(
    "J11_union_by_name",
    "source:s k:i value:d2",
    """SELECT 'order' AS source, o_orderkey AS k, o_totalprice AS value FROM orders
    UNION ALL SELECT 'event', event_id, value FROM events UNION ALL SELECT 'customer', c_custkey, NULL FROM customer""",
)
def j11(t: Tables):
    return J.union_by_name(
        t.orders.select(F.lit("order").alias("source"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("value")),
        t.events.select(F.col("value"), F.lit("event").alias("source"), F.col("event_id").alias("k")),
        t.customer.select(F.lit("customer").alias("source"), F.col("c_custkey").alias("k")),
    )


@query(
    "J12_team_sets",
    "season:i teams:i kept:i new:i gone:i",
    """WITH s AS (SELECT DISTINCT season, team FROM @t),
    j AS (SELECT coalesce(a.season, b.season + 1) AS season, a.team AS cur, b.team AS prev FROM s a FULL JOIN s b ON a.team = b.team AND a.season = b.season + 1)
    SELECT season, count(cur) AS teams, count(*) FILTER (WHERE cur = prev) AS kept, count(*) FILTER (WHERE prev IS NULL) AS new,
      count(*) FILTER (WHERE cur IS NULL) AS gone FROM j WHERE season IN (SELECT season FROM s) GROUP BY season""",
)
def j12(t: Tables):
    now = J.team_set(t.matches)
    before = now.select((F.col("season") + 1).alias("season"), "team").join(now.select("season").distinct(), "season", "left_semi")
    n = lambda df, name: df.groupBy("season").agg(F.count("*").alias(name))
    out = n(now, "teams")
    for name, df in (("kept", now.intersect(before)), ("new", now.exceptAll(before)), ("gone", before.exceptAll(now))):
        out = out.join(n(df, name), "season", "left")
    return out.na.fill(0)


@query(
    "J13_unpivot_outcomes",
    "match_id:i outcome:s p:d8",
    """SELECT match_id, 'H' AS outcome, p_home AS p FROM @probs UNION ALL SELECT match_id, 'D', p_draw FROM @probs
    UNION ALL SELECT match_id, 'A', p_away FROM @probs""",
)
def j13(t: Tables):
    return J.unpivot_outcomes(t.probs, ["match_id"], {"p_home": "H", "p_draw": "D", "p_away": "A"}, "outcome", "p")


@query(
    "J14_cross_grid",
    "k:d1 adv:d1 n:i total:d4",
    """SELECT k, adv, count(*) AS n, sum(hxg * k + adv) AS total FROM @matches,
      (SELECT unnest([10.0, 20.0, 30.0]::DOUBLE[]) AS k) AS a, (SELECT unnest([0.0, 50.0]::DOUBLE[]) AS adv) AS b GROUP BY k, adv""",
)
def j14(t: Tables):
    grid = J.cross_grid(t.matches.select("hxg"), k=[10.0, 20.0, 30.0], adv=[0.0, 50.0])
    return grid.groupBy("k", "adv").agg(F.count("*").alias("n"), F.sum(F.col("hxg") * F.col("k") + F.col("adv")).alias("total"))


@query(
    "J15_top_n",
    "match_id:i rank:i scope:s",
    """SELECT * FROM (SELECT match_id, row_number() OVER (ORDER BY hs DESC NULLS LAST, hxg DESC, match_id) AS rank, 'all' AS scope FROM @matches ORDER BY 2 LIMIT 25)
    UNION ALL SELECT match_id, rank, 'pool' FROM (SELECT match_id, row_number() OVER (PARTITION BY pool ORDER BY hxg DESC, match_id) AS rank FROM @matches) AS x WHERE rank <= 3""",
)
def j15(t: Tables):
    order = [F.col("hs").desc_nulls_last(), F.col("hxg").desc(), F.col("match_id").asc()]
    best = J.top_n(t.matches, 25, order)
    from pyspark.sql import Window

    # 25 rows: numbering them needs no key.
    best = best.select("match_id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).alias("rank"), F.lit("all").alias("scope"))
    per = J.top_n_per_key(t.matches, ["pool"], 3, [F.col("hxg").desc(), F.col("match_id").asc()])
    return best.unionByName(per.select("match_id", "rank", F.lit("pool").alias("scope")))


@query(
    "J16_rank_min",
    "match_id:i rank:i",
    "SELECT match_id, rank() OVER (PARTITION BY season ORDER BY hs DESC NULLS LAST) AS rank FROM @matches",
)
def j16(t: Tables):
    return J.rank_min(t.matches.select("match_id", "season", "hs"), ["season"], "hs").select("match_id", "rank")


@query(
    "J17_recent_meetings",
    "match_id:i meeting:i team_a:i team_b:i score:s winner:d0",
    """SELECT * FROM (SELECT match_id, row_number() OVER (PARTITION BY least(home, away), greatest(home, away) ORDER BY match_date DESC, match_id DESC) AS meeting,
      least(home, away) AS team_a, greatest(home, away) AS team_b, concat(CAST(hg AS VARCHAR), '-', CAST(ag AS VARCHAR)) AS score,
      CASE WHEN hg > ag THEN home WHEN hg < ag THEN away END AS winner FROM @matches) AS x WHERE meeting <= 5""",
)
def j17(t: Tables):
    return J.recent_meetings(t.matches)


@query(
    "J18_assemble_features",
    "match_id:i home_points_last_5:i home_xg_avg:d6 away_days_rest:d1 h2h_matches_count:i p_home:d8",
    """WITH f AS (SELECT match_id, is_home, coalesce(sum(points) OVER w, 0) AS pts, coalesce(avg(xgf) OVER w, 0) AS xg,
      coalesce(match_date - lag(match_date) OVER (PARTITION BY team ORDER BY match_date, match_id), 14) AS rest FROM @t
      WINDOW w AS (PARTITION BY team ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
    h AS (SELECT match_id, row_number() OVER (PARTITION BY least(home, away), greatest(home, away) ORDER BY match_date, match_id) - 1 AS n FROM @matches)
    SELECT f.match_id, max(CASE WHEN is_home = 1 THEN pts END) AS home_points_last_5, max(CASE WHEN is_home = 1 THEN xg END) AS home_xg_avg,
      max(CASE WHEN is_home = 0 THEN rest END) AS away_days_rest, max(h.n) AS h2h_matches_count, max(p.p_home) AS p_home
    FROM f JOIN h USING (match_id) JOIN @probs p USING (match_id) GROUP BY f.match_id""",
)
def j18(t: Tables):
    return J.assemble_features(
        R.match_features(t.long), R.head_to_head(t.matches), t.probs.select("match_id", "p_home")
    )


@query(
    "J19_available_columns",
    "column:s available:i",
    """SELECT 'hs' AS column, CASE WHEN count(hs) > 0 AND sum(abs(hs)) > 0 THEN 1 ELSE 0 END AS available FROM @matches
    UNION ALL SELECT 'is_draw', CASE WHEN sum(is_draw) > 0 THEN 1 ELSE 0 END FROM @t UNION ALL SELECT 'zero', 0 UNION ALL SELECT 'absent', 0""",
)
def j19(t: Tables):
    rows = t.long.select(F.col("sf").alias("hs"), "is_draw", F.lit(0).alias("zero"))
    return J.available_columns(rows, ["hs", "is_draw", "zero", "absent"], need_mass=True)


# --- data quality ----------------------------------------------------------

_MISS = ("average_possession", "PPDA", "build_up_speed")


@query(
    "D1_missing_report",
    "field:s non_null_rows:i missing_rows:i coverage:d6",
    " UNION ALL ".join(
        f"SELECT '{c}' AS field, count({c}) AS non_null_rows, count(*) - count({c}) AS missing_rows, count({c}) / count(*) AS coverage FROM @tactics" for c in _MISS
    ),
)
def d1(t: Tables):
    return Q.missing_report(t.tactics, [*_MISS, "not_there"])


@query(
    "D2_season_coverage",
    "season:i team_rows:i matches:i matches_with_two_team_rows:i",
    """SELECT season, sum(n) AS team_rows, count(*) AS matches, count(*) FILTER (WHERE n = 2) AS matches_with_two_team_rows
    FROM (SELECT match_id, min(season) AS season, count(*) AS n FROM @t WHERE match_id % 10 > 0 OR is_home = 1 GROUP BY match_id) AS g GROUP BY season""",
)
def d2(t: Tables):
    return Q.season_coverage(t.long.where("match_id % 10 > 0 OR is_home = 1"))


@query(
    "D3_duplicates",
    "team:i match_date:s match_id:i",
    "SELECT team, match_date, match_id FROM (SELECT *, count(*) OVER (PARTITION BY team, match_date) AS n FROM @t) AS x WHERE n > 1",
)
def d3(t: Tables):
    return Q.duplicates(t.long.select("team", "match_date", "match_id"), ["team", "match_date"])


_FIXTURES = """SELECT match_id, pool, CAST(match_date AS STRING) AS date, home AS home_team, away AS away_team,
  CASE WHEN match_id % 50 = 0 THEN '9:00' ELSE '15:00' END AS kickoff_time_uk, '16:00' AS kickoff_time_dk FROM @matches"""


@query(
    "D4_validate_fixtures",
    "pool:i check:s value:d1 status:s",
    f"""WITH f AS ({_FIXTURES}), b AS (SELECT pool, count(*) AS n, count(*) - count(DISTINCT (date, home_team, away_team)) AS dup,
      count(*) FILTER (WHERE kickoff_time_uk = '9:00') AS uk FROM f GROUP BY pool),
    tm AS (SELECT pool, team, sum(h) AS h, sum(a) AS a FROM (SELECT pool, home_team AS team, 1 AS h, 0 AS a FROM f UNION ALL SELECT pool, away_team, 0, 1 FROM f) AS x GROUP BY ALL),
    c AS (SELECT pool, count(*) AS teams, count(*) FILTER (WHERE h + a <> 38) AS ot, count(*) FILTER (WHERE h <> 19) AS oh, count(*) FILTER (WHERE a <> 19) AS oa FROM tm GROUP BY pool)
    SELECT pool, v.check, v.value, CASE WHEN v.value = v.want THEN 'pass' ELSE 'fail' END AS status FROM b JOIN c USING (pool),
      LATERAL (VALUES ('missing_columns', 6, 0), ('fixture_count', n, 380), ('team_count', teams, 20), ('duplicate_fixtures', dup, 0), ('invalid_dates', 0, 0),
        ('invalid_uk_times', uk, 0), ('invalid_dk_times', 0, 0), ('teams_off_total', ot, 0), ('teams_off_home', oh, 0), ('teams_off_away', oa, 0)) AS v("check", value, want)""",
)
def d4(t: Tables):
    return Q.validate_fixtures(t.sql(_FIXTURES), ["pool"])


@query(
    "D5_validate_lineups",
    "check:s value:d6 status:s",
    """WITH p AS (SELECT match_id, team, player, count(*) AS n, sum(started) AS s FROM @appearances GROUP BY ALL),
    g AS (SELECT match_id, team, sum(n - 1) AS dup, sum(s) AS st FROM p GROUP BY ALL),
    a AS (SELECT sum(dup) AS dp, avg(CASE WHEN st BETWEEN 10 AND 12 THEN 1.0 ELSE 0 END) FILTER (WHERE st > 0) AS good FROM g),
    l AS (SELECT match_id, count(DISTINCT team) AS k, count(*) AS n FROM @t GROUP BY match_id),
    b AS (SELECT sum(n - k) AS dl, avg(CASE WHEN k = 2 THEN 1.0 ELSE 0 END) AS two FROM l)
    SELECT v.check, v.value, CASE WHEN v.ok THEN 'pass' ELSE 'fail' END AS status FROM a, b, LATERAL (VALUES ('duplicate_player_appearances', dp::DOUBLE, dp = 0),
      ('duplicate_team_lineups', dl, dl = 0), ('missing_dates', 0, true), ('starter_count', good, good > 0.95), ('two_team_lineups_per_match', two, two > 0.95)) AS v("check", value, ok)""",
)
def d5(t: Tables):
    """Both tables are parted by match before anything is grouped: joins and counts need no further shuffle, and parts stay small."""
    n = parts_for(t.lineitem)
    matches = t.matches.repartition(n, "match_id")
    appearances = t.sql(CTES["appearances"], lineitem=t.lineitem.repartition(n, "l_orderkey"), matches=matches)
    return Q.validate_lineups(to_long(matches).select("match_id", "team"), appearances)


@query(
    "D6_validate_managers",
    "check:s value:d6 status:s",
    """WITH a AS (SELECT sum(n - 1) AS dup FROM (SELECT count(*) AS n FROM @t GROUP BY match_date, team, opponent) AS x),
    b AS (SELECT count(*) AS m, avg(CASE WHEN k = 2 THEN 1.0 ELSE 0 END) AS two FROM (SELECT count(DISTINCT team) AS k FROM @t GROUP BY match_id) AS y)
    SELECT v.check, v.value, CASE WHEN v.ok THEN 'pass' ELSE 'fail' END AS status FROM a, b, LATERAL (VALUES ('duplicate_team_match_managers', dup::DOUBLE, dup = 0),
      ('two_manager_rows_per_match', two, two > 0.95), ('match_coverage', m, m >= 380)) AS v("check", value, ok)""",
)
def d6(t: Tables):
    return Q.validate_managers(t.coached.select("match_id", "match_date", "team", "opponent"))


_PRICES = """SELECT season, CASE WHEN match_id % 7 = 0 THEN NULL ELSE odds_h END AS AvgH, odds_d AS AvgD, odds_a AS AvgA,
  CASE WHEN match_id % 3 = 0 THEN odds_h END AS PSCH, odds_d AS PSCD, odds_a AS PSCA, odds_h AS Referee FROM @probs"""
_PRICE_COLS = ["AvgH", "AvgD", "AvgA", "PSCH", "PSCD", "PSCA", "Referee"]


@query(
    "D7_price_column_inventory",
    "column:s source:s outcome:s odds_type:s timing:s seasons_covered:s non_missing_values:i missing_values:i",
    f"""WITH p AS ({_PRICES}), s AS (SELECT string_agg(CAST(season AS VARCHAR), ', ' ORDER BY season) AS seasons FROM (SELECT DISTINCT season FROM p) AS d),
    c AS (SELECT {", ".join(f"count({c}) AS c_{c}" for c in _PRICE_COLS[:-1])}, count(*) AS n FROM p)
    SELECT v.column, v.source, v.outcome, v.odds_type, v.timing, s.seasons AS seasons_covered, v.k AS non_missing_values, n - v.k AS missing_values FROM c, s, LATERAL (VALUES
      ('AvgH', 'Market average', 'home', 'average pre-closing', 'PREMATCH_CONDITIONAL', c_AvgH), ('AvgD', 'Market average', 'draw', 'average pre-closing', 'PREMATCH_CONDITIONAL', c_AvgD),
      ('AvgA', 'Market average', 'away', 'average pre-closing', 'PREMATCH_CONDITIONAL', c_AvgA), ('PSCH', 'Pinnacle', 'home', 'single-bookmaker closing', 'BENCHMARK_ONLY', c_PSCH),
      ('PSCD', 'Pinnacle', 'draw', 'single-bookmaker closing', 'BENCHMARK_ONLY', c_PSCD), ('PSCA', 'Pinnacle', 'away', 'single-bookmaker closing', 'BENCHMARK_ONLY', c_PSCA)) AS v("column", source, outcome, odds_type, timing, k)""",
)
def d7(t: Tables):
    return Q.price_column_inventory(t.sql(_PRICES), _PRICE_COLS)


@query(
    "D7_price_column_rollup",
    "timing:s odds_type:s column_count:i columns:s non_missing_values:i",
    f"""WITH p AS ({_PRICES}) SELECT 'PREMATCH_CONDITIONAL' AS timing, 'average pre-closing' AS odds_type, 3 AS column_count, 'AvgA, AvgD, AvgH' AS columns,
      count(AvgH) + count(AvgD) + count(AvgA) AS non_missing_values FROM p
    UNION ALL SELECT 'BENCHMARK_ONLY', 'single-bookmaker closing', 3, 'PSCA, PSCD, PSCH', count(PSCH) + count(PSCD) + count(PSCA) FROM p""",
)
def d7_rollup(t: Tables):
    return Q.inventory_rollup(Q.price_column_inventory(t.sql(_PRICES), _PRICE_COLS), ["timing", "odds_type"])


@query(
    "D8_source_coverage",
    "source_file:s competition:s team_rows:i teams:i first_date:s last_date:s",
    """SELECT 'items' AS source_file, competition, count(*) AS team_rows, count(DISTINCT team) AS teams, min(match_date) AS first_date, max(match_date) AS last_date
    FROM @nonleague GROUP BY competition""",
)
def d8(t: Tables):
    return Q.source_coverage(t.nonleague.withColumn("source_file", F.lit("items")))


@query(
    "D9_validate_matches",
    "season:i matches:i first_date:s latest_date:s shot_missing_rows:i",
    """SELECT season, count(*) AS matches, min(match_date) AS first_date, max(match_date) AS latest_date,
      count(*) FILTER (WHERE hs IS NULL OR as_ IS NULL OR hst IS NULL OR ast IS NULL) AS shot_missing_rows FROM @matches GROUP BY season""",
)
def d9(t: Tables):
    return Q.validate_matches(t.matches)


@query(
    "D10_assess_prediction_quality",
    "match_id:i warnings:s status:s",
    """WITH b AS (SELECT match_id, match_date > DATE '2001-06-01' + 14 AS stale, hs, as_, hg, ag, hst, ast FROM @matches),
    w AS (SELECT match_id, list_filter([CASE WHEN stale THEN 'stale_data' END, CASE WHEN hs > 15 AND NOT stale THEN 'home_long_gap' END,
      CASE WHEN hst IS NULL AND hg > 0 THEN 'home_adjusted_history' WHEN hst IS NULL THEN 'home_no_history' END,
      CASE WHEN as_ > 15 AND NOT stale THEN 'away_long_gap' END,
      CASE WHEN ast IS NULL AND ag > 0 THEN 'away_adjusted_history' WHEN ast IS NULL THEN 'away_no_history' END], lambda x: x IS NOT NULL) AS ws FROM b)
    SELECT match_id, array_to_string(ws, ',') AS warnings, CASE WHEN len(ws) = 0 THEN 'Good' WHEN len(ws) <= 2 THEN 'Warning' ELSE 'Poor' END AS status FROM w""",
)
def d10(t: Tables):
    side = lambda h, a: {"home": h, "away": a}
    got = Q.assess_prediction_quality(
        t.matches, match_date=F.col("match_date"), latest=F.lit("2001-06-01").cast("date"),
        rest=side(F.col("hs") + 15, F.col("as_") + 15), known=side(F.col("hst").isNotNull(), F.col("ast").isNotNull()),
        signal=side(F.col("hg") > 0, F.col("ag") > 0),
    )
    return got.withColumn("warnings", F.array_join("warnings", ","))


@query(
    "D11_signal_coverage",
    "split:s rows:i signal:s with_signal:i",
    """WITH b AS (SELECT CASE WHEN season < 2000 THEN 'train' ELSE 'test' END AS split, hg, ag, hst FROM @matches),
    c AS (SELECT split, count(*) AS rows, count(*) FILTER (WHERE hg + ag > 0) AS g, count(*) FILTER (WHERE coalesce(hst, 0) > 0) AS s FROM b GROUP BY split)
    SELECT split, rows, 'goals' AS signal, g AS with_signal FROM c UNION ALL SELECT split, rows, 'shots', s FROM c""",
)
def d11(t: Tables):
    rows = t.matches.withColumn("split", F.when(F.col("season") < 2000, "train").otherwise("test"))
    return Q.signal_coverage(rows, {"goals": ["hg", "ag"], "shots": ["hst"]})


_POLICY = """SELECT concat('f', CAST(p_partkey AS STRING)) AS feature, p_size > 10 AS active, array('hs', p_name, CASE WHEN p_size % 2 = 0 THEN 'hxg' ELSE p_brand END) AS columns FROM part"""


@query(
    "D12_validate_feature_policy",
    "feature:s column:s",
    """SELECT feature, c AS "column" FROM (SELECT concat('f', CAST(p_partkey AS VARCHAR)) AS feature, p_size > 10 AS active,
      unnest(['hs', p_name, CASE WHEN p_size % 2 = 0 THEN 'hxg' ELSE p_brand END]) AS c FROM part) AS x
    WHERE active AND c NOT IN ('hs', 'hxg') AND c NOT IN (SELECT p_name FROM part WHERE p_partkey % 2 = 0)""",
)
def d12(t: Tables):
    have = t.part.where("p_partkey % 2 = 0").select(F.col("p_name").alias("column"))
    table = t.matches.limit(1).select(F.explode(F.array(*[F.lit(c) for c in t.matches.columns])).alias("column"))
    return Q.validate_feature_policy(have.union(table), t.sql(_POLICY))


@query(
    "D12_feature_lists",
    "active:s features:i",
    "SELECT CASE WHEN p_size > 10 THEN 'true' ELSE 'false' END AS active, count(*) AS features FROM part GROUP BY ALL",
)
def d12_lists(t: Tables):
    return Q.feature_lists(t.sql(_POLICY))


@query(
    "D13_field_availability",
    "source:s field:s available:i values:i source_columns:s",
    """SELECT 'results' AS source, 'shots' AS field, 1 AS available, count(hs) + count(as_) AS "values", 'hs|as_' AS source_columns FROM @matches
    UNION ALL SELECT 'results', 'possession', 0, 0, 'possession'""",
)
def d13(t: Tables):
    return Q.field_availability(t.matches, {"shots": ["hs", "as_"], "possession": ["possession"]}, "results")


_CUTOFFS = ("1996-02-11", "1998-07-01", "2000-10-30")


@query(
    "D14_leakage_check",
    "builder:s cutoff:s match_id:i side:s",
    "SELECT '' AS builder, '' AS cutoff, match_id, '' AS side FROM @matches WHERE match_id < 0",
)
def d14(t: Tables):
    """Four builders at three dates: no row."""
    builders = {
        "form": (R.match_features, t.long), "head_to_head": (R.head_to_head, t.matches),
        "elo": (E.elo_features, t.matches), "opponent_adjusted_xg": (E.opponent_adjusted_xg, t.matches),
    }
    checks = [
        found.select(F.lit(name).alias("builder"), F.lit(day).alias("cutoff"), "match_id", "side")
        for name, (build, source) in builders.items()
        for day, found in zip(_CUTOFFS, Q.leakage_checks(build, source, _CUTOFFS), strict=True)
    ]
    return reduce(DataFrame.unionByName, checks)


def _season_size(df: DataFrame) -> DataFrame:
    """A leak: the matches of the whole season, later ones included."""
    sizes = df.groupBy("pool", "season").agg(F.count("*").alias("season_matches"))
    return df.select("match_id", "pool", "season").join(sizes, ["pool", "season"])


@query(
    "D14_planted_leak",
    "match_id:i side:s season_matches:i",
    f"""WITH b AS (SELECT pool, season, count(*) AS f, count(*) FILTER (WHERE match_date < DATE '{_CUTOFFS[1]}') AS p FROM @matches GROUP BY ALL HAVING f > p),
    e AS (SELECT match_id, f, p FROM @matches JOIN b USING (pool, season) WHERE match_date < DATE '{_CUTOFFS[1]}')
    SELECT match_id, 'full' AS side, f AS season_matches FROM e UNION ALL SELECT match_id, 'truncated', p FROM e""",
)
def d14_planted(t: Tables):
    return Q.leakage_check(_season_size, t.matches, _CUTOFFS[1]).select("match_id", "side", "season_matches")
