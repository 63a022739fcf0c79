"""Readers' cleaning steps, payload normalisers and refresh steps (S1-S25) on texts derived from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from matchframe import schema as S
from matchframe.functions.clean import COMPETITION_WEIGHTS
from matchframe.plans.clean_queries import case_map
from matchframe.plans.registry import query
from matchframe.plans.stages import checkpoint_dir
from matchframe.plans.tables import CTES, Tables, date_text
from matchframe.sources import absences as A
from matchframe.sources import lineups as L
from matchframe.sources import readers as R
from matchframe.sources import sinks

# --- result files ----------------------------------------------------------

_CLEAN = """SELECT rid, season_text AS season, m.match_date, "HomeTeam" AS home, "AwayTeam" AS away, m.hg, m.ag, m.result,
  CAST(m.hs AS DOUBLE) AS hs, CAST(m.hst AS DOUBLE) AS hst, TRY_CAST(r."HxG" AS DOUBLE) AS provider_hxg,
  m.axg AS provider_axg, m.hxg AS true_hxg, m.pool
FROM @result_text r JOIN @matches m ON m.match_id = r.rid WHERE r.rid % 31 <> 0 AND r.rid % 29 <> 0"""
_CLEAN_COLS = "season:s match_date:s home:s away:s hg:i ag:i result:s hs:d1 hst:d1 provider_hxg:d2 provider_axg:d2"


@query("S1_read_matches", _CLEAN_COLS, _CLEAN)
def s1(t: Tables):
    return R.clean_results(t.result_text, F.col("season_text"))


@query(
    "S5_read_second_tier",
    "season:s match_date:s home:s away:s hg:i ag:i result:s",
    f"SELECT * FROM ({_CLEAN}) AS c WHERE pool % 2 = 1",
)
def s5(t: Tables):
    lower = t.result_text.where("pool % 2 = 1").drop("HS", "AS", "HST", "AST", "HxG", "AxG")
    return R.clean_results(lower, F.col("season_text"))


# One provider file per league: a dates array of its matches.
_XG_ROW = """SELECT match_id, pool, CAST(season AS STRING) AS season, {iso} AS datetime, match_id % 9 <> 0 AS is_result,
  CAST(home AS STRING) AS h, CAST(away AS STRING) AS a, CAST(hxg AS STRING) AS xh, CAST(axg AS STRING) AS xa FROM @matches"""
_XG_ROW = _XG_ROW.format(iso=date_text("match_date", "iso"))


def _xg_payload(t: Tables):
    side = lambda c: F.struct(F.col(c).alias("title"))
    return t.sql(_XG_ROW).select(
        "season",
        F.array(
            F.struct(
                F.col("match_id").cast("string").alias("id"), F.col("is_result").alias("isResult"),
                F.concat("datetime", F.lit(" 15:00:00")).alias("datetime"), side("h").alias("h"), side("a").alias("a"),
                F.struct(F.lit("0").alias("h"), F.lit("0").alias("a")).alias("goals"),
                F.struct(F.col("xh").alias("h"), F.col("xa").alias("a")).alias("xG"),
            )
        ).alias("dates"),
    )


_XG_SQL = """SELECT CAST(season AS VARCHAR) AS season, match_date, CAST(home AS VARCHAR) AS home, CAST(away AS VARCHAR) AS away, hxg, axg
  FROM @matches WHERE match_id % 9 <> 0"""


@query("S2_read_xg_json", "season:s match_date:s home:s away:s hxg:d2 axg:d2", _XG_SQL)
def s2(t: Tables):
    return R.xg_rows(_xg_payload(t), F.col("season"))


CTES["unique_matches"] = """SELECT min(match_id) AS match_id, season, match_date, home, away, min(hxg) AS hxg, min(axg) AS axg,
  min(hs) AS hs, min(as_) AS as_, min(hst) AS hst, min(ast) AS ast, min(hg) AS hg, min(ag) AS ag
  FROM @matches GROUP BY season, match_date, home, away"""


@query(
    "S3_attach_xg",
    "match_id:i hxg:d2 axg:d2",
    """SELECT match_id, CASE WHEN match_id % 4 = 0 THEN 9.5 WHEN match_id % 3 = 0 THEN hxg END AS hxg,
      CASE WHEN match_id % 4 = 0 THEN 8.5 WHEN match_id % 3 = 0 THEN axg END AS axg FROM @unique_matches""",
)
def s3(t: Tables):
    u = t.unique_matches
    spare = F.col("match_id") % 3 == 0
    base = u.select(
        "match_id", *R.MATCH_KEY, F.when(spare, F.col("hxg")).alias("provider_hxg"), F.when(spare, F.col("axg")).alias("provider_axg")
    )
    xg = u.where("match_id % 4 = 0").select(*R.MATCH_KEY, F.lit(9.5).alias("hxg"), F.lit(8.5).alias("axg"))
    return R.attach_xg(base, xg)


@query(
    "S4_attach_shots",
    "match_id:i hs:d1 as_:d1 hst:d1 ast:d1",
    "SELECT match_id, " + ", ".join(f"CASE WHEN match_id % 5 > 0 THEN {c} END AS {c}" for c in ("hs", "as_", "hst", "ast")) + " FROM @unique_matches",
)
def s4(t: Tables):
    u = t.unique_matches
    return R.attach_shots(u.select("match_id", *R.MATCH_KEY), u.where("match_id % 5 > 0"))


@query(
    "S6_read_table_with_defaults",
    "team:s player:s suspended_from:s suspended_until:s matches_remaining:d1 expected_starter:d1 importance_score:d1 reason:s",
    """SELECT concat('Team ', CAST(o_custkey AS VARCHAR)) AS team, o_orderpriority AS player, CAST(o_orderdate AS DATE) AS suspended_from,
      NULL AS suspended_until, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 3 END AS matches_remaining, 0 AS expected_starter,
      0 AS importance_score, NULL AS reason FROM orders WHERE o_orderkey % 6 <> 5""",
)
def s6(t: Tables):
    raw = t.date_texts.join(t.orders, F.col("k") == F.col("o_orderkey")).select(
        F.concat(F.lit("Team "), F.col("o_custkey").cast("string")).alias("team"),
        F.col("o_orderpriority").alias("player"),
        F.col("txt").alias("suspended_from"),
        F.when(F.col("k") % 4 == 0, "none").otherwise((F.col("k") % 3).cast("string")).alias("matches_remaining"),
    )
    return R.with_defaults(raw, S.SUSPENSIONS, required=["team", "player", "suspended_from"])


_OPEN = f"""SELECT match_id, CAST(season AS STRING) AS "Season", {date_text("match_date", "iso")} AS "Date", CAST(home AS STRING) AS "HomeTeam",
  CAST(away AS STRING) AS "AwayTeam", CASE WHEN match_id % 7 = 0 THEN 'n/a' ELSE CAST(odds_h AS STRING) END AS "home_open_odds",
  CAST(odds_d AS STRING) AS "draw_open_odds", CASE WHEN match_id % 11 = 0 THEN '1.0' ELSE CAST(odds_a AS STRING) END AS "away_open_odds" FROM @probs"""


@query(
    "S7_read_opening_odds",
    "season:s match_date:s home:s away:s market_home_prob:d8 market_draw_prob:d8 market_away_prob:d8 market_margin:d8 market_favorite_prob:d8",
    """SELECT CAST(season AS VARCHAR) AS season, match_date, home, away, 1 / odds_h / s AS market_home_prob, 1 / odds_d / s AS market_draw_prob,
      1 / odds_a / s AS market_away_prob, s - 1 AS market_margin, greatest(1 / odds_h, 1 / odds_d, 1 / odds_a) / s AS market_favorite_prob
    FROM (SELECT *, 1 / odds_h + 1 / odds_d + 1 / odds_a AS s FROM @probs) AS p
    WHERE match_id % 7 <> 0 AND match_id % 11 <> 0 AND odds_h > 1 AND odds_d > 1 AND odds_a > 1""",
)
def s7(t: Tables):
    return R.clean_opening_odds(t.sql(_OPEN))


@query(
    "S8_read_fixtures",
    "matchweek:i match_date:s home:s away:s completed:i",
    """SELECT m.match_id % 38 + 1 AS matchweek, m.match_date, concat('Team ', CAST(home AS VARCHAR)) AS home,
      concat('Team ', CAST(away AS VARCHAR)) AS away, CASE WHEN m.match_id % 29 = 0 THEN 0 ELSE 1 END AS completed
    FROM @matches m WHERE m.match_id % 31 <> 0""",
)
def s8(t: Tables):
    raw = t.result_text
    plain = R.clean_fixtures(
        raw.select((F.col("rid") % 38 + 1).alias("matchweek"), F.col("Date").alias("date"), F.col("HomeTeam").alias("home_team"),
                   F.col("AwayTeam").alias("away_team"), F.col("rid")), ["rid"]
    )
    # By row: teams may meet twice on a day, and only one of the two matches may have a score.
    done = R.completed_only(raw.where("season_text IS NOT NULL"), F.col("season_text"), ["rid"]).select("rid").distinct()
    return plain.join(done.withColumn("c", F.lit(1)), ["rid"], "left").withColumn(
        "completed", F.coalesce("c", F.lit(0))
    )


_FIX = """SELECT o_orderkey AS k, concat('{"content":[{"kickoff":{"millis":', CAST((o_orderkey % 18000) * 86400000
  + (CAST(floor(o_totalprice) AS BIGINT) % 24) * 3600000 AS STRING), '.0},"gameweek":{"gameweek":', CAST(o_orderkey % 38 + 1 AS STRING),
  '.0},"teams":[{"team":{"club":{"name":"Manchester City"}}},{"team":{"club":{"name":"Club ', CAST(o_custkey AS STRING), '"}}}]}]}') AS payload FROM orders"""


@query(
    "S9_fixtures_from_json",
    "last_updated:s matchweek:i date:s kickoff_time_uk:s kickoff_time_dk:s home_team:s away_team:s",
    """WITH k AS (SELECT o_orderkey AS k, o_custkey, make_timestamptz(((o_orderkey % 18000) * 86400000
      + (CAST(floor(o_totalprice) AS BIGINT) % 24) * 3600000) * 1000) AS ko FROM orders)
    SELECT k AS last_updated, k % 38 + 1 AS matchweek, CAST(timezone('Europe/London', ko) AS DATE) AS date,
      strftime(timezone('Europe/London', ko), '%H:%M') AS kickoff_time_uk, strftime(timezone('Europe/Copenhagen', ko), '%H:%M') AS kickoff_time_dk,
      'Man City' AS home_team, concat('Club ', CAST(o_custkey AS VARCHAR)) AS away_team FROM k""",
)
def s9(t: Tables):
    return R.fixtures_from_json(t.sql(_FIX), "payload", "2026/27", F.col("k").cast("string"))


@query(
    "S10_read_non_league",
    "source_file:s match_date:s team:s opponent:s competition:s points:d1 goals_for:d1 shots_for:d1 weight:d2",
    f"""WITH c AS ({_CLEAN.replace("r.rid % 31 <> 0 AND r.rid % 29 <> 0", "r.rid % 31 <> 0")}),
    b AS (SELECT 'fixtures.csv' AS source_file, match_date, home AS team, away AS opponent, 'Championship' AS competition,
      CASE result WHEN 'D' THEN 1 WHEN 'H' THEN 3 ELSE 0 END AS points, CASE WHEN rid % 29 = 0 THEN 0 ELSE hg END AS goals_for,
      coalesce(hs, 0) AS shots_for FROM c
    UNION ALL SELECT 'fixtures.csv', match_date, away, home, 'Championship', CASE result WHEN 'D' THEN 1 WHEN 'A' THEN 3 ELSE 0 END,
      ag, coalesce(as_, 0) FROM (SELECT c.*, m.as_ FROM c JOIN @matches m ON m.match_id = c.rid) AS x
    UNION ALL SELECT 'teams.csv', match_date, CAST(team AS VARCHAR), 'unknown', competition, points, goals_for, shots_for FROM @nonleague)
    SELECT *, {case_map("competition", COMPETITION_WEIGHTS, "0.5")} AS weight FROM b""",
)
def s10(t: Tables):
    fixtures = t.result_text.select("Date", "HomeTeam", "AwayTeam", "FTR", "FTHG", "FTAG", "HS", "AS")
    teams = t.nonleague.select(
        F.col("match_date").alias("date"), F.col("team").cast("string").alias("team"), F.lit("unknown").alias("opponent"),
        "competition", "points", "goals_for", "shots_for",
    )
    a = R.non_league_rows(fixtures, "fixtures.csv", "Championship")
    return a.unionByName(R.non_league_rows(teams, "teams.csv", "Non-league"))


def _scratch(t: Tables, name: str) -> str:
    """A new folder below the shared one."""
    return f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "S11_union_tagged_exports",
    "source_file:s k:i name:s extra:s",
    """SELECT 'a.csv' AS source_file, k, name, NULL AS extra FROM @names WHERE k % 2 = 0
    UNION ALL SELECT 'b.csv', k, name, segment FROM @names WHERE k % 2 = 1""",
)
def s11(t: Tables):
    """Two exports with different columns, written as CSV to the shared folder and read as one directory."""
    folder = _scratch(t, "exports")
    quoted = F.concat(F.lit("<"), F.col("name"), F.lit(">")).alias("name")
    sinks.write_table(t.names.where("k % 2 = 0").select("k", quoted), f"{folder}/a.csv", "csv")
    sinks.write_table(t.names.where("k % 2 = 1").select("k", quoted, F.col("segment").alias("extra")), f"{folder}/b.csv", "csv")
    return R.read_csv_dir(t.spark, folder).withColumn("name", F.regexp_replace("name", "^<|>$", ""))


# --- absences --------------------------------------------------------------

_ITEM = f"""SELECT l_orderkey * 10 + l_linenumber AS k, l_partkey, l_suppkey, l_quantity, l_linenumber, CAST(l_shipdate AS DATE) AS d,
  {date_text("l_shipdate", "iso")} AS iso FROM lineitem"""
_FEED = f"""SELECT k, concat('{{"response":[{{"player":{{"name":"P', CAST(l_partkey AS STRING), '"}},"team":{{"name":"T', CAST(l_suppkey AS STRING),
  '"}},"fixture":{{"date":"', CASE WHEN l_linenumber = 3 THEN '' ELSE iso END, 'T15:00:00+00:00"}},"type":"Missing Fixture","reason":"',
  CASE WHEN l_linenumber % 3 = 0 THEN 'Red Card' ELSE 'Hamstring' END, '"}}]}}') AS payload FROM ({_ITEM}) AS i"""
_ABS_COLS = "report_date:s team:s player:s unavailable_from:s expected_return_date:s status_type:s injury_or_suspension:s is_suspended:d1"


@query(
    "S12_absences_fixture_feed",
    _ABS_COLS,
    f"""SELECT CASE WHEN l_linenumber = 3 THEN DATE '2000-01-01' ELSE d END AS report_date, concat('T', CAST(l_suppkey AS VARCHAR)) AS team,
      concat('P', CAST(l_partkey AS VARCHAR)) AS player, CASE WHEN l_linenumber = 3 THEN DATE '2000-01-01' ELSE d END AS unavailable_from,
      CASE WHEN l_linenumber = 3 THEN NULL ELSE d END AS expected_return_date,
      CASE WHEN l_linenumber % 3 = 0 THEN 'suspension' ELSE 'injury' END AS status_type,
      CASE WHEN l_linenumber % 3 = 0 THEN 'Red Card' ELSE 'Hamstring' END AS injury_or_suspension,
      CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END AS is_suspended FROM ({_ITEM}) AS i""",
)
def s12(t: Tables):
    return A.from_fixture_feed(t.sql(_FEED), "payload", F.lit("2000-01-01").cast("date"))


# Both payload shapes: a list of entities with a list, and one entity with {"data": []}.
_SIDE = f"""SELECT k, concat(CASE WHEN l_linenumber % 2 = 0 THEN '{{"data":[' ELSE '{{"data":' END,
  CASE WHEN l_linenumber % 2 = 0 THEN '{{"id":1,"sidelined":[' ELSE '{{"id":1,"sidelined":{{"data":[' END,
  '{{"participant":{{"name":"T', CAST(l_suppkey AS STRING), '"}},"player":{{"display_name":"P', CAST(l_partkey AS STRING),
  '"}},"type":{{"name":"Muscle"}},"sideline":{{"category":"', CASE WHEN l_linenumber % 3 = 0 THEN 'suspended' ELSE 'injured' END,
  '","start_date":"', iso, '","end_date":null}}}}', CASE WHEN l_linenumber % 2 = 0 THEN ']}}]}}' ELSE ']}}}}}}' END) AS payload FROM ({_ITEM}) AS i"""


@query(
    "S13_absences_sidelined_feed",
    _ABS_COLS,
    f"""SELECT d AS report_date, concat('T', CAST(l_suppkey AS VARCHAR)) AS team, concat('P', CAST(l_partkey AS VARCHAR)) AS player,
      d AS unavailable_from, NULL AS expected_return_date, CASE WHEN l_linenumber % 3 = 0 THEN 'suspension' ELSE 'injury' END AS status_type,
      concat(CASE WHEN l_linenumber % 3 = 0 THEN 'suspended' ELSE 'injured' END, ' Muscle') AS injury_or_suspension,
      CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END AS is_suspended FROM ({_ITEM}) AS i""",
)
def s13(t: Tables):
    return A.from_sidelined_feed(t.sql(_SIDE), "payload", F.lit("2000-01-01").cast("date"))


# A player's status per round: the rounds of a team's season, one status by hash.
CTES["round_schedule"] = """SELECT season AS season_start, team, match_date,
  row_number() OVER (PARTITION BY season, team ORDER BY match_date, h, a, mid) AS round
  FROM (SELECT season, match_date, home AS h, away AS a, home AS team, match_id AS mid FROM @matches
    UNION ALL SELECT season, match_date, home, away, away, match_id FROM @matches) AS s"""
CTES["round_status"] = """SELECT season AS season_start, team, concat('P', CAST(is_home AS STRING)) AS player,
  min(match_id % 25 + 1) AS round, CASE CAST(min(match_id) % 9 AS INT) WHEN 0 THEN 'injured' WHEN 1 THEN 'Suspended' WHEN 2 THEN 'sub_in' WHEN 3 THEN 'bench'
    ELSE 'starting' END AS status,
  CASE WHEN min(match_id) % 2 = 0 THEN 'Return expected on 01/01/2002' ELSE '' END AS detail
  FROM @t GROUP BY season, team, is_home, match_id % 25"""


@query(
    "S14_absences_round_status",
    "report_date:s team:s player:s status_type:s injury_or_suspension:s is_expected_starter:d1 is_key_player:d1 is_long_term_injury:d1 minutes_played_last_365:d1",
    """WITH r AS (SELECT s.season_start, s.team, s.player, s.round, lower(s.status) AS status, s.detail, d.match_date
      FROM @round_status s LEFT JOIN @round_schedule d USING (season_start, team, round)),
    k AS (SELECT * FROM r WHERE match_date IS NOT NULL OR status IN ('starting', 'sub_in')),
    w AS (SELECT *, coalesce(sum(CASE WHEN status = 'starting' THEN 1 ELSE 0 END) OVER (p ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS s5,
      lag(status) OVER p AS prev, coalesce(sum(CASE status WHEN 'starting' THEN 90 WHEN 'sub_in' THEN 25 ELSE 0 END)
        OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mins
      FROM k WINDOW p AS (PARTITION BY season_start, team, player ORDER BY round))
    SELECT match_date AS report_date, team, player, CASE status WHEN 'suspended' THEN 'suspension' ELSE 'injury' END AS status_type,
      CASE WHEN detail = '' THEN status ELSE detail END AS injury_or_suspension,
      CASE WHEN s5 >= 3 OR prev = 'starting' THEN 1 ELSE 0 END AS is_expected_starter, CASE WHEN mins >= 900 THEN 1 ELSE 0 END AS is_key_player,
      CASE WHEN detail <> '' AND DATE '2002-01-01' - match_date >= 30 THEN 1 ELSE 0 END AS is_long_term_injury, mins AS minutes_played_last_365
    FROM w WHERE match_date IS NOT NULL AND status IN ('injured', 'suspended')""",
)
def s14(t: Tables):
    m = t.matches.select(F.col("season").alias("season_start"), "match_date", "home", "away")
    rows = t.round_status.withColumn("collected", F.lit("2003-01-01").cast("date"))
    return A.from_round_status(rows, A.round_dates(m))


_EXPORT = f"""SELECT concat('T', CAST(l_suppkey AS STRING)) AS "Club", concat('P', CAST(l_partkey AS STRING)) AS "name", {date_text("l_shipdate", "slash")} AS "from",
  CASE WHEN l_linenumber = 1 THEN '?' ELSE {date_text("l_shipdate", "iso")} END AS "until",
  CASE WHEN l_returnflag = 'R' THEN 'Suspended' ELSE 'Knee' END AS "reason", CAST(l_quantity AS STRING) AS "minutes",
  concat('€', CAST(l_linenumber AS STRING), '.5m') AS "value" FROM lineitem"""


@query(
    "S15_absences_flat_export",
    _ABS_COLS + " source:s minutes_played_last_365:d1 market_value_eur:d1",
    """WITH b AS (SELECT concat('T', CAST(l_suppkey AS VARCHAR)) AS team, concat('P', CAST(l_partkey AS VARCHAR)) AS player, CAST(l_shipdate AS DATE) AS d,
      CASE WHEN l_returnflag = 'R' THEN 'Suspended' ELSE 'Knee' END AS injury_or_suspension, l_quantity AS minutes_played_last_365,
      (l_linenumber + 0.5) * 1000000 AS market_value_eur, l_linenumber, l_returnflag FROM lineitem)
    SELECT *, d AS report_date, d AS unavailable_from, CASE WHEN l_linenumber = 1 THEN NULL ELSE d END AS expected_return_date, 'injury' AS status_type,
      0 AS is_suspended, 'spells' AS source FROM b
    UNION ALL SELECT *, NULL AS report_date, NULL AS unavailable_from, NULL AS expected_return_date,
      CASE WHEN l_returnflag = 'R' THEN 'suspension' ELSE 'injury' END AS status_type, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_suspended, 'statuses' AS source FROM b""",
)
def s15(t: Tables):
    raw = t.sql(_EXPORT)
    spells = A.from_flat_export(raw, A.SPELL_EXPORT, "spells", read_status=False)
    return spells.unionByName(A.from_flat_export(raw, A.STATUS_EXPORT, "statuses", read_status=True))


@query(
    "S16_absence_master",
    "report_date:s team:s player:s unavailable_from:s expected_return_date:s status_type:s source:s minutes_played_last_365:d1",
    """WITH b AS (SELECT report_date, team, player, unavailable_from, expected_return_date, status_type, row_id, minutes FROM @absences),
    u AS (SELECT *, 0 AS r, 'first' AS source FROM b UNION ALL SELECT *, 1, 'second' FROM b WHERE row_id % 2 = 0)
    SELECT report_date, team, player, unavailable_from, expected_return_date, status_type, source, minutes AS minutes_played_last_365 FROM (
      SELECT *, row_number() OVER (PARTITION BY report_date, team, player, unavailable_from, expected_return_date, status_type
        ORDER BY r DESC, minutes DESC) AS rn FROM u) AS x WHERE rn = 1""",
)
def s16(t: Tables):
    def source(df, name):
        return A.canonical(
            df, name, F.lit(None), report_date=F.col("report_date"), team=F.col("team"), player=F.col("player"),
            unavailable_from=F.col("unavailable_from"), expected_return_date=F.col("expected_return_date"),
            status_type=F.col("status_type"), minutes_played_last_365=F.col("minutes"),
        )

    return A.build_absence_master(source(t.absences, "first"), source(t.absences.where("row_id % 2 = 0"), "second"))


# --- line-ups --------------------------------------------------------------

_LINEUP = f"""SELECT l_orderkey * 10 + l_linenumber AS rank_id, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_orderkey AS STRING) END AS game_id,
  {date_text("l_shipdate", "iso")} AS "Date", concat('T', CAST(l_linenumber % 2 AS STRING)) AS squad, concat('P', CAST(l_partkey AS STRING)) AS "Player",
  CASE WHEN l_quantity > 10 THEN '1' ELSE '0' END AS starter, CAST(l_quantity AS STRING) AS mins, l_returnflag AS formation, l_linestatus AS captain,
  CASE WHEN l_linenumber = 2 THEN concat('P', CAST(l_suppkey AS STRING)) END AS sub_on_player, CAST(l_linenumber * 10 AS STRING) AS sub_minute FROM lineitem"""
_L_SQL = """WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS rk, CAST(l_orderkey AS VARCHAR) AS match_id, CAST(l_shipdate AS DATE) AS date,
  concat('T', CAST(l_linenumber % 2 AS VARCHAR)) AS team, * FROM lineitem WHERE l_linenumber <> 7),
o AS (SELECT *, row_number() OVER (PARTITION BY match_id, team ORDER BY rk DESC) AS rn FROM b)
"""


@query(
    "S17_normalize_lineups",
    "table_name:s match_id:s date:s team:s who:s started:d1 minutes:d1 formation:s",
    _L_SQL + """SELECT 'lineups' AS table_name, match_id, date, team, l_linestatus AS who, NULL AS started, NULL AS minutes, l_returnflag AS formation FROM o WHERE rn = 1
    UNION ALL SELECT 'formations', match_id, date, team, NULL, NULL, NULL, l_returnflag FROM o WHERE rn = 1
    UNION ALL SELECT 'appearances', match_id, date, team, concat('P', CAST(l_partkey AS VARCHAR)), CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END, l_quantity, NULL FROM b
    UNION ALL SELECT 'substitutions', match_id, date, team, concat('P', CAST(l_suppkey AS VARCHAR)), NULL, l_linenumber * 10, NULL FROM b WHERE l_linenumber = 2""",
)
def s17(t: Tables):
    got = L.normalize_lineups(t.sql(_LINEUP), "export", "rank_id")
    none = F.lit(None)
    pick = {
        "lineups": ("captain", none, none, F.col("formation")),
        "formations": ("manager", none, none, F.col("formation")),
        "appearances": ("player", F.col("started"), F.col("minutes"), none),
        "substitutions": ("player_on", none, F.col("minute"), none),
    }
    parts = [
        got[k].select(
            F.lit(k).alias("table_name"), "match_id", "date", "team", F.col(who).alias("who"), s.cast("double").alias("started"),
            m.cast("double").alias("minutes"), f.cast("string").alias("formation"),
        )
        for k, (who, s, m, f) in pick.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "S17_lineup_master",
    "table_name:s source:s n:i",
    _L_SQL + """, u AS (SELECT match_id, team, l_partkey, rk, 0 AS r FROM b UNION ALL SELECT match_id, team, l_partkey, rk, 1 FROM b WHERE l_linenumber <= 3),
    l AS (SELECT match_id, team, max(r) AS r FROM u GROUP BY ALL), p AS (SELECT match_id, team, l_partkey, max(r) AS r FROM u GROUP BY ALL)
    SELECT 'lineups' AS table_name, CASE r WHEN 0 THEN 'first' ELSE 'second' END AS source, count(*) AS n FROM l GROUP BY r
    UNION ALL SELECT 'formations', CASE r WHEN 0 THEN 'first' ELSE 'second' END, count(*) FROM l GROUP BY r
    UNION ALL SELECT 'appearances', CASE r WHEN 0 THEN 'first' ELSE 'second' END, count(*) FROM p GROUP BY r
    UNION ALL SELECT 'substitutions', s, count(*) FROM (SELECT unnest(['first', 'second']) AS s FROM b WHERE l_linenumber = 2) AS x GROUP BY s""",
)
def s17_master(t: Tables):
    raw = t.sql(_LINEUP)
    tables = L.build_lineup_master(
        L.normalize_lineups(raw, "first", "rank_id"), L.normalize_lineups(raw.where("rank_id % 10 <= 3"), "second", "rank_id")
    )
    out = None
    for name, df in tables.items():
        part = df.groupBy("source").agg(F.count("*").alias("n")).withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


_LM_RAW = f"""SELECT a.match_id * 100 + a.player AS rank_id, CAST(a.match_id AS STRING) AS match_id, concat('Club ', CAST(a.team AS STRING)) AS team,
  concat('P', CAST(a.player AS STRING)) AS player, CASE CAST(a.player % 3 AS INT) WHEN 0 THEN 'GK' WHEN 1 THEN 'DF,MF' ELSE 'zz' END AS pos,
  CASE WHEN a.started = 1 THEN 'true' ELSE 'no' END AS is_starter, CAST(a.minutes AS STRING) AS minutes FROM @appearances AS a"""
_LM_SCHED = f"""SELECT CAST(match_id AS STRING) AS match_id, {date_text("match_date", "iso")} AS date, CAST(season AS STRING) AS season,
  concat('Club ', CAST(home AS STRING)) AS home, concat('Club ', CAST(away AS STRING)) AS away FROM @matches"""


@query(
    "S18_lineups_matched",
    "match_id:s season:s date:s team:s opponent:s player:s position_group:s started:d1 minutes:d1 source_collected_at:s",
    """WITH k AS (SELECT match_date, home, away, min(match_id) AS mid FROM @matches GROUP BY ALL),
    m AS (SELECT * FROM @matches WHERE match_id % 4 <> 0),
    b AS (SELECT a.*, m0.home, m0.away FROM @appearances a JOIN @matches m0 USING (match_id)),
    x AS (SELECT b.*, CASE WHEN b.team = b.home THEN b.away ELSE b.home END AS opp FROM b),
    e AS (SELECT DISTINCT match_date, home, away, season FROM m)
    SELECT lower(replace(concat(CAST(e.season AS VARCHAR), '_', strftime(x.match_date, '%Y%m%d'), '_club ', CAST(e.home AS VARCHAR), '_club ', CAST(e.away AS VARCHAR)), ' ', '_')) AS match_id,
      e.season, x.match_date AS date, concat('Club ', CAST(x.team AS VARCHAR)) AS team, concat('Club ', CAST(x.opp AS VARCHAR)) AS opponent,
      concat('P', CAST(x.player AS VARCHAR)) AS player, CASE x.player % 3 WHEN 0 THEN 'goalkeeper' WHEN 1 THEN 'defender' ELSE 'unknown' END AS position_group,
      x.started, x.minutes, x.match_date + 1 AS source_collected_at
    FROM x JOIN (SELECT match_date, home, away, season, team, opp, row_number() OVER (PARTITION BY match_date, team, opp ORDER BY ih DESC) AS rn FROM (
        SELECT *, home AS team, away AS opp, 0 AS ih FROM e UNION ALL SELECT *, away, home, 1 FROM e) AS z) AS e
      ON e.rn = 1 AND e.match_date = x.match_date AND e.team = x.team AND e.opp = x.opp""",
)
def s18(t: Tables):
    return _matched_lineups(t)["appearances"]


def _matched_lineups(t: Tables):
    raw = L.enrich_with_schedule(t.sql(_LM_RAW), t.sql(_LM_SCHED))
    known = t.sql(
        "SELECT season, match_date, concat('Club ', CAST(home AS STRING)) AS home, concat('Club ', CAST(away AS STRING)) AS away "
        "FROM @matches WHERE match_id % 4 <> 0"
    )
    return L.normalize_lineups_with_matches(raw, known, "rank_id")


@query(
    "S18_lineup_match_counts",
    "raw_rows:i matched_team_rows:i unmatched_team_rows:i",
    """WITH e AS (SELECT match_date, home, away FROM @matches WHERE match_id % 4 <> 0), k AS (SELECT match_date, home AS team, away AS opp FROM e UNION SELECT match_date, away, home FROM e),
    x AS (SELECT a.match_date, a.team, CASE WHEN a.team = m.home THEN m.away ELSE m.home END AS opp FROM @appearances a JOIN @matches m USING (match_id)),
    c AS (SELECT count(*) AS raw_rows, count(k.team) AS matched FROM x LEFT JOIN k ON k.match_date = x.match_date AND k.team = x.team AND k.opp = x.opp)
    SELECT raw_rows, matched AS matched_team_rows, raw_rows - matched AS unmatched_team_rows FROM c""",
)
def s18_counts(t: Tables):
    return _matched_lineups(t)["stats"]


# --- tactics, pages, refresh, logs ----------------------------------------


@query(
    "S19_team_stats_to_tactics",
    "match_id:s team:s is_home:i source_collected_at:s shots:d1 attacking_pressure_score:d1 progression_score:d1 directness_score:d1",
    """WITH l AS (SELECT lower(concat(CAST(season AS VARCHAR), '_', strftime(match_date, '%Y%m%d'), '_', CAST(CASE WHEN is_home = 1 THEN team ELSE opponent END AS VARCHAR),
      '_', CAST(CASE WHEN is_home = 1 THEN opponent ELSE team END AS VARCHAR))) AS match_id, team, is_home, match_date + 1 AS source_collected_at, sf AS shots,
      sf + 2.0 * sotf AS attacking_pressure_score, NULL AS progression_score, NULL AS directness_score, sotf FROM @t)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, team ORDER BY shots NULLS LAST, sotf NULLS LAST, is_home) AS rn FROM l) AS x WHERE rn = 1""",
)
def s19(t: Tables):
    m = t.matches.withColumns({"home": F.col("home").cast("string"), "away": F.col("away").cast("string")})
    return R.team_stats_to_tactics(m)


_PAGE = """SELECT page_id, concat(html, '<div class="scorebox"><div><strong>Manager</strong>: <b>Anna &amp; Co</b> ', CAST(page_id AS STRING),
  '</div><div><strong>Manager</strong>: J. Doe</div><div class="scorebox_meta"></div></div><div><strong>Manager</strong>: later</div>') AS html FROM pages"""


@query(
    "S20_extract_managers",
    "page_id:i position:i value:s",
    """SELECT page_id, 0 AS position, concat('Anna & Co ', CAST(page_id AS VARCHAR)) AS value FROM pages
    UNION ALL SELECT page_id, 1, 'J. Doe' FROM pages""",
)
def s20(t: Tables):
    return R.extract_managers(t.sql(_PAGE))


_ANCHOR = '<a href="[^"]*">([^<]*)</a>'


@query(
    "S20_extract_links",
    "page_id:i position:i value:s",
    f"""SELECT page_id, unnest(generate_series(0, CAST(len(v) AS BIGINT) - 1)) AS position,
      unnest(list_transform(v, lambda x: trim(replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
        '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), chr(160), ' ')))) AS value
    FROM (SELECT page_id, regexp_extract_all(html, '{_ANCHOR}', 1) AS v FROM pages) AS p""",
)
def s20_links(t: Tables):
    return R.extract_all(t.pages.select("page_id", "html"), "html", _ANCHOR)


# The payload with its quotes escaped in three ways and some underscores escaped; # stands for a backslash.
_INFO = """SELECT match_id, concat('<script>var match_info = JSON.parse(', chr(39), replace(replace(concat('{"h_shot":"', CAST(coalesce(hs, 0) AS STRING),
  '","a_shot":"', CAST(coalesce(as_, 0) AS STRING), '"}'), '"', CASE CAST(match_id % 3 AS INT) WHEN 0 THEN '#x22' WHEN 1 THEN '#"' ELSE '#u0022' END),
  '_', CASE WHEN match_id % 2 = 0 THEN '#x5F' ELSE '_' END), chr(39), ');</script>') AS html FROM @matches"""


@query(
    "S20_extract_match_info",
    "match_id:i hs:d1 as_:d1 hst:d1",
    "SELECT match_id, coalesce(hs, 0) AS hs, coalesce(as_, 0) AS as_, NULL AS hst FROM @matches",
)
def s20_info(t: Tables):
    pages = t.sql(_INFO)
    return R.extract_match_info(pages.withColumn("html", F.replace("html", F.lit("#"), F.lit("\\"))))


@query(
    "S21_merge_new_results",
    "match_date:s home:i away:i hg:i ag:i result:s",
    """WITH u AS (SELECT DISTINCT match_date, home, away FROM @matches WHERE match_id % 3 <> 0),
    i AS (SELECT *, row_number() OVER (PARTITION BY match_date, home, away ORDER BY hg, ag) AS rn FROM @matches WHERE match_id % 3 <> 1 AND match_id % 10 <> 0)
    SELECT match_date, home, away, hg, ag, result FROM @matches WHERE match_id % 3 <> 0
    UNION ALL SELECT match_date, home, away, hg, ag, result FROM i ANTI JOIN u USING (match_date, home, away) WHERE rn = 1""",
)
def s21(t: Tables):
    cols = ["match_date", "home", "away", "hg", "ag", "result"]
    base = t.matches.where("match_id % 3 <> 0").select(*cols)
    hidden = F.col("match_id") % 10 == 0
    incoming = t.matches.where("match_id % 3 <> 1").select(
        "match_date", "home", "away", F.when(~hidden, F.col("hg")).alias("hg"), F.when(~hidden, F.col("ag")).alias("ag")
    )
    return R.merge_new_results(base, incoming)


_SHOTS = ["hs", "as_", "hst", "ast"]
_GAP = " OR ".join(f"{c} IS NULL" for c in _SHOTS)


@query(
    "S22_backfill_nulls",
    "match_id:i still_missing:i " + " ".join(f"{c}:d1" for c in _SHOTS),
    f"""SELECT match_id, CASE WHEN ({_GAP}) AND match_id % 4 = 0 THEN 1 ELSE 0 END AS still_missing,
    {", ".join(f"CASE WHEN ({_GAP}) AND match_id % 4 <> 0 THEN {i + 20} ELSE {c} END AS {c}" for i, c in enumerate(_SHOTS))} FROM @matches""",
)
def s22(t: Tables):
    base = t.matches.select("match_id", *[F.col(c).cast("double").alias(c) for c in _SHOTS])
    src = base.where("match_id % 4 <> 0").select("match_id", *[F.lit(float(i + 20)).alias(c) for i, c in enumerate(_SHOTS)])
    return R.backfill_nulls(base, src, _SHOTS, ["match_id"])


@query(
    "S23_forecast_snapshot",
    "match_id:i snapshot_time_utc:s model_version:s favorite:s favorite_probability:d8",
    """SELECT match_id, '2001-09-01T00:00:00' AS snapshot_time_utc, 'v1' AS model_version, CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 'H'
      WHEN p_draw >= p_away THEN 'D' ELSE 'A' END AS favorite, greatest(p_home, p_draw, p_away) AS favorite_probability FROM @probs""",
)
def s23(t: Tables):
    return sinks.forecast_snapshot(t.probs, F.lit("2001-09-01T00:00:00"), "v1")


@query(
    "S24_experiment_records",
    "experiment:s logged_at:s field:s value:s",
    """WITH g AS (SELECT season, count(*) AS n, max(hg) AS top FROM @matches GROUP BY season)
    SELECT concat('goals-', CAST(season AS VARCHAR)) AS experiment, '2001-09-01' AS logged_at, f.field, f.value FROM g,
      LATERAL (VALUES ('season', CAST(season AS VARCHAR)), ('n', CAST(n AS VARCHAR)), ('top', CAST(top AS VARCHAR))) AS f(field, value)""",
)
def s24(t: Tables):
    per = t.matches.groupBy("season").agg(F.count("*").alias("n"), F.max("hg").alias("top"))
    return sinks.experiment_records(per, F.concat(F.lit("goals-"), F.col("season").cast("string")), F.lit("2001-09-01"))


@query(
    "S25_write_table_rows",
    "season:i pool:i matches:i goals:i",
    "SELECT season, pool, count(*) AS matches, sum(hg + ag) AS goals FROM @matches GROUP BY season, pool",
)
def s25(t: Tables):
    """A summary written as a partitioned table to the shared folder, and read back."""
    folder = _scratch(t, "summary")
    summary = t.matches.groupBy("season", "pool").agg(F.count("*").alias("matches"), F.sum(F.col("hg") + F.col("ag")).alias("goals"))
    sinks.write_table(summary, folder, partition_by=("season",))
    return t.spark.read.parquet(folder)
