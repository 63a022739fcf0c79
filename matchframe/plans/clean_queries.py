"""Cleaning and label functions (C1-C25) over texts derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchframe.functions import clean as C
from matchframe.plans.registry import query
from matchframe.plans.tables import Tables


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case_map(column: str, table: dict, default: str) -> str:
    whens = " ".join(
        f"WHEN {quoted(k)} THEN {quoted(v) if isinstance(v, str) else v}" for k, v in table.items()
    )
    return f"CASE {column} {whens} ELSE {default} END"


@query(
    "C1_map_entity",
    "k:i plain:s stripped:s",
    f"""SELECT k, {case_map("trim(name)", C.TEAM_ALIASES, "trim(name)")} AS plain,
    {case_map("trim(name)", C.TEAM_ALIASES, "regexp_replace(trim(name), ' FC$', '')")} AS stripped FROM @names""",
)
def c1(t: Tables):
    return t.names.select("k", C.map_entity("name").alias("plain"), C.map_entity("name", strip_suffix=" FC").alias("stripped"))


@query(
    "C2_first_alias",
    "k:i team:s pos:s none:s",
    "SELECT k, name AS team, segment AS pos, CAST(NULL AS VARCHAR) AS none FROM @names",
)
def c2(t: Tables):
    raw = t.names.select("k", F.col("name").alias("Squad "), F.col("segment").alias("player Pos"))
    return raw.select(
        "k",
        C.first_alias(raw, ["team", "squad"]).alias("team"),
        C.first_alias(raw, ["pos"], suffix_match=True).alias("pos"),
        C.first_alias(raw, ["manager"]).alias("none"),
    )


@query("C3_parse_mixed_date", "k:i d:s", "SELECT k, CASE WHEN txt = 'to be confirmed' THEN NULL ELSE d END AS d FROM @date_texts")
def c3(t: Tables):
    return t.date_texts.select("k", C.parse_mixed_date("txt").alias("d"))


_MONEY = """SELECT c_custkey AS k, c_acctbal AS v, CASE c_custkey % 5
  WHEN 0 THEN concat('€', CAST(CAST(floor(abs(c_acctbal)) AS INT) AS STRING), ',000') WHEN 1 THEN concat(CAST(c_custkey % 90 AS STRING), '.5m')
  WHEN 2 THEN concat('€', CAST(c_custkey % 900 AS STRING), 'K') WHEN 3 THEN '-' ELSE CAST(c_custkey AS STRING) END AS txt FROM customer"""


@query(
    "C4_parse_money",
    "k:i eur:d2",
    f"""SELECT k, CASE k % 5 WHEN 0 THEN CAST(floor(abs(v)) AS INT) * 1000.0 WHEN 1 THEN (k % 90 + 0.5) * 1000000
      WHEN 2 THEN (k % 900) * 1000.0 WHEN 3 THEN 0 ELSE k END AS eur FROM ({_MONEY}) AS m""",
)
def c4(t: Tables):
    return t.sql(_MONEY).select("k", C.parse_money("txt").alias("eur"))


_REASON = """SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN concat('Red Card, ', o_orderpriority)
  WHEN 1 THEN 'Suspended for one match' WHEN 2 THEN concat('Knee injury. Return expected on ', {d}) WHEN 3 THEN NULL
  ELSE concat('BANNED ', o_orderstatus) END AS reason FROM orders"""


def _reason() -> str:
    from matchframe.plans.tables import date_text

    return _REASON.replace("{d}", date_text("o_orderdate", "slash"))


@query(
    "C5_status_from_reason",
    "k:i status:s",
    "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 IN (0, 1, 4) THEN 'suspension' ELSE 'injury' END AS status FROM orders",
)
def c5(t: Tables):
    return t.sql(_reason()).select("k", C.status_from_reason("reason").alias("status"))


@query(
    "C6_extract_return_date",
    "k:i back:s",
    "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 2 THEN CAST(o_orderdate AS DATE) END AS back FROM orders",
)
def c6(t: Tables):
    return t.sql(_reason()).select("k", C.extract_return_date("reason").alias("back"))


@query(
    "C7_slug_match_id",
    "k:i slug:s",
    """SELECT m.match_id AS k, lower(replace(replace(concat(CAST(season AS VARCHAR), '_', strftime(match_date, '%Y%m%d'), '_',
      a.name, '_', b.name), ' ', '_'), '''', '')) AS slug
    FROM @matches m JOIN @names a ON a.k = m.match_id % 50 JOIN @names b ON b.k = m.match_id % 37""",
)
def c7(t: Tables):
    names = t.names.select("k", "name")
    a, b = names.toDF("ka", "na"), names.toDF("kb", "nb")
    m = t.matches.withColumns({"ka": F.col("match_id") % 50, "kb": F.col("match_id") % 37})
    j = m.join(a, "ka").join(b, "kb")
    return j.select(
        F.col("match_id").alias("k"),
        C.slug_match_id(F.col("season"), F.col("match_date"), F.col("na"), F.col("nb")).alias("slug"),
    )


_POS = """SELECT l_orderkey * 10 + l_linenumber AS k, CASE CAST((l_linenumber + l_partkey) % 14 AS INT) WHEN 0 THEN 'GK' WHEN 1 THEN 'xx/cb'
  WHEN 2 THEN 'AM,LW' WHEN 3 THEN 'st' WHEN 4 THEN 'coach' WHEN 5 THEN 'DM LB' WHEN 7 THEN 'D' WHEN 8 THEN 'def' WHEN 9 THEN 'M'
  WHEN 10 THEN 'Mid' WHEN 11 THEN 'w' WHEN 12 THEN 'F' WHEN 13 THEN 'DD' ELSE NULL END AS pos FROM lineitem"""


@query(
    "C8_position_group",
    "k:i line:s",
    """SELECT l_orderkey * 10 + l_linenumber AS k, CASE CAST((l_linenumber + l_partkey) % 14 AS INT) WHEN 0 THEN 'goalkeeper' WHEN 1 THEN 'defender'
      WHEN 2 THEN 'midfielder' WHEN 3 THEN 'attacker' WHEN 5 THEN 'midfielder' WHEN 7 THEN 'defender' WHEN 8 THEN 'defender'
      WHEN 9 THEN 'midfielder' WHEN 10 THEN 'midfielder' WHEN 11 THEN 'attacker' WHEN 12 THEN 'attacker' ELSE 'unknown' END AS line FROM lineitem""",
)
def c8(t: Tables):
    return t.sql(_POS).select("k", C.position_group("pos").alias("line"))


_FLAG = """SELECT l_orderkey * 10 + l_linenumber AS k, CASE l_linenumber % 7 WHEN 0 THEN '1' WHEN 1 THEN ' True ' WHEN 2 THEN 'starting'
  WHEN 3 THEN '0' WHEN 4 THEN 'bench' WHEN 5 THEN 'Y' ELSE NULL END AS f, CASE WHEN l_linenumber % 3 = 0 THEN 'n/a'
  ELSE CAST(l_quantity AS STRING) END AS n FROM lineitem"""


@query(
    "C9_to_flag",
    "k:i flag:d1",
    "SELECT l_orderkey * 10 + l_linenumber AS k, CASE WHEN l_linenumber % 7 IN (0, 1, 2, 5) THEN 1 ELSE 0 END AS flag FROM lineitem",
)
def c9(t: Tables):
    return t.sql(_FLAG).select("k", C.to_flag("f").alias("flag"))


@query(
    "C10_to_number",
    "k:i n:d2",
    "SELECT l_orderkey * 10 + l_linenumber AS k, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_quantity END AS n FROM lineitem",
)
def c10(t: Tables):
    return t.sql(_FLAG).select("k", C.to_number("n").alias("n"))


@query(
    "C11_season_code",
    "season:i code:s back:i n:i",
    """SELECT season, concat(lpad(CAST(season % 100 AS VARCHAR), 2, '0'), lpad(CAST((season + 1) % 100 AS VARCHAR), 2, '0')) AS code,
      2000 + season % 100 AS back, count(*) AS n FROM @matches GROUP BY season""",
)
def c11(t: Tables):
    per = t.matches.groupBy("season").agg(F.count("*").alias("n"))
    code = C.season_code("season")
    return per.select("season", code.alias("code"), C.season_year(code).alias("back"), "n")


@query(
    "C12_join_text",
    "k:i txt:s",
    """SELECT k, concat_ws(' ', nullif(trim(segment), ''), nullif(trim(name), ''), CASE WHEN k % 2 = 0 THEN NULL ELSE 'x' END) AS txt FROM @names""",
)
def c12(t: Tables):
    return t.names.select("k", C.join_text("segment", "name", F.when(F.col("k") % 2 == 0, "  ").otherwise(" x ")).alias("txt"))


@query(
    "C13_competition_weight",
    "row_id:i weight:d2",
    f"SELECT row_id, {case_map('competition', C.COMPETITION_WEIGHTS, '0.5')} AS weight FROM @nonleague",
)
def c13(t: Tables):
    return t.nonleague.select("row_id", C.competition_weight("competition").alias("weight"))


@query(
    "C14_competition_class",
    "competition:s preseason:i europe:i competitive:i n:i",
    """SELECT competition, CASE WHEN competition = 'Friendly' THEN 1 ELSE 0 END AS preseason,
      CASE WHEN competition = 'Champions League' THEN 1 ELSE 0 END AS europe,
      CASE WHEN competition = 'Friendly' THEN 0 ELSE 1 END AS competitive, count(*) AS n FROM @nonleague GROUP BY ALL""",
)
def c14(t: Tables):
    flags = {"preseason": C.is_preseason, "europe": C.is_europe, "competitive": C.is_competitive}
    return t.nonleague.groupBy(
        "competition", *[f("competition").cast("int").alias(k) for k, f in flags.items()]
    ).agg(F.count("*").alias("n"))


@query(
    "C15_points",
    "match_id:i is_home:i points:i by_result:i",
    """SELECT match_id, is_home, points, CASE WHEN result = 'D' THEN 1 WHEN result = CASE is_home WHEN 1 THEN 'H' ELSE 'A' END
      THEN 3 ELSE 0 END AS by_result FROM @t""",
)
def c15(t: Tables):
    return t.long.select(
        "match_id", "is_home", "points", C.points_from_result(F.col("result"), F.col("is_home") == 1).alias("by_result")
    )


@query(
    "C16_outcome_label",
    "match_id:i label:i result:s",
    "SELECT match_id, CASE result WHEN 'H' THEN 0 WHEN 'D' THEN 1 ELSE 2 END AS label, result FROM @matches",
)
def c16(t: Tables):
    m = t.matches.select("match_id", C.outcome_label("result").alias("label"))
    return m.withColumn("result", C.outcome_result("label"))


@query(
    "C17_bucketize",
    "k:i gap:i tenure:i meetings:d2 conf:s stable:s warn:s quality:s",
    """WITH v AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) % 900 - 450 AS d, CAST(floor(o_totalprice) AS BIGINT) % 500 AS days,
      o_orderkey % 9 AS n, CAST(CAST(floor(o_totalprice) AS BIGINT) % 100 AS DOUBLE) / 100 AS p FROM orders)
    SELECT k, CASE WHEN abs(d) < 50 THEN 0 ELSE CASE WHEN abs(d) < 100 THEN 1 WHEN abs(d) < 200 THEN 2 ELSE 3 END * CASE WHEN d > 0 THEN 1 ELSE -1 END END AS gap,
      CASE WHEN days <= 0 THEN 0 WHEN days <= 30 THEN 1 WHEN days <= 90 THEN 2 WHEN days <= 365 THEN 3 ELSE 4 END AS tenure,
      CASE WHEN n <= 0 THEN 0 WHEN n <= 2 THEN 0.25 WHEN n <= 5 THEN 0.6 ELSE 1 END AS meetings,
      CASE WHEN p >= 0.62 THEN 'high_confidence' WHEN p >= 0.48 THEN 'medium_confidence' ELSE 'low_confidence' END AS conf,
      CASE WHEN p >= 0.75 THEN 'High confidence' WHEN p >= 0.5 THEN 'Medium confidence' ELSE 'Low confidence' END AS stable,
      CASE WHEN n >= 2 THEN 'Low' WHEN p >= 0.62 AND n = 0 THEN 'High' WHEN p >= 0.48 THEN 'Medium' ELSE 'Low' END AS warn,
      CASE WHEN n = 0 THEN 'Good' WHEN n <= 2 THEN 'Warning' ELSE 'Poor' END AS quality FROM v""",
)
def c17(t: Tables):
    v = t.sql(
        "SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) % 900 - 450 AS d, CAST(floor(o_totalprice) AS BIGINT) % 500 AS days, "
        "o_orderkey % 9 AS n, CAST(CAST(floor(o_totalprice) AS BIGINT) % 100 AS DOUBLE) / 100 AS p FROM orders"
    )
    p, n = F.col("p"), F.col("n")
    return v.select(
        "k", C.elo_gap_bucket(F.col("d")).alias("gap"), C.tenure_bucket(F.col("days")).alias("tenure"),
        C.meeting_strength(n).alias("meetings"), C.confidence_bucket(p).alias("conf"), C.stability_label(p).alias("stable"),
        C.forecast_confidence(p, n).alias("warn"), C.quality_label(n).alias("quality"),
    )


@query(
    "C18_safe_divide",
    "match_id:i ratio:d9",
    "SELECT match_id, CASE WHEN hs > 0 THEN coalesce(CAST(hst AS DOUBLE) / hs, 0) ELSE 0 END AS ratio FROM @matches",
)
def c18(t: Tables):
    return t.matches.select("match_id", C.safe_divide(F.col("hst"), F.col("hs")).alias("ratio"))


@query(
    "C19_similarity",
    "match_id:i gap:d9 low:d9",
    "SELECT match_id, 1 / (1 + abs(hxg - axg) / 0.75) AS gap, 1 / (1 + (hxg + axg) / 2.5) AS low FROM @matches",
)
def c19(t: Tables):
    a, b = F.col("hxg"), F.col("axg")
    return t.matches.select("match_id", C.similarity_gap(a, b, 0.75).alias("gap"), C.low_total_profile(a + b, 2.5).alias("low"))


@query(
    "C20_fixture_congestion",
    "match_id:i score:d3",
    "SELECT match_id, greatest(0, 7 - hs) + 1.5 * hg + 0.5 * ag AS score FROM @matches",
)
def c20(t: Tables):
    return t.matches.select("match_id", C.fixture_congestion(F.col("hs").cast("double"), F.col("hg"), F.col("ag")).alias("score"))


# Column names built from the data: every bookmaker code crossed with the keys of a table.
_BOOKS = list(C.BOOKMAKERS)
_PRICE_NAMES = (
    "SELECT c_custkey AS k, concat(CASE CAST(c_custkey % {n} AS INT) {books} ELSE 'ZZ' END, "
    "CASE CAST(floor(c_custkey / 3) AS BIGINT) % 7 WHEN 0 THEN 'H' WHEN 1 THEN 'D' WHEN 2 THEN 'A' WHEN 3 THEN 'CH' "
    "WHEN 4 THEN 'CD' WHEN 5 THEN 'CA' ELSE '>2.5' END) AS name FROM customer"
).format(n=len(_BOOKS) + 1, books=" ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(_BOOKS)))
_KNOWN = "|".join(sorted(_BOOKS, key=len, reverse=True))


@query(
    "C21_classify_price_column",
    "k:i is_match_price:i prefix:s source:s outcome:s odds_type:s timing:s usage:s",
    f"""WITH p AS (SELECT k, name, regexp_matches(name, '^({_KNOWN})(CH|CD|CA|H|D|A)$') AS known FROM ({_PRICE_NAMES}) AS n),
    s AS (SELECT k, name, CASE WHEN known THEN regexp_extract(name, '^({_KNOWN})(CH|CD|CA|H|D|A)$', 1)
        WHEN regexp_matches(name, '(CH|CD|CA|H|D|A)$') THEN regexp_extract(name, '^(.*?)(CH|CD|CA|H|D|A)$', 1) ELSE name END AS prefix,
      CASE WHEN known THEN regexp_extract(name, '^({_KNOWN})(CH|CD|CA|H|D|A)$', 2)
        ELSE regexp_extract(name, '^(.*?)(CH|CD|CA|H|D|A)$', 2) END AS suffix FROM p)
    SELECT k, CASE WHEN name LIKE '%2.5%' THEN 0 WHEN regexp_matches(name, '(H|D|A)$') THEN 1 ELSE 0 END AS is_match_price, prefix,
      {case_map("prefix", C.BOOKMAKERS, "prefix")} AS source,
      CASE WHEN suffix IN ('H', 'CH') THEN 'home' WHEN suffix IN ('D', 'CD') THEN 'draw' WHEN suffix IN ('A', 'CA') THEN 'away' ELSE 'unknown' END AS outcome,
      concat(CASE prefix WHEN 'Avg' THEN 'average' WHEN 'Max' THEN 'maximum' ELSE 'single-bookmaker' END,
        CASE WHEN length(suffix) = 2 THEN ' closing' ELSE ' pre-closing' END) AS odds_type,
      CASE WHEN length(suffix) = 2 THEN 'BENCHMARK_ONLY' ELSE 'PREMATCH_CONDITIONAL' END AS timing,
      CASE WHEN length(suffix) = 2 THEN 'Benchmark only' ELSE 'Production candidate only with matching live pre-closing feed' END AS usage
    FROM s""",
)
def c21(t: Tables):
    got = C.classify_price_column("name")
    got["is_match_price"] = got["is_match_price"].cast("int")
    return t.sql(_PRICE_NAMES).select("k", *[c.alias(n) for n, c in got.items()])


@query(
    "C22_zscore",
    "match_id:i z:d8",
    """SELECT match_id, CASE WHEN stddev_pop(hxg) OVER w > 0 THEN (hxg - avg(hxg) OVER w) / stddev_pop(hxg) OVER w ELSE 0 END AS z
    FROM @matches WINDOW w AS (PARTITION BY pool, season)""",
)
def c22(t: Tables):
    from matchframe.operators.strength import zscore

    return zscore(t.matches.select("match_id", "pool", "season", "hxg"), ["pool", "season"], "hxg", "z")


# Feature names: plain ones, and the same behind a part name.
_SUFFIXES = """
elo_trend shots_avg xg_avg days_rest points_last_5 home_advantage europe_load missing_minutes points_weighted_linear
xg_weighted_halflife3 availability_score other home_xg_avg away_xga_avg home_xg_diff home_xg_attack_rating_last5
away_xg_defense_rating attack_defense_matchup_score poisson_draw_prob expected_goal_diff_model opponent_shot_rate shot_accuracy
xga_per_shot style_cluster_2 press_vs_build PPDA through_balls shared_starts manager_tenure manager_change_flag caretaker_ppg
production_manager_ppg same_xi last_win_lineup h2h_draws h2h_last_3_goal_diff h2h_home_venue_xg_diff attacking_pressure_gap
home_team_points_last_5 congestion_index squad_consistency x_exponential halflife5_halflife5
""".split()
_NAMES = f"""SELECT CASE WHEN p_size % 2 = 0 THEN s ELSE concat(lower(p_name), '_', s) END AS name FROM (
  SELECT p_name, p_size, CASE CAST(p_partkey % {len(_SUFFIXES)} AS INT) {" ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_SUFFIXES))} END AS s
  FROM part) AS x"""


def _any(*tokens: str) -> str:
    return "(" + " OR ".join(f"contains(name, '{t}')" for t in tokens) + ")"


def _whole(*names: str) -> str:
    return "name IN (" + ", ".join(f"'{n}'" for n in names) + ")"


def _cases(*pairs: str) -> str:
    whens = " ".join(f"WHEN {t} THEN '{g}'" for t, g in zip(pairs[:-1:2], pairs[1:-1:2], strict=True))
    return f"CASE {whens} ELSE '{pairs[-1]}' END"


_TIRED = _any("days", "midweek", "matches_last")
_RESTED = _any("days_rest", "midweek", "matches_last", "congestion")
_RATINGS = "regexp_full_match(name, '(home|away)_xg_(attack|defense)_rating(_last5|_last10|_season)?') OR " + _whole(
    "home_attack_vs_away_defense", "away_attack_vs_home_defense", "attack_defense_matchup_score"
)
_RAW = "regexp_full_match(name, '(home|away)_(team_points_last_5|goals_scored_avg|xg_avg|xga_avg|xg_diff|shots(_on_target)?_avg_(last5|last10|season))')"
_COACH = _any("manager_", "caretaker")
_ADJUSTED_XG = (
    _whole("poisson_home_win_prob", "poisson_draw_prob", "poisson_away_win_prob"), "poisson",
    _whole("expected_home_goals_model", "expected_away_goals_model", "expected_goal_diff_model"), "expected_goals",
    _RATINGS, "opponent_adjusted_xg", _any("xg"), "raw_xg", _any("elo"), "elo", _any("shot"), "shot_volume", _TIRED, "fatigue", "form_home_advantage",
)
_TAXONOMIES = {
    "projection": _cases(
        _any("elo"), "Elo", _any("shots"), "Shot volume", _any("xg"), "xG/xGA", _TIRED, "Schedule/fatigue", _any("points", "goals"), "Recent form",
        "name = 'home_advantage'", "Home advantage", "Other",
    ),
    "experiment": _cases(
        _any("europe"), "europe", _any("xg"), "xG", _RESTED, "fatigue", _any("injured", "missing"), "injury",
        _any("availability", "lineup_strength", "severity"), "availability", "form",
    ),
    "recency": _cases(
        _any("_linear"), "weighted_linear", _any("_exponential"), "weighted_exponential", _any("_halflife3"), "weighted_halflife3",
        _any("_halflife5"), "weighted_halflife5", _RAW, "raw_rolling", _any("elo"), "elo", _TIRED, "fatigue", "other_production",
    ),
    "opponent_xg": _cases(*_ADJUSTED_XG),
    "xg_replacement": _cases(
        "regexp_full_match(name, '(home|away)_xg_avg')", "raw_xg", "regexp_full_match(name, '(home|away)_xga_avg')", "raw_xga",
        "regexp_full_match(name, '(home|away)_xg_diff')", "xg_differential", f"({_RATINGS}) AND contains(name, 'attack')", "attack_ratings",
        _RATINGS, "defense_ratings", *_ADJUSTED_XG,
    ),
    "shot_efficiency": _cases(
        _any("shots_allowed", "opponent_shot", "xga_per_shot"), "defensive_shot_prevention",
        _any("shot_accuracy", "goals_per_shot", "xg_per_shot", "goals_minus_xg"), "shot_efficiency",
        _any("shots_avg", "shots_on_target_avg"), "shot_volume", "production",
    ),
    "tactical": _cases(
        _any("style_cluster", "style_history", "embedding"), "style_embedding",
        _any("press_vs", "possession_vs", "high_line_vs", "crossing_vs", "style_distance"), "matchup",
        "regexp_matches(name, 'possession|progressive_passes|PPDA|press|crosses|through_balls|counter_attacks|blocks|interceptions|tackles|directness|verticality|high_line')",
        "tactical_profile", _any("xg"), "xG", _any("lineup", "shared_", "manager_"), "lineup_stability",
        _any("days_rest", "congestion", "midweek"), "fatigue", "baseline",
    ),
    "lineup": _cases(
        _any("shared_", "familiarity"), "familiarity", _any("manager_", "rotation", "squad_consistency"), "stability", _any("last_win"), "last_win",
        _any("lineup", "starting_xi", "same_"), "continuity", _any("xg"), "xG", _RESTED, "fatigue",
        _any("injured", "missing", "availability"), "availability", "baseline",
    ),
    "lineup_engine": _cases(
        _any("shared_", "familiarity"), "familiarity", _any("manager_", "rotation", "squad_consistency"), "stability",
        _any("lineup", "starting_xi", "same_"), "continuity", "production",
    ),
    "head_to_head": _cases(
        "regexp_full_match(name, 'h2h_(matches_count|home_wins|draws|away_wins|points_(home|away)_team|data_strength_score)')", "h2h_core",
        "regexp_full_match(name, 'h2h_(last_3_points_home|last_5_points_home_team|last_[35]_(goal|xg)_diff)')", "h2h_recent",
        "regexp_full_match(name, 'h2h_home_venue_(points|goal_diff|xg_diff)')", "h2h_venue", _any("attacking_pressure"), "tactical_pressure",
        _any("xg"), "xG", _any("days_rest", "matches_last", "midweek"), "fatigue", "baseline",
    ),
    "manager": _cases(
        _any("production"), "production", f"{_COACH} AND {_any('ppg', 'xg_diff', 'elo_change', 'form_since')}", "manager_performance",
        f"{_COACH} AND {_any('tenure', 'matches_in_charge', 'experience', 'continuity')}", "manager_continuity", _COACH, "manager_change", "production",
    ),
}


@query(
    "C23_feature_group",
    "name:s " + " ".join(f"{k}:s" for k in _TAXONOMIES) + " n:i",
    f"SELECT name, {', '.join(f'{v} AS {k}' for k, v in _TAXONOMIES.items())}, count(*) AS n FROM ({_NAMES}) AS f GROUP BY ALL",
)
def c23(t: Tables):
    groups = [C.feature_group("name", rules).alias(k) for k, rules in C.FEATURE_GROUPS.items()]
    return t.sql(_NAMES).groupBy("name", *groups).agg(F.count("*").alias("n"))


@query(
    "C24_format_text",
    "match_id:i change:s pct:s label:s",
    """SELECT match_id, CASE WHEN hs IS NULL THEN '' WHEN hg - ag > 0 THEN concat('+', CAST(hg - ag AS VARCHAR)) ELSE CAST(hg - ag AS VARCHAR) END AS change,
      concat(printf('%.1f', round(hxg * 100, 1)), '%') AS pct,
      concat('MW', CAST(season AS VARCHAR), ': ', CAST(home AS VARCHAR), ' v ', CAST(away AS VARCHAR), ' — ', CAST(match_date AS VARCHAR), ' 16:00 DK') AS label FROM @matches""",
)
def c24(t: Tables):
    diff = F.when(F.col("hs").isNull(), F.lit(None)).otherwise(F.col("hg") - F.col("ag")).cast("double")
    return t.matches.select(
        "match_id", C.format_change(diff).alias("change"), C.percent_text(F.col("hxg")).alias("pct"),
        C.fixture_label(F.col("season"), F.col("home").cast("string"), F.col("away").cast("string"), F.col("match_date"), F.lit("16:00")).alias("label"),
    )


@query(
    "C25_predicates",
    "match_id:i season:i hxg:d2",
    """SELECT match_id, season, hxg FROM @matches WHERE season BETWEEN 1996 AND 1999 AND result IN ('H', 'D') AND hst IS NOT NULL
      AND hxg >= 0.5 AND match_date < DATE '1999-07-01'""",
)
def c25(t: Tables):
    return t.matches.where(
        F.col("season").between(1996, 1999) & F.col("result").isin("H", "D") & F.col("hst").isNotNull()
        & (F.col("hxg") >= 0.5) & (F.col("match_date") < F.lit("1999-07-01").cast("date"))
    ).select("match_id", "season", "hxg")
