"""Column functions for names, dates, flags, buckets and labels."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Club names as result files spell them, by provider spelling.
TEAM_ALIASES = {
    "AFC Bournemouth": "Bournemouth",
    "Brighton & Hove Albion": "Brighton",
    "Brighton and Hove Albion": "Brighton",
    "Coventry City": "Coventry",
    "Hull City": "Hull",
    "Ipswich Town": "Ipswich",
    "Leeds United": "Leeds",
    "Leicester City": "Leicester",
    "Manchester City": "Man City",
    "Manchester United": "Man United",
    "Manchester Utd": "Man United",
    "Newcastle United": "Newcastle",
    "Newcastle Utd": "Newcastle",
    "Nott'ham Forest": "Nott'm Forest",
    "Nottingham Forest": "Nott'm Forest",
    "Tottenham Hotspur": "Tottenham",
    "West Ham United": "West Ham",
    "Wolverhampton Wanderers": "Wolves",
}

# The line of each position code.
POSITION_CODES = {
    "GK": "goalkeeper",
    "G": "goalkeeper",
    "D": "defender",
    "DF": "defender",
    "DEF": "defender",
    "CB": "defender",
    "LB": "defender",
    "RB": "defender",
    "WB": "defender",
    "LWB": "defender",
    "RWB": "defender",
    "M": "midfielder",
    "MF": "midfielder",
    "MID": "midfielder",
    "CM": "midfielder",
    "DM": "midfielder",
    "AM": "midfielder",
    "W": "attacker",
    "LW": "attacker",
    "RW": "attacker",
    "F": "attacker",
    "FW": "attacker",
    "ST": "attacker",
    "CF": "attacker",
}

# How much a result outside the league counts.
COMPETITION_WEIGHTS = {
    "Premier League": 1.0,
    "Championship": 0.55,
    "Championship Playoff": 0.55,
    "Champions League": 0.80,
    "Europa League": 0.75,
    "Conference League": 0.70,
    "European Qualifier": 0.70,
    "UEFA Super Cup": 0.70,
    "Community Shield": 0.45,
    "Domestic Cup": 0.45,
    "Friendly": 0.25,
    "Pre-season Friendly": 0.25,
}
DEFAULT_COMPETITION_WEIGHT = 0.50

# Bookmaker codes in price column names.
BOOKMAKERS = {
    "B365": "Bet365",
    "BFD": "Betfred",
    "BW": "Bet&Win/Bwin",
    "BMGM": "BetMGM",
    "BV": "BetVictor",
    "CL": "Coral",
    "IW": "Interwetten",
    "LB": "Ladbrokes",
    "PS": "Pinnacle",
    "WH": "William Hill",
    "VC": "VC Bet",
    "BF": "Betfair sportsbook",
    "BFE": "Betfair Exchange",
    "1XB": "1xBet",
    "Max": "Market maximum",
    "Avg": "Market average",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c: Column | str, table: Mapping[str, object], default: Column | None = None) -> Column:
    """Value of a small literal map, ``default`` (null if none) for misses."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    hit = F.create_map(*pairs)[_col(c)]
    return hit if default is None else F.coalesce(hit, default)


def map_entity(c: Column | str, aliases: Mapping[str, str] = TEAM_ALIASES, strip_suffix: str | None = None) -> Column:
    """Canonical name; unknown names pass through, optionally without a suffix."""
    name = F.trim(_col(c))
    rest = F.regexp_replace(name, f"{strip_suffix}$", "") if strip_suffix else name
    return lookup(name, aliases, rest)


def map_entity_table(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """``map_entity`` for alias tables too large for a literal map (alias, canonical)."""
    a = aliases.select(F.col("alias").alias(column), F.col("canonical").alias("_to"))
    return df.join(a, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def first_alias(df: DataFrame, names: Sequence[str], *, suffix_match: bool = False) -> Column:
    """First column of ``df`` whose name matches, ignoring case; null if none does."""

    def norm(name: str) -> str:
        return name.strip().lower().replace(" ", "_")

    have = {norm(c): c for c in df.columns}
    for name in names:
        if norm(name) in have:
            return F.col(f"`{have[norm(name)]}`")
    if suffix_match:
        for key, c in have.items():
            if any(key.endswith("_" + norm(n)) for n in names):
                return F.col(f"`{c}`")
    return F.lit(None)


def _try_date(c: Column, fmt: str) -> Column:
    return F.try_to_timestamp(c, F.lit(fmt)).cast("date")


def parse_mixed_date(c: Column | str) -> Column:
    """ISO dates as such, everything else day first; null if neither parses."""
    text = F.trim(_col(c).cast("string"))
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}")
    day_first = F.regexp_replace(F.split(text, " ")[0], "-", "/")
    long_year = day_first.rlike(r"/\d{4}$")
    return (
        F.when(iso, _try_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
        .when(long_year, _try_date(day_first, "d/M/yyyy"))
        .otherwise(_try_date(day_first, "d/M/yy"))
    )


def parse_money(c: Column | str) -> Column:
    text = F.trim(F.regexp_replace(_col(c).cast("string"), "[€,]", ""))
    number = F.regexp_extract(text, r"([0-9.]+)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, r"([mkMK])", 1))
    scale = F.when(unit == "m", 1_000_000.0).when(unit == "k", 1_000.0).otherwise(1.0)
    return F.coalesce(number, F.lit(0.0)) * scale


def status_from_reason(c: Column | str) -> Column:
    text = F.lower(F.coalesce(_col(c).cast("string"), F.lit("")))
    return F.when(text.rlike("suspend|ban|red card"), "suspension").otherwise("injury")


def extract_return_date(c: Column | str) -> Column:
    found = F.regexp_extract(F.coalesce(_col(c), F.lit("")), r"Return expected on (\d{2}/\d{2}/\d{4})", 1)
    return _try_date(found, "dd/MM/yyyy")


def slug_match_id(season: Column, day: Column, home: Column, away: Column) -> Column:
    raw = F.concat_ws("_", season.cast("string"), F.date_format(day, "yyyyMMdd"), home, away)
    return F.lower(F.regexp_replace(F.regexp_replace(raw, " ", "_"), "'", ""))


def position_group(c: Column | str) -> Column:
    """Line of the first token that is a known code, else ``unknown``."""
    tokens = F.split(F.upper(F.coalesce(_col(c), F.lit(""))), r"[,/\s]+")
    hits = F.filter(F.transform(tokens, lambda t: lookup(t, POSITION_CODES)), lambda g: g.isNotNull())
    return F.coalesce(F.get(hits, F.lit(0)), F.lit("unknown"))


def to_flag(c: Column | str) -> Column:
    text = F.lower(F.trim(_col(c).cast("string")))
    yes = text.isin("1", "1.0", "true", "yes", "y", "starter", "start", "starting")
    return F.when(yes, 1.0).otherwise(0.0)


def to_number(c: Column | str, default: float | None = 0.0) -> Column:
    number = _col(c).try_cast("double")
    return number if default is None else F.coalesce(number, F.lit(default))


def season_code(year: Column | str) -> Column:
    """2019 -> ``1920``."""
    start = _col(year).cast("int") % 100
    return F.concat(F.lpad(start.cast("string"), 2, "0"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def season_year(code: Column | str) -> Column:
    """``1920`` -> 2019."""
    return F.lit(2000) + F.substring(_col(code), 1, 2).cast("int")


def join_text(*cols: Column | str) -> Column:
    """Non-blank values, trimmed, joined by one space."""
    return F.concat_ws(" ", *[F.nullif(F.trim(_col(c).cast("string")), F.lit("")) for c in cols])


def competition_weight(c: Column | str) -> Column:
    return lookup(F.trim(_col(c)), COMPETITION_WEIGHTS, F.lit(DEFAULT_COMPETITION_WEIGHT))


def _competition_text(c: Column | str) -> Column:
    return F.lower(F.coalesce(_col(c), F.lit("")))


def is_preseason(c: Column | str) -> Column:
    return _competition_text(c).rlike("friendly|pre-season|preseason")


def is_europe(c: Column | str) -> Column:
    return _competition_text(c).rlike("champions league|europa|conference|europe")


def is_competitive(c: Column | str) -> Column:
    return ~is_preseason(c)


def points_from_goals(gf: Column, ga: Column) -> Column:
    return F.when(gf > ga, 3).when(gf == ga, 1).otherwise(0)


def points_from_result(result: Column, is_home: Column) -> Column:
    """Three, one or none; an unknown result gives none."""
    win = F.when(is_home, F.lit("H")).otherwise(F.lit("A"))
    return F.when(result == "D", 1).when(result == win, 3).otherwise(0)


def result_from_goals(hg: Column, ag: Column) -> Column:
    return F.when(hg > ag, "H").when(hg < ag, "A").when(hg == ag, "D")


def outcome_label(result: Column | str) -> Column:
    r = _col(result)
    return F.when(r == "H", 0).when(r == "D", 1).when(r == "A", 2)


def outcome_result(label: Column | str) -> Column:
    c = _col(label)
    return F.when(c == 0, "H").when(c == 1, "D").when(c == 2, "A")


def elo_gap_bucket(diff: Column) -> Column:
    size = F.abs(diff)
    level = F.when(size < 50, 0).when(size < 100, 1).when(size < 200, 2).otherwise(3)
    return F.when(diff > 0, level).otherwise(-level)


def tenure_bucket(days: Column) -> Column:
    """0 on the first day, then up to a month, three months, a year, longer."""
    return F.when(days <= 0, 0).when(days <= 30, 1).when(days <= 90, 2).when(days <= 365, 3).otherwise(4)


def meeting_strength(n: Column) -> Column:
    return F.when(n <= 0, 0.0).when(n <= 2, 0.25).when(n <= 5, 0.60).otherwise(1.0)


def confidence_bucket(p: Column) -> Column:
    return (
        F.when(p >= 0.62, "high_confidence").when(p >= 0.48, "medium_confidence").otherwise("low_confidence")
    )


def stability_label(score: Column) -> Column:
    return (
        F.when(score >= 0.75, "High confidence").when(score >= 0.5, "Medium confidence").otherwise("Low confidence")
    )


def forecast_confidence(top: Column, warnings: Column) -> Column:
    return (
        F.when(warnings >= 2, "Low")
        .when((top >= 0.62) & (warnings == 0), "High")
        .when(top >= 0.48, "Medium")
        .otherwise("Low")
    )


def quality_label(warnings: Column) -> Column:
    return F.when(warnings == 0, "Good").when(warnings <= 2, "Warning").otherwise("Poor")


def safe_divide(n: Column, d: Column) -> Column:
    return F.coalesce(F.when(d > 0, n / d), F.lit(0.0))


def similarity_gap(a: Column, b: Column, scale: float) -> Column:
    return 1.0 / (1.0 + F.abs(a - b) / scale)


def low_total_profile(total: Column, scale: float) -> Column:
    return 1.0 / (1.0 + total / scale)


def fixture_congestion(rest: Column, last14: Column, last30: Column) -> Column:
    return F.greatest(F.lit(0.0), 7.0 - rest) + 1.5 * last14 + 0.5 * last30


# Price column suffixes.
_OUTCOMES = {"H": "home", "D": "draw", "A": "away", "CH": "home", "CD": "draw", "CA": "away"}


def classify_price_column(name: Column | str) -> dict[str, Column]:
    """Source, outcome, timing and permitted use of a bookmaker price column name."""
    c = _col(name)
    books = "|".join(sorted(BOOKMAKERS, key=len, reverse=True))
    known = f"^({books})(CH|CD|CA|H|D|A)$"
    any_suffix = "^(.*?)(CH|CD|CA|H|D|A)$"
    is_known = c.rlike(known)
    prefix = F.when(is_known, F.regexp_extract(c, known, 1)).otherwise(
        F.when(c.rlike(any_suffix), F.regexp_extract(c, any_suffix, 1)).otherwise(c)
    )
    suffix = F.when(is_known, F.regexp_extract(c, known, 2)).otherwise(F.regexp_extract(c, any_suffix, 2))
    closing = F.length(suffix) == 2
    kind = F.when(prefix == "Avg", "average").when(prefix == "Max", "maximum").otherwise("single-bookmaker")
    return {
        "is_match_price": ~c.rlike(">2.5|<2.5|AHH|AHA|AHCh|AHCA|AHh") & c.rlike("(H|D|A)$"),
        "prefix": prefix,
        "source": lookup(prefix, BOOKMAKERS, prefix),
        "outcome": lookup(suffix, _OUTCOMES, F.lit("unknown")),
        "odds_type": F.concat(kind, F.when(closing, " closing").otherwise(" pre-closing")),
        "timing": F.when(closing, "BENCHMARK_ONLY").otherwise("PREMATCH_CONDITIONAL"),
        "usage": F.when(closing, "Benchmark only").otherwise(
            "Production candidate only with matching live pre-closing feed"
        ),
    }


def has(*tokens: str) -> Callable[[Column], Column]:
    """The name contains one of the tokens."""
    return lambda c: reduce(or_, [c.contains(t) for t in tokens])


def named(*names: str) -> Callable[[Column], Column]:
    """The name is one of ``names``."""
    return lambda c: c.isin(*names)


def both(*tests: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda c: reduce(and_, [t(c) for t in tests])


# Names of the opponent-adjusted columns.
ADJUSTED_RATINGS = (
    "home_xg_attack_rating",
    "away_xg_attack_rating",
    "home_xg_defense_rating",
    "away_xg_defense_rating",
    "home_attack_vs_away_defense",
    "away_attack_vs_home_defense",
    "attack_defense_matchup_score",
    "home_xg_attack_rating_last5",
    "away_xg_attack_rating_last5",
    "home_xg_defense_rating_last5",
    "away_xg_defense_rating_last5",
    "home_xg_attack_rating_last10",
    "away_xg_attack_rating_last10",
    "home_xg_defense_rating_last10",
    "away_xg_defense_rating_last10",
    "home_xg_attack_rating_season",
    "away_xg_attack_rating_season",
    "home_xg_defense_rating_season",
    "away_xg_defense_rating_season",
)
_FATIGUE = has("days", "midweek", "matches_last")
_OPPONENT_XG = (
    (named("poisson_home_win_prob", "poisson_draw_prob", "poisson_away_win_prob"), "poisson"),
    (named("expected_home_goals_model", "expected_away_goals_model", "expected_goal_diff_model"), "expected_goals"),
    (named(*ADJUSTED_RATINGS), "opponent_adjusted_xg"),
    (has("xg"), "raw_xg"),
    (has("elo"), "elo"),
    (has("shot"), "shot_volume"),
    (_FATIGUE, "fatigue"),
    (None, "form_home_advantage"),
)
_MANAGER = has("manager_", "caretaker")

# Per feature taxonomy, tests in order -> group; the last entry is the default.
FEATURE_GROUPS = {
    "projection": (
        (has("elo"), "Elo"),
        (has("shots"), "Shot volume"),
        (has("xg"), "xG/xGA"),
        (_FATIGUE, "Schedule/fatigue"),
        (has("points", "goals"), "Recent form"),
        (named("home_advantage"), "Home advantage"),
        (None, "Other"),
    ),
    "experiment": (
        (has("europe"), "europe"),
        (has("xg"), "xG"),
        (has("days_rest", "midweek", "matches_last", "congestion"), "fatigue"),
        (has("injured", "missing"), "injury"),
        (has("availability", "lineup_strength", "severity"), "availability"),
        (None, "form"),
    ),
    "recency": (
        (has("_linear"), "weighted_linear"),
        (has("_exponential"), "weighted_exponential"),
        (has("_halflife3"), "weighted_halflife3"),
        (has("_halflife5"), "weighted_halflife5"),
        (
            named(
                *[f"{side}_{c}" for c in ("team_points_last_5", "goals_scored_avg", "xg_avg", "xga_avg", "xg_diff") for side in ("home", "away")],
                *[f"{side}_{c}_avg_{w}" for c in ("shots", "shots_on_target") for w in ("last5", "last10", "season") for side in ("home", "away")],
            ),
            "raw_rolling",
        ),
        (has("elo"), "elo"),
        (_FATIGUE, "fatigue"),
        (None, "other_production"),
    ),
    "opponent_xg": _OPPONENT_XG,
    "xg_replacement": (
        (named("home_xg_avg", "away_xg_avg"), "raw_xg"),
        (named("home_xga_avg", "away_xga_avg"), "raw_xga"),
        (named("home_xg_diff", "away_xg_diff"), "xg_differential"),
        (both(named(*ADJUSTED_RATINGS), has("attack")), "attack_ratings"),
        (both(named(*ADJUSTED_RATINGS), has("defense")), "defense_ratings"),
        *_OPPONENT_XG,
    ),
    "shot_efficiency": (
        (has("shots_allowed", "opponent_shot", "xga_per_shot"), "defensive_shot_prevention"),
        (has("shot_accuracy", "goals_per_shot", "xg_per_shot", "goals_minus_xg"), "shot_efficiency"),
        (has("shots_avg", "shots_on_target_avg"), "shot_volume"),
        (None, "production"),
    ),
    "tactical": (
        (has("style_cluster", "style_history", "embedding"), "style_embedding"),
        (has("press_vs", "possession_vs", "high_line_vs", "crossing_vs", "style_distance"), "matchup"),
        (
            has(
                "possession", "progressive_passes", "PPDA", "press", "crosses", "through_balls", "counter_attacks", "blocks",
                "interceptions", "tackles", "directness", "verticality", "low_block", "high_line",
            ),
            "tactical_profile",
        ),
        (has("xg"), "xG"),
        (has("lineup", "shared_", "manager_"), "lineup_stability"),
        (has("days_rest", "congestion", "midweek"), "fatigue"),
        (None, "baseline"),
    ),
    "lineup": (
        (has("shared_", "familiarity"), "familiarity"),
        (has("manager_", "rotation", "squad_consistency"), "stability"),
        (has("last_win"), "last_win"),
        (has("lineup", "starting_xi", "same_"), "continuity"),
        (has("xg"), "xG"),
        (has("days_rest", "midweek", "matches_last", "congestion"), "fatigue"),
        (has("injured", "missing", "availability"), "availability"),
        (None, "baseline"),
    ),
    "lineup_engine": (
        (has("shared_", "familiarity"), "familiarity"),
        (has("manager_", "rotation", "squad_consistency"), "stability"),
        (has("lineup", "starting_xi", "same_"), "continuity"),
        (None, "production"),
    ),
    "head_to_head": (
        (
            named(
                "h2h_matches_count", "h2h_home_wins", "h2h_draws", "h2h_away_wins", "h2h_points_home_team", "h2h_points_away_team",
                "h2h_data_strength_score",
            ),
            "h2h_core",
        ),
        (
            named(
                "h2h_last_3_points_home", "h2h_last_5_points_home_team", "h2h_last_3_goal_diff", "h2h_last_5_goal_diff",
                "h2h_last_3_xg_diff", "h2h_last_5_xg_diff",
            ),
            "h2h_recent",
        ),
        (named("h2h_home_venue_points", "h2h_home_venue_goal_diff", "h2h_home_venue_xg_diff"), "h2h_venue"),
        (has("attacking_pressure"), "tactical_pressure"),
        (has("xg"), "xG"),
        (has("days_rest", "matches_last", "midweek"), "fatigue"),
        (None, "baseline"),
    ),
    "manager": (
        (has("production"), "production"),
        (both(_MANAGER, has("ppg", "xg_diff", "elo_change", "form_since")), "manager_performance"),
        (both(_MANAGER, has("tenure", "matches_in_charge", "experience", "continuity")), "manager_continuity"),
        (_MANAGER, "manager_change"),
        (None, "production"),
    ),
}


def feature_group(name: Column | str, rules: Sequence[tuple[Callable | None, str]] = FEATURE_GROUPS["projection"]) -> Column:
    """Label of the first rule whose test the feature name meets; the last rule has none."""
    c = _col(name)
    out = F.lit(rules[-1][1])
    for test, label in reversed(rules[:-1]):
        out = F.when(test(c), F.lit(label)).otherwise(out)
    return out


def format_change(c: Column) -> Column:
    n = F.rint(c).cast("int")
    return F.when(c.isNull(), "").when(n > 0, F.concat(F.lit("+"), n.cast("string"))).otherwise(n.cast("string"))


def percent_text(c: Column) -> Column:
    return F.format_string("%.1f%%", c.cast("double") * 100)


def fixture_label(week: Column, home: Column, away: Column, day: Column, kickoff: Column) -> Column:
    return F.concat(
        F.lit("MW"), week.cast("int").cast("string"), F.lit(": "), home, F.lit(" v "), away,
        F.lit(" — "), day.cast("string"), F.lit(" "), kickoff, F.lit(" DK"),
    )
