"""Season tables, promoted sides, season-start adjustments and strength scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchframe.operators.longform import to_long
from matchframe.operators.rolling import zero
from matchframe.operators.windows import tied_rank

LEAGUE = ("pool", "season")


def zscore(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Standard score by key with the population deviation; 0 where that is 0 or null.

    The moments are aggregated first, so a large key is never held in one task.
    """
    stats = df.groupBy(*keys).agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    z = F.coalesce(F.when(F.col("_s") > 0, (F.col(column) - F.col("_m")) / F.col("_s")), F.lit(0.0))
    return df.join(stats, list(keys), "left").withColumn(name, z).drop("_m", "_s")


def season_table(matches: DataFrame, keys: Sequence[str] = LEAGUE) -> DataFrame:
    """League table: points, goals, difference and position (points, difference, goals, name)."""
    rows = to_long(matches).groupBy(*keys, "team").agg(
        F.count("*").alias("played"), F.sum("points").alias("points"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga")
    )
    # One row per team of a league season is left to order.
    w = Window.partitionBy(*keys).orderBy(
        F.col("points").desc(), (F.col("gf") - F.col("ga")).desc(), F.col("gf").desc(), F.col("team")
    )
    return rows.withColumns({"gd": F.col("gf") - F.col("ga"), "position": F.row_number().over(w)})


def season_index(matches: DataFrame, keys: Sequence[str] = ("pool",)) -> DataFrame:
    """(keys..., season, prev): each season with the one before it."""
    seasons = matches.select(*keys, "season").distinct()
    return seasons.withColumn("prev", F.lag("season").over(Window.partitionBy(*keys).orderBy("season")))


def promoted_teams(matches: DataFrame, keys: Sequence[str] = ("pool",)) -> DataFrame:
    """(keys..., season, team) of teams absent from the previous season; none in the first one."""
    teams = matches.select(*keys, "season", F.explode(F.array("home", "away")).alias("team")).distinct()
    return promoted_in(teams, keys)


def promoted_in(teams: DataFrame, keys: Sequence[str] = ("pool",)) -> DataFrame:
    """As ``promoted_teams``, from the rows (keys..., season, team) of a season table."""
    k = list(keys)
    later = season_index(teams, keys).where("prev IS NOT NULL")
    now = teams.select(*k, "season", "team").join(later, [*k, "season"])
    before = teams.select(*k, F.col("season").alias("prev"), "team")
    return now.join(before, [*k, "prev", "team"], "left_anti").select(*k, "season", "team")


# What a promoted side is expected to do without any data.
NO_DATA = {
    "average_points": 34.0, "median_points": 34.0, "average_position": 17.0, "median_position": 17.0,
    "relegation_rate": 0.55, "goals_for_per_match": 1.05, "goals_against_per_match": 1.70,
}
SEASON_MATCHES = 38.0


def promoted_baseline(matches: DataFrame, keys: Sequence[str] = ("pool",), table: DataFrame | None = None) -> DataFrame:
    """Typical season of promoted sides per key; the 12 lowest-scoring seasons where there are none.

    ``table`` is the season table of the matches, if it is at hand.
    """
    k = list(keys)
    table = season_table(matches, [*k, "season"]) if table is None else table
    new = promoted_in(table, keys).withColumn("_new", F.lit(1))
    rows = table.join(new, [*k, "season", "team"], "left")
    some = rows.groupBy(*k).agg(F.max("_new").alias("_any"))
    lowest = Window.partitionBy(*k).orderBy("points", "season", "team")
    poorest = rows.join(some.where("_any IS NULL"), k, "left_semi").withColumn("_rn", F.row_number().over(lowest)).where("_rn <= 12").drop("_rn")
    used = rows.where("_new = 1").unionByName(poorest)
    half = lambda c: F.percentile(c, F.lit(0.5))
    stats = used.groupBy(*k).agg(
        F.avg("points").alias("average_points"), half("points").alias("median_points"),
        F.avg("position").alias("average_position"), half("position").alias("median_position"),
        F.avg((F.col("position") >= 18).cast("double")).alias("relegation_rate"),
        F.avg(F.col("gf") / SEASON_MATCHES).alias("goals_for_per_match"),
        F.avg(F.col("ga") / SEASON_MATCHES).alias("goals_against_per_match"),
    )
    return stats.na.fill(NO_DATA)


def current_records(matches: DataFrame, season, keys: Sequence[str] = ("pool",)) -> DataFrame:
    """Matches and points per team in one season."""
    return to_long(matches.where(F.col("season") == season)).groupBy(*keys, "team").agg(
        F.count("*").alias("matches"), F.sum("points").alias("points")
    )


def tier_summary(matches: DataFrame, keys: Sequence[str] = ("pool",)) -> DataFrame:
    """Second-tier form per team of a key: last 5, last 10 and all matches; xG and shots where present."""
    long, k = to_long(matches), [*keys, "team"]
    newest = Window.partitionBy(*k).orderBy(F.col("match_date").desc(), F.col("match_id").desc())
    ten = long.withColumn("_rn", F.row_number().over(newest)).where("_rn <= 10")
    five = F.col("_rn") <= 5
    mean5 = lambda c: F.avg(F.when(five, F.col(c)))
    recent = ten.groupBy(*k).agg(
        F.sum(F.when(five, F.col("points"))).alias("points_last5"),
        mean5("gf").alias("goals_for_avg_last5"), mean5("ga").alias("goals_against_avg_last5"),
        zero(mean5("sf")).alias("shots_avg_last5"), zero(mean5("sotf")).alias("shots_on_target_avg_last5"),
        zero(F.avg("sf")).alias("shots_avg_last10"), zero(F.avg("sotf")).alias("shots_on_target_avg_last10"),
        zero(mean5("sa")).alias("shots_allowed_avg_last5"), zero(mean5("sota")).alias("shots_on_target_allowed_avg_last5"),
        mean5("xgf").alias("xg_avg_last5"), mean5("xga").alias("xga_avg_last5"),
    )
    whole = long.groupBy(*k).agg(
        F.count("*").alias("source_matches"), F.max("match_date").alias("latest_match"),
        zero(F.avg("sf")).alias("shots_avg_season"), zero(F.avg("sotf")).alias("shots_on_target_avg_season"),
        F.max(F.col("xgf").isNotNull().cast("int")).alias("xg_available"),
        F.max(F.col("sf").isNotNull().cast("int")).alias("shot_volume_available"),
    )
    return whole.join(recent, k)


# snapshot column -> column of the tier summary and its factor to top-flight level.
ADJUSTED = {
    "points_last_5": ("points_last5", 0.55),
    "goals_scored_avg": ("goals_for_avg_last5", 0.75),
    "xg_avg": ("xg_avg_last5", 0.75),
    "xga_avg": ("xga_avg_last5", 1.35),
    **{
        f"{m}_avg_{w}": (f"{m}_avg_{w}", 0.75)
        for m in ("shots", "shots_on_target")
        for w in ("last5", "last10", "season")
    },
}
MIN_MATCHES = 5
# Medians assumed where a league has none.
MEDIAN_FALLBACK = {"points_last_5": 5.0, "goals_scored_avg": 1.15, "xg_avg": 1.25, "xga_avg": 1.45,
                   **{c: 10.0 if "on_target" not in c else 3.5 for c in ADJUSTED if c.startswith("shots")}}


def feature_medians(snapshot: DataFrame, keys: Sequence[str] = ("pool",)) -> DataFrame:
    """Median of the ten form columns over teams with at least five matches."""
    some = snapshot.where(F.col("match_count") >= MIN_MATCHES)
    return some.groupBy(*keys).agg(*[F.percentile(c, F.lit(0.5)).alias("med_" + c) for c in ADJUSTED])


PL, TIER, BASE = (
    "Premier League historical data", "Championship adjusted to Premier League equivalent",
    "Promoted-team conservative Premier League baseline",
)


def adjusted_features(
    teams: DataFrame, snapshot: DataFrame, medians: DataFrame, baseline: DataFrame, tier: DataFrame,
    records: DataFrame, promoted: DataFrame, keys: Sequence[str] = ("pool",)
) -> DataFrame:
    """Season-start features per team: own history, converted second-tier form or a cautious baseline.

    A promoted side blends in its own form by n/5 until it has five matches.
    Input ``teams(keys..., team)``; every other table joins by key and team, or by key.
    """
    k, kt = list(keys), [*keys, "team"]
    raw = snapshot.select(*kt, "match_count", "latest_match", *ADJUSTED)
    rows = (
        teams.join(raw, kt, "left")
        .join(tier.select(*kt, "source_matches", F.col("latest_match").alias("tier_latest"), "xg_available",
                          *[F.col(c).alias("t_" + c) for c in dict.fromkeys(s for s, _ in ADJUSTED.values())]), kt, "left")
        .join(records.select(*kt, F.col("matches").alias("season_matches"), F.col("points").alias("season_points")), kt, "left")
        .join(promoted.select(*kt).distinct().withColumn("is_promoted", F.lit(1)), kt, "left")
        .join(medians, k, "left")
        .join(baseline, k, "left")
        .na.fill(0, ["match_count", "season_matches", "season_points", "is_promoted", *ADJUSTED])
        .na.fill({**{f"med_{c}": v for c, v in MEDIAN_FALLBACK.items()}, **NO_DATA})
    )
    new = (F.col("is_promoted") == 1) & (F.col("season_matches") < MIN_MATCHES)
    own = (F.col("match_count") >= MIN_MATCHES) & ~new
    has_tier = F.col("source_matches").isNotNull()
    gf, ga = F.col("goals_for_per_match"), F.col("goals_against_per_match")
    med = lambda c: F.col("med_" + c)
    cautious = {
        "points_last_5": F.least(med("points_last_5") * 0.85, F.col("median_points") / SEASON_MATCHES * 5.0),
        "goals_scored_avg": F.least(med("goals_scored_avg") * 0.85, gf),
        "xg_avg": F.least(med("xg_avg") * 0.82, gf * 0.95),
        "xga_avg": F.greatest(med("xga_avg") * 1.18, ga * 0.95),
        **{c: med(c) * 0.82 for c in ADJUSTED if c.startswith("shots")},
    }
    share = F.when(new & (F.col("season_matches") > 0), F.least(F.lit(1.0), F.col("season_matches") / MIN_MATCHES)).otherwise(0.0)
    rows = rows.withColumn("current_season_blend_weight", F.when(own, 1.0).otherwise(share))
    w = F.col("current_season_blend_weight")
    out: dict[str, Column] = {}
    for c, (src, factor) in ADJUSTED.items():
        converted = F.col("t_" + src) * factor
        if c in ("xg_avg", "xga_avg"):
            converted = F.when(F.col("xg_available") == 1, converted).otherwise(cautious[c])
        prior = F.when(has_tier, converted).otherwise(cautious[c])
        out["adj_" + c] = F.when(own, F.col(c)).otherwise((1.0 - w) * prior + w * F.col(c))
    rows = rows.withColumns(out).withColumn("adj_xg_diff", F.col("adj_xg_avg") - F.col("adj_xga_avg"))
    return rows.withColumns(
        {
            "source_league": F.when(own, PL).when(has_tier, TIER).otherwise(BASE),
            "promotion_adjustment_applied": (~own).cast("int"),
            "fallback_used": (~own & ~has_tier).cast("int"),
            "tier_available": has_tier.cast("int"),
        }
    )


@dataclass(frozen=True)
class Reasons:
    """Why a team's features are adjusted, in words; ``blend`` takes the share of its own season."""

    # The texts that audits show.
    baseline: str = "No local Premier League history; Championship data is not treated as Premier League-equivalent."
    converted: str = "Championship recent form, xG/xGA and shot volume converted to Premier League-equivalent values."
    partly: str = (
        "Championship recent form and shot volume converted to Premier League-equivalent values. "
        "Championship xG unavailable, so xG/xGA use conservative promoted-team baseline."
    )
    blend: str = " Current-season Premier League form is blended in at %.0f%% until five PL matches are available."


def season_start_audit(
    adjusted: DataFrame, state: DataFrame | None = None, reasons: Reasons = Reasons(), keys: Sequence[str] = ("pool",)
) -> DataFrame:
    """Reason text and the list of data gaps per team; ``state(keys..., team, rating)`` marks unrated teams."""
    rows = adjusted
    rated = F.lit(True)
    if state is not None:
        kt = [*keys, "team"]
        rows = rows.join(state.select(*kt, F.col("rating").alias("elo_rating")), kt, "left")
        rated = F.col("elo_rating").isNotNull()
        rows = rows.withColumn("elo_fallback", (~rated).cast("int")).na.fill({"elo_rating": 1500.0})
        rated = F.col("elo_fallback") == 0
    active = F.when(F.col("is_promoted") == 1, F.col("season_matches")).otherwise(F.col("match_count"))
    flags = {
        "no_premier_league_history": active == 0,
        "limited_recent_form": (active > 0) & (active < MIN_MATCHES),
        "xg_fallback": active < MIN_MATCHES,
        "shot_volume_fallback": active < MIN_MATCHES,
        "elo_fallback": ~rated,
    }
    text = F.concat_ws(", ", *[F.when(c, F.lit(n)) for n, c in flags.items()])
    w = F.col("current_season_blend_weight")
    blend = F.when((w > 0) & (F.col("source_league") != PL), F.format_string(reasons.blend, w * 100)).otherwise("")
    text_of = {BASE: reasons.baseline, TIER: reasons.converted}
    partly = (F.col("source_league") == TIER) & (F.coalesce("xg_available", F.lit(0)) != 1)
    said = F.when(partly, reasons.partly)
    for league, words in text_of.items():
        said = said.when(F.col("source_league") == league, words)
    reason = F.when(F.col("source_league") == PL, "none").otherwise(F.concat(said, blend))
    return rows.withColumns(
        {
            "fallback_flags": F.when(text == "", "none").otherwise(text),
            "fallback_reason": reason,
            "promoted_team_uncertainty_flag": (active < MIN_MATCHES).cast("int"),
        }
    )


OVERRIDES = (*ADJUSTED, "xg_diff")


def feature_overrides(audit: DataFrame) -> DataFrame:
    """(pool, team, o_*) for adjusted teams only."""
    some = audit.where("fallback_used = 1 OR promotion_adjustment_applied = 1")
    return some.select("pool", "team", *[F.col("adj_" + c).alias("o_" + c) for c in OVERRIDES])


def apply_overrides(features: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace both sides' columns of overridden teams; ``features`` has pool, home, away and home_/away_ columns."""
    out = features
    for side in ("home", "away"):
        o = overrides.select("pool", F.col("team").alias(side), *[F.col("o_" + c).alias("_" + c) for c in OVERRIDES])
        have = [c for c in OVERRIDES if f"{side}_{c}" in features.columns]
        out = out.join(o, ["pool", side], "left")
        out = out.withColumns({f"{side}_{c}": F.coalesce("_" + c, f"{side}_{c}") for c in have}).drop(*["_" + c for c in OVERRIDES])
    return out


def validate_projection_inputs(audit: DataFrame) -> DataFrame:
    """Status per team: error, fallback, adjusted or ok, and what is missing."""
    fallback, adjusted = F.col("fallback_used") == 1, F.col("promotion_adjustment_applied") == 1
    thin = (F.col("match_count") < MIN_MATCHES) & ~fallback & ~adjusted
    silent = fallback & (F.coalesce("fallback_reason", F.lit("")) == "")
    missing = F.concat_ws(", ", F.when(thin, "recent_form, xg_strength, shot_volume"), F.when(silent, "fallback_reason"))
    status = F.when(thin | silent, "error").when(fallback, "fallback").when(adjusted, "adjusted").otherwise("ok")
    marker = F.when(fallback, "explicit_fallback").when(adjusted, "promoted_adjustment").otherwise("none")
    return audit.withColumns(
        {"feature_validation_status": status, "missing_or_fallback_groups": F.when(missing != "", missing).otherwise(marker)}
    )


def projection_status(validation: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Worst status over all teams in words."""
    s = F.col("feature_validation_status")
    level = F.max(F.when(s == "error", 3).when(s == "fallback", 2).when(s == "adjusted", 1).otherwise(0))
    words = F.array(*[F.lit(x) for x in ("Ready", "Adjusted", "Fallback", "Error")])
    return validation.groupBy(*keys).agg(level.alias("_l"), F.count("*").alias("teams")).withColumn("status", words[F.col("_l")]).drop("_l")


MIN_SEASON_MATCHES = 300


def long_term_strength(
    matches: DataFrame, teams: DataFrame, state: DataFrame, *, keys: Sequence[str] = ("pool",), least: int = MIN_SEASON_MATCHES
) -> DataFrame:
    """0.55 z(points) + 0.30 z(difference) + 0.15 z(rating) over the last two full seasons of each key."""
    k = list(keys)
    full = matches.groupBy(*k, "season").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    w = Window.partitionBy(*k).orderBy(F.col("season").desc())
    recent = full.withColumn("_rn", F.row_number().over(w)).where("_rn <= 2").select(*k, "season")
    table = season_table(matches.join(recent, [*k, "season"], "left_semi"), [*k, "season"])
    sums = table.groupBy(*k, "team").agg(F.sum("points").alias("p"), F.sum("played").alias("n"), F.sum("gd").alias("g"))
    per = sums.select(*k, "team", (F.col("p") / F.col("n")).alias("ppg"), (F.col("g") / F.col("n")).alias("gdm"))
    rows = teams.join(per, [*k, "team"], "left")
    mid = rows.groupBy(*k).agg(F.percentile("ppg", F.lit(0.5)).alias("_p"), F.percentile("gdm", F.lit(0.5)).alias("_g"))
    rows = rows.join(mid, k).withColumns(
        {"ppg": F.coalesce("ppg", "_p", F.lit(1.0)), "gd_per_match": F.coalesce("gdm", "_g", F.lit(0.0))}
    ).drop("gdm", "_p", "_g")
    rows = rows.join(state.select(*k, "team", F.col("rating").alias("elo")), [*k, "team"], "left").na.fill({"elo": 1500.0})
    for c in ("ppg", "gd_per_match", "elo"):
        rows = zscore(rows, k, c, "z_" + c)
    return rows.withColumn("strength", 0.55 * F.col("z_ppg") + 0.30 * F.col("z_gd_per_match") + 0.15 * F.col("z_elo"))


def normalize_squad_strength(squads: DataFrame, keys: Sequence[str] = ("season",), value: str = "squad_market_value_eur") -> DataFrame:
    """Min-max score of the log value, rank, percentile and bucket; a missing value stays missing."""
    k = list(keys)
    log = F.when(F.col(value).isNotNull(), F.log(F.greatest(F.col(value), F.lit(1.0))))
    rows = squads.withColumns({"squad_strength_used": F.col(value).isNotNull().cast("int"), "_log": log})
    span = rows.groupBy(*k).agg(F.min("_log").alias("_lo"), F.max("_log").alias("_hi"), F.sum("squad_strength_used").alias("_n"))
    rows = tied_rank(rows, k, value, name="_rank").join(span, k)
    used = F.col("squad_strength_used") == 1
    rank = F.when(used, F.col("_rank"))
    score = F.when(used, (F.col("_log") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-9)))
    pct = 1.0 - (rank - 1.0) / F.greatest(F.col("_n") - 1, F.lit(1))
    promoted = F.coalesce(F.col("promoted_team_flag") > 0, F.lit(False)) if "promoted_team_flag" in squads.columns else F.lit(False)
    bucket = (
        F.when(~used, "Missing")
        .when(promoted & (rank > 12), "Promoted / uncertain")
        .when(rank <= 4, "Elite").when(rank <= 8, "Strong").when(rank <= 14, "Mid-table").otherwise("Lower-table")
    )
    return rows.withColumns(
        {"squad_strength_rank": rank, "squad_strength_score": score, "squad_strength_percentile": pct, "squad_strength_bucket": bucket}
    ).drop("_log", "_lo", "_hi", "_n", "_rank")


def feature_parity(a: DataFrame, b: DataFrame, columns: Sequence[str], key: str = "match_id") -> DataFrame:
    """Absolute difference of two versions of the same features, one row per match and column."""
    joined = a.select(key, *[F.col(c).alias("a_" + c) for c in columns]).join(
        b.select(key, *[F.col(c).alias("b_" + c) for c in columns]), key
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"), F.col("a_" + c).cast("double").alias("left_value"), F.col("b_" + c).cast("double").alias("right_value")
            )
            for c in columns
        ]
    )
    return joined.select(key, F.inline(cells)).withColumn("abs_diff", F.abs(F.col("left_value") - F.col("right_value")))
