"""Absences and suspensions turned into match features and probability shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchframe.functions.probs import P, normalize_probs, triple
from matchframe.operators.joins import active_interval_join, spell_totals
from matchframe.operators.longform import side_value, to_wide

# What is summed over absent players.
ABSENT_SUMS = ("minutes", "goals", "xg", "xa", "market_value", "defensive")


def absence_totals(long: DataFrame, absences: DataFrame) -> DataFrame:
    """Per team-match: distinct absent players and sums, split into injured and suspended."""
    suspended = F.coalesce((F.col("is_suspended") >= 1) | (F.lower("status_type") == "suspension"), F.lit(False))
    starter = F.col("is_expected_starter") >= 1
    kinds = {"injured": ~suspended, "suspended": suspended}
    totals = spell_totals(
        long.select("match_id", "is_home", "team", "match_date"),
        absences,
        who="player",
        present={
            "injured_players_count": ~suspended,
            "injured_starters_count": ~suspended & starter,
            "suspended_players_count": suspended,
            "suspended_expected_starters": suspended & starter,
            "number_of_injured_starters": starter,
        },
        sums={f"{kind}_missing_{c}": F.when(held, F.col(c)) for kind, held in kinds.items() for c in ABSENT_SUMS},
    )
    return totals.drop("team", "match_date").withColumns(
        {"missing_" + c: F.col("injured_missing_" + c) + F.col("suspended_missing_" + c) for c in ABSENT_SUMS}
    ).withColumn("injured_expected_starters", F.col("injured_starters_count"))


ABSENCE_FEATURES = (
    "injured_players_count", "injured_starters_count", "injured_expected_starters", "suspended_players_count",
    "suspended_expected_starters", "number_of_injured_starters",
    *(f"{p}missing_{c}" for p in ("injured_", "suspended_", "") for c in ABSENT_SUMS),
)


def absence_features(long: DataFrame, absences: DataFrame) -> DataFrame:
    """One row per match with a home side, zeros for sides without absences."""
    wide = to_wide(absence_totals(long, absences), ABSENCE_FEATURES)
    return wide.where(F.col(f"home_{ABSENCE_FEATURES[0]}").isNotNull()).na.fill(0)


def availability_scores(features: DataFrame) -> DataFrame:
    """Severity, availability and line-up strength per side, 0 to 100."""
    out: dict[str, Column] = {}
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0))
    for side in ("home", "away"):

        def v(name: str, side: str = side) -> Column:
            return F.col(f"{side}_{name}").cast("double")

        starters = 6.0 * v("injured_starters_count")
        squad = 1.5 * F.greatest(F.lit(0.0), v("injured_players_count") - v("injured_starters_count"))
        minutes = v("missing_minutes") / 450.0
        attack = 3.0 * (v("missing_xg") + v("missing_xa"))
        severity = starters + squad + minutes + attack + v("missing_market_value") / 15_000_000.0
        out[f"{side}_availability_score"] = clip(100.0 - severity)
        out[f"{side}_lineup_strength_score"] = clip(100.0 - starters - minutes - attack)
        out[f"{side}_injury_severity_score"] = severity
    return features.withColumns(out)


def active_suspensions(long: DataFrame, suspensions: DataFrame) -> DataFrame:
    """(team-match, suspension) pairs in force on the day with matches left to serve."""
    return active_interval_join(
        long, suspensions.where("matches_remaining > 0"), known="suspended_from", start="suspended_from", end="suspended_until"
    )


# Cap on what one team's suspensions may move, and where the mass goes.
MAX_TEAM_IMPACT = 0.06
TO_DRAW, TO_OPPONENT = 0.35, 0.65


def suspension_impact(starter: Column, importance: Column, remaining: Column) -> Column:
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    raw = 0.004 + 0.010 * unit(starter) + 0.026 * unit(importance) + F.when(remaining >= 2, 0.004).otherwise(0.0)
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(0.04))


def suspension_adjust(probs: DataFrame, long: DataFrame, suspensions: DataFrame) -> DataFrame:
    """Move mass away from sides with suspended players, home side first."""
    impact = suspension_impact(F.col("expected_starter"), F.col("importance_score"), F.col("matches_remaining"))
    per_side = spell_totals(
        long.select("match_id", "is_home", "team", "match_date"), suspensions.where("matches_remaining > 0"),
        sums={"impact": impact}, known="suspended_from", start="suspended_from", end="suspended_until",
    ).withColumn("impact", F.least("impact", F.lit(MAX_TEAM_IMPACT)))
    per_match = per_side.groupBy("match_id").agg(
        side_value(1, "impact").alias("home_impact"), side_value(0, "impact").alias("away_impact")
    )
    floor = 1e-9
    h, d, a = normalize_probs(triple(), floor)
    rows = probs.join(per_match, "match_id", "left").na.fill(0.0, ["home_impact", "away_impact"])
    rows = rows.withColumns({"_h": h, "_d": d, "_a": a})
    take = F.when(F.col("home_impact") > 0, F.least(F.col("home_impact"), F.col("_h") - floor)).otherwise(0.0)
    rows = rows.withColumn("_m", take).withColumns(
        {"_h": F.col("_h") - F.col("_m"), "_d": F.col("_d") + F.col("_m") * TO_DRAW, "_a": F.col("_a") + F.col("_m") * TO_OPPONENT}
    )
    take = F.when(F.col("away_impact") > 0, F.least(F.col("away_impact"), F.col("_a") - floor)).otherwise(0.0)
    rows = rows.withColumn("_m", take).withColumns(
        {"_a": F.col("_a") - F.col("_m"), "_d": F.col("_d") + F.col("_m") * TO_DRAW, "_h": F.col("_h") + F.col("_m") * TO_OPPONENT}
    )
    new = normalize_probs(triple(("_h", "_d", "_a")), floor)
    return rows.withColumns({"adj_" + c: x for c, x in zip(P, new, strict=True)}).drop("_h", "_d", "_a", "_m")
