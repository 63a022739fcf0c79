"""Season projection: expected points, sampled seasons, positions and their validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchframe.functions.probs import hash_uniform, normalize_probs, triple
from matchframe.operators.joins import anti_join_played
from matchframe.operators.metrics import average_rank
from matchframe.operators.strength import season_table

KEYS = ("pool",)


def _both_sides(rows: DataFrame, home: Column, away: Column, keep: Sequence[str], name: str) -> DataFrame:
    sides = F.array(
        F.struct(F.col("home").alias("team"), home.alias(name)), F.struct(F.col("away").alias("team"), away.alias(name))
    )
    return rows.select(*keep, F.inline(sides))


def starting_points(done: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys..., team, start) from completed matches of one season."""
    return season_table(done, keys).select(*keys, "team", F.col("points").cast("double").alias("start"))


def expected_points(probs: DataFrame, start: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    h, d, a = triple()
    rows = _both_sides(probs, 3.0 * h + d, 3.0 * a + d, keys, "x")
    if start is not None:
        rows = rows.unionByName(start.select(*keys, "team", F.col("start").alias("x")))
    return rows.groupBy(*keys, "team").agg(F.sum("x").alias("expected_points_deterministic"))


def sample_seasons(
    probs: DataFrame, n: int, seed: int = 42, start: DataFrame | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Points per (keys..., sim, team) over ``n`` sampled seasons.

    Draws depend only on (seed, sim, match), so a repeated task draws the same.
    Each task sums its own matches before anything is shuffled.
    """
    h, d, a = normalize_probs(triple())
    rows = probs.select("match_id", *keys, "home", "away", h.alias("_h"), (h + d).alias("_hd"))
    sims = rows.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    u = hash_uniform(F.lit(seed), F.col("sim"), F.col("match_id"))
    sims = sims.withColumn("_u", u)
    home = F.when(F.col("_u") < F.col("_h"), 3.0).when(F.col("_u") < F.col("_hd"), 1.0).otherwise(0.0)
    away = F.when(F.col("_u") < F.col("_h"), 0.0).when(F.col("_u") < F.col("_hd"), 1.0).otherwise(3.0)
    out = _both_sides(sims, home, away, [*keys, "sim"], "x")
    if start is not None:
        base = start.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        out = out.unionByName(base.select(*keys, "sim", "team", F.col("start").alias("x")))
    return out.groupBy(*keys, "sim", "team").agg(F.sum("x").alias("points"))


def position_probabilities(sims: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Expected points and position, title, top-4, top-6 and relegation chances.

    Ranks by points, then name; goal difference is not simulated.  A partition
    holds the teams of one league in one sampled season.
    """
    w = Window.partitionBy(*keys, "sim").orderBy(F.col("points").desc(), F.col("team"))
    size = Window.partitionBy(*keys, "sim")
    rows = sims.withColumns({"pos": F.row_number().over(w), "n": F.count("*").over(size)})
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(*keys, "team").agg(
        F.avg("points").alias("expected_points"), F.avg("pos").alias("expected_position"),
        share(F.col("pos") == 1).alias("title_probability"), share(F.col("pos") <= 4).alias("top_4_probability"),
        share(F.col("pos") <= 6).alias("top_6_probability"), share(F.col("pos") >= F.col("n") - 2).alias("relegation_probability"),
    )


def projected_position(projection: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("expected_position", "team")
    return projection.withColumn("projected_position", F.row_number().over(w))


def project_season(probs: DataFrame, done: DataFrame, n: int, seed: int = 42, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sampled projection of the unplayed fixtures on top of the points already won."""
    todo = anti_join_played(probs, done)
    start = starting_points(done, keys)
    sims = position_probabilities(sample_seasons(todo, n, seed, start, keys), keys)
    both = sims.join(expected_points(todo, start, keys), [*keys, "team"], "left")
    return projected_position(both, keys)


# --- progress of a running season -----------------------------------------


def with_matchweeks(done: DataFrame, fixtures: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    weeks = fixtures.select(*keys, "home", "away", "matchweek")
    return done.join(weeks, [*keys, "home", "away"], "left")


def matchweek_progress(done: DataFrame, fixtures: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per key: latest full week, latest started week, the reference week for movement and the first open week.

    The reference is the week before the latest full one, unless another round is under way.
    """
    k = list(keys)
    planned = fixtures.groupBy(*k, "matchweek").agg(F.count("*").alias("_n"))
    played = with_matchweeks(done, fixtures, keys).where("matchweek IS NOT NULL").groupBy(*k, "matchweek").agg(F.count("*").alias("_d"))
    missing = anti_join_played(fixtures, done, [*k, "home", "away"]).groupBy(*k, "matchweek").agg(F.count("*").alias("_open"))
    weeks = planned.join(played, [*k, "matchweek"], "left").join(missing, [*k, "matchweek"], "left")
    week = F.col("matchweek")
    out = weeks.groupBy(*k).agg(
        F.max(F.when(F.col("_d") >= F.col("_n"), week)).alias("latest_full"),
        F.max(F.when(F.col("_d").isNotNull(), week)).alias("latest_started"),
        F.coalesce(F.min(F.when(F.col("_open") > 0, week)), F.max(week)).alias("first_open"),
    )
    full, started = F.col("latest_full"), F.col("latest_started")
    return out.withColumn("reference", F.when((full > 1) & (full == started), full - 1))


def through_matchweek(done: DataFrame, fixtures: DataFrame, reference: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Completed matches up to the reference week; none where there is no such week."""
    ref = reference.select(*keys, F.col("reference").alias("_ref"))
    rows = with_matchweeks(done, fixtures, keys).join(ref, list(keys))
    return rows.where(F.col("matchweek") <= F.col("_ref")).select(*done.columns)


def position_movement(
    current: DataFrame, preseason: DataFrame, previous: DataFrame | None = None, keys: Sequence[str] = ("pool",)
) -> DataFrame:
    """Places gained (positive) since the season start and since the previous round, per key and team."""
    k = [*keys, "team"]
    here = F.col("projected_position")
    out = current.join(preseason.select(*k, F.col("projected_position").alias("preseason_projected_position")), k, "left")
    out = out.withColumn("position_change_since_season_start", F.col("preseason_projected_position") - here)
    if previous is not None:
        prev = previous.select(*k, F.col("projected_position").alias("previous_round_projected_position"))
        out = out.join(prev, k, "left").withColumn(
            "position_change_since_previous_round", F.col("previous_round_projected_position") - here
        )
    return out


# --- validation ------------------------------------------------------------


def season_errors(forecast: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Absolute position and points errors; ``actual(keys..., team, points, position)``."""
    a = actual.select(*keys, "team", "points", F.col("position").alias("actual_position"))
    return forecast.join(a, [*keys, "team"], "left").withColumns(
        {
            "position_error": F.abs(F.col("expected_position") - F.col("actual_position")),
            "points_error": F.abs(F.col("expected_points") - F.col("points")),
        }
    )


def season_validation(errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean errors, rank correlation (mean ranks for ties), champion hit, top-4 and bottom-3 overlap per season."""
    k = list(keys)
    best = Window.partitionBy(*k)
    by_forecast = best.orderBy("expected_position", "team")
    by_actual = best.orderBy("actual_position", "team")
    rows = errors.withColumns(
        {"_f": F.row_number().over(by_forecast), "_a": F.row_number().over(by_actual), "_n": F.count("*").over(best)}
    )
    rows = average_rank(average_rank(rows, k, "expected_position", "_rf"), k, "actual_position", "_ra")
    hit = lambda a, b: F.sum((a & b).cast("double"))
    f, a, n = F.col("_f"), F.col("_a"), F.col("_n")
    corr = F.corr("_rf", "_ra")
    return rows.groupBy(*k).agg(
        F.avg("position_error").alias("average_position_error"), F.avg("points_error").alias("average_points_error"),
        F.when(~F.isnan(corr), corr).alias("rank_correlation"),
        hit(f == 1, a == 1).alias("champion_prediction_accuracy"),
        (hit(f <= 4, a <= 4) / 4.0).alias("top_4_prediction_accuracy"),
        (hit(f > n - 3, a > n - 3) / 3.0).alias("relegation_prediction_accuracy"),
    )


VALIDATION = (
    "average_position_error", "average_points_error", "rank_correlation", "champion_prediction_accuracy",
    "top_4_prediction_accuracy", "relegation_prediction_accuracy",
)


def aggregate_validation(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    return metrics.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in VALIDATION], F.count("*").alias("seasons"))


def misranked(errors: DataFrame, keys: Sequence[str], season: str = "season") -> DataFrame:
    return errors.groupBy(*keys, "team").agg(
        F.count_distinct(season).alias("seasons"), F.avg("position_error").alias("mean_position_error"),
        F.avg("points_error").alias("mean_points_error"), F.avg("expected_position").alias("mean_expected_position"),
        F.avg("actual_position").alias("mean_actual_position"),
    )


def variant_name(elo: bool, calibrated: bool) -> str:
    return {(True, True): "current_plus_elo_calibrated", (True, False): "current_plus_elo",
            (False, True): "current_calibrated", (False, False): "current_without_elo"}[elo, calibrated]


def projection_delta(after: DataFrame, before: DataFrame, columns: Sequence[str] = ("expected_points", "relegation_probability"), keys: Sequence[str] = ("pool", "team")) -> DataFrame:
    """Change of the projection columns between two runs."""
    b = before.select(*keys, *[F.col(c).alias("_" + c) for c in columns])
    out = after.join(b, list(keys), "left")
    return out.withColumns({f"{c}_delta": F.col(c) - F.col("_" + c) for c in columns}).drop(*["_" + c for c in columns])
