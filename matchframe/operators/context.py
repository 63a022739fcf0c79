"""Calendar context around fixtures, prediction rows, time-window means and freshness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchframe.functions import clean as C
from matchframe.operators.joins import dedupe_keep
from matchframe.operators.longform import to_wide
from matchframe.operators.rolling import zero
from matchframe.operators.windows import History, real_row

# --- results outside the league -------------------------------------------

NON_LEAGUE = (
    "any_matches_last_14_days", "days_since_any_match", "preseason_matches_last_60_days",
    "competitive_non_pl_matches_last_30_days", "europe_qualifier_last_7_days", "non_pl_points_equiv_last5",
    "non_pl_goals_equiv_avg_last5", "non_pl_shots_equiv_avg_last5", "non_pl_context_available",
)


def non_league_context(long: DataFrame, rows: DataFrame, *, source_empty: bool | None = None) -> DataFrame:
    """What each side did outside the league before the match day.

    ``rows(team, match_date, row_id, competition, points, goals_for, shots_for,
    weight)``.  A team without rows has 14 days since any match; if there are no
    rows at all every column is 0 instead.  Unless ``source_empty`` says which it
    is, a job looks for a first row.
    """
    if source_empty is None:
        source_empty = rows.isEmpty()
    asks = long.select("match_id", "is_home", "team", "match_date", F.lit(0).alias("_q"), F.lit(0).cast("long").alias("row_id"))
    facts = rows.select(
        "team", "match_date", F.lit(1).alias("_q"), F.col("row_id").cast("long").alias("row_id"),
        *[(F.col(c).cast("double") * F.col("weight")).alias("_" + c) for c in ("points", "goals_for", "shots_for")],
        C.is_preseason("competition").cast("int").alias("_pre"),
        C.is_europe("competition").cast("int").alias("_eur"),
    )
    fact = F.col("_q") == 1
    one = F.when(fact, 1)
    h = History(
        asks.unionByName(facts, allowMissingColumns=True),
        ["team"],
        ties=("_q", "row_id"),
        rows=5,
        rows_where=fact,
        days=60,
        day_sums={"d_any": one, "d_pre": F.col("_pre"), "d_comp": F.when(fact, 1 - F.col("_pre")), "d_eur": F.col("_eur")},
    )
    last_day = F.max(real_row(F.when(fact, F.col("match_date")))).over(h.running())
    seen = h.frame.withColumns({"_k": F.coalesce(F.sum(real_row(one)).over(h.running()), F.lit(0)), "_last": last_day})
    last5 = h.part().orderBy("_k").rangeBetween(-5, -1)

    def load(c: str, n: int) -> Column:
        return F.coalesce(F.sum(c).over(h.within_days(1, n)), F.lit(0)).cast("double")

    cols = {
        "any_matches_last_14_days": load("d_any", 14),
        "days_since_any_match": F.coalesce(F.datediff("match_date", "_last").cast("double"), F.lit(14.0)),
        "preseason_matches_last_60_days": load("d_pre", 60),
        "competitive_non_pl_matches_last_30_days": load("d_comp", 30),
        "europe_qualifier_last_7_days": (load("d_eur", 7) > 0).cast("double"),
        "non_pl_points_equiv_last5": zero(F.sum(real_row(F.col("_points"))).over(last5)),
        "non_pl_goals_equiv_avg_last5": zero(F.avg(real_row(F.col("_goals_for"))).over(last5)),
        "non_pl_shots_equiv_avg_last5": zero(F.avg(real_row(F.col("_shots_for"))).over(last5)),
        "non_pl_context_available": (F.col("_last").isNotNull()).cast("double"),
    }
    if source_empty:
        cols = {k: F.lit(0.0) for k in cols}
    out = h.real(seen.withColumns(cols)).where("_q = 0")
    return to_wide(out, NON_LEAGUE)


# --- fixture calendar ------------------------------------------------------

CONTEXT = (
    "days_rest", "matches_last_7_days", "matches_last_14_days", "matches_next_7_days", "matches_next_14_days",
    "short_rest_flag", "midweek_fixture_flag", "festive_congestion_flag",
)


def schedule_context(asks: DataFrame, dates: DataFrame, keys: Sequence[str] = ("team",)) -> DataFrame:
    """Calendar context of ``asks(keys..., match_date, ...)`` among ``dates(keys..., match_date)``.

    Rest is 14 without an earlier date; look-ahead counts come from known fixtures.
    """
    rows = asks.withColumn("_q", F.lit(1)).unionByName(
        dates.groupBy(*keys, "match_date").agg(F.count("*").alias("_n")).withColumn("_q", F.lit(0)), allowMissingColumns=True
    )
    mid = F.weekday("match_date").isin(1, 2, 3)
    is_date = F.col("_q") == 0
    h = History(
        rows, list(keys), ties=("_q",), rows=1, rows_where=is_date, days=14, ahead=14,
        day_sums={"d_n": F.when(is_date, F.col("_n")), "d_mid": F.when(is_date & mid, F.col("_n"))},
    )
    day = F.unix_date("match_date")
    before = h.part().orderBy(day).rangeBetween(-10_000_000, -1)
    last = F.max(real_row(F.when(is_date, day))).over(before)

    def n(c: str, w) -> Column:
        return F.coalesce(F.sum(c).over(w), F.lit(0)).cast("double")

    rest = F.coalesce((day - last).cast("double"), F.lit(14.0))
    month, dom = F.month("match_date"), F.day("match_date")
    cols = {
        "days_rest": rest,
        "matches_last_7_days": n("d_n", h.within_days(1, 7)),
        "matches_last_14_days": n("d_n", h.within_days(1, 14)),
        "matches_next_7_days": n("d_n", h.next_days(1, 7)),
        "matches_next_14_days": n("d_n", h.next_days(1, 14)),
        "midweek_fixture_flag": (n("d_mid", h.within_days(1, 7)) > 0).cast("double"),
        "festive_congestion_flag": (((month == 12) & (dom >= 20)) | ((month == 1) & (dom <= 4))).cast("double"),
    }
    rows = h.real(h.frame.withColumns(cols)).where("_q = 1")
    return rows.select(*asks.columns, *cols, (F.col("days_rest") < 5).cast("double").alias("short_rest_flag"))


def sides_of(fixtures: DataFrame, keep: Sequence[str] = ("match_id", "match_date")) -> DataFrame:
    """(keep..., team, is_home) per side of a fixture list."""
    sides = F.inline(
        F.array(
            F.struct(F.col("home").alias("team"), F.lit(1).alias("is_home")),
            F.struct(F.col("away").alias("team"), F.lit(0).alias("is_home")),
        )
    )
    return fixtures.select(*keep, sides)


def fixture_schedule_context(fixtures: DataFrame, schedule: DataFrame | None = None) -> DataFrame:
    """Per fixture: both sides' context within ``schedule`` (default: the list itself)."""
    asks = sides_of(fixtures)
    dates = sides_of(fixtures if schedule is None else schedule, ("match_date",)).select("team", "match_date")
    return to_wide(schedule_context(asks, dates), CONTEXT)


def add_supplemental_fixtures(fixtures: DataFrame, *extra: DataFrame) -> DataFrame:
    """League list plus cup rows (fixture- or team-level), first listed row per key kept."""
    parts = [fixtures.select("date", F.col("home").cast("string").alias("home"), F.col("away").cast("string").alias("away"))]
    for e in extra:
        home, away = C.first_alias(e, ["HomeTeam", "home", "team"]), C.first_alias(e, ["AwayTeam", "away", "opponent"])
        parts.append(
            e.select(
                C.first_alias(e, ["date"]).alias("date"), C.map_entity(home.cast("string")).alias("home"),
                C.map_entity(away.cast("string")).alias("away"),
            )
        )
    rows = None
    for i, p in enumerate(parts):
        p = p.select(C.parse_mixed_date("date").alias("match_date"), "home", "away", F.lit(i).alias("source"))
        rows = p if rows is None else rows.unionByName(p)
    return dedupe_keep(rows.dropna(subset=["match_date"]), ["match_date", "home", "away"], ["source"])


# --- prediction rows -------------------------------------------------------

SNAPSHOT_MEANS = {"goals_scored_avg": "gf", "xg_avg": "xgf", "xga_avg": "xga"}


def team_snapshot(long: DataFrame, keys: Sequence[str] = ("pool", "team")) -> DataFrame:
    """Latest state per team of a pool: form of the last 5, shots of the last 5/10 complete rows and the latest season.

    Only the newest ten rows per team survive the pre-shuffle limit; seasons are
    partial aggregates.
    """
    k = list(keys)
    newest = Window.partitionBy(*k).orderBy(F.col("match_date").desc(), F.col("match_id").desc())

    def top(df: DataFrame, n: int) -> DataFrame:
        return df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n)

    form = top(long, 5).groupBy(*k).agg(
        F.sum("points").alias("points_last_5"),
        *[zero(F.avg(src)).alias(name) for name, src in SNAPSHOT_MEANS.items()],
    )
    valid = long.where("sf IS NOT NULL AND sotf IS NOT NULL")
    in5 = F.col("_rn") <= 5
    shots = top(valid, 10).groupBy(*k).agg(
        *[
            F.avg(c if cond is None else F.when(cond, F.col(c))).alias(f"{name}_avg_{w}")
            for name, c in (("shots", "sf"), ("shots_on_target", "sotf"))
            for w, cond in (("last5", in5), ("last10", None))
        ]
    )
    seasons = valid.groupBy(*k, "season").agg(
        F.max("match_date").alias("_d"), F.count("*").alias("_n"), F.avg("sf").alias("_s"), F.avg("sotf").alias("_t")
    )
    latest = seasons.groupBy(*k).agg(F.max_by(F.struct("_n", "_s", "_t"), F.struct("_d", "season")).alias("l"))
    counts = long.groupBy(*k).agg(F.count("*").alias("match_count"), F.max("match_date").alias("latest_match"))
    out = counts.join(form, k).join(shots, k, "left").join(latest, k, "left")
    for name, f in (("shots", "_s"), ("shots_on_target", "_t")):
        season = F.when(F.col("l._n") >= 5, F.col(f"l.{f}")).otherwise(F.col(f"{name}_avg_last10"))
        out = out.withColumn(f"{name}_avg_season", zero(season))
    out = out.withColumn("xg_diff", F.col("xg_avg") - F.col("xga_avg")).drop("l")
    return out.na.fill(0.0, [c for c in out.columns if c.startswith("shots")])


def prediction_features(
    fixtures: DataFrame, long: DataFrame, *, horizon_days: int = 7, keys: Sequence[str] = ("pool", "team")
) -> DataFrame:
    """Features of unplayed fixtures from the teams' latest state.

    Schedule columns are taken at min(fixture day, latest known match + 7 days).
    Unknown teams get zero form and a rest of 14.
    """
    latest = long.agg(F.max("match_date").alias("_latest")).withColumn("_1", F.lit(1))
    dated = fixtures.withColumn("_1", F.lit(1)).join(F.broadcast(latest), "_1").drop("_1")
    limit = F.date_add("_latest", horizon_days)
    dated = dated.withColumn("match_date", F.least("match_date", F.coalesce(limit, F.col("match_date"))))
    asks = sides_of(dated, ("match_id", "match_date", *[k for k in keys if k != "team"]))
    load = schedule_context(asks, long.select(*keys, "match_date"), keys).select(
        "match_id", "is_home", *keys, "days_rest", "matches_last_14_days", F.col("midweek_fixture_flag").alias("had_midweek_match")
    )
    snap = team_snapshot(long, keys)
    state = [c for c in snap.columns if c not in (*keys, "latest_match", "match_count")]
    rows = load.join(snap, list(keys), "left").na.fill(0, state)
    return to_wide(rows, [*state, "days_rest", "matches_last_14_days", "had_midweek_match"]).withColumn("home_advantage", F.lit(1))


# --- time windows and freshness -------------------------------------------


def rolling_time_mean(df: DataFrame, value: str, keys: Sequence[str], days: int = 60, day: str = "match_date") -> DataFrame:
    """Mean of ``value`` over the trailing ``days`` days per key and day (the whole day counts)."""
    daily = df.groupBy(*keys, day).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(F.unix_date(F.col(day))).rangeBetween(-(days - 1), 0)
    return daily.select(*keys, day, (F.sum("_s").over(w) / F.sum("_n").over(w)).alias("rolling_mean"), F.col("_n").alias("rows"))


STALE_DAYS = 370


def freshness(long: DataFrame) -> DataFrame:
    """Latest match per team and overall; stale means more than 370 days behind."""
    per = long.groupBy("team").agg(F.max("match_date").alias("latest"))
    overall = per.agg(F.max("latest").alias("dataset_latest")).withColumn("_1", F.lit(1))
    out = per.withColumn("_1", F.lit(1)).join(F.broadcast(overall), "_1").drop("_1")
    gap = F.datediff("dataset_latest", "latest")
    return out.withColumns({"days_behind": gap, "stale": (gap > STALE_DAYS).cast("int")})
