"""Coaching spells, tenure features and before/after studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchframe.functions.clean import tenure_bucket
from matchframe.operators.joins import active_interval_join, asof_last
from matchframe.operators.longform import to_wide
from matchframe.operators.rolling import zero
from matchframe.operators.windows import History, fits_whole, real_row
from matchframe.plans.stages import staged
from matchframe.settings import chunk_days


def mark_runs(rows: DataFrame, value: str = "manager", whole: bool = False) -> DataFrame:
    """Number the runs of equal consecutive ``value`` per team: adds ``run`` and ``is_change``.

    With ``whole`` (``windows.fits_whole`` of the rows) a team is one slice.
    """
    h = History(rows, ["team"], rows=1, whole=whole)
    w = h.ordered()
    before = F.lag(real_row(F.coalesce(F.col(value), F.lit("")))).over(w)
    first = F.lag(real_row(F.lit(1))).over(w).isNull()
    change = (first | (before != F.coalesce(F.col(value), F.lit("")))).cast("int")
    flagged = h.real(h.frame.withColumn("is_change", change))
    runs = History(flagged, ["team"], totals={"_c": F.col("is_change")}, whole=whole)
    return runs.real(runs.frame.withColumn("run", F.sum("_c").over(runs.running_inclusive()))).drop("_c")


def manager_spells(rows: DataFrame) -> DataFrame:
    """(team, manager, start_date, end_date): a spell ends the day before the next one starts.  Runs a job."""
    starts = staged(mark_runs(rows).where("is_change = 1").select("team", "manager", "run", F.col("match_date").alias("start_date")))
    following = starts.select("team", (F.col("run") - 1).alias("run"), F.date_sub("start_date", 1).alias("end_date"))
    return starts.join(following, ["team", "run"], "left").select("team", "manager", "start_date", "end_date")


def manager_stability(long: DataFrame, spells: DataFrame) -> DataFrame:
    """Earlier matches of the team since the start of the spell active on the day; 0 without one.

    A difference of running counts, so no match is listed per spell.
    """
    h = History(long.select("match_id", "is_home", "team", "match_date"), ["team"], totals={"_n": F.lit(1)})
    counted = h.real(h.frame.withColumn("before", F.coalesce(F.sum("_n").over(h.running()), F.lit(0)))).drop("_n")
    days = counted.groupBy("team", "match_date").agg((F.max("before") + 1).alias("upto"))
    dated = spells.select("team", F.col("start_date").alias("match_date"), "end_date").withColumn("match_id", F.lit(0))
    at_start = asof_last(dated, days, value=["upto"]).select(
        "team", F.col("match_date").alias("start_date"), "end_date", F.coalesce("upto", F.lit(0)).alias("at_start")
    )
    hit = active_interval_join(counted, at_start, known="start_date", start="start_date", end="end_date")
    latest = hit.groupBy("match_id", "is_home").agg(F.max_by(F.col("before") - F.col("at_start"), "start_date").alias("n"))
    out = counted.join(latest, ["match_id", "is_home"], "left")
    return out.select("match_id", "is_home", "team", F.coalesce("n", F.lit(0)).alias("manager_stability_score"))


MANAGER = (
    "manager_tenure_days", "manager_matches_in_charge", "manager_change_last_30d", "manager_change_last_60d",
    "new_manager_first_5_matches", "new_manager_first_10_matches", "caretaker_manager", "manager_tenure_bucket",
    "manager_data_available", "manager_points_per_game_before_match", "manager_xg_diff_before_match",
    "manager_team_form_since_appointment", "manager_elo_change_since_appointment",
)
GAPS = {
    "manager_continuity_gap": "manager_tenure_days",
    "manager_experience_gap": "manager_matches_in_charge",
    "manager_ppg_gap": "manager_points_per_game_before_match",
    "manager_xg_diff_gap": "manager_xg_diff_before_match",
}


_STATE = ("manager", "run", "n", "p", "x", "e", "form")


def _states(marked: DataFrame, value: dict[str, Column], whole: bool) -> DataFrame:
    """Matches, results and form of the run up to and with each match; of whole teams also its first day."""
    h = History(marked, ["team", "run"], rows=5, totals={"_n": F.lit(1), **{"_t" + k: F.col("_v" + k) for k in value}}, whole=whole)
    upto = h.running_inclusive()
    cols = {
        "n": F.sum("_n").over(upto),
        "form": F.avg(real_row(F.col("_vp"))).over(h.ordered().rowsBetween(-4, 0)),
        **{k: F.sum("_t" + k).over(upto) for k in value},
    }
    if whole:
        cols["run_start"] = F.first("match_date").over(upto)
    return h.real(h.frame.withColumns(cols))


def _last_state_whole(rows: DataFrame, value: dict[str, Column]) -> DataFrame:
    """Rows with ``_now`` and the state ``_p_...`` and ``run_start`` of the team's last match before the day, if any, of ``asof_day``.

    A team's rows are shuffled once and stay in one place for all windows.
    """
    keep = [*_STATE, "run_start"]
    state = _states(mark_runs(rows, whole=True), value, True)
    # No team has no runs, and a match without id no say.
    state = state.withColumn("run_start", F.when(F.col("team").isNotNull(), F.col("run_start")))
    last = F.struct(F.col("match_date").alias("asof_day"), "match_id", F.when(F.col("match_id").isNotNull(), F.struct(*keep)).alias("s"))
    earlier = Window.partitionBy("team").orderBy(F.unix_date("match_date")).rangeBetween(Window.unboundedPreceding, -1)
    seen = state.select("match_id", "is_home", "team", "match_date", F.col("manager").alias("_now"), F.max(last).over(earlier).alias("_last"))
    # Rows without a team see no further back than the slice of days that they are in, as in ``_last_state``.
    width = chunk_days(rows.sparkSession)
    near = F.floor((F.unix_date("_last.asof_day") + 1) / width) == F.floor(F.unix_date("match_date") / width)
    seen = seen.withColumn("_last", F.when(F.col("team").isNotNull() | near, F.col("_last")))
    picked = [F.col(f"_last.s.{c}").alias(c if c == "run_start" else "_p_" + c) for c in keep]
    return seen.select("match_id", "is_home", "team", "match_date", "_now", F.col("_last.asof_day").alias("asof_day"), *picked)


def _last_state(rows: DataFrame, value: dict[str, Column]) -> DataFrame:
    """``_last_state_whole`` for teams of any size, in slices.  Runs two jobs."""
    marked = staged(mark_runs(rows))
    state = _states(marked, value, False)
    starts = marked.where("is_change = 1").select("team", "run", F.col("match_date").alias("run_start"))
    per_day = state.groupBy("team", "match_date").agg(F.max_by(F.struct(*_STATE), "match_id").alias("s")).select("team", "match_date", "s.*")
    per_day = staged(per_day)
    asks = rows.select("match_id", "is_home", "team", "match_date", F.col("manager").alias("_now"))
    facts = per_day.select("team", "match_date", *[F.col(c).alias("_p_" + c) for c in _STATE])
    seen = asof_last(asks, facts, ties=("match_id", "is_home"), value=["_p_" + c for c in _STATE])
    return seen.join(starts.select("team", F.col("run").alias("_p_run"), "run_start"), ["team", "_p_run"], "left")


def manager_features(rows: DataFrame) -> DataFrame:
    """Tenure and results of the current coach's unbroken run before each match day.

    ``rows``: long rows with ``manager`` and ``elo_trend``.  The run is that of
    the team's last match before the day, if its coach is still in charge; the
    Elo figure sums the trends of the run's matches.  Counts the rows of each team;
    if some team has many, runs two more jobs: the marked rows and the state per day
    are read several times.
    """
    value = {"p": F.col("points").cast("double"), "x": F.col("xgf") - F.col("xga"), "e": zero(F.col("elo_trend"))}
    thin = rows.select("match_id", "is_home", "team", "match_date", "manager", *[c.alias("_v" + k) for k, c in value.items()])
    # Every match is asked for and tells the later ones.
    seen = _last_state_whole(thin, value) if fits_whole(["team"], rows, rows) else _last_state(thin, value)
    now = F.coalesce(F.col("_now"), F.lit(""))
    same = (F.coalesce(F.col("_p_manager"), F.lit("")) == now) & F.col("asof_day").isNotNull()
    changed = F.col("asof_day").isNotNull() & ~same
    known = now != ""

    def held(c: Column) -> Column:
        return F.when(same, c).otherwise(0.0)

    days = held(F.datediff("match_date", "run_start").cast("double"))
    n = held(F.col("_p_n").cast("double"))
    cols = {
        "manager_tenure_days": days,
        "manager_matches_in_charge": n,
        "manager_change_last_30d": (changed | (days <= 30)).cast("double"),
        "manager_change_last_60d": (changed | (days <= 60)).cast("double"),
        "new_manager_first_5_matches": (n < 5).cast("double"),
        "new_manager_first_10_matches": (n < 10).cast("double"),
        "caretaker_manager": F.lit(0.0),
        "manager_tenure_bucket": tenure_bucket(days).cast("double"),
        "manager_data_available": F.lit(1.0),
        "manager_points_per_game_before_match": held(F.col("_p_p") / F.col("_p_n")),
        "manager_xg_diff_before_match": held(F.col("_p_x") / F.col("_p_n")),
        "manager_team_form_since_appointment": held(F.col("_p_form")),
        "manager_elo_change_since_appointment": held(F.col("_p_e")),
    }
    wide = to_wide(seen.withColumns({k: F.when(known, c).otherwise(0.0) for k, c in cols.items()}), MANAGER)
    return wide.withColumns({g: F.col("home_" + c) - F.col("away_" + c) for g, c in GAPS.items()})


def event_study(long: DataFrame, events: DataFrame) -> DataFrame:
    """Five matches before and the first 5 and 10 from each team's event on: ``events(team, start_date)``.

    The pre-shuffle limit keeps at most fifteen rows per team.
    """
    rows = long.join(events, "team").withColumns({"_gd": F.col("gf") - F.col("ga"), "_xd": F.col("xgf") - F.col("xga")})
    near = [F.col("match_date"), F.col("match_id")]
    past = Window.partitionBy("team").orderBy(*[c.desc() for c in near])
    future = Window.partitionBy("team").orderBy(*near)
    before = rows.where("match_date < start_date").withColumn("_rn", F.row_number().over(past)).where("_rn <= 5")
    after = rows.where("match_date >= start_date").withColumn("_rn", F.row_number().over(future)).where("_rn <= 10")
    both = before.withColumn("_w", F.lit("before")).unionByName(after.withColumn("_w", F.lit("after")))
    windows = {
        "before_5": F.col("_w") == "before",
        "after_5": (F.col("_w") == "after") & (F.col("_rn") <= 5),
        "after_10": F.col("_w") == "after",
    }
    aggs = []
    for name, cond in windows.items():
        aggs.append(F.sum(cond.cast("double")).alias(f"{name}_matches"))
        for label, c in (("ppg", "points"), ("goal_diff_per_match", "_gd"), ("xg_diff_per_match", "_xd")):
            aggs.append(zero(F.avg(F.when(cond, F.col(c)))).alias(f"{name}_{label}"))
    stats = both.groupBy("team").agg(*aggs)
    names = [f"{w}_{m}" for w in windows for m in ("matches", "ppg", "goal_diff_per_match", "xg_diff_per_match")]
    return events.join(stats, "team", "left").na.fill(0.0, names)


def latest_changes(spells: DataFrame) -> DataFrame:
    """The last spell of each team as the event to study."""
    return spells.groupBy("team").agg(
        F.max_by("manager", "start_date").alias("manager"), F.max("start_date").alias("start_date")
    )
