"""Line-up continuity, familiarity and rotation before each match.

``appearances``: (team, match_date, player, position_group, started, minutes,
lineup_type, source_collected_at).  A line-up is a set of at most eleven starters
plus substitutes, so one line-up per (team, day) fits in an array.  Collection
dates are taken to be one per line-up and to grow with the match date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchframe.operators.joins import asof_last, lineup_pairs
from matchframe.operators.longform import to_wide
from matchframe.operators.rolling import zero
from matchframe.operators.windows import History, fits_whole, real_row
from matchframe.plans.stages import staged

GROUPS = {"same_back_four": "defender", "same_midfield": "midfielder", "same_attack": "attacker"}
SIZE = 11


def lineup_sets(appearances: DataFrame) -> DataFrame:
    """One row per (team, day): starters as sets, overall and per line."""
    started = F.col("started") >= 1
    return appearances.groupBy("team", "match_date").agg(
        F.max("source_collected_at").alias("collected"),
        F.sort_array(F.collect_set(F.when(started, F.col("player")))).alias("xi"),
        *[
            F.sort_array(F.collect_set(F.when(started & (F.col("position_group") == g), F.col("player")))).alias("xi_" + g)
            for g in GROUPS.values()
        ],
    )


_SETS = ["xi", *["xi_" + g for g in GROUPS.values()]]


def known_lineups(appearances: DataFrame) -> DataFrame:
    """``lineup_sets``, and beside each the sets of the starters that were expected before the day (``e_``; null without any).

    One reading and grouping of the appearances for all that follows.  Runs a job.
    """
    kind = F.lower(F.coalesce(F.col("lineup_type"), F.lit(""))).isin("expected", "projected")
    early = F.col("source_collected_at").isNull() | (F.col("source_collected_at") < F.col("match_date"))
    started = F.col("started") >= 1
    expected = F.coalesce(kind & early & started, F.lit(False))
    some = {"xi": F.lit(True), **{"xi_" + g: F.col("position_group") == g for g in GROUPS.values()}}
    sets = [F.sort_array(F.collect_set(F.when(started & of, F.col("player")))).alias(c) for c, of in some.items()]
    sets += [F.when(F.max(expected), F.sort_array(F.collect_set(F.when(expected & of, F.col("player"))))).alias("e_" + c) for c, of in some.items()]
    return staged(appearances.groupBy("team", "match_date").agg(F.max("source_collected_at").alias("collected"), *sets))


def current_and_previous(asks: DataFrame, appearances: DataFrame, lineups: DataFrame | None = None) -> DataFrame:
    """The line-up in sight for each ask (expected for the day, else latest known) and the one before it.

    ``lineups`` are the ``known_lineups`` of the appearances, if they are at hand.  Runs jobs: the line-ups and the chosen
    ones are staged, as they are read several times.
    """
    lineups = known_lineups(appearances) if lineups is None else lineups
    facts = lineups.drop(*["e_" + c for c in _SETS])
    whole = fits_whole(["team"], asks, facts)
    latest = asof_last(asks, facts, ties=("match_id", "is_home"), value=_SETS, known="collected", whole=whole)
    expected = lineups.where(F.col("e_xi").isNotNull()).select("team", "match_date", *["e_" + c for c in _SETS])
    both = latest.join(expected, ["team", "match_date"], "left")
    has = F.col("e_xi").isNotNull()
    chosen = both.withColumns(
        {
            "lineup_day": F.when(has, F.col("match_date")).when(F.size("xi") > 0, F.col("asof_day")),
            **{"c_" + c: F.when(has, F.col("e_" + c)).otherwise(F.col(c)) for c in _SETS},
        }
    ).select(*asks.columns, "lineup_day", *["c_" + c for c in _SETS])
    chosen = staged(chosen)
    known = chosen.where("lineup_day IS NOT NULL")
    moved = known.select("match_id", "is_home", "team", F.col("lineup_day").alias("match_date"))
    prev = asof_last(moved, facts, ties=("match_id", "is_home"), value=_SETS, known="collected", whole=whole)
    prev = prev.select("match_id", "is_home", *[F.col(c).alias("p_" + c) for c in _SETS])
    return chosen.join(prev, ["match_id", "is_home"], "left")


def _overlap(a: str, b: str) -> Column:
    return F.coalesce(F.size(F.array_intersect(a, b)), F.lit(0)).cast("double")


CONTINUITY = (
    "starting_xi_repeat_count", "starting_xi_repeat_pct", "lineup_changes", "same_back_four", "same_midfield",
    "same_attack", "starters_from_last_win", "lineup_similarity_last_win", "days_since_last_win",
)


def continuity_rows(long: DataFrame, appearances: DataFrame, lineups: DataFrame | None = None) -> DataFrame:
    """Repeat counts against the previous line-up and the last winning one, per team-match."""
    thin = long.select("match_id", "is_home", "team", "match_date", "points")
    h = History(thin, ["team"], rows=1, rows_where=F.col("points") == 3, whole=fits_whole(["team"], long))
    won = F.max(real_row(F.when(F.col("points") == 3, F.col("match_date")))).over(h.running())
    asks = h.real(h.frame.withColumn("win_day", won)).drop("points")
    lineups = known_lineups(appearances) if lineups is None else lineups
    rows = current_and_previous(asks, appearances, lineups)
    win = lineups.select("team", F.col("match_date").alias("win_day"), F.col("xi").alias("w_xi"))
    rows = rows.join(win, ["team", "win_day"], "left")
    repeat, shared = _overlap("c_xi", "p_xi"), _overlap("c_xi", "w_xi")
    cols = {
        "starting_xi_repeat_count": repeat,
        "starting_xi_repeat_pct": repeat / SIZE,
        "lineup_changes": F.greatest(F.lit(0.0), SIZE - repeat),
        **{name: _overlap("c_xi_" + g, "p_xi_" + g) for name, g in GROUPS.items()},
        "starters_from_last_win": shared,
        "lineup_similarity_last_win": shared / SIZE,
        "days_since_last_win": F.coalesce(F.datediff("match_date", "win_day").cast("double"), F.lit(365.0)),
    }
    has = F.col("lineup_day").isNotNull()
    return rows.withColumns({k: F.when(has, c).otherwise(0.0) for k, c in cols.items()})


def lineup_continuity(long: DataFrame, appearances: DataFrame) -> DataFrame:
    return to_wide(continuity_rows(long, appearances), CONTINUITY)


def pair_history(appearances: DataFrame) -> DataFrame:
    """Joint starts and minutes of each pair up to and including each day it becomes known.  Runs a job."""
    return _pair_history(appearances)[0]


def _pair_history(appearances: DataFrame) -> tuple[DataFrame, bool]:
    """``pair_history``, and whether a team's rows of it fit into one slice."""
    s = appearances.where("started >= 1").groupBy("team", "match_date", "player").agg(
        F.max("minutes").alias("minutes"), F.max("source_collected_at").alias("c")
    )
    pairs = lineup_pairs(s, ["team", "match_date"]).select(
        "team", F.col("player_a").alias("a"), F.col("player_b").alias("b"),
        F.greatest("match_date", F.coalesce(F.greatest("c_a", "c_b"), "match_date")).alias("match_date"),
        F.least("minutes_a", "minutes_b").cast("double").alias("m"),
    )
    daily = staged(pairs.groupBy("team", "a", "b", "match_date").agg(F.count("*").alias("n"), F.sum("m").alias("m")))
    # All pairs of a team together, as that takes no grouping by pair.
    whole = fits_whole(["team"], daily)
    h = History(daily, ["team", "a", "b"], ties=(), totals={"_n": F.col("n"), "_m": F.col("m")}, whole=whole)
    upto = h.running_inclusive()
    out = h.real(h.frame.withColumns({"starts": F.sum("_n").over(upto), "minutes": F.sum("_m").over(upto)}))
    return out.select("team", "a", "b", "match_date", "starts", "minutes"), whole


FAMILIARITY = ("shared_starts_score", "shared_minutes_score", "lineup_familiarity_score")


def familiarity_rows(asks: DataFrame, appearances: DataFrame) -> DataFrame:
    """Joint starts and minutes summed over the pairs of the line-up in sight.

    ``asks`` carries the sorted line-up ``c_xi``; each has at most 55 pairs.
    """
    i = F.sequence(F.lit(0), F.size("c_xi") - 1)
    pairs = F.flatten(
        F.transform(
            i,
            lambda j: F.transform(
                F.slice(F.col("c_xi"), j + 2, F.size("c_xi")),
                lambda b: F.struct(F.get(F.col("c_xi"), j).alias("a"), b.alias("b")),
            ),
        )
    )
    known = asks.where(F.col("lineup_day").isNotNull() & (F.size("c_xi") >= 2))
    listed = known.select("match_id", "is_home", "team", "match_date", F.inline(pairs))
    history, whole = _pair_history(appearances)
    # A match asks for a pair once at most.
    whole = whole and fits_whole(["team"], known)
    seen = asof_last(
        listed, history, keys=("team", "a", "b"), ties=("match_id", "is_home"), value=["starts", "minutes"], whole=whole
    )
    sums = seen.groupBy("match_id", "is_home").agg(
        F.coalesce(F.sum("starts"), F.lit(0)).cast("double").alias("shared_starts_score"),
        zero(F.sum("minutes")).alias("shared_minutes_score"),
    )
    out = asks.join(sums, ["match_id", "is_home"], "left").na.fill(0.0, ["shared_starts_score", "shared_minutes_score"])
    return out.withColumn(
        "lineup_familiarity_score", F.log1p("shared_starts_score") + F.log1p("shared_minutes_score") / 10.0
    )


def lineup_familiarity(long: DataFrame, appearances: DataFrame) -> DataFrame:
    asks = current_and_previous(long.select("match_id", "is_home", "team", "match_date"), appearances)
    return to_wide(familiarity_rows(asks, appearances), FAMILIARITY)


def rotation_facts(appearances: DataFrame, lineups: DataFrame | None = None) -> DataFrame:
    """Mean of the last 10 changes between consecutive line-ups, at each line-up.  Runs jobs."""
    lineups = known_lineups(appearances) if lineups is None else lineups
    sets = lineups.where(F.size("xi") > 0).select("team", "match_date", "collected", "xi")
    whole = fits_whole(["team"], sets)
    step = History(sets, ["team"], ties=(), rows=1, whole=whole)
    before = F.lag(real_row(F.col("xi"))).over(step.ordered())
    change = F.greatest(F.lit(0), SIZE - F.size(F.array_intersect("xi", "_b"))).cast("double")
    moved = step.real(step.frame.withColumn("_b", before)).withColumn(
        "change", F.when(F.col("_b").isNotNull(), change)
    ).drop("_b", "xi")
    h = History(moved if whole else staged(moved), ["team"], ties=(), rows=10, whole=whole)
    mean = F.avg(real_row(F.col("change"))).over(h.ordered().rowsBetween(-9, 0))
    return h.real(h.frame.withColumn("rotation", mean)).drop("change")


ROTATION = ("lineup_rotation_rate", "squad_consistency_score")


def rotation_rows(rows: DataFrame, appearances: DataFrame, lineups: DataFrame | None = None) -> DataFrame:
    """Adds the rotation rate and the consistency score to continuity rows."""
    asks = rows.select("match_id", "is_home", "team", "match_date")
    lineups = known_lineups(appearances) if lineups is None else lineups
    facts = rotation_facts(appearances, lineups)
    whole = fits_whole(["team"], asks, lineups)
    rate = asof_last(asks, facts, ties=("match_id", "is_home"), value=["rotation"], known="collected", whole=whole)
    out = rows.join(rate.select("match_id", "is_home", "rotation"), ["match_id", "is_home"])
    has = F.col("lineup_day").isNotNull()
    rot = F.when(has, zero(F.col("rotation"))).otherwise(0.0)
    score = F.greatest(F.lit(0.0), 100.0 - 7.0 * rot + 20.0 * F.col("starting_xi_repeat_pct"))
    return out.withColumns({"lineup_rotation_rate": rot, "squad_consistency_score": F.when(has, score).otherwise(0.0)})


def lineup_rotation(long: DataFrame, appearances: DataFrame) -> DataFrame:
    lineups = known_lineups(appearances)
    rows = continuity_rows(long, appearances, lineups).select("match_id", "is_home", "team", "match_date", "lineup_day", "starting_xi_repeat_pct")
    return to_wide(rotation_rows(staged(rows), appearances, lineups), ROTATION)
