"""Leak-free rolling features per team: form, schedule, shots, draws, venue, pairs.

Every function reads the long table of ``longform.to_long`` (or the match table)
and returns one row per match.  Only rows before the match in (date, match_id)
order, or before its day for calendar windows, are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchframe.functions.clean import (
    fixture_congestion,
    low_total_profile,
    meeting_strength,
    outcome_label,
    safe_divide,
    similarity_gap,
)
from matchframe.operators.longform import to_wide
from matchframe.operators.windows import REAL, History, fits_whole, real_row

TEAM = ["team"]
BASE = ("match_id", "match_date", "season", "team", "is_home")


def narrow(long: DataFrame, *columns: str) -> DataFrame:
    """Only what a feature needs: copied look-back rows travel whole, so keep them thin."""
    return long.select(*BASE, *columns)


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _labels() -> dict[str, Column]:
    """The outcome label and the constant home advantage, kept through the regrouping."""
    return {"target": outcome_label("result"), "home_advantage": F.lit(1)}


# --- form, xG and schedule -------------------------------------------------

FORM = ("points_last_5", "goals_scored_avg")
XG = ("xg_avg", "xga_avg", "xg_diff")
SCHEDULE = ("days_rest", "matches_last_14_days", "had_midweek_match", "days_since_last_match")
SHOT_VOLUME = tuple(f"{m}_avg_{w}" for m in ("shots", "shots_on_target") for w in ("last5", "last10", "season"))


def _midweek(day: Column) -> Column:
    return F.weekday(day).isin(1, 2, 3).cast("int")


def form_columns(h: History) -> dict[str, Column]:
    w = h.last(5)
    return {
        "points_last_5": F.coalesce(F.sum(real_row(F.col("points"))).over(w), F.lit(0)),
        "goals_scored_avg": zero(F.avg(real_row(F.col("gf"))).over(w)),
    }


def xg_columns(h: History) -> dict[str, Column]:
    w = h.last(5)
    return {name: zero(F.avg(real_row(F.col(c))).over(w)) for name, c in (("xg_avg", "xgf"), ("xga_avg", "xga"))}


def schedule_columns(h: History) -> dict[str, Column]:
    """Rest since the previous row (14 without one), load and weekday-based midweek flag."""
    prev = F.max(real_row(F.col("match_date"))).over(h.last(1))
    rest = F.coalesce(F.datediff("match_date", prev).cast("double"), F.lit(14.0))
    return {
        "days_rest": rest,
        "matches_last_14_days": F.coalesce(F.sum("_played").over(h.within_days(1, 14)), F.lit(0)),
        "had_midweek_match": (F.coalesce(F.sum("_played_mid").over(h.within_days(1, 7)), F.lit(0)) > 0).cast("int"),
    }


# Columns that follow from window columns; kept out of the window step so that no window is computed twice.
_DERIVED = {
    "xg_diff": (("xg_avg", "xga_avg"), lambda: F.col("xg_avg") - F.col("xga_avg")),
    "days_since_last_match": (("days_rest",), lambda: F.col("days_rest")),
}


def _day_counts() -> dict[str, Column]:
    return {"_played": F.lit(1), "_played_mid": _midweek(F.col("match_date"))}


def _features(long: DataFrame, rows: int, blocks: list, days: int = 0, labels: bool = False) -> DataFrame:
    thin = narrow(long, "result", "points", "gf", "xgf", "xga")
    h = History(thin, TEAM, rows=rows, days=days, day_sums=_day_counts() if days else None, whole=fits_whole(TEAM, long))
    cols: dict[str, Column] = {}
    for block in blocks:
        cols.update(block(h))
    more = {name: make() for name, (need, make) in _DERIVED.items() if set(need) <= set(cols)}
    rows_out = h.real(h.frame.withColumns(cols)).withColumns(more)
    return to_wide(rows_out, [*cols, *more], shared=_labels() if labels else None)


def form_features(long: DataFrame) -> DataFrame:
    return _features(long, 5, [form_columns], labels=True)


def xg_features(long: DataFrame) -> DataFrame:
    return _features(long, 5, [xg_columns])


def schedule_features(long: DataFrame) -> DataFrame:
    return _features(long, 1, [schedule_columns], days=14)


def match_features(long: DataFrame) -> DataFrame:
    """Form, xG and schedule in one pass over one partitioning."""
    return _features(long, 5, [form_columns, xg_columns, schedule_columns], days=14, labels=True)


# --- shots -----------------------------------------------------------------

MIN_SEASON_ROWS = 5


def _valid_shots() -> Column:
    return F.col("sf").isNotNull() & F.col("sotf").isNotNull()


def _shot_totals() -> dict[str, Column]:
    ok = _valid_shots()
    return {"_n": F.when(ok, 1), "_s": F.when(ok, F.col("sf").cast("double")), "_t": F.when(ok, F.col("sotf").cast("double"))}


def _valid_rows(h: History) -> Column:
    """Rows with shots before this one: valid row number j has j - 1, so a RANGE over it counts valid rows only."""
    return F.coalesce(F.sum(real_row(F.when(_valid_shots(), 1))).over(h.running()), F.lit(0))


def _shot_columns(h: History) -> dict[str, Column]:
    """Window columns of a history with ``_shot_totals`` by season and ``_valid_rows`` as ``_k``."""
    by_count = h.part().orderBy("_k")
    cols: dict[str, Column] = {}
    season = h.running(["season"])
    n = F.coalesce(F.sum("_n").over(season), F.lit(0))
    for name, src, tot in (("shots", "sf", "_s"), ("shots_on_target", "sotf", "_t")):
        value = F.when(_valid_shots(), real_row(F.col(src).cast("double")))
        cols[f"{name}_avg_last5"] = zero(F.avg(value).over(by_count.rangeBetween(-5, -1)))
        cols[f"{name}_avg_last10"] = zero(F.avg(value).over(by_count.rangeBetween(-10, -1)))
        cols["_sum" + tot] = F.sum(tot).over(season)
    cols["_season_n"] = n
    return cols


def _season_means() -> dict[str, Column]:
    full = F.col("_season_n") >= MIN_SEASON_ROWS
    return {
        f"{name}_avg_season": F.when(full, F.col("_sum" + tot) / F.col("_season_n")).otherwise(F.col(f"{name}_avg_last10"))
        for name, tot in (("shots", "_s"), ("shots_on_target", "_t"))
    }


def shot_volume_features(long: DataFrame) -> DataFrame:
    """Means over rows that have both shots and shots on target.

    The season mean falls back to the last 10 such rows of any season while the
    season has fewer than five.
    """
    h = History(
        narrow(long, "sf", "sotf"), TEAM, rows=10, rows_where=_valid_shots(), totals=_shot_totals(), totals_by=["season"],
        whole=fits_whole(TEAM, long),
    )
    rows = h.real(h.frame.withColumn("_k", _valid_rows(h)).withColumns(_shot_columns(h)))
    return to_wide(rows.withColumns(_season_means()), SHOT_VOLUME)


def match_and_shot_features(long: DataFrame) -> DataFrame:
    """``match_features`` and ``shot_volume_features`` of a match; teams with few rows are sorted and regrouped once for both."""
    if not fits_whole(TEAM, long):
        return match_features(long).join(shot_volume_features(long), "match_id")
    thin = narrow(long, "result", "points", "gf", "xgf", "xga", "sf", "sotf")
    h = History(thin, TEAM, day_sums=_day_counts(), totals=_shot_totals(), totals_by=["season"], whole=True)
    cols = {**form_columns(h), **xg_columns(h), **schedule_columns(h)}
    more = {name: make() for name, (_, make) in _DERIVED.items()}
    rows = h.real(h.frame.withColumn("_k", _valid_rows(h)).withColumns({**cols, **_shot_columns(h)}))
    names = [*cols, *more, *SHOT_VOLUME]
    # A side's columns meet the other side's as one value: two to regroup, not two of each.
    packed = rows.withColumns({**more, **_season_means()}).withColumn("_side", F.struct(*names))
    wide = to_wide(packed, ["_side"], shared=_labels())
    return wide.select("match_id", *[F.col(f"{side}__side.{c}").alias(f"{side}_{c}") for c in names for side in ("home", "away")], *_labels())


EFFICIENCY = (
    "shots_avg", "shots_on_target_avg", "shot_accuracy", "goals_per_shot", "goals_per_shot_on_target",
    "xg_per_shot", "goals_minus_xg", "shots_allowed_avg", "shots_on_target_allowed_avg",
    "opponent_shot_accuracy", "xga_per_shot_allowed",
)


def shot_efficiency(long: DataFrame) -> DataFrame:
    """Ratios of sums over the last 5, the last 10 and the season so far."""
    src = {"_s": "sf", "_t": "sotf", "_g": "gf", "_x": "xgf", "_sa": "sa", "_ta": "sota", "_xa": "xga"}
    measures = {k: F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for k, v in src.items()}
    h = History(
        narrow(long, *src.values()).withColumns({k + "r": v for k, v in measures.items()}),
        TEAM,
        rows=10,
        totals={**measures, "_n": F.lit(1)},
        totals_by=["season"],
    )
    windows = {"last5": h.last(5), "last10": h.last(10), "season": h.running(["season"])}
    sums: dict[str, Column] = {}
    for suffix, w in windows.items():
        for k in measures:
            value = F.col(k) if suffix == "season" else real_row(F.col(k + "r"))
            sums[f"{k}_{suffix}"] = F.sum(value).over(w)
        sums[f"_n_{suffix}"] = F.sum("_n").over(w) if suffix == "season" else F.count(real_row(F.lit(1))).over(w)
    # Window sums first, ratios in a second projection: each sum is computed once.
    summed = h.real(h.frame.withColumns(sums)).na.fill(0, list(sums))
    cols: dict[str, Column] = {}
    for suffix in windows:
        g, x, s, t, sa, ta, xa, n = (F.col(f"{k}_{suffix}") for k in ("_g", "_x", "_s", "_t", "_sa", "_ta", "_xa", "_n"))
        values = (
            (s, n), (t, n), (t, s), (g, s), (g, t), (x, s), (g - x, n), (sa, n), (ta, n), (ta, sa), (xa, sa),
        )
        for name, (num, den) in zip(EFFICIENCY, values, strict=True):
            cols[f"{name}_{suffix}"] = safe_divide(num, den)
    return to_wide(summed.withColumns(cols), list(cols))


# --- calendar load with extra competitions ---------------------------------

FATIGUE = (
    "days_rest", "had_midweek_match", "matches_last_14_days", "matches_last_30_days",
    "days_since_last_match", "fixture_congestion_score",
)
EUROPE = ("played_europe_midweek", "days_since_europe_match", "european_fixture_load")


def calendar_load(long: DataFrame, extra: DataFrame | None = None, include_extra: bool = True) -> DataFrame:
    """Per team-match load over league dates and distinct ``extra(team, match_date)`` dates."""
    league = long.select("match_id", "match_date", "team", "is_home", F.lit(0).alias("_x"))
    rows = league
    if extra is not None:
        rows = league.unionByName(
            extra.select("team", "match_date").distinct().withColumn("_x", F.lit(1)), allowMissingColumns=True
        )
    ex = F.col("_x") == 1
    counts = {
        "_all": F.lit(1) if include_extra else F.when(~ex, 1).otherwise(0),
        "_extra": F.when(ex, 1).otherwise(0),
        "_xmid": F.when(ex, _midweek(F.col("match_date"))).otherwise(0),
    }
    # Latest earlier day of each kind: a calendar frame over day numbers, whose
    # context is one maximum per (team, slice).
    h = History(rows, TEAM, ties=["_x", "match_id"], days=30, day_sums=counts)
    frame = h.frame.join(_last_days_before_slice(rows, h, include_extra), ["team", "_chunk"], "left")
    day = F.unix_date("match_date")
    upto_yesterday = h.part().orderBy(day).rangeBetween(-10_000_000, -1)
    real = F.col("_ctx") == REAL
    in_rest = real if include_extra else real & ~ex
    last_any = F.coalesce(F.max(F.when(in_rest, day)).over(upto_yesterday), F.col("_before_any"))
    last_extra = F.coalesce(F.max(F.when(real & ex, day)).over(upto_yesterday), F.col("_before_extra"))

    def load(name: str, n: int) -> Column:
        return F.coalesce(F.sum(name).over(h.within_days(1, n)), F.lit(0)).cast("double")

    cols = {
        "days_rest": F.coalesce((day - last_any).cast("double"), F.lit(14.0)),
        "matches_last_14_days": load("_all", 14),
        "matches_last_30_days": load("_all", 30),
        "played_europe_midweek": (load("_xmid", 7) > 0).cast("int"),
        "days_since_europe_match": F.coalesce((day - last_extra).cast("double"), F.lit(60.0)),
        "european_fixture_load": load("_extra", 30),
    }
    rest = F.col("days_rest")
    more = {
        "had_midweek_match": (rest <= 4).cast("int"),
        "days_since_last_match": rest,
        "fixture_congestion_score": fixture_congestion(rest, F.col("matches_last_14_days"), F.col("matches_last_30_days")),
    }
    rows = h.real(frame.withColumns(cols)).where("_x = 0").withColumns(more)
    return rows.select("match_id", "team", "is_home", *cols, *more)


def _last_days_before_slice(rows: DataFrame, h: History, include_extra: bool) -> DataFrame:
    day = F.unix_date("match_date")
    per = (
        rows.withColumn("_chunk", h.slice_of(F.col("match_date")))
        .groupBy("team", "_chunk")
        .agg(
            F.max(day if include_extra else F.when(F.col("_x") == 0, day)).alias("a"),
            F.max(F.when(F.col("_x") == 1, day)).alias("b"),
        )
    )
    prior = Window.partitionBy("team").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(
        "team", "_chunk", F.max("a").over(prior).alias("_before_any"), F.max("b").over(prior).alias("_before_extra")
    )


def fatigue_features(long: DataFrame, extra: DataFrame | None = None, include_extra: bool = True) -> DataFrame:
    return to_wide(calendar_load(long, extra, include_extra), FATIGUE)


def europe_features(long: DataFrame, extra: DataFrame) -> DataFrame:
    return to_wide(calendar_load(long, extra), EUROPE)


# --- recency weighting -----------------------------------------------------

# Weight of a match by its age in matches, before normalising.
RECENCY_SCHEMES = ("linear", "exponential", "halflife3", "halflife5")
RECENCY_MEASURES = {
    "points": "points", "goals_scored": "gf", "xg": "xgf", "xga": "xga", "shots": "sf", "shots_on_target": "sotf",
}


def _recency_weights(scheme: str, have: int) -> list[float]:
    """Normalised weights, most recent match first, for ``have`` matches."""
    base = {"exponential": 0.75, "halflife3": 0.5 ** (1 / 3), "halflife5": 0.5 ** (1 / 5)}
    raw = [have - age if scheme == "linear" else base[scheme] ** age for age in range(have)]
    return [w / sum(raw) for w in raw]


def recency_columns(frame: DataFrame, h: History, measures: dict[str, str], window: int = 5) -> tuple[DataFrame, list[str]]:
    """Weighted means of the last ``window`` rows; a null among them gives 0."""
    w = h.ordered()
    lags = {
        f"_l_{name}": F.array(*[F.lag(F.col(src).cast("double"), age + 1).over(w) for age in range(window)])
        for name, src in measures.items()
    }
    frame = h.real(frame.withColumns({"_have": F.count(real_row(F.lit(1))).over(h.last(window)), **lags}))
    out: dict[str, Column] = {}
    for scheme in RECENCY_SCHEMES:
        table = F.array(
            *[F.array(*[F.lit(float(x)) for x in _recency_weights(scheme, n)]) for n in range(1, window + 1)]
        )
        weights = F.get(table, F.col("_have") - 1)
        for name in measures:
            terms = F.zip_with(weights, F.slice(f"_l_{name}", 1, F.col("_have")), lambda x, y: x * y)
            mean = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
            out[f"{name}_weighted_{scheme}"] = F.when(F.col("_have") > 0, zero(mean)).otherwise(0.0)
    frame = frame.withColumns(out)
    if {"xg", "xga"} <= set(measures):
        diff = {
            f"xg_diff_weighted_{s}": F.col(f"xg_weighted_{s}") - F.col(f"xga_weighted_{s}") for s in RECENCY_SCHEMES
        }
        frame = frame.withColumns(diff)
        out.update(diff)
    return frame, list(out)


def recency_weighted(long: DataFrame, ratings: DataFrame | None = None, window: int = 5) -> DataFrame:
    """``ratings(match_id, team, attack_rating, defense_rating)`` adds the rating measures."""
    measures = dict(RECENCY_MEASURES)
    rows = long
    if ratings is not None:
        measures.update(attack_rating="attack_rating", defense_rating="defense_rating")
        rows = long.join(ratings, ["match_id", "team"], "left")
    h = History(narrow(rows, *measures.values()), TEAM, rows=window)
    frame, cols = recency_columns(h.frame, h, measures, window)
    return to_wide(frame, cols)


# --- venue -----------------------------------------------------------------


def venue_features(long: DataFrame) -> DataFrame:
    """Home side over its last 5 home matches, away side over its last 5 away matches."""
    h = History(narrow(long, "points", "gf", "ga", "xgf", "xga"), ["team", "is_home"], rows=5)
    w = h.last(5)
    gd = F.col("gf") - F.col("ga")
    cols = {
        "points": F.coalesce(F.sum(real_row(F.col("points"))).over(w), F.lit(0)),
        "xg": zero(F.avg(real_row(F.col("xgf"))).over(w)),
        "xga": zero(F.avg(real_row(F.col("xga"))).over(w)),
        "gd": zero(F.avg(real_row(gd)).over(w)),
    }
    rows = h.real(h.frame.withColumns({"v_" + k: c for k, c in cols.items()}))
    wide = to_wide(rows, ["v_" + k for k in cols])
    names = {"points": "points_last_5", "xg": "xg_last_5", "xga": "xga_last_5", "gd": "goal_diff"}
    return wide.select(
        "match_id",
        *[
            F.col(f"{side}_v_{k}").alias(f"{side}_{label}_{side}_matches")
            for side in ("home", "away")
            for k, label in names.items()
        ],
    )


# --- head to head ----------------------------------------------------------


def head_to_head(matches: DataFrame) -> DataFrame:
    """History of the pair, from the current home team's side.

    One history per unordered pair holds values for the lower-named team; the
    sign flips when the viewer is the other one.
    """
    first_home = F.col("home") < F.col("away")
    gd = (F.col("hg") - F.col("ag")).cast("double")
    xd = (F.col("hxg") - F.col("axg")).cast("double")
    low_win = F.when(F.col("result") == "D", F.lit(None)).otherwise((F.col("result") == "H") == first_home)
    rows = matches.withColumns(
        {
            "_a": F.least("home", "away"),
            "_b": F.greatest("home", "away"),
            "_at_low": first_home.cast("int"),
            "_gd": F.when(first_home, gd).otherwise(-gd),
            "_xd": F.when(first_home, xd).otherwise(-xd),
            "_w": F.coalesce(low_win.cast("int"), F.lit(0)),
            "_l": F.coalesce((~low_win).cast("int"), F.lit(0)),
            "_d": (F.col("result") == "D").cast("int"),
        }
    ).select("match_id", "match_date", "_a", "_b", "_at_low", "_gd", "_xd", "_w", "_l", "_d", "result", gd.alias("_g0"), xd.alias("_x0"))
    whole = fits_whole(["_a", "_b"], rows)
    h = History(
        rows.drop("result", "_g0", "_x0"),
        ["_a", "_b"],
        rows=5,
        totals={"n": F.lit(1), "nw": F.col("_w"), "nl": F.col("_l"), "nd": F.col("_d")},
        whole=whole,
    )
    # Totals per venue are separate running sums of the same pair.
    run = h.running()
    venue = History(
        rows,
        ["_a", "_b", "_at_low"],
        totals={
            "vp": F.when(F.col("result") == "H", 3).when(F.col("result") == "D", 1).otherwise(0),
            "vg": F.col("_g0"),
            "vx": F.col("_x0"),
        },
        whole=whole,
    )
    vrun = venue.running()
    venue_cols = venue.real(
        venue.frame.withColumns(
            {
                "h2h_home_venue_points": zero(F.sum("vp").over(vrun)),
                "h2h_home_venue_goal_diff": zero(F.sum("vg").over(vrun)),
                "h2h_home_venue_xg_diff": zero(F.sum("vx").over(vrun)),
            }
        )
    ).select("match_id", "h2h_home_venue_points", "h2h_home_venue_goal_diff", "h2h_home_venue_xg_diff")

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c).over(run), F.lit(0))

    def recent(c: Column, n: int) -> Column:
        return zero(F.sum(real_row(c)).over(h.last(n)))

    sides = {"win": F.col("_w"), "loss": F.col("_l")}
    cols = {"n": total("n"), "w": total("nw"), "l": total("nl"), "d": total("nd")}
    for n in (3, 5):
        cols[f"gd{n}"] = recent(F.col("_gd"), n)
        cols[f"xd{n}"] = recent(F.col("_xd"), n)
        cols[f"pl{n}"] = recent(3.0 * sides["win"] + F.col("_d"), n)
        cols[f"ph{n}"] = recent(3.0 * sides["loss"] + F.col("_d"), n)
    got = h.real(h.frame.withColumns({"_h_" + k: v for k, v in cols.items()}))

    def c(name: str) -> Column:
        return F.col("_h_" + name)

    def view(low: Column, high: Column) -> Column:
        return F.when(F.col("_at_low") == 1, low).otherwise(high)

    wins, losses, draws = view(c("w"), c("l")), view(c("l"), c("w")), c("d")
    core = got.select(
        "match_id",
        c("n").alias("h2h_matches_count"),
        wins.alias("h2h_home_wins"),
        draws.alias("h2h_draws"),
        losses.alias("h2h_away_wins"),
        (3 * wins + draws).alias("h2h_points_home_team"),
        (3 * losses + draws).alias("h2h_points_away_team"),
        meeting_strength(c("n")).alias("h2h_data_strength_score"),
        view(c("pl3"), c("ph3")).alias("h2h_last_3_points_home"),
        view(c("pl5"), c("ph5")).alias("h2h_last_5_points_home_team"),
        *[
            view(c(f"{k}{n}"), -c(f"{k}{n}")).alias(f"h2h_last_{n}_{label}")
            for k, label in (("gd", "goal_diff"), ("xd", "xg_diff"))
            for n in (3, 5)
        ],
    )
    return core.join(venue_cols, "match_id")


# --- draws -----------------------------------------------------------------


def draw_propensity(long: DataFrame) -> DataFrame:
    """Draw rates, similarity and low-scoring profiles; a null shot count zeroes its profile."""
    h = History(
        narrow(long, "is_draw", "points", "gf", "xgf", "xga", "sotf"),
        TEAM,
        rows=10,
        totals={"_n": F.lit(1), "_dr": F.col("is_draw")},
        totals_by=["season"],
    )
    w5, w10, season = h.last(5), h.last(10), h.running(["season"])

    def mean5(c: str) -> Column:
        return zero(F.avg(real_row(F.col(c).cast("double"))).over(w5))

    missing = F.count(real_row(F.when(F.col("sotf").isNull(), 1))).over(w5)
    cols = {
        "r10": zero(F.avg(real_row(F.col("is_draw"))).over(w10)),
        "rs": zero(F.sum("_dr").over(season) / F.sum("_n").over(season)),
        "xd": mean5("xgf") - mean5("xga"),
        "pt": mean5("points"),
        "xg": mean5("xgf"),
        "gl": mean5("gf"),
        "st": F.when(missing == 0, mean5("sotf")),
    }
    wide = to_wide(h.real(h.frame.withColumns(cols)), list(cols))

    def both(c: str) -> tuple[Column, Column]:
        return F.col("home_" + c), F.col("away_" + c)

    (h10, a10), (hs, as_) = both("r10"), both("rs")
    c10, cs = (h10 + a10) / 2, (hs + as_) / 2
    strength = similarity_gap(*both("xd"), 1.0)
    low_xg = low_total_profile(sum(both("xg")), 2.5)
    low_goals = low_total_profile(sum(both("gl")), 2.5)
    return wide.select(
        "match_id",
        h10.alias("home_draw_rate_last10"),
        a10.alias("away_draw_rate_last10"),
        c10.alias("combined_draw_rate_last10"),
        hs.alias("home_draw_rate_season"),
        as_.alias("away_draw_rate_season"),
        cs.alias("combined_draw_rate_season"),
        strength.alias("team_strength_similarity"),
        similarity_gap(*both("xd"), 0.75).alias("xg_diff_similarity"),
        similarity_gap(*both("pt"), 1.25).alias("form_points_similarity"),
        low_xg.alias("low_total_xg_profile"),
        low_goals.alias("low_total_goals_profile"),
        zero(low_total_profile(sum(both("st")), 8.0)).alias("low_total_shots_on_target_profile"),
        ((c10 + cs + strength + low_xg + low_goals) / 5).alias("draw_propensity_score"),
    )
