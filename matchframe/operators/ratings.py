"""Sequential ratings: each match updates both teams, so order matters within a pool.

No window expresses this.  A pool's rows are shuffled to one place, sorted there
by the engine (which spills) and folded as a stream of Arrow batches; the state
is a few numbers per team, and no group is ever held in memory.  Pools run in
parallel.  A pool beyond ``waves.STEP_ROWS`` matches is cut into steps of that size
that hand their state on, and inside a step teams that no match links are rated
side by side.  ``elo_state`` of one table is the ``state`` of the next.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchframe.functions.clean import elo_gap_bucket
from matchframe.functions.probs import with_poisson_1x2
from matchframe.operators.waves import STEP_ROWS, in_steps, needs_steps
from matchframe.operators.windows import History
from matchframe.shipping import ship


def fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable, out: T.StructType, then: Sequence[str] = ()
) -> DataFrame:
    """Stream each key's rows in order, and by ``then`` within equal ``order``, through a fresh pair from ``start()``.

    The pair is ``step(row) -> tuple | None``, called per row, and ``finish() ->
    tuples``, called once after the key's last row (or None).
    """
    names = df.columns
    n_keys, n_order = len(keys), len(order)
    at = [names.index(c) for c in (*keys, *order)]
    columns = out.names

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last, step, finish = None, None, None, None
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False, name=None):
                now = tuple(row[i] for i in at)
                if now[:n_keys] != key:
                    if finish is not None:
                        rows.extend(finish())
                    key = now[:n_keys]
                    step, finish = start()
                elif n_order and now[n_keys:] < last:
                    raise ValueError("rows of a key must arrive in order")
                last = now[n_keys:]
                got = step(row)
                if got is not None:
                    rows.append(got)
            yield pd.DataFrame(rows, columns=columns)
        if finish is not None:
            yield pd.DataFrame(list(finish()), columns=columns)

    ship(df.sparkSession)
    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order, *then)
    return placed.mapInPandas(run, out)


@dataclass(frozen=True)
class EloConfig:
    k: float = 20.0
    home_advantage: float = 50.0
    margin: bool = False
    initial: float = 1500.0
    carryover: float = 1.0

    @property
    def name(self) -> str:
        mov = "mov" if self.margin else "nomov"
        return f"k{int(self.k)}_ha{int(self.home_advantage)}_{mov}_carry{round(self.carryover * 100)}"


TREND = 5


class _Elo:
    """Rating and last five post-match ratings per team of one pool."""

    def __init__(self, cfg: EloConfig) -> None:
        self.cfg = cfg
        self.rating: dict = {}
        self.past: dict = {}
        self.season = None

    def load(self, team, rating: float, past: Iterable[float], season) -> None:
        self.rating[team], self.past[team] = rating, deque(past, TREND)
        self.season = season

    def trend(self, team) -> float:
        past = self.past.get(team, ())
        return self.rating[team] - past[0] if len(past) == TREND else 0.0

    def play(self, season, home, away, goal_diff: float) -> tuple:
        c = self.cfg
        if self.season is not None and season != self.season and c.carryover < 1.0:
            for team, r in self.rating.items():
                self.rating[team] = c.initial + c.carryover * (r - c.initial)
                if self.past[team]:
                    self.past[team].append(self.rating[team])
        self.season = season
        for team in (home, away):
            if team not in self.rating:
                self.rating[team], self.past[team] = c.initial, deque(maxlen=TREND)
        rh, ra = self.rating[home], self.rating[away]
        seen = (rh, ra, self.trend(home), self.trend(away))
        lead = rh + c.home_advantage - ra
        expected = 1.0 / (1.0 + 10.0 ** (-lead / 400.0))
        actual = 1.0 if goal_diff > 0 else 0.0 if goal_diff < 0 else 0.5
        size = abs(goal_diff)
        weight = math.log(size + 1.0) * (2.2 / (abs(lead) * 0.001 + 2.2)) if c.margin and size > 1 else 1.0
        change = c.k * weight * (actual - expected)
        self.rating[home], self.rating[away] = rh + change, ra - change
        self.past[home].append(rh + change)
        self.past[away].append(ra - change)
        return seen


class _LaggingElo(_Elo):
    """``_Elo`` for teams apart from the rest of their pool: a new season reaches a team when it plays next.

    Seasons are numbers that count up, and the state of a team holds the one that it has seen last.
    """

    def __init__(self, cfg: EloConfig) -> None:
        super().__init__(cfg)
        self.seen: dict = {}

    def load(self, team, rating: float, past: Iterable[float], season: int) -> None:
        super().load(team, rating, past, None)
        self.seen[team] = season

    def catch_up(self, team, season: int) -> None:
        c = self.cfg
        if team in self.rating and c.carryover < 1.0:
            for _ in range(season - self.seen[team]):
                self.rating[team] = c.initial + c.carryover * (self.rating[team] - c.initial)
                if self.past[team]:
                    self.past[team].append(self.rating[team])
        self.seen[team] = season

    def play(self, season: int, home, away, goal_diff: float) -> tuple:
        for team in (home, away):
            self.catch_up(team, season)
        self.season = season
        return super().play(season, home, away, goal_diff)


_RATED = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ("home_elo", "away_elo", "home_elo_trend", "away_elo_trend")]
)


def _typed(df: DataFrame, columns: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(c, df.schema[c].dataType) for c in columns]


def _elo_input(matches: DataFrame, state: DataFrame | None, more: Sequence[str] = ()) -> DataFrame:
    rows = matches.select(
        *more, "pool", "match_date", "match_id", "season", "home", "away",
        (F.col("hg") - F.col("ag")).cast("double").alias("gd"), F.lit(1).alias("_kind"),
        F.lit(None).cast("double").alias("rating"), F.lit(None).cast("array<double>").alias("past"),
    )
    if state is None:
        return rows
    # State rows come first: dated at the dawn of the pool.
    first = state.select(
        *more, "pool", F.lit("0001-01-01").cast("date").alias("match_date"), F.lit(0).cast(matches.schema["match_id"].dataType).alias("match_id"),
        "season", F.col("team").alias("home"), F.col("team").alias("away"), F.lit(0.0).alias("gd"), F.lit(0).alias("_kind"),
        "rating", "past",
    )
    return rows.unionByName(first)


def elo_features(
    matches: DataFrame, cfg: EloConfig = EloConfig(), *, keys: Sequence[str] = ("pool",), state: DataFrame | None = None,
    step_rows: int = STEP_ROWS,
) -> DataFrame:
    """Pre-match ratings, difference, ratio, gap bucket and trends per match.

    Counts the rows of each pool; beyond ``step_rows`` all pools are rated in steps (see ``waves``).
    """
    if tuple(keys) == ("pool",) and needs_steps(matches, step_rows=step_rows):
        return _elo_columns(_elo_in_steps(matches, cfg, state, step_rows)[0])
    rows = _elo_input(matches, state)
    order = ["match_date", "_kind", "match_id"]
    if state is None:
        # Plain numbers alone reach the fold.
        rows = rows.withColumn("match_date", F.unix_date("match_date")).drop("_kind", "rating", "past")
        order.remove("_kind")
    i = {c: rows.columns.index(c) for c in rows.columns}
    pool, match_id, season, home, away, gd = (i[c] for c in ("pool", "match_id", "season", "home", "away", "gd"))

    def start():
        elo = _Elo(cfg)

        def step(row):
            if "_kind" in i and row[i["_kind"]] == 0:
                elo.load(row[home], row[i["rating"]], row[i["past"]], row[season])
                return None
            return (row[pool], row[match_id], *elo.play(row[season], row[home], row[away], row[gd]))

        return step, None

    schema = T.StructType(_typed(rows, ["pool", "match_id"]) + _RATED.fields)
    return _elo_columns(fold(rows, keys, order, start, schema))


def _numbered_seasons(matches: DataFrame) -> DataFrame:
    """(pool, season, _no): a pool's seasons in order of their first match; they must not interleave."""
    first = matches.groupBy("pool", "season").agg(F.min(F.struct("match_date", "match_id")).alias("_first"))
    return first.select("pool", "season", (F.row_number().over(Window.partitionBy("pool").orderBy("_first")) - 1).alias("_no"))


def _elo_in_steps(matches: DataFrame, cfg: EloConfig, state: DataFrame | None, step_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rated matches, state with ``season`` as a number and seasons not yet seen left open)."""
    numbers = _numbered_seasons(matches)
    same = F.col("m.pool").eqNullSafe(F.col("n.pool")) & F.col("m.season").eqNullSafe(F.col("n.season"))
    rows = matches.alias("m").join(numbers.alias("n"), same).select(
        "m.pool", "match_date", "match_id", F.col("_no").alias("season"), "home", "away", (F.col("hg") - F.col("ag")).cast("double").alias("gd")
    )
    team = _typed(rows, ["pool"]) + [T.StructField("team", rows.schema["home"].dataType)]
    held = [T.StructField("season", T.IntegerType()), T.StructField("rating", T.DoubleType()), T.StructField("past", T.ArrayType(T.DoubleType()))]
    if state is None:
        known = matches.sparkSession.createDataFrame([], T.StructType(team + held))
    else:
        # A saved state of the season that the pool goes on with is up to date, any other one is a season behind.
        begun = numbers.where("_no = 0").select("pool", F.col("season").alias("_begun"))
        number = F.when(F.col("season").eqNullSafe(F.col("_begun")), 0).otherwise(-1)
        known = state.join(begun, "pool", "left").select("pool", "team", number.alias("season"), "rating", "past")
    schema = T.StructType(_typed(rows, ["pool", "match_id"]) + _RATED.fields + [T.StructField("_kind", T.IntegerType())] + team[1:] + held)

    def rate(played: DataFrame, teams: DataFrame) -> DataFrame:
        both = _elo_input(played.withColumns({"hg": F.col("gd"), "ag": F.lit(0.0)}), teams, ("_group",))
        i = {c: both.columns.index(c) for c in both.columns}

        def start():
            elo, pool = _LaggingElo(cfg), []

            def step(row):
                pool[:] = [row[i["pool"]]]
                if row[i["_kind"]] == 0:
                    elo.load(row[i["home"]], row[i["rating"]], row[i["past"]], row[i["season"]])
                    return None
                seen = elo.play(row[i["season"]], row[i["home"]], row[i["away"]], row[i["gd"]])
                return (pool[0], row[i["match_id"]], *seen, 1, None, None, None, None)

            def finish():
                nothing = [None] * 5
                return [(pool[0], *nothing, 0, t, elo.seen[t], r, list(elo.past[t])) for t, r in elo.rating.items()]

            return step, finish

        return fold(both, ["pool", "_group"], ["match_date", "_kind", "match_id"], start, schema)

    rated, after = in_steps(rows, known, rate, step_rows)
    return rated.select("pool", "match_id", *_RATED.names), after


def _settled(state: DataFrame, numbers: DataFrame, cfg: EloConfig) -> DataFrame:
    """The state in the pool's last season, under that season's name."""
    last = numbers.groupBy("pool").agg(F.max(F.struct("_no", "season")).alias("_last"))
    rows = state.join(last, "pool").withColumn("_behind", F.col("_last._no") - F.col("season"))
    fields = [*_typed(rows, ["pool", "team"]), T.StructField("season", rows.schema["_last"].dataType["season"].dataType), *_typed(rows, ["rating", "past"])]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                elo = _LaggingElo(cfg)
                elo.load(r.team, r.rating, r.past, 0)
                elo.catch_up(r.team, r.behind)
                out.append((r.pool, r.team, r.season, elo.rating[r.team], list(elo.past[r.team])))
            yield pd.DataFrame(out, columns=[f.name for f in fields])

    plain = rows.select("pool", "team", F.col("_last.season").alias("season"), "rating", "past", F.col("_behind").alias("behind"))
    return plain.mapInPandas(run, T.StructType(fields))


def _elo_columns(df: DataFrame) -> DataFrame:
    diff = F.col("home_elo") - F.col("away_elo")
    form = F.col("home_elo_trend") - F.col("away_elo_trend")
    return df.withColumns(
        {
            "elo_difference": diff,
            "elo_ratio": F.when(F.col("away_elo") != 0, F.col("home_elo") / F.col("away_elo")).otherwise(1.0),
            "elo_gap_bucket": elo_gap_bucket(diff).cast("double"),
            "elo_recent_change": form,
            "rolling_elo_form": form,
        }
    )


class _EloGrid:
    """``_Elo`` for many configurations at once: a team's rating is a vector with a number for each."""

    def __init__(self, configs: Sequence[EloConfig]) -> None:
        column = lambda name: np.array([float(getattr(c, name)) for c in configs])
        self.k, self.home, self.margin = column("k"), column("home_advantage"), column("margin") > 0
        self.initial, self.carry = column("initial"), column("carryover")
        self.rating: dict = {}
        self.past: dict = {}
        self.season = None

    def trend(self, team) -> np.ndarray:
        past = self.past[team]
        return self.rating[team] - past[0] if len(past) == TREND else np.zeros_like(self.k)

    def play(self, season, home, away, goal_diff: float) -> tuple:
        if self.season is not None and season != self.season:
            fades = self.carry < 1.0
            for team, r in self.rating.items():
                self.rating[team] = np.where(fades, self.initial + self.carry * (r - self.initial), r)
                if self.past[team] and fades.any():
                    self.past[team].append(self.rating[team])
        self.season = season
        for team in (home, away):
            if team not in self.rating:
                self.rating[team], self.past[team] = self.initial, deque(maxlen=TREND)
        rh, ra = self.rating[home], self.rating[away]
        seen = (rh, ra, self.trend(home), self.trend(away))
        lead = rh + self.home - ra
        expected = 1.0 / (1.0 + 10.0 ** (-lead / 400.0))
        actual = 1.0 if goal_diff > 0 else 0.0 if goal_diff < 0 else 0.5
        size = abs(goal_diff)
        weight = np.where(self.margin & (size > 1), math.log(size + 1.0) * (2.2 / (np.abs(lead) * 0.001 + 2.2)), 1.0)
        change = self.k * weight * (actual - expected)
        self.rating[home], self.rating[away] = rh + change, ra - change
        self.past[home].append(self.rating[home])
        self.past[away].append(self.rating[away])
        return seen


def elo_grid(matches: DataFrame, configs: Sequence[EloConfig], carry: Sequence[str] = (), keep: Callable | None = None) -> DataFrame:
    """Ratings under every configuration: one fold per pool over vectors, then a row per match and configuration.

    ``carry`` names columns of ``matches`` to hand on; ``keep`` may stage the vectors, one row a match, before they are dealt out.

    Configurations that carry ratings over seasons unchanged and ones that do not are folded apart, as
    only the latter put a season's start into the trend.
    """
    parts = []
    table = list(enumerate(configs))
    for fades in (False, True):
        some = [(n, c) for n, c in table if (c.carryover < 1.0) == fades]
        if some:
            parts.append(_grid_fold(matches, some, carry, keep))
    rated = reduce(DataFrame.unionByName, parts)
    names = F.array(*[F.lit(c.name) for _, c in table])
    return _elo_columns(rated).withColumn("config_name", F.get(names, F.col("config")))


def _grid_fold(matches: DataFrame, numbered: list[tuple[int, EloConfig]], carry: Sequence[str], keep: Callable | None) -> DataFrame:
    rows = _elo_input(matches, None, carry)
    i = {c: rows.columns.index(c) for c in rows.columns}
    configs = [c for _, c in numbered]

    def start():
        grid = _EloGrid(configs)

        def step(row):
            seen = grid.play(row[i["season"]], row[i["home"]], row[i["away"]], row[i["gd"]])
            return (row[i["pool"]], row[i["match_id"]], *[row[i[c]] for c in carry], *[x.tolist() for x in seen])

        return step, None

    names = [f.name for f in _RATED.fields]
    lists = [T.StructField(n, T.ArrayType(T.DoubleType())) for n in names]
    folded = fold(rows, ["pool"], ["match_date", "match_id"], start, T.StructType(_typed(rows, ["pool", "match_id", *carry]) + lists))
    if keep is not None:
        folded = keep(folded)
    number = F.array(*[F.lit(n) for n, _ in numbered]).alias("config")
    return folded.select("pool", "match_id", *carry, F.inline(F.arrays_zip(number, *names)))


def elo_state(
    matches: DataFrame, cfg: EloConfig = EloConfig(), state: DataFrame | None = None, step_rows: int = STEP_ROWS
) -> DataFrame:
    """Final rating and last five post-match ratings per team: (pool, team, season, rating, past).

    Counts the rows of each pool, like ``elo_features``.
    """
    if needs_steps(matches, step_rows=step_rows):
        return _settled(_elo_in_steps(matches, cfg, state, step_rows)[1], _numbered_seasons(matches), cfg)
    rows = _elo_input(matches, state)
    i = {c: rows.columns.index(c) for c in rows.columns}

    def start():
        elo = _Elo(cfg)
        pool = []

        def step(row):
            pool[:] = [row[i["pool"]]]
            if row[i["_kind"]] == 0:
                elo.load(row[i["home"]], row[i["rating"]], row[i["past"]], row[i["season"]])
            else:
                elo.play(row[i["season"]], row[i["home"]], row[i["away"]], row[i["gd"]])

        def finish():
            return [(pool[0], t, elo.season, r, list(elo.past[t])) for t, r in elo.rating.items()]

        return step, finish

    schema = T.StructType(
        [
            *_typed(rows, ["pool"]), T.StructField("team", rows.schema["home"].dataType), *_typed(rows, ["season"]),
            T.StructField("rating", T.DoubleType()), T.StructField("past", T.ArrayType(T.DoubleType())),
        ]
    )
    return fold(rows, ["pool"], ["match_date", "_kind", "match_id"], start, schema)


def elo_prediction_rows(fixtures: DataFrame, state: DataFrame, initial: float = 1500.0) -> DataFrame:
    """Rating features of unplayed fixtures ``(pool, home, away)``; an unknown team starts at ``initial``."""
    s = state.select(
        "pool", "team", "rating", F.when(F.size("past") == TREND, F.col("rating") - F.col("past")[0]).otherwise(0.0).alias("trend")
    )
    out = fixtures
    for side in ("home", "away"):
        one = s.select("pool", F.col("team").alias(side), F.col("rating").alias(f"{side}_elo"), F.col("trend").alias(f"{side}_elo_trend"))
        out = out.join(one, ["pool", side], "left").na.fill({f"{side}_elo": initial, f"{side}_elo_trend": 0.0})
    return _elo_columns(out)


# --- opponent-adjusted xG --------------------------------------------------


@dataclass(frozen=True)
class XgConfig:
    home_factor: float = 1.08
    away_factor: float = 0.96
    alpha: float = 0.35
    max_goals: int = 10
    # League means before any match, the floor of an opponent's strength, the goal range.
    league: tuple[float, float, float] = (1.35, 1.45, 1.20)
    floor: float = 0.25
    low: float = 0.15
    high: float = 4.5


_BLOCKS = ("", "_last5", "_last10", "_season")
XG_RATING_COLUMNS = tuple(
    f"{side}_xg_{part}_rating{block}" for block in _BLOCKS for part in ("attack", "defense") for side in ("home", "away")
)


class _XgTeam:
    __slots__ = ("ewm", "recent", "season", "total", "n")

    def __init__(self) -> None:
        self.ewm: tuple[float, float] | None = None
        self.recent: deque = deque(maxlen=10)
        self.season, self.total, self.n = None, (0.0, 0.0), 0

    def block(self, season, league: float) -> list[tuple[float, float]]:
        """(attack, defence) relative to the league: weighted, last 5, last 10, season."""

        def mean(rows: list) -> tuple[float, float]:
            if not rows:
                return league, league
            return sum(r[0] for r in rows) / len(rows), sum(r[1] for r in rows) / len(rows)

        rows = list(self.recent)
        in_season = (self.total[0] / self.n, self.total[1] / self.n) if self.n and self.season == season else (league, league)
        parts = [self.ewm or (league, league), mean(rows[-5:]), mean(rows), in_season]
        return [(a / league, d / league) for a, d in parts]

    def dump(self) -> tuple:
        """(ewm, recent, season, total, n) as flat lists and numbers."""
        return list(self.ewm or ()), [x for pair in self.recent for x in pair], self.season, list(self.total), self.n

    @classmethod
    def restored(cls, ewm, recent, season, total, n: int) -> _XgTeam:
        out = cls()
        out.ewm = tuple(ewm) if len(ewm) else None
        out.recent.extend(zip(recent[::2], recent[1::2], strict=True))
        out.season, out.total, out.n = season, tuple(total), n
        return out

    def add(self, season, attack: float, defence: float, alpha: float) -> None:
        if self.ewm is None:
            self.ewm = (attack, defence)
        else:
            self.ewm = (alpha * attack + (1 - alpha) * self.ewm[0], alpha * defence + (1 - alpha) * self.ewm[1])
        self.recent.append((attack, defence))
        if season != self.season:
            self.season, self.total, self.n = season, (0.0, 0.0), 0
        self.total = (self.total[0] + attack, self.total[1] + defence)
        self.n += 1


def _xg_match(h: _XgTeam, a: _XgTeam, season, hx: float, ax: float, sums: Sequence, cfg: XgConfig) -> tuple:
    """Ratings and expected goals before the match; both teams then hold it.  ``sums``: home xG, away xG and matches so far."""
    n = sums[2]
    league, lh, la = ((sums[0] + sums[1]) / (2 * n), sums[0] / n, sums[1] / n) if n else cfg.league
    # A mean of 0 measures nothing: until the league's first chance the start value stands.
    league = league or cfg.league[0]
    hb, ab = h.block(season, league), a.block(season, league)
    (h_att, h_def), (a_att, a_def) = hb[0], ab[0]
    eh = lh * h_att * a_def * cfg.home_factor
    ea = la * a_att * h_def * cfg.away_factor
    out = [x for k in range(4) for pair in ((hb[k][0], ab[k][0]), (hb[k][1], ab[k][1])) for x in pair]
    h.add(season, hx / max(a_def, cfg.floor), ax / max(a_att, cfg.floor), cfg.alpha)
    a.add(season, ax / max(h_def, cfg.floor), hx / max(h_att, cfg.floor), cfg.alpha)
    clip = lambda x: min(max(x, cfg.low), cfg.high)
    return (*out, clip(eh), clip(ea))


def _xg_in_steps(matches: DataFrame, cfg: XgConfig, number: list[T.StructField], step_rows: int) -> DataFrame:
    """The league's sums so far come from a running sum over slices; what is left depends on both teams alone."""
    rows = matches.select("pool", "match_date", "match_id", "season", "home", "away", "hxg", "axg")
    sums = {"_h": F.col("hxg"), "_a": F.col("axg"), "_n": F.lit(1)}
    run = History(rows, ["pool"], totals=sums)
    rows = run.real(run.frame.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(run.running()), F.lit(0)) for c in sums})).drop(*sums)
    before = [f"{c}_before" for c in sums]
    held = [
        T.StructField("team", rows.schema["home"].dataType), T.StructField("ewm", T.ArrayType(T.DoubleType())),
        T.StructField("recent", T.ArrayType(T.DoubleType())), T.StructField("team_season", rows.schema["season"].dataType),
        T.StructField("total", T.ArrayType(T.DoubleType())), T.StructField("played", T.LongType()),
    ]
    names = [f.name for f in held]
    ids = _typed(rows, ["pool", "match_id"])
    schema = T.StructType(ids + number + [T.StructField("_kind", T.IntegerType())] + held)

    def rate(played: DataFrame, teams: DataFrame) -> DataFrame:
        first = teams.withColumns({"_kind": F.lit(0), "match_date": F.lit("0001-01-01").cast("date")})
        both = played.withColumn("_kind", F.lit(1)).unionByName(first, allowMissingColumns=True)
        i = {c: both.columns.index(c) for c in both.columns}

        def start():
            known, pool = {}, []

            def step(row):
                pool[:] = [row[i["pool"]]]
                if row[i["_kind"]] == 0:
                    known[row[i["team"]]] = _XgTeam.restored(*[row[i[c]] for c in names[1:]])
                    return None
                h, a = (known.setdefault(row[i[s]], _XgTeam()) for s in ("home", "away"))
                so_far = [row[i[c]] for c in before]
                seen = _xg_match(h, a, row[i["season"]], row[i["hxg"]], row[i["axg"]], so_far, cfg)
                return (pool[0], row[i["match_id"]], *seen, 1, *[None] * len(names))

            def finish():
                return [(pool[0], None, *[None] * len(number), 0, t, *x.dump()) for t, x in known.items()]

            return step, finish

        return fold(both, ["pool", "_group"], ["match_date", "_kind"], start, schema, then=["match_id"])

    nobody = matches.sparkSession.createDataFrame([], T.StructType(ids[:1] + held))
    rated, _ = in_steps(rows, nobody, rate, step_rows)
    return rated.select("pool", "match_id", *[f.name for f in number])


def opponent_adjusted_xg(
    matches: DataFrame, cfg: XgConfig = XgConfig(), keys: Sequence[str] = ("pool",), step_rows: int = STEP_ROWS
) -> DataFrame:
    """Attack and defence ratings against the league mean so far, expected goals and their 1X2 chances.

    A pool's seasons must not interleave in time.  Counts the rows of each pool, like ``elo_features``.
    """
    number = [T.StructField(c, T.DoubleType()) for c in (*XG_RATING_COLUMNS, "expected_home_goals_model", "expected_away_goals_model")]
    if tuple(keys) == ("pool",) and needs_steps(matches, step_rows=step_rows):
        return _xg_columns(_xg_in_steps(matches, cfg, number, step_rows), cfg)
    rows = matches.select("pool", "match_date", "match_id", "season", "home", "away", "hxg", "axg")
    i = {c: rows.columns.index(c) for c in rows.columns}

    def start():
        teams: dict = {}
        sums = [0.0, 0.0, 0]

        def step(row):
            h, a = (teams.setdefault(row[i[s]], _XgTeam()) for s in ("home", "away"))
            hx, ax = row[i["hxg"]], row[i["axg"]]
            out = _xg_match(h, a, row[i["season"]], hx, ax, sums, cfg)
            sums[:] = [sums[0] + hx, sums[1] + ax, sums[2] + 1]
            return (row[i["pool"]], row[i["match_id"]], *out)

        return step, None

    return _xg_columns(fold(rows, keys, ["match_date", "match_id"], start, T.StructType(_typed(rows, ["pool", "match_id"]) + number)), cfg)


def _xg_columns(rated: DataFrame, cfg: XgConfig) -> DataFrame:
    c = F.col
    hv, av = c("home_xg_attack_rating") * c("away_xg_defense_rating"), c("away_xg_attack_rating") * c("home_xg_defense_rating")
    rated = rated.withColumns(
        {
            "home_attack_vs_away_defense": hv,
            "away_attack_vs_home_defense": av,
            "attack_defense_matchup_score": hv - av,
            "expected_goal_diff_model": c("expected_home_goals_model") - c("expected_away_goals_model"),
        }
    )
    names = ("poisson_home_win_prob", "poisson_draw_prob", "poisson_away_win_prob")
    return with_poisson_1x2(rated, "expected_home_goals_model", "expected_away_goals_model", names, cfg.max_goals)


def rating_rows(ratings: DataFrame, matches: DataFrame) -> DataFrame:
    """Ratings per team-match for ``rolling.recency_weighted``."""
    sides = F.inline(
        F.array(
            *[
                F.struct(F.col(s).alias("team"), F.col(f"{s}_xg_attack_rating").alias("attack_rating"),
                         F.col(f"{s}_xg_defense_rating").alias("defense_rating"))
                for s in ("home", "away")
            ]
        )
    )
    return ratings.join(matches.select("match_id", "home", "away"), "match_id").select("match_id", sides)
