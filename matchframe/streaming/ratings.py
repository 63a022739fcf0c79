"""Ratings that follow a stream of results: state per pool and team, rows in any order up to a stated delay.

A pool's clock is the latest day seen in it.  A match waits until the clock is
``delay_days`` beyond it (a day at least), so matches of a day meet whichever file they come
in, and is then rated in the order of days and ids, as ``elo_features`` does
for a whole table.  Batches split in any way give the same ratings as long as no match
comes later than that.

State: a rating and five past ones per team, the waiting matches, the clock.
Teams are read and written one by one, so a pool never has to fit into a task; a task does hold
the matches of a pool that one batch brings, which ``maxFilesPerTrigger`` bounds.

Outcomes: ``rated``; ``late`` for matches of days that are closed, among them repeated
rows of rated matches; ``incomplete`` for rows that lack the day, a team or goals.  A row
without an id only moves the clock, which closes the last days of a season.
A waiting match that comes again replaces the one that waits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from matchframe.operators.ratings import EloConfig, _elo_columns, _LaggingElo
from matchframe.plans.stages import staged
from matchframe.shipping import ship

PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RATED, LATE, INCOMPLETE = "rated", "late", "incomplete"
_OUT = ["pool", "match_id", "home_elo", "away_elo", "home_elo_trend", "away_elo_trend", "outcome"]


class _Rater(StatefulProcessor):
    def __init__(self, cfg: EloConfig, delay_days: int, season: str, match_id: str, team: str) -> None:
        self.cfg, self.delay = cfg, max(1, delay_days)
        self.types = season, match_id, team

    def init(self, handle: StatefulProcessorHandle) -> None:
        season, match_id, team = self.types
        self.clock = handle.getValueState("clock", f"closed int, season {season}, number int")
        self.teams = handle.getMapState("teams", f"team {team}", "number int, rating double, past array<double>")
        self.waiting = handle.getMapState(
            "waiting", f"day int, match_id {match_id}", f"season {season}, home {team}, away {team}, gd double"
        )

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N803
        for r in initialState.itertuples(index=False):
            self.clock.update((None if pd.isna(r.closed) else int(r.closed), r.season, 0))
            self.teams.updateValue((r.team,), (0, float(r.rating), [float(x) for x in r.past]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        closed, season, number = self.clock.get() if self.clock.exists() else (None, None, None)
        newest, came, out = None, {}, []
        for frame in rows:
            for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False):
                if r.day is not None:
                    newest = r.day if newest is None else max(newest, r.day)
                if r.match_id is None:
                    continue
                if r.day is None or r.home is None or r.away is None or r.gd is None:
                    out.append((*key, r.match_id, None, None, None, None, INCOMPLETE))
                elif closed is not None and r.day <= closed:
                    out.append((*key, r.match_id, None, None, None, None, LATE))
                else:
                    came[int(r.day), r.match_id] = (r.season, r.home, r.away, float(r.gd))
        if newest is not None:
            newest = int(newest) - self.delay
            closed = newest if closed is None else max(closed, newest)
        ready = {k: v for k, v in came.items() if closed is not None and k[0] <= closed}
        if closed is not None:
            for k in [tuple(k) for k in self.waiting.keys()]:
                if k[0] <= closed:
                    ready.setdefault(k, tuple(self.waiting.getValue(k)))
                    self.waiting.removeKey(k)
        for k, v in came.items():
            if k not in ready:
                self.waiting.updateValue(k, v)
        elo = _LaggingElo(self.cfg)
        for k in sorted(ready):
            its_season, home, away, gd = ready[k]
            if number is None or its_season != season:
                season, number = its_season, 0 if number is None else number + 1
            for team in (home, away):
                if team not in elo.rating and self.teams.containsKey((team,)):
                    at, rating, past = self.teams.getValue((team,))
                    elo.load(team, rating, past, at)
            out.append((*key, k[1], *elo.play(number, home, away, gd), RATED))
        for team, rating in elo.rating.items():
            self.teams.updateValue((team,), (elo.seen[team], float(rating), [float(x) for x in elo.past[team]]))
        self.clock.update((closed, season, number))
        yield pd.DataFrame(out, columns=_OUT)

    def close(self) -> None:
        pass


def elo_stream(
    results: DataFrame, cfg: EloConfig = EloConfig(), *, delay_days: int = 7, state: DataFrame | None = None
) -> DataFrame:
    """Pre-match ratings of the streamed ``results`` with an ``outcome``, see above.

    ``results`` has pool, match_date, match_id, season, home, away, hg and ag.  ``state`` is ``elo_state`` of
    the matches before the stream, with their last day in each pool as ``match_date``; it is staged.  The query needs the
    RocksDB state store; ``write_ratings`` sets it.
    """
    ship(results.sparkSession)
    kind = {c: results.schema[c].dataType.simpleString() for c in ("pool", "season", "match_id", "home")}
    rows = results.select(
        "pool", "match_id", "season", "home", "away", F.unix_date("match_date").alias("day"),
        (F.col("hg") - F.col("ag")).cast("double").alias("gd"),
    )
    first = None
    if state is not None:
        plain = state.select("pool", "team", "season", "rating", "past", F.unix_date("match_date").alias("closed"))
        first = staged(plain).groupBy("pool")
    rated = rows.groupBy("pool").transformWithStateInPandas(
        statefulProcessor=_Rater(cfg, delay_days, kind["season"], kind["match_id"], kind["home"]),
        outputStructType=f"pool {kind['pool']}, match_id {kind['match_id']}, home_elo double, away_elo double, "
        "home_elo_trend double, away_elo_trend double, outcome string",
        outputMode="Append", timeMode="None", initialState=first,
    )
    return _elo_columns(rated)


def write_ratings(rated: DataFrame, folder: str, progress: str, *, once: bool = True):
    """Write rated matches to ``folder``/rated, others to ``folder``/aside; returns the running query.

    Each batch has a partition of its own in both, which a repeated batch replaces.
    """
    spark = rated.sparkSession
    spark.conf.set(PROVIDER_KEY, PROVIDER)

    def write(batch: DataFrame, number: int) -> None:
        good = F.col("outcome") == RATED
        kept = batch.persist()
        kept.where(good).drop("outcome").write.mode("overwrite").parquet(f"{folder}/rated/batch={number}")
        kept.where(~good).select("pool", "match_id", "outcome").write.mode("overwrite").parquet(f"{folder}/aside/batch={number}")
        kept.unpersist()

    writer = rated.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", progress)
    return (writer.trigger(availableNow=True) if once else writer).start()
