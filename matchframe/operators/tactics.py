"""Tactical profiles, match-ups and playing styles."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchframe.operators.rolling import zero
from matchframe.operators.windows import REAL, TOTAL, History, fits_whole, real_row
from matchframe.plans.stages import staged
from matchframe.shipping import ship


# The tactical measures of a team's match.
TACTICAL_MEASURES = (
    "average_possession",
    "possession_score",
    "progressive_passes",
    "passes_per_sequence",
    "build_up_speed",
    "long_pass_ratio",
    "progression_score",
    "directness_score",
    "PPDA",
    "high_press_events",
    "press_success_rate",
    "turnovers_forced",
    "counterpress_actions",
    "press_intensity_score",
    "crosses_per_match",
    "crossing_score",
    "through_balls",
    "counter_attacks",
    "fast_break_frequency",
    "attacking_pressure_score",
    "attacking_width_score",
    "attacking_verticality_score",
    "defensive_line_height_proxy",
    "blocks",
    "interceptions",
    "tackles",
    "low_block_score",
    "high_line_score",
    "defensive_activity_score",
    "defensive_aggression_score",
)


FRAMES = {"last5": 5, "last10": 10}


def _mean(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, total / np.maximum(n, 1), np.nan)


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows again, cut so that no (team, slice) is parted; one slice at most is held back."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        if not rows.num_rows:
            continue
        last = rows.num_rows - 1
        same = np.ones(rows.num_rows, bool)
        for c in ("_part", "_chunk"):
            x = rows.column(c).to_numpy()
            same &= x == x[last]
        cut = last + 1 - int(np.argmin(same[::-1])) if not same.all() else 0
        held = rows.slice(cut)
        if cut:
            yield rows.slice(0, cut)
    if held is not None and held.num_rows:
        yield held


def _packed(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The given lists of a column as a matrix; null lists are left out, a null number is NaN."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _profile(rows: pa.Table, width: int, frames: Sequence[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(places of the asks, frame -> matrix of means) of whole slices in order."""
    number = lambda c: rows.column(c).to_numpy()
    part, chunk, kind = number("_part"), number("_chunk"), number("_q")
    border = np.concatenate([[True], (part[1:] != part[:-1]) | (chunk[1:] != chunk[:-1])])
    group = np.cumsum(border) - 1
    asks, facts = np.flatnonzero((kind == 0) & (number("_ctx") == REAL)), np.flatnonzero(kind == 1)
    values = _packed(rows.column("m"), width)
    held = (~np.isnan(values)).astype(float)
    values = np.nan_to_num(values, copy=False)
    # The facts before an ask, and those of its own slice among them; the row of zeros at the end stands for none.
    upto = np.searchsorted(facts, asks)
    first = np.searchsorted(group[facts], group[asks])
    ended = {n: np.concatenate([x, np.zeros((1, width))]) for n, x in (("total", values), ("n", held))}
    out = {}
    wanted = {FRAMES[f]: f for f in frames if f in FRAMES}
    total, n = np.zeros((len(asks), width)), np.zeros((len(asks), width))
    for back in range(1, max(wanted, default=0) + 1):
        at = np.where(upto - back >= first, upto - back, len(facts))
        total += ended["total"][at]
        n += ended["n"][at]
        if back in wanted:
            out[wanted[back]] = _mean(total, n)
    if "season" in frames:
        out["season"] = _season(rows, width, group, asks, facts, values, held)
    return asks, {f: out[f] for f in frames}


def _season(rows: pa.Table, width: int, group: np.ndarray, asks: np.ndarray, facts: np.ndarray, values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Season so far: what earlier slices carried, then the slice's own facts, running within (slice, season)."""
    own = rows.column("_ctx").to_numpy()[facts] == REAL
    at, each = facts[own], [values[own], held[own]]
    if "tot" in rows.column_names:
        carried = np.flatnonzero(rows.column("_q").to_numpy() == 2)
        at = np.concatenate([at, carried])
        each = [np.concatenate([x, np.nan_to_num(_packed(rows.column(c), width))]) for x, c in zip(each, ("tot", "cnt"), strict=True)]
    code = pd.factorize(rows.column("season").to_pandas())[0]
    # One number a (slice, season), and the row's place in it.
    key = np.unique(group * (code.max() + 2) + code + 1, return_inverse=True)[1] * rows.num_rows
    place = key[at] + at
    order = np.argsort(place, kind="stable")
    place = place[order]
    begin, end = np.searchsorted(place, key[asks]), np.searchsorted(place, key[asks] + asks)
    sums = []
    for x in each:
        c = np.concatenate([np.zeros((1, width)), np.cumsum(x[order], axis=0)])
        sums.append(c[end] - c[begin])
    return _mean(*sums)


def _profiles(width: int, names: list[str], frames: Sequence[str]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _slices(batches):
            asks, means = _profile(rows, width, frames)
            keys = rows.select(["match_id", "is_home", "team", "season"]).take(pa.array(asks)).combine_chunks()
            columns = [pa.array(x[:, k], from_pandas=True) for k in range(width) for x in means.values()]
            out = pa.Table.from_arrays([*keys.columns, *columns], [*keys.column_names, *names])
            yield from out.combine_chunks().to_batches()

    return run


def tactical_profiles(
    asks: DataFrame, tactics: DataFrame, metrics: Sequence[str] = TACTICAL_MEASURES, frames: Sequence[str] = (*FRAMES, "season")
) -> DataFrame:
    """Means of the last 5 and 10 earlier tactical rows and of the season so far; nulls are skipped.

    ``asks(match_id, is_home, team, season, match_date)``; ``tactics`` has one row
    per team-match with the same keys and, optionally, ``collected``, from when
    it is known (taken to grow with the match date).

    A row's measures travel as one array.  Teams with few rows are one slice each (``windows.fits_whole``, which counts
    them).  Other slices get the ten rows before them and each season's sums so far.  They are sorted by the engine, and
    batches of whole slices are averaged in NumPy.  Where teams are sliced, stages the arrays, which three steps read.
    """
    ship(asks.sparkSession)
    seen = F.col("match_date")
    if "collected" in tactics.columns:
        seen = F.greatest(seen, F.coalesce(F.col("collected"), seen))
    facts = tactics.select(
        "team", "season", seen.alias("match_date"), F.col("match_id").alias("_mid"), F.lit(1).alias("_q"),
        F.array(*[F.col(m).cast("double") for m in metrics]).alias("m"),
    )
    whole = fits_whole(["team"], asks, tactics)
    if not whole:
        facts = staged(facts)
    q = asks.select("match_id", "is_home", "team", "season", "match_date", F.lit(0).alias("_q"), F.col("match_id").alias("_mid"))
    rows = q.unionByName(facts, allowMissingColumns=True)
    h = History(rows, ["team"], ties=("_q", "_mid"), rows=10, rows_where=F.col("_q") == 1, whole=whole)
    frame, sums = h.frame, []
    if not whole and "season" in frames:
        frame, sums = frame.unionByName(_carried(rows, facts, h, len(metrics)), allowMissingColumns=True), ["tot", "cnt"]
    placed = frame.withColumn("_part", F.xxhash64("team")).repartition("team", "_chunk")
    placed = placed.sortWithinPartitions("_part", "team", "_chunk", "_front", "match_date", "_q", "_mid")
    names = [f"{m}_{f}" for m in metrics for f in frames]
    kinds = [f"`{c}` {asks.schema[c].dataType.simpleString()}" for c in ("match_id", "is_home", "team", "season")]
    return placed.select("_part", "_chunk", "_ctx", "_q", "match_id", "is_home", "team", "season", "m", *sums).mapInArrow(
        _profiles(len(metrics), names, tuple(frames)), ", ".join([*kinds, *[f"`{n}` double" for n in names]])
    )


def _carried(rows: DataFrame, facts: DataFrame, h: History, width: int) -> DataFrame:
    """One row a (team, season, slice) with the sums and counts of the season's earlier slices."""
    places = range(width)
    per = facts.groupBy("team", "season", h.slice_of(F.col("match_date")).alias("_chunk")).agg(
        *[F.sum(F.col("m")[k]).alias(f"s{k}") for k in places], *[F.count(F.col("m")[k]).alias(f"n{k}") for k in places]
    )
    # Slices of a key that hold asks alone need the carried sums as well.
    all_slices = rows.select("team", "season", h.slice_of(F.col("match_date")).alias("_chunk")).distinct()
    prior = Window.partitionBy("team", "season").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return all_slices.join(
        per.select(F.col("team").alias("t"), F.col("season").alias("s"), F.col("_chunk").alias("c"), *[f"s{k}" for k in places], *[f"n{k}" for k in places]),
        F.col("team").eqNullSafe(F.col("t")) & F.col("season").eqNullSafe(F.col("s")) & (F.col("_chunk") == F.col("c")), "left",
    ).select(
        "team", "season", "_chunk", F.array(*[F.sum(f"s{k}").over(prior) for k in places]).alias("tot"),
        F.array(*[F.sum(f"n{k}").over(prior).cast("double") for k in places]).alias("cnt"),
        F.lit(TOTAL).alias("_ctx"), F.lit(0).alias("_front"), F.lit(2).alias("_q"),
    )


def _v(side: str, name: str) -> Column:
    return zero(F.col(f"{side}_{name}").cast("double"))


# Home measure minus away measure.
MATCHUPS = {
    "possession_vs_counter": ("home", "average_possession", "away", "counter_attacks"),
    "high_line_vs_transition": ("home", "high_line_score", "away", "fast_break_frequency"),
    "crossing_vs_low_block": ("home", "crosses_per_match", "away", "low_block_score"),
    "home_press_vs_away_build_up": ("home", "press_intensity_score", "away", "build_up_speed"),
    "away_press_vs_home_build_up": ("away", "press_intensity_score", "home", "build_up_speed"),
}


def tactical_matchups(wide: DataFrame, metrics: Sequence[str], pairs: dict[str, tuple[str, str, str, str]] = MATCHUPS, suffix: str = "_last10") -> DataFrame:
    """Differences of opposing measures and the distance of the two style vectors; null counts as 0."""
    cols = {n: _v(a, x + suffix) - _v(b, y + suffix) for n, (a, x, b, y) in pairs.items()}
    home, away = (F.array(*[_v(s, m + suffix) for m in metrics]) for s in ("home", "away"))
    squares = F.zip_with(home, away, lambda x, y: (x - y) * (x - y))
    cols["style_distance_score"] = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))
    return wide.withColumns(cols)


# Style measures in the order in which ties are settled.
STYLE_MEASURES = ("average_possession", "press_intensity_score", "directness_score", "low_block_score", "crosses_per_match")


def style_cluster_rule(prefix: str = "", measures: Sequence[str] = STYLE_MEASURES, suffix: str = "_last10") -> Column:
    """Index of the largest measure (first wins ties), 0 when none is positive."""
    values = [zero(F.col(f"{prefix}{m}{suffix}").cast("double")) for m in measures]
    out = F.lit(0)
    for i in reversed(range(len(values))):
        rest = values[i + 1 :]
        wins = values[i] > 0
        for r in rest:
            wins = wins & (values[i] >= r)
        out = F.when(wins, i + 1).otherwise(out)
    return out


def style_history_points(rows: DataFrame) -> DataFrame:
    """Mean points of the last 10 earlier matches against the same opponent style.

    ``rows(match_id, match_date, team, opponent_cluster, points)``.
    """
    h = History(rows, ["team", "opponent_cluster"], rows=10)
    mean = zero(F.avg(real_row(F.col("points").cast("double"))).over(h.last(10)))
    return h.real(h.frame.withColumn("style_history_points", mean)).select("match_id", "team", "style_history_points")


# Names of the clusters 0 to 5.
ARCHETYPES = ("Balanced", "Possession Dominant", "High Press", "Direct Counterattack", "Low Block", "Cross Heavy")


def style_embeddings(
    profiles: DataFrame, metrics: Sequence[str], k: int = 6, seed: int = 42, rounds: int = 100_000, vector: str | None = None
) -> DataFrame:
    """Median-imputed, standardised profiles in ``k`` clusters.  Stages the profiles and fits models, so it runs jobs.

    The clusters settle: rounds go on until no centre moves by more than rounding, which is far less than one profile
    moves it; ``rounds`` only ends a search that never would.  ``vector`` names a column for the standardised profile.
    """
    profiles = staged(profiles)
    imputed = [m + "_i" for m in metrics]
    model = Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=list(metrics), outputCols=imputed),
            VectorAssembler(inputCols=imputed, outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_z", withMean=True),
            KMeans(featuresCol="_z", predictionCol="team_style_cluster", k=k, seed=seed, maxIter=rounds, tol=1e-10),
        ]
    ).fit(profiles)
    names = F.array(*[F.lit(a) for a in ARCHETYPES])
    out = model.transform(profiles)
    if vector is not None:
        out = out.withColumn(vector, vector_to_array("_z"))
    out = out.drop("_raw", "_z", *imputed)
    return out.withColumn("team_style_archetype", F.coalesce(F.get(names, F.col("team_style_cluster")), F.lit("Balanced")))
