"""Time splits, temperature, blend weights, overlays and selection rules.

A search over a grid is one pass: a batch of rows becomes the vector of its summed losses,
the vectors of a key are added up, and the least (loss, setting) wins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchframe.functions.probs import (
    FLOOR,
    P,
    brier,
    draw_overlay,
    log_loss,
    named,
    normalize_probs,
    pick,
    softmax3,
    temperature_scale,
    triple,
)
from matchframe.operators.metrics import bin_index
from matchframe.operators.windows import History, exact_quantiles
from matchframe.plans.stages import staged
from matchframe.shipping import ship

MARKET = ("m_home", "m_draw", "m_away")


# --- time split ------------------------------------------------------------


def split_cutoff(df: DataFrame, frac: float = 0.8, keys: Sequence[str] = (), day: str = "match_date") -> DataFrame:
    """(keys..., cutoff): the day of row number int(frac * n) in date order.

    Days are counted first, so the ordered step sees one row per day and key.
    """
    daily = df.groupBy(*keys, day).agg(F.count("*").alias("_n"))
    part = list(keys) or [F.lit(1)]
    upto = Window.partitionBy(*part).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*part)
    marked = daily.withColumns({"_c": F.sum("_n").over(upto), "_t": F.sum("_n").over(whole)})
    past = F.col("_c") > F.floor(F.col("_t") * frac + 1e-9)
    return marked.where(past).groupBy(*keys).agg(F.min(day).alias("cutoff"))


def time_split(df: DataFrame, frac: float = 0.8, keys: Sequence[str] = (), day: str = "match_date") -> DataFrame:
    """Adds ``is_test``: 1 from the cutoff day on."""
    cut = split_cutoff(df, frac, keys, day)
    if keys:
        rows = df.join(cut, list(keys))
    else:
        # One row, whatever the size of the data.
        rows = df.withColumn("_1", F.lit(1)).join(F.broadcast(cut.withColumn("_1", F.lit(1))), "_1").drop("_1")
    return rows.withColumn("is_test", (F.col(day) >= F.col("cutoff")).cast("int")).drop("cutoff")


# --- searches --------------------------------------------------------------

# Search grids.
TEMPERATURES = [round(0.6 + 0.025 * i, 3) for i in range(81)]
BLEND_WEIGHTS = [i / 100 for i in range(101)]
COARSE_WEIGHTS = [i / 40 for i in range(41)]
RESIDUAL_WEIGHTS = [round(-0.5 + 0.01 * i, 2) for i in range(101)]


#: Rows of a batch that are expanded over the grid at once.
GRID_ROWS = 2_048

# One row a match, one column a grid value, one layer an outcome.
Layers = np.ndarray


def _clipped(x: Layers) -> Layers:
    """``normalize_probs`` of layers."""
    x = np.clip(x, FLOOR, 1.0)
    return x / x.sum(0)


def _tempered(p: Layers, _: Layers, grid: np.ndarray) -> Layers:
    q = _clipped(p) ** (1.0 / grid)
    return q / q.sum(0)


def _blended(p: Layers, m: Layers, grid: np.ndarray) -> Layers:
    return _clipped(grid * p + (1.0 - grid) * m)


def _shifted(p: Layers, m: Layers, grid: np.ndarray) -> Layers:
    return _clipped(m + grid * (p - m))


def _grid_sums(keys: list[str], grid: np.ndarray, mix: Callable[[Layers, Layers, np.ndarray], Layers], n_probs: int) -> Callable:
    """Per batch and key: the number of rows and the sum of their losses for each grid value."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.zeros(batch.num_rows, np.int64)
            if keys:
                code = batch.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(code, kind="stable")
            columns = [batch.column(c).to_numpy(zero_copy_only=False)[order] for c in (*[f"_x{i}" for i in range(n_probs)], "_t")]
            probs, target = np.stack(columns[:-1])[:, :, None].astype(float), columns[-1].astype(int)
            names, first = np.unique(code[order], return_index=True)
            sums = np.zeros((len(names), len(grid)))
            for lo in range(0, len(order), GRID_ROWS):
                part = slice(lo, lo + GRID_ROWS)
                q = _clipped(mix(probs[:3, part], probs[3:, part], grid))
                kept = q[target[part], np.arange(q.shape[1])]
                here, starts = np.unique(code[order][part], return_index=True)
                sums[np.searchsorted(names, here)] -= np.add.reduceat(np.log(kept), starts, axis=0)
            sample = batch.take(pa.array(order[first]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1, dtype=np.int32) * len(grid)), pa.array(sums.ravel()))
            counts = pa.array(np.diff(np.append(first, len(order))))
            yield pa.RecordBatch.from_arrays([*(sample.column(k) for k in keys), counts, lists], [*keys, "_n", "_l"])

    return run


def _best(df: DataFrame, name: str, grid: Sequence[float], mix: Callable, keys: Sequence[str], probs: Sequence[str]) -> DataFrame:
    """The grid value with the least mean log loss; the smaller value of equal ones.

    One pass: batches add up the losses of their rows for the whole grid, Spark adds the vectors of each
    key.  Rows without a target or with a missing probability are left out.
    """
    ship(df.sparkSession)
    keys = list(keys)
    whole = df.dropna(subset=[*probs, "target"])
    rows = whole.select(*keys, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(probs)], F.col("target").cast("int").alias("_t"))
    types = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    work = _grid_sums(keys, np.array(grid, float), mix, len(probs))
    parts = rows.mapInArrow(work, types + "_n long, _l array<double>")
    sums = parts.groupBy(*keys).agg(F.sum("_n").alias("_n"), Summarizer.sum(array_to_vector("_l")).alias("_l")).where("_n > 0")
    values = F.array(*[F.lit(float(g)) for g in grid])
    pairs = F.zip_with(vector_to_array("_l"), values, lambda x, v: F.struct((x / F.col("_n")).alias("loss"), v.alias("v")))
    best = sums.select(*keys, F.array_min(pairs).alias("b"))
    return best.select(*keys, F.col("b.v").alias(name), F.col("b.loss").alias("loss"))


def choose_temperature(df: DataFrame, keys: Sequence[str] = (), probs: Sequence[str] = P) -> DataFrame:
    return _best(df, "temperature", TEMPERATURES, _tempered, keys, probs)


def tune_blend(df: DataFrame, grid: Sequence[float] = BLEND_WEIGHTS, keys: Sequence[str] = (), market: Sequence[str] = MARKET) -> DataFrame:
    return _best(df, "weight", grid, _blended, keys, (*P, *market))


def tune_residual(df: DataFrame, keys: Sequence[str] = (), market: Sequence[str] = MARKET) -> DataFrame:
    return _best(df, "weight", RESIDUAL_WEIGHTS, _shifted, keys, (*P, *market))


def _attach(df: DataFrame, best: DataFrame, keys: Sequence[str]) -> DataFrame:
    if keys:
        return df.join(best, list(keys), "left")
    return df.withColumn("_1", F.lit(1)).join(F.broadcast(best.withColumn("_1", F.lit(1))), "_1").drop("_1")


def tempered_blend(df: DataFrame, keys: Sequence[str] = (), frac: float = 0.8, least: int = 30) -> DataFrame:
    """Temperature, then blend weight, both tuned on the latest days; the whole set if they hold under ``least`` rows.

    Stages the tuning rows and the temperatures.
    """
    split = time_split(df, frac, keys)
    late = split.groupBy(*keys).agg(F.sum("is_test").alias("_late"))
    tune = _attach(split, late, keys).where((F.col("is_test") == 1) | (F.col("_late") < least))
    tune = staged(tune.select(*keys, *P, *MARKET, "target"))
    temp = staged(choose_temperature(tune, keys).drop("loss"))
    scaled = _attach(tune, temp, keys)
    scaled = scaled.withColumns(named(temperature_scale(triple(), F.col("temperature"))))
    weight = tune_blend(scaled, COARSE_WEIGHTS, keys)
    return _attach(weight, temp, keys)


# --- market overlay --------------------------------------------------------


def meta_features(df: DataFrame, market: Sequence[str] = MARKET) -> dict[str, Column]:
    """Seventeen columns: log odds against the draw, probabilities, favourites and edges."""
    out: dict[str, Column] = {}
    p, m = triple(), triple(market)
    for name, q in (("model", p), ("market", m)):
        c = [F.least(F.greatest(x, F.lit(1e-6)), F.lit(1.0 - 1e-6)) for x in normalize_probs(q)]
        out[f"{name}_home_logit_vs_draw"] = F.log(c[0] / c[1])
        out[f"{name}_away_logit_vs_draw"] = F.log(c[2] / c[1])
        for label, x in zip(("home", "draw", "away"), c, strict=True):
            out[f"{name}_{label}_prob"] = x
        out[f"{name}_favorite_prob"] = F.greatest(*c)
    for label, x, y in zip(("home", "draw", "away"), p, m, strict=True):
        out[f"edge_{label}"] = x - y
    out["abs_edge_max"] = F.greatest(*[F.abs(x - y) for x, y in zip(p, m, strict=True)])
    out["model_minus_market_favorite"] = F.greatest(*p) - F.greatest(*m)
    return out


# --- draw overlay ----------------------------------------------------------

# The overlay search.
SCORE_QUANTILES = (0.50, 0.60, 0.70, 0.80)
SPREADS = (0.08, 0.12, 0.16, 0.20)
BOOSTS = (0.01, 0.02, 0.03, 0.04, 0.05, 0.06)
STRATEGIES = ("draw_score", "low_spread", "draw_score_and_low_spread")


def overlay_mask(strategy: Column, score: Column, spread: Column, threshold: Column, limit: Column) -> Column:
    high, close = score >= threshold, spread <= limit
    return (
        F.when(strategy == "draw_score", high).when(strategy == "low_spread", close).otherwise(high & close)
    )


def tune_draw_overlay(df: DataFrame, least: int = 20) -> DataFrame:
    """Overlay results on the calibration (``is_test`` = 0) and test rows, with the selected one marked.

    Needs p_*, target, draw_score, is_test.  Candidates that lower the log loss
    without hurting the Brier score by 0.001 or the calibration error by 0.01 on
    the calibration rows come first; the least (log loss, Brier) wins.  Stages the
    cut points and the table of settings.
    """
    cal = df.where("is_test = 0")
    cuts = staged(exact_quantiles(cal, [], "draw_score", SCORE_QUANTILES).agg(F.sort_array(F.collect_list("value")).alias("cuts")))
    rows = _attach(df.select(*P, "target", "draw_score", "is_test"), cuts, ())
    settings = [(None, 0, 0, 0.0)]
    for s in STRATEGIES:
        for i in range(len(SCORE_QUANTILES)):
            for j in range(len(SPREADS)):
                if (s == "draw_score" and j) or (s == "low_spread" and i):
                    continue
                settings += [(s, i, j, b) for b in BOOSTS]
    grid = F.array(
        *[
            F.struct(F.lit(s or "none").alias("strategy"), F.lit(i).alias("ti"), F.lit(SPREADS[j]).alias("spread_threshold"), F.lit(b).alias("boost"))
            for s, i, j, b in settings
        ]
    )
    wide = rows.select("*", F.inline(grid)).withColumn("threshold", F.get("cuts", F.col("ti")))
    spread = F.abs(F.col("p_home") - F.col("p_away"))
    mask = overlay_mask(F.col("strategy"), F.col("draw_score"), spread, F.col("threshold"), F.col("spread_threshold"))
    wide = wide.withColumn("_m", F.when(F.col("strategy") == "none", F.lit(False)).otherwise(mask))
    wide = wide.withColumns(named(draw_overlay(triple(), F.col("_m"), F.col("boost")), ("q_home", "q_draw", "q_away")))
    q = triple(("q_home", "q_draw", "q_away"))
    t = F.col("target")
    key = ["strategy", "threshold", "spread_threshold", "boost"]
    first = F.col("k") == 0
    parts = (
        wide.withColumns({"_l": log_loss(q, t), "_b": brier(q, t)})
        .withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        .withColumns({"p": pick(F.col("k"), q), "y": (t == F.col("k")).cast("double")})
        .groupBy(*key, "is_test", "k", bin_index(F.col("p")).alias("bin"))
        .agg(
            F.count("*").alias("n"), F.sum("p").alias("p"), F.sum("y").alias("y"),
            F.sum(F.when(first, F.col("_l"))).alias("l"), F.sum(F.when(first, F.col("_b"))).alias("b"),
            F.sum(F.when(first, F.col("_m").cast("long"))).alias("m"),
        )
    )
    scores = parts.groupBy(*key, "is_test").agg(
        (F.sum("l") / F.sum(F.when(first, F.col("n")))).alias("log_loss"),
        (F.sum("b") / F.sum(F.when(first, F.col("n")))).alias("brier"),
        (F.sum(F.abs(F.col("y") - F.col("p"))) / F.sum("n")).alias("ece"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("adjusted"),
    )
    side = lambda flag, c: F.max(F.when(F.col("is_test") == flag, F.col(c)))
    table = scores.groupBy(*key).agg(
        *[side(f, c).alias(f"{n}_{c}") for f, n in ((0, "calibration"), (1, "test")) for c in ("log_loss", "brier", "ece", "adjusted")]
    ).where((F.col("strategy") == "none") | (F.col("calibration_adjusted") >= least))
    # One row per setting, read three times below.
    table = staged(table)
    base = table.where("strategy = 'none'").select(*[F.col(f"calibration_{c}").alias("_" + c) for c in ("log_loss", "brier", "ece")])
    table = _attach(table, base, ())
    d = lambda c: F.col(f"calibration_{c}") - F.col("_" + c)
    valid = (d("log_loss") < 0) & (d("brier") <= 0.001) & (d("ece") <= 0.01)
    order = F.struct((~valid).cast("int").alias("a"), F.col("calibration_log_loss").alias("b"), F.col("calibration_brier").alias("c"), *[F.col(k) for k in key])
    best = table.where("strategy <> 'none'").agg(F.min(order).alias("_best"))
    out = _attach(table, best, ())
    is_best = F.coalesce(
        (F.col("strategy") == F.col("_best.strategy")) & (F.col("threshold") == F.col("_best.threshold"))
        & (F.col("spread_threshold") == F.col("_best.spread_threshold")) & (F.col("boost") == F.col("_best.boost")),
        F.lit(False),
    )
    return out.withColumn("selected", is_best.cast("int")).drop("_best", "_log_loss", "_brier", "_ece")


def selection_gate(results: DataFrame, baseline: str, model: str = "model_version") -> DataFrame:
    """Best candidate, its deltas to the baseline and whether to adopt it."""
    metrics = ("log_loss", "brier_score", "ece")
    base = results.where(F.col(model) == baseline).select(*[F.col(m).alias("_" + m) for m in metrics])
    best = (
        results.where(F.col(model) != baseline)
        .agg(F.min(F.struct("log_loss", "brier_score", model, "ece")).alias("b"))
        .select("b.*")
    )
    out = _attach(best, base, ()).withColumns({f"{m}_delta": F.col(m) - F.col("_" + m) for m in metrics})
    adopt = (F.col("log_loss_delta") < 0) & (F.col("brier_score_delta") <= 0) & (F.col("ece_delta") <= 0.01)
    return out.withColumn("adopt", adopt.cast("int")).drop(*["_" + m for m in metrics])


# --- priors ----------------------------------------------------------------

SQUAD_MAX_WEIGHT = 0.08
LONG_TERM_WEIGHT = 0.35


def _team_value(df: DataFrame, values: DataFrame, column: str, name: str) -> DataFrame:
    out = df
    for side in ("home", "away"):
        out = out.join(values.select(F.col("team").alias(side), F.col(column).alias(f"{side}_{name}")), side, "left")
    return out


def squad_prior(probs: DataFrame, scores: DataFrame, keys: Sequence[str] = ("season",), max_weight: float = SQUAD_MAX_WEIGHT) -> DataFrame:
    """Blend a strength prior early in the season: the weight falls with the teams' match number.

    A missing score leaves the triple unchanged.  ``scores(team, score)``.
    """
    sides = probs.select("match_id", "match_date", *keys, F.explode(F.array("home", "away")).alias("team"))
    h = History(sides, ["team", *keys], totals={"_n": F.lit(1)})
    number = h.real(h.frame.withColumn("k", F.coalesce(F.sum("_n").over(h.running()), F.lit(0)) + 1))
    phase = number.groupBy("match_id").agg(F.min("k").alias("phase"))
    rows = _team_value(probs.join(phase, "match_id"), scores, "score", "score")
    w = F.least(F.lit(max_weight), F.when(F.col("phase") <= 5, 0.08).when(F.col("phase") <= 12, 0.05).otherwise(0.025))
    gap = F.col("home_score") - F.col("away_score")
    prior = softmax3((0.18 + 0.65 * gap, -0.05 - 0.04 * F.abs(gap), -0.18 - 0.65 * gap))
    mixed = [(1.0 - w) * x + w * y for x, y in zip(triple(), prior, strict=True)]
    total = mixed[0] + mixed[1] + mixed[2]
    new = {"adj_" + c: F.when(gap.isNull(), F.col(c)).otherwise(x / total) for c, x in zip(P, mixed, strict=True)}
    return rows.withColumns({"squad_prior_weight": w, "strength_diff": gap, **new})


def long_term_prior(probs: DataFrame, strength: DataFrame, weight: float = LONG_TERM_WEIGHT) -> DataFrame:
    """Blend with a prior from long-term strength; a missing team counts as 0.  ``strength(team, strength)``."""
    rows = _team_value(probs, strength, "strength", "strength").na.fill(0.0, ["home_strength", "away_strength"])
    gap = F.col("home_strength") - F.col("away_strength")
    prior = softmax3((0.22 + 0.52 * gap, -0.06 - 0.05 * F.abs(gap), -0.22 - 0.52 * gap))
    mixed = [(1.0 - weight) * x + weight * y for x, y in zip(triple(), prior, strict=True)]
    total = mixed[0] + mixed[1] + mixed[2]
    return rows.withColumns({"adj_" + c: x / total for c, x in zip(P, mixed, strict=True)})


# --- prices ----------------------------------------------------------------

# Price sources in order of preference, by column prefix, with their labels.
CLOSING_PRICES = (
    ("AvgC", "average closing odds"),
    ("MaxC", "maximum closing odds"),
    ("B365C", "Bet365 closing odds"),
    ("BWC", "Bwin closing odds"),
    ("IWC", "Interwetten closing odds"),
    ("PSC", "Pinnacle closing odds"),
    ("WHC", "William Hill closing odds"),
    ("VCC", "VC Bet closing odds"),
    ("BFC", "Betfair closing odds"),
    ("BFEC", "Betfair Exchange closing odds"),
    ("1XBC", "1xBet closing odds"),
    ("Avg", "average listed odds"),
    ("Max", "maximum listed odds"),
)
# Fixed values.
PRECLOSING_PRICES = (
    ("Avg", "average pre-closing odds"),
    ("Max", "maximum pre-closing odds"),
    ("B365", "Bet365 pre-closing odds"),
    ("BW", "Bwin pre-closing odds"),
    ("IW", "Interwetten pre-closing odds"),
    ("PS", "Pinnacle pre-closing odds"),
    ("WH", "William Hill pre-closing odds"),
    ("VC", "VC Bet pre-closing odds"),
    ("BF", "Betfair pre-closing odds"),
    ("BFE", "Betfair Exchange pre-closing odds"),
    ("1XB", "1xBet pre-closing odds"),
    ("BFD", "Betfred pre-closing odds"),
    ("BMGM", "BetMGM pre-closing odds"),
    ("BV", "BetVictor pre-closing odds"),
    ("CL", "Coral pre-closing odds"),
    ("LB", "Ladbrokes pre-closing odds"),
)
# Fixed values.
LISTED_PRICES = (
    ("B365", "Bet365 listed odds"),
    ("BW", "Bwin listed odds"),
    ("IW", "Interwetten listed odds"),
    ("PS", "Pinnacle listed odds"),
    ("WH", "William Hill listed odds"),
    ("VC", "VC Bet listed odds"),
    ("BF", "Betfair listed odds"),
    ("1XB", "1xBet listed odds"),
)
PRICE_MODES = {
    "none": (), "opening": (), "safe-prematch": (),
    "preclosing": PRECLOSING_PRICES,
    "benchmark": CLOSING_PRICES,
    "research": LISTED_PRICES + CLOSING_PRICES,
}


def _chosen(columns: Sequence[str], mode: str) -> Column:
    """The first source of ``mode`` among ``columns`` whose three prices all exceed 1, as a struct (h, d, a, s); null if none."""
    if mode not in PRICE_MODES:
        raise ValueError(f"unknown market mode: {mode}")
    options = []
    for prefix, label in PRICE_MODES[mode]:
        cols = [prefix + outcome for outcome in "HDA"]
        if not set(cols) <= set(columns):
            continue
        h, d, a = (F.col(f"`{c}`").try_cast("double") for c in cols)
        ok = (h > 1) & (d > 1) & (a > 1)
        options.append(F.when(ok, F.struct(h.alias("h"), d.alias("d"), a.alias("a"), F.lit(label).alias("s"))))
    return F.coalesce(*options) if options else F.lit(None).cast("struct<h:double,d:double,a:double,s:string>")


def _odds_of(chosen: str) -> dict[str, Column]:
    return {n: F.col(f"{chosen}.{f}") for n, f in (("home_odds", "h"), ("draw_odds", "d"), ("away_odds", "a"), ("odds_source", "s"))}


def select_odds(df: DataFrame, mode: str) -> DataFrame:
    """First source whose three prices all exceed 1: adds home_odds, draw_odds, away_odds, odds_source (its label)."""
    return df.withColumn("_o", _chosen(df.columns, mode)).withColumns(_odds_of("_o")).drop("_o")


def select_odds_by_mode(df: DataFrame, modes: Sequence[str], keys: Sequence[str] = ("match_id",)) -> DataFrame:
    """``select_odds`` for several modes, a row of (keys, mode, odds) for each; ``df`` is read once."""
    each = [F.struct(F.lit(m).alias("mode"), _chosen(df.columns, m).alias("_o")) for m in modes]
    return df.select(*keys, F.inline(F.array(*each))).select(*keys, "mode", *[c.alias(n) for n, c in _odds_of("_o").items()])
