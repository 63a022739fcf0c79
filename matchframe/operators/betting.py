"""Flat-stake back-tests of probability tables against prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchframe.functions.probs import P, argmax3, fair_odds, triple
from matchframe.operators.joins import cross_grid

OUTCOMES = ("home", "draw", "away")
ODDS = ("odds_h", "odds_d", "odds_a")
# Edge thresholds of the back-test.
THRESHOLDS = (0.0, 0.03, 0.05, 0.08, 0.10)
STAKE = 1.0


def edge_table(df: DataFrame, market: Sequence[str] = ("m_home", "m_draw", "m_away"), odds: Sequence[str] = ODDS) -> DataFrame:
    """Fair odds, edges, picks and confidences per match."""
    p, m = triple(), triple(market)
    fair = fair_odds(p)
    cols: dict[str, Column] = {}
    for o, f, price in zip(OUTCOMES, fair, odds, strict=True):
        cols[f"{o}_fair_odds"] = f
        cols[f"{o}_edge"] = F.col(price) / f - 1.0
    cols.update(
        model_pick=argmax3(p), market_pick=argmax3(m), model_confidence=F.greatest(*p), market_confidence=F.greatest(*m)
    )
    return df.withColumns(cols)


def _bets(edges: DataFrame, odds: Sequence[str] = ODDS) -> DataFrame:
    """All three possible bets per match with profit for a unit stake."""
    options = F.array(
        *[
            F.struct(
                F.lit(i).alias("k"), F.lit(o).alias("bet_type"), F.col(P[i]).alias("model_probability"),
                F.col(odds[i]).alias("bookmaker_odds"), F.col(f"{o}_edge").alias("edge"),
            )
            for i, o in enumerate(OUTCOMES)
        ]
    )
    rows = edges.select(
        "match_id", "match_date", "target", "model_pick", "market_pick", "model_confidence", F.inline(options)
    )
    won = (F.col("k") == F.col("target")).cast("int")
    return rows.withColumns(
        {"won": won, "stake": F.lit(STAKE), "profit": F.when(won == 1, F.col("bookmaker_odds") - STAKE).otherwise(-STAKE)}
    )


def edge_bets(edges: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """One bet per outcome whose edge exceeds the threshold, for every threshold."""
    return cross_grid(_bets(edges), threshold=list(thresholds)).where(F.col("edge") > F.col("threshold"))


def pick_bets(edges: DataFrame, picker: str = "model") -> DataFrame:
    """Always back the top pick of the model or the market."""
    return _bets(edges).where(F.col("k") == F.col(f"{picker}_pick"))


def max_drawdown(bets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest fall of cumulative profit below its running peak (at least 0), per key.

    Each day of a key gives its sum, its worst fall, its low and its high; the days,
    one row each, then combine through the sums and the highest peak before them.
    """
    k = list(keys)
    ties = [c for c in ("match_id", "bet_type") if c not in k]
    order = Window.partitionBy(*k, "match_date").orderBy(*ties).rowsBetween(Window.unboundedPreceding, 0)
    inside = bets.select(*k, "match_date", *ties, F.sum("profit").over(order).alias("cum"), "profit")
    peaks = inside.withColumn("peak", F.max("cum").over(order))
    days = peaks.groupBy(*k, "match_date").agg(
        F.sum("profit").alias("sum"), F.max(F.col("peak") - F.col("cum")).alias("fall"), F.min("cum").alias("low"), F.max("cum").alias("high")
    )
    prior = Window.partitionBy(*k).orderBy("match_date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("before", F.coalesce(F.sum("sum").over(prior), F.lit(0.0)))
    start = F.greatest(F.coalesce(F.max(F.col("before") + F.col("high")).over(prior), F.lit(0.0)), F.lit(0.0))
    worst = F.greatest("fall", start - F.col("before") - F.col("low"))
    return days.withColumn("worst", worst).groupBy(*k).agg(F.max("worst").alias("maximum_drawdown"))


def bet_summary(bets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bets, hit rate, profit, stake, return, drawdown, mean edge and mean odds per key."""
    sums = bets.groupBy(*keys).agg(
        F.count("*").alias("bets"), F.avg("won").alias("hit_rate"), F.sum("profit").alias("profit"), F.sum("stake").alias("stake"),
        F.avg("edge").alias("average_edge"), F.avg("bookmaker_odds").alias("average_odds"),
    )
    out = sums.withColumns(
        {"roi": F.when(F.col("stake") != 0, F.col("profit") / F.col("stake")).otherwise(0.0), "yield": F.col("profit") / F.col("bets")}
    )
    return out.join(max_drawdown(bets, keys), list(keys))
