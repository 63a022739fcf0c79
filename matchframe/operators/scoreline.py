"""Scoreline grids: a fixed number of cells per match, built in place without a shuffle."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchframe.functions.probs import P, argmax3, triple

MAX_GOALS = 6
LEAGUE_HOME, LEAGUE_AWAY = 1.45, 1.15


def expected_goals(df: DataFrame, probs: Sequence[str] = P) -> DataFrame:
    """Attack and opposing defence blended, nudged toward the 1X2 view, within [0.2, 4]."""
    h, d, a = triple(probs)
    total = h + d + a
    balance = F.when(total != 0, (h - a) / total).otherwise(0.0)

    def value(c: str, fallback: float) -> Column:
        if c not in df.columns:
            return F.lit(fallback)
        v = F.col(c).cast("double")
        return F.when(v.isNotNull() & ~F.isnan(v) & (v > 0), v).otherwise(fallback)

    eh = 0.55 * value("home_xg_avg", LEAGUE_HOME) + 0.45 * value("away_xga_avg", LEAGUE_HOME)
    ea = 0.55 * value("away_xg_avg", LEAGUE_AWAY) + 0.45 * value("home_xga_avg", LEAGUE_AWAY)
    clip = lambda c: F.least(F.greatest(c, F.lit(0.2)), F.lit(4.0))
    return df.withColumns(
        {"expected_home_goals": clip(eh * F.exp(0.22 * balance)), "expected_away_goals": clip(ea * F.exp(-0.22 * balance))}
    )


def _sum(xs: list[Column]) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out + x
    return out


def with_cells(
    df: DataFrame, home: str = "expected_home_goals", away: str = "expected_away_goals", *, align: Sequence[str] | None = None, top: int = MAX_GOALS
) -> DataFrame:
    """Adds ``cells``: array of (h, a, p) summing to 1; with ``align`` the buckets match that triple."""
    goals = range(top + 1)
    raw = {
        f"_{s}{k}": F.exp(-F.col(m)) * F.pow(F.col(m), F.lit(float(k))) / math.factorial(k)
        for s, m in (("h", home), ("a", away))
        for k in goals
    }
    h, a = ([F.col(f"_{s}{k}") for k in goals] for s in "ha")
    out = df.withColumns(raw).withColumns(
        {
            "_w": _sum([h[i] * _sum(a[:i]) for i in goals if i]),
            "_d": _sum([h[i] * a[i] for i in goals]),
            "_l": _sum([a[i] * _sum(h[:i]) for i in goals if i]),
        }
    )
    buckets = [F.col(c) for c in ("_w", "_d", "_l")]
    mass = _sum(buckets)
    if align is None:
        scale = [1.0 / mass] * 3
    else:
        t = [F.least(F.greatest(F.col(c), F.lit(1e-12)), F.lit(1.0)) for c in align]
        hit = [F.when(b > 0, x / _sum(t)).otherwise(0.0) for b, x in zip(buckets, t, strict=True)]
        scale = [F.when(b > 0, x / b / _sum(hit)).otherwise(0.0) for b, x in zip(buckets, hit, strict=True)]
    out = out.withColumns({f"_s{i}": s for i, s in enumerate(scale)})
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("h"), F.lit(j).alias("a"),
                (h[i] * a[j] * F.col("_s0" if i > j else "_s1" if i == j else "_s2")).alias("p"),
            )
            for i in goals
            for j in goals
        ]
    )
    return out.withColumn("cells", cells).drop(*raw, "_w", "_d", "_l", "_s0", "_s1", "_s2")


def scoreline_grid(df: DataFrame, keys: Sequence[str] = ("match_id",), top: int = MAX_GOALS) -> DataFrame:
    """Long form of ``cells``: (keys..., h, a, p).

    Expands a literal index: expanding the array itself makes the optimizer push
    a copy of its whole definition into a filter.
    """
    index = F.explode(F.sequence(F.lit(0), F.lit((top + 1) ** 2 - 1))).alias("_k")
    return df.select(*keys, "cells", index).withColumn("_c", F.get("cells", F.col("_k"))).select(*keys, "_c.h", "_c.a", "_c.p")


def bucket_probabilities(grid: DataFrame, keys: Sequence[str] = ("match_id",)) -> DataFrame:
    h, a = F.col("h"), F.col("a")
    part = lambda c: F.sum(F.when(c, F.col("p")).otherwise(0.0))
    return grid.groupBy(*keys).agg(part(h > a).alias("home"), part(h == a).alias("draw"), part(h < a).alias("away"))


BUCKETS = ("all", "home", "draw", "away")


def ranked_cells(bucket: str = "all") -> Column:
    """Cells of a bucket, most likely first; equal ones (to 12 places) keep (h, a) order."""
    keep = {"all": lambda c: F.lit(True), "home": lambda c: c["h"] > c["a"], "draw": lambda c: c["h"] == c["a"], "away": lambda c: c["h"] < c["a"]}
    some = F.filter("cells", keep[bucket])
    return F.sort_array(
        F.transform(some, lambda c: F.struct((-F.round(c["p"], 12)).alias("o"), c["h"].alias("h"), c["a"].alias("a"), c["p"].alias("p")))
    )


def top_scorelines(df: DataFrame, n: int = 5, per_bucket: int = 3, keys: Sequence[str] = ("match_id",)) -> DataFrame:
    """(keys..., bucket, rank, h, a, p): the top ``n`` overall and the top few per outcome."""
    slots = [(b, i) for b in BUCKETS for i in range(n if b == "all" else per_bucket)]
    pick = F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(i).alias("i")) for b, i in slots])).alias("_s")
    rows = df.withColumns({"_" + b: F.slice(ranked_cells(b), 1, n if b == "all" else per_bucket) for b in BUCKETS})
    rows = rows.select(*keys, *["_" + b for b in BUCKETS], pick)
    bucket = F.col("_s.bucket")
    best = F.col("_away")
    for b in BUCKETS[:-1]:
        best = F.when(bucket == b, F.col("_" + b)).otherwise(best)
    return rows.withColumn("_c", F.get(best, F.col("_s.i"))).select(
        *keys, "_s.bucket", (F.col("_s.i") + 1).alias("rank"), "_c.h", "_c.a", "_c.p"
    ).where("h IS NOT NULL")


def predicted_scoreline(df: DataFrame, probs: Sequence[str] = P) -> DataFrame:
    """Best cell of the outcome that the triple favours."""
    best = F.when(argmax3(triple(probs)) == 0, ranked_cells("home")[0]).when(
        argmax3(triple(probs)) == 1, ranked_cells("draw")[0]
    ).otherwise(ranked_cells("away")[0])
    return df.withColumn("_b", best).withColumns(
        {"pred_h": F.col("_b.h"), "pred_a": F.col("_b.a"), "pred_p": F.col("_b.p")}
    ).drop("_b")


def estimate_scorelines(df: DataFrame, probs: Sequence[str] = P) -> DataFrame:
    """Expected goals, aligned cells and the predicted scoreline."""
    return predicted_scoreline(with_cells(expected_goals(df, probs), align=probs), probs)


def scoreline_metrics(df: DataFrame, keys: Sequence[str] = (), probs: Sequence[str] = P) -> DataFrame:
    """Exact, top-3 and top-5 hits, probability of the actual score, its log loss and the alignment error."""
    best = F.slice(ranked_cells("all"), 1, 5)
    same = lambda c: (c["h"] == F.col("hg")) & (c["a"] == F.col("ag"))
    found = F.filter("cells", same)
    p = F.greatest(F.coalesce(F.get(found, F.lit(0))["p"], F.lit(1e-15)), F.lit(1e-15))
    rows = df.withColumns({"_best": best, "_p": p})
    place = F.coalesce(F.array_position(F.transform("_best", same), F.lit(True)), F.lit(0))
    error = [
        F.abs(F.aggregate(F.filter("cells", f), F.lit(0.0), lambda acc, c: acc + c["p"]) - F.col(t))
        for t, f in zip(probs, (lambda c: c["h"] > c["a"], lambda c: c["h"] == c["a"], lambda c: c["h"] < c["a"]), strict=True)
    ]
    rows = rows.withColumns({"_place": place, "_err": F.greatest(*error)})
    hit = lambda n: F.avg(F.col("_place").between(1, n).cast("double"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("test_matches"), hit(1).alias("correct_score_accuracy"), hit(3).alias("top_3_hit_rate"),
        hit(5).alias("top_5_hit_rate"), F.avg("_p").alias("mean_probability_assigned_to_actual"),
        (-F.avg(F.log("_p"))).alias("scoreline_log_loss"), F.avg("_err").alias("mean_1x2_alignment_error"),
        F.max("_err").alias("max_1x2_alignment_error"),
    )
