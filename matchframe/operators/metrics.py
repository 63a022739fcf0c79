"""Evaluation of probability tables: (match, p_home, p_draw, p_away, target) grouped by any keys."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchframe.functions import clean as C
from matchframe.functions.probs import FLOOR, P, Triple, argmax3, brier, log_loss, normalize_probs, pick, triple
from matchframe.shipping import ship

CLASSES = ("home_win", "draw", "away_win")


def bin_edges(bins: int = 10) -> list[float]:
    return [i * (1.0 / bins) for i in range(bins + 1)]


def bin_index(p: Column, bins: int = 10) -> Column:
    """Index of the half-open bin of ``p``; the last bin is closed."""
    out = F.lit(bins - 1)
    edges = bin_edges(bins)
    for i in reversed(range(bins - 1)):
        out = F.when(p < edges[i + 1], i).otherwise(out)
    return out


def _edge(index: Column, bins: int) -> Column:
    return F.get(F.array(*[F.lit(e) for e in bin_edges(bins)]), index)


def score_probs(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    p = triple()
    hit = (argmax3(normalize_probs(p)) == F.col("target")).cast("double")
    return df.groupBy(*keys).agg(
        F.count("*").alias("matches"),
        F.avg(hit).alias("accuracy"),
        F.avg(log_loss(p, F.col("target"))).alias("log_loss"),
        F.avg(brier(p, F.col("target"))).alias("brier_score"),
    )


def confusion(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.col("target").alias("actual"), argmax3(triple()).alias("predicted")).agg(F.count("*").alias("n"))


def by_class(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Three rows per match: class, its probability ``p`` and whether it happened ``y``."""
    rows = F.inline(
        F.array(
            *[
                F.struct(F.lit(name).alias("class"), F.col(c).alias("p"), (F.col("target") == i).cast("double").alias("y"))
                for i, (name, c) in enumerate(zip(CLASSES, P, strict=True))
            ]
        )
    )
    return df.select(*keep, rows)


def brier_by_class(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return by_class(df, keys).groupBy(*keys, "class").agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))


def calibration_table(df: DataFrame, keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    b = bin_index(F.col("p"), bins)
    out = by_class(df, keys).groupBy(*keys, "class", b.alias("bin")).agg(
        F.count("*").alias("count"),
        F.avg("p").alias("mean_predicted_probability"),
        F.avg("y").alias("observed_frequency"),
    )
    return out.withColumns({"bin_lower": _edge(F.col("bin"), bins), "bin_upper": _edge(F.col("bin") + 1, bins)})


def calibration_summary(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per class: weighted absolute and signed error and a plain-words label."""
    err = F.col("observed_frequency") - F.col("mean_predicted_probability")
    n = F.sum("count")
    signed = F.sum(err * F.col("count")) / n
    out = table.groupBy(*keys, "class").agg(
        (F.sum(F.abs(err) * F.col("count")) / n).alias("mean_absolute_calibration_error"),
        signed.alias("mean_signed_calibration_error"),
    )
    s = F.col("mean_signed_calibration_error")
    return out.withColumn(
        "diagnosis",
        F.when(s < -0.02, "overconfident / overpredicted")
        .when(s > 0.02, "underconfident / underpredicted")
        .otherwise("reasonably calibrated"),
    )


def ece(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    err = F.abs(F.col("observed_frequency") - F.col("mean_predicted_probability"))
    return table.groupBy(*keys).agg((F.sum(err * F.col("count")) / F.sum("count")).alias("ece"))


def class_performance(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    rows = by_class(df.withColumn("_pick", argmax3(triple())), [*keys, "_pick"])
    hit = F.col("y") == 1
    idx = F.when(F.col("class") == CLASSES[0], 0).when(F.col("class") == CLASSES[1], 1).otherwise(2)

    def over(c: Column) -> Column:
        return F.coalesce(F.avg(F.when(hit, c)), F.lit(0.0))

    return rows.groupBy(*keys, "class").agg(
        F.sum("y").cast("long").alias("support"),
        F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("one_vs_rest_brier"),
        over((F.col("_pick") == idx).cast("double")).alias("actual_class_accuracy"),
        over(F.col("p")).alias("actual_class_mean_probability"),
        over(-F.log(F.greatest("p", F.lit(FLOOR)))).alias("actual_class_log_loss"),
    )


def confidence_table(df: DataFrame, keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    top = F.greatest(*triple())
    hit = (argmax3(triple()) == F.col("target")).cast("double")
    out = df.groupBy(*keys, bin_index(top, bins).alias("bin")).agg(
        F.count("*").alias("count"), F.avg(top).alias("mean_confidence"), F.avg(hit).alias("accuracy")
    )
    gap = F.col("mean_confidence") - F.col("accuracy")
    return out.withColumns(
        {"bin_lower": _edge(F.col("bin"), bins), "bin_upper": _edge(F.col("bin") + 1, bins), "confidence_minus_accuracy": gap}
    )


def prediction_rows(df: DataFrame) -> DataFrame:
    """Pick, confidence and individual log loss per match."""
    p = triple()
    return df.withColumns(
        {
            "predicted": argmax3(p),
            "predicted_confidence": F.greatest(*p),
            "actual_probability": pick(F.col("target"), p),
            "individual_log_loss": -F.log(F.greatest(pick(F.col("target"), p), F.lit(FLOOR))),
        }
    )


def worst_predictions(df: DataFrame, n: int = 25, tie: str = "match_id") -> DataFrame:
    return prediction_rows(df).orderBy(F.col("individual_log_loss").desc(), F.col(tie).asc()).limit(n)


def failure_flags(df: DataFrame, *, rest: tuple[Column, Column], promoted: Column) -> DataFrame:
    rows = prediction_rows(df)
    wrong = F.col("predicted") != F.col("target")
    favourite = F.col("p_home") >= F.greatest("p_draw", "p_away")
    return rows.withColumns(
        {
            "high_confidence_wrong": (wrong & (F.col("predicted_confidence") > 0.70)).cast("int"),
            "home_favorite_failure": (favourite & (F.col("target") != 0)).cast("int"),
            "draw_as_home": ((F.col("target") == 1) & (F.col("predicted") == 0)).cast("int"),
            "suspicious_rest_gap": ((rest[0] > 30) | (rest[1] > 30)).cast("int"),
            "promoted_team_involved": promoted.cast("int"),
        }
    )


def failure_teams(flags: DataFrame) -> DataFrame:
    """How often each team appears in confident misses."""
    miss = flags.where("high_confidence_wrong = 1")
    return miss.select(F.explode(F.array("home", "away")).alias("team")).groupBy("team").agg(F.count("*").alias("n"))


def _least_index(p: Triple) -> Column:
    h, d, a = p
    return F.when((h <= d) & (h <= a), 0).when(d <= a, 1).otherwise(2)


def draw_metrics(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Recall, precision, both draw log losses, rates, top-two rate and double chance.

    The two most likely classes are all but the first least likely one.
    """
    p = normalize_probs(triple())
    draw = (F.col("target") == 1).cast("double")
    said = (argmax3(p) == 1).cast("double")
    out = _least_index(p)
    pd = p[1]
    n_draw, n_said, both = F.sum(draw), F.sum(said), F.sum(draw * said)

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    scores = df.groupBy(*keys).agg(
        share(both, n_draw).alias("draw_recall"),
        share(both, n_said).alias("draw_precision"),
        F.avg(F.when(draw == 1, -F.log(pd))).alias("draw_log_loss_on_draws"),
        (-F.avg(draw * F.log(pd) + (1 - draw) * F.log(1 - pd))).alias("draw_log_loss"),
        F.avg((out != 1).cast("double")).alias("draw_top2_rate"),
        F.avg(draw).alias("actual_draw_rate"),
        F.avg(said).alias("predicted_draw_top1_rate"),
        F.avg(pd).alias("mean_draw_probability"),
        (F.avg(pd) - F.avg(draw)).alias("draw_probability_gap"),
        F.avg((out != F.col("target")).cast("double")).alias("double_chance_hit_rate"),
    )
    table = calibration_table(df, keys).where(F.col("class") == "draw")
    error = ece(table, keys).withColumnRenamed("ece", "draw_calibration_error")
    if keys:
        return scores.join(error, list(keys))
    one = F.lit(1).alias("_1")
    return scores.select("*", one).join(error.select("*", one), "_1").drop("_1")


def segment_metrics(df: DataFrame, segments: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Scores, calibration error and draw scores for overlapping segments."""
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in segments.items()]), lambda s: s.isNotNull())
    rows = df.withColumn("segment", F.explode(names))
    k = [*keys, "segment"]
    table = calibration_table(rows, k)
    draws = draw_metrics(rows, k).select(*k, "draw_recall", "draw_log_loss")
    return score_probs(rows, k).join(ece(table, k), k).join(draws, k)


OUTCOMES = ("home", "draw", "away")


def disagreement_table(df: DataFrame, model: Sequence[str] = P, market: Sequence[str] = ("m_home", "m_draw", "m_away")) -> DataFrame:
    p, m = triple(model), triple(market)
    edges = {f"edge_{o}": x - y for o, x, y in zip(OUTCOMES, p, m, strict=True)}
    t = F.col("target")
    loss = lambda q: -F.log(F.greatest(pick(t, q), F.lit(FLOOR)))
    rows = df.withColumns(
        {
            **edges,
            "model_pick": argmax3(p), "market_pick": argmax3(m),
            "model_confidence": F.greatest(*p), "market_confidence": F.greatest(*m),
            "model_log_loss": loss(p), "market_log_loss": loss(m),
        }
    )
    right = F.col("model_pick") == t
    return rows.withColumns(
        {
            "max_abs_edge": F.greatest(*[F.abs(F.col(e)) for e in edges]),
            "model_market_disagree": (F.col("model_pick") != F.col("market_pick")).cast("int"),
            "model_correct": right.cast("int"),
            "market_correct": (F.col("market_pick") == t).cast("int"),
            "edge_correct": (right & (F.col("model_log_loss") < F.col("market_log_loss"))).cast("int"),
        }
    )


def disagreement_summary(table: DataFrame) -> DataFrame:
    """All matches, disagreements and the top quartile of edges.  Stages the cut point."""
    from matchframe.operators.windows import exact_quantiles
    from matchframe.plans.stages import staged

    cut = staged(exact_quantiles(table, [], "max_abs_edge", [0.75])).select(F.col("value").alias("_cut"), F.lit(1).alias("_1"))
    rows = table.withColumn("_1", F.lit(1)).join(F.broadcast(cut), "_1")
    names = F.filter(
        F.array(
            F.lit("all_test_matches"),
            F.when(F.col("model_market_disagree") == 1, "model_market_disagreements"),
            F.when(F.col("max_abs_edge") >= F.col("_cut"), "large_edges_top_quartile"),
        ),
        lambda s: s.isNotNull(),
    )
    return rows.select(F.explode(names).alias("segment"), "model_correct", "market_correct", "max_abs_edge").groupBy("segment").agg(
        F.count("*").alias("matches"), F.avg("model_correct").alias("model_accuracy"),
        F.avg("market_correct").alias("market_accuracy"), F.avg("max_abs_edge").alias("mean_abs_edge"),
    )


def metric_deltas(results: DataFrame, baseline: str, metrics: Sequence[str], split: str = "season", model: str = "model_version") -> DataFrame:
    """Mean difference to the baseline per model, splits improved and splits tested; lower is better."""
    base = results.where(F.col(model) == baseline).select(split, *[F.col(m).alias("_b_" + m) for m in metrics])
    rows = results.where(F.col(model) != baseline).join(base, split, "left")
    aggs = []
    for m in metrics:
        d = F.col(m) - F.col("_b_" + m)
        aggs += [F.avg(d).alias(f"mean_{m}_delta"), F.sum((d < 0).cast("long")).alias(f"splits_{m}_improved")]
    return rows.groupBy(model).agg(*aggs, F.count_distinct(split).alias("splits_tested"))


_MOMENTS = ("n", "sx", "sy", "mxx", "myy", "mxy", "cxx", "cyy", "cxy")


def _pair_moments(width: int) -> Callable:
    """Per task and column: vectors of the moments with every column, from products of whole batches.

    Values are taken about the task's first batch means, so products stay small; what a task gives are its
    own centred products (c) and the raw ones of its means (m), which add up over tasks.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = None
        n, a, square, cross = (np.zeros((width, width)) for _ in range(4))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            there = ~np.isnan(x)
            if pivot is None:
                pivot = np.where(there, x, 0.0).sum(0) / np.maximum(there.sum(0), 1)
            x, mask = np.where(there, x - pivot, 0.0), there.astype(float)
            n += mask.T @ mask
            a += x.T @ mask
            square += (x * x).T @ mask
            cross += x.T @ x
        if pivot is None:
            return
        safe = np.maximum(n, 1)
        mx = np.where(n > 0, pivot[:, None] + a / safe, 0.0)
        cxx = square - a * a / safe
        parts = (n, n * mx, n * mx.T, n * mx * mx, n * mx.T * mx.T, n * mx * mx.T, cxx, cxx.T, cross - a * a.T / safe)
        flat = np.stack(parts, 1).reshape(width, -1)
        places = pa.array(np.arange(width + 1, dtype=np.int32) * flat.shape[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width, dtype=np.int32)), pa.ListArray.from_arrays(places, pa.array(flat.ravel()))], ["i", "v"]
        )

    return run


def correlation(df: DataFrame, columns: Sequence[str], others: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlations as (a, b, corr) over the rows that hold both; null without spread.

    One pass: tasks multiply batches of rows with themselves, and a vector for each column is added up over
    the tasks, so the plan does not grow with the pairs.  NaN counts as missing; no rows give no pairs.
    """
    ship(df.sparkSession)
    names = list(dict.fromkeys([*columns, *(others or ())]))
    rows = df.select(*[F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(names)])
    parts = rows.mapInArrow(_pair_moments(len(names)), "i int, v array<double>")
    sums = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).where("i IS NOT NULL")
    wanted = {c: k for k, c in enumerate(names)}
    ends = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(wanted[b]).alias("j")) for b in (others or columns)])
    pairs = sums.where(F.col("i").isin([wanted[c] for c in columns])).select("i", "v", F.inline(ends)).where("i <> j")
    m = {c: F.get("v", F.lit(k * len(names)) + F.col("j")) for k, c in enumerate(_MOMENTS)}
    spread = lambda c, raw, x, y: m[c] + m[raw] - m[x] * m[y] / F.greatest(m["n"], F.lit(1.0))
    xx, yy, xy = spread("cxx", "mxx", "sx", "sx"), spread("cyy", "myy", "sy", "sy"), spread("cxy", "mxy", "sx", "sy")
    # What rounding leaves of a constant's spread is none.
    some = (m["n"] > 0) & (xx > 1e-14 * m["mxx"]) & (yy > 1e-14 * m["myy"])
    first = F.get(F.array(*[F.lit(c) for c in names]), F.col("i"))
    return pairs.select(first.alias("a"), "b", F.when(some, xy / F.sqrt(xx * yy)).alias("corr"))


def correlation_groups(pairs: DataFrame, groups: dict[str, Sequence[str]], high: float = 0.80) -> DataFrame:
    """Per feature group: mean and largest |corr| with features of other groups and pairs at or above ``high``."""
    table = {f: g for g, fs in groups.items() for f in fs}
    ga, gb = C.lookup("a", table), C.lookup("b", table)
    size = F.abs(F.col("corr"))
    return pairs.where(ga != gb).groupBy(ga.alias("feature_group")).agg(
        F.count_distinct("a").alias("features"),
        F.avg(size).alias("mean_abs_corr"),
        F.max(size).alias("max_abs_corr"),
        F.sum((size >= high).cast("long")).alias("high_corr_pairs"),
    )


def most_correlated(pairs: DataFrame) -> DataFrame:
    size = F.abs(F.col("corr"))
    return pairs.where("corr IS NOT NULL").groupBy("a").agg(
        F.avg(size).alias("mean_abs_corr"), F.max(size).alias("max_abs_corr"), F.max_by("b", F.struct(size, "b")).alias("partner")
    )


def group_importance(df: DataFrame, rules=C.FEATURE_GROUPS["projection"], value: str = "importance") -> DataFrame:
    return df.groupBy(C.feature_group("feature", rules).alias("feature_group")).agg(F.sum(value).alias(value))


def regime_change(rows: DataFrame, gaps: Sequence[str]) -> DataFrame:
    """Mean and largest absolute gap between weighted and plain features per team."""
    aggs = [f(F.abs(F.col(g))).alias(f"{n}_abs_{g}") for g in gaps for n, f in (("mean", F.avg), ("max", F.max))]
    return rows.groupBy("team").agg(*aggs)


def split_effect(rows: DataFrame, flag: Column, value: str = "points", keys: Sequence[str] = ("team",)) -> DataFrame:
    """Mean with and without a condition and their difference; null where a side is empty."""
    f = F.coalesce(flag, F.lit(False))
    yes, no = F.avg(F.when(f, F.col(value))), F.avg(F.when(~f, F.col(value)))
    return rows.groupBy(*keys).agg(
        F.sum(f.cast("long")).alias("matches_with"), yes.alias("mean_with"), no.alias("mean_without"), (yes - no).alias("delta")
    )


def group_correlation(rows: DataFrame, x: str, y: str = "points", keys: Sequence[str] = ("team",), least: int = 10) -> DataFrame:
    """Correlation per key with at least ten rows and two distinct values of ``x``."""
    ok = (F.count("*") >= least) & (F.min(x) != F.max(x))
    c = F.corr(F.col(x).cast("double"), F.col(y).cast("double"))
    return rows.groupBy(*keys).agg(F.when(ok & ~F.isnan(c), c).alias("correlation"))


def style_performance(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matches and points per match by style, team and opposing style, or style pairing."""
    return rows.groupBy(*keys).agg(F.count("*").alias("matches"), F.avg("points").alias("points_per_match"))


def stability_score(std: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - std / 0.18))


def replicate_intervals(long: DataFrame, keys: Sequence[str] = ("row_id", "class")) -> DataFrame:
    """Mean, population deviation and 95 % range over replicates (a few dozen per key)."""
    q = F.percentile("p", F.array(F.lit(0.025), F.lit(0.975)))
    out = long.groupBy(*keys).agg(F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"), q.alias("_q"))
    return out.withColumns({"lower_95": F.col("_q")[0], "upper_95": F.col("_q")[1]}).drop("_q")


def stability_table(intervals: DataFrame, row: str = "row_id") -> DataFrame:
    """Stability score, label and the class with the widest interval per row."""
    width = F.col("upper_95") - F.col("lower_95")
    out = intervals.groupBy(row).agg(
        stability_score(F.avg("std")).alias("stability_score"), F.avg("std").alias("mean_probability_std"),
        F.max("std").alias("max_probability_std"), F.max_by("class", F.struct(width, "class")).alias("widest_class"),
    )
    label = C.stability_label(F.col("stability_score"))
    text = F.when(label == "High confidence", "Bootstrap models are stable").when(
        label == "Medium confidence", "Moderate model disagreement"
    ).otherwise("High model disagreement")
    explanation = F.concat(text, F.lit("; widest interval is for "), "widest_class", F.lit("."))
    return out.withColumns({"confidence_label": label, "explanation": explanation})


def hit_rate(forecasts: DataFrame, results: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Share of forecasts whose favourite came in, by round."""
    rows = forecasts.join(results, list(keys))
    return rows.groupBy(*by).agg(
        F.count("*").alias("matches"), F.avg((F.col("favorite") == F.col("result")).cast("double")).alias("hit_rate")
    )


def average_rank(df: DataFrame, keys: Sequence[str], by: str, name: str) -> DataFrame:
    """Ascending rank with ties sharing their mean, for the teams of one table."""
    w = Window.partitionBy(*keys).orderBy(by)
    peers = Window.partitionBy(*keys, by)
    return df.withColumn(name, F.rank().over(w) + (F.count("*").over(peers) - 1) / 2.0)
