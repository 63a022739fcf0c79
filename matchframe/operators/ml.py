"""Outcome models on Spark ML: fitting, validation, calibration, uncertainty, explanation.

Functions that fit models run jobs; each says so.  Only coefficients, trees, their
importances and row counts come back to the driver.
"""

from __future__ import annotations

import random
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchframe.functions.probs import FLOOR, P, blend, hash_uniform, log_loss, named, normalize_probs, softmax3, triple
from matchframe.operators.boosting import Booster, Trees, chance, fit_boosters, moved_losses, with_margins
from matchframe.operators.joins import union_by_name
from matchframe.operators.manyfits import array_intervals, fit_many
from matchframe.operators.metrics import CLASSES, calibration_table, ece, replicate_intervals, score_probs
from matchframe.operators.ratings import EloConfig, elo_grid
from matchframe.operators.tuning import MARKET, meta_features, time_split
from matchframe.operators.windows import uniform_rank
from matchframe.plans.stages import checkpoint_dir, staged
from matchframe.shipping import ship

SEED = 42
# Size of the boosted model.
ROUNDS, DEPTH, RATE, SHARE, STEPS = 150, 3, 0.05, 0.9, 1000
#: Fits that run at the same time: the small jobs of one fill the gaps between those of another.
FITS = 6
#: Rows whose walks through all trees are held at once.
WALK_ROWS = 2_000


def side_by_side(spark: SparkSession, fits: Sequence[Callable], width: int = FITS) -> list:
    """Results of independent fits in their order, ``width`` of them at a time."""
    if len(fits) < 2:
        return [f() for f in fits]
    with ThreadPool(min(width, len(fits))) as pool:
        return pool.map(lambda f: f(), [inheritable_thread_target(spark)(f) for f in fits], chunksize=1)


@dataclass(frozen=True)
class OutcomeModel:
    """Fitted three-class model and the columns it was fitted on."""

    columns: tuple[str, ...]
    kind: str
    stages: tuple[PipelineModel, ...] | tuple[Booster, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds p_home, p_draw, p_away."""
        out = df
        if self.kind != "boosted":
            out = self.stages[0].transform(out)
            p = vector_to_array("_prob")
            out = out.withColumns({c: F.get(p, F.lit(i)) for i, c in enumerate(P)})
            return out.drop("_raw", "_x", "_rawp", "_prob", "_pred")
        out = with_margins(out, self.stages, "_m")
        out = out.withColumns({c: chance(F.get("_m", F.lit(i))) for i, c in enumerate(P)}).drop("_m")
        return out.withColumns(named(normalize_probs(triple())))


def _front(columns: Sequence[str], scale: bool) -> list:
    raw = VectorAssembler(inputCols=list(columns), outputCol="_raw" if scale else "_x", handleInvalid="keep")
    return [raw, StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)] if scale else [raw]


def fit_outcome_model(
    df: DataFrame, columns: Sequence[str], *, kind: str = "forest", weight: str | None = None, reg: float = 0.0,
    rounds: int = ROUNDS, depth: int = DEPTH, seed: int = SEED
) -> OutcomeModel:
    """Fit ``forest``, ``logistic`` (multinomial) or ``boosted`` (one booster per class).  Runs jobs."""
    out = {"featuresCol": "_x", "labelCol": "target", "rawPredictionCol": "_rawp", "probabilityCol": "_prob", "predictionCol": "_pred"}
    if weight:
        out["weightCol"] = weight
    cols = tuple(columns)
    rows = df.na.fill(0.0, list(cols))
    if kind == "forest":
        stages = [*_front(cols, False), RandomForestClassifier(numTrees=rounds, maxDepth=depth, seed=seed, **out)]
        return OutcomeModel(cols, kind, (Pipeline(stages=stages).fit(rows),))
    if kind == "logistic":
        lr = LogisticRegression(family="multinomial", regParam=reg, maxIter=STEPS, tol=1e-6, standardization=False, **out)
        return OutcomeModel(cols, kind, (Pipeline(stages=[*_front(cols, True), lr]).fit(rows),))
    if kind == "boosted":
        boosters = fit_boosters(rows, cols, len(P), weight=weight, rounds=rounds, depth=depth, rate=RATE, share=SHARE, seed=seed)
        return OutcomeModel(cols, kind, tuple(boosters))
    raise ValueError(f"unknown model kind: {kind}")


def apply_logistic(df: DataFrame, columns: Sequence[str], coefficients: Sequence[Sequence[float]], intercepts: Sequence[float]) -> DataFrame:
    """p_home, p_draw, p_away of a multinomial model with these coefficients; a missing value counts as 0."""
    cells = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    scores = [sum((x * float(w) for x, w in zip(cells, row, strict=True)), F.lit(float(b))) for row, b in zip(coefficients, intercepts, strict=True)]
    return df.withColumns(named(softmax3(tuple(scores))))


# --- validation ------------------------------------------------------------


def _scored(model: OutcomeModel, test: DataFrame, name: str) -> DataFrame:
    return model.transform(test.na.fill(0.0, list(model.columns))).withColumn("model_version", F.lit(name))


def metrics_of(scored: DataFrame, keys: Sequence[str] = ("model_version",)) -> DataFrame:
    table = calibration_table(scored, keys)
    return score_probs(scored, keys).join(ece(table, keys), list(keys))


def _at_once(model: dict) -> bool:
    """Plain logistic models are fitted together, in one pass a step."""
    return model == {"kind": "logistic"}


def _pick_fit(scored: DataFrame, fit: Column) -> DataFrame:
    return scored.withColumns({p: F.get(p, fit) for p in P})


def compare_feature_sets(df: DataFrame, sets: dict[str, Sequence[str]], *, frac: float = 0.8, **model) -> DataFrame:
    """Fit and score every column set on one split: one row of metrics per set.  Runs jobs.

    Logistic models are fitted together: ``df`` is then read three times, so give it staged.
    """
    at_once = _at_once(model)
    split = time_split(df, frac) if at_once else staged(time_split(df, frac))
    train, test = split.where("is_test = 0"), split.where("is_test = 1")
    if at_once:
        every = list(dict.fromkeys(c for cols in sets.values() for c in cols))
        scored = fit_many(train, every, F.array_repeat(F.lit(1.0), len(sets)), len(sets), list(sets.values())).transform(test.select("match_id", "target", *every))
        cells = F.array(*[F.struct(F.lit(name).alias("model_version"), *[F.get(p, F.lit(r)).alias("_" + p) for p in P]) for r, name in enumerate(sets)])
        return metrics_of(scored.select("target", F.inline(cells)).withColumnsRenamed({"_" + p: p for p in P}))
    fitted = side_by_side(df.sparkSession, [lambda c=c: fit_outcome_model(train, c, **model) for c in sets.values()])
    parts = [_scored(m, test, name).select("model_version", "match_id", "target", *P) for name, m in zip(sets, fitted, strict=True)]
    return metrics_of(union_by_name(*parts))


def blended_fit(
    train: DataFrame, test: DataFrame, first: Sequence[str], second: Sequence[str], *, weight: float = 0.5, **model
) -> DataFrame:
    """Test rows scored by the blend of two models on different column sets.  Runs two fits."""
    one, two = side_by_side(train.sparkSession, [lambda c=c: fit_outcome_model(train, c, **model) for c in (first, second)])
    scored = one.transform(test.na.fill(0.0, list(first))).withColumnsRenamed({c: "_a_" + c for c in P})
    both = two.transform(scored.na.fill(0.0, list(second)))
    mixed = blend(triple(tuple("_a_" + c for c in P)), triple(), F.lit(weight))
    return both.withColumns(named(mixed)).drop(*["_a_" + c for c in P])


def earlier_seasons(seasons: Sequence) -> Column:
    """Weights of a row in the fits that test each season: 1 if its own season is earlier."""
    return F.array(*[(F.col("season") < s).cast("double") for s in seasons])


def walk_forward(
    df: DataFrame, columns: Sequence[str], seasons: Sequence | None = None, *, name: str = "model", **model
) -> DataFrame:
    """Train on earlier seasons, test on each season that has one: scored rows of all.  Runs one fit per season."""
    rows = staged(df)
    if seasons is None:
        seasons = sorted(r["season"] for r in rows.select("season").distinct().collect())[1:]
    if _at_once(model) and seasons:
        many = fit_many(rows, columns, earlier_seasons(seasons), len(seasons))
        scored = many.transform(rows.where(F.col("season").isin(list(seasons))))
        which = F.array_position(F.array(*[F.lit(s) for s in seasons]), F.col("season")) - 1
        return _pick_fit(scored, which.cast("int")).withColumn("model_version", F.lit(name))
    fits = [lambda s=s: fit_outcome_model(rows.where(F.col("season") < s), columns, **model) for s in seasons]
    fitted = side_by_side(df.sparkSession, fits)
    return union_by_name(*[_scored(m, rows.where(F.col("season") == s), name) for s, m in zip(seasons, fitted, strict=True)])


def add_one_group(df: DataFrame, base: Sequence[str], groups: dict[str, Sequence[str]], **model) -> DataFrame:
    """Metrics of base + each group and their change to the base.  Runs jobs."""
    sets = {"base": list(base), **{f"+{g}": [*base, *cols] for g, cols in groups.items()}}
    return with_deltas(compare_feature_sets(df, sets, **model), "base")


def remove_one_group(df: DataFrame, groups: dict[str, Sequence[str]], **model) -> DataFrame:
    """Metrics of all groups but one and their change to the full set.  Runs jobs."""
    every = [c for cols in groups.values() for c in cols]
    sets = {"full": every, **{f"-{g}": [c for c in every if c not in cols] for g, cols in groups.items() if len(groups) > 1}}
    return with_deltas(compare_feature_sets(df, sets, **model), "full")


def with_deltas(results: DataFrame, base: str) -> DataFrame:
    """The change of each model's metrics to those of ``base``.  Stages the results, a row a model, so that they are computed once."""
    results = staged(results)
    cols = ("log_loss", "brier_score", "ece")
    b = results.where(F.col("model_version") == base).select(F.lit(1).alias("_1"), *[F.col(c).alias("_" + c) for c in cols])
    out = results.withColumn("_1", F.lit(1)).join(F.broadcast(b), "_1")
    return out.withColumns({f"{c}_delta": F.col(c) - F.col("_" + c) for c in cols}).drop("_1", *["_" + c for c in cols])


ELO_COLUMNS = ("home_elo", "away_elo", "elo_difference", "elo_ratio", "elo_gap_bucket", "home_elo_trend", "away_elo_trend")
# The rating searches.
ELO_GRID = tuple(
    EloConfig(k=k, home_advantage=h, margin=m) for k in (10.0, 20.0, 30.0, 40.0) for h in (25.0, 50.0, 75.0, 100.0) for m in (False, True)
)
CARRYOVERS = (1.0, 0.9, 0.85, 0.75, 0.65, 0.5)
CARRYOVER_GRID = tuple(EloConfig(k=30.0, home_advantage=75.0, carryover=c) for c in CARRYOVERS)


def parameter_search(matches: DataFrame, configs: Sequence[EloConfig] = ELO_GRID + CARRYOVER_GRID[1:], **model) -> DataFrame:
    """Held-out scores of a rating-only model per configuration.  One rating job, and the fits."""
    # Every configuration rates the same matches, so one cutoff serves all.  Kept is a row of vectors a match.
    rated = elo_grid(time_split(matches), configs, ("target", "is_test"), staged)
    train, test = rated.where("is_test = 0"), rated.where("is_test = 1")
    if _at_once(model):
        many = fit_many(train, ELO_COLUMNS, F.col("config"), len(configs), one_each=True)
        scored = many.transform_own(test.select("config", "target", *ELO_COLUMNS), "config")
        names = F.get(F.array(*[F.lit(c.name) for c in configs]), F.col("config").cast("int"))
        return metrics_of(scored.select(names.alias("model_version"), "target", *P))
    fits = [lambda n=n: fit_outcome_model(train.where(F.col("config") == n), ELO_COLUMNS, **model) for n in range(len(configs))]
    fitted = side_by_side(matches.sparkSession, fits)
    parts = [
        _scored(m, test.where(F.col("config") == n), cfg.name).select("model_version", "target", *P)
        for n, (cfg, m) in enumerate(zip(configs, fitted, strict=True))
    ]
    return metrics_of(union_by_name(*parts))


# --- calibration and stacking ---------------------------------------------


@dataclass(frozen=True)
class Calibrator:
    """Per-class calibration and the feature columns it belongs to."""

    columns: tuple[str, ...]
    kind: str
    models: tuple

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c, m in zip(P, self.models, strict=True):
            one = m.transform(out)
            value = vector_to_array("_prob")[1] if self.kind == "sigmoid" else F.col("_pred")
            out = one.withColumn("_c_" + c, value).drop("_f", "_rawp", "_prob", "_pred")
        new = normalize_probs(triple(tuple("_c_" + c for c in P)))
        return out.withColumns(named(new)).drop(*["_c_" + c for c in P])


def fit_calibrator(held_out: DataFrame, columns: Sequence[str], kind: str = "sigmoid") -> Calibrator:
    """Fit ``sigmoid`` or ``isotonic`` maps on scored held-out rows.  Runs three small fits."""
    rows = staged(held_out.select(*P, "target"))
    models = []
    for i, c in enumerate(P):
        y = rows.withColumn("_y", (F.col("target") == i).cast("double"))
        front = VectorAssembler(inputCols=[c], outputCol="_f")
        if kind == "sigmoid":
            last = LogisticRegression(featuresCol="_f", labelCol="_y", rawPredictionCol="_rawp", probabilityCol="_prob", predictionCol="_pred", maxIter=STEPS)
        else:
            last = IsotonicRegression(featuresCol="_f", labelCol="_y", predictionCol="_pred")
        models.append(Pipeline(stages=[front, last]).fit(y))
    return Calibrator(tuple(columns), kind, tuple(models))


def apply_calibration(scored: DataFrame, calibrator: Calibrator | None, columns: Sequence[str]) -> DataFrame:
    """Calibrated triple if the calibrator was fitted for these columns, else the raw one; adds ``method``."""
    if calibrator is None or calibrator.columns != tuple(columns):
        return scored.withColumn("method", F.lit("raw"))
    return calibrator.transform(scored).withColumn("method", F.lit(calibrator.kind))


def compare_calibrations(held_out: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Metrics of raw, sigmoid and isotonic probabilities on ``test``, best first rank.  Runs jobs."""
    parts = [apply_calibration(test, None, columns)]
    parts += [apply_calibration(test, fit_calibrator(held_out, columns, k), columns) for k in ("sigmoid", "isotonic")]
    out = metrics_of(union_by_name(*[p.select("method", "target", *P) for p in parts]), ["method"])
    best = out.agg(F.min(F.struct("log_loss", "brier_score", "method")).alias("b")).select(F.col("b.method").alias("_m"), F.lit(1).alias("_1"))
    joined = out.withColumn("_1", F.lit(1)).join(F.broadcast(best), "_1")
    return joined.withColumn("selected", (F.col("method") == F.col("_m")).cast("int")).drop("_1", "_m")


def logistic_stack(train: DataFrame, test: DataFrame, *, c: float = 0.2, market: Sequence[str] = MARKET) -> DataFrame:
    """Multinomial model on the meta features of model and market, penalised like 1/C.  Runs jobs."""
    cols = list(meta_features(train, market))
    rows = staged(train.withColumns(meta_features(train, market)))
    model = fit_outcome_model(rows, cols, kind="logistic", reg=1.0 / (c * max(rows.count(), 1)))
    scored = test.withColumns(meta_features(test, market)).drop(*P)
    return model.transform(scored)


# --- uncertainty -----------------------------------------------------------


def poisson_limits(top: int = 20) -> list[float]:
    """The chances of at most 0, 1, ... ``top`` - 1 events."""
    mass, total, out = 0.36787944117144233, 0.0, []
    for k in range(top):
        total += mass
        out.append(total)
        mass /= k + 1
    return out


def poisson_weight(u: Column, top: int = 20) -> Column:
    """Poisson(1) draw from a uniform number: bootstrap weights without copying rows.

    The mass beyond ``top`` is below 1e-19, less than a step of a uniform double.
    """
    return sum(((u >= limit).cast("double") for limit in poisson_limits(top)), F.lit(0.0))


def _replicates(train: DataFrame, test: DataFrame, columns: Sequence[str], n: int, draw, weight, **model) -> DataFrame:
    rows, parts = staged(train), []
    fits = [lambda r=r: fit_outcome_model(rows.withColumn("_w", weight(draw(F.lit(r)))).where("_w > 0"), columns, weight="_w", **model) for r in range(n)]
    for r, fitted in enumerate(side_by_side(train.sparkSession, fits)):
        scored = fitted.transform(test.na.fill(0.0, list(columns))).select("match_id", *P)
        cells = F.array(*[F.struct(F.lit(k).alias("class"), F.col(c).alias("p")) for k, c in zip(CLASSES, P, strict=True)])
        parts.append(scored.select(F.col("match_id").alias("row_id"), F.lit(r).alias("replicate"), F.inline(cells)))
    return union_by_name(*parts)


def replicate_weights(n: int, draw: Callable[[Column], Column], weight: Callable[[Column], Column]) -> Column:
    """A row's weights in ``n`` replicates, as an array: ``weight`` of what ``draw`` gives for the replicate's number."""
    return F.transform(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), draw), lambda u: weight(u))


def bootstrap_draw(seed: int, tag: str) -> Callable[[Column], Column]:
    return lambda r: hash_uniform(F.lit(seed) + r, F.lit(tag), F.col("match_id"))


def _intervals(train: DataFrame, test: DataFrame, columns: Sequence[str], n: int, draw, weight, **model) -> DataFrame:
    if not _at_once(model):
        return replicate_intervals(_replicates(train, test, columns, n, draw, weight, **model))
    scored = fit_many(train, columns, replicate_weights(n, draw, weight), n).transform(test.select(F.col("match_id").alias("row_id"), *columns))
    cells = F.array(*[F.struct(F.lit(k).alias("class"), F.col(c).alias("_p")) for k, c in zip(CLASSES, P, strict=True)])
    return scored.select("row_id", F.inline(cells)).select("row_id", "class", *[v.alias(k) for k, v in array_intervals(F.col("_p"), n).items()])


def bootstrap_models(train: DataFrame, test: DataFrame, columns: Sequence[str], n: int = 40, seed: int = SEED, **model) -> DataFrame:
    """Mean, deviation and 95 % range of ``n`` bootstrap models per row and class.  Runs ``n`` fits, logistic ones at once."""
    return _intervals(train, test, columns, n, bootstrap_draw(seed, "b"), poisson_weight, **model)


def subset_ensemble(train: DataFrame, test: DataFrame, columns: Sequence[str], n: int = 30, share: float = 0.85, seed: int = SEED, **model) -> DataFrame:
    """Mean and deviation over models fitted on random subsets.  Runs ``n`` fits, logistic ones at once."""
    weight = lambda u: (u < share).cast("double")
    return _intervals(train, test, columns, n, bootstrap_draw(seed, "s"), weight, **model).select("row_id", "class", "mean", "std")


# --- explanation -----------------------------------------------------------


def gain_importance(model: OutcomeModel, df: DataFrame) -> DataFrame:
    """(feature, importance) of a tree model, the mean over its classes' boosters; ``df`` only lends its session."""
    if model.kind == "boosted":
        each = [b.gains / (b.gains.sum() or 1.0) for b in model.stages]
    else:
        each = [stage.stages[-1].featureImportances.toArray() for stage in model.stages]
    rows = [(f, float(s)) for f, s in zip(model.columns, sum(each) / len(each), strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def shifts(n: int, reps: int, seed: int = SEED) -> list[int]:
    """How far each repetition moves the values round the ``n`` places: different and not 0 while ``n`` > ``reps``."""
    if n < 2:
        return [0] * reps
    some = random.Random(seed).sample(range(1, n), min(reps, n - 1))
    return [some[r % len(some)] for r in range(reps)]


def shuffled_partners(df: DataFrame, ids: Sequence[str], values: str, reps: int, seed: int = SEED) -> DataFrame:
    """``df`` once for each repetition with ``_from``, the ``values`` of another row; each row gives to one row.

    Rows get dense places in a random order once; a repetition turns that order by a number of places of its own, so a
    partner's place is plain arithmetic.  Runs jobs that rank and stage the rows.
    """
    key = hash_uniform(F.lit(seed), *[F.col(c) for c in ids])
    placed = staged(uniform_rank(df.withColumn("_u", key), [], "_u", name="_place", ties=list(ids)).drop("_u"))
    n = placed.count()
    moves = [F.struct(F.lit(r).alias("rep"), F.lit(s).alias("_by")) for r, s in enumerate(shifts(n, reps, seed))]
    # What follows makes many rows of each, so the parts are as many as the session says, however few bytes they have.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    giving = placed.select(F.col("_place").alias("_at"), F.col(values).alias("_from"), F.inline(F.array(*moves)))
    giving = giving.select((F.pmod(F.col("_at") - 1 - F.col("_by"), F.lit(max(n, 1))) + 1).alias("_place"), "rep", "_from")
    return placed.repartition(parts, "_place").join(giving.repartition(parts, "_place"), "_place").drop("_place")


def permutation_importance(model: OutcomeModel, df: DataFrame, reps: int = 5, seed: int = SEED, features: Sequence[str] | None = None) -> DataFrame:
    """Rise of the log loss when one column is shuffled over all rows, mean and deviation over repetitions.

    Rows meet their partner of each repetition once, for all features; which feature is the partner's is settled in place,
    so nothing is shuffled for each feature.  Of a boosted model only the trees that use a feature are walked again for it.  No rows give no importance.  Runs the jobs of ``shuffled_partners``.
    """
    names = list(features or model.columns)
    cells = F.array(*[F.col(c).cast("double") for c in model.columns])
    base = df.na.fill(0.0, list(model.columns)).select("match_id", "target", cells.alias("_x"))
    pairs = shuffled_partners(base, ["match_id"], "_x", reps, seed)
    moved = [model.columns.index(f) for f in names]
    loss = F.avg(log_loss(triple(), F.col("target")))
    if model.kind == "boosted":
        ship(df.sparkSession)
        given = pairs.select("rep", F.col("target").cast("int"), "_x", "_from")
        sums = given.mapInArrow(moved_losses(model.stages, moved, FLOOR), "rep int, _f int, l double, n long")
        after = sums.groupBy("_f", "rep").agg((F.sum("l") / F.sum("n")).alias("l"))
    else:
        each = pairs.select("*", F.explode(F.array(*[F.lit(j) for j in moved])).alias("_f"))
        own = [F.when(F.col("_f") == j, F.get("_from", F.lit(j))).otherwise(F.get("_x", F.lit(j))).alias(c) for j, c in enumerate(model.columns)]
        after = model.transform(each.select("target", "rep", "_f", *own)).groupBy("_f", "rep").agg(loss.alias("l"))
    plain = base.select("target", *[F.get("_x", F.lit(j)).alias(c) for j, c in enumerate(model.columns)])
    before = model.transform(plain).agg(loss.alias("_b")).withColumn("_1", F.lit(1))
    rise = after.withColumn("_1", F.lit(1)).join(F.broadcast(before), "_1").withColumn("d", F.col("l") - F.col("_b"))
    feature = F.get(F.array(*[F.lit(c) for c in model.columns]), F.col("_f"))
    return rise.groupBy(feature.alias("feature")).agg(F.avg("d").alias("importance"), F.stddev_pop("d").alias("std"))


def class_trees(model: OutcomeModel, spark: SparkSession) -> list[Trees]:
    """The trees of each class.  Saves a forest to the checkpoint folder and collects its nodes: trees * 2^(depth + 1) rows at most."""
    if model.kind not in ("boosted", "forest"):
        raise ValueError("only boosted models and forests have trees")
    if model.kind == "boosted":
        return [b.trees for b in model.stages]
    fitted = model.stages[0].stages[-1]
    place = f"{checkpoint_dir(spark)}/trees-{uuid.uuid4().hex}"
    fitted.save(place)
    nodes = spark.read.parquet(f"{place}/data").select("treeID", "nodeData.*").collect()
    shape = (len(fitted.treeWeights), 1 + max(r["id"] for r in nodes))
    feature, threshold = np.zeros(shape, np.int64), np.full(shape, np.inf)
    left = np.tile(np.arange(shape[1]), (shape[0], 1))
    right = left.copy()
    value = np.zeros((len(P), *shape))
    for r in nodes:
        at = (r["treeID"], r["id"])
        value[(slice(None), *at)] = np.array(r["impurityStats"]) / sum(r["impurityStats"]) / shape[0]
        if r["leftChild"] >= 0:
            feature[at], threshold[at] = r["split"]["featureIndex"], r["split"]["leftCategoriesOrThreshold"][0]
            left[at], right[at] = r["leftChild"], r["rightChild"]
    return [Trees(feature, threshold, left, right, v, fitted.getOrDefault("maxDepth")) for v in value]


def _walk(trees: list[Trees], ids: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, WALK_ROWS):
                batch = whole.slice(lo, WALK_ROWS)
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[ids:]])
                for name, one in zip(CLASSES, trees, strict=True):
                    cells = one.contributions(x)
                    given = pa.ListArray.from_arrays(np.arange(0, cells.size + 1, x.shape[1], np.int32), cells.ravel())
                    columns = [pa.array([name] * len(x)), pa.array(np.full(len(x), one.base)), given]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:ids], *columns], [*batch.schema.names[:ids], "class", "base", "contributions"])

    return run


def path_contributions(model: OutcomeModel, df: DataFrame, ids: Sequence[str] = ("match_id",)) -> DataFrame:
    """Per row and class of a boosted model or forest: ``base`` and an array of ``contributions`` in the order of the model's columns.

    A tree's prediction is its root's value and the changes of value along the row's path; each change belongs to the column
    that was split on.  ``base`` and the contributions add up to the booster's raw score, or to the forest's probability.
    A missing value counts as 0, as in the fit; no rows give no rows.  Runs the job that reads the trees.
    """
    ship(df.sparkSession)
    trees = class_trees(model, df.sparkSession)
    rows = df.na.fill(0.0, list(model.columns)).select(*ids, *[F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(model.columns)])
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(ids)])
    return rows.mapInArrow(_walk(trees, len(ids)), f"{given}, class string, base double, contributions array<double>")


def mean_path_contributions(model: OutcomeModel, df: DataFrame) -> DataFrame:
    """Mean |contribution| per feature and class of a boosted model or forest."""
    cells = path_contributions(model, df).select("class", F.posexplode("contributions").alias("_j", "_v"))
    feature = F.get(F.array(*[F.lit(c) for c in model.columns]), F.col("_j"))
    return cells.groupBy("_j", "class").agg(F.avg(F.abs("_v")).alias("mean_abs_contribution")).select(feature.alias("feature"), "class", "mean_abs_contribution")


def additive_contributions(model: OutcomeModel, df: DataFrame) -> DataFrame:
    """Mean |contribution| per feature and class: coefficient x standardised value of a logistic model, path changes of trees."""
    if model.kind != "logistic":
        return mean_path_contributions(model, df)
    stages = model.stages[0].stages
    mean, std = stages[1].mean.toArray(), stages[1].std.toArray()
    coef = stages[2].coefficientMatrix.toArray()
    rows = df.na.fill(0.0, list(model.columns))
    cells = []
    aggs = []
    for j, f in enumerate(model.columns):
        z = F.abs((F.col(f).cast("double") - float(mean[j])) / float(std[j])) if std[j] > 0 else F.lit(0.0)
        aggs.append(F.avg(z).alias(f"_z{j}"))
        for k, name in enumerate(CLASSES):
            cells.append(
                F.struct(F.lit(f).alias("feature"), F.lit(name).alias("class"), (F.col(f"_z{j}") * abs(float(coef[k][j]))).alias("mean_abs_contribution"))
            )
    return rows.agg(*aggs).select(F.inline(F.array(*cells)))
