"""Document quality learned from preference pairs (Bradley-Terry), cut at a score quantile.

* Features: ``FEATURES`` numbers a document of its bytes, words and lines (shares of letters,
  capitals, digits and each punctuation mark, repeated neighbours, word shapes), computed from
  the whole text in NumPy, a megabyte at a time.  Id, language, source and labels are not read.
* Pairs: in each of ``meetings`` drawings a labelled document is dealt to one of as many slots as
  the rarer label has documents; in a slot every good document meets every bad one.  On average
  that is one meeting a drawing for each document of the commoner label, so pairs grow with the
  rows and never with their product.
* Model: a pair says that the good document's score is higher; with scores linear in the
  features this is a logistic loss on feature differences without intercept, fitted by Spark's
  logistic regression on all pairs (every second pair is turned round).
* Threshold: the labelled documents' scores are cut into ``QUANTILES`` quantiles; the quantile with
  the fewest wrong labels, weighed so that both labels count alike, becomes ``cut``, and
  ``score = sigmoid(slope * (raw - threshold) + logit(cut))``, where the slope makes the middle half
  of the labelled scores one unit wide.

Cases: a null, blank or empty text has the features of an empty text and a score; several labels
of one id count as their mean, ties as good; null labels are not read; with one label only, or
none, every document scores 0.5; repeated rows score alike and each joins in the meetings; an
empty table gives an empty result; columns named like the results are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchframe.llm.groups import spread_back
from matchframe.llm.words import row_blocks, split_words
from matchframe.plans.stages import staged
from matchframe.shipping import ship

QUANTILES = 200
MARKS = [ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]
#: Class of a byte: small letter, capital, digit, blank, line end, other control, beyond ASCII, then each mark.
CLASS = np.full(256, 5, np.int64)
CLASS[ord("a") : ord("z") + 1], CLASS[ord("A") : ord("Z") + 1], CLASS[ord("0") : ord("9") + 1] = 0, 1, 2
CLASS[ord(" ")], CLASS[ord("\n")], CLASS[128:] = 3, 4, 6
CLASS[MARKS] = 7 + np.arange(len(MARKS))
CLASSES = 7 + len(MARKS)
FEATURES = CLASSES + 11


def _share(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.sqrt(count / np.maximum(of, 1))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` numbers for each text; shares enter by their root, sizes by their logarithm."""
    n, size = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    per = lambda rows, weights=None: np.bincount(rows, weights, minlength=n)
    kind = CLASS[data]
    classes = np.bincount(row * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES)
    same = (data[1:] == data[:-1]) & (row[1:] == row[:-1])
    marks = (kind >= 7).astype(np.int64)
    words = split_words(data, offsets)
    n_words, of_word = words.counts, np.repeat(np.arange(n), words.counts)
    length = words.end - words.start
    inside = np.concatenate([[0], np.cumsum(np.isin(kind, (0, 6)))])
    capitals = np.concatenate([[0], np.cumsum(kind == 1)])
    letters = inside[words.end] - inside[words.start]
    shout = (letters == 0) & (capitals[words.end] - capitals[words.start] > 1)
    bare = (letters == 0) & (capitals[words.end] - capitals[words.start] == 0)
    twin = (words.hash[1:] == words.hash[:-1]) & (of_word[1:] == of_word[:-1])
    rest = np.column_stack(
        [
            np.log1p(size), np.log1p(n_words), np.log1p(classes[:, 4]),
            per(of_word, length) / np.maximum(n_words, 1) / 10,
            _share(per(row[1:][same]), size),
            _share(per(row[1:][(marks[1:] & marks[:-1] & (row[1:] == row[:-1])).astype(bool)]), size),
            _share(per(of_word[shout]), n_words),
            _share(per(of_word[bare]), n_words),
            _share(per(of_word[kind[words.end - 1] >= 7]), n_words),
            _share(per(of_word[1:][twin]), n_words),
            _share(classes[:, 7:].sum(1), size),
        ]
    )
    return np.column_stack([_share(classes, size[:, None]), rest])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks = [features(data, offsets).astype(np.float32) for _, _, data, offsets in row_blocks(batch.column("text"))]
        flat = pa.array(np.concatenate(blocks).ravel() if blocks else np.zeros(0, np.float32))
        x = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * FEATURES), flat)
        yield pa.RecordBatch.from_arrays([batch.column("id"), x], ["id", "x"])


def preference_pairs(labelled: DataFrame, meetings: int) -> DataFrame:
    """(d, y): feature differences; y is 1 for good minus bad, 0 for the pair turned round.  Runs a job."""
    counts = {r["good"]: r["n"] for r in labelled.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = min(counts.get(0, 0), counts.get(1, 0))
    if not slots:
        return labelled.select(F.col("x").alias("d"), F.lit(0).alias("y")).limit(0)
    drawing = F.explode(F.sequence(F.lit(1), F.lit(meetings))).alias("drawing")
    dealt = labelled.select("place", "x", "good", drawing)
    dealt = dealt.withColumn("slot", F.pmod(F.xxhash64("place", "drawing"), F.lit(slots)))
    good = dealt.where("good = 1").select("drawing", "slot", F.col("x").alias("a"), "place")
    bad = dealt.where("good = 0").select("drawing", "slot", F.col("x").alias("b"), F.col("place").alias("other"))
    turned = F.pmod(F.xxhash64("drawing", "place", "other"), F.lit(2)) == 0
    sign = F.when(turned, -1.0).otherwise(1.0)
    return good.join(bad, ["drawing", "slot"]).select(
        F.zip_with("a", "b", lambda a, b: sign * (a - b)).alias("d"), F.when(turned, 0).otherwise(1).alias("y")
    )


def _raw(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES).astype(np.float64)
            names = [c for c in batch.schema.names if c != "x"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(x @ weights)], [*names, "raw"])

    return run


def best_quantile(bins: list) -> int:
    """The cell from which on documents count as good: the least mean of both error rates, the lowest of equal ones."""
    good, bad = np.zeros(QUANTILES), np.zeros(QUANTILES)
    for r in bins:
        good[r["cell"]], bad[r["cell"]] = r["good"], r["n"] - r["good"]
    lost = np.concatenate([[0], np.cumsum(good)[:-1]]) / good.sum()
    passed = 1 - np.concatenate([[0], np.cumsum(bad)[:-1]]) / bad.sum()
    return int(np.argmin(np.round(lost + passed, 9)))


def score_quantile(scored: DataFrame) -> tuple[float, float]:
    """(threshold, width): the raw score at the best quantile and the range of the middle half.  Runs two jobs."""
    steps = [k / QUANTILES for k in range(1, QUANTILES)]
    edges = scored.agg(F.percentile_approx("raw", steps, 10_000)).first()[0]
    cell = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("raw")))
    bins = scored.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good")).collect()
    best = best_quantile(bins)
    width = edges[3 * QUANTILES // 4 - 1] - edges[QUANTILES // 4 - 1]
    return (edges[best - 1] if best else edges[0]), width


def quality_scores(
    docs: DataFrame, labels: DataFrame, learn: Column, cut: float = 0.3, meetings: int = 4,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> DataFrame:
    """Id, ``score`` and ``predicted`` (1 from ``cut`` on) of every document; ``learn`` picks the label rows to learn from.

    Runs the jobs that compute features, pairs, model and threshold.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = staged(texts.mapInArrow(_features, f"id {kind}, x array<float>").withColumn("place", F.monotonically_increasing_id()))
    given = labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    given = given.groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("good"))
    labelled = staged(spread_back(rows, given, "id", F.col("place")).where("good IS NOT NULL").select("x", "good", "place"))
    pairs = preference_pairs(labelled, meetings).select(array_to_vector("d").alias("d"), F.col("y").cast("double").alias("y"))
    pairs = staged(pairs)
    if pairs.isEmpty():
        score = F.lit(0.5)
        return rows.select(F.col("id").alias(id_col), score.alias("score"), (score >= cut).cast("int").alias("predicted"))
    fit = LogisticRegression(
        featuresCol="d", labelCol="y", fitIntercept=False, regParam=1e-3, maxIter=60, standardization=True
    ).fit(pairs)
    weights = fit.coefficients.toArray()
    threshold, width = score_quantile(labelled.mapInArrow(_raw(weights), "good int, place long, raw double"))
    slope = 1 / width if width > 0 else 1.0
    raw = rows.select("id", "x").mapInArrow(_raw(weights), f"id {kind}, raw double")
    score = 1 / (1 + F.exp(-(F.lit(slope) * (F.col("raw") - threshold) + log(cut / (1 - cut)))))
    out = raw.select(F.col("id").alias(id_col), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
