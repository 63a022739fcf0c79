"""Draw documents that resemble a target collection: hashed n-gram importance weights and Gumbel top-k.

* Scan: a text's A-Z are lower-cased and every run of separators becomes one space.  One
  pattern per n-gram length, anchored by lookarounds at word borders, then runs over the
  text with overlapping matches; each match is the n-gram itself, and its CRC-32 modulo
  ``buckets`` is counted.  No list of words or of n-grams is built.
* Counts: documents keep their buckets as two or four bytes an n-gram, staged once; tasks
  add their own rows up and Spark adds at most ``buckets`` sums a task.
* Weight: the floored mean of a document's bucket gains, a gain being
  ``floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))`` of target and corpus counts.
* Draw: ``floor(percent * N / 100)`` of the N documents with ``least_words`` words have a rank, by
  weight plus a Gumbel variate that the seed and the id fix.  Scores lie within some
  100,000 of zero whatever the input, so counts by ``BIN`` scores are a few thousand rows:
  they give the lowest score that can be drawn, only documents above it are sorted, and
  the sort deals them by ranges, so that no task holds them all.

Cases: a null or empty text has no n-grams, weight 0 and no rank; a null id draws with the
empty text in its place; equal scores go by the smaller id, null first, and repeated
rows are ranked one after the other; an empty table gives an empty result; an empty
target gives gains from its zero counts; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchframe.llm.words import LOWER, text_bytes
from matchframe.plans.stages import staged
from matchframe.shipping import ship

BIN = 64
#: Lower-cased letters, digits and bytes of other scripts stay; all else is a separator.
FOLD = LOWER.copy()
FOLD[: ord("0")] = FOLD[ord("9") + 1 : ord("A")] = FOLD[ord("Z") + 1 : ord("a")] = FOLD[ord("z") + 1 : 128] = ord(" ")
FOLD = FOLD.tobytes()


def gram_pattern(n: int) -> regex.Pattern:
    """Runs of n words between borders of words that are parted by single spaces."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1))


def scan(raw: bytes, patterns: list[regex.Pattern], buckets: int) -> tuple[int, np.ndarray]:
    """The number of words of a text and the bucket of every n-gram."""
    text = regex.sub(rb" {2,}", b" ", raw.translate(FOLD)).strip(b" ")
    crcs = (zlib.crc32(m.group()) for p in patterns for m in p.finditer(text, overlapped=True))
    return (text.count(b" ") + 1 if text else 0), np.fromiter(crcs, np.uint32) % np.uint32(buckets)


def _cell(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def _scan(shortest: int, longest: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [gram_pattern(n) for n in range(shortest, longest + 1)]
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            found = [scan(data[a:b].tobytes(), patterns, buckets) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([n for n, _ in found], pa.int64()),
                 pa.array([len(x) for _, x in found], pa.int64()),
                 pa.array([x.astype(_cell(buckets)).tobytes() for _, x in found], pa.binary())],
                ["id", "n_words", "n_features", "cells"],
            )

    return run


def _count(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            sums += np.bincount(text_bytes(batch.column("cells"))[0].view(_cell(buckets)), minlength=buckets)
        cells = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(sums[cells])], ["cell", "n"])

    return run


def _weigh(gains, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("cells"))
            sums = np.concatenate([[0], np.cumsum(gains.value[data.view(_cell(buckets))])])
            places = offsets // np.dtype(_cell(buckets)).itemsize
            n = np.diff(places)
            weight = (sums[places[1:]] - sums[places[:-1]]) // np.maximum(n, 1)
            columns = [batch.column(c) for c in ("id", "n_words", "n_features")] + [pa.array(weight, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_features", "weight"])

    return run


def bucket_counts(scanned: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs.  Runs a job; ``buckets`` rows reach the driver."""
    parts = scanned.select("cells").mapInArrow(_count(buckets), "cell int, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    buckets = len(corpus)
    above = (target + 1.0) * float(corpus.sum() + buckets)
    below = (corpus + 1.0) * float(target.sum() + buckets)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def gumbel(id_col: Column, seed: int) -> Column:
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    uniform = (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(-1000 * F.ln(-F.ln(uniform)))


def _lowest_bin(bins: list, wanted: int) -> int | None:
    """The bin in which, counted from the top, the ``wanted``-th document lies."""
    for r in sorted(bins, key=lambda r: -r["bin"]):
        wanted -= r["n"]
        if wanted <= 0:
            return r["bin"]
    return None


def ranked(rows: DataFrame, drawn: int) -> DataFrame:
    """``rows`` with ``rank`` 1 to ``drawn`` by falling score, then by id and ``place``; null beyond.  Runs jobs."""
    order = [F.desc("score"), F.asc_nulls_first("id"), F.asc("place")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    sizes = sorted((r["part"], r["count"]) for r in dealt.groupBy("part").count().collect())
    before = accumulate((n for _, n in sizes), initial=0)
    offsets = rows.sparkSession.createDataFrame(
        [(part, start) for (part, _), start in zip(sizes, before, strict=False)], "part int, start long"
    )
    rank = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    out = dealt.join(F.broadcast(offsets), "part").withColumn("rank", rank)
    return out.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).drop("part", "start")


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, shortest: int = 1, longest: int = 1, buckets: int = 10_000,
    least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null if not drawn).

    Runs the jobs that scan, count, weigh and sort.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_features long"
    work = _scan(shortest, longest, buckets)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scanned = staged(texts.mapInArrow(work, schema + ", cells binary"))
    wanted = target.select(F.lit(0).alias("id"), F.col(target_col).alias("text"))
    wanted = wanted.mapInArrow(work, "id int, n_words long, n_features long, cells binary")
    gains = spark.sparkContext.broadcast(bucket_gains(bucket_counts(scanned, buckets), bucket_counts(wanted, buckets)))
    weighed = scanned.mapInArrow(_weigh(gains, buckets), schema + ", weight long")
    scored = weighed.withColumns(
        {"score": F.col("weight") + gumbel(F.col("id"), seed), "place": F.monotonically_increasing_id()}
    )
    scored = staged(scored)
    gains.destroy()

    fit = F.col("n_words") >= least_words
    bins = scored.where(fit).groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    drawn = percent * sum(r["n"] for r in bins) // 100
    lowest = _lowest_bin(bins, drawn) if drawn else None
    out = scored.withColumn("rank", F.lit(None).cast("long"))
    if lowest is not None:
        high = fit & (F.col("score") >= lowest * BIN)
        out = out.where(~high).union(ranked(scored.where(high), drawn))
    return out.drop("place").withColumnRenamed("id", id_col)
