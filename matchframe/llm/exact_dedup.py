"""Exact duplicates by a tree merge of sorted digest runs.

Each row's text becomes a SHA-256 digest and a byte length.  Every partition is
a run: it holds each of its digests once, with the best identifier and the number
of rows, combined before anything is exchanged.  Then runs merge in rounds: run
``r`` of a round takes the runs ``fan_in * r ...`` of the round before, sorted together
by digest and identifier; of the entries of one digest, at most ``fan_in``, the first in
that order stays with the sum of the counts.  Length and digest must both agree, and
the order puts the best identifier first at every level.  After a logarithmic number
of rounds one run is left, itself spread over all partitions by digest.  Its verdicts
go back through the first runs, so that the rows of a very frequent text meet them
under a key for each partition that they came from.

Texts never move; only (digest, length, id, count) does.  A text with a third of all
rows is one entry of each run, and no key of the joins has more rows than a partition.

Cases: a null text counts as empty; a null id is chosen only if all are null; rows that
share the winning id all stay, as they are one document listed twice; an empty
table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchframe.plans.stages import staged


def merged_runs(runs: DataFrame, width: int, best: Column, fan_in: int) -> DataFrame:
    """One run of ``width`` sorted ones: (digest, size, best, rows), merged ``fan_in`` at a time."""
    key = ["run", "digest", "size"]
    order = Window.partitionBy(*key).orderBy(best)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    while width > 1:
        width = -(-width // fan_in)
        dealt = runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        counted = dealt.withColumns({"place": F.row_number().over(order), "rows": F.sum("rows").over(whole)})
        runs = counted.where("place = 1").drop("place")
    return runs.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fan_in: int = 8) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    ``keep`` is ``min`` or ``max``: which identifier of equal texts stays.
    Runs two jobs, which stage the digests and count the runs.
    """
    agg = {"min": F.min, "max": F.max}[keep]
    best = F.col("best").asc_nulls_last() if keep == "min" else F.col("best").desc_nulls_last()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = staged(
        docs.select(
            F.col(id_col).alias("id"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            F.octet_length(text).cast("long").alias("size"),
            F.spark_partition_id().alias("run"),
        )
    )
    width = rows.agg(F.coalesce(F.max("run") + 1, F.lit(0))).first()[0]
    first = rows.groupBy("run", "digest", "size").agg(agg("id").alias("best"), F.count(F.lit(1)).alias("rows"))
    verdict = first.select("run", "digest", "size").join(merged_runs(first, width, best, fan_in), ["digest", "size"])
    return rows.join(verdict, ["run", "digest", "size"]).select(
        F.col("id").alias(id_col),
        F.col("best").alias("keep_id"),
        F.col("rows").alias("group_size"),
        F.col("id").eqNullSafe(F.col("best")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
