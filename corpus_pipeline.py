"""From raw documents to sampled token ids: five stages, each written as Parquet and read again by the next.

When a stage begins, the result of the one before it is written, so executors drop what that one broadcast.

Cases: documents with a null or empty text go at the first stage, as they have no letter; null languages and
sources are values like others; an empty table gives an empty result; further columns pass through.  Rows that
repeat id and text count once from the jaccard_join stage on; there, rows with a null id or an id that other rows
have too are documents of their own, and a row with an id of its own stays before them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchframe.llm.decontamination import contamination
from matchframe.llm.groups import bounded
from matchframe.llm.jaccard_join import jaccard_components
from matchframe.llm.language_id import UNKNOWN, identify
from matchframe.llm.line_dedup import line_dedup
from matchframe.llm.sentencepiece_sampling import sample_segmentations
from matchframe.llm.shared import forget
from matchframe.plans.stages import checkpoint_dir, staged


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and documents that labelled texts show to be unlike every language."""
    forget(spark)
    seen = identify(docs, F.lit(True))
    return seen.where((F.col("lang_pred") != UNKNOWN) & ~F.col("strange")).select(*docs.columns)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop each source's boilerplate lines from its documents; ``n_chars`` follows the text."""
    forget(spark)
    out = line_dedup(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def _with_row_ids(docs: DataFrame, name: str) -> DataFrame:
    """One row for each id and text, with a row id: ``doc_id`` where it is unique, else a number above all ids.

    Only ids are counted; texts move only for rows whose id is null or repeated.
    """
    shared = staged(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name)).where(f"`{name}` > 1 OR doc_id IS NULL").select("doc_id"))
    own = docs.withColumn(name, F.col("doc_id").cast("long"))
    if shared.isEmpty():
        return own
    shared = bounded(shared.where("doc_id IS NOT NULL"))
    unclear = docs.where("doc_id IS NULL").unionByName(docs.join(shared, "doc_id", "left_semi"))
    # Digests in place of texts as keys, and a written table, so that numbers stay when tasks are repeated.
    once = unclear.withColumn(name, F.sha2("text", 256)).dropDuplicates(["doc_id", name])
    top = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0] or 0
    numbered = once.withColumn(name, F.monotonically_increasing_id() + F.lit(top + 1))
    return own.where("doc_id IS NOT NULL").join(shared, "doc_id", "left_anti").unionByName(staged(numbered))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose word 5-grams agree by 80 % or more, and those linked through them, the smallest row id stays."""
    forget(spark)
    row = "row_id"
    while row in docs.columns:
        row += "_"
    rows = _with_row_ids(docs, row)
    groups = jaccard_components(rows, id_col=row, n=5, percent=80)
    dropped = groups.where(F.col(row) != F.col("component_id")).select(row).distinct()
    return rows.join(bounded(dropped), row, "left_anti").select(*docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage, also a paraphrased one."""
    forget(spark)
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("item_ids") == 0).select(*docs.columns)


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document, in place of its text."""
    forget(spark)
    return sample_segmentations(docs).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("line_dedup", without_boilerplate),
    ("jaccard_join", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("sentencepiece", segmented),
]
#: Most stages are beyond SQL; tests hold each against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES[:-1]):
        place = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return STAGES[-1][1](spark, docs, sf_dir)
