"""Result files that keep arriving, appended once each to a results table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchframe.sources.readers import RESULT_COLUMNS, SHOT_COLUMNS, clean_results, merge_new_results

KEYS = ("match_date", "home", "away")


def results_stream(spark: SparkSession, folder: str, season: str) -> DataFrame:
    """Cleaned rows of every result CSV that appears in ``folder``."""
    names = [*RESULT_COLUMNS, *SHOT_COLUMNS]
    schema = ", ".join(f"`{n}` string" for n in names)
    return clean_results(spark.readStream.schema(schema).option("header", True).csv(folder), F.lit(season))


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists, in whatever file system it names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def append_new_results(stream: DataFrame, table: str, progress: str, *, once: bool = True):
    """Append the matches that ``table`` lacks, batch by batch; returns the running query.

    A batch that is run again finds its own rows in the table and adds nothing.
    Of the table only the days of the batch are read.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        if _exists(spark, table):
            span = batch.agg(F.min("match_date").alias("a"), F.max("match_date").alias("b")).first()
            base = spark.read.parquet(table).where(F.col("match_date").between(F.lit(span["a"]), F.lit(span["b"])))
        else:
            base = batch.limit(0)
        known = base.select(*KEYS).withColumn("_old", F.lit(1))
        merged = merge_new_results(base.limit(0), batch, KEYS)
        merged.join(known, list(KEYS), "left_anti").select(*batch.columns).write.mode("append").parquet(table)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", progress)
    return (writer.trigger(availableNow=True) if once else writer).start()
