"""Writers: logs that grow, a latest snapshot, plain tables."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchframe.functions.clean import outcome_result
from matchframe.functions.probs import argmax3, triple


def forecast_snapshot(probs: DataFrame, at: Column, model_version: str, method: str = "raw") -> DataFrame:
    """Probabilities stamped with time and model, and the favourite with its probability."""
    p = triple()
    return probs.withColumns(
        {
            "snapshot_time_utc": at,
            "model_version": F.lit(model_version),
            "calibration_method": F.lit(method),
            "favorite": outcome_result(argmax3(p)),
            "favorite_probability": F.greatest(*p),
        }
    )


RUN = "run_id"


def write_run(df: DataFrame, path: str, run: str) -> None:
    """Write ``df`` as the run ``run`` of a log, in place of an earlier try of the same run.  Writes.

    A run is one partition of the log and only that partition is replaced, when all of its files are there: a
    write that was killed, or a retry of one that was not, leaves one copy.
    """
    rows = df.withColumn(RUN, F.lit(run))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RUN).parquet(path)


def latest_run(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the run of a log whose name is the greatest; names are times, or numbers of equal length.

    Reads one partition: the newest run is found from the partition values.
    """
    log = spark.read.parquet(path).withColumn(RUN, F.col(RUN).cast("string"))
    newest = log.agg(F.max(RUN)).first()[0]
    return log.where(F.col(RUN) == F.lit(newest))


def append_snapshot(snapshot: DataFrame, log_path: str, latest_path: str, run: str | None = None) -> None:
    """Append to the log and replace the latest snapshot.  Writes.

    With ``run``, the log holds one partition for each run and a repeated call replaces its own
    (``write_run``); ``latest_run`` reads the newest without a second copy.
    """
    if run is not None:
        write_run(snapshot, log_path, run)
    else:
        snapshot.write.mode("append").parquet(log_path)
    snapshot.write.mode("overwrite").parquet(latest_path)


def append_experiment(spark: SparkSession, record: Mapping[str, object], path: str, run: str | None = None) -> None:
    """Append one flattened record; nested values become JSON text.  Writes; with ``run`` a repeated call replaces its own."""
    flat = {k: v if isinstance(v, (int, float, str, bool)) or v is None else json.dumps(v, sort_keys=True) for k, v in record.items()}
    pairs = [(str(k), None if v is None else str(v)) for k, v in sorted(flat.items())]
    row = spark.createDataFrame([(pairs,)], "record array<struct<field:string,value:string>>")
    if run is not None:
        write_run(row, path, run)
    else:
        row.write.mode("append").parquet(path)


def experiment_records(results: DataFrame, name: Column, at: Column) -> DataFrame:
    """Result rows as long experiment records: (experiment, logged_at, field, value)."""
    fields = [c for c in results.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields])
    return results.select(name.alias("experiment"), at.alias("logged_at"), F.inline(pairs))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    """Write as parquet, CSV with a header, or JSON lines."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
