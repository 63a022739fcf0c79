"""Session helpers and the few knobs the operators read from the session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

CHUNK_DAYS_KEY = "spark.matchframe.chunkDays"
DEFAULT_CHUNK_DAYS = 182


def local_session(cpus: str = "8", app: str = "matchframe") -> SparkSession:
    """Single-machine session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("MATCHFRAME_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def chunk_days(spark: SparkSession) -> int:
    """Width in days of the time slices that split one key's history.

    Smaller slices bound the rows one task sees for a hot key; larger ones copy
    fewer context rows.  ``operators.windows.suggest_chunk_days`` measures a
    good value for a given table.
    """
    return int(spark.conf.get(CHUNK_DAYS_KEY, str(DEFAULT_CHUNK_DAYS)))
