"""Broadcast values of this subpackage, and letting executors drop those of earlier steps."""

from __future__ import annotations

from typing import Any

from pyspark import Broadcast
from pyspark.sql import SparkSession

_shared: dict[str, list[Broadcast]] = {}


def share(spark: SparkSession, value: Any) -> Broadcast:
    """Broadcast ``value``, to be dropped by the next ``forget``."""
    out = spark.sparkContext.broadcast(value)
    _shared.setdefault(spark.sparkContext.applicationId, []).append(out)
    return out


def forget(spark: SparkSession) -> None:
    """Executors drop what was shared so far; a frame that still needs such a value fetches it again from the driver."""
    for one in _shared.pop(spark.sparkContext.applicationId, []):
        one.unpersist()
