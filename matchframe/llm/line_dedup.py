"""Boilerplate lines, judged inside each site.

For every host, the share of its pages that contain a line is the number of
those pages over the host's page total.  A line beyond ``ratio`` on at least
``min_pages`` pages is boilerplate and is dropped from all pages of that host.

A page contributes each distinct line once, as a digest, and digests are counted
before the exchange: a host or a line with a third of all rows becomes one row
per task.  A host has at most (mean distinct lines per page) / ``ratio``
boilerplate lines, so its list is short.  The lists are staged and counted; up
to ``broadcast_lines`` in total they are broadcast, beyond that pages meet them
in a join on (host, salt) with ``salts`` parts per host.

Cases: lines are compared without surrounding spaces, blank lines always stay;
a null host is a site of its own; a null text stays null with no lines; an
empty table gives an empty result; ``n_lines`` and ``n_removed`` replace input
columns of the same names, and all other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchframe.plans.stages import staged

HOST, LISTED, SALT = "__site_host", "__site_lines", "__site_salt"


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line)))


def _host_key(host_col: str) -> Column:
    host = F.col(host_col).cast("string")
    return F.when(host.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), host))


def boilerplate_lines(docs: DataFrame, text_col: str, host_col: str, ratio: float, min_pages: int) -> DataFrame:
    """The digests of each host's boilerplate lines as one array per host."""
    pages = docs.select(_host_key(host_col).alias(HOST), F.split(F.col(text_col), "\n", -1).alias("lines"))
    totals = pages.groupBy(HOST).agg(F.count(F.lit(1)).alias("pages"))
    real = F.filter("lines", lambda x: F.trim(x) != "")
    seen = pages.select(HOST, F.explode(F.array_distinct(F.transform(real, _digest))).alias("line"))
    counts = seen.groupBy(HOST, "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    frequent = counts.join(totals, HOST).where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return frequent.groupBy(HOST).agg(F.collect_list("line").alias(LISTED))


def line_dedup(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = 0.1, min_pages: int = 5,
    broadcast_lines: int = 100_000, salts: int = 64, key_col: str = "doc_id",
) -> DataFrame:
    """``docs`` without boilerplate lines, plus ``n_lines`` and ``n_removed``.  Runs a job for the line lists."""
    lists = staged(boilerplate_lines(docs, text_col, host_col, ratio, min_pages))
    total = lists.agg(F.coalesce(F.sum(F.size(LISTED)), F.lit(0))).first()[0]
    keyed = docs.withColumn(HOST, _host_key(host_col))
    if total <= broadcast_lines:
        joined = keyed.join(F.broadcast(lists), HOST, "left")
    else:
        salted = keyed.withColumn(SALT, F.pmod(F.xxhash64(key_col), F.lit(salts)).cast("int"))
        spread = lists.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = salted.join(spread, [HOST, SALT], "left").drop(SALT)
    lines = F.split(F.col(text_col), "\n", -1)
    stays = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(LISTED), _digest(x)))
    stays = F.when(F.col(LISTED).isNull(), lines).otherwise(stays)
    text = F.when(F.col(text_col).isNotNull(), F.array_join(stays, "\n"))
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    out = joined.withColumns(
        {
            "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(n_lines).cast("long"),
            "n_removed": F.when(F.col(text_col).isNull(), 0).otherwise(n_lines - F.size(stays)).cast("long"),
        }
    )
    return out.withColumn(text_col, text).drop(HOST, LISTED)
