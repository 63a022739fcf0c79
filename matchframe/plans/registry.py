"""Registered queries: a Spark function and, where SQL can say it, its twin.

A query declares its output as ``"name:kind ..."`` where kind is ``i`` (bigint),
``s`` (string, dates included) or ``dN`` (double rounded to N places).  The same
declaration casts and rounds both sides, so the two results compare cell by cell.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchframe.plans.tables import CTES, Tables


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = self.build(Tables(spark, sf_dir))
        return out.select(*[_spark_cell(c, k) for c, k in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body, used = self.sql, []
        pending = True
        while pending:
            pending = False
            for name in reversed(CTES):
                text = " ".join([body, *[CTES[u] for u in used]])
                if name not in used and f"@{name}" in text:
                    used.append(name)
                    pending = True
        ctes = ", ".join(f"{n} AS ({CTES[n]})" for n in CTES if n in used)
        sql = body.strip()
        if sql[:4].upper() == "WITH":
            rest = sql[4:].strip()
            recursive = rest[:9].upper() == "RECURSIVE"
            rest = rest[9:].strip() if recursive else rest
            inner = f"WITH {'RECURSIVE ' if recursive else ''}{ctes + ', ' if ctes else ''}{rest}"
        else:
            inner = f"WITH {ctes} {sql}" if ctes else sql
        cells = ", ".join(_sql_cell(c, k) for c, k in self.columns)
        return f"SELECT {cells} FROM ({inner}) AS q".replace("@", "")


def _spark_cell(name: str, kind: str):
    c = F.col(name)
    if kind == "i":
        return c.cast("bigint").alias(name)
    if kind == "s":
        return c.cast("string").alias(name)
    return (rounded(c.cast("double"), int(kind[1:])) + F.lit(0.0)).alias(name)


def rounded(x: Column, places: int) -> Column:
    """``F.round``, which goes through decimal text, by plain arithmetic where the two cannot differ.

    Away from the middle of two steps (by more than the product's error of at most 2e-5) the nearest step is certain, and a
    whole number divided by a power of ten is the double nearest to that decimal, as in ``F.round``.
    """
    scale = float(10**places)
    y = x * scale
    certain = (F.abs(y) < 1e11) & (F.abs(y - F.floor(y) - 0.5) > 1e-4)
    return F.when(certain, F.floor(y + 0.5) / F.lit(scale)).otherwise(F.round(x, places))


def _sql_cell(name: str, kind: str) -> str:
    q = f'"{name}"'
    if kind == "i":
        return f"CAST({q} AS BIGINT) AS {q}"
    if kind == "s":
        return f"CAST({q} AS VARCHAR) AS {q}"
    return f"round(CAST({q} AS DOUBLE), {int(kind[1:])}) + 0.0::DOUBLE AS {q}"


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Register ``build(tables) -> DataFrame`` under ``name``."""

    def add(build: Callable[[Tables], DataFrame]):
        cols = tuple(tuple(x.rsplit(":", 1)) for x in columns.split())
        assert name not in REGISTRY, name
        REGISTRY[name] = Query(name, cols, build, sql)
        return build

    return add


def both_sides(cols: str) -> str:
    """``"a:d4 b:i"`` -> the same columns with home_ and away_ prefixes."""
    return " ".join(f"{s}_{c}" for s in ("home", "away") for c in cols.split())


def wide_sql(source: str, cols: str, key: str = "match_id") -> str:
    """SQL twin of ``longform.to_wide``."""
    picks = ", ".join(
        f"max(CASE WHEN is_home = {f} THEN {c} END) AS {s}_{c}"
        for c in cols.split()
        for f, s in ((1, "home"), (0, "away"))
    )
    return f"SELECT {key}, {picks} FROM {source} GROUP BY {key}"
