"""Two rows per match, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchframe.functions.clean import points_from_goals

# role in the long row -> (column when at home, column when away)
SIDES = {
    "team": ("home", "away"),
    "opponent": ("away", "home"),
    "gf": ("hg", "ag"),
    "ga": ("ag", "hg"),
    "xgf": ("hxg", "axg"),
    "xga": ("axg", "hxg"),
    "sf": ("hs", "as_"),
    "sa": ("as_", "hs"),
    "sotf": ("hst", "ast"),
    "sota": ("ast", "hst"),
}
SHARED = ("match_id", "pool", "season", "match_date", "result")


def to_long(matches: DataFrame, extra: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """One row per (match, side).  Columns that the input lacks are left out."""
    have = set(matches.columns)
    roles = {k: v for k, v in {**SIDES, **(extra or {})}.items() if set(v) <= have}
    rows = F.array(
        *[
            F.struct(F.lit(flag).alias("is_home"), *[F.col(cols[side]).alias(role) for role, cols in roles.items()])
            for flag, side in ((1, 0), (0, 1))
        ]
    )
    keep = [c for c in SHARED if c in have]
    long = matches.select(*keep, F.inline(rows))
    if {"gf", "ga"} <= set(roles):
        long = long.withColumns(
            {
                "points": points_from_goals(F.col("gf"), F.col("ga")),
                "is_draw": (F.col("gf") == F.col("ga")).cast("int"),
            }
        )
    return long


def side_value(flag: int, value: Column | str) -> Column:
    return F.max(F.when(F.col("is_home") == flag, F.col(value) if isinstance(value, str) else value))


def to_wide(
    long: DataFrame, columns: Sequence[str], key: Sequence[str] = ("match_id",), shared: dict[str, Column] | None = None
) -> DataFrame:
    """Back to one row per match with ``home_``/``away_`` prefixes; ``shared`` values are equal on both sides."""
    return long.groupBy(*key).agg(
        *[side_value(flag, c).alias(f"{side}_{c}") for c in columns for flag, side in ((1, "home"), (0, "away"))],
        *[F.max(c).alias(name) for name, c in (shared or {}).items()],
    )
