"""Sequential folds of pools that are too large for one task: steps in time, independent groups inside a step.

A match depends on the earlier matches of its two teams only.  A large pool is cut
into steps of about ``STEP_ROWS`` matches, whole days each; a step starts from the
state that the steps before it left, a few numbers per team.  Inside a step, teams
that are not linked through its matches cannot touch one another, so every linked
group of teams is folded by itself and the groups run side by side.  No task holds
a pool, and a lost executor repeats part of one step.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchframe.plans.stages import staged

STEP_ROWS = 1_000_000


def needs_steps(rows: DataFrame, pool: str = "pool", step_rows: int = STEP_ROWS) -> bool:
    """Whether some pool has more than ``step_rows`` rows.  Runs a count."""
    return not rows.groupBy(pool).count().where(F.col("count") > step_rows).isEmpty()


def with_step(rows: DataFrame, step_rows: int, pool: str = "pool", day: str = "match_date") -> DataFrame:
    """Adds ``_step``: the pool's days in order, about ``step_rows`` rows a step.  Sorted is one row per pool and day."""
    daily = rows.groupBy(pool, day).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(pool).orderBy(day).rowsBetween(Window.unboundedPreceding, -1))
    steps = daily.select(pool, day, F.floor(F.coalesce(before, F.lit(0)) / step_rows).cast("int").alias("_step"))
    return rows.join(steps, [pool, day])


def linked_groups(rows: DataFrame, sides: Sequence[str] = ("home", "away"), pool: str = "pool") -> DataFrame:
    """(pool, team, _group): teams that are linked through matches share the least team as group.

    Labels fall to the least of the neighbours' and then to their label's label, so long chains take a
    logarithmic number of rounds.  Stages each round.
    """
    a, b = sides
    pairs = rows.select(pool, F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    both = staged(pairs.union(pairs.select(pool, "b", "a")).distinct())
    label = staged(both.groupBy(pool, "a").agg(F.least("a", F.min("b")).alias("l")))
    while True:
        near = both.join(label.select(pool, F.col("a").alias("b"), "l"), [pool, "b"]).groupBy(pool, "a").agg(F.min("l").alias("m"))
        low = label.join(near, [pool, "a"]).select(pool, "a", "l", F.least("l", "m").alias("m"))
        onward = label.select(pool, F.col("a").alias("m"), F.col("l").alias("j"))
        fallen = staged(low.join(onward, [pool, "m"]).select(pool, "a", "l", F.least("m", "j").alias("n")))
        label = fallen.select(pool, "a", F.col("n").alias("l"))
        if fallen.where("n <> l").isEmpty():
            return label.select(pool, F.col("a").alias("team"), F.col("l").alias("_group"))


def in_steps(
    rows: DataFrame, state: DataFrame, rate: Callable[[DataFrame, DataFrame], DataFrame], step_rows: int, pool: str = "pool"
) -> tuple[DataFrame, DataFrame]:
    """(rated rows, final state) of matches ``rows`` from ``state(pool, team, ...)``.

    ``rate(matches, state)`` gets both with a ``_group`` and returns rated matches (``_kind`` = 1) beside the
    groups' teams' new state (``_kind`` = 0, with the columns of ``state``).  Runs several jobs a step.
    """
    stepped = staged(with_step(rows, step_rows, pool))
    last = stepped.agg(F.max("_step")).first()[0]
    state, parts = staged(state), []
    for step in range(-1 if last is None else last + 1):
        now = stepped.where(F.col("_step") == step).drop("_step")
        groups = staged(linked_groups(now, pool=pool))
        played = now.join(groups.withColumnRenamed("team", "home"), [pool, "home"])
        out = staged(rate(played, state.join(groups, [pool, "team"])))
        parts.append(out.where("_kind = 1"))
        idle = state.join(groups, [pool, "team"], "left_anti")
        state = staged(out.where("_kind = 0").select(*state.columns).unionByName(idle))
    return reduce(DataFrame.unionByName, parts), state
