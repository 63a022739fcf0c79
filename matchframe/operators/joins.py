"""Joins, reshapes, set operations and ordering."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchframe.operators.windows import History, fits_whole, parts_for, tied_rank


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left equi join whose right keys must be unique; the plan itself raises otherwise."""
    rest = [c for c in right.columns if c not in keys]
    once = right.groupBy(*keys).agg(
        F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rest]
    )
    checked = once.withColumns(
        {c: F.when(F.col("_n") > 1, F.raise_error(F.lit("join key is not unique"))).otherwise(F.col(c)) for c in rest}
    ).drop("_n")
    return left.join(checked, list(keys), "left")


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join with nulls for misses; the engine broadcasts the right side if it is small enough."""
    return left.join(right, list(keys), "left")


# The interval index: a tree of day blocks, eight to a parent, over 262,144 days around 1970.  Days themselves
# (level 0) are not listed: the smallest blocks hold a week or so, and dates are compared after the join.
FAN, LEVELS, LEAST_LEVEL = 8, 6, 1
FIRST_DAY = -(FAN**LEVELS) // 2
_BLOCK = "array<struct<_level:int,_slot:bigint>>"


def _between(first: Column, last: Column, level: int) -> Column:
    blocks = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(blocks, lambda b: F.struct(F.lit(level).alias("_level"), b.alias("_slot")))


def covering_blocks(low: Column, stop: Column, least: int = 0) -> Column:
    """The fewest blocks of the tree that make up the days ``low`` to ``stop`` (exclusive), as (_level, _slot).

    Both must be borders of blocks of the level ``least``, the smallest that is used.
    """
    parts = []
    for level in range(least, LEVELS):
        width = FAN**level
        first, last = F.ceil(low / width), F.floor(stop / width) - 1
        if level == LEVELS - 1:
            parts.append(_between(first, last, level))
            continue
        # What the level above covers is left out here.
        up, down = F.ceil(low / (width * FAN)) * FAN, F.floor(stop / (width * FAN)) * FAN
        whole = up < down
        parts.append(_between(first, F.when(whole, up - 1).otherwise(last), level))
        parts.append(_between(F.when(whole, down).otherwise(last + 1), last, level))
    return F.concat(*parts)


def _slot(day: Column, level: Column | int) -> Column:
    """The number of the day's block: days are counted from zero, and eight blocks make a block of the next level."""
    return F.call_function("shiftright", day.cast("bigint"), F.lit(3) * level)


def two_blocks(low: Column, stop: Column) -> Column:
    """The one or two blocks, of the smallest ones that are as wide as the interval, that hold all of its days."""
    level = F.lit(LEVELS - 1)
    for least in reversed(range(LEAST_LEVEL, LEVELS - 1)):
        level = F.when(stop - low <= FAN**least, least).otherwise(level)
    first, last = (F.struct(level.alias("_level"), _slot(day, level).alias("_slot")) for day in (low, stop - 1))
    return F.when(first["_slot"] == last["_slot"], F.array(first)).otherwise(F.array(first, last)).cast(_BLOCK)


def interval_blocks(low: Column, stop: Column) -> Column:
    """``two_blocks``, or for an interval without an end (a null ``stop``) the block of its first day and a cover of all later days."""
    width = FAN**LEAST_LEVEL
    start = F.array(F.struct(F.lit(LEAST_LEVEL).alias("_level"), _slot(low, LEAST_LEVEL).alias("_slot"))).cast(_BLOCK)
    later = covering_blocks((_slot(low, LEAST_LEVEL) + 1) * width, F.lit(FAN**LEVELS), LEAST_LEVEL).cast(_BLOCK)
    return F.when(stop.isNull() | (stop - low > FAN ** (LEVELS - 1)), F.concat(start, later)).otherwise(two_blocks(low, stop))


def active_interval_join(
    events: DataFrame,
    facts: DataFrame,
    *,
    keys: Sequence[str] = ("team",),
    day: str = "match_date",
    known: str = "report_date",
    start: str = "unavailable_from",
    end: str = "expected_return_date",
) -> DataFrame:
    """Pairs (event, fact) with the fact known, begun and not ended on the event's day.

    A closed fact is listed under the one or two blocks, about as wide as itself, that hold it; an open one
    under the block of its first day and a cover of all later days, some twenty blocks.  An event looks once
    on every level of the tree, so it meets a fact at most once, through an equi join on (keys, level, block)
    that also compares the dates.  The pairs are the result itself: many events of a key times many open
    facts of it are that many; ``spell_totals`` gives sums without them.
    """
    begin = F.greatest(F.col(known), F.col(start)) if known != start else F.col(start)
    low, stop = F.unix_date("_from") - FIRST_DAY, F.unix_date(end) - FIRST_DAY + 1
    listed = (
        facts.withColumn("_from", begin)
        .where(F.col("_from").isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col("_from"))))
        .withColumns({"_until": F.col(end), "_blocks": interval_blocks(low, stop)})
        .select("*", F.inline("_blocks"))
        .drop("_blocks")
    )
    at = F.unix_date(day) - FIRST_DAY
    looks = F.array(
        *[F.struct(F.lit(v).alias("_level"), _slot(at, v).alias("_slot")) for v in range(LEAST_LEVEL, LEVELS)]
    )
    seen = events.withColumn("_day", F.col(day)).select("*", F.inline(looks)).alias("e")
    same = [F.col(f"e.{c}") == F.col(f"f.{c}") for c in (*keys, "_level", "_slot")]
    inside = (F.col("_from") <= F.col("_day")) & (F.col("_until").isNull() | (F.col("_until") >= F.col("_day")))
    # The engine takes the sides for as small as they are before the looks and blocks are listed.
    hit = seen.join(listed.alias("f").hint("merge"), reduce(and_, same, inside))
    given = [F.col(f"e.{c}") for c in events.columns]
    return hit.select(*given, *[F.col(f"f.{c}") for c in facts.columns if c not in keys])


def spell_totals(
    asks: DataFrame,
    facts: DataFrame,
    *,
    sums: dict[str, Column],
    present: dict[str, Column] | None = None,
    who: str | None = None,
    keys: Sequence[str] = ("team",),
    day: str = "match_date",
    known: str = "report_date",
    start: str = "unavailable_from",
    end: str = "expected_return_date",
    ties: Sequence[str] = ("match_id", "is_home"),
) -> DataFrame:
    """``asks`` with totals over the facts in force on their day, without listing the pairs.

    ``sums`` adds an amount of every fact in force; ``present`` counts the distinct ``who`` with such a fact
    that meets a condition.  Null amounts count as 0, null conditions as false, a null ``who`` as one more.

    A sweep over days: a fact adds its amounts on its first day and takes them back on the day after its
    last.  For ``present``, running counts of one ``who`` tell on which days it comes and goes, so overlapping
    facts count once.  Changes are summed up per key and day, and an ask reads their running sum over time
    slices.  Rows are linear in facts and asks.  Fractions are rounded to nine digits, which takes away
    what adding and taking back leaves.
    """
    present = present or {}
    begin = F.greatest(F.col(known), F.col(start)) if known != start else F.col(start)
    # A fact has two changes, so half as many facts fit.
    one = fits_whole(keys, asks, facts, facts)
    if one:
        # Facts and asks go to their key's place once, before the facts become changes; what follows is done there.
        parts = max(parts_for(facts), parts_for(asks))
        facts, asks = (x.repartition(parts, *keys) for x in (facts, asks))
    whole = facts.withColumns({"_from": begin, "_until": F.col(end)}).where(
        F.col("_from").isNotNull() & (F.col("_until").isNull() | (F.col("_until") >= F.col("_from")))
    )
    amount = {f"_s{i}": F.coalesce(c.cast("double"), F.lit(0.0)) for i, c in enumerate(sums.values())}
    there = {f"_p{i}": F.coalesce(c, F.lit(False)).cast("long") for i, c in enumerate(present.values())}
    changes = [*amount, *there]
    edges = F.array(
        F.struct(F.col("_from").alias("_at"), F.lit(1).alias("_sign")),
        F.struct(F.date_add("_until", 1).alias("_at"), F.lit(-1).alias("_sign")),
    )
    by = [*keys, "_who"] if present else list(keys)
    person = [F.col(who).alias("_who")] if present else []
    moves = whole.select(*keys, *person, F.inline(edges), *[c.alias(n) for n, c in (amount | there).items()]).where("_at IS NOT NULL")
    daily = moves.groupBy(*by, "_at").agg(*[F.sum(F.col("_sign") * F.col(c)).alias(c) for c in changes])
    if present:
        upto = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        counted = daily.withColumns({f"_n{c}": F.sum(c).over(upto) for c in there})
        came = {c: (F.col(f"_n{c}") > 0).cast("long") - (F.col(f"_n{c}") - F.col(c) > 0).cast("long") for c in there}
        daily = counted.withColumns(came).groupBy(*keys, "_at").agg(*[F.sum(c).alias(c) for c in changes])
    rows = asks.withColumns({"_at": F.col(day), "_q": F.lit(1)}).unionByName(daily.withColumn("_q", F.lit(0)), allowMissingColumns=True)
    h = History(rows, keys, day="_at", ties=("_q", *ties), totals={c: F.col(c) for c in changes}, whole=one)
    total = {c: F.sum(c).over(h.running()) for c in changes}
    out = h.real(h.frame.withColumns(total)).where("_q = 1")
    read = [F.round(F.coalesce(F.col(c), F.lit(0.0)), 9).alias(n) for c, n in zip(amount, sums, strict=True)]
    read += [F.coalesce(F.col(c), F.lit(0)).alias(n) for c, n in zip(there, present, strict=True)]
    return out.select(*asks.columns, *read)


def asof_last(
    left: DataFrame,
    right: DataFrame,
    *,
    keys: Sequence[str] = ("team",),
    day: str = "match_date",
    ties: Sequence[str] = ("match_id",),
    value: Sequence[str],
    known: str | None = None,
    whole: bool = False,
) -> DataFrame:
    """Latest right row dated strictly before each left row.

    ``right`` has one row per (keys, day).  With ``known`` the right row must
    also have been collected before the left day, so it takes effect on the day
    after the later of the two.  Adds ``asof_day`` and the ``value`` columns.

    A running maximum of (day, value) over time slices: each slice starts from
    the carried maximum of the slices before it.  With ``whole`` (``windows.fits_whole`` of both sides) a key is one slice.
    """
    seen = F.col(day) if known is None else F.greatest(F.col(day), F.coalesce(F.col(known), F.col(day)))
    facts = right.select(
        *keys, F.date_add(seen, 1).alias("_at"), F.struct(F.col(day).alias("day"), *value).alias("_val"), F.lit(0).alias("_q")
    )
    asks = left.withColumns({"_at": F.col(day), "_q": F.lit(1)})
    rows = asks.unionByName(facts, allowMissingColumns=True)
    h = History(rows, keys, day="_at", ties=("_q", *ties), whole=whole)
    inside = F.max(F.col("_val")).over(h.running())
    if whole:
        out = h.real(h.frame.withColumn("_last", inside)).where("_q = 1")
        return out.select(*left.columns, F.col("_last.day").alias("asof_day"), *[F.col(f"_last.{c}").alias(c) for c in value])
    per = rows.withColumn("_chunk", h.slice_of(F.col("_at"))).groupBy(*keys, "_chunk").agg(F.max("_val").alias("_m"))
    prior = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(*keys, "_chunk", F.max("_m").over(prior).alias("_carry"))
    frame = h.frame.join(carried, [*keys, "_chunk"], "left")
    out = h.real(frame.withColumn("_last", F.greatest(inside, F.col("_carry")))).where("_q = 1")
    return out.select(
        *left.columns, F.col("_last.day").alias("asof_day"), *[F.col(f"_last.{c}").alias(c) for c in value]
    )


def anti_join_played(fixtures: DataFrame, done: DataFrame, keys: Sequence[str] = ("home", "away")) -> DataFrame:
    return fixtures.join(done.select(*keys).distinct(), list(keys), "left_anti")


def semi_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), list(keys), "left_semi")


def lineup_pairs(starters: DataFrame, group: Sequence[str] = ("team", "match_date")) -> DataFrame:
    """Unordered pairs of players who started together, one row per line-up and pair.

    A group is one line-up, which the rules of the game bound at eleven players.
    """
    keep = [c for c in starters.columns if c not in group]
    a = starters.select(*group, *[F.col(c).alias(c + "_a") for c in keep])
    b = starters.select(*group, *[F.col(c).alias(c + "_b") for c in keep])
    return a.join(b, list(group)).where(F.col("player_a") < F.col("player_b"))


def dedupe_keep(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "first") -> DataFrame:
    """First or last row per key in ``order``; most copies drop before the shuffle."""
    by = [F.col(c).desc_nulls_last() if keep == "last" else F.col(c).asc_nulls_last() for c in order]
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def union_by_name(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def team_set(matches: DataFrame, keys: Sequence[str] = ("season",)) -> DataFrame:
    """Distinct teams per key, from both sides."""
    sides = F.explode(F.array("home", "away")).alias("team")
    return matches.select(*keys, sides).distinct()


def unpivot_outcomes(df: DataFrame, ids: Sequence[str], columns: dict[str, str], name: str, value: str) -> DataFrame:
    """One row per outcome: ``columns`` maps column name to outcome label."""
    pairs = ", ".join(f"'{label}', {c}" for c, label in columns.items())
    return df.select(*ids, F.expr(f"stack({len(columns)}, {pairs}) AS ({name}, {value})"))


def cross_grid(df: DataFrame, **grid: Sequence[float]) -> DataFrame:
    """Rows times a fixed parameter grid, expanded in place without a join."""
    out = df
    for name, values in grid.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def top_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_n_per_key(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def rank_min(df: DataFrame, keys: Sequence[str], by: str, name: str = "rank") -> DataFrame:
    """Competition ranking per key, best (highest) value first, nulls last."""
    return tied_rank(df, keys, by, name=name)


def recent_meetings(matches: DataFrame, n: int = 5) -> DataFrame:
    """Latest ``n`` meetings of every pair with the score text and the winner."""
    pair = matches.withColumns({"team_a": F.least("home", "away"), "team_b": F.greatest("home", "away")})
    newest = [F.col("match_date").desc(), F.col("match_id").desc()]
    top = top_n_per_key(pair, ["team_a", "team_b"], n, newest, "meeting")
    return top.withColumns(
        {
            "score": F.concat_ws("-", F.col("hg").cast("string"), F.col("ag").cast("string")),
            "winner": F.when(F.col("hg") > F.col("ag"), F.col("home")).when(F.col("hg") < F.col("ag"), F.col("away")),
        }
    )


def assemble_features(base: DataFrame, *blocks: DataFrame, key: str = "match_id") -> DataFrame:
    """Feature blocks side by side; every block is already partitioned by the match."""
    out = base
    for b in blocks:
        out = out.join(b, key, "left")
    return out


def available_columns(df: DataFrame, columns: Sequence[str], *, need_mass: bool = False) -> DataFrame:
    """Which columns exist, hold a value and, if asked, a non-zero one: (column, available)."""
    have = [c for c in columns if c in df.columns]
    checks = []
    for c in have:
        ok = F.count(c) > 0
        if need_mass:
            ok = ok & (F.coalesce(F.sum(F.abs(F.col(c).cast("double"))), F.lit(0.0)) > 0)
        checks.append(ok.alias(c))
    pairs = [F.struct(F.lit(c).alias("column"), (F.col(c) if c in have else F.lit(False)).alias("available")) for c in columns]
    row = df.agg(*checks) if checks else df.limit(1).agg(F.count("*").alias("_n"))
    return row.select(F.inline(F.array(*pairs)))
