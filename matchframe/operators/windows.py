"""Ordered windows that do not put a whole key into one task.

``Window.partitionBy(team)`` sends every row of a team to one task, which fails
when one team holds a large part of the table.  ``History`` cuts each key's
rows into time slices, copies a *bounded* amount of context to the front of
every slice, and then windows over (key, slice):

* the last ``rows`` earlier rows of the key (for ``ROWS n PRECEDING`` frames),
* daily pre-aggregates of the last ``days`` days (for calendar frames),
* one row with the totals of all earlier slices (for running sums).

The context comes from partial aggregates and from a per-slice top-n, so what is
shuffled twice is a few rows per (key, slice).  The results equal those of the
plain window; ``tests/test_windows.py`` checks this on a skewed table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from matchframe.plans.stages import staged
from matchframe.settings import CHUNK_DAYS_KEY, chunk_days

REAL, RECENT, DAILY, TOTAL = 0, 1, 2, 3
_INTERNAL = ("_chunk", "_ctx", "_front")


class History:
    """Sliced history of ``df`` per ``keys``, ordered by ``day`` and ``ties``.

    ``rows``        longest ROWS look-back needed
    ``rows_where``  only rows meeting this condition enter the copied look-back
    ``days``        longest calendar look-back needed, in days
    ``ahead``       longest calendar look-ahead needed, in days
    ``day_sums``    name -> per-row value, summed by calendar frames
    ``totals``      name -> per-row value, summed by running frames
    ``totals_by``   further keys of the running frames (for example season)
    ``whole``       each key's history is one slice and nothing is copied: for tables that ``fits_whole`` has measured
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        *,
        day: str = "match_date",
        ties: Sequence[str] = ("match_id",),
        rows: int = 0,
        rows_where: Column | None = None,
        days: int = 0,
        ahead: int = 0,
        day_sums: dict[str, Column] | None = None,
        totals: dict[str, Column] | None = None,
        totals_by: Sequence[str] = (),
        width: int | None = None,
        whole: bool = False,
    ) -> None:
        self.keys = list(keys)
        self.order = [day, *ties]
        self.day = day
        self.whole = whole
        self.width = width or chunk_days(df.sparkSession)
        self.width = max(self.width, days + 1, ahead + 1)
        base = df.withColumn("_chunk", self.slice_of(F.col(day)))
        real = base.withColumns(
            {**(day_sums or {}), **(totals or {}), "_ctx": F.lit(REAL), "_front": F.lit(1)}
        )
        if whole:
            self.frame = real
            return
        parts = [real]
        if rows:
            parts.append(self._recent_rows(base, rows, rows_where))
        if days:
            parts.append(self._daily_rows(base, F.unix_date(F.col(day)) >= (F.col("_chunk") + 1) * self.width - days, 1, day_sums or {}))
        if ahead:
            parts.append(self._daily_rows(base, F.unix_date(F.col(day)) < F.col("_chunk") * self.width + ahead, -1, day_sums or {}))
        if totals:
            parts.append(self._total_rows(base, totals, list(totals_by)))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        self.frame = out

    def slice_of(self, day: Column) -> Column:
        return F.lit(0).cast("long") if self.whole else F.floor(F.unix_date(day) / self.width).cast("long")

    def _recent_rows(self, base: DataFrame, n: int, where: Column | None) -> DataFrame:
        """Last ``n`` earlier rows of the key, one copy per slice that follows."""
        src = base if where is None else base.where(where)
        back = Window.partitionBy(*self.keys, "_chunk").orderBy(*[F.col(c).desc() for c in self.order])
        tail = src.withColumn("_rn", F.row_number().over(back)).where(F.col("_rn") <= n).drop("_rn")
        rest = [c for c in base.columns if c not in (*self.keys, *self.order, "_chunk")]
        packed = tail.groupBy(*self.keys, "_chunk").agg(
            F.sort_array(F.collect_list(F.struct(*self.order, *rest))).alias("_tail")
        )
        slices = base.select(*self.keys, "_chunk").distinct()
        if where is None:
            marks = packed
        else:
            marks = slices.join(packed, [*self.keys, "_chunk"], "left")
        # A slice without rows has no entry, so n entries always hold n rows,
        # but a slice whose rows all fail ``where`` holds none: skip those.
        if where is None:
            prior = Window.partitionBy(*self.keys).orderBy("_chunk").rowsBetween(-n, -1)
            seen = F.flatten(F.collect_list("_tail").over(prior))
        else:
            kept = F.sum(F.col("_tail").isNotNull().cast("long"))
            upto = Window.partitionBy(*self.keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
            marks = marks.withColumn("_k", F.coalesce(kept.over(upto), F.lit(0)))
            prior = Window.partitionBy(*self.keys).orderBy("_k").rangeBetween(-n, -1)
            seen = F.flatten(F.collect_list("_tail").over(prior))
        last_n = F.slice(seen, F.greatest(F.size(seen) - n + 1, F.lit(1)), n)
        return (
            marks.withColumn("_rows", last_n)
            .select(*self.keys, "_chunk", F.explode("_rows").alias("_r"))
            .select(*self.keys, "_chunk", "_r.*", F.lit(RECENT).alias("_ctx"), F.lit(1).alias("_front"))
        )

    def _daily_rows(self, base: DataFrame, near: Column, step: int, sums: dict[str, Column]) -> DataFrame:
        """Per-day sums of the days that the slice one ``step`` on can see."""
        return (
            base.where(near)
            .groupBy(*self.keys, self.day, (F.col("_chunk") + step).alias("_to"))
            .agg(*[F.sum(v).alias(k) for k, v in sums.items()])
            .withColumnRenamed("_to", "_chunk")
            .withColumns({"_ctx": F.lit(DAILY), "_front": F.lit(0)})
        )

    def _total_rows(self, base: DataFrame, totals: dict[str, Column], by: list[str]) -> DataFrame:
        """Sums of all earlier slices, one row per (key, slice)."""
        per_slice = base.groupBy(*self.keys, *by, "_chunk").agg(*[F.sum(v).alias(k) for k, v in totals.items()])
        prior = (
            Window.partitionBy(*self.keys, *by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        )
        return per_slice.withColumns({k: F.sum(k).over(prior) for k in totals}).withColumns(
            {"_ctx": F.lit(TOTAL), "_front": F.lit(0)}
        )

    def part(self, by: Sequence[str] = ()) -> WindowSpec:
        return Window.partitionBy(*self.keys, "_chunk", *by)

    def ordered(self, by: Sequence[str] = ()) -> WindowSpec:
        return self.part(by).orderBy("_front", *self.order)

    def last(self, n: int) -> WindowSpec:
        """The ``n`` rows before the current one."""
        return self.ordered().rowsBetween(-n, -1)

    def running(self, by: Sequence[str] = ()) -> WindowSpec:
        """Everything before the current row."""
        return self.ordered(by).rowsBetween(Window.unboundedPreceding, -1)

    def running_inclusive(self, by: Sequence[str] = ()) -> WindowSpec:
        return self.ordered(by).rowsBetween(Window.unboundedPreceding, 0)

    def within_days(self, low: int, high: int) -> WindowSpec:
        """Rows dated between ``low`` and ``high`` days ago, both counted as positive ages."""
        return self.part().orderBy(F.unix_date(F.col(self.day))).rangeBetween(-high, -low)

    def next_days(self, low: int, high: int) -> WindowSpec:
        """Rows dated between ``low`` and ``high`` days later."""
        return self.part().orderBy(F.unix_date(F.col(self.day))).rangeBetween(low, high)

    def real(self, df: DataFrame) -> DataFrame:
        """Drop the context rows and the bookkeeping columns."""
        return df.where(F.col("_ctx") == REAL).drop(*_INTERNAL)


def real_row(value: Column) -> Column:
    """``value`` on true rows (own or copied), null on aggregate context rows."""
    return F.when(F.col("_ctx").isin(REAL, RECENT), value)


#: Rows of a key up to which its history is windowed as it is.
WHOLE_ROWS = 100_000


def fits_whole(keys: Sequence[str], *tables: DataFrame) -> bool:
    """Whether no key has more than ``WHOLE_ROWS`` rows in all tables together.  Counts the rows of each key.

    Such histories need no slices: where teams have a hundred matches, half-year slices copy more context than they hold
    rows.  A slice width that the session sets is kept.
    """
    if tables[0].sparkSession.conf.get(CHUNK_DAYS_KEY, None) is not None:
        return False
    most = 0
    for t in tables:
        busiest = t.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        most += busiest or 0
    return most <= WHOLE_ROWS


#: Rows of a part where one task groups and joins all rows of its keys.
PART_ROWS = 500_000


def parts_for(df: DataFrame) -> int:
    """As many parts as the session's shuffles have, more where these would hold over ``PART_ROWS`` rows, fewer for small tables.

    A ``repartition`` into that many parts is not merged by the engine, so what a task holds does not grow with the table.
    Counts the rows.
    """
    rows = df.count()
    usual = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + 20 * rows // PART_ROWS)
    return max(usual, -(-rows // PART_ROWS))


def suggest_chunk_days(df: DataFrame, keys: Sequence[str], *, day: str = "match_date", target_rows: int = 2_000_000) -> int:
    """Slice width that keeps the busiest key near ``target_rows`` per slice.

    Runs one small aggregate (row count and day span of the busiest key).
    """
    busiest = (
        df.groupBy(*keys)
        .agg(F.count("*").alias("n"), (F.datediff(F.max(day), F.min(day)) + 1).alias("span"))
        .agg(F.max(F.struct("n", "span")).alias("top"))
        .select("top.*")
        .first()
    )
    if busiest is None or busiest["n"] is None:
        return 1
    slices = max(1, -(-busiest["n"] // target_rows))
    return max(1, int(busiest["span"]) // slices)


SLICE_ROWS = 1_000_000


def _value_slices(df: DataFrame, keys: list[str], value: Column, rows: int) -> DataFrame:
    """Adds ``_slice``: ascending value ranges of about ``SLICE_ROWS`` of ``rows`` rows, by approximate quantiles.

    Equal values share a slice, so the approximation only affects how even the slices are.
    """
    slices = -(-rows // SLICE_ROWS)
    if slices <= 1:
        return df.withColumn("_slice", F.lit(0))
    cuts = [i / slices for i in range(1, slices)]
    bounds = df.groupBy(*keys).agg(F.percentile_approx(value, cuts, 10 * slices).alias("_cuts"))
    if keys:
        rows_with = df.join(bounds, keys)
    else:
        # A single row of at most ``slices`` numbers.
        rows_with = df.withColumn("_one", F.lit(1)).join(F.broadcast(bounds.withColumn("_one", F.lit(1))), "_one").drop("_one")
    return rows_with.withColumn("_slice", F.size(F.filter("_cuts", lambda c: c < value))).drop("_cuts")


def value_positions(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """(keys..., by, _n, _below): rows with each value, and with a smaller one.  Stages the value counts.

    Rows are counted per value before anything is sorted, so a frequent value is
    one row; distinct values are summed up in value slices.
    """
    keys = list(keys)
    counts = staged(df.where(F.col(by).isNotNull()).groupBy(*keys, by).agg(F.count("*").alias("_n")))
    cut = _value_slices(counts, keys, F.col(by).cast("double"), counts.count())
    inside = Window.partitionBy(*keys, "_slice").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    below = F.coalesce(F.sum("_n").over(inside), F.lit(0))
    return cut.withColumn("_in", below).join(before, [*keys, "_slice"]).select(
        *keys, by, "_n", (F.col("_in") + F.col("_before")).alias("_below")
    )


def tied_rank(df: DataFrame, keys: Sequence[str], by: str, *, name: str = "rank", descending: bool = True) -> DataFrame:
    """Competition rank of a possibly huge key by ``by``, nulls last.  Stages the value counts."""
    keys = list(keys)
    places = value_positions(df, keys, by)
    whole = places.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    if keys:
        ranked = df.join(places, [*keys, by], "left").join(whole, keys, "left")
    else:
        one = F.broadcast(whole.withColumn("_one", F.lit(1)))
        ranked = df.join(places, by, "left").withColumn("_one", F.lit(1)).join(one, "_one").drop("_one")
    better = F.col("_all") - F.col("_below") - F.col("_n") if descending else F.col("_below")
    rank = F.coalesce(better, F.col("_all"), F.lit(0)) + 1
    return ranked.withColumn(name, rank).drop("_n", "_below", "_all")


def uniform_rank(df: DataFrame, keys: Sequence[str], by: str, *, name: str, ties: Sequence[str]) -> DataFrame:
    """Row number by ``by``, a number drawn evenly from [0, 1).  Runs a count."""
    keys = list(keys)
    slices = max(1, -(-df.count() // SLICE_ROWS))
    rows = df.withColumn("_slice", F.floor(F.col(by) * slices).cast("int"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(by, *ties))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = counts.select(*keys, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    out = rows.withColumn("_in", inside).join(before, [*keys, "_slice"])
    return out.withColumn(name, F.col("_in") + F.col("_before")).drop("_slice", "_in", "_before")


def exact_quantiles(df: DataFrame, keys: Sequence[str], column: str, probs: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles per key: (keys..., q, value).  Stages the value counts."""
    keys = list(keys)
    places = staged(value_positions(df.select(*keys, column), keys, column))
    whole = places.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    asked = whole.withColumn("q", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumn(
        "_at", F.col("q") * (F.col("_all") - 1) + 1
    )
    if keys:
        met = places.join(asked, keys)
    else:
        met = places.withColumn("_one", F.lit(1)).join(F.broadcast(asked.withColumn("_one", F.lit(1))), "_one")
    upto = F.col("_below") + F.col("_n")
    # The value at a place is the least one that enough rows reach.
    low = F.min(F.when(upto >= F.floor("_at"), F.col(column)))
    high = F.min(F.when(upto >= F.floor("_at") + 1, F.col(column)))
    part = met.groupBy(*keys, "q", "_at").agg(low.alias("_low"), high.alias("_high"))
    between = F.col("_at") - F.floor("_at")
    return part.select(
        *keys, "q", (F.col("_low") + between * (F.coalesce("_high", "_low") - F.col("_low"))).alias("value")
    )
