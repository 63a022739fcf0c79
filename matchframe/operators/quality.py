"""Data-quality reports, all as small long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchframe.functions import clean as C
from matchframe.plans.stages import shuffles_freed


def missing_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null and missing rows and the coverage per column, from one scan."""
    have = [c for c in columns if c in df.columns]
    row = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in have])
    parts = [
        F.struct(
            F.lit(c).alias("field"),
            F.col(c).alias("non_null_rows"),
            (F.col("_n") - F.col(c)).alias("missing_rows"),
            F.when(F.col("_n") > 0, F.col(c) / F.col("_n")).otherwise(0.0).alias("coverage"),
        )
        for c in have
    ]
    return row.select(F.inline(F.array(*parts)))


def season_coverage(df: DataFrame) -> DataFrame:
    per = df.groupBy("match_id").agg(F.count("*").alias("n"), F.min("season").alias("season"))
    return per.groupBy("season").agg(
        F.sum("n").alias("team_rows"),
        F.count("*").alias("matches"),
        F.sum((F.col("n") == 2).cast("long")).alias("matches_with_two_team_rows"),
    )


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key occurs more than once.

    Only the repeated keys are joined back, so single rows drop early.
    """
    many = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return df.join(many, list(keys), "left_semi")


FIXTURE_COLUMNS = (
    "season", "matchweek", "date", "kickoff_time_uk", "kickoff_time_dk", "home_team", "away_team", "source",
    "source_url", "fixture_status", "last_updated",
)


def _checks(row: DataFrame, rules: dict[str, tuple[Column, Column]], keys: Sequence[str] = ()) -> DataFrame:
    """One row of numbers per key -> (check, value, status): ``name -> (value, passes)``."""
    parts = [
        F.struct(
            F.lit(name).alias("check"), value.cast("double").alias("value"),
            F.when(ok, "pass").otherwise("fail").alias("status"),
        )
        for name, (value, ok) in rules.items()
    ]
    return row.select(*keys, F.inline(F.array(*parts)))


def validate_fixtures(df: DataFrame, keys: Sequence[str] = (), *, fixtures: int = 380, teams: int = 20) -> DataFrame:
    """Counts, teams, home and away balance, duplicates, dates and times per list."""
    missing = [c for c in FIXTURE_COLUMNS if c not in df.columns and c not in keys]
    time = r"^\d{2}:\d{2}$"
    k = list(keys)

    def bad_time(c: str) -> Column:
        if c not in df.columns:
            return F.lit(0)
        return F.sum((~F.coalesce(F.col(c).rlike(time), F.lit(False))).cast("long"))

    per_fixture = df.groupBy(*k, "date", "home_team", "away_team").agg(
        F.count("*").alias("n"), bad_time("kickoff_time_uk").alias("uk"), bad_time("kickoff_time_dk").alias("dk")
    )
    bad_day = F.col("date").isNull() if dict(df.dtypes)["date"] == "date" else F.col("date").try_cast("date").isNull()
    whole = per_fixture.groupBy(*k).agg(
        F.sum("n").alias("fixtures"),
        F.sum(F.col("n") - 1).alias("duplicates"),
        F.sum(F.when(bad_day, F.col("n")).otherwise(0)).alias("bad_dates"),
        F.sum("uk").alias("bad_uk"),
        F.sum("dk").alias("bad_dk"),
    )
    sides = F.inline(
        F.array(
            F.struct(F.col("home_team").alias("team"), F.lit(1).alias("h"), F.lit(0).alias("a")),
            F.struct(F.col("away_team").alias("team"), F.lit(0).alias("h"), F.lit(1).alias("a")),
        )
    )
    per_team = df.select(*k, sides).groupBy(*k, "team").agg(F.sum("h").alias("h"), F.sum("a").alias("a"))
    half = teams - 1

    def off(c: Column) -> Column:
        return F.sum(c.cast("long"))

    balance = per_team.groupBy(*k).agg(
        F.count("*").alias("teams"),
        off(F.col("h") + F.col("a") != 2 * half).alias("off_total"),
        off(F.col("h") != half).alias("off_home"),
        off(F.col("a") != half).alias("off_away"),
    )
    if k:
        both = whole.join(balance, k)
    else:
        both = whole.withColumn("_1", F.lit(1)).join(balance.withColumn("_1", F.lit(1)), "_1").drop("_1")
    zero = lambda c: (F.col(c), F.col(c) == 0)
    return _checks(
        both,
        {
            "missing_columns": (F.lit(len(missing)), F.lit(not missing)),
            "fixture_count": (F.col("fixtures"), F.col("fixtures") == fixtures),
            "team_count": (F.col("teams"), F.col("teams") == teams),
            "duplicate_fixtures": zero("duplicates"),
            "invalid_dates": zero("bad_dates"),
            "invalid_uk_times": zero("bad_uk"),
            "invalid_dk_times": zero("bad_dk"),
            "teams_off_total": zero("off_total"),
            "teams_off_home": zero("off_home"),
            "teams_off_away": zero("off_away"),
        },
        k,
    )


def fixture_mode(checks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    failed = F.sum((F.col("status") == "fail").cast("int"))
    return checks.groupBy(*keys).agg(
        F.when(failed == 0, "Official fixtures loaded").otherwise("Fixture data outdated").alias("mode"),
        failed.alias("failed_checks"),
    )


def validate_lineups(lineups: DataFrame, appearances: DataFrame) -> DataFrame:
    """Duplicates, missing dates, 10-12 starters and two line-ups per match in more than 95 %."""
    per_player = appearances.groupBy("match_id", "team", "player").agg(
        F.count("*").alias("n"),
        F.sum((F.col("started") >= 1).cast("long")).alias("s"),
        F.sum(F.col("match_date").isNull().cast("long")).alias("no_date"),
    )
    per_team = per_player.groupBy("match_id", "team").agg(
        F.sum(F.col("n") - 1).alias("dup"), F.sum("s").alias("starters"), F.sum("no_date").alias("no_date")
    )
    good = F.when(F.col("starters") > 0, F.col("starters").between(10, 12).cast("double"))
    a = per_team.agg(F.sum("dup").alias("dup_players"), F.sum("no_date").alias("no_date"), F.avg(good).alias("good_share"))
    per_side = lineups.groupBy("match_id", "team").agg(F.count("*").alias("n"))
    per_match = per_side.groupBy("match_id").agg(F.sum(F.col("n") - 1).alias("dup"), F.count("*").alias("teams"))
    b = per_match.agg(F.sum("dup").alias("dup_lineups"), F.avg((F.col("teams") == 2).cast("double")).alias("two_share"))
    one = a.withColumn("_1", F.lit(1)).join(b.withColumn("_1", F.lit(1)), "_1")
    return _checks(
        one,
        {
            "duplicate_player_appearances": (F.col("dup_players"), F.col("dup_players") == 0),
            "duplicate_team_lineups": (F.col("dup_lineups"), F.col("dup_lineups") == 0),
            "missing_dates": (F.col("no_date"), F.col("no_date") == 0),
            "starter_count": (F.col("good_share"), F.col("good_share") > 0.95),
            "two_team_lineups_per_match": (F.col("two_share"), F.col("two_share") > 0.95),
        },
    )


def validate_managers(rows: DataFrame, project_matches: int = 380) -> DataFrame:
    per_key = rows.groupBy("match_date", "team", "opponent", "match_id").agg(F.count("*").alias("n"))
    dup = per_key.groupBy("match_date", "team", "opponent").agg(F.sum("n").alias("n")).agg(
        F.sum(F.col("n") - 1).alias("dup")
    )
    per_match = per_key.select("match_id", "team").distinct().groupBy("match_id").agg(F.count("*").alias("teams"))
    cover = per_match.agg(F.count("*").alias("matches"), F.avg((F.col("teams") == 2).cast("double")).alias("two_share"))
    one = dup.withColumn("_1", F.lit(1)).join(cover.withColumn("_1", F.lit(1)), "_1")
    return _checks(
        one,
        {
            "duplicate_team_match_managers": (F.col("dup"), F.col("dup") == 0),
            "two_manager_rows_per_match": (F.col("two_share"), F.col("two_share") > 0.95),
            "match_coverage": (F.col("matches"), F.col("matches") >= project_matches),
        },
    )


def price_column_inventory(df: DataFrame, columns: Sequence[str], season: str = "season") -> DataFrame:
    """Per price column: class, seasons covered, values present and missing."""
    per = df.groupBy(season).agg(
        F.count("*").alias("_n"), *[F.count(F.col(f"`{c}`").try_cast("double")).alias(c) for c in columns]
    )
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("present")) for c in columns])
    long = per.select(F.col(season).cast("string").alias("season"), "_n", F.inline(cells))
    out = long.groupBy("column").agg(
        F.array_join(F.sort_array(F.collect_set("season")), ", ").alias("seasons_covered"),
        F.sum("present").alias("non_missing_values"),
        F.sum(F.col("_n") - F.col("present")).alias("missing_values"),
    )
    kinds = C.classify_price_column("column")
    ok = kinds.pop("is_match_price")
    return out.where(ok).withColumns(kinds)


def inventory_rollup(inventory: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts and joined column names per class; one row per price column goes in."""
    return inventory.groupBy(*keys).agg(
        F.count("*").alias("column_count"),
        F.sum("non_missing_values").alias("non_missing_values"),
        F.sum("missing_values").alias("missing_values"),
        F.array_join(F.sort_array(F.collect_set("column")), ", ").alias("columns"),
    )


def source_coverage(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_file", "competition").agg(
        F.count("*").alias("team_rows"),
        F.count_distinct("team").alias("teams"),
        F.min("match_date").alias("first_date"),
        F.max("match_date").alias("last_date"),
    )


def validate_matches(df: DataFrame, shots: Sequence[str] = ("hs", "as_", "hst", "ast")) -> DataFrame:
    """Rows, date range and rows with a missing shot count, per season."""
    gap = F.lit(False)
    for c in shots:
        gap = gap | F.col(c).isNull()
    return df.groupBy("season").agg(
        F.count("*").alias("matches"),
        F.min("match_date").alias("first_date"),
        F.max("match_date").alias("latest_date"),
        F.sum(gap.cast("long")).alias("shot_missing_rows"),
    )


def assess_prediction_quality(
    df: DataFrame, *, match_date: Column, latest: Column, rest: dict[str, Column], known: dict[str, Column],
    signal: dict[str, Column], has_xg: bool = True
) -> DataFrame:
    """Warnings per fixture as an array of codes, and the status by their number."""
    stale = match_date > F.date_add(latest, 14)
    found = [F.when(stale, "stale_data")]
    for side in ("home", "away"):
        found.append(F.when((rest[side] > 30) & ~stale, f"{side}_long_gap"))
        found.append(
            F.when(~known[side] & signal[side], f"{side}_adjusted_history").when(~known[side], f"{side}_no_history")
        )
    if not has_xg:
        found.append(F.lit("missing_xg"))
    warnings = F.filter(F.array(*found), lambda w: w.isNotNull())
    return df.withColumn("warnings", warnings).withColumn("status", C.quality_label(F.size("warnings")))


def signal_coverage(df: DataFrame, signals: dict[str, Sequence[str]], split: str = "split") -> DataFrame:
    """Rows with any positive value per signal and split."""
    aggs = [
        F.sum((sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0)) > 0).cast("long")).alias(name)
        for name, cols in signals.items()
    ]
    per = df.groupBy(split).agg(F.count("*").alias("rows"), *aggs)
    cells = F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).alias("with_signal")) for n in signals])
    return per.select(split, "rows", F.inline(cells))


def validate_feature_policy(columns: DataFrame, policy: DataFrame) -> DataFrame:
    """Columns that active features name but the table lacks: (feature, column)."""
    need = policy.where("active").select("feature", F.explode("columns").alias("column"))
    return need.join(columns.select("column").distinct(), "column", "left_anti")


def feature_lists(policy: DataFrame) -> DataFrame:
    return policy.groupBy("active").agg(
        F.count("*").alias("features"), F.array_join(F.sort_array(F.collect_set("feature")), ", ").alias("names")
    )


def field_availability(df: DataFrame, fields: dict[str, Sequence[str]], source: str) -> DataFrame:
    """Whether all source columns of each field exist in ``df`` and hold values."""
    have = sorted({c for cols in fields.values() for c in cols if c in df.columns})
    row = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in have])
    parts = [
        F.struct(
            F.lit(source).alias("source"), F.lit(f).alias("field"),
            F.lit(bool(cols) and all(c in have for c in cols)).alias("available"),
            (sum((F.col(c) for c in cols if c in have), F.lit(0))).alias("values"),
            F.lit("|".join(cols)).alias("source_columns"),
        )
        for f, cols in fields.items()
    ]
    return row.select(F.inline(F.array(*parts)))


def _late_keys_apart(source: DataFrame, ids: DataFrame, day: Column, key: str) -> DataFrame:
    """``source`` with new keys, beyond all others, for rows from ``day`` on that share a key of ``ids``."""
    kind = source.schema[key].dataType
    if isinstance(kind, T.StringType):
        ends = source.agg(F.max(key).alias("_high"))
        new = F.concat("_high", F.lit("/"), key)
    else:
        ends = source.agg((F.max(key) - F.min(key) + 1).alias("_high"))
        new = (F.col(key) + F.col("_high")).cast(kind)
    shared = ids.withColumn("_early", F.lit(True))
    marked = source.join(shared, key, "left").join(F.broadcast(ends))
    late = F.col("_early") & ~F.coalesce(F.col("match_date") < day, F.lit(False))
    return marked.withColumn(key, F.when(late, new).otherwise(F.col(key))).select(*source.columns)


#: Groups of rows, by a digest of the row, whose sums are compared before any row is.
DIGESTS = 4096


def _digested(df: DataFrame) -> DataFrame:
    """Adds ``_group`` and four 32-bit parts ``_d0`` to ``_d3`` of two digests of the row; equal rows, nulls and NaN included, have equal ones."""
    atomic = {f.name for f in df.schema if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)}
    cells = [F.col(c) if c in atomic else F.col(c).cast("string") for c in df.columns]
    # Nulls leave a digest as it is, so it takes in which cells are null.
    gaps = [c.isNull() for c in cells]
    h = [F.xxhash64(F.lit(seed), *cells, *gaps) for seed in (1, 2)]
    parts = [x.bitwiseAND(F.lit(0xFFFFFFFF)) if low else F.shiftrightunsigned(x, 32) for x in h for low in (True, False)]
    return df.withColumns({"_group": F.pmod(h[0], F.lit(DIGESTS)).cast("int"), **{f"_d{i}": x for i, x in enumerate(parts)}})


def _digest_sums(digested: DataFrame, cases: Sequence[Column]) -> list[dict[int, tuple]]:
    """Per case, a condition on the rows: rows and sums of the digests of every group that has some.  Runs a job."""
    values = [F.lit(1).cast("long"), *[F.col(f"_d{i}") for i in range(4)]]
    sums = [F.sum(F.when(case, v).otherwise(0)).alias(f"s{k}_{i}") for k, case in enumerate(cases) for i, v in enumerate(values)]
    rows = digested.groupBy("_group").agg(*sums).collect()
    return [{r["_group"]: found for r in rows if (found := tuple(r[f"s{k}_{i}"] for i in range(5)))[0]} for k in range(len(cases))]


def leakage_checks(build, source: DataFrame, cutoffs: Sequence[str], key: str = "match_id") -> list[DataFrame]:
    """``leakage_check`` for each of ``cutoffs``.  Runs the builds, one after the other.

    All rows are built once for the cutoffs that no key has rows on both sides of.  Sums of row digests, 128 bits a row, are
    compared first, so that no built row travels; rows meet one by one only in groups whose sums differ.  A build's
    shuffle files go when its sums are known.
    """
    spark = source.sparkSession
    with shuffles_freed(spark):
        day = F.col("match_date")
        keys = source.groupBy(key).agg(F.min(day).alias("_first"), F.max(day).alias("_last"), F.count_if(day.isNull()).alias("_open"))
        dates = [F.lit(c).cast("date") for c in cutoffs]
        straddles = [(F.col("_first") < d) & ((F.col("_last") >= d) | (F.col("_open") > 0)) for d in dates]
        shared = keys.agg(*[F.coalesce(F.bool_or(x), F.lit(False)).alias(str(k)) for k, x in enumerate(straddles)]).first()
        parts = [build(source.where(day < d)) for d in dates]
        cells = parts[0].columns

        def built(rows: DataFrame) -> DataFrame:
            return build(rows).select(*cells)

        first = keys.select(F.col(key).alias("_key"), "_first")

        def dated(rows: DataFrame) -> DataFrame:
            return _digested(rows).join(first, F.col(key) == F.col("_key"))

        apart = [k for k in range(len(dates)) if shared[k]]
        common = [k for k in range(len(dates)) if not shared[k]]
        wholes = {k: built(_late_keys_apart(source, keys.where(F.col("_first") < dates[k]).select(key), dates[k], key)) for k in apart}
        wholes |= dict.fromkeys(common, built(source) if common else None)
        sums = {}
        for some in [common, *[[k] for k in apart]]:
            if some:
                sums |= dict(zip(some, _digest_sums(dated(wholes[some[0]]), [F.col("_first") < dates[k] for k in some]), strict=True))
        out = []
        for k, d in enumerate(dates):
            part = _digested(parts[k].select(*cells))
            (ours,) = _digest_sums(part, [F.lit(True)])
            differ = [g for g in range(DIGESTS) if sums[k].get(g) != ours.get(g)]
            ids = source.where(day < d).select(key).distinct()
            full = _digested(wholes[k]).join(ids, key, "left_semi").select("_group", *cells)
            # Rows are counted once, up for the one side and down for the other.
            both = full.withColumn("_n", F.lit(1)).unionByName(part.select("_group", *cells, F.lit(-1).alias("_n")))
            both = both.where(F.col("_group").isin(differ)) if differ else both.where(F.lit(False))
            more = both.groupBy(*cells).agg(F.sum("_n").alias("_n")).where("_n <> 0")
            side = F.when(F.col("_n") > 0, "full").otherwise("truncated").alias("side")
            out.append(more.select(*cells, side, F.explode(F.array_repeat(F.lit(1), F.abs("_n").cast("int"))).alias("_n")).drop("_n"))
        return out


def leakage_check(build, source: DataFrame, cutoff: str, key: str = "match_id") -> DataFrame:
    """Rows whose features before ``cutoff`` change when later source rows are dropped.  Runs the builds.

    ``build(df) -> features`` is run on all and on the truncated rows; a leak-free
    builder gives an empty result.  A later row whose key an earlier row has too is
    built under a key of its own, as the features do not tell the two apart.
    """
    return leakage_checks(build, source, [cutoff], key)[0]
