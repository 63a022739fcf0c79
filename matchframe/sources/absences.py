"""Provider payloads and exports -> one canonical absence table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchframe.functions import clean as C
from matchframe.operators.joins import dedupe_keep, union_by_name
from matchframe.operators.windows import History, real_row
from matchframe.schema import ABSENCE_API, ABSENCES, SIDELINED_ITEM
from matchframe.sources.readers import with_defaults

ABSENCE_KEYS = ("report_date", "team", "player", "unavailable_from", "expected_return_date", "status_type")


def canonical(df: DataFrame, source: str, collected: Column, **given: Column) -> DataFrame:
    """Canonical columns: the given ones, zero for other numbers, null for other texts."""
    cols = []
    for f in ABSENCES.fields:
        if f.name in given:
            c = given[f.name]
        elif f.name == "source":
            c = F.lit(source)
        elif f.name in ("report_date", "source_collected_at"):
            c = collected
        else:
            c = F.lit(0.0 if isinstance(f.dataType, T.DoubleType) else None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def _suspended(status: Column) -> Column:
    return (status == "suspension").cast("double")


def from_fixture_feed(payloads: DataFrame, column: str, collected: Column) -> DataFrame:
    """Feed with one ``response`` item per player and fixture."""
    items = payloads.select(collected.alias("_at"), F.inline(F.from_json(column, ABSENCE_API)["response"]))
    reason = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("reason", "type", "description")])
    day = C.parse_mixed_date("fixture.date")
    status = C.status_from_reason(reason)
    return canonical(
        items,
        "fixture_feed",
        F.col("_at"),
        report_date=F.coalesce(day, "_at"),
        team=F.col("team.name"),
        player=F.col("player.name"),
        unavailable_from=F.coalesce(day, "_at"),
        expected_return_date=day,
        status_type=status,
        injury_or_suspension=reason,
        is_suspended=_suspended(status),
    )


def from_sidelined_feed(payloads: DataFrame, column: str, collected: Column) -> DataFrame:
    """Feed whose ``data`` is one entity or a list, with ``sidelined`` a list or ``{data: []}``."""

    def entities(path: str) -> Column:
        text = F.get_json_object(column, path)
        return F.when(text.startswith("["), F.from_json(text, "array<string>")).when(
            text.startswith("{"), F.array(text)
        )

    entity = payloads.select(collected.alias("_at"), F.explode(entities("$.data")).alias("_e"))
    side = F.get_json_object("_e", "$.sidelined")
    nested = F.get_json_object("_e", "$.sidelined.data")
    listed = F.when(side.startswith("["), side).when(nested.startswith("["), nested)
    items = entity.select("_at", F.explode(F.from_json(listed, f"array<{SIDELINED_ITEM}>")).alias("i"))

    def nestable(c: str) -> Column:
        return F.coalesce(F.col(f"i.sideline.{c}"), F.col(f"i.{c}"))

    player = F.coalesce(F.col("i.player"), F.col("i.sideline.player"))
    team = F.coalesce(F.col("i.participant"), F.col("i.team"), F.col("i.sideline.team"))
    kind = F.coalesce(F.col("i.type"), F.col("i.sideline.type"))
    reason = C.join_text(nestable("category"), kind["name"], kind["developer_name"])
    start, end = C.parse_mixed_date(nestable("start_date")), C.parse_mixed_date(nestable("end_date"))
    status = C.status_from_reason(reason)
    return canonical(
        items,
        "sidelined_feed",
        F.col("_at"),
        report_date=F.coalesce(start, "_at"),
        team=team["name"],
        player=F.coalesce(player["display_name"], player["common_name"], player["name"]),
        unavailable_from=F.coalesce(start, "_at"),
        expected_return_date=end,
        status_type=status,
        injury_or_suspension=reason,
        is_suspended=_suspended(status),
    )


def round_dates(matches: DataFrame) -> DataFrame:
    """Date of each team's n-th match of the season: (season_start, team, round, match_date)."""
    sides = F.explode(F.array("home", "away")).alias("team")
    long = matches.select("season_start", "match_date", F.col("home").alias("_h"), F.col("away").alias("_a"), sides)
    h = History(long, ["season_start", "team"], ties=("_h", "_a"), totals={"_n": F.lit(1)})
    number = F.coalesce(F.sum("_n").over(h.running()), F.lit(0)) + 1
    return h.real(h.frame.withColumn("round", number)).select("season_start", "team", "round", "match_date")


def from_round_status(rows: DataFrame, schedule: DataFrame) -> DataFrame:
    """Per player and round status -> absences.

    ``rows(season_start, team, player, round, status, detail, collected)``.  An
    expected starter has three starts in the last five known rounds or started
    the last one; a key player has 900 earlier minutes (90 per start, 25 per
    substitution); long-term means a stated return 30 days or more away.
    Rounds without a date count only when the player took the field.
    """
    status = F.lower(F.coalesce(F.col("status"), F.lit("")))
    dated = rows.withColumn("status", status).join(schedule, ["season_start", "team", "round"], "left")
    kept = dated.where(F.col("match_date").isNotNull() | F.col("status").isin("starting", "sub_in"))
    start = (F.col("status") == "starting").cast("int")
    minutes = F.when(F.col("status") == "starting", 90.0).when(F.col("status") == "sub_in", 25.0).otherwise(0.0)
    # Rounds take the place of days.
    ordered = kept.withColumns({"_round": F.date_from_unix_date("round"), "_start": start})
    h = History(ordered, ["season_start", "team", "player"], day="_round", ties=("status",), rows=5, totals={"_played": minutes})
    begun = real_row(F.col("_start"))
    seen = h.real(
        h.frame.withColumns(
            {
                "_starts5": F.coalesce(F.sum(begun).over(h.last(5)), F.lit(0)),
                "_last": F.coalesce(F.max(begun).over(h.last(1)), F.lit(0)),
                "_minutes": F.coalesce(F.sum("_played").over(h.running()), F.lit(0.0)),
            }
        )
    ).where("match_date IS NOT NULL AND status IN ('injured', 'suspended')")
    kind = F.when(F.col("status") == "suspended", "suspension").otherwise("injury")
    away_days = F.datediff(C.extract_return_date("detail"), "match_date")
    return canonical(
        seen,
        "round_status",
        F.col("collected"),
        report_date=F.col("match_date"),
        team=F.col("team"),
        player=F.col("player"),
        unavailable_from=F.col("match_date"),
        expected_return_date=F.col("match_date"),
        status_type=kind,
        injury_or_suspension=F.coalesce(F.nullif("detail", F.lit("")), "status"),
        is_expected_starter=((F.col("_starts5") >= 3) | (F.col("_last") == 1)).cast("double"),
        is_key_player=(F.col("_minutes") >= 900).cast("double"),
        is_long_term_injury=F.coalesce((away_days >= 30).cast("double"), F.lit(0.0)),
        is_suspended=_suspended(kind),
        minutes_played_last_365=F.col("_minutes"),
    )


def availability_rows(files: DataFrame, competition: str, default_collected: Column) -> DataFrame:
    """Nested availability files (``schema.AVAILABILITY_FILE``) -> rows for ``from_round_status``."""
    player = (
        files.select(
            F.col("season").cast("int").alias("season_start"),
            C.map_entity("club", strip_suffix=" FC").alias("team"),
            F.coalesce(C.parse_mixed_date("scrapedAt"), default_collected).alias("collected"),
            F.inline("competitions"),
        )
        .where(F.col("code") == competition)
        .select("season_start", "team", "collected", F.inline("players"))
    )
    return player.select(
        "season_start", "team", "collected", F.col("name").alias("player"), F.inline("matches")
    ).withColumn("round", F.split("round", r"\.")[0].try_cast("int")).where("round IS NOT NULL")


# Column spellings of flat exports: canonical name -> candidates.
_SHARED = {
    "player": ("player", "name"),
    "is_expected_starter": ("is_expected_starter", "expected_starter"),
    "is_key_player": ("is_key_player", "key_player"),
    "is_long_term_injury": ("is_long_term_injury", "long_term"),
    "goals_last_365": ("goals_last_365", "goals"),
    "xg_contribution_last_365": ("xg_contribution_last_365", "xg"),
    "xa_contribution_last_365": ("xa_contribution_last_365", "xa"),
    "defensive_contribution_last_365": ("defensive_contribution_last_365", "defensive_contribution", "def_actions"),
    "market_value_eur": ("market_value_eur", "market_value", "value"),
    "source_url": ("source_url", "url"),
}
SPELL_EXPORT = {
    **_SHARED,
    "report_date": ("report_date", "date", "from", "unavailable_from"),
    "team": ("team", "club", "squad"),
    "unavailable_from": ("unavailable_from", "from", "start_date", "injury_from"),
    "expected_return_date": ("expected_return_date", "until", "return_date", "injury_until"),
    "injury_or_suspension": ("injury", "reason", "type", "description"),
    "minutes_played_last_365": ("minutes_played_last_365", "minutes", "mins_last_365"),
    "source_collected_at": ("source_collected_at", "collected_at", "scraped_at"),
}
STATUS_EXPORT = {
    **_SHARED,
    "report_date": ("report_date", "date", "updated", "last_updated"),
    "team": ("team", "club"),
    "unavailable_from": ("unavailable_from", "start_date", "date"),
    "expected_return_date": ("expected_return_date", "return_date", "expected_return"),
    "injury_or_suspension": ("injury_or_suspension", "injury", "reason", "status"),
    "minutes_played_last_365": ("minutes_played_last_365", "minutes"),
    "source_collected_at": ("source_collected_at", "collected_at"),
}


def from_flat_export(raw: DataFrame, aliases: dict[str, Sequence[str]], source: str, *, read_status: bool) -> DataFrame:
    """Flat export with vendor column names; ``read_status`` takes suspensions from the reason."""
    found = {k: C.first_alias(raw, names) for k, names in aliases.items()}
    given: dict[str, Column] = {}
    for f in ABSENCES.fields:
        if f.name not in found:
            continue
        c = found[f.name]
        if f.name == "market_value_eur":
            given[f.name] = C.parse_money(c)
        elif isinstance(f.dataType, T.DoubleType):
            given[f.name] = C.to_number(c)
        elif isinstance(f.dataType, T.DateType):
            given[f.name] = C.parse_mixed_date(c)
        else:
            given[f.name] = c.cast("string")
    hit = F.coalesce(F.lower(given["injury_or_suspension"]).contains("suspend"), F.lit(False)) if read_status else F.lit(False)
    status = F.when(hit, "suspension").otherwise("injury")
    given.update(status_type=status, is_suspended=_suspended(status))
    return canonical(raw, source, F.lit(None), **given)


def from_own_file(raw: DataFrame) -> DataFrame:
    out = with_defaults(raw, ABSENCES)
    return out.withColumn("source", F.coalesce("source", F.lit("manual_injuries_csv")))


def build_absence_master(*frames: DataFrame) -> DataFrame:
    """All sources in one table; among equal keys the last listed source wins."""
    ranked = [f.withColumn("_source_rank", F.lit(i)) for i, f in enumerate(frames)]
    rows = union_by_name(*ranked).dropna(subset=["report_date", "team", "player", "unavailable_from"])
    rest = [f.name for f in ABSENCES.fields if f.name not in ABSENCE_KEYS]
    once = dedupe_keep(rows, ABSENCE_KEYS, ["_source_rank", *rest], keep="last")
    return once.select(*ABSENCES.names)
