"""Line-up exports -> line-ups, appearances, formations and substitutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchframe import schema as S
from matchframe.functions import clean as C
from matchframe.operators.joins import dedupe_keep, union_by_name

# Column spellings of line-up exports: canonical name -> candidates.
LINEUP_ALIASES = {
    "match_id": ("match_id", "game_id", "fixture_id"),
    "season": ("season",),
    "date": ("date", "match_date"),
    "team": ("team", "squad", "club"),
    "opponent": ("opponent", "opp"),
    "is_home": ("is_home", "home", "venue_home"),
    "player": ("player", "name"),
    "position": ("position", "pos"),
    "position_group": ("position_group", "line", "unit"),
    "started": ("started", "start", "is_starter", "starter"),
    "is_substitute": ("is_substitute", "substitute", "bench"),
    "minutes": ("minutes", "mins", "min"),
    "sub_on_minute": ("sub_on_minute", "sub_on"),
    "sub_off_minute": ("sub_off_minute", "sub_off"),
    "formation": ("formation",),
    "captain": ("captain", "is_captain"),
    "manager": ("manager", "coach"),
    "player_off": ("player_off", "sub_off_player"),
    "player_on": ("player_on", "sub_on_player"),
    "minute": ("minute", "sub_minute"),
    "lineup_type": ("lineup_type", "type"),
    "source_collected_at": ("source_collected_at", "scraped_at", "collected_at"),
}


def _select(raw: DataFrame, schema: T.StructType, given: dict[str, Column]) -> DataFrame:
    return raw.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def normalize_lineups(raw: DataFrame, source: str, order: str) -> dict[str, DataFrame]:
    """One wide export -> four tables.  ``order`` ranks rows of the same key; the last one stays.

    Of rows with the same rank it is the one that is read first, the same in every table.
    """
    given: dict[str, Column] = {"source": F.lit(source)}
    numeric = {f.name for s in (S.LINEUPS, S.APPEARANCES, S.SUBSTITUTIONS) for f in s.fields if isinstance(f.dataType, T.DoubleType)}
    for name, aliases in LINEUP_ALIASES.items():
        c = C.first_alias(raw, aliases)
        if name in numeric:
            c = C.to_number(c)
        elif name in ("date", "source_collected_at"):
            c = C.parse_mixed_date(c)
        elif name == "lineup_type":
            c = F.coalesce(c.cast("string"), F.lit("actual"))
        given[name] = c
    rank = F.col(order)
    keyed = ["match_id", "date", "team"]

    def table(schema: T.StructType, need: list[str], key: list[str] | None) -> DataFrame:
        rows = raw.select(
            rank.alias("_rank"), (-F.monotonically_increasing_id()).alias("_tie"), *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
        ).dropna(subset=need)
        if key:
            rows = dedupe_keep(rows, key, ["_rank", "_tie"], keep="last")
        return rows.drop("_rank", "_tie")

    return {
        "lineups": table(S.LINEUPS, keyed, ["match_id", "team"]),
        "appearances": table(S.APPEARANCES, [*keyed, "player"], None),
        "formations": table(S.FORMATIONS, keyed, ["match_id", "team"]),
        "substitutions": table(S.SUBSTITUTIONS, [*keyed, "player_on"], None),
    }


def build_lineup_master(*sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Sources in rising priority, deduplicated per table with the last source winning."""
    keys = {"lineups": ["match_id", "team"], "appearances": ["match_id", "team", "player"], "formations": ["match_id", "team"]}
    out = {}
    for name in ("lineups", "appearances", "formations", "substitutions"):
        ranked = [s[name].withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)]
        rows = union_by_name(*ranked)
        if name in keys:
            rest = [c for c in sources[0][name].columns if c not in keys[name]]
            rows = dedupe_keep(rows, keys[name], ["_rank", *rest], keep="last")
        out[name] = rows.drop("_rank")
    return out


def enrich_with_schedule(raw: DataFrame, schedule: DataFrame) -> DataFrame:
    """Add date, teams and season of the schedule by match id, and infer the opponent."""
    s = schedule.select("match_id", "date", "season", F.col("home").alias("_home"), F.col("away").alias("_away"))
    add = [c for c in ("date", "season") if c not in raw.columns]
    s = dedupe_keep(s, ["match_id"], ["date", "_home", "_away"]).select("match_id", *add, "_home", "_away")
    out = raw.join(s, "match_id", "left")
    if "opponent" not in raw.columns:
        me, home, away = (C.map_entity(F.col(c).cast("string")) for c in ("team", "_home", "_away"))
        out = out.withColumn("opponent", F.when(me == home, away).otherwise(home))
    return out.drop("_home", "_away")


def match_lookup(matches: DataFrame) -> DataFrame:
    """Both orientations of every match: (date, team, opponent) -> id, season, side."""
    home, away = C.map_entity(F.col("home").cast("string")), C.map_entity(F.col("away").cast("string"))
    mid = C.slug_match_id(F.col("season"), F.col("match_date"), home, away)
    sides = F.array(
        F.struct(home.alias("team"), away.alias("opponent"), F.lit(1).alias("is_home")),
        F.struct(away.alias("team"), home.alias("opponent"), F.lit(0).alias("is_home")),
    )
    long = matches.select(
        mid.alias("match_id"), F.col("season").cast("string").alias("season"), F.col("match_date").alias("date"), F.inline(sides)
    )
    return dedupe_keep(long, ["date", "team", "opponent"], ["is_home", "match_id"])


def normalize_lineups_with_matches(raw: DataFrame, matches: DataFrame, order: str) -> dict[str, DataFrame]:
    """Map export rows to matches by (date, team, opponent); they count as known a day later.

    ``stats`` holds one row: raw, matched and unmatched counts.
    """
    named = raw.withColumns(
        {
            "_day": C.parse_mixed_date(C.first_alias(raw, ["date", "match_date"])),
            "_team": C.map_entity(C.first_alias(raw, ["team", "squad"]).cast("string")),
            "_opp": C.map_entity(C.first_alias(raw, ["opponent", "opp"]).cast("string")),
        }
    )
    keys = match_lookup(matches).select(
        F.col("date").alias("_day"), F.col("team").alias("_team"), F.col("opponent").alias("_opp"),
        F.col("match_id").alias("_mid"), F.col("season").alias("_season"), F.col("is_home").alias("_is_home"),
    )
    joined = named.join(keys, ["_day", "_team", "_opp"], "left")
    stats = joined.agg(
        F.count("*").alias("raw_rows"),
        F.count("_mid").alias("matched_team_rows"),
        (F.count("*") - F.count("_mid")).alias("unmatched_team_rows"),
    )
    hit = joined.where("_mid IS NOT NULL")

    def text(names: list[str]) -> Column:
        return C.first_alias(raw, names).cast("string")

    base = {
        "match_id": F.col("_mid"), "season": F.col("_season"), "date": F.col("_day"), "team": F.col("_team"),
        "opponent": F.col("_opp"), "is_home": F.col("_is_home"), "source": F.coalesce(text(["source"]), F.lit("export")),
        "source_collected_at": F.date_add("_day", 1), "formation": text(["formation"]),
        "captain": text(["captain", "is_captain"]), "lineup_type": F.lit("actual"), "player": text(["player", "name"]),
        "position": text(["position", "pos"]), "position_group": C.position_group(text(["position", "pos"])),
        "started": C.to_flag(C.first_alias(raw, ["is_starter", "started", "starter", "start"])),
        "is_substitute": C.to_flag(C.first_alias(raw, ["is_substitute", "substitute", "bench"])),
        "minutes": C.to_number(C.first_alias(raw, ["minutes", "minutes_played", "min"])),
        "sub_on_minute": F.lit(0.0), "sub_off_minute": F.lit(0.0),
    }
    last = dedupe_keep(hit, ["_mid", "_team"], [order], keep="last")
    return {
        "lineups": _select(last, S.LINEUPS, base),
        "appearances": _select(hit, S.APPEARANCES, base).dropna(subset=["player"]),
        "formations": _select(last, S.FORMATIONS, {k: v for k, v in base.items()}),
        "stats": stats,
    }
