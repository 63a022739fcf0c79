"""File readers and the cleaning step behind each of them."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchframe.functions import clean as C
from matchframe.functions.probs import odds_to_probs
from matchframe.operators.joins import dedupe_keep, join_one_to_one, union_by_name
from matchframe.schema import FIXTURE_API, XG_FILE

RESULT_COLUMNS = {"Date": "match_date", "HomeTeam": "home", "AwayTeam": "away", "FTHG": "hg", "FTAG": "ag", "FTR": "result"}
SHOT_COLUMNS = {"HS": "hs", "AS": "as_", "HST": "hst", "AST": "ast"}
PROVIDER_XG = {"HxG": "provider_hxg", "AxG": "provider_axg"}
MATCH_KEY = ["season", "match_date", "home", "away"]


def clean_results(raw: DataFrame, season: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Base columns plus any shot and xG columns present; incomplete rows drop.  ``keep`` names columns to hand on."""
    missing = [c for c in RESULT_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"missing result columns: {missing}")
    number = {**{k: v for k, v in RESULT_COLUMNS.items() if k in ("FTHG", "FTAG")}, **SHOT_COLUMNS, **PROVIDER_XG}
    cols = [season.alias("season"), C.parse_mixed_date("Date").alias("match_date")]
    for src, name in {**RESULT_COLUMNS, **SHOT_COLUMNS, **PROVIDER_XG}.items():
        if src == "Date" or src not in raw.columns:
            continue
        c = F.col(src)
        if src in number:
            c = c.try_cast("double")
            if src in RESULT_COLUMNS:
                c = c.cast("int")
        cols.append(c.alias(name))
    return raw.select(*cols, *keep).dropna(subset=list(RESULT_COLUMNS.values()))


def read_matches(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """One file (or glob) per season: ``{season: path}``; later files may have more columns."""
    out: DataFrame | None = None
    for season, path in paths.items():
        part = clean_results(spark.read.csv(path, header=True), F.lit(season))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no season files given")
    return out


def read_second_tier(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Lower-division results; shots and xG are optional there."""
    return read_matches(spark, paths)


def xg_rows(payload: DataFrame, season: Column) -> DataFrame:
    """Completed matches of a provider payload with a ``dates`` array."""
    return (
        payload.select(season.alias("season"), F.inline("dates"))
        .where("isResult")
        .select(
            "season",
            F.col("datetime").try_cast("timestamp").cast("date").alias("match_date"),
            C.map_entity("h.title").alias("home"),
            C.map_entity("a.title").alias("away"),
            F.col("xG.h").try_cast("double").alias("hxg"),
            F.col("xG.a").try_cast("double").alias("axg"),
        )
    )


def read_xg_json(spark: SparkSession, path: str, season: str) -> DataFrame:
    return xg_rows(spark.read.schema(XG_FILE).json(path, multiLine=True), F.lit(season))


def attach_xg(matches: DataFrame, xg: DataFrame) -> DataFrame:
    """xG by season, date and teams, with the result file's own xG where the provider has none."""
    out = join_one_to_one(matches, xg.select(*MATCH_KEY, "hxg", "axg"), MATCH_KEY)
    for side in ("hxg", "axg"):
        spare = "provider_" + side
        if spare in out.columns:
            out = out.withColumn(side, F.coalesce(side, spare)).drop(spare)
    return out


def attach_shots(matches: DataFrame, shots: DataFrame) -> DataFrame:
    names = list(SHOT_COLUMNS.values())
    return join_one_to_one(matches.drop(*names), shots.select(*MATCH_KEY, *names), MATCH_KEY)


def require_complete(df: DataFrame, columns: Sequence[str], show: Sequence[str] = MATCH_KEY) -> DataFrame:
    """Raise with ten examples if any listed column is null.  Runs a job that stops at ten rows."""
    gap = F.lit(False)
    for c in columns:
        gap = gap | F.col(c).isNull()
    examples = df.where(gap).select(*show).take(10)
    if examples:
        raise ValueError(f"missing values in {list(columns)}: {[r.asDict() for r in examples]}")
    return df


def with_defaults(
    df: DataFrame, schema: T.StructType, *, defaults: Mapping[str, object] | None = None, required: Sequence[str] = ()
) -> DataFrame:
    """Coerce to ``schema``: missing columns and unreadable numbers take their default.

    Numbers default to 0, everything else to null; rows without a required value drop.
    """
    defaults = dict(defaults or {})
    cols = []
    for f in schema.fields:
        fallback = defaults.get(f.name, 0.0 if isinstance(f.dataType, T.DoubleType) else None)
        if f.name not in df.columns:
            c = F.lit(fallback)
        elif isinstance(f.dataType, T.DateType):
            c = C.parse_mixed_date(f.name)
        else:
            c = F.col(f.name).try_cast(f.dataType)
            c = c if fallback is None else F.coalesce(c, F.lit(fallback))
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols).dropna(subset=list(required)) if required else df.select(*cols)


def read_table_with_defaults(spark: SparkSession, path: str, schema: T.StructType, **kw) -> DataFrame:
    return with_defaults(spark.read.csv(path, header=True), schema, **kw)


OPENING_COLUMNS = ("Season", "Date", "HomeTeam", "AwayTeam", "home_open_odds", "draw_open_odds", "away_open_odds")


def clean_opening_odds(raw: DataFrame) -> DataFrame:
    """Rows whose three opening prices all exceed one, with their implied probabilities."""
    missing = [c for c in OPENING_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"missing opening price columns: {missing}")
    h, d, a = (F.col(f"{o}_open_odds").try_cast("double") for o in ("home", "draw", "away"))
    out = raw.select(
        F.col("Season").cast("string").alias("season"),
        C.parse_mixed_date("Date").alias("match_date"),
        F.col("HomeTeam").alias("home"),
        F.col("AwayTeam").alias("away"),
        h.alias("home_odds"),
        d.alias("draw_odds"),
        a.alias("away_odds"),
    ).where("home_odds > 1 AND draw_odds > 1 AND away_odds > 1")
    return out.withColumns(odds_to_probs(F.col("home_odds"), F.col("draw_odds"), F.col("away_odds")))


def read_opening_odds(spark: SparkSession, path: str) -> DataFrame:
    return clean_opening_odds(spark.read.csv(path, header=True))


def clean_fixtures(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Official or plain fixture list in model column names.  ``keep`` names columns to hand on."""
    home = C.first_alias(raw, ["home_team", "HomeTeam"])
    away = C.first_alias(raw, ["away_team", "AwayTeam"])
    return raw.select(
        C.first_alias(raw, ["matchweek", "week"]).try_cast("int").alias("matchweek"),
        C.parse_mixed_date(C.first_alias(raw, ["date"])).alias("match_date"),
        C.map_entity(home).alias("home"),
        C.map_entity(away).alias("away"), *keep,
    ).dropna(subset=["match_date", "home", "away"])


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    return clean_fixtures(spark.read.csv(path, header=True))


def completed_only(raw: DataFrame, season: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of the running season that already have a score."""
    return clean_results(raw, season, keep)


def read_completed(spark: SparkSession, path: str, season: str) -> DataFrame:
    return completed_only(spark.read.csv(path, header=True), F.lit(season))


def fixtures_from_json(df: DataFrame, column: str, season: str, updated: Column) -> DataFrame:
    """API payload text -> fixture rows with UK and Danish kick-off times."""
    item = df.select(updated.alias("last_updated"), F.inline(F.from_json(column, FIXTURE_API)["content"]))
    at = F.timestamp_millis(F.col("kickoff.millis").cast("long"))
    uk, dk = F.from_utc_timestamp(at, "Europe/London"), F.from_utc_timestamp(at, "Europe/Copenhagen")
    club = [C.map_entity(F.col("teams")[i]["team"]["club"]["name"]) for i in (0, 1)]
    return item.select(
        F.lit(season).alias("season"),
        F.col("gameweek.gameweek").cast("int").alias("matchweek"),
        uk.cast("date").alias("date"),
        F.date_format(uk, "HH:mm").alias("kickoff_time_uk"),
        F.date_format(dk, "HH:mm").alias("kickoff_time_dk"),
        club[0].alias("home_team"),
        club[1].alias("away_team"),
        F.lit("scheduled_subject_to_change").alias("fixture_status"),
        "last_updated",
    )


def non_league_rows(raw: DataFrame, source: str, default_competition: str) -> DataFrame:
    """Fixture-level or team-level rows -> team rows with the competition weight."""
    day = C.parse_mixed_date(C.first_alias(raw, ["Date"])).alias("match_date")
    named = C.first_alias(raw, ["competition", "competition_name"])
    competition = F.coalesce(named.cast("string"), F.lit(default_competition))
    have = {c.lower() for c in raw.columns}
    home, away = C.first_alias(raw, ["HomeTeam", "home_team"]), C.first_alias(raw, ["AwayTeam", "away_team"])
    number = lambda names: C.to_number(C.first_alias(raw, names))
    if {"hometeam", "awayteam"} <= have or {"home_team", "away_team"} <= have:
        result = C.first_alias(raw, ["FTR"]).cast("string")
        sides = F.array(
            *[
                F.struct(
                    team.alias("team"),
                    opponent.alias("opponent"),
                    C.points_from_result(result, F.lit(at_home)).cast("double").alias("points"),
                    number(goals).alias("goals_for"),
                    number(shots).alias("shots_for"),
                )
                for team, opponent, at_home, goals, shots in (
                    (home, away, True, ["FTHG"], ["HS"]),
                    (away, home, False, ["FTAG"], ["AS"]),
                )
            ]
        )
        rows = raw.select(day, competition.alias("competition"), F.inline(sides))
    elif {"team", "opponent", "competition"} <= have:
        rows = raw.select(
            day,
            competition.alias("competition"),
            C.first_alias(raw, ["team"]).alias("team"),
            C.first_alias(raw, ["opponent"]).alias("opponent"),
            *[number([c]).alias(c) for c in ("points", "goals_for", "shots_for")],
        )
    else:
        raise ValueError("rows must be fixture-level or team-level")
    return (
        rows.withColumns({"source_file": F.lit(source), "weight": C.competition_weight("competition")})
        .dropna(subset=["match_date", "team"])
        .where("length(team) > 0")
    )


def read_non_league(spark: SparkSession, files: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``{source: (path, default competition)}`` -> one long table."""
    parts = [non_league_rows(spark.read.csv(p, header=True), s, c) for s, (p, c) in files.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_csv_dir(spark: SparkSession, path: str) -> DataFrame:
    """Every CSV of a directory as text, tagged with its name; columns that one file lacks are null there.

    An entry is a file or a folder of part files whose name ends in ``.csv``.  Lists the directory.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    inside = F.regexp_extract("path", r"/([^/]+[.]csv)(/[^/]*)?$", 1)
    names = sorted(r[0] for r in listed.select(inside.alias("n")).where("n <> ''").distinct().collect())
    if not names:
        raise ValueError(f"no CSV files in {path}")
    parts = [spark.read.csv(f"{path}/{n}", header=True).withColumn("source_file", F.lit(n)) for n in names]
    return union_by_name(*parts)


# --- tactics ---------------------------------------------------------------

RAW_TACTICS = (
    "possession", "passes_attempted", "passes_completed", "pass_completion_pct", "progressive_passes",
    "progressive_carries", "crosses", "long_balls", "shots", "shots_on_target", "tackles", "interceptions", "blocks",
)


def mapped_tactics(df: DataFrame) -> DataFrame:
    """Derived measures; each is null if any part is."""

    def raw(c: str) -> Column:
        return F.col(c).try_cast("double") if c in df.columns else F.lit(None).cast("double")

    return df.withColumns(
        {
            "average_possession": raw("possession"),
            "possession_score": raw("possession"),
            "progression_score": raw("progressive_passes") + raw("progressive_carries"),
            "directness_score": F.when(raw("passes_attempted") > 0, raw("long_balls") / raw("passes_attempted")),
            "crosses_per_match": raw("crosses"),
            "crossing_score": raw("crosses"),
            "attacking_pressure_score": raw("shots") + 2.0 * raw("shots_on_target"),
            "defensive_activity_score": raw("tackles") + raw("interceptions") + raw("blocks"),
        }
    )


def team_stats_to_tactics(matches: DataFrame) -> DataFrame:
    """Two tactical rows per result row, known from the day after the match."""
    mid = C.slug_match_id(F.col("season"), F.col("match_date"), F.col("home"), F.col("away"))
    sides = F.array(
        *[
            F.struct(
                F.col(team).alias("team"), F.col(opp).alias("opponent"), F.lit(flag).alias("is_home"),
                F.lit(venue).alias("venue"), F.col(s).alias("shots"), F.col(t).alias("shots_on_target"),
            )
            for team, opp, flag, venue, s, t in (
                ("home", "away", 1, "home", "hs", "hst"), ("away", "home", 0, "away", "as_", "ast"),
            )
        ]
    )
    long = matches.select(
        mid.alias("match_id"), "season", "match_date", F.date_add("match_date", 1).alias("source_collected_at"),
        F.inline(sides),
    )
    rows = dedupe_keep(long, ["match_id", "team"], ["shots", "shots_on_target", "is_home"])
    return mapped_tactics(rows)


# --- page text -------------------------------------------------------------


# A character reference by number or name, other text, or a lone ampersand.
_REFERENCE = r"(&#[0-9]{1,7};?|&#[xX][0-9a-fA-F]{1,6};?|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&)"


def _from_code(code: Column) -> Column:
    """The character with this number, from its eight hexadecimal digits."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def unescape_html(c: Column) -> Column:
    """Character references as characters; unknown names stay as they are."""
    names = {k: v for k, v in html5.items() if k.endswith(";")}
    table = F.from_json(F.lit(json.dumps(names)), "map<string,string>")

    def one(token: Column) -> Column:
        digits = F.regexp_replace(token, "[&#xX;]", "")
        number = F.when(token.rlike("^&#[0-9]"), digits.cast("long")).when(token.rlike("^&#[xX]"), F.conv(digits, 16, 10).cast("long"))
        named = F.when(token.rlike("^&[A-Za-z].*;$"), F.coalesce(F.try_element_at(table, F.substr(token, F.lit(2))), token))
        return F.when((number > 0) & (number < 0x110000), _from_code(number)).otherwise(F.coalesce(named, token))

    return F.when(c.contains("&"), F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_REFERENCE), 1), one), "")).otherwise(c)


def strip_tags(c: Column) -> Column:
    text = unescape_html(F.regexp_replace(c, "<[^>]+>", ""))
    return F.trim(F.replace(text, F.lit(" "), F.lit(" ")))


def extract_all(pages: DataFrame, column: str, pattern: str, *, within: str | None = None, limit: int | None = None) -> DataFrame:
    """Every first group of ``pattern`` in document order, tags stripped: adds ``position`` and ``value``.

    ``within`` restricts the search to its first group where that matches.
    """
    body = F.col(column)
    if within:
        body = F.when(body.rlike(within), F.regexp_extract(body, within, 1)).otherwise(body)
    found = F.regexp_extract_all(body, F.lit(pattern), 1)
    if limit:
        found = F.slice(found, 1, limit)
    return pages.select(
        *[c for c in pages.columns if c != column], F.posexplode(found).alias("position", "_v")
    ).withColumn("value", strip_tags(F.col("_v"))).drop("_v")


# The format of the pages.
MANAGER_PATTERN = r"(?s)<strong>Manager</strong>:\s*(.*?)</div>"
SCOREBOX = r'(?s)<div class="scorebox">(.*?)<div class="scorebox_meta">'
MATCH_INFO = r"var match_info\s*=\s*JSON.parse\('([^']+)'\)"


def extract_managers(pages: DataFrame, column: str = "html") -> DataFrame:
    return extract_all(pages, column, MANAGER_PATTERN, within=SCOREBOX, limit=2)


_ESCAPE = r"(?s)((?:\\x[0-9a-fA-F]{2})+|(?:\\u[0-9a-fA-F]{4})+|\\.|[^\\]+|\\)"
_CONTROL = {"\\n": "\n", "\\t": "\t", "\\r": "\r", "\\b": "\b", "\\f": "\f"}


def unescape_string(c: Column) -> Column:
    """``\\xNN``, ``\\uNNNN`` (also as pairs) and backslash escapes as characters."""

    def one(token: Column) -> Column:
        pairs = F.decode(F.unhex(F.replace(token, F.lit("\\x"), F.lit("00"))), "UTF-16BE")
        units = F.decode(F.unhex(F.replace(token, F.lit("\\u"), F.lit(""))), "UTF-16BE")
        plain = F.coalesce(*[F.when(token == k, F.lit(v)) for k, v in _CONTROL.items()], F.substr(token, F.lit(2)))
        return (
            F.when(token.rlike(r"^\\x[0-9a-fA-F]{2}"), pairs)
            .when(token.rlike(r"^\\u[0-9a-fA-F]{4}"), units)
            .when((F.length(token) == 2) & token.startswith("\\"), plain)
            .otherwise(token)
        )

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_ESCAPE), 1), one), "")


def extract_match_info(pages: DataFrame, column: str = "html") -> DataFrame:
    """Shot counts from the JSON text embedded in a match page, a string with backslash escapes."""
    text = unescape_string(F.regexp_extract(column, MATCH_INFO, 1))
    info = F.from_json(text, "h_shot string, a_shot string, h_shotOnTarget string, a_shotOnTarget string")
    return pages.withColumn("_i", info).select(
        *[c for c in pages.columns if c != column],
        *[F.col(f"_i.{src}").try_cast("int").alias(to) for src, to in
          (("h_shot", "hs"), ("a_shot", "as_"), ("h_shotOnTarget", "hst"), ("a_shotOnTarget", "ast"))],
    )


# --- refresh ---------------------------------------------------------------


def merge_new_results(base: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("match_date", "home", "away")) -> DataFrame:
    """Base rows plus completed incoming rows whose key is new, their result derived from the goals."""
    done = incoming.where("hg IS NOT NULL AND ag IS NOT NULL")
    new = dedupe_keep(done, list(keys), ["hg", "ag"]).join(base.select(*keys), list(keys), "left_anti")
    return base.unionByName(
        new.withColumn("result", C.result_from_goals(F.col("hg"), F.col("ag"))), allowMissingColumns=True
    )


def backfill_nulls(base: DataFrame, incoming: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows with any null among ``columns`` take all of them from a complete incoming row; adds ``still_missing``."""
    src = incoming.select(*keys, *[F.col(c).alias("_n_" + c) for c in columns]).dropna()
    gap = F.lit(False)
    for c in columns:
        gap = gap | F.col(c).isNull()
    out = join_one_to_one(base.withColumn("_gap", gap), src.withColumn("_have", F.lit(1)), keys)
    fill = F.col("_gap") & F.col("_have").isNotNull()
    return (
        out.withColumns({c: F.when(fill, F.col("_n_" + c)).otherwise(F.col(c)) for c in columns})
        .withColumn("still_missing", (F.col("_gap") & ~fill).cast("int"))
        .drop("_gap", "_have", *["_n_" + c for c in columns])
    )
