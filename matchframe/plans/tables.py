"""The driver tables seen as two-sided events, in SQL that both engines read.

Orders are matches: a block of 100 customers is a league of 20 teams, so that
leagues and teams grow in number with the data.  Line items are appearances and
absences, user events are extra fixtures.  ``CTES`` holds the projections; the
Spark side runs the same text through ``selectExpr``-style SQL over the files.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchframe.operators.longform import to_long
from matchframe.operators.tactics import TACTICAL_MEASURES

_TP = "CAST(floor(o_totalprice) AS BIGINT)"

# name -> SQL; "@x" refers to another entry, plain names to driver tables.
CTES: dict[str, str] = {}

CTES["raw_matches"] = f"""
SELECT o_orderkey AS match_id,
  CAST(floor(o_custkey / 100) AS BIGINT) AS pool,
  CAST(year(o_orderdate) AS BIGINT) AS season,
  CAST(o_orderdate AS DATE) AS match_date,
  CAST(floor(o_custkey / 100) * 20 + o_custkey % 20 AS BIGINT) AS home,
  CAST(floor(o_custkey / 100) * 20 + (o_custkey % 20 + 1 + o_orderkey % 19) % 20 AS BIGINT) AS away,
  {_TP} % 5 AS hg,
  CAST(floor(o_totalprice / 7) AS BIGINT) % 4 AS ag,
  CAST({_TP} % 300 AS DOUBLE) / 100 AS hxg,
  CAST(CAST(floor(o_totalprice / 3) AS BIGINT) % 250 AS DOUBLE) / 100 AS axg,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 5 + CAST(floor(o_totalprice / 11) AS BIGINT) % 16 END AS hs,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 13) AS BIGINT) % 6 END AS hst,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 4 + CAST(floor(o_totalprice / 17) AS BIGINT) % 14 END AS as_,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 19) AS BIGINT) % 5 END AS ast
FROM orders"""
CTES["matches"] = (
    "SELECT *, CASE WHEN hg > ag THEN 'H' WHEN hg < ag THEN 'A' ELSE 'D' END AS result FROM @raw_matches"
)
CTES["t"] = """
SELECT match_id, pool, season, match_date, result, 1 AS is_home, home AS team, away AS opponent,
  hg AS gf, ag AS ga, hxg AS xgf, axg AS xga, hs AS sf, as_ AS sa, hst AS sotf, ast AS sota,
  CASE WHEN hg > ag THEN 3 WHEN hg = ag THEN 1 ELSE 0 END AS points,
  CASE WHEN hg = ag THEN 1 ELSE 0 END AS is_draw FROM @matches
UNION ALL
SELECT match_id, pool, season, match_date, result, 0, away, home, ag, hg, axg, hxg, as_, hs, ast, hst,
  CASE WHEN ag > hg THEN 3 WHEN hg = ag THEN 1 ELSE 0 END,
  CASE WHEN hg = ag THEN 1 ELSE 0 END FROM @matches"""
# Cup ties of the same teams, one per line item.
CTES["extra"] = """
SELECT CAST(l_shipdate AS DATE) AS match_date,
  CAST(floor(floor(l_orderkey / 10) / 100) * 20 + CAST(floor(l_orderkey / 10) AS BIGINT) % 20 AS BIGINT) AS team
FROM lineitem"""
# Results outside the league, with a competition name.
CTES["nonleague"] = """
SELECT CAST(l_shipdate AS DATE) AS match_date,
  CAST(floor(floor(l_orderkey / 10) / 100) * 20 + CAST(floor(l_orderkey / 10) AS BIGINT) % 20 AS BIGINT) AS team,
  (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS row_id, l_partkey AS part_id, l_suppkey AS supp_id,
  CASE WHEN l_quantity < 25 THEN 'Reserve League' ELSE CASE l_linenumber % 5 WHEN 0 THEN 'Friendly' WHEN 1 THEN 'Championship' WHEN 2 THEN 'Champions League'
    WHEN 3 THEN 'Domestic Cup' ELSE 'Regional Shield' END END AS competition,
  CAST(CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS DOUBLE) AS points,
  CAST(l_suppkey % 4 AS DOUBLE) AS goals_for, l_quantity AS shots_for
FROM lineitem"""
# Absences: one per line item.
CTES["absences"] = """
SELECT l_orderkey * 10 + l_linenumber AS row_id,
  CAST(floor(floor(l_orderkey / 10) / 100) * 20 + CAST(floor(l_orderkey / 10) AS BIGINT) % 20 AS BIGINT) AS team,
  CAST(l_partkey % 30 AS BIGINT) AS player,
  CAST(l_shipdate AS DATE) - CAST(l_linenumber % 3 AS INT) AS report_date,
  CAST(l_shipdate AS DATE) AS unavailable_from,
  CASE WHEN l_quantity < 3 THEN NULL ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) END AS expected_return_date,
  CASE WHEN l_returnflag = 'R' THEN 'suspension' ELSE 'injury' END AS status_type,
  CAST(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS is_expected_starter,
  CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS DOUBLE) AS is_suspended,
  l_quantity * 30 AS minutes, floor(l_quantity / 5) AS goals, round(l_discount * 10, 2) AS xg,
  round(l_tax * 10, 2) AS xa, l_quantity AS defensive, floor(l_extendedprice) * 100 AS market_value
FROM lineitem"""
# Line-ups: the items of an order, odd line numbers for the home side.
CTES["appearances"] = """
SELECT m.match_id, m.season, m.match_date, a.is_home, CASE WHEN a.is_home = 1 THEN m.home ELSE m.away END AS team,
  a.player, a.position_group, a.started, a.minutes
FROM (
  SELECT l_orderkey, CAST(l_linenumber % 2 AS INT) AS is_home, CAST(l_partkey % 15 AS BIGINT) AS player,
    max(CASE CAST(l_partkey % 15 % 4 AS INT) WHEN 0 THEN 'goalkeeper' WHEN 1 THEN 'defender'
      WHEN 2 THEN 'midfielder' ELSE 'attacker' END) AS position_group,
    max(CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END) AS started, max(floor(l_quantity * 1.8)) AS minutes
  FROM lineitem GROUP BY l_orderkey, CAST(l_linenumber % 2 AS INT), CAST(l_partkey % 15 AS BIGINT)
) AS a JOIN @matches AS m ON m.match_id = a.l_orderkey"""
# SQL for the last season that has started.
LATEST = "(SELECT max(season) FROM @matches)"
# A probability triple, and decimal odds around a second triple.
_W = {
    "wh": f"(5 + {_TP} % 41)", "wd": "(5 + CAST(floor(o_totalprice / 29) AS BIGINT) % 23)",
    "wa": "(5 + CAST(floor(o_totalprice / 37) AS BIGINT) % 31)",
}
CTES["probs"] = f"""
SELECT m.*, CAST(wh AS DOUBLE) / (wh + wd + wa) AS p_home, CAST(wd AS DOUBLE) / (wh + wd + wa) AS p_draw,
  CAST(wa AS DOUBLE) / (wh + wd + wa) AS p_away,
  round(1.0 + CAST(match_id % 37 AS DOUBLE) / 10 + CAST(wa AS DOUBLE) / 20, 2) AS odds_h,
  round(2.1 + CAST(match_id % 23 AS DOUBLE) / 10, 2) AS odds_d,
  round(1.0 + CAST(match_id % 41 AS DOUBLE) / 10 + CAST(wh AS DOUBLE) / 20, 2) AS odds_a,
  CASE result WHEN 'H' THEN 0 WHEN 'D' THEN 1 ELSE 2 END AS target
FROM (SELECT o_orderkey, {", ".join(f"{v} AS {k}" for k, v in _W.items())} FROM orders) AS w
JOIN @matches AS m ON m.match_id = w.o_orderkey"""
# The coach in charge of a side, changing in irregular blocks of days.
CTES["coached"] = """
SELECT *, concat('M', CAST(team AS STRING), '-', CAST(CAST(floor((datediff_days + team * 37) / 170) AS BIGINT) % 4 AS STRING)) AS manager
FROM (SELECT t.*, {days} AS datediff_days FROM @t AS t) AS x"""
# Every tactical measure of a team's match, from its numbers, with gaps in some of them.
CTES["tactics"] = "SELECT match_id, team, is_home, season, match_date, points, opponent, xgf, xga, " + ", ".join(
    (f"CASE WHEN match_id % {7 + i} = 0 THEN NULL ELSE " if i % 4 == 0 else "CASE WHEN false THEN NULL ELSE ")
    + f"{3 + 2 * i} + (match_id * {31 + 6 * i} + team * {17 + 4 * i}) % {15 + 3 * i} END * 1.0 AS {m}"
    for i, m in enumerate(TACTICAL_MEASURES)
) + " FROM @t"

# --- text inputs for the cleaning functions and readers ---
CTES["names"] = """
SELECT c_custkey AS k, c_mktsegment AS segment, c_acctbal AS balance,
  CASE c_custkey % 8 WHEN 0 THEN 'Manchester City' WHEN 1 THEN 'Nottingham Forest' WHEN 2 THEN 'Wolverhampton Wanderers'
    WHEN 3 THEN 'Brighton & Hove Albion' WHEN 4 THEN concat(c_mktsegment, ' FC')
    WHEN 5 THEN concat('Nott', chr(39), 'ham Forest') WHEN 6 THEN concat(' ', c_name, ' ') ELSE c_name END AS name
FROM customer"""
_D2 = "lpad(CAST(day({d}) AS STRING), 2, '0')"
_M2 = "lpad(CAST(month({d}) AS STRING), 2, '0')"


def date_text(d: str, order: str) -> str:
    """SQL for the ``iso``, ``slash``, ``dash`` or ``short`` spelling of a date."""
    day, month, year = _D2.format(d=d), _M2.format(d=d), f"CAST(year({d}) AS STRING)"
    if order == "iso":
        return f"concat({year}, '-', {month}, '-', {day})"
    if order == "short":
        return f"concat(CAST(day({d}) AS STRING), '/', CAST(month({d}) AS STRING), '/', {year})"
    sep = "/" if order == "slash" else "-"
    return f"concat({day}, '{sep}', {month}, '{sep}', {year})"


CTES["date_texts"] = f"""
SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CASE CAST(o_orderkey % 6 AS INT)
  WHEN 0 THEN {date_text("o_orderdate", "iso")} WHEN 1 THEN {date_text("o_orderdate", "slash")}
  WHEN 2 THEN {date_text("o_orderdate", "dash")} WHEN 3 THEN concat({date_text("o_orderdate", "iso")}, ' 15:30:00')
  WHEN 4 THEN {date_text("o_orderdate", "short")} ELSE 'to be confirmed' END AS txt FROM orders"""
# A result file: every column is text, some dates and goals are unreadable.
CTES["result_text"] = f"""
SELECT match_id AS rid, pool, CAST(season AS STRING) AS season_text,
  CASE WHEN match_id % 31 = 0 THEN 'postponed' WHEN match_id % 3 = 0 THEN {date_text("match_date", "iso")}
    ELSE {date_text("match_date", "slash")} END AS "Date",
  concat('Team ', CAST(home AS STRING)) AS "HomeTeam", concat('Team ', CAST(away AS STRING)) AS "AwayTeam",
  CASE WHEN match_id % 29 = 0 THEN 'x' ELSE CAST(hg AS STRING) END AS "FTHG", CAST(ag AS STRING) AS "FTAG",
  result AS "FTR", CAST(hs AS STRING) AS "HS", CAST(as_ AS STRING) AS "AS", CAST(hst AS STRING) AS "HST",
  CAST(ast AS STRING) AS "AST", CASE WHEN match_id % 5 = 0 THEN '' ELSE CAST(hxg AS STRING) END AS "HxG",
  CAST(axg AS STRING) AS "AxG" FROM @matches"""

_DAYS = {
    "spark": "datediff(match_date, DATE '1992-01-01')",
    "duck": "date_diff('day', DATE '1992-01-01', match_date)",
}
_COACHED = CTES["coached"]
CTES["coached"] = _COACHED.replace("{days}", _DAYS["duck"])

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


class Tables:
    """Lazily planned views of one data directory; nothing here runs a job."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, **given: DataFrame) -> DataFrame:
        """Run shared SQL: ``@x`` is an entry of ``CTES`` or of ``given``, other names are driver tables or of ``given``."""
        text = text.replace(_DAYS["duck"], _DAYS["spark"])
        text = text.replace("{", "{{").replace("}", "}}")
        text = re.sub(r' AS "(\w+)"', r" AS `\1`", text)
        views: dict[str, DataFrame] = {}
        for name in sorted(CTES, key=len, reverse=True):
            if f"@{name}" in text:
                text = text.replace(f"@{name}", "{" + "cte_" + name + "}")
                views["cte_" + name] = given.get(name, self.view(name))
        for name in DRIVER_TABLES:
            for word in (f"FROM {name}", f"JOIN {name}"):
                if word in text:
                    text = text.replace(word, word.split()[0] + " {" + name + "}")
                    views[name] = given.get(name, self.table(name))
        return self.spark.sql(text, **views)

    def view(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = to_long(self.matches) if name == "t" else self.sql(CTES[name])
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in CTES:
            return self.view(name)
        if name in DRIVER_TABLES:
            return self.table(name)
        raise AttributeError(name)

    @cached_property
    def measures(self) -> DataFrame:
        """``tactics`` with doubles from the start: the same whole numbers, without a step through decimals of 23 digits."""
        return self.sql(CTES["tactics"].replace(" END * 1.0 AS ", " END * 1D AS "))

    @cached_property
    def latest(self) -> int:
        """The last season that has started; runs a job of one row."""
        return self.matches.agg(F.max("season")).first()[0]

    @cached_property
    def long(self) -> DataFrame:
        return self.view("t")
