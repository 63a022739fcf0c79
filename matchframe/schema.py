"""Explicit schemas of the input files."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"s": T.StringType(), "d": T.DateType(), "f": T.DoubleType(), "i": T.LongType()}


def schema_of(text: str) -> T.StructType:
    """``"team:s day:d value:f"`` -> StructType."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split(":") for x in text.split())])


ABSENCES = schema_of(
    "report_date:d team:s player:s unavailable_from:d expected_return_date:d status_type:s injury_or_suspension:s "
    "is_expected_starter:f is_key_player:f is_long_term_injury:f is_suspended:f minutes_played_last_365:f "
    "goals_last_365:f xg_contribution_last_365:f xa_contribution_last_365:f defensive_contribution_last_365:f "
    "market_value_eur:f source:s source_url:s source_collected_at:d"
)
SUSPENSIONS = schema_of(
    "team:s player:s suspended_from:d suspended_until:d matches_remaining:f reason:s expected_starter:f "
    "importance_score:f source:s last_updated:d"
)
SQUADS = schema_of(
    "season:s team:s squad_market_value_eur:f average_player_value_eur:f squad_size:f source:s source_url:s "
    "last_updated:d data_confidence:s previous_season_finish:f promoted_team_flag:f"
)
EXTRA_FIXTURES = schema_of("date:d team:s competition:s opponent:s")
MANAGERS = schema_of("team:s manager:s start_date:d end_date:d source:s source_collected_at:d")
LINEUPS = schema_of(
    "match_id:s season:s date:d team:s opponent:s is_home:f formation:s captain:s lineup_type:s source:s "
    "source_collected_at:d"
)
APPEARANCES = schema_of(
    "match_id:s season:s date:d team:s opponent:s player:s position:s position_group:s started:f is_substitute:f "
    "minutes:f sub_on_minute:f sub_off_minute:f lineup_type:s source:s source_collected_at:d"
)
FORMATIONS = schema_of("match_id:s season:s date:d team:s formation:s manager:s source:s source_collected_at:d")
SUBSTITUTIONS = schema_of(
    "match_id:s season:s date:d team:s player_off:s player_on:s minute:f source:s source_collected_at:d"
)
FIXTURES = schema_of(
    "season:s matchweek:i date:d kickoff_time_uk:s kickoff_time_dk:s home_team:s away_team:s source:s source_url:s "
    "fixture_status:s last_updated:s"
)

_SIDE = "struct<title:string>"
XG_FILE = (
    "dates array<struct<id:string,isResult:boolean,datetime:string,"
    f"h:{_SIDE},a:{_SIDE},goals:struct<h:string,a:string>,xG:struct<h:string,a:string>>>"
)
FIXTURE_API = (
    "struct<content:array<struct<kickoff:struct<millis:double>,gameweek:struct<gameweek:double>,"
    "teams:array<struct<team:struct<club:struct<name:string>>>>>>>"
)
ABSENCE_API = (
    "struct<response:array<struct<player:struct<name:string>,team:struct<name:string>,fixture:struct<date:string>,"
    "type:string,reason:string,description:string>>>"
)
_NAMED = "struct<name:string,developer_name:string>"
_PLAYER = "struct<display_name:string,common_name:string,name:string>"
_TEAM = "struct<name:string>"
_SIDELINE = (
    f"struct<category:string,start_date:string,end_date:string,player:{_PLAYER},team:{_TEAM},type:{_NAMED}>"
)
SIDELINED_ITEM = (
    f"struct<participant:{_TEAM},team:{_TEAM},player:{_PLAYER},type:{_NAMED},sideline:{_SIDELINE},"
    "category:string,start_date:string,end_date:string>"
)
AVAILABILITY_FILE = (
    "season string, club string, scrapedAt string, competitions array<struct<code:string,"
    "players:array<struct<name:string,matches:array<struct<round:string,status:string,detail:string>>>>>>"
)
