"""Schemas of the domain's tables."""

from __future__ import annotations

SCHEMAS = {
    "players": "id string, full_name string, known_as string, date_of_birth date, sex string, nationality array<string>, is_egypt_eligible boolean, primary_sport string, tier string, position string, is_minor boolean, external_ids map<string,string>, status string, merged_into string",
    "measurements": "id string, player_id string, measured_at date, metric string, value decimal(10,3), unit string, source string, confidence string, created_at timestamp",
    "performance_entries": "id string, player_id string, sport string, period_type string, period_start date, period_end date, event string, organization_id string, opponent_org_id string, opponent_player_id string, metrics map<string,double>, schema_ref string, source string, is_validated boolean",
    "organizations": "id string, name string, type string, sport string, country string, region string, parent_org_id string",
    "affiliations": "player_id string, organization_id string, role string, start_date date, end_date date, shirt_number int",
}

#: Provider event trees: what is read of lineups, and of events.
LINEUP = "team_id long, lineup array<struct<player_id:long,player_name:string,positions array<struct<position:string,`from`:string,`to`:string,from_period:int,start_reason:string>>>>".replace("positions array", "positions:array")
EVENT = "id string, type struct<name:string>, period int, minute int, second int, team struct<id:long>, player struct<id:long>, possession_team struct<id:long>, duration double, location array<double>, pass struct<outcome:struct<name:string>,type:struct<name:string>,shot_assist:boolean,goal_assist:boolean,assisted_shot_id:string>, shot struct<outcome:struct<name:string>,type:struct<name:string>,xg:double,key_pass_id:string>, duel struct<type:struct<name:string>,outcome:struct<name:string>>, dribble struct<outcome:struct<name:string>>"
