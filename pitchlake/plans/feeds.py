"""Queries on an event feed, on backtests and on boosted forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, feed, models, temporal
from . import adapters as ad
from .forecasts import cases
from .growth import Z_SQL, height_reference
from ..operators import cohorts

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def flat(spark, sf_dir):
    """The events as a feed: days are matches, users of odd and even id the two teams."""
    e, k = ad.table(spark, sf_dir, "events"), F.col("event_id")
    shot = F.col("event_type") == "purchase"
    return e.select(
        F.dayofmonth("ts").alias("match_id"), k.alias("event_id"), F.when(shot, "Shot").when(F.col("event_type") == "view", "Pass").when(F.col("event_type") == "click", "Dribble").otherwise("Duel").alias("type"),
        (1 + (k % 10 >= 5).cast("int")).alias("period"), (k % 95).cast("int").alias("minute"), (F.col("user_id") % 2).alias("team_id"), F.col("user_id").alias("player_id"), ((F.col("user_id") + k) % 2).alias("possession_team_id"), (k % 7).cast("double").alias("duration"),
        F.when(shot & (F.col("value") > 30), "Goal").when(F.col("value") < 5, "Incomplete").alias("outcome"), F.when(shot & (k % 20 == 0), "Penalty").when(k % 9 == 0, "Throw-in").alias("kind"),
        F.when(shot, (k % 100) / 100.0).alias("xg"), F.when(shot, k - 1).alias("key_pass_id"), (k % 50 == 0).alias("goal_assist"),
    )


FEED_SQL = """feed AS (SELECT CAST(dayofmonth(ts) AS INTEGER) AS match_id, event_id, CASE event_type WHEN 'purchase' THEN 'Shot' WHEN 'view' THEN 'Pass' WHEN 'click' THEN 'Dribble' ELSE 'Duel' END AS type, CASE WHEN event_id % 10 >= 5 THEN 2 ELSE 1 END AS period, event_id % 95 AS minute,
    user_id % 2 AS team_id, user_id AS player_id, (user_id + event_id) % 2 AS possession_team_id, event_id % 7 AS duration, CASE WHEN event_type = 'purchase' AND value > 30 THEN 'Goal' WHEN value < 5 THEN 'Incomplete' END AS outcome,
    CASE WHEN event_type = 'purchase' AND event_id % 20 = 0 THEN 'Penalty' WHEN event_id % 9 = 0 THEN 'Throw-in' END AS kind, CASE WHEN event_type = 'purchase' THEN (event_id % 100) / 100.0 END AS xg, CASE WHEN event_type = 'purchase' THEN event_id - 1 END AS key_pass_id, event_id % 50 = 0 AS goal_assist FROM events)"""


@query(f"""WITH {FEED_SQL}, x AS (SELECT f.*, s.xg AS xa FROM feed f LEFT JOIN feed s ON s.key_pass_id = f.event_id AND s.match_id = f.match_id)
SELECT match_id, team_id, player_id, count(*) FILTER (type = 'Shot') AS shots, count(*) FILTER (type = 'Shot' AND outcome = 'Goal') AS goals, round(coalesce(sum(xg) FILTER (type = 'Shot'), 0), 4)::DOUBLE AS xg, round(coalesce(sum(xg) FILTER (type = 'Shot' AND coalesce(kind, '') <> 'Penalty'), 0), 4)::DOUBLE AS npxg,
    round(coalesce(sum(xa) FILTER (type = 'Pass' AND coalesce(kind, '') <> 'Throw-in'), 0), 4)::DOUBLE AS xa, count(*) FILTER (type = 'Pass' AND coalesce(kind, '') <> 'Throw-in') AS passes, count(*) FILTER (type = 'Pass' AND coalesce(kind, '') <> 'Throw-in' AND outcome IS NULL) AS passes_completed, count(*) FILTER (goal_assist) AS assists,
    count(*) FILTER (type = 'Dribble') AS take_ons, 0::BIGINT AS take_ons_won, count(*) FILTER (type = 'Duel') AS duels, 0::BIGINT AS duels_won FROM x GROUP BY ALL""")
def a4_player_lines(spark, sf_dir):
    return feed.player_lines(flat(spark, sf_dir))


@query(f"""WITH {FEED_SQL}, o AS (SELECT match_id, team_id, count(*) FILTER (type = 'Shot' AND outcome = 'Goal') AS goals, count(*) FILTER (type = 'Shot' AND outcome = 'Goal' AND period = 1) AS goals_first_half, count(*) FILTER (type = 'Shot' AND outcome = 'Goal' AND minute >= 75) AS goals_late, count(*) FILTER (type = 'Shot') AS shots, round(coalesce(sum(xg), 0), 4)::DOUBLE AS xg FROM feed GROUP BY ALL),
h AS (SELECT match_id, possession_team_id AS team_id, sum(duration)::DOUBLE AS possession_s FROM feed GROUP BY ALL)
SELECT o.match_id, o.team_id, o.goals, o.goals_first_half, o.goals_late, o.shots, o.xg, h.possession_s, b.goals AS goals_against, b.xg AS xg_against, CASE WHEN o.goals > b.goals THEN 3 WHEN o.goals = b.goals THEN 1 ELSE 0 END AS points, b.goals = 0 AS clean_sheet
FROM o JOIN o b ON o.match_id = b.match_id AND o.team_id <> b.team_id LEFT JOIN h ON h.match_id = o.match_id AND h.team_id = o.team_id""")
def a6_team_lines(spark, sf_dir):
    return feed.team_lines(flat(spark, sf_dir))


@query(f"""WITH {FEED_SQL} SELECT player_id, team_id, count(*) FILTER (type = 'Shot') AS shots, count(*) FILTER (type = 'Shot' AND outcome = 'Goal') AS goals, round(coalesce(sum(xg), 0), 2)::DOUBLE AS xg, count(DISTINCT match_id) AS matches FROM feed GROUP BY ALL""")
def a7_season_totals(spark, sf_dir):
    l = feed.player_lines(flat(spark, sf_dir))
    return l.groupBy("player_id", "team_id").agg(F.sum("shots").alias("shots"), F.sum("goals").alias("goals"), F.round(F.sum("xg"), 2).alias("xg"), F.countDistinct("match_id").alias("matches"))


def detailed(spark, sf_dir):
    """The feed with duels of all kinds, fouls and cards, set pieces and own goals."""
    k, t = F.col("event_id"), F.col("type")
    e = flat(spark, sf_dir).withColumn("type", F.when(t == "Duel", F.element_at(F.array(*[F.lit(x) for x in ("Foul Committed", "Clearance", "Interception", "Own Goal Against", "Duel", "Duel", "Duel")]), (k % 7 + 1).cast("int"))).otherwise(t))
    return e.withColumns({
        "outcome": F.when((t == "Duel") & (k % 3 == 0), "Won").when((t == "Dribble") & (k % 2 == 0), "Complete").when((t == "Shot") & F.col("outcome").isNull(), "Saved").otherwise(F.col("outcome")),
        "kind": F.when(t == "Duel", F.when(k % 2 == 0, "Tackle").otherwise("Aerial Lost")).otherwise(F.col("kind")),
        "card": F.when(t == "Foul Committed", F.when(k % 3 == 0, "Yellow Card").when(k % 3 == 1, "Red Card")),
        "aerial_won": (t == "Pass") & (k % 11 == 0), "shot_assist": (t == "Pass") & (k % 8 == 0), "play_pattern": F.when(k % 6 == 0, "From Corner").when(k % 6 == 1, "From Free Kick").otherwise("Regular Play"),
    })


DETAIL_SQL = FEED_SQL + """, typed AS (SELECT * EXCLUDE (type), CASE WHEN type = 'Duel' THEN ['Foul Committed', 'Clearance', 'Interception', 'Own Goal Against', 'Duel', 'Duel', 'Duel'][event_id % 7 + 1] ELSE type END AS type FROM feed),
detailed AS (SELECT * REPLACE (CASE WHEN type = 'Duel' AND event_id % 3 = 0 THEN 'Won' WHEN type = 'Dribble' AND event_id % 2 = 0 THEN 'Complete' WHEN type = 'Shot' AND outcome IS NULL THEN 'Saved' ELSE outcome END AS outcome, CASE WHEN type <> 'Duel' THEN kind WHEN event_id % 2 = 0 THEN 'Tackle' ELSE 'Aerial Lost' END AS kind),
    CASE WHEN type = 'Foul Committed' AND event_id % 3 = 0 THEN 'Yellow Card' WHEN type = 'Foul Committed' AND event_id % 3 = 1 THEN 'Red Card' END AS card, type = 'Pass' AND event_id % 11 = 0 AS aerial_won, type = 'Pass' AND event_id % 8 = 0 AS shot_assist, CASE event_id % 6 WHEN 0 THEN 'From Corner' WHEN 1 THEN 'From Free Kick' ELSE 'Regular Play' END AS play_pattern FROM typed)"""


def lineups(spark, sf_dir):
    """(lineups, last events): each player's spells, in one row a match, team and player."""
    e = flat(spark, sf_dir)
    p = F.col("player_id")
    minute = lambda m: F.concat(F.lpad(m.cast("string"), 2, "0"), F.lit(":30"))
    first = F.struct(F.element_at(F.array(*[F.lit(x) for x in ("Keeper", "Back", "Wing", "Striker")]), (p % 4 + 1).cast("int")).alias("position"), minute(p % 40).alias("from"), F.when(p % 3 > 0, minute(p % 40 + 20)).alias("to"), F.lit(1).alias("from_period"), F.when(p % 2 == 0, "Starting XI").otherwise("Substitution").alias("start_reason"))
    second = F.struct(F.lit("Striker").alias("position"), F.lit("70:00").alias("from"), F.lit("75:15").alias("to"), F.when(p % 5 == 0, 5).otherwise(2).alias("from_period"), F.lit("Tactical Shift").alias("start_reason"))
    rows = e.groupBy("match_id", "team_id", "player_id").agg(F.count("*").alias("n"))
    rows = rows.select("match_id", "team_id", F.array(F.struct("player_id", F.array(first, second).alias("positions"))).alias("lineup"))
    return rows, e.groupBy("match_id").agg(F.max(F.col("minute") * 60.0).alias("end_s"))


SPELL_SQL = """ends AS (SELECT match_id, max(minute) * 60 AS end_s FROM feed GROUP BY ALL), who AS (SELECT DISTINCT match_id, team_id, player_id FROM feed),
spells AS (SELECT match_id, team_id, player_id, ['Keeper', 'Back', 'Wing', 'Striker'][player_id % 4 + 1] AS position, greatest(0, CASE WHEN player_id % 3 > 0 THEN 1200 ELSE end_s - (player_id % 40 * 60 + 30) END) AS seconds, player_id % 2 = 0 AS starting FROM who JOIN ends USING (match_id)
    UNION ALL SELECT match_id, team_id, player_id, 'Striker', 315, FALSE FROM who WHERE player_id % 5 <> 0),
places AS (SELECT match_id, team_id, player_id, position, sum(seconds) AS seconds, bool_or(starting) AS starting FROM spells GROUP BY ALL),
played AS (SELECT match_id, team_id, player_id, arg_max(position, (seconds, position)) AS position, CAST(round_even(sum(seconds) / 60.0, 0) AS INTEGER) AS minutes, bool_or(starting) AS started FROM places GROUP BY ALL HAVING sum(seconds) > 0)"""


@query(f"WITH {FEED_SQL}, {SPELL_SQL} SELECT * FROM played")
def a5_minutes_played(spark, sf_dir):
    return feed.minutes_played(*lineups(spark, sf_dir))


@query(f"WITH {FEED_SQL}, {SPELL_SQL} SELECT player_id, position, sum(seconds)::DOUBLE AS seconds FROM spells GROUP BY ALL")
def a7_position_seconds(spark, sf_dir):
    return feed.position_seconds(*lineups(spark, sf_dir))


@query(f"""WITH {DETAIL_SQL}, {SPELL_SQL},
x AS (SELECT f.*, s.xg AS xa, type = 'Pass' AND coalesce(f.kind, '') <> 'Throw-in' AS passed FROM detailed f LEFT JOIN (SELECT match_id, key_pass_id AS event_id, max(xg) AS xg FROM feed WHERE key_pass_id IS NOT NULL GROUP BY ALL) s USING (match_id, event_id)),
d AS (SELECT match_id, player_id, count(*) FILTER (type = 'Shot') AS shots, count(*) FILTER (type = 'Shot' AND outcome = 'Goal') AS goals, round(coalesce(sum(xg) FILTER (type = 'Shot'), 0), 4)::DOUBLE AS xg, round(coalesce(sum(xg) FILTER (type = 'Shot' AND coalesce(kind, '') <> 'Penalty'), 0), 4)::DOUBLE AS npxg,
    round(coalesce(sum(xa) FILTER (passed), 0), 4)::DOUBLE AS xa, count(*) FILTER (passed) AS passes, count(*) FILTER (passed AND outcome IS NULL) AS passes_completed, count(*) FILTER (goal_assist) AS assists, count(*) FILTER (passed AND (goal_assist OR shot_assist)) AS key_passes,
    count(*) FILTER (type = 'Shot' AND outcome IN ('Goal', 'Saved')) AS shots_on_target, count(*) FILTER (type = 'Shot' AND outcome = 'Goal' AND kind = 'Penalty') AS penalty_goals, count(*) FILTER (type = 'Duel' AND kind = 'Tackle') AS tackles, count(*) FILTER (type = 'Duel' AND kind = 'Tackle' AND outcome = 'Won') AS tackles_won,
    count(*) FILTER (type = 'Duel' AND kind = 'Aerial Lost') AS aerials_lost, count(*) FILTER (aerial_won) AS aerials_won, count(*) FILTER (type = 'Dribble') AS dribbles, count(*) FILTER (type = 'Dribble' AND outcome = 'Complete') AS dribbles_completed, count(*) FILTER (type = 'Interception') AS interceptions, count(*) FILTER (type = 'Clearance') AS clearances,
    count(*) FILTER (card = 'Yellow Card') AS yellow_cards, count(*) FILTER (card = 'Red Card') AS red_cards FROM x GROUP BY ALL)
SELECT d.*, team_id, 1 AS appearances, started::INTEGER AS starts, minutes AS minutes_played, aerials_won + aerials_lost AS aerials, tackles + aerials_won + aerials_lost + dribbles AS duels, tackles_won + aerials_won + dribbles_completed AS duels_won FROM played JOIN d USING (match_id, player_id)""")
def a4_match_lines(spark, sf_dir):
    return feed.match_lines(detailed(spark, sf_dir), feed.minutes_played(*lineups(spark, sf_dir)))


def match_results(spark, sf_dir):
    """Each day's two sides, with a published score of their shots' and own goals."""
    e = detailed(spark, sf_dir)
    scored = F.when(F.col("type") == "Own Goal Against", 1 - F.col("team_id")).when((F.col("type") == "Shot") & (F.col("outcome") == "Goal"), F.col("team_id"))
    homes = e.groupBy("match_id").agg(F.count(F.when(scored == 0, 1)).alias("home_score"), F.count(F.when(scored == 1, 1)).alias("away_score")).select("match_id", F.lit(0).cast("long").alias("home"), F.lit(1).cast("long").alias("away"), "home_score", "away_score")
    return feed.match_results(e, homes)


RESULT_SQL = DETAIL_SQL + """, g AS (SELECT *, CASE WHEN type = 'Own Goal Against' THEN 1 - team_id WHEN type = 'Shot' AND outcome = 'Goal' THEN team_id END AS scorer, type = 'Shot' AND outcome = 'Goal' AND (coalesce(kind, '') IN ('Penalty', 'Free Kick', 'Corner') OR play_pattern IN ('From Corner', 'From Free Kick')) AS piece FROM detailed),
sides AS (SELECT DISTINCT match_id, t AS team_id, 1 - t AS other, t = 0 AS at_home FROM g, (SELECT unnest([0, 1])::BIGINT AS t)),
r AS (SELECT s.match_id, s.team_id, s.other, s.at_home, count(*) FILTER (scorer = s.team_id) AS goals_for, count(*) FILTER (scorer = s.other) AS goals_against, count(*) FILTER (scorer = s.team_id AND period = 1) AS goals_for_first_half, count(*) FILTER (scorer = s.other AND period = 1) AS goals_against_first_half, count(*) FILTER (scorer = s.other AND period = 2 AND minute >= 75) AS goals_against_last_15,
    count(*) FILTER (scorer = s.team_id AND piece) AS set_piece_goals_for, count(*) FILTER (scorer = s.other AND piece) AS set_piece_goals_against, count(*) FILTER (type = 'Shot' AND g.team_id = s.team_id) AS shots_for, count(*) FILTER (type = 'Shot' AND g.team_id = s.other) AS shots_against,
    coalesce(sum(xg) FILTER (g.team_id = s.team_id), 0)::DOUBLE AS xg_for, coalesce(sum(xg) FILTER (g.team_id = s.other), 0)::DOUBLE AS xg_against, coalesce(sum(duration) FILTER (possession_team_id = s.team_id), 0)::DOUBLE AS possession_s, coalesce(sum(duration) FILTER (possession_team_id = s.other), 0)::DOUBLE AS possession_against_s FROM sides s JOIN g USING (match_id) GROUP BY ALL),
p AS (SELECT *, CASE WHEN goals_for > goals_against THEN 3 WHEN goals_for = goals_against THEN 1 ELSE 0 END AS points FROM r),
lines AS (SELECT *, (points = 3)::INTEGER AS wins, (points = 1)::INTEGER AS draws, (points = 0)::INTEGER AS losses, CASE WHEN at_home THEN points ELSE 0 END AS home_points, CASE WHEN at_home THEN 0 ELSE points END AS away_points, (goals_against = 0)::INTEGER AS clean_sheets FROM p)"""


@query(f"WITH {RESULT_SQL} SELECT * REPLACE (round(xg_for, 4) AS xg_for, round(xg_against, 4) AS xg_against) FROM lines")
def a6_match_results(spark, sf_dir):
    return match_results(spark, sf_dir).withColumns({c: F.round(c, 4) for c in ("xg_for", "xg_against")})


TOTALS = ("goals_for", "goals_against", "goals_for_first_half", "goals_against_first_half", "goals_against_last_15", "set_piece_goals_for", "set_piece_goals_against", "shots_for", "shots_against", "points", "wins", "draws", "losses", "home_points", "away_points", "clean_sheets")


@query(f"""WITH {RESULT_SQL} SELECT team_id, count(*) AS matches, {', '.join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in TOTALS)}, round(sum(xg_for), 2) AS xg_for, round(sum(xg_against), 2) AS xg_against, round(sum(possession_s) / sum(possession_s + possession_against_s) * 100, 1) AS possession_pct FROM lines GROUP BY ALL""")
def a7_team_totals(spark, sf_dir):
    return feed.team_totals(match_results(spark, sf_dir))


@query()
def m1d_tree_forecast(spark, sf_dir):
    """Errors of a boosted forecast learnt from the cases known by the last origin."""
    c = cases(spark, sf_dir)
    c = c.withColumn("age", F.datediff("last_date", "date_of_birth") / 365.25).withColumn("gap", F.datediff("target_date", "last_date").cast("double")).withColumn("male", (F.col("sex") == "M").cast("double"))
    cut_at = c.agg(F.max("origin")).first()[0]
    known, new = c.where(F.col("target_date") <= F.lit(cut_at)), c.where(F.col("origin") == F.lit(cut_at))
    scored = models.tree_forecast(known, new, ["male", "age", "gap", "last"], "last", "target")
    return evaluation.errors(scored, "target", "guess", ["sex"]).select("sex", "n", "missing", *[F.round(x, 4).alias(x) for x in ("mae", "rmse", "bias")])
