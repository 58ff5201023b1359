"""Match lines from an event feed: players, teams, minutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.match import clock_seconds

SHOOTOUT = 5  # the period that counts for nothing

# A provider's names of outcomes, restarts and cards.
ON_TARGET = ("Goal", "Saved", "Saved to Post")
TACKLE_WON = ("Won", "Success In Play", "Success Out")
SET_PIECE_SHOT = ("Penalty", "Free Kick", "Corner")
SET_PIECE_PATTERN = ("From Corner", "From Free Kick")
SENT_OFF = ("Second Yellow", "Red Card")


def nested(events: DataFrame, path: str) -> Column:
    """A nested field; null where the events' schema lacks it, as a match without cards does."""
    kind = events.schema
    for part in path.split("."):
        if part not in getattr(kind, "names", ()):
            return F.lit(None)
        kind = kind[part].dataType
    return F.col(path)


def flatten(events: DataFrame) -> DataFrame:
    """A provider's nested events as flat rows, without the shootout."""
    f = lambda path: nested(events, path)
    first = lambda *paths: F.coalesce(*[f(p) for p in paths]).cast("string")
    aerial = [f(f"{c}.aerial_won").cast("boolean") for c in ("pass", "shot", "clearance", "miscontrol")]
    return events.where(f"period <> {SHOOTOUT}").select(
        "match_id", F.col("id").alias("event_id"), F.col("type.name").alias("type"), "period", "minute", f("team.id").alias("team_id"), f("player.id").alias("player_id"),
        f("possession_team.id").alias("possession_team_id"), "duration", first("shot.outcome.name", "pass.outcome.name", "dribble.outcome.name", "duel.outcome.name").alias("outcome"),
        first("shot.type.name", "pass.type.name", "duel.type.name").alias("kind"), f("shot.xg").cast("double").alias("xg"), first("shot.key_pass_id").alias("key_pass_id"),
        f("pass.goal_assist").cast("boolean").alias("goal_assist"), f("pass.shot_assist").cast("boolean").alias("shot_assist"), first("foul_committed.card.name", "bad_behaviour.card.name").alias("card"),
        F.coalesce(*aerial, F.lit(False)).alias("aerial_won"), first("play_pattern.name").alias("play_pattern"),
    )


def with_assists(events: DataFrame) -> DataFrame:
    """Flat events with ``xa``: the xG of the shot that a pass set up."""
    made = events.where("key_pass_id is not null").groupBy("match_id", F.col("key_pass_id").alias("event_id")).agg(F.max("xg").alias("xa"))
    return events.join(made, ["match_id", "event_id"], "left")


def player_lines(events: DataFrame) -> DataFrame:
    """One row for each match, team and player: shots, goals, xG with and without penalties,
    passes, assists, take-ons, duels. Throw-ins are not passes; own goals are no shots."""
    n = lambda c: F.count(F.when(c, 1))
    t, o, k = F.col("type"), F.col("outcome"), F.coalesce(F.col("kind"), F.lit(""))
    shot, is_pass, penalty = t == "Shot", (t == "Pass") & (k != "Throw-in"), k == "Penalty"
    e = with_assists(events).where("player_id is not null")
    total = lambda c, w: F.round(F.coalesce(F.sum(F.when(w, F.col(c))), F.lit(0.0)), 4)
    return e.groupBy("match_id", "team_id", "player_id").agg(
        n(shot).alias("shots"), n(shot & (o == "Goal")).alias("goals"), total("xg", shot).alias("xg"), total("xg", shot & ~penalty).alias("npxg"), total("xa", is_pass).alias("xa"),
        n(is_pass).alias("passes"), n(is_pass & o.isNull()).alias("passes_completed"), n(F.coalesce(F.col("goal_assist"), F.lit(False))).alias("assists"),
        n(t == "Dribble").alias("take_ons"), n((t == "Dribble") & (o == "Complete")).alias("take_ons_won"), n(t == "Duel").alias("duels"), n((t == "Duel") & o.isin("Won", "Success", "Success In Play")).alias("duels_won"),
    )


def team_lines(events: DataFrame, last_minutes: int = 75) -> DataFrame:
    """One row for each match and team: goals for and against by half and late, xG, possession.

    An own goal counts for the other side, which sees it as 'Own Goal For'.
    """
    goal = ((F.col("type") == "Shot") & (F.col("outcome") == "Goal")) | (F.col("type") == "Own Goal For")
    n = lambda c: F.count(F.when(c, 1))
    own = events.groupBy("match_id", "team_id").agg(
        n(goal).alias("goals"), n(goal & (F.col("period") == 1)).alias("goals_first_half"), n(goal & (F.col("minute") >= last_minutes)).alias("goals_late"),
        n(F.col("type") == "Shot").alias("shots"), F.round(F.coalesce(F.sum("xg"), F.lit(0.0)), 4).alias("xg"),
    )
    held = events.groupBy("match_id", F.col("possession_team_id").alias("team_id")).agg(F.round(F.sum("duration"), 4).alias("possession_s"))
    own = own.join(held, ["match_id", "team_id"], "left")
    other = own.select("match_id", F.col("team_id").alias("_o"), F.col("goals").alias("goals_against"), F.col("xg").alias("xg_against"))
    out = own.join(other, "match_id").where("team_id <> _o").drop("_o")
    points = F.when(F.col("goals") > F.col("goals_against"), 3).when(F.col("goals") == F.col("goals_against"), 1).otherwise(0)
    return out.withColumn("points", points).withColumn("clean_sheet", F.col("goals_against") == 0)


def minutes_played(lineups: DataFrame, last_event: DataFrame) -> DataFrame:
    """(match_id, team_id, player_id, position, minutes, started) from spells of positions.

    A spell without an end lasts until the match's last event (match_id, end_s). Players without
    time on the pitch are left out.
    """
    s = position_spells(lineups, last_event)
    by = s.groupBy("match_id", "team_id", "player_id", "position").agg(F.sum("seconds").alias("seconds"), F.bool_or("starting").alias("starting"))
    return by.groupBy("match_id", "team_id", "player_id").agg(F.max_by("position", F.struct("seconds", "position")).alias("position"), F.bround(F.sum("seconds") / 60).cast("int").alias("minutes"), F.bool_or("starting").alias("started"), F.sum("seconds").alias("_s")).where("_s > 0").drop("_s")


def match_lines(events: DataFrame, minutes: DataFrame) -> DataFrame:
    """One row for each match and player with time on the pitch, with everything the player did.

    ``events``: flat, with card, aerial_won, shot_assist. ``minutes``: of ``minutes_played``; who is
    not in it has no line. A duel is a tackle, an aerial one or a take-on; an aerial one is won
    where another event (pass, shot, clearance) says so, and lost as a duel of its own kind.
    """
    n = lambda c: F.count(F.when(c, 1))
    t, o, k = F.col("type"), F.coalesce(F.col("outcome"), F.lit("")), F.coalesce(F.col("kind"), F.lit(""))
    shot, is_pass, tackle, take_on = t == "Shot", (t == "Pass") & (k != "Throw-in"), (t == "Duel") & (k == "Tackle"), t == "Dribble"
    set_up = F.coalesce(F.col("goal_assist"), F.lit(False)) | F.coalesce(F.col("shot_assist"), F.lit(False))
    did = events.where("player_id is not null").groupBy("match_id", "player_id").agg(
        n(shot & o.isin(*ON_TARGET)).alias("shots_on_target"), n(shot & (o == "Goal") & (k == "Penalty")).alias("penalty_goals"), n(is_pass & set_up).alias("key_passes"),
        n(tackle).alias("tackles"), n(tackle & o.isin(*TACKLE_WON)).alias("tackles_won"), n((t == "Duel") & (k == "Aerial Lost")).alias("aerials_lost"), n(F.col("aerial_won")).alias("aerials_won"),
        n(take_on).alias("dribbles"), n(take_on & (o == "Complete")).alias("dribbles_completed"), n(t == "Interception").alias("interceptions"), n(t == "Clearance").alias("clearances"),
        n(F.col("card") == "Yellow Card").alias("yellow_cards"), n(F.col("card").isin(*SENT_OFF)).alias("red_cards"),
    )
    lines = player_lines(events).select("match_id", "player_id", "shots", "goals", "xg", "npxg", "xa", "passes", "passes_completed", "assists")
    on = minutes.select("match_id", "team_id", "player_id", F.lit(1).alias("appearances"), F.col("started").cast("int").alias("starts"), F.col("minutes").alias("minutes_played"))
    out = on.join(did, ["match_id", "player_id"], "left").join(lines, ["match_id", "player_id"], "left")
    out = out.na.fill(0, [c for c in out.columns if c not in ("match_id", "team_id", "player_id")])
    out = out.withColumn("aerials", F.col("aerials_won") + F.col("aerials_lost"))
    return out.withColumn("duels", F.col("tackles") + F.col("aerials") + F.col("dribbles")).withColumn("duels_won", F.col("tackles_won") + F.col("aerials_won") + F.col("dribbles_completed"))


def match_results(events: DataFrame, homes: DataFrame, late: int = 75) -> DataFrame:
    """One row for each match and side, home first: the result and what goals it is made of.

    ``events``: flat, with play_pattern. ``homes``: (match_id, home, away, home_score, away_score),
    the published score, which decides the result. An own goal counts for the other side; it is no
    set piece. Possession is what the match's own sides held; sides without an event get zeros.
    """
    n = lambda c: F.count(F.when(c, 1))
    own_goal, k = F.col("type") == "Own Goal Against", F.coalesce(F.col("kind"), F.lit(""))
    goal = ((F.col("type") == "Shot") & (F.col("outcome") == "Goal")) | own_goal
    piece = goal & ~own_goal & (k.isin(*SET_PIECE_SHOT) | F.coalesce(F.col("play_pattern").isin(*SET_PIECE_PATTERN), F.lit(False)))
    sides = homes.select("match_id", F.explode(F.array(
        F.struct(F.col("home").alias("team_id"), F.col("away").alias("other"), F.col("home_score").alias("goals_for"), F.col("away_score").alias("goals_against"), F.lit(True).alias("at_home")),
        F.struct(F.col("away").alias("team_id"), F.col("home").alias("other"), F.col("away_score").alias("goals_for"), F.col("home_score").alias("goals_against"), F.lit(False).alias("at_home")),
    )).alias("s")).select("match_id", "s.*")
    by = events.groupBy("match_id", F.col("team_id").alias("side"), own_goal.alias("own")).agg(
        n(goal & (F.col("period") == 1)).alias("first_half"), n(goal & (F.col("period") == 2) & (F.col("minute") >= late)).alias("last_15"), n(piece).alias("set_piece"),
        n(F.col("type") == "Shot").alias("shots"), F.coalesce(F.sum(F.when(F.col("type") == "Shot", F.col("xg"))), F.lit(0.0)).alias("xg"),
    )
    part = sides.select("match_id", "team_id", "other").join(by, "match_id").where((F.col("side") == F.col("team_id")) | (F.col("side") == F.col("other")))
    ours = (F.col("side") == F.col("team_id")) != F.col("own")
    total = lambda c, w: F.sum(F.when(w, F.col(c)).otherwise(0))
    scored = part.groupBy("match_id", "team_id").agg(
        *[total(c, w).alias(a) for c, w, a in (("first_half", ours, "goals_for_first_half"), ("first_half", ~ours, "goals_against_first_half"), ("last_15", ~ours, "goals_against_last_15"), ("set_piece", ours, "set_piece_goals_for"), ("set_piece", ~ours, "set_piece_goals_against"))],
        *[total(c, (F.col("side") == F.col("team_id")) == F.lit(mine)).alias(a) for c, mine, a in (("shots", True, "shots_for"), ("shots", False, "shots_against"), ("xg", True, "xg_for"), ("xg", False, "xg_against"))],
    )
    held = events.groupBy("match_id", F.col("possession_team_id").alias("team_id")).agg(F.sum("duration").alias("possession_s"))
    out = sides.join(scored, ["match_id", "team_id"], "left").join(held, ["match_id", "team_id"], "left")
    out = out.join(held.select("match_id", F.col("team_id").alias("other"), F.col("possession_s").alias("possession_against_s")), ["match_id", "other"], "left")
    counts = [*[c for c in scored.columns if c not in ("match_id", "team_id")], "possession_s", "possession_against_s"]
    points = F.when(F.col("goals_for") > F.col("goals_against"), 3).when(F.col("goals_for") == F.col("goals_against"), 1).otherwise(0)
    out = out.na.fill(0, counts).withColumn("points", points)
    return out.withColumns({
        "wins": (F.col("points") == 3).cast("int"), "draws": (F.col("points") == 1).cast("int"), "losses": (F.col("points") == 0).cast("int"),
        "home_points": F.when(F.col("at_home"), F.col("points")).otherwise(0), "away_points": F.when(F.col("at_home"), 0).otherwise(F.col("points")), "clean_sheets": (F.col("goals_against") == 0).cast("int"),
    })


def team_totals(results: DataFrame) -> DataFrame:
    """Season totals of ``match_results`` by team, and the share of the time held by either side."""
    kept = ("match_id", "team_id", "other", "at_home", "possession_s", "possession_against_s", "xg_for", "xg_against")
    held, theirs = F.sum("possession_s"), F.sum("possession_against_s")
    share = F.when(held + theirs > 0, held / (held + theirs) * 100).otherwise(0.0)
    return results.groupBy("team_id").agg(F.count("*").alias("matches"), *[F.sum(c).alias(c) for c in results.columns if c not in kept], *[F.round(F.sum(c), 2).alias(c) for c in ("xg_for", "xg_against")], F.round(share, 1).alias("possession_pct"))


def position_spells(lineups: DataFrame, last_event: DataFrame) -> DataFrame:
    """(match_id, team_id, player_id, position, seconds, starting) of the spells outside the shootout."""
    s = lineups.select("match_id", "team_id", F.explode("lineup").alias("p")).select("match_id", "team_id", F.col("p.player_id").alias("player_id"), F.explode("p.positions").alias("s"))
    s = s.where(f"s.from_period is null or s.from_period <> {SHOOTOUT}").join(last_event, "match_id")
    start, end = clock_seconds(F.col("s")["from"]), F.coalesce(clock_seconds(F.col("s")["to"]), F.col("end_s"))
    return s.select("match_id", "team_id", "player_id", F.col("s.position").alias("position"), F.greatest(end - start, F.lit(0.0)).alias("seconds"), (F.col("s.start_reason") == "Starting XI").alias("starting"))


def position_seconds(lineups: DataFrame, last_event: DataFrame) -> DataFrame:
    """(player_id, position, seconds) over all matches."""
    return position_spells(lineups, last_event).groupBy("player_id", "position").agg(F.sum("seconds").alias("seconds"))


def shot_situation(kind: Column, play_pattern: Column) -> Column:
    """penalty, free kick, corner, other set piece or open play."""
    return F.when(kind == "Penalty", "penalty").when(kind == "Free Kick", "free kick").when(play_pattern == "From Corner", "corner").when(play_pattern.isin("From Free Kick", "From Throw In"), "set piece").otherwise("open play")
