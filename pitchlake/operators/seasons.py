"""Seasons: rates, ranks, changes, needs, reports, event tallies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.match import in_first_half, stamp_minute
from .percentiles import midrank
from .temporal import latest


def per_90(df: DataFrame, minutes: str, fields: Sequence[str], least: int = 450) -> DataFrame:
    """Rates per 90 minutes as ``<field>_90``, null under ``least`` minutes."""
    return df.withColumns({f"{f}_90": F.when(F.col(minutes) >= least, 90.0 * F.col(f) / F.col(minutes)) for f in fields})


def melt(df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """A row for each of ``values``."""
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias(name), F.col(v).cast("double").alias(value)) for v in values])).alias("_m")).select(*keys, f"_m.{name}", f"_m.{value}")


def team_profile(teams: DataFrame, league: Sequence[str], metric: str, value: str, lower_better: Sequence[str], stable: Sequence[str], least: int = 8) -> DataFrame:
    """Rank of each team's metric in its league (1 is best), ``bottom`` third and ``weak``.

    Ties share a rank. The bottom third is rank > 2 n / 3 among ``least`` or more valued teams;
    only a stable metric there is weak.
    """
    signed = F.when(F.col(metric).isin(*lower_better), -F.col(value)).otherwise(F.col(value)) if lower_better else F.col(value)
    w = Window.partitionBy(*league, metric)
    out = teams.where(F.col(value).isNotNull()).withColumn("_s", signed).withColumn("n", F.count("*").over(w)).withColumn("rank", F.rank().over(w.orderBy(F.desc("_s"))))
    bottom = (F.col("n") >= least) & (F.col("rank") > 2 * F.col("n") / 3)
    return out.withColumn("bottom", bottom).withColumn("weak", bottom & F.col(metric).isin(*stable)).drop("_s")


def squad_coverage(players: DataFrame, group: Sequence[str], minutes: str) -> DataFrame:
    """Each player's share of their group's minutes."""
    return players.withColumn("share", F.col(minutes) / F.sum(minutes).over(Window.partitionBy(*group)))


def latest_season(seasons: DataFrame, player: str, end: str, minutes: str, tie: str) -> DataFrame:
    """Each player's latest season, the one of more minutes first."""
    return latest(seasons, [player], [F.desc(end), F.desc(minutes), F.col(tie)])


def opportunity(now: Column, team_now: Column, before: Column, team_before: Column, floor: float = 0.025) -> Column:
    """Log change of a player's share of the team's chances."""
    return F.ln((now / team_now + floor) / (before / team_before + floor))


def breakout(df: DataFrame, score: str, age: str, minutes: str, members: str, bar: float, squad: int = 11) -> Column:
    """Why a season can't be assessed, or whether it is a breakout: ages 18 to 24, 270 minutes, a squad."""
    return (
        F.when(~F.col(age).between(18, 24), "age")
        .when(F.col(minutes) < 270, "minutes")
        .when(F.col(members) < squad, "squad")
        .when(F.col(score).isNull(), "no season before")
        .when(F.col(score) >= bar, "breakout")
        .otherwise("none")
    )


def rate_breakout(df: DataFrame, age: str, minutes: str, rate: Column, before_minutes: str, before_rate: Column, bar: float = 0.15, weight: float = 0.1, full: float = 34 * 90.0) -> Column:
    """The first version: log change of the bare rate and a tenth of the rise in playing time."""
    change = F.when(F.col(before_minutes) >= 270, F.ln((rate + 0.05) / (before_rate + 0.05))).otherwise(0.0)
    rise = (F.col(minutes) - F.coalesce(before_minutes, F.lit(0))) / full
    return F.coalesce((F.col(age) >= 18) & (F.col(age) < 24) & (F.col(minutes) >= 270) & (change + weight * rise >= bar), F.lit(False))


def minutes_breakout(age: Column, minutes: Column, before: Column, bar: float, full: float = 34 * 90.0) -> Column:
    """The baseline: a young player's share of a full season rose by ``bar``."""
    return F.coalesce((age >= 18) & (age < 24) & ((minutes - F.coalesce(before, F.lit(0))) / full >= bar), F.lit(False))


def gap_value(plus: Sequence[str], minus: Sequence[str] = (), over: Sequence[str] = (), minutes: str | None = None) -> Column:
    """A sum of fields less others, per 90 minutes or over other fields; null if any is missing."""
    top = sum((F.col(c) for c in plus), F.lit(0.0)) - sum((F.col(c) for c in minus), F.lit(0.0))
    if minutes:
        return 90.0 * top / F.nullif(F.col(minutes), F.lit(0))
    return top / F.nullif(sum((F.col(c) for c in over), F.lit(0.0)), F.lit(0.0)) if over else top


def shown_value(raw: Column, kind: str, floor: float = 0.05) -> Column:
    """A profile's value as it is shown: a log rate as the rate again, a share in per cent."""
    return F.exp(raw) - floor if kind == "rate" else 100.0 * raw if kind == "percent" else raw


def recommendation(grade_: Column, confidence: Column) -> Column:
    """Shortlist for an A or B that is no mere guess, Not now for a D, else Monitor."""
    return F.when(grade_.isin("A", "B") & (confidence != "low"), "Shortlist").when(grade_ == "D", "Not now").otherwise("Monitor")


def candidates(players: DataFrame, group: Sequence[str], player: str, attributes: Sequence[str], minutes: str, top: int) -> DataFrame:
    """The first ``top`` of each group by the mean of their percentiles among the others."""
    long = melt(players, [*group, player, minutes], attributes)
    ranked = midrank(long, [*group, "metric"], "value", include_self=False)
    mean = ranked.groupBy(*group, player, minutes).agg(F.avg("percentile").alias("mean"))
    w = Window.partitionBy(*group).orderBy(F.desc("mean"), F.desc(minutes), player)
    return mean.where("mean is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def club_candidates(players: DataFrame, needs: DataFrame, league: Sequence[str], group: str, club: str, player: str, attributes: Sequence[str], minutes: str, top: int) -> DataFrame:
    """For each need (league, group, club) the first ``top`` players of the club's league and
    group who are with other clubs, by the mean of all their percentiles, rounded to a tenth.

    Percentiles are among the league's whole group, the club's own players included; players
    without one of them are unranked. A club's list lies within the league's first ``top`` and as
    many more as the largest club has in the group, so no club meets all players of its league.
    """
    keys = [*league, group]
    long = melt(players, [*keys, club, player, minutes], attributes)
    ranked = midrank(long, [*keys, "metric"], "value", include_self=False)
    mean = ranked.groupBy(*keys, club, player, minutes).agg(F.bround(F.avg("percentile"), 1).alias("mean"), F.count("percentile").alias("_known")).where(F.col("_known") == len(attributes)).drop("_known")
    most = mean.groupBy(*keys, club).agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.max("_n").alias("_most"))
    order = [F.desc("mean"), F.desc(minutes), F.col(player)]
    first = mean.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).join(most, keys).where(F.col("_r") <= top + F.col("_most"))
    j = needs.select(*keys, F.col(club).alias("for_club")).distinct().join(first, keys).where(F.col(club) != F.col("for_club"))
    w = Window.partitionBy(*keys, "for_club").orderBy(*order)
    return j.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).drop("_r", "_most")


def grade(score: Column) -> Column:
    """A from 85, B from 70, C from 50, else D."""
    return F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 50, "C").when(score.isNotNull(), "D")


def report(players: DataFrame, group: Sequence[str], player: str, areas: Mapping[str, Sequence[str]], minutes: str) -> DataFrame:
    """Area scores (mean percentile of an area's attributes among the group's others), grades,
    the weakest area, counts of strengths (70 and more) and weaknesses (30 and less)."""
    attributes = sorted({a for names in areas.values() for a in names})
    ranked = midrank(melt(players, [*group, player, minutes], attributes), [*group, "metric"], "value", include_self=False)
    area = F.lit(None).cast("string")
    scores = ranked.groupBy(*group, player, minutes).agg(
        *[F.avg(F.when(F.col("metric").isin(*names), F.col("percentile"))).alias(a) for a, names in areas.items()],
        F.count(F.when(F.col("percentile") >= 70, 1)).alias("strengths"),
        F.count(F.when(F.col("percentile") <= 30, 1)).alias("weaknesses"),
    )
    least = F.least(*[F.col(a) for a in areas])
    for a in reversed(list(areas)):
        area = F.when(F.col(a) == least, a).otherwise(area)
    out = scores.withColumn("level", sum((F.col(a) for a in areas), F.lit(0.0)) / len(areas)).withColumn("weakest", area)
    confidence = F.when(F.col(minutes) >= 1800, "high").when(F.col(minutes) >= 900, "medium").otherwise("low")
    return out.withColumn("grade", grade(F.col("level"))).withColumn("confidence", confidence)


def success_rates(events: DataFrame, keys: Sequence[str], attempts: Column, successes: Column, least: int = 10) -> DataFrame:
    """Attempts, successes and their rate, hidden under ``least`` attempts."""
    g = events.groupBy(*keys).agg(F.count(F.when(attempts, 1)).alias("attempts"), F.count(F.when(attempts & successes, 1)).alias("successes"))
    return g.withColumn("rate", F.when(F.col("attempts") >= least, F.col("successes") / F.col("attempts")))


def touch_counts(events: DataFrame, keys: Sequence[str], zone: Column) -> DataFrame:
    """Touches by zone and, by key, the sparse map of a grid."""
    n = events.groupBy(*keys, zone.alias("zone")).agg(F.count("*").alias("touches"))
    return n.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("zone", "touches"))).alias("cells"), F.sum("touches").alias("all"))


def team_season(matches: DataFrame, season: Column) -> DataFrame:
    """Won, drawn, lost, goals and points by team and season, of matches (home, away, goals).

    A match without a number takes both teams' seasons out.
    """
    m = matches.withColumn("season", season)
    both = m.select("season", F.explode(F.array(F.struct(F.col("home").alias("team"), F.col("home_goals").alias("f"), F.col("away_goals").alias("a")), F.struct(F.col("away").alias("team"), F.col("away_goals").alias("f"), F.col("home_goals").alias("a")))).alias("s")).select("season", "s.*")
    g = both.groupBy("team", "season").agg(
        F.count("*").alias("played"),
        F.count(F.when(F.col("f") > F.col("a"), 1)).alias("won"),
        F.count(F.when(F.col("f") == F.col("a"), 1)).alias("drawn"),
        F.count(F.when(F.col("f") < F.col("a"), 1)).alias("lost"),
        F.sum("f").alias("goals_for"),
        F.sum("a").alias("goals_against"),
        F.count(F.when(F.col("f").isNull() | F.col("a").isNull(), 1)).alias("broken"),
        F.count(F.when(F.col("a") == 0, 1)).alias("clean_sheets"),
    )
    return g.where("broken = 0").drop("broken").withColumn("points", 3 * F.col("won") + F.col("drawn"))


def team_season_details(matches: DataFrame, season: Column, last: int = 76) -> DataFrame:
    """Season rows by team as ``team_season`` gives, with xG, shots, possession, halves and venue.

    ``matches``: home, away, and for both ``<side>_goals``, ``_xg``, ``_shots``, ``_possession`` and
    ``_stamps`` (minutes such as '45+2', which is still the first half). A match without one of
    these numbers takes both teams' seasons out. Possession is the mean over matches.
    """
    numbers = ("goals", "xg", "shots", "possession", "stamps")

    def side(me: str, other: str) -> Column:
        mine = [F.col(f"{me}_{c}").alias(c) for c in numbers] + [F.col(f"{other}_{c}").alias(f"{c}_a") for c in numbers]
        return F.struct(F.col(me).alias("team"), F.lit(me == "home").alias("at_home"), *mine)

    both = matches.withColumn("season", season).select("season", F.explode(F.array(side("home", "away"), side("away", "home"))).alias("s")).select("season", "s.*")
    known = [F.col(c).isNotNull() for n in numbers[:-1] for c in (n, f"{n}_a")]
    broken = ~F.forall(F.array(*known), lambda x: x)
    won, drawn, lost = (F.col("goals") > F.col("goals_a"), F.col("goals") == F.col("goals_a"), F.col("goals") < F.col("goals_a"))
    points = F.when(won, 3).when(drawn, 1).otherwise(0)
    stamps = lambda c, keep: F.sum(F.coalesce(F.size(F.filter(c, keep)), F.lit(0)))
    g = both.groupBy("team", "season").agg(
        F.count("*").alias("matches"), F.count_if(won).alias("wins"), F.count_if(drawn).alias("draws"), F.count_if(lost).alias("losses"), F.sum(points).alias("points"),
        F.sum(F.when(F.col("at_home"), points).otherwise(0)).alias("home_points"), F.sum(F.when(F.col("at_home"), 0).otherwise(points)).alias("away_points"),
        F.sum("goals").alias("goals_for"), F.sum("goals_a").alias("goals_against"), F.round(F.sum("xg"), 2).alias("xg_for"), F.round(F.sum("xg_a"), 2).alias("xg_against"),
        F.sum("shots").alias("shots_for"), F.sum("shots_a").alias("shots_against"), F.round(F.avg("possession"), 1).alias("possession_pct"), F.count_if(F.col("goals_a") == 0).alias("clean_sheets"),
        stamps(F.col("stamps"), in_first_half).alias("goals_for_first_half"), stamps(F.col("stamps_a"), in_first_half).alias("goals_against_first_half"),
        stamps(F.col("stamps_a"), lambda x: stamp_minute(x) >= last).alias("goals_against_last_15"), F.bool_or(broken).alias("_broken"),
    )
    return g.where("not _broken").drop("_broken")


def reconcile(ours: DataFrame, published: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, field, ours, published) where the totals differ or one side is missing."""
    a, b = melt(ours, keys, fields, "field", "ours"), melt(published, keys, fields, "field", "published")
    return a.join(b, [*keys, "field"], "full").where(~F.col("ours").eqNullSafe(F.col("published")))


def dimensions(rows: DataFrame, player: str, season: str, details: Sequence[str], team: str, first: str, last: str) -> tuple[DataFrame, DataFrame]:
    """Players with the details of their latest season, and spells from first to last day."""
    people = rows.groupBy(player).agg(*[F.max_by(c, F.struct(season, c)).alias(c) for c in details])
    spells = rows.groupBy(player, team).agg(F.min(first).alias("start_date"), F.max(last).alias("end_date"))
    return people, spells


def profile_vectors(df: DataFrame, player: str, group: Sequence[str], exposure: str, counts: Sequence[str], least: float, floor: float = 0.05) -> DataFrame:
    """Log rates per 90 of each player with enough exposure, and their z in the group."""
    sums = df.groupBy(player, *group).agg(F.sum(exposure).alias("_e"), *[F.sum(c).alias(c) for c in counts]).where(F.col("_e") >= least)
    raw = sums.withColumns({c: F.ln(90.0 * F.col(c) / F.col("_e") + floor) for c in counts})
    of = raw.groupBy(*group).agg(*[f(c).alias(f"_{n}_{c}") for c in counts for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    z = lambda c: F.coalesce((F.col(c) - F.col(f"_mean_{c}")) / F.nullif(F.col(f"_sd_{c}"), F.lit(0.0)), F.lit(0.0)).alias(c)
    return raw.join(of, list(group)).select(player, *group, *[z(c) for c in counts])
