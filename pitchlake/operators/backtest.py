"""Decisions as they would have been taken: what was known at each cutoff, and what came of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.people import age_years
from . import cohorts, evaluation, temporal

STEP, HISTORY, FUTURE = 91, 365, 365  # days between cutoffs, before the first, after the last
ACTIVE = 183  # days since the last reading of one who is still measured
CUT_AGES = (12.0, 16.0)
OUTCOME_DAYS, CATCH_UP = 365, 0.5


def cutoffs(readings: DataFrame, date: str) -> DataFrame:
    """One row a cutoff, from a year after the first reading to a year before the last; none if the
    readings span less."""
    ends = readings.agg(F.date_add(F.min(date), HISTORY).alias("a"), F.date_sub(F.max(date), FUTURE).alias("b")).where("a <= b")
    return ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval {STEP} days"))).alias("cutoff"))


def snapshots(readings: DataFrame, cutoff: DataFrame, groups: Sequence[str], player: str, date: str, value: str, born: str, floor: float) -> DataFrame:
    """(cutoff, groups, player, last_date, last_z, mean_z, readings, recent_velocity, stated_age, age).

    Everything from readings up to the cutoff alone: the cohorts' references, each player's z and
    velocity, and the day that counts as today (the last one with a reading). All cutoffs are in
    one plan, with the cutoff as one more key. ``readings`` has the age at each reading in ``age``.
    """
    # dealt out by player before the cutoffs multiply them: all steps by cutoff and player stay there
    seen = temporal.as_of(readings.repartition(player), F.broadcast(cutoff), date)
    keys = ["cutoff", *groups]
    z = cohorts.z_scores(seen, cohorts.cohort_reference(seen, keys, "age", value, floor), keys, "age", value)
    at = F.struct(F.col(date).alias("d"), F.col(value).alias("v"))
    sizes = z.groupBy("cutoff", player).agg(F.max_by("z", at).alias("last_z"), F.avg("z").alias("mean_z"), F.count("*").alias("readings"))
    today = F.broadcast(seen.groupBy("cutoff").agg(F.max(date).alias("today")))  # a row a cutoff
    recent = F.when(F.datediff("today", date) <= cohorts.RECENT_DAYS, at)
    rows = seen.join(today, "cutoff").groupBy("cutoff", *groups, player, born, "today")
    grown = rows.agg(F.max(date).alias("last_date"), F.min(recent).alias("a"), F.max(recent).alias("b"), F.count(recent).alias("n"))
    velocity = F.coalesce(cohorts.velocity(F.col("a"), F.col("b"), F.col("n")), F.lit(0.0))
    out = grown.select("cutoff", *groups, player, "last_date", velocity.alias("recent_velocity"), age_years(F.col("today"), F.col(born)).alias("stated_age"), age_years(F.col("cutoff"), F.col(born)).alias("age"))
    return out.join(sizes, ["cutoff", player])


def decisions(snapshot: DataFrame, groups: Sequence[str], player: str) -> DataFrame:
    """The first cutoff at which a player was among the shortest quarter of those of 12 to 16 still
    measured, whether they would have been flagged as a late bloomer, and else the first gate that
    failed."""
    eligible = snapshot.where((F.datediff("cutoff", "last_date") <= ACTIVE) & (F.col("age") >= CUT_AGES[0]) & (F.col("age") < CUT_AGES[1]))
    short = cohorts.shortest_quarter(eligible, ["cutoff", *groups], "last_z", player).select("cutoff", player)
    first = short.groupBy(player).agg(F.min("cutoff").alias("cutoff"))
    failed = (
        F.when(F.col("readings") < 3, "too few readings")
        .when(~F.col("stated_age").between(11, 18.5), "age")
        .when(F.col("mean_z") > -0.9, "not short enough on average")
        .when(F.col("recent_velocity") < 3.0, "not growing fast yet")
    )
    return snapshot.join(first, ["cutoff", player]).select("cutoff", *groups, player, "last_z", "readings", failed.isNull().alias("flagged"), failed.alias("reason"))


def outcomes(decided: DataFrame, readings: DataFrame, groups: Sequence[str], player: str, date: str, value: str, floor: float) -> DataFrame:
    """``decided`` with ``z_change`` and ``caught_up``, null without a reading a year on.

    Judged by the reference of all readings: this is hindsight, and nothing of it reaches the
    decisions.
    """
    z = cohorts.z_scores(readings, cohorts.cohort_reference(readings, groups, "age", value, floor), groups, "age", value).select(player, F.col(date).alias("_d"), F.struct(F.col(date).alias("d"), F.col(value).alias("v")).alias("_at"), F.col("z").alias("_z"))
    both = decided.select("cutoff", player).join(z, player)
    then = F.max_by(F.when(F.col("_d") <= F.col("cutoff"), F.col("_z")), F.when(F.col("_d") <= F.col("cutoff"), F.col("_at")))
    later = F.datediff("_d", "cutoff") >= OUTCOME_DAYS
    now = F.max_by(F.when(later, F.col("_z")), F.when(later, F.col("_at")))
    change = both.groupBy(player).agg((now - then).alias("z_change"))
    return decided.join(change, player, "left").withColumn("caught_up", F.col("z_change") >= CATCH_UP)


def summary(judged: DataFrame, dataset: str) -> DataFrame:
    """Counts by dataset and, as dataset 'all', over all of them, with Wilson's interval of the share
    of those who caught up that were flagged. Pooled shares are of pooled counts."""
    n = lambda c: F.count(F.when(c, 1)).alias
    flagged, up = F.col("flagged"), F.col("caught_up")
    counted = judged.groupBy(F.col(dataset).cast("string").alias("dataset")).agg(
        F.count("*").alias("decisions"), n(flagged)("flagged"), F.count("z_change").alias("followed"), n(up)("caught_up"), n(flagged & up)("hits"), n(flagged & ~up)("false_alarms")
    )
    names = ["decisions", "flagged", "followed", "caught_up", "hits", "false_alarms"]
    every = counted.union(counted.agg(F.lit("all").alias("dataset"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]))
    low, high = evaluation.wilson(F.col("hits"), F.col("caught_up"))
    return every.select("dataset", *names, F.when(F.col("caught_up") > 0, low).alias("low"), F.when(F.col("caught_up") > 0, high).alias("high"))
