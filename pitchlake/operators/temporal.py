"""Joins in time: intervals in force, the latest before a date, previous periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def in_force(df: DataFrame, on: Column, start: str, end: str) -> DataFrame:
    """Rows whose interval holds the date; a null end is open."""
    return df.where((F.col(start) <= on) & (F.col(end).isNull() | (F.col(end) >= on)))


def consented(people: DataFrame, consent: DataFrame, on: Column, person: str, purpose: str) -> DataFrame:
    """People with a granted consent for the purpose in force on the date."""
    ok = in_force(consent.where(F.col("granted") & (F.col("purpose") == purpose)), on, "valid_from", "valid_until")
    return people.join(ok.select(F.col("player_id").alias(person)).distinct(), person, "left_semi")


def consent_state(consent: DataFrame, on: Column, purposes: Sequence[str], needed: Sequence[str]) -> DataFrame:
    """(player_id, a column for each purpose, complete); absent counts as refused."""
    rows = in_force(consent, on, "valid_from", "valid_until").groupBy("player_id")
    out = rows.agg(*[F.coalesce(F.bool_or(F.col("granted") & (F.col("purpose") == p)), F.lit(False)).alias(p) for p in purposes])
    complete = F.lit(True)
    for p in needed:
        complete = complete & F.col(p)
    return out.withColumn("complete", complete)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by the order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def current_spell(spells: DataFrame, player: str, start: str, end: str, tie: str) -> DataFrame:
    """Each player's open spell, the latest begun if there are several."""
    return latest(spells.where(F.col(end).isNull()), [player], [F.desc(start), F.col(tie)])


def spell_on(rows: DataFrame, spells: DataFrame, player: str, date: str, start: str, end: str, tie: str, row_id: str) -> DataFrame:
    """Each row with the spell in force on its date (the latest begun), null columns without."""
    s = spells.select(F.col(player).alias("_p"), start, end, tie)
    joined = rows.join(s, (F.col(player) == F.col("_p")) & (F.col(start) <= F.col(date)) & (F.col(end).isNull() | (F.col(end) >= F.col(date))), "left")
    return latest(joined, [row_id], [F.desc_nulls_last(start), F.col(tie)]).drop("_p")


def month_before(rows: DataFrame, monthly: DataFrame, player: str, date: str, month: str, value: str) -> DataFrame:
    """Each row with the player's value as it stood going into the month of its date."""
    keyed = rows.withColumn("_m", F.trunc(F.col(date), "MM").cast("date"))
    m = monthly.select(F.col(player), F.col(month).cast("date").alias("_m"), F.col(value))
    return keyed.join(m, [player, "_m"], "left").drop("_m")


def as_of(df: DataFrame, cutoffs: DataFrame, date: str, cutoff: str = "cutoff") -> DataFrame:
    """Rows seen at each cutoff: those dated on or before it. The cutoffs are few."""
    return df.join(F.broadcast(cutoffs), F.col(date) <= F.col(cutoff))


def within_season(events: DataFrame, seasons: DataFrame, player: str, date: str, start: str, end: str) -> DataFrame:
    """Events of a player inside a season's dates."""
    s = seasons.withColumnRenamed(player, "_p")
    return events.join(s, (F.col(player) == F.col("_p")) & F.col(date).between(F.col(start), F.col(end))).drop("_p")


def previous_season(seasons: DataFrame, keys: Sequence[str], year: str, columns: Sequence[str], covered: Sequence[str]) -> DataFrame:
    """Each season with its predecessor's columns (``before_*``): same keys, the year before.

    The first covered year of a competition has no predecessor and is left out.
    """
    first = seasons.groupBy(*covered).agg(F.min(year).alias("_first"))
    before = seasons.select(*keys, (F.col(year) + 1).alias(year), *[F.col(c).alias(f"before_{c}") for c in columns])
    return seasons.join(first, list(covered)).where(F.col(year) > F.col("_first")).drop("_first").join(before, [*keys, year], "left")


def overlapping_spells(spells: DataFrame, keys: Sequence[str], start: str, end: str, tie: str) -> DataFrame:
    """Neighbouring spells of a key of which the earlier hasn't ended when the next begins."""
    w = Window.partitionBy(*keys).orderBy(start, tie)
    following = spells.withColumn("next_start", F.lead(start).over(w))
    return following.where(F.col("next_start").isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col("next_start"))))


def previous_reading(df: DataFrame, keys: Sequence[str], date: str, tie: str, value: str) -> DataFrame:
    """Each reading with the one before it of the same keys."""
    w = Window.partitionBy(*keys).orderBy(date, tie)
    return df.withColumn("previous_date", F.lag(date).over(w)).withColumn("previous_value", F.lag(value).over(w))


def plausibility(df: DataFrame, date: str, value: str, low: float, high: float, drop: float = 1.5, monthly: float = 2.5) -> DataFrame:
    """``df`` (with previous readings) and ``warnings``: unusual, drop, fast gain."""
    months = F.greatest(F.datediff(date, "previous_date") / 30.44, F.lit(1.0))
    change = F.col(value) - F.col("previous_value")
    warnings = F.array(
        F.when(~F.col(value).between(low, high), "unusual"),
        F.when(change < -drop, "drop"),
        F.when(change / months > monthly, "fast gain"),
    )
    return df.withColumn("warnings", F.array_compact(warnings))


def follow_pointers(records: DataFrame, key: str, pointer: str, most: int = 20) -> DataFrame:
    """(key, survivor): the end of each chain of pointers; loops end at their least key."""
    now = records.select(F.col(key).alias("key"), F.coalesce(F.col(pointer), F.col(key)).alias("survivor"))
    for _ in range(most):
        step = now.select(F.col("key").alias("survivor"), F.col("survivor").alias("_next"))
        doubled = written(now.join(step, "survivor", "left").select("key", F.coalesce("_next", "survivor").alias("next"), "survivor"))
        moved = doubled.where("next <> survivor").limit(1).count()
        now = doubled.select("key", F.col("next").alias("survivor"))
        if not moved:
            break
    return now.select(F.col("key").alias(key), "survivor")
