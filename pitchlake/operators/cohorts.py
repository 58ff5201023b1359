"""Cohort references, growth rates and the flags that rest on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECENT_DAYS, LEAST_DAYS = 400, 60


def cohort_reference(df: DataFrame, groups: Sequence[str], age: str, value: str, floor: float, least: int = 5, around: int = 1) -> DataFrame:
    """Median and spread of ``value`` by (groups, age), ages pooled with their neighbours.

    Only ages that occur themselves get a reference, of ``least`` or more values; the spread is
    the population's standard deviation, at least ``floor``. Values are counted by (key, value)
    first, so a large group shuffles its distinct values, not its rows.
    """
    keys = [*groups, "age"]
    counted = df.where(F.col(value).isNotNull() & F.col(age).isNotNull()).groupBy(*groups, F.bround(F.col(age)).cast("int").alias("age"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    own = counted.select(*keys).distinct()
    near = counted.withColumn("age", F.explode(F.array(*[F.col("age") + d for d in range(-around, around + 1)])))
    pooled = near.groupBy(*keys, "v").agg(F.sum("n").alias("n")).join(own, keys, "left_semi")
    mean = F.sum(F.col("v") * F.col("n")) / F.sum("n")
    out = pooled.groupBy(*keys).agg(
        F.expr("percentile(v, 0.5, n)").alias("median"),
        F.sqrt(F.greatest(F.sum(F.col("v") * F.col("v") * F.col("n")) / F.sum("n") - mean * mean, F.lit(0.0))).alias("sd"),
        F.sum("n").alias("members"),
    )
    return out.where(F.col("members") >= least).withColumn("sd", F.greatest("sd", F.lit(floor)))


def z_scores(df: DataFrame, reference: DataFrame, groups: Sequence[str], age: str, value: str) -> DataFrame:
    """``df`` with ``z`` against its cohort; rows without a reference go."""
    keyed = df.withColumn("_age", F.bround(F.col(age)).cast("int"))
    ref = reference.withColumnRenamed("age", "_age").select(*groups, "_age", "median", "sd")
    return keyed.join(ref, [*groups, "_age"]).withColumn("z", (F.col(value) - F.col("median")) / F.col("sd")).drop("_age", "median", "sd")


def z_summary(z: DataFrame, player: str, date: str, value: str) -> DataFrame:
    """Last, mean and least z of each player; of one day's readings the larger is the last."""
    return z.groupBy(player).agg(F.max_by("z", F.struct(date, value)).alias("last_z"), F.avg("z").alias("mean_z"), F.min("z").alias("least_z"), F.count("*").alias("readings"))


def velocity(first: Column, last: Column, n: Column) -> Column:
    """Units a year between two (date, value) structs; 0 for under 2 readings or 60 days."""
    days = F.datediff(last["d"], first["d"])
    return F.when((n < 2) | (days < LEAST_DAYS), 0.0).otherwise((last["v"] - first["v"]) / (days / F.lit(365.25)))


def growth(df: DataFrame, player: str, date: str, value: str, reference_date: Column) -> DataFrame:
    """(player, velocity, recent_velocity): over all readings and over the last 400 days."""
    at = F.struct(F.col(date).alias("d"), F.col(value).alias("v"))
    recent = F.datediff(reference_date, F.col(date)) <= RECENT_DAYS
    some = F.when(recent, at)
    grouped = df.groupBy(player).agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").alias("n"), F.min(some).alias("ra"), F.max(some).alias("rb"), F.count(some).alias("rn"))
    return grouped.select(player, velocity(F.col("a"), F.col("b"), F.col("n")).alias("velocity"), F.coalesce(velocity(F.col("ra"), F.col("rb"), F.col("rn")), F.lit(0.0)).alias("recent_velocity"))


def spaced_velocities(df: DataFrame, player: str, date: str, value: str, apart: int = 150) -> DataFrame:
    """(player, start, end, velocity) of pieces that don't overlap.

    A piece ends at the first reading ``apart`` or more days after its start and the next begins
    there. Readings are folded in order, a short list for each player.
    """
    state = "struct<d:date,v:double,out:array<struct<start:date,end:date,velocity:double>>>"
    series = df.groupBy(player).agg(F.array_sort(F.collect_list(F.struct(F.col(date).alias("d"), F.col(value).cast("double").alias("v")))).alias("s"))
    first = F.struct(F.col("s")[0]["d"].alias("d"), F.col("s")[0]["v"].alias("v"), F.array().cast("array<struct<start:date,end:date,velocity:double>>").alias("out")).cast(state)

    def step(acc: Column, x: Column) -> Column:
        days = F.datediff(x["d"], acc["d"])
        piece = F.struct(acc["d"].alias("start"), x["d"].alias("end"), ((x["v"] - acc["v"]) / (days / F.lit(365.25))).alias("velocity"))
        return F.when(days >= apart, F.struct(x["d"].alias("d"), x["v"].alias("v"), F.concat(acc["out"], F.array(piece)).alias("out"))).otherwise(acc)

    pieces = series.select(player, F.explode(F.aggregate(F.slice("s", 2, F.size("s")), first, step)["out"]).alias("_p"))
    return pieces.select(player, "_p.start", "_p.end", "_p.velocity")


def own_velocity(df: DataFrame, player: str, date: str, value: str, apart: int = 150) -> DataFrame:
    """(player, own_velocity): the last reading against the latest one ``apart`` days earlier."""
    at = F.struct(F.col(date).alias("d"), F.col(value).alias("v"))
    last = df.groupBy(player).agg(F.max(at).alias("last"))
    before = df.join(last, player).where(F.datediff(F.col("last.d"), F.col(date)) >= apart)
    pair = before.groupBy(player).agg(F.max(at).alias("first"), F.first("last").alias("last"))
    return pair.select(player, ((F.col("last.v") - F.col("first.v")) / (F.datediff("last.d", "first.d") / F.lit(365.25))).alias("own_velocity"))


def late_bloomers(features: DataFrame, age: str = "age", z: str = "mean_z", velocity: str = "recent_velocity", readings: str = "readings") -> DataFrame:
    """Small for their age and growing fast: ages 11 to 18.5, mean z <= -0.9, 3 or more a year."""
    return features.where(F.col(age).between(11, 18.5) & (F.col(readings) >= 3) & (F.col(z) <= -0.9) & (F.col(velocity) >= 3.0))


def maturity_mismatch(height_z: Column, velocity_z: Column) -> Column:
    """Tall for the age but growing slowly, as one who is older than stated."""
    return height_z - velocity_z


def age_misrepresentation(height_z: Column, velocity_z: Column, output_z: Column) -> Column:
    """The rule that a record breaks: growth-led, output-led, growth alone; null if none."""
    growth_led = F.coalesce(maturity_mismatch(height_z, velocity_z) >= 1.8, F.lit(False)) | (velocity_z.isNull() & F.coalesce(height_z >= 1.8, F.lit(False)))
    return (
        F.when(growth_led & (output_z >= 0.5), "growth and output")
        .when((output_z >= 1.25) & (height_z >= 1.0), "output and height")
        .when(growth_led & output_z.isNull(), "growth alone")
    )


def shortest_quarter(df: DataFrame, groups: Sequence[str], value: str, player: str, share: float = 0.25) -> DataFrame:
    """The shortest quarter of each group of four or more, at least one."""
    counts = df.groupBy(*groups, value).agg(F.count("*").alias("_equal"))
    w = Window.partitionBy(*groups)  # of distinct values
    counts = counts.withColumn("_upto", F.sum("_equal").over(w.orderBy(value))).withColumn("_n", F.sum("_equal").over(w))
    counts = counts.where("_n >= 4").withColumn("_k", F.greatest(F.lit(1), F.floor(F.col("_n") * share))).where("_upto - _equal < _k")
    rows = df.join(counts, [*groups, value])
    edge = rows.where("_upto > _k").withColumn("_r", F.row_number().over(Window.partitionBy(*groups, value).orderBy(player)))
    kept = rows.where("_upto <= _k").select(*df.columns)
    return kept.union(edge.where(F.col("_r") <= F.col("_k") - F.col("_upto") + F.col("_equal")).select(*df.columns))


def birth_year_z(df: DataFrame, groups: Sequence[str], born: str, value: str) -> DataFrame:
    """z within the year of birth: a control that is biased against those born late in it."""
    rows = df.withColumn("_year", F.year(born))
    of = rows.groupBy(*groups, "_year").agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    return rows.join(of, [*groups, "_year"]).withColumn("z", (F.col(value) - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0))).drop("_year", "_mean", "_sd")


def output_index(df: DataFrame, player: str, groups: Sequence[str], wide: Sequence[str], metrics: Sequence[str], exposure: str, lower_better: Sequence[str] = (), least: int = 5) -> DataFrame:
    """(player, output): mean log ratio of a player's rates to the group's median rates.

    Counts and exposure are pooled by player. A group of under ``least`` players takes the
    median of the wider one. Half a count is added on both sides; metrics of which less is
    better count negatively.
    """
    pooled = df.groupBy(player, *groups).agg(F.sum(exposure).alias("_e"), *[F.sum(m).alias(m) for m in metrics]).where("_e > 0")
    long = pooled.select(player, *groups, "_e", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("count"), F.lit(-1.0 if m in lower_better else 1.0).alias("sign")) for m in metrics])).alias("m"))
    long = long.select(player, *groups, "_e", "m.*").withColumn("rate", F.col("count") / F.col("_e"))
    narrow = long.groupBy(*groups, "metric").agg(F.median("rate").alias("m1"), F.count("*").alias("n1"))
    broad = long.groupBy(*wide, "metric").agg(F.median("rate").alias("m2"), F.count("*").alias("n2"))
    joined = long.join(narrow, [*groups, "metric"]).join(broad, [*wide, "metric"])
    expected = F.when(F.col("n1") >= least, F.col("m1")).when(F.col("n2") >= least, F.col("m2")) * F.col("_e")
    ratio = F.col("sign") * F.ln((F.col("count") + 0.5) / (expected + 0.5))
    return joined.groupBy(player).agg(F.avg(ratio).alias("output"))
