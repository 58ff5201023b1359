"""Mid-rank percentiles and what is shown with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def midrank(df: DataFrame, groups: Sequence[str], value: str, out: str = "percentile", include_self: bool = True, higher_better: bool = True) -> DataFrame:
    """``df`` with the mid-rank percentile (1 to 99) of ``value`` in its group.

    round(100 (below + equal / 2) / n), half to even. Without the row itself, it is left out of
    the equal ones and of n; a row alone has none. Nulls have none and don't count. The ranks
    come from counts by distinct value, so a large group's window holds its distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_equal"))
    w = Window.partitionBy(*groups)
    counts = counts.withColumn("_below", F.coalesce(F.sum("_equal").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_equal").over(w))
    mine = 0 if include_self else 1
    below = F.col("_below") if higher_better else F.col("_n") - F.col("_below") - F.col("_equal")
    n = F.col("_n") - mine
    p = F.bround(100.0 * (below + (F.col("_equal") - mine) / 2.0) / F.nullif(n, F.lit(0)), 0).cast("int")
    keys = [*groups, value]
    ranked = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.when(n > 0, F.greatest(F.least(p, F.lit(99)), F.lit(1))).alias(out), n.alias(f"{out}_of"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(ranked, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def half_quantiles(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """p25, p50 and p75: medians of the list and of its halves, the middle left out when odd."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_equal"))
    w = Window.partitionBy(*groups)  # of distinct values
    counts = counts.withColumn("_upto", F.sum("_equal").over(w.orderBy("_v"))).withColumn("_n", F.sum("_equal").over(w))
    half = F.greatest(F.floor(F.col("_n") / 2), F.lit(1))

    def at(place: Column) -> Column:
        """The value at a place of the sorted list, from 1."""
        return F.max(F.when((F.col("_upto") >= place) & (F.col("_upto") - F.col("_equal") < place), F.col("_v")))

    def median(first: Column, size: Column) -> Column:
        return (at(first + F.floor((size + 1) / 2)) + at(first + F.floor(size / 2 + 1))) / 2

    zero = F.lit(0)
    return counts.groupBy(*groups).agg(median(zero, half).alias("p25"), median(zero, F.col("_n")).alias("p50"), median(F.col("_n") - half, half).alias("p75"), F.max("_n").alias("n"))


def widened(df: DataFrame, groups: Sequence[str], age: str, least: int = 8, spreads: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """(groups, age, spread, peers): the first spread of ages that gives ``least`` or more rows."""
    n = df.groupBy(*groups, age).agg(F.count("*").alias("_n"))
    keys = n.select(*groups, F.col(age).alias("_own"))
    near = n.select(*groups, F.explode(F.array(*[F.struct((F.col(age) + d).alias("_own"), F.lit(abs(d)).alias("_far")) for d in range(-max(spreads), max(spreads) + 1)])).alias("x"), "_n").select(*groups, "x._own", "x._far", "_n")
    sums = near.join(keys, [*groups, "_own"], "left_semi").groupBy(*groups, "_own").agg(*[F.sum(F.when(F.col("_far") <= s, F.col("_n"))).alias(f"_s{s}") for s in spreads])
    spread, peers = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s in reversed(list(spreads)):
        spread, peers = F.when(F.col(f"_s{s}") >= least, s).otherwise(spread), F.when(F.col(f"_s{s}") >= least, F.col(f"_s{s}")).otherwise(peers)
    return sums.select(*groups, F.col("_own").alias(age), spread.alias("spread"), peers.alias("peers"))


def cohort_percentile(df: DataFrame, groups: Sequence[str], age: str, value: str, least: int = 8) -> DataFrame:
    """Percentile among the exact age if it has ``least`` rows, else with the neighbouring ages.

    None below ``least``. ``span`` is 0 or 1.
    """
    band = widened(df, groups, age, least, (0, 1)).select(*groups, age, F.col("spread").alias("span"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, age, value).agg(F.count("*").alias("_m"))
    pooled = counts.select(*groups, F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_d"), age, value, "_m").select(*groups, (F.col(age) + F.col("_d")).alias(age), F.abs("_d").alias("_d"), value, "_m")
    pool = pooled.join(band.where("span is not null"), [*groups, age]).where("_d <= span").groupBy(*groups, age, value).agg(F.sum("_m").alias("_m"))
    w = Window.partitionBy(*groups, age)
    pool = pool.withColumn("_below", F.coalesce(F.sum("_m").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_m").over(w))
    p = F.bround(100.0 * (F.col("_below") + F.col("_m") / 2.0) / F.col("_n"), 0).cast("int")
    pool = pool.select(*groups, age, value, F.greatest(F.least(p, F.lit(99)), F.lit(1)).alias("percentile"))
    return df.join(band, [*groups, age], "left").join(pool, [*groups, age, value], "left")


def leaders(df: DataFrame, groups: Sequence[str], value: str, player: str, top: int = 5) -> DataFrame:
    """The first ``top`` of each group with their percentile and the group's median."""
    ranked = midrank(df, groups, value)
    w = Window.partitionBy(*groups)
    ranked = ranked.withColumn("rank", F.row_number().over(w.orderBy(F.desc(value), player)))
    medians = df.groupBy(*groups).agg(F.median(value).alias("median"))
    return ranked.where(F.col("rank") <= top).join(medians, list(groups))


def quarter_filter(df: DataFrame, groups: Sequence[str], value: str, top: bool = True) -> DataFrame:
    """The rows of the better (or lower) quarter by percentile."""
    ranked = midrank(df, groups, value)
    return ranked.where(F.col("percentile") >= 75 if top else F.col("percentile") <= 25)
