"""Scores of flags, forecasts and rankings against the truth."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import chi_square_tail_3


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of a share; null without trials."""
    p = F.try_divide(hits, F.nullif(n, F.lit(0)))
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)


def confusion(population: DataFrame, predicted: DataFrame, actual: DataFrame, key: str, groups: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 over a closed population; other ids don't count."""
    p, a = predicted.select(key).distinct().withColumn("_p", F.lit(True)), actual.select(key).distinct().withColumn("_a", F.lit(True))
    x = population.join(p, key, "left").join(a, key, "left").fillna(False, ["_p", "_a"])
    return counted(x, F.col("_p"), F.col("_a"), groups)


def counted(df: DataFrame, predicted: Column, actual: Column, groups: Sequence[str] = ()) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    g = df.groupBy(*groups).agg(n(predicted & actual).alias("tp"), n(predicted & ~actual).alias("fp"), n(~predicted & actual).alias("fn"), n(~predicted & ~actual).alias("tn"))
    share = lambda a, b: F.try_divide(F.col(a), F.nullif(F.col(a) + F.col(b), F.lit(0)))
    g = g.withColumn("precision", share("tp", "fp")).withColumn("recall", share("tp", "fn"))
    return g.withColumn("f1", F.try_divide(2.0 * F.col("tp"), F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))))


def errors(df: DataFrame, truth: str, guess: str, groups: Sequence[str] = ()) -> DataFrame:
    """n, missing, mean absolute and root mean square error, bias (guess minus truth)."""
    e = F.col(guess) - F.col(truth)
    return df.where(F.col(truth).isNotNull()).groupBy(*groups).agg(F.count(guess).alias("n"), F.count(F.when(F.col(guess).isNull(), 1)).alias("missing"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))


def errors_by(df: DataFrame, truth: str, guess: str, cuts: Sequence[str]) -> DataFrame:
    """The errors over all and by each of ``cuts``, as one pass over grouping sets."""
    e = F.col(guess) - F.col(truth)
    sets = [[F.col(c)] for c in cuts] + [[]]
    g = df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()).groupingSets(sets, *[F.col(c) for c in cuts])
    return g.agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"))


#: The chances of at most 0, 1, .. 5 of a Poisson number of mean 1.
POISSON_STEPS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)


def resampled(clusters: DataFrame, key: str, times: int, seed: int) -> DataFrame:
    """``clusters`` once for each resampling ``t``, with its weight ``w`` there: a Poisson(1) number
    drawn from a hash of both, so it doesn't depend on how the rows are dealt."""
    rows = clusters.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(times))))
    hashed = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col("t").cast("string"))), 1, 7)
    u = (F.conv(hashed, 16, 10).cast("long") + 0.5) / float(1 << 28)
    return rows.withColumn("w", sum(((u > b).cast("int") for b in POISSON_STEPS), F.lit(0)))


def bootstrap(clusters: DataFrame, key: str, top: str, bottom: str, times: int = 200, seed: int = 3) -> DataFrame:
    """(low, high) of the ratio of sums, from ``times`` resamplings of whole clusters."""
    r = resampled(clusters, key, times, seed).groupBy("t").agg((F.sum(F.col(top) * F.col("w")) / F.nullif(F.sum(F.col(bottom) * F.col("w")), F.lit(0))).alias("r"))
    return r.agg(F.expr("percentile(r, 0.025)").alias("low"), F.expr("percentile(r, 0.975)").alias("high"))


def paired_bootstrap(rows: DataFrame, cluster: str, first: str, second: str, times: int = 1000, seed: int = 5) -> DataFrame:
    """(difference, low, high): mean of ``first`` less that of ``second``, losses of two models on the
    same rows, with the middle 95 % over ``times`` resamplings of whole clusters.

    Both models have the same clusters in a resampling, so what makes some clusters harder for
    both cancels out. A cluster is one row before it is resampled.
    """
    d = rows.where(F.col(first).isNotNull() & F.col(second).isNotNull()).withColumn("_d", F.round(F.col(first) - F.col(second), 9).cast("decimal(28,9)"))
    sums = d.groupBy(cluster).agg(F.sum("_d").cast("double").alias("d"), F.count("*").alias("n"))
    whole = sums.agg((F.sum("d") / F.sum("n")).alias("difference"))
    return whole.join(bootstrap(sums, cluster, "d", "n", times, seed))


def fairness(df: DataFrame, quarter: str, flagged: str, positive: str) -> DataFrame:
    """By birth quarter: rows, flagged, false-positive rate; chi-square of flags and its p."""
    g = df.groupBy(quarter).agg(F.count("*").alias("n"), F.count(F.when(F.col(flagged), 1)).alias("flagged"), F.try_divide(F.count(F.when(F.col(flagged) & ~F.col(positive), 1)), F.nullif(F.count(F.when(~F.col(positive), 1)), F.lit(0))).alias("false_positive_rate"))
    w = Window.partitionBy()
    share = F.sum("flagged").over(w) / F.sum("n").over(w)
    e, o = F.col("n") * share, F.col("flagged")
    part = (o - e) * (o - e) / F.nullif(e, F.lit(0.0)) + (o - e) * (o - e) / F.nullif(F.col("n") - e, F.lit(0.0))

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(chi_square_tail_3, na_action="ignore")

    g = g.withColumn("chi_square", F.sum(part).over(w))  # four rows
    return g.withColumn("p", tail(F.col("chi_square")))


def auc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Area under the curve from rank sums, ties at their mean rank, by distinct score."""
    g = df.groupBy(score).agg(F.count("*").alias("n"), F.count(F.when(F.col(truth), 1)).alias("pos"))
    r = running(g, score, "n", "below").withColumn("rank", F.col("below") + (F.col("n") + 1) / 2.0).agg(F.sum(F.col("rank") * F.col("pos")).alias("s"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return r.select(((F.col("s") - F.col("p") * (F.col("p") + 1) / 2.0) / F.nullif(F.col("p") * F.col("q"), F.lit(0))).alias("auc"))


def running(df: DataFrame, order: str, value: str, out: str, parts: int = 200) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before, by ``order`` (distinct, not null).

    Rows are cut into parts at quantiles of ``order``; the parts' sums are added up first, so no
    task orders all rows.
    """
    bounds = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 1000)).first()[0] or []
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(order))) if bounds else F.lit(0)
    rows = df.withColumn("_part", part)
    sums = rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of as many rows as parts
    rows = rows.join(F.broadcast(sums.select("_part", before.alias("_before"))), "_part")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn(out, F.col("_before") + inside).drop("_part", "_before")


def forecast_scores(df: DataFrame, score: str, truth: str, bins: int = 10) -> DataFrame:
    """n, positives, Brier score, log loss and the calibration error over bins of equal counts.

    Rows are put in bins by the number of rows of lower scores; equal scores share a bin.
    """
    g = df.groupBy(score).agg(F.count("*").alias("n"), F.count(F.when(F.col(truth), 1)).alias("pos"))
    total = g.agg(F.sum("n")).first()[0] or 0
    p = F.least(F.greatest(F.col(score), F.lit(1e-12)), F.lit(1 - 1e-12))
    y = F.col("pos")
    b = running(g, score, "n", "below").withColumn("bin", F.floor(F.col("below") * bins / F.lit(max(total, 1))))
    b = b.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum(F.col(score) * F.col("n")).alias("s"), F.sum((1 - p) * (1 - p) * y + p * p * (F.col("n") - y)).alias("b"), F.sum(-(F.ln(p) * y + F.ln(1 - p) * (F.col("n") - y))).alias("l"))
    n = F.sum("n")
    return b.agg(n.alias("n"), F.sum("pos").alias("positives"), (F.sum("b") / n).alias("brier"), (F.sum("l") / n).alias("log_loss"), (F.sum(F.abs(F.col("s") - F.col("pos"))) / n).alias("calibration_error"))


def mean_rank(df: DataFrame, groups: Sequence[str], value: str, out: str) -> DataFrame:
    """``df`` with the mean rank of ``value`` in its group (ties share the mean)."""
    counts = df.groupBy(*groups, value).agg(F.count("*").alias("_equal"))
    upto = F.sum("_equal").over(Window.partitionBy(*groups).orderBy(value))  # of distinct values
    keys = [*groups, value]
    ranks = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (upto - (F.col("_equal") - 1) / 2.0).alias(out))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(ranks, same).drop(*[f"_k{i}" for i in range(len(keys))])


def spearman(df: DataFrame, groups: Sequence[str], x: str, y: str) -> DataFrame:
    """Spearman's correlation by group."""
    r = mean_rank(mean_rank(df, groups, x, "_x"), groups, y, "_y")
    return r.groupBy(*groups).agg(F.corr("_x", "_y").alias("spearman"), F.count("*").alias("n"))


def spearman_brown(r: Column) -> Column:
    """The reliability of a whole from the correlation of its halves."""
    return F.when(r > -1, 2 * r / (1 + r)).otherwise(-1.0)


def split_half(halves: DataFrame, keys: Sequence[str], group: str, metric: str, first: str, second: str, weight: str, threshold: float, least: int = 3) -> DataFrame:
    """(metric, r, reliability, n): how well the first half of a season tells the second.

    Rows with half the threshold's weight in each half count; values are standardised within the
    group, groups of under ``least`` rows left out.
    """
    x = halves.where((F.col(weight) >= threshold / 2) & F.col(first).isNotNull() & F.col(second).isNotNull())
    of = x.groupBy(group, metric).agg(F.count("*").alias("_n"), *[f(c).alias(f"_{n}_{c}") for c in (first, second) for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]).where(F.col("_n") >= least)
    z = lambda c: F.when(F.col(f"_sd_{c}") > 0, (F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_sd_{c}")).otherwise(0.0)
    r = x.join(of, [group, metric]).select(metric, z(first).alias("a"), z(second).alias("b")).groupBy(metric).agg(F.corr("a", "b").alias("r"), F.count("*").alias("n"))
    return r.withColumn("reliability", spearman_brown(F.col("r")))


def smallest_reliable(reliabilities: DataFrame, threshold: str, value: str, target: float = 0.7) -> DataFrame:
    """The least threshold whose median reliability reaches the target; no row if none does."""
    m = reliabilities.groupBy(threshold).agg(F.median(value).alias("median")).where(F.col("median") >= target)
    return m.agg(F.min_by(F.struct(threshold, "median"), threshold).alias("m")).where("m is not null").select("m.*")


def bottom_kept(df: DataFrame, groups: Sequence[str], key: str, first: str, second: str) -> DataFrame:
    """Of each group's bottom third by the first value, the share also there by the second."""
    w = Window.partitionBy(*groups)
    n = F.count("*").over(w)
    r = df.withColumn("_third", F.floor(n / 3)).withColumn("_a", F.row_number().over(w.orderBy(first, key))).withColumn("_b", F.row_number().over(w.orderBy(second, key)))
    both = F.count(F.when((F.col("_a") <= F.col("_third")) & (F.col("_b") <= F.col("_third")), 1))
    return r.groupBy(*groups).agg((both / F.greatest(F.lit(1), F.max("_third"))).alias("kept"), F.count("*").alias("n"))


def neighbour_quality(near: DataFrame, rows: DataFrame, groups: Sequence[str], key: str, role: str, level: str, k: int) -> DataFrame:
    """(key, same_role, chance, gap, random_gap): how alike a row's neighbours are.

    near: (key, other); rows: (groups, key, role, level). The share of neighbours of one's role
    and that of the group's others; the mean difference of level from the neighbours and from
    all others. The latter comes from sums over distinct levels, not from pairs; levels that are
    decimals are added up exactly and divided last.
    """
    mean = lambda total, n: total.cast("double") / n
    o = rows.select(F.col(key).alias("other"), F.col(role).alias("_role"), F.col(level).alias("_level"))
    own = near.select(key, "other").join(rows.select(*groups, key, role, level), key).join(o, "other")
    found = own.groupBy(*groups, key).agg(F.avg((F.col(role) == F.col("_role")).cast("double")).alias("same_role"), mean(F.sum(F.abs(F.col(level) - F.col("_level"))), F.count("*")).alias("gap"), F.count("*").alias("_k")).where(F.col("_k") >= k)
    n = rows.groupBy(*groups).agg(F.count("*").alias("_n"), F.sum(level).alias("_sum"))
    same = rows.groupBy(*groups, role).agg(F.count("*").alias("_same"))
    w = Window.partitionBy(*groups).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)  # of distinct levels
    d = rows.groupBy(*groups, level).agg(F.count("*").alias("_m"))
    d = d.select(*groups, level, "_m", F.coalesce(F.sum("_m").over(w), F.lit(0)).alias("_below"), F.coalesce(F.sum(F.col(level) * F.col("_m")).over(w), F.lit(0)).alias("_below_sum"))
    x = rows.join(n, list(groups)).join(same, [*groups, role]).join(d, [*groups, level])
    a = F.col(level)
    above, above_sum = F.col("_n") - F.col("_below") - F.col("_m"), F.col("_sum") - F.col("_below_sum") - a * F.col("_m")
    total = a * F.col("_below") - F.col("_below_sum") + above_sum - a * above
    others = F.nullif(F.col("_n") - 1, F.lit(0))
    pool = x.select(*groups, key, ((F.col("_same") - 1) / others).alias("chance"), mean(total, others).alias("random_gap"))
    return found.drop("_k").join(pool, [*groups, key])


def thirds_agreement(df: DataFrame, groups: Sequence[str], key: str, verdict: str, truth: str) -> DataFrame:
    """(verdict, n, hits): of 'Shortlist' those in the top third of truth of their group, of
    'Not now' those in the bottom third; ties with the third's edge count."""
    w = Window.partitionBy(*groups)
    r = df.withColumn("_third", F.floor(F.count("*").over(w) / 3)).withColumn("_r", F.row_number().over(w.orderBy(truth, key))).withColumn("_d", F.row_number().over(w.orderBy(F.desc(truth), key)))
    edges = r.groupBy(*groups).agg(F.max(F.when(F.col("_r") == F.col("_third"), F.col(truth))).alias("_low"), F.max(F.when(F.col("_d") == F.col("_third"), F.col(truth))).alias("_high"))
    x = r.join(edges, list(groups))
    hit = ((F.col(verdict) == "Shortlist") & (F.col(truth) >= F.col("_high"))) | ((F.col(verdict) == "Not now") & (F.col(truth) <= F.col("_low")))
    return x.groupBy(verdict).agg(F.count("*").alias("n"), F.count(F.when(hit, 1)).alias("hits"))


def poisson_deviance(y: Column, mean: Column) -> Column:
    """Deviance of a count against its mean; a count of 0 has no logarithm."""
    return 2 * (F.when(y > 0, y * F.ln(y / mean)).otherwise(0.0) - (y - mean))
