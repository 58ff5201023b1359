"""Forecasts, shrunk rates, neighbours, shot chances, outliers, growth timing."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import gamma_quantile, negative_binomial_quantile, poisson_quantile
from ..session import cut, written


def curve(df: DataFrame, groups: Sequence[str], age: str, value: str, floor: float, least: int = 5, around: int = 0) -> DataFrame:
    """Points of a curve by half-year of age: (groups, at, median, sd, next_at, next_median, next_sd).

    ``around`` neighbouring half-years on either side are pooled into each that occurs itself.
    """
    rows = df.select(*groups, F.col(value).alias("_v"), (F.bround(F.col(age) / 0.5, 0) * 0.5).alias("at"))
    if around:
        own = rows.select(*groups, "at").distinct()
        near = F.explode(F.array(*[F.col("at") + 0.5 * d for d in range(-around, around + 1)]))
        rows = rows.select(*groups, "_v", near.alias("at")).join(own, [*groups, "at"], "left_semi")
    value = "_v"
    p = rows.groupBy(*groups, "at").agg(F.median(value).alias("median"), F.greatest(F.stddev_pop(value), F.lit(floor)).alias("sd"), F.count("*").alias("n")).where(F.col("n") >= least)
    w = Window.partitionBy(*groups).orderBy("at")
    return p.select(*groups, "at", "median", "sd", F.lead("at").over(w).alias("next_at"), F.lead("median").over(w).alias("next_median"), F.lead("sd").over(w).alias("next_sd"), (F.row_number().over(w) == 1).alias("first"))


def on_curve(rows: DataFrame, points: DataFrame, groups: Sequence[str], age: str, out: str, sd: str | None = None) -> DataFrame:
    """``rows`` with the curve's value (and spread) at an age: straight between points, flat
    beyond the ends. A point's stretch is cut into half-years, so the join is by equal keys."""
    p = points.select(*[F.col(g).alias(f"_{g}") for g in groups], *[F.col(c).alias(f"_{c}") for c in ("at", "median", "sd", "next_at", "next_median", "next_sd")])
    p = points_small(p)
    own = [F.col(g) == F.col(f"_{g}") for g in groups]
    ends = p.groupBy(*[f"_{g}" for g in groups]).agg(F.min("_at").alias("_low"), F.max("_at").alias("_high"))
    half = lambda c: F.round(F.col(c) * 2).cast("int")
    dense = p.withColumn("_half", F.explode(F.sequence(half("_at"), F.coalesce(half("_next_at") - 1, half("_at")))))
    inside = F.greatest(F.least(F.floor(F.col(age) * 2).cast("int"), half("_high")), half("_low"))
    placed = rows.join(F.broadcast(ends), own, "left").withColumn("_of", inside).drop(*[f"_{g}" for g in groups])
    joined = placed.join(F.broadcast(dense), [*own, F.col("_of") == F.col("_half")], "left")
    share = (F.greatest(F.least(F.col(age), F.col("_next_at")), F.col("_at")) - F.col("_at")) / (F.col("_next_at") - F.col("_at"))
    at = lambda a, b: F.when(F.col(b).isNull(), F.col(a)).otherwise(F.col(a) + share * (F.col(b) - F.col(a)))
    joined = joined.withColumn(out, at("_median", "_next_median"))
    joined = joined.withColumn(sd, at("_sd", "_next_sd")) if sd else joined
    return joined.drop(*p.columns, "_low", "_high", "_of", "_half")


def points_small(points: DataFrame, most: int = 100_000) -> DataFrame:
    """Curve points, checked to be few: a half-year of age for each group."""
    points = cut(points)
    if points.count() > most:
        raise ValueError("too many curve points; group by fewer columns")
    return points


def walk_forward(readings: DataFrame, origins: DataFrame, player: str, date: str, value: str, ahead: int = 365, least: int = 2) -> DataFrame:
    """Cases (origin, player, last date and value seen, target date and value).

    Only readings on or before an origin are seen; targets are within ``ahead`` days after it.
    The origins are few and broadcast; the rest is one shuffle by player.
    """
    seen = readings.join(F.broadcast(origins), F.col(date) <= F.col("origin")).groupBy("origin", player).agg(F.max(F.struct(F.col(date).alias("d"), F.col(value).alias("v"))).alias("l"), F.count("*").alias("n")).where(F.col("n") >= least)
    target = readings.select(F.col(player), F.col(date).alias("target_date"), F.col(value).alias("target"))
    j = seen.join(target, player).where((F.col("target_date") > F.col("origin")) & (F.datediff("target_date", "origin") <= ahead))
    return j.select("origin", player, F.col("l.d").alias("last_date"), F.col("l.v").alias("last"), "target_date", "target")


def growth_between(rows: DataFrame, points: DataFrame, groups: Sequence[str], start: str, end: str, out: str, step: float = 0.05) -> DataFrame:
    """``rows`` with the growth that a curve of velocities gives between two ages.

    Midpoint sums over steps of ``step`` years; velocities below 0 count as none. Each distinct
    (groups, start, end) is summed once.
    """
    keys = [*groups, start, end]
    span = F.col(end) - F.col(start)
    n = F.greatest(F.lit(1), F.floor(F.abs(span) / step)).cast("int")
    mids = rows.select(*keys).where(span.isNotNull()).distinct().withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), n - 1)))
    mids = mids.withColumn("_width", span / F.col("_n")).withColumn("_mid", F.col(start) + (F.col("_i") + 0.5) * F.col("_width"))
    total = F.sum(F.greatest(F.coalesce("_rate", F.lit(0.0)), F.lit(0.0)) * F.col("_width"))
    sums = on_curve(mids, points, groups, "_mid", "_rate").groupBy(*keys).agg(total.alias(out))
    return rows.join(sums, keys, "left")


def height_forecasts(readings: DataFrame, velocities: DataFrame, cases: DataFrame, player: str = "player_id", recent: int = 3) -> DataFrame:
    """``cases`` with ``last_value``, ``population``, ``cohort_velocity`` and ``centile``.

    readings: (player, sex, date_of_birth, measured_at, age, value); velocities: (player, sex,
    end, age, velocity); cases: (origin, player, sex, date_of_birth, last_date, last, target_date,
    target). Each origin learns its curves from what ended by then. The population's median at the
    target's age; the last value and the median growth from then on; the median at the target's
    age and as many spreads as the ``recent`` last readings lay off it on average.
    """
    origins = F.broadcast(cases.select("origin").distinct())
    known = readings.join(origins, F.col("measured_at") <= F.col("origin"))
    heights = cut(curve(known, ["origin", "sex"], "age", "value", 1.0, around=1))
    rates = cut(curve(velocities.join(origins, F.col("end") <= F.col("origin")), ["origin", "sex"], "age", "velocity", 0.2, around=1))
    years = lambda c: F.datediff(c, "date_of_birth") / 365.25
    rows = cases.withColumn("_last_age", years("last_date")).withColumn("_age", years("target_date"))
    rows = on_curve(rows, heights, ["origin", "sex"], "_age", "population", "_spread")
    rows = growth_between(rows, rates, ["origin", "sex"], "_last_age", "_age", "_growth")
    w = Window.partitionBy("origin", player).orderBy(F.desc("measured_at"), F.desc("value"))
    latest = known.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= recent)
    z = on_curve(latest, heights, ["origin", "sex"], "age", "_m", "_s").groupBy("origin", player).agg(F.avg((F.col("value") - F.col("_m")) / F.col("_s")).alias("_z"))
    rows = rows.join(z, ["origin", player], "left").withColumn("last_value", F.col("last"))
    rows = rows.withColumn("cohort_velocity", F.col("last") + F.coalesce("_growth", F.lit(0.0))).withColumn("centile", F.col("population") + F.col("_z") * F.col("_spread"))
    return rows.drop("_last_age", "_age", "_spread", "_growth", "_z")


def serving_forecasts(players: DataFrame, errors: DataFrame, horizons: Sequence[int] = (91, 182, 365), stale: int = 365, readings: int = 2) -> DataFrame:
    """(player_id, days, centre, lower, upper, reason): a forecast with its band, or why there is none.

    players: (player_id, group, sex, consent, n, stale_days) and a column ``at_<days>`` for each
    horizon; errors: (group, sex, band, low, high) of forecasts that came true. Without consent,
    date of birth or sex, two readings, a reading within a year or a band for the nearest horizon
    there is a reason; later horizons without a band are left out, and those after them.
    """
    reason = (
        F.when(~F.coalesce("consent", F.lit(False)), "no consent")
        .when(F.col("group").isNull() | F.col("sex").isNull(), "no birth date or sex")
        .when(F.coalesce("n", F.lit(0)) < readings, "too few readings")
        .when(F.col("stale_days") > stale, "last reading too old")
    )
    points = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(d).alias("days"), F.col(f"at_{d}").alias("centre")) for i, d in enumerate(horizons)]))
    rows = players.withColumn("reason", reason).withColumn("_p", points).withColumn("band", horizon_band(F.col("_p.days")))
    rows = rows.join(errors, ["group", "sex", "band"], "left")
    gap = F.min(F.when(F.col("low").isNull() | F.col("_p.centre").isNull(), F.col("_p.k"))).over(Window.partitionBy("player_id"))
    rows = rows.withColumn("_gap", F.coalesce(gap, F.lit(len(horizons)))).withColumn("reason", F.coalesce("reason", F.when(F.col("_gap") == 0, "no band yet")))
    shown = rows.where((F.col("reason").isNotNull() & (F.col("_p.k") == 0)) | (F.col("reason").isNull() & (F.col("_p.k") < F.col("_gap"))))
    some = lambda c, name: F.when(F.col("reason").isNull(), c).alias(name)
    centre = F.col("_p.centre")
    return shown.select("player_id", some(F.col("_p.days"), "days"), some(centre, "centre"), some(centre + F.col("low"), "lower"), some(centre + F.col("high"), "upper"), "reason")


def joint_curve(readings: DataFrame, group: str, player: str, age: str, value: str, rounds: int = 15, settled: float = 0.05, least: int = 5) -> DataFrame:
    """(group, at, median, ..): a curve fitted together with each player's shift and size.

    Shifts and sizes are fitted to the curve; readings are laid on it by them, less their mean
    over the group; each half-year's knot takes the median of what lies within half a year of it
    (of ``least`` or more), and the curve never falls. Until no knot moves by ``settled``.
    """
    readings = written(readings.select(player, group, F.col(age).alias("_age"), F.col(value).alias("_value")))
    age, value = "_age", "_value"
    points = written(curve(readings, [group], age, value, 1.0))
    for _ in range(rounds):
        fits = written(timing_shift(readings, points, group, player, age, value)).join(readings.select(player, group).distinct(), player)
        means = fits.groupBy(group).agg(F.avg("shift").alias("_shift"), F.avg("size").alias("_size"))
        laid = readings.join(fits.drop(group), player).join(means, group)
        laid = laid.select(group, (F.col(age) + F.col("shift") - F.col("_shift")).alias("_a"), (F.col(value) - F.col("size") + F.col("_size")).alias("_v"))
        at = F.explode(F.array(*[(F.floor(F.col("_a") * 2) + d) / 2 for d in (-1, 0, 1, 2)]))
        near = laid.withColumn("at", at).where(F.abs(F.col("_a") - F.col("at")) <= 0.5)
        knots = near.groupBy(group, "at").agg(F.median("_v").alias("_m"), F.count("*").alias("_n")).where(F.col("_n") >= least)
        w = Window.partitionBy(group).orderBy("at")
        new = points.join(knots, [group, "at"], "left").withColumn("_new", F.max(F.coalesce("_m", "median")).over(w))
        new = written(new.select(group, "at", F.col("_new").alias("median"), "sd", "next_at", F.lead("_new").over(w).alias("next_median"), "next_sd", "first", F.abs(F.col("_new") - F.col("median")).alias("_moved")))
        moved = new.agg(F.max("_moved")).first()[0]
        points = new.drop("_moved")
        if moved is None or moved < settled:
            break
    return points


def horizon_band(days: Column) -> Column:
    return F.when(days <= 91, "0-91").when(days <= 182, "92-182").otherwise("183-365")


def error_bands(cases: DataFrame, groups: Sequence[str], least: int = 30) -> DataFrame:
    """(origin, groups, low, high): the middle 80 % of errors known by each origin.

    An error is known at the origins on or after its target's date. Errors are counted by
    value first, so the join of origins is with distinct errors by day.
    """
    e = cases.groupBy(*groups, "target_date", F.round(F.col("target") - F.col("guess"), 3).alias("e")).agg(F.count("*").alias("n"))
    origins = cases.select("origin").distinct()
    known = e.join(F.broadcast(origins), F.col("target_date") <= F.col("origin"))
    g = known.groupBy("origin", *groups).agg(F.expr("percentile(e, 0.1, n)").alias("low"), F.expr("percentile(e, 0.9, n)").alias("high"), F.sum("n").alias("errors"))
    return g.where(F.col("errors") >= least)


def fit_gamma_poisson(counts: np.ndarray, exposure: np.ndarray, n: np.ndarray | float = 1.0) -> tuple[float, float]:
    """(shape, rate) of the prior that makes the counts likeliest: the mean is that of the pool,
    the shape is found by golden section on its logarithm."""
    mean = max((n * counts).sum() / (n * exposure).sum(), 1e-9)
    lg = np.vectorize(math.lgamma)

    def loss(log_shape: float) -> float:
        a = math.exp(log_shape)
        b = a / mean
        return -float(np.sum(n * (lg(counts + a) - math.lgamma(a) + a * math.log(b) - (counts + a) * np.log(b + exposure))))

    low, high, g = math.log(1e-2), math.log(1e4), (math.sqrt(5) - 1) / 2
    c, d = high - g * (high - low), low + g * (high - low)
    fc, fd = loss(c), loss(d)
    for _ in range(60):
        if fc < fd:
            high, d, fd = d, c, fc
            c = high - g * (high - low)
            fc = loss(c)
        else:
            low, c, fc = c, d, fd
            d = low + g * (high - low)
            fd = loss(d)
    shape = math.exp((low + high) / 2)
    return shape, shape / mean


def shrunk_rates(df: DataFrame, groups: Sequence[str], player: str, count: str, exposure: str, least: int = 5) -> DataFrame:
    """(groups, player, raw, estimate, weight, low, high, next_low, next_high).

    Each group's prior is fitted to its counts, first counted by (count, exposure), so a task
    holds distinct pairs, not rows. The interval is the posterior's middle 80 %, the next one
    that of a new count over the same exposure.
    """
    s = df.groupBy(*groups, player).agg(F.sum(count).cast("double").alias("y"), F.sum(exposure).cast("double").alias("e")).where("e > 0")
    pairs = s.groupBy(*groups, "y", "e").agg(F.count("*").alias("n"))
    kinds = ", ".join(f"{g} {dict(s.dtypes)[g]}" for g in groups)

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        y, e = g["y"].to_numpy(), g["e"].to_numpy()
        a, b = fit_gamma_poisson(y, e, g["n"].to_numpy())
        return pd.DataFrame({**{k: [g[k].iloc[0]] for k in groups}, "a": [a], "b": [b], "n": [int(g["n"].sum())]})

    prior = pairs.groupBy(*groups).applyInPandas(fit, f"{kinds}, a double, b double, n long").where(F.col("n") >= least)

    @F.pandas_udf("struct<low:double,high:double,next_low:long,next_high:long>")
    def intervals(a: pd.Series, b: pd.Series, e: pd.Series) -> pd.DataFrame:
        nb = [[negative_binomial_quantile(p, x, r / (r + t)) for x, r, t in zip(a, b, e)] for p in (0.1, 0.9)]
        return pd.DataFrame({"low": gamma_quantile(0.1, a.to_numpy(), b.to_numpy()), "high": gamma_quantile(0.9, a.to_numpy(), b.to_numpy()), "next_low": nb[0], "next_high": nb[1]})

    j = s.join(prior, list(groups)).withColumn("i", intervals(F.col("a") + F.col("y"), F.col("b") + F.col("e"), F.col("e")))
    return j.select(*groups, player, (F.col("y") / F.col("e")).alias("raw"), ((F.col("a") + F.col("y")) / (F.col("b") + F.col("e"))).alias("estimate"), (F.col("e") / (F.col("b") + F.col("e"))).alias("weight"), "i.*")


def poisson_range(mean: Column, low: float = 0.1, high: float = 0.9) -> Column:
    """(low, high) counts of a Poisson mean's middle 80 %."""

    @F.pandas_udf("struct<low:int,high:int>")
    def ranges(m: pd.Series) -> pd.DataFrame:
        x = m.to_numpy(dtype=float)
        return pd.DataFrame({"low": poisson_quantile(low, x).astype("int32"), "high": poisson_quantile(high, x).astype("int32")})

    return ranges(mean)


def finishing(goals: Column, interval: Column) -> Column:
    """Whether goals are more or fewer than chance explains."""
    return F.when(goals > interval["high"], "above").when(goals < interval["low"], "below").otherwise("as expected")


def nearest(vectors: DataFrame, groups: Sequence[str], key: str, columns: Sequence[str], k: int, side: int = 1000, cosine: bool = False) -> DataFrame:
    """(groups, key, other, distance, place): the ``k`` nearest of each row in its group.

    ``cosine``: by 1 less the cosine of unit vectors, to nine digits, else by Euclid; ties by key.

    A group is cut into cells of about ``side`` rows that lie together, along one column after the
    other. A row's ``k`` nearest in its own cell bound how far the others may be, so it asks only
    those cells whose bounding box comes as near: a few, however many there are. Boxes are joined
    by group, as one row of a group's ends; the bests of the cells asked are merged.
    """
    size, n = len(columns), vectors.groupBy(*groups).count()
    rows = vectors.select(*groups, F.col(key).cast("long").alias("key"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    rows = rows.join(n, list(groups)).withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.pow(F.col("count") / side, 1.0 / size))).cast("int")).withColumn("_cell", F.lit(""))
    for i in range(size):  # ends of equal shares, of the rows of each slab of the columns before
        ends = rows.groupBy(*groups, "_cell", "_parts").agg(F.percentile_approx(F.col("v")[i], [j / 64 for j in range(1, 64)], 1000).alias("_ends"))
        end = lambda j: F.get("_ends", F.least(F.round(j * 64 / F.col("_parts")).cast("int") - 1, F.lit(62)))
        at = F.size(F.filter(F.sequence(F.lit(1), F.col("_parts")), lambda j: (j < F.col("_parts")) & (end(j) < F.col("v")[i])))
        rows = rows.join(ends, [*groups, "_cell", "_parts"]).withColumn("_cell", F.concat_ws(".", "_cell", at.cast("string"))).drop("_ends")
    rows = written(rows.select(*groups, "_cell", "key", "v"))
    box = lambda f: F.array(*[f(F.col("v")[i]) for i in range(size)])
    boxes = written(rows.groupBy(*groups, "_cell").agg(box(F.min).alias("low"), box(F.max).alias("high")))
    kinds = ", ".join(f"{g} {dict(vectors.dtypes)[g]}" for g in groups)
    out = f"{kinds}, key long, other long, distance double"

    def best(asks: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        parts, held = [], held.sort_values("key")
        for lo in range(0, len(asks), 1000):
            a, found = asks.iloc[lo : lo + 1000], []
            x, own = np.stack(a["v"]), a["key"].to_numpy()
            for at in range(0, len(held), 4000):  # blocks, as rows that are equal are in one cell
                b = held.iloc[at : at + 4000]
                y, ids = np.stack(b["v"]), b["key"].to_numpy()
                d = np.round(1 - x @ y.T, 9) if cosine else np.sqrt(sum((x[:, i, None] - y[None, :, i]) ** 2 for i in range(size)))
                d[own[:, None] == ids[None, :]] = np.inf
                most = min(k, len(ids)) - 1
                r, c = np.nonzero((d <= np.partition(d, most, axis=1)[:, most, None]) & np.isfinite(d))  # the k nearest and their ties
                found.append(pd.DataFrame({"key": own[r], "other": ids[c], "distance": d[r, c]}))
            if found:
                f = pd.concat(found).sort_values(["key", "distance", "other"])
                parts.append(f[f.groupby("key").cumcount() < k])
        f = pd.concat(parts) if parts else pd.DataFrame({"key": [], "other": [], "distance": []})
        f = f.assign(**{c: (asks if len(asks) else held)[c].iloc[0] for c in groups})
        return f[[*groups, "key", "other", "distance"]]

    by = [*groups, "_cell"]
    first = written(rows.groupBy(*by).applyInPandas(lambda g: best(g, g), out))
    far = first.groupBy(*groups, "key").agg(F.when(F.count("*") >= k, F.max("distance")).alias("_far"))
    reach = F.when(F.col("_far").isNotNull(), F.sqrt(2 * F.greatest(F.col("_far"), F.lit(0.0)) + 1e-8)) if cosine else F.col("_far") * (1 + 1e-9) + 1e-9  # |x - y|^2 of unit vectors is twice the distance
    gap = lambda i: F.greatest(F.col("low")[i] - F.col("v")[i], F.col("v")[i] - F.col("high")[i], F.lit(0.0))
    asking = rows.withColumnRenamed("_cell", "_own").join(far, [*groups, "key"], "left").withColumn("_reach", reach)
    asking = asking.join(F.broadcast(boxes), list(groups)).where("_cell <> _own").where(F.col("_reach").isNull() | (F.sqrt(sum(gap(i) * gap(i) for i in range(size))) <= F.col("_reach")))
    more = written(asking.select(*by, "key", "v")).groupBy(*by).cogroup(rows.groupBy(*by)).applyInPandas(best, out)
    w = Window.partitionBy(*groups, "key").orderBy("distance", "other")
    return first.union(more).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).withColumnRenamed("key", key)


def twin_ranks(vectors: DataFrame, groups: Sequence[str], key: str, twin: str, columns: Sequence[str], side: int = 1000) -> DataFrame:
    """(key, rank, others): how many rows of the group are as near as a row's twin, itself
    included, ties by key; ``others`` is the number of the group's other rows.

    Rows that have their twin in the group ask, with the twin's vector. Each pair of sides is one
    task's matrix product, which counts the nearer rows; counts are added up by row.
    """
    n = vectors.groupBy(*groups).count()
    v = vectors.select(*groups, F.col(key).cast("long").alias("key"), F.col(twin).cast("long").alias("twin"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    rows = v.join(n, list(groups)).withColumn("_sides", F.ceil(F.col("count") / side).cast("int")).withColumn("_side", F.pmod(F.xxhash64("key"), F.col("_sides")).cast("int"))
    found = rows.join(v.select(*groups, F.col("key").alias("twin"), F.col("v").alias("w")), [*groups, "twin"])
    every = F.explode(F.sequence(F.lit(0), F.col("_sides") - 1))
    asks = found.withColumn("_other", every).select(*groups, F.col("_side").alias("i"), F.col("_other").alias("j"), F.lit(True).alias("asks"), "key", "twin", "v", "w", "count")
    held = rows.withColumn("_other", every).select(*groups, F.col("_other"), F.col("_side"), F.lit(False), "key", "twin", "v", F.col("v"), "count")

    def counted(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[g["asks"]], g[~g["asks"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"key": np.zeros(0, dtype=np.int64), "n": np.zeros(0, dtype=np.int64), "others": np.zeros(0, dtype=np.int64)})
        x, y, w = np.stack(a["v"]), np.stack(b["v"]), np.stack(a["w"])
        own = ((x - w) ** 2).sum(1)[:, None]
        d = np.stack([((p - y) ** 2).sum(1) for p in x])
        ids, twins = b["key"].to_numpy()[None, :], a["twin"].to_numpy()[:, None]
        nearer = ((d < own) | ((d == own) & (ids <= twins))) & (ids != a["key"].to_numpy()[:, None])
        return pd.DataFrame({"key": a["key"], "n": nearer.sum(1), "others": a["count"] - 1})

    parts = asks.union(held).groupBy(*groups, "i", "j").applyInPandas(counted, "key long, n long, others long")
    return parts.groupBy(F.col("key").alias(key)).agg(F.sum("n").alias("rank"), F.max("others").alias("others"))


def isolation_scores(df: DataFrame, key: str, columns: Sequence[str], trees: int = 50, sample: int = 256, seed: int = 5) -> DataFrame:
    """(key, score): isolation forest, higher is odder. Trees from small samples, all rows scored."""
    chosen = df.select(*[F.col(c).cast("double") for c in columns]).na.drop().orderBy(F.xxhash64(F.lit(seed), *columns), *columns).limit(sample * 8).toPandas().to_numpy()
    rng = np.random.default_rng(seed)

    def grow(x: np.ndarray, depth: int):
        n = len(x)
        norm = lambda n: 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
        if n <= 1 or depth >= math.ceil(math.log2(max(2, sample))) or (x.max(0) == x.min(0)).all():
            return depth + norm(n)
        f = rng.choice(np.flatnonzero(x.max(0) > x.min(0)))
        at = rng.uniform(x[:, f].min(), x[:, f].max())
        return (int(f), float(at), grow(x[x[:, f] < at], depth + 1), grow(x[x[:, f] >= at], depth + 1))

    forest = [grow(chosen[rng.choice(len(chosen), min(sample, len(chosen)), replace=False)], 0) for _ in range(trees)] if len(chosen) else []
    shared = df.sparkSession.sparkContext.broadcast(forest)
    scale = 2 * (math.log(max(sample, 3) - 1) + 0.5772156649) - 2 * (sample - 1) / sample

    def lengths(x: np.ndarray, node, rows: np.ndarray, out: np.ndarray) -> None:
        if not isinstance(node, tuple):
            out[rows] += node
            return
        f, at, low, high = node
        left = x[rows, f] < at
        lengths(x, low, rows[left], out)
        lengths(x, high, rows[~left], out)

    def scored(batches):
        for b in batches:
            x, out = b[list(columns)].to_numpy(dtype=float), np.zeros(len(b))
            for t in shared.value:
                lengths(x, t, np.arange(len(b)), out)
            yield pd.DataFrame({key: b[key], "score": 2 ** (-out / max(1, len(shared.value)) / scale)})

    kind = dict(df.dtypes)[key]
    return df.select(key, *columns).na.drop().mapInPandas(scored, f"{key} {kind}, score double")


def timing_shift(readings: DataFrame, points: DataFrame, group: str, player: str, age: str, value: str, penalty: float = 4.0, steps: int = 60, width: float = 3.0) -> DataFrame:
    """(player, shift, size, loss): the shift of age at which a player's readings fit the curve.

    ``steps`` shifts on either side; the size offset has a closed form; the loss adds a penalty
    on the shift. Readings are shuffled once, by player, and all shifts of a player's readings are
    laid on the curve together within the task; the curve's points are few.
    """
    shifts = np.array([round(width * i / steps, 4) for i in range(-steps, steps + 1)])
    order = np.lexsort((shifts, np.abs(shifts)))  # of equal losses the shift nearest to none, the lesser
    curves = {g: c.sort_values("at") for g, c in points_small(points).select(group, "at", "median").toPandas().groupby(group)}
    r = readings.where(F.col(age).isNotNull() & F.col(value).isNotNull()).select(player, group, F.col(age).cast("double").alias("_a"), F.col(value).cast("double").alias("_v"))

    def best(d: pd.DataFrame) -> pd.DataFrame:
        d = d[d[group].isin(list(curves))]
        c = np.empty((len(d), len(shifts)))
        for g, at in curves.items():
            mine = (d[group] == g).to_numpy()
            c[mine] = np.interp(d["_a"].to_numpy()[mine][:, None] + shifts[None, :], at["at"], at["median"])
        off = d["_v"].to_numpy()[:, None] - c
        people, start = np.unique(d[player].to_numpy(), return_index=True)  # rows come sorted by player
        if not len(people):
            return pd.DataFrame({player: d[player], "shift": [], "size": [], "loss": []})
        n = np.diff([*start, len(d)])
        size = np.add.reduceat(off, start) / n[:, None]
        loss = np.add.reduceat((off - np.repeat(size, n, axis=0)) ** 2, start) + penalty * shifts**2
        at = order[loss[:, order].argmin(axis=1)]
        rows = np.arange(len(people))
        return pd.DataFrame({player: people, "shift": shifts[at], "size": size[rows, at], "loss": loss[rows, at]})

    def fitted(batches):
        rest = None
        for d in batches:  # a player may go on in the next batch
            d = d if rest is None else pd.concat([rest, d])
            going = (d[player] == d[player].iloc[-1]).to_numpy() if len(d) else np.zeros(0, dtype=bool)
            rest = d[going]
            if not going.all():
                yield best(d[~going])
        if rest is not None and len(rest):
            yield best(rest)

    kind = dict(r.dtypes)[player]
    return r.where(F.col(player).isNotNull()).repartition(player).sortWithinPartitions(player, "_a", "_v").mapInPandas(fitted, f"{player} {kind}, shift double, size double, loss double")


def tree_forecast(known: DataFrame, new: DataFrame, features: Sequence[str], last: str, target: str, trees: int = 20) -> DataFrame:
    """``new`` with ``guess``: the last value plus a boosted forecast of the change."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    v = VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="skip")
    rows = v.transform(known.withColumn("_y", (F.col(target) - F.col(last)).cast("double")))
    model = GBTRegressor(featuresCol="_v", labelCol="_y", maxIter=trees, maxDepth=4, seed=3).fit(rows)
    return model.transform(v.transform(new)).withColumn("guess", F.col(last) + F.col("prediction")).drop("_v", "prediction")
