"""The decision-moment backtest looks at nothing after a cutoff; resampled differences are paired."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pitchlake.operators import backtest, evaluation

SCHEMA = "reading_id long, player_id long, sex string, date_of_birth date, measured_at date, value double, age double"


def readings(seed, change_after=None):
    rng, other = random.Random(seed), random.Random(-seed)
    rows, k = [], 0
    for p in range(120):
        born = dt.date(2008, 1, 1) + dt.timedelta(days=rng.randint(0, 900))
        size, day = rng.gauss(0, 6), dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 90))
        while day < dt.date(2024, 6, 1):
            age = (day - born).days / 365.25
            grown = 120 + 5.5 * (age - 8) + size * (1 if p % 3 else max(0.2, 1.5 - 0.25 * (age - 11))) + rng.gauss(0, 0.4)
            if change_after and day > change_after:
                grown += other.gauss(20, 15)
            rows.append((k, p, "M" if p % 2 else "F", born, day, round(grown, 1), age))
            k += 1
            day += dt.timedelta(days=rng.randint(60, 130))
    return rows


GROUPS = ["sex"]


def snapshot(spark, rows, cutoffs):
    return backtest.snapshots(spark.createDataFrame(rows, SCHEMA), cutoffs, GROUPS, "player_id", "measured_at", "value", "date_of_birth", 0.5)


def test_readings_after_a_cutoff_change_nothing(spark):
    at = dt.date(2022, 5, 1)
    cutoffs = spark.createDataFrame([(at,), (dt.date(2021, 6, 1),)], "cutoff date")
    one, two = (snapshot(spark, readings(4, c), cutoffs).cache() for c in (None, at))
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert one.count() > 150 and key(one) == key(two)
    decided = [key(backtest.decisions(s, GROUPS, "player_id")) for s in (one, two)]
    assert decided[0] == decided[1] and len(decided[0]) > 10
    rows = spark.createDataFrame(readings(4), SCHEMA)
    judged = backtest.outcomes(backtest.decisions(one, GROUPS, "player_id"), rows, GROUPS, "player_id", "measured_at", "value", 0.5)
    assert judged.where("caught_up").count() > 0 and judged.where("not caught_up").count() > 0
    other = backtest.outcomes(backtest.decisions(one, GROUPS, "player_id"), rows.where(F.col("measured_at") < F.date_add(F.lit(at), 30)), GROUPS, "player_id", "measured_at", "value", 0.5)
    assert other.where(F.col("cutoff") == F.lit(at)).where("z_change is not null").count() == 0


def test_cutoffs_leave_a_year_on_both_sides(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1),), (dt.date(2022, 6, 1),)], "d date")
    got = [r[0] for r in backtest.cutoffs(df, "d").orderBy("cutoff").collect()]
    assert got == [dt.date(2020, 12, 31), dt.date(2021, 4, 1)]
    assert backtest.cutoffs(df.limit(1), "d").count() == 0 and backtest.cutoffs(df.limit(0), "d").count() == 0


def test_pooled_shares_are_of_pooled_counts(spark):
    rows = [("x", True, 1.0, True)] * 3 + [("x", False, 0.9, True)] + [("y", True, 0.1, False), ("y", False, None, None)]
    df = spark.createDataFrame(rows, "dataset string, flagged boolean, z_change double, caught_up boolean")
    got = {r["dataset"]: r for r in backtest.summary(df, "dataset").collect()}
    assert {k: tuple(v)[1:7] for k, v in got.items()} == {"x": (4, 3, 4, 4, 3, 0), "y": (2, 1, 1, 0, 0, 1), "all": (6, 4, 5, 4, 3, 1)}
    assert got["y"]["low"] is None and got["all"]["low"] == pytest.approx(got["x"]["low"])


def test_the_interval_of_a_difference_is_paired(spark):
    """Clusters differ much from each other, the models little: the interval covers the planted
    difference and is far narrower than that of one model's loss."""
    covered = 0
    for seed in range(6):
        rng, rows = random.Random(seed), [(999, None, 1.0)]
        for cluster in range(300):
            hard = rng.gauss(5, 3)
            rows += [(cluster, hard + 0.2 + rng.gauss(0, 0.3), hard + rng.gauss(0, 0.3)) for _ in range(rng.randint(1, 20))]
        df = spark.createDataFrame(rows, "match long, a double, b double")
        r = evaluation.paired_bootstrap(df, "match", "a", "b", 400).first()
        assert r["high"] - r["low"] < 0.06 and r["low"] < r["difference"] < r["high"]
        covered += r["low"] < 0.2 < r["high"]
    assert covered >= 5
    alone = evaluation.bootstrap(df.groupBy("match").agg(F.sum("a").alias("a"), F.count("a").alias("n")), "match", "a", "n", 400).first()
    assert alone["high"] - alone["low"] > 5 * (r["high"] - r["low"])
    again = evaluation.paired_bootstrap(df.repartition(7), "match", "a", "b", 400).first()
    assert tuple(again) == pytest.approx(tuple(r))
