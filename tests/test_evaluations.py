"""Forecasts, refits, nets, scores, sources and streams on small invented rows."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.functions import people as names
from pitchlake.operators import cohorts, evaluation, feed, linkage, matches, models, people, seasons
from pitchlake.sources import io
from pitchlake.streaming import jobs

D = dt.date


def test_growth_of_six_a_year_is_forecast(spark):
    rng = random.Random(1)
    rows = []
    for k in range(40):
        born = D(2008, 1, 1) + dt.timedelta(days=rng.randint(0, 900))
        first = D(2019, 1, 1) + dt.timedelta(days=rng.randint(0, 30))
        for i in range(19):
            day = first + dt.timedelta(days=60 * i)
            age = (day - born).days / 365.25
            rows.append((k, "M", born, day, age, 80 + 6 * age))
    readings = spark.createDataFrame(rows, "player_id long, sex string, date_of_birth date, measured_at date, age double, value double")
    v = cohorts.spaced_velocities(readings.select("player_id", "measured_at", "value"), "player_id", "measured_at", "value")
    born = readings.select("player_id", "sex", "date_of_birth").distinct()
    v = v.join(born, "player_id").withColumn("age", (F.datediff("start", "date_of_birth") + F.datediff("end", "date_of_birth")) / 2 / 365.25)
    origins = spark.createDataFrame([(D(2021, 1, 1),)], "origin date")
    cases = models.walk_forward(readings, origins, "player_id", "measured_at", "value").join(born, "player_id")
    got = models.height_forecasts(readings, v, cases).collect()
    assert len(got) > 100
    for r in got:
        assert abs(r["cohort_velocity"] - r["target"]) <= 0.3
        assert r["last_value"] == r["last"]
    off = lambda c: sum(abs(r[c] - r["target"]) for r in got) / len(got)
    assert off("cohort_velocity") < 0.3 < off("centile") < off("population")
    later = readings.withColumn("value", F.when(F.col("measured_at") > "2021-01-01", 0.0).otherwise(F.col("value")))
    again = {(r["player_id"], r["target_date"]): r for r in models.height_forecasts(later, v, cases).collect()}
    assert all(again[r["player_id"], r["target_date"]]["population"] == r["population"] for r in got)


def test_forecasts_say_why_there_is_none(spark):
    rows = [(1, "youth", "M", True, 3, 10), (2, "youth", "M", False, 3, 10), (3, "youth", None, True, 3, 10), (4, "adult", "M", True, 1, 10), (5, "adult", "M", True, 3, 400), (6, "adult", "F", True, 3, 10)]
    p = spark.createDataFrame(rows, "player_id long, group string, sex string, consent boolean, n long, stale_days int").withColumns({f"at_{d}": F.lit(150.0) for d in (91, 182, 365)})
    e = spark.createDataFrame([("youth", "M", "0-91", -1.0, 2.0), ("youth", "M", "183-365", -1.0, 2.0), ("adult", "M", "0-91", -1.0, 1.0)], "group string, sex string, band string, low double, high double")
    got = {(r["player_id"], r["days"]): (r["lower"], r["upper"], r["reason"]) for r in models.serving_forecasts(p, e).collect()}
    assert got == {(1, 91): (149.0, 152.0, None), (2, None): (None, None, "no consent"), (3, None): (None, None, "no birth date or sex"), (4, None): (None, None, "too few readings"), (5, None): (None, None, "last reading too old"), (6, None): (None, None, "no band yet")}


def test_a_joint_curve_recovers_planted_shifts(spark):
    rng = random.Random(3)
    height = lambda a: 100 + 5 * a + 20 / (1 + math.exp(-2 * (a - 13)))
    rows = []
    for k in range(60):
        late = rng.choice([-1.0, 0.0, 1.0])
        for i in range(8):
            age = 9 + i + rng.random()
            rows.append((k, "M", age, height(age - late), late))
    r = spark.createDataFrame(rows, "player_id long, sex string, age double, value double, late double")
    points = models.joint_curve(r.drop("late"), "sex", "player_id", "age", "value", rounds=3)
    medians = [x["median"] for x in points.orderBy("at").collect()]
    assert medians == sorted(medians)
    fit = models.timing_shift(r.drop("late"), points, "sex", "player_id", "age", "value").join(r.select("player_id", "late").distinct(), "player_id")
    assert fit.agg(F.corr("shift", "late")).first()[0] < -0.8  # a late player is laid on the curve by a shift back


def test_fits_by_month_and_gender_are_fits_of_their_own(spark):
    rng = random.Random(5)
    rows = [(D(2020, 1 + i // 30, 5), *rng.sample(range(6), 2), rng.randint(22, 40), rng.randint(5, 21)) for i in range(90)]
    m = spark.createDataFrame(rows, "played date, winner long, loser long, high long, low long")
    together = {(r["month"], r["player_id"]): r["theta"] for r in matches.bradley_terry(matches.before_each_month(m), by=["month"]).collect()}
    alone = {r["player_id"]: r["theta"] for r in matches.bradley_terry(m.where("played < '2020-03-01'")).collect()}
    assert {k[0] for k in together} == {D(2020, 2, 1), D(2020, 3, 1)}
    assert all(abs(together[D(2020, 3, 1), p] - t) < 1e-4 for p, t in alone.items())
    o = matches.with_outsiders(m, lambda p: p > 3, lambda p: -1 - p % 2)
    assert not o.where("winner > 3 or loser > 3").count() and o.where("winner < 0 or loser < 0").count()


def test_groups_in_rounds_equal_links_in_order(spark):
    rng = random.Random(9)
    pairs = {}
    for _ in range(160):
        a, b = sorted(rng.sample(range(40), 2))
        pairs[a, b] = (round(rng.random(), 6), rng.random() < 0.25)
    df = spark.createDataFrame([(a, b, p, c) for (a, b), (p, c) in pairs.items()], "a long, b long, probability double, conflict boolean")
    group, members = {}, {}
    bad = {k for k, (_, c) in pairs.items() if c}
    links = sorted((-p, a, b) for (a, b), (p, c) in pairs.items() if p >= 0.5 and not c)
    for _, a, b in links:
        for i in (a, b):
            if i not in group:
                group[i], members[i] = i, {i}
    for _, a, b in links:
        x, y = group[a], group[b]
        if x != y and not any((min(i, j), max(i, j)) in bad for i in members[x] for j in members[y]):
            members[min(x, y)] |= members.pop(max(x, y))
            for i in members[min(x, y)]:
                group[i] = min(x, y)
    assert {r["id"]: r["group"] for r in linkage.greedy_groups(df, "conflict").collect()} == group


def test_reviewers_verdicts_are_followed(spark):
    rng = random.Random(7)
    rows = [(i, rng.uniform(-2, 2), None if i % 5 == 0 else rng.random()) for i in range(200)]
    x = spark.createDataFrame(rows, "id long, z double, v double")
    kept = {r["id"] for r in people.taught_filter(x.where("id < 120").withColumn("ok", F.col("z") < 0), x, ["z", "v"], "ok").collect()}
    wrong = sum((r[1] < 0) != (r[0] in kept) for r in rows)
    assert wrong <= 10
    assert people.taught_filter(x.withColumn("ok", F.lit(False)), x, ["z"], "ok").count() == 0
    assert people.taught_filter(x.withColumn("ok", F.lit(True)), x, ["z"], "ok").count() == 200
    assert people.taught_filter(x.limit(0).withColumn("ok", F.lit(True)), x, ["z"], "ok").count() == 200


def test_running_sums_and_tails(spark):
    rng = random.Random(2)
    scores = sorted({round(rng.random(), 3) for _ in range(300)})
    df = spark.createDataFrame([(s, i % 4 + 1) for i, s in enumerate(scores)], "s double, n long")
    got = {r["s"]: r["b"] for r in evaluation.running(df, "s", "n", "b", parts=7).collect()}
    total = 0
    for i, s in enumerate(scores):
        assert got[s] == total
        total += i % 4 + 1
    assert evaluation.running(df.limit(0), "s", "n", "b").count() == 0
    q = spark.createDataFrame([(k, f, f) for k, n, hits in ((1, 100, 30), (2, 100, 20), (3, 100, 10), (4, 100, 20)) for f in [True] * hits + [False] * (n - hits)], "quarter int, flagged boolean, positive boolean")
    r = evaluation.fairness(q, "quarter", "flagged", "positive").first()
    assert r["chi_square"] == pytest.approx(12.5) and r["p"] == pytest.approx(0.00586, abs=1e-5)


def test_names_and_evidence(spark):
    df = spark.createDataFrame([("all", "conflict", "unknown"), ("most", "unknown", "same")], "name string, dob string, sport string")
    got = [r[0] for r in df.select(names.evidence({c: F.col(c) for c in ("name", "dob", "sport")})).collect()]
    assert got == [["Every word of the shorter name after the given one is in the other", "Dates of birth disagree"], ["Most words after the given name match", "A date of birth is missing", "Same sport"]]
    assert spark.range(1).select(names.exact_form(F.lit("  Al \t Ahly SC "))).first()[0] == "al ahly sc"


def test_rates_and_shot_kinds(spark):
    s = spark.createDataFrame([(900, 10), (90, 2)], "minutes int, goals int")
    assert [r["goals_90"] for r in seasons.per_90(s, "minutes", ["goals"]).orderBy("minutes").collect()] == [None, 1.0]
    k = spark.createDataFrame([("Penalty", None), ("Free Kick", None), ("Open Play", "From Corner"), ("Open Play", "From Throw In"), ("Open Play", "Regular Play")], "kind string, pattern string")
    assert [r[0] for r in k.select(feed.shot_situation(F.col("kind"), F.col("pattern"))).collect()] == ["penalty", "free kick", "corner", "set piece", "open play"]


def test_import_verdicts(spark):
    rows = [("Ali", "2010-01-02", "yes", "150,5", "2024-01-01"), ("=cmd", None, None, None, None), ("Mo", "2010-13-02", None, None, None), ("Mo", None, "perhaps", None, None), ("Mo", None, None, "tall", "2024-01-01"), ("Mo", None, None, "150", None)]
    df = spark.createDataFrame(rows, "name string, born string, guardian string, height string, height_date string")
    verdict = io.import_verdict({c: F.col(c) for c in df.columns}, "born", "guardian", "height", "height_date")
    assert [r[0] for r in df.select(verdict).collect()] == ["ready", "rejected", "rejected", "confirm", "rejected", "rejected"]


def test_tables_and_caches_are_written_and_read(spark, tmp_path):
    io.write_tables({"a": spark.range(3), "b": spark.range(2)}, str(tmp_path / "out"))
    assert spark.read.parquet(f"{tmp_path}/out/a").count() == 3
    for season, parts in (("season=1", ("players", "matches", "teams")), ("season=2", ("players",))):
        (tmp_path / "cache" / season).mkdir(parents=True)
        for p in parts:
            (tmp_path / "cache" / season / f"{p}.json").write_text(json.dumps({"data": [{"id": 1}, {"id": 2}]}))
    got = io.read_provider_cache(spark, str(tmp_path / "cache"))
    assert {r["season"] for r in got["players"].collect()} == {"season=1"} and got["teams"].count() == 2


def test_arrivals_are_checked_against_the_last_reading(spark, tmp_path):
    spark.createDataFrame([(1, D(2024, 1, 1), 150.0), (2, D(2024, 1, 1), 150.0)], "player_id long, measured_at date, value double").write.parquet(f"{tmp_path}/last")
    new = spark.createDataFrame([(1, D(2024, 2, 1), 140.0), (2, D(2024, 2, 1), 156.0), (3, D(2024, 2, 1), 150.0)], "player_id long, measured_at date, value double")
    jobs.check_arrivals(f"{tmp_path}/last", f"{tmp_path}/out")(new, 0)
    assert {r["player_id"]: r["warnings"] for r in spark.read.parquet(f"{tmp_path}/out/batch=0").collect()} == {1: ["drop"], 2: ["fast gain"], 3: []}


def test_twins_ranks_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal((60, 2)), 1)
    df = spark.createDataFrame([(i, i % 2, float(a), float(b), i + 2) for i, (a, b) in enumerate(x)], "id long, g int, a double, b double, twin long")
    got = {r["id"]: (r["rank"], r["others"]) for r in models.twin_ranks(df, ["g"], "id", "twin", ["a", "b"], side=7).collect()}
    for i in range(58):
        d = sorted((((x[i] - x[j]) ** 2).sum(), j) for j in range(60) if j != i and j % 2 == i % 2)
        assert got[i] == (1 + [j for _, j in d].index(i + 2), 29)
    assert 58 not in got
