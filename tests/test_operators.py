"""Operators on small invented rows, with worked examples and known truths."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitchlake.functions import match, numbers, people
from pitchlake.operators import cohorts, flags, linkage, matches, models, percentiles, rules, seasons, temporal
from pitchlake.sources import io
from pitchlake.streaming import jobs

D = dt.date


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


FOOTBALL = {
    "properties": {"goals": {"min": 0}, "shots": {"min": 0}, "shots_on_target": {"min": 0}, "passes_completed": {}, "passes_attempted": {}, "distance_km": {"max": 16}, "minutes_played": {"min": 0, "max": 120}},
    "required": ["minutes_played"],
    "invariants": [{"lte": ["goals", "shots_on_target"]}, {"lte": ["goals", "shots"]}, {"lte": ["shots_on_target", "shots"]}, {"lte": ["passes_completed", "passes_attempted"]}, {"ifZero": "minutes_played", "thenZero": ["goals", "shots"]}],
}
TABLE = {"properties": {"best_of": {"values": [3, 5, 7]}, "sets_won": {}, "sets_lost": {}, "points_won": {"min": 0}}, "required": [], "invariants": [{"raceTo": ["sets_won", "sets_lost", "best_of"]}, {"atLeast": ["points_won", 11, "sets_won"]}]}


@pytest.mark.parametrize(
    "rule, metrics, bad",
    [
        (FOOTBALL, {"goals": 3, "shots": 1}, True),
        (FOOTBALL, {"shots_on_target": 5, "shots": 2}, True),
        (FOOTBALL, {"passes_completed": 40, "passes_attempted": 12}, True),
        (FOOTBALL, {"distance_km": 18.2}, True),
        (FOOTBALL, {"minutes_played": 0, "goals": 2}, True),
        (FOOTBALL, {"goals": 1, "shots": 4, "shots_on_target": 2}, False),
        (FOOTBALL, {"minutes_played": 0, "goals": 0}, False),
        (FOOTBALL, {}, False),
        (TABLE, {"best_of": 5, "sets_won": 3, "sets_lost": 3}, True),
        (TABLE, {"best_of": 5, "sets_won": 3, "sets_lost": 1, "points_won": 12}, True),
        (TABLE, {"best_of": 5, "sets_won": 3, "sets_lost": 1, "points_won": 44}, False),
        (TABLE, {"sets_won": 3}, False),
    ],
)
def test_impossible_rows(spark, rule, metrics, bad):
    df = spark.createDataFrame([({k: float(v) for k, v in metrics.items()},)], "m map<string,double>")
    assert bool(df.select(rules.impossible(rule, "m")).first()[0]) is bad


def test_validation_names_every_reason(spark):
    df = spark.createDataFrame([({"goals": -1.0, "foo": 1.0},), ({"minutes_played": 10.0, "goals": 3.0, "shots": 1.0},)], "m map<string,double>")
    got = [r[0] for r in df.select(rules.validate(FOOTBALL, "m")).collect()]
    assert got == [["minutes_played missing", "goals under 0", "foo unknown"], ["lte:goals,shots"]]


def test_two_sided_matches(spark):
    day = D(2024, 1, 1)
    rows = [
        (1, day, 1, 2, 3, 1, True), (2, day, 2, 1, 1, 3, False),  # mirrors
        (3, day, 3, 4, 3, 0, True), (4, day, 4, 3, 3, 0, False),  # against a verified row
        (5, day, 5, 6, 3, 0, False), (6, day, 6, 5, 3, 1, False),  # neither verified
        (7, day, 7, 8, 3, 0, True), (8, day, 8, 7, 3, 0, True),  # both verified
        (9, day, 9, 10, 3, 2, False),  # one side only
        (10, day, 11, 12, None, 2, False), (11, day, 12, 11, 3, 0, False),  # unknown
        (12, day, 1, 2, 3, 1, False),  # an extra agreeing row
    ]
    df = spark.createDataFrame(rows, "row_id long, played date, player_id long, opponent_id long, won int, lost int, verified boolean")
    pairs = matches.contradictions(df)
    assert values(pairs, "a", "b") == [(3, 4), (5, 6), (7, 8)]
    assert values(matches.blamed(pairs), "row_id", "reason") == [(4, "against a verified row"), (5, "neither is verified"), (6, "neither is verified")]
    merged = spark.createDataFrame([(5,)], "player_id long")
    assert values(matches.contradictions(df, merged), "a", "b") == [(3, 4), (7, 8)]


def test_glicko_step_is_the_published_example():
    s = 173.7178
    mu, phi = 0.0, 200 / s
    games = [((1400 - 1500) / s, 30 / s, 1), ((1550 - 1500) / s, 100 / s, 0), ((1700 - 1500) / s, 300 / s, 0)]
    g_sum = d_sum = 0.0
    for m, p, score in games:
        g = 1 / math.sqrt(1 + 3 * p * p / math.pi**2)
        e = 1 / (1 + math.exp(-g * (mu - m)))
        g_sum += g * g * e * (1 - e)
        d_sum += g * (score - e)
    out = matches.glicko_month(pd.DataFrame({"player_id": [1], "mu": [mu], "phi": [phi], "sigma": [0.06], "g_sum": [g_sum], "d_sum": [d_sum]}), 0.5)
    assert out["mu"][0] * s + 1500 == pytest.approx(1464.06, abs=0.01)
    assert out["phi"][0] * s == pytest.approx(151.52, abs=0.01)
    assert out["sigma"][0] == pytest.approx(0.05999, abs=1e-5)


def test_monthly_ratings_start_at_the_beginning(spark):
    df = spark.createDataFrame([(D(2024, 1, 5), 1, 2), (D(2024, 2, 5), 1, 2), (D(2024, 3, 5), 1, 3)], "played date, winner long, loser long")
    got = {(r["player_id"], r["month"]): r for r in matches.glicko(df).collect()}
    assert got[(1, D(2024, 1, 1))]["rating"] == 1500
    assert got[(1, D(2024, 3, 1))]["rating"] > got[(1, D(2024, 2, 1))]["rating"] > 1500
    assert got[(3, D(2024, 3, 1))]["deviation"] > 350


def test_the_rating_query_takes_the_whole_history(spark, tmp_path):
    from pitchlake.plans import results

    orders = [(i, (D(1995, 1, 3), D(1998, 6, 3), D(2001, 1, 3))[i % 3]) for i in range(30)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, s, 10.0 * s) for i, _ in orders for s in (1, 2, 3)], "l_orderkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = results.m2_glicko_ratings(spark, str(tmp_path)).collect()
    assert {r["month"] for r in got} == {D(1995, 1, 1), D(1998, 6, 1), D(2001, 1, 1)}
    assert all(r["rating"] != 1500 for r in got if r["month"] == D(2001, 1, 1) and r["player_id"] != 2)


def test_point_ratings_recover_the_edge(spark):
    df = spark.createDataFrame([(1, 2, 60, 40)] * 30, "winner long, loser long, high int, low int")
    t = {r["player_id"]: r["theta"] for r in matches.bradley_terry(df, prior=10.0).collect()}
    assert t[1] - t[2] == pytest.approx(math.log(1.5), abs=0.01)
    one = {r["player_id"]: r["theta"] for r in matches.bradley_terry(spark.createDataFrame([(1, 2, 33, 10)], df.schema)).collect()}
    assert 1 / (1 + math.exp(one[2] - one[1])) < 0.6


def test_chances_are_fair_and_symmetric(spark):
    df = spark.createDataFrame([(0.5,), (0.3,), (0.7,)], "p double")
    a, b, c = (r[0] for r in df.select(match.set_chance(F.col("p"))).collect())
    assert a == pytest.approx(0.5) and b + c == pytest.approx(1)
    a, b, c = (r[0] for r in df.select(match.match_chance(F.col("p"))).collect())
    assert a == pytest.approx(0.5) and b + c == pytest.approx(1)


def test_cohort_reference_pools_only_ages_that_occur(spark):
    rows = [("M", 10.0, 100.0 + i) for i in range(4)] + [("M", 11.4, 110.0), ("M", 13.0, 200.0)]
    df = spark.createDataFrame(rows, "sex string, age double, v double")
    got = {(r["sex"], r["age"]): r for r in cohorts.cohort_reference(df, ["sex"], "age", "v", 0.5).collect()}
    assert set(got) == {("M", 10), ("M", 11)}
    pool = [100, 101, 102, 103, 110]
    assert got[("M", 10)]["median"] == 102 and got[("M", 10)]["sd"] == pytest.approx(np.std(pool))


def test_velocities(spark):
    rows = [(1, D(2020, 1, 1) + dt.timedelta(days=60 * k), 100 + k) for k in range(12)] + [(2, D(2020, 1, 1), 100.0)]
    df = spark.createDataFrame([(p, d, float(v)) for p, d, v in rows], "p long, d date, v double")
    g = {r["p"]: r for r in cohorts.growth(df, "p", "d", "v", F.lit("2022-01-01").cast("date")).collect()}
    assert g[1]["velocity"] == pytest.approx(365.25 / 60) and g[2]["velocity"] == 0
    s = cohorts.spaced_velocities(df, "p", "d", "v").collect()
    assert [(x["end"] - x["start"]).days for x in sorted(s, key=lambda x: x["start"])] == [180, 180, 180]
    assert cohorts.own_velocity(df, "p", "d", "v").first()["own_velocity"] == pytest.approx(365.25 / 60)


def test_percentile_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice("ab"), float(rng.randint(0, 6)) if rng.random() < 0.9 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, g string, v double")
    for include in (True, False):
        for r in percentiles.midrank(df, ["g"], "v", include_self=include).collect():
            peers = [v for k, g, v in rows if g == r["g"] and v is not None and (include or k != r["k"])]
            if r["v"] is None:
                assert r["percentile"] is None
                continue
            p = round(100 * (sum(v < r["v"] for v in peers) + sum(v == r["v"] for v in peers) / 2) / len(peers))
            assert r["percentile"] == max(1, min(99, p))


def test_half_quantiles_leave_the_middle_out(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5)] + [("b", 7.0)], "g string, v double")
    assert values(percentiles.half_quantiles(df, ["g"], "v"), "g", "p25", "p50", "p75") == [("a", 1.5, 3.0, 4.5), ("b", 7.0, 7.0, 7.0)]


def test_intervals_and_spells(spark):
    s = spark.createDataFrame([(1, 1, D(2020, 1, 1), D(2020, 6, 1)), (1, 2, D(2020, 6, 1), None), (1, 3, D(2021, 1, 1), None)], "p long, s long, a date, b date")
    rows = spark.createDataFrame([(1, 1, D(2020, 3, 1)), (2, 1, D(2020, 6, 1)), (3, 1, D(2019, 1, 1)), (4, 1, D(2022, 1, 1))], "r long, p long, d date")
    assert values(temporal.spell_on(rows, s, "p", "d", "a", "b", "s", "r").fillna(-1, ["s"]), "r", "s") == [(1, 1), (2, 2), (3, -1), (4, 3)]
    assert values(temporal.overlapping_spells(s, ["p"], "a", "b", "s"), "s") == [(1,), (2,)]
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 5), (5, 5)], "k long, to long")
    assert values(temporal.follow_pointers(chain, "k", "to"), "k", "survivor") == [(1, 3), (2, 3), (3, 3), (4, 5), (5, 5)]


def test_birth_relations_and_candidates(spark):
    day = D(2010, 3, 7)
    others = {2: D(2010, 3, 7), 3: D(2010, 7, 3), 4: D(2010, 3, 10), 5: D(2010, 11, 20), 6: None, 7: D(2010, 3, 1)}
    df = spark.createDataFrame([(1, day, "M")] + [(k, d, "M") for k, d in others.items()] + [(8, day, "F")], "id long, born date, sex string")
    got = {(r["a"], r["b"]): r["relation"] for r in linkage.birth_candidates(df, "id", "born", ["sex"]).collect() if r["a"] == 1}
    assert got == {(1, 2): "exact", (1, 3): "transposed", (1, 4): "near", (1, 7): "near"}


def test_groups_refuse_conflicts(spark):
    df = spark.createDataFrame([(1, 2, 0.99, False), (2, 3, 0.95, False), (1, 3, 0.6, True), (7, 8, 0.4, False)], "a long, b long, probability double, conflict boolean")
    assert values(linkage.greedy_groups(df, "conflict"), "id", "group") == [(1, 1), (2, 1), (3, 3)]


def test_cluster_scores(spark):
    found = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2)], "id long, c long")
    true = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 2)], "id long, c long")
    p = linkage.pairwise_scores(found, true, "id", "c").first()
    assert (p["precision"], p["recall"]) == (0.5, pytest.approx(1 / 3))
    b = linkage.bcubed(found, true, "id", "c").first()
    assert b["precision"] == pytest.approx(0.75) and b["recall"] == pytest.approx((2 / 3 + 2 / 3 + 1 / 3 + 1) / 4)


def test_names_and_ages(spark):
    df = spark.createDataFrame([("  Ahmed   HASSAN ", "u17"), ("أَحْمَد", "14 to 16"), ("ﬁn", "over 15"), (None, "tall")], "n string, q string")
    assert [r[0] for r in df.select(people.normal_name(F.col("n"))).collect()] == ["ahmed hassan", "احمد", "fin", None]
    assert [tuple(r[0]) for r in df.select(people.age_range(F.col("q"))).collect()] == [(None, 16), (14, 16), (16, None), (None, None)]


def test_clocks_and_seasons(spark):
    df = spark.createDataFrame([("47:12", "45+2", "La Liga 2015/16"), ("x", "90+3", "2018")], "c string, s string, t string")
    got = df.select(match.clock_seconds(F.col("c")), match.in_first_half(F.col("s")), match.season_of_text(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(2832.0, True, "2015/2016"), (None, False, "2018")]


def test_quantiles_without_tables():
    assert numbers.poisson_quantile(0.9, np.array([0.0, 1.0, 10.0])).tolist() == [0, 2, 14]
    assert numbers.gamma_quantile(0.5, np.array([1.0]), np.array([2.0]))[0] == pytest.approx(math.log(2) / 2, abs=1e-6)
    assert numbers.gamma_cdf(numbers.gamma_quantile(0.1, np.array([499.0, 700.0]), np.array([1.0, 1.0])), np.array([499.0, 700.0])) == pytest.approx([0.1, 0.1], abs=1e-3)
    assert numbers.negative_binomial_quantile(0.5, 1.0, 0.5) == 0
    assert numbers.chi_square_tail_3(7.815) == pytest.approx(0.05, abs=1e-3)


def test_shrinkage_recovers_a_prior():
    rng = np.random.default_rng(3)
    exposure = rng.uniform(5, 30, 4000)
    counts = rng.poisson(rng.gamma(4.0, 1 / 8.0, 4000) * exposure)
    a, b = models.fit_gamma_poisson(counts.astype(float), exposure)
    assert a == pytest.approx(4, rel=0.15) and a / b == pytest.approx(0.5, rel=0.05)


def test_nearest_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((70, 3))
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", *map(float, r)) for i, r in enumerate(x)], "k long, g string, u double, v double, w double")
    got = {(r["k"], r["place"]): r["other"] for r in models.nearest(df, ["g"], "k", ["u", "v", "w"], 4, side=9).collect()}
    for i in range(70):
        peers = [j for j in range(70) if j != i and bool(j % 3) == bool(i % 3)]
        want = sorted(peers, key=lambda j: np.linalg.norm(x[i] - x[j]))[:4]
        assert [got[(i, p)] for p in range(1, 5)] == want


def test_forecasts_never_look_ahead(spark):
    rows = [(p, D(2018, 1, 1) + dt.timedelta(days=60 * k + p), 100.0 + k) for p in range(6) for k in range(18)]
    df = spark.createDataFrame(rows, "p long, d date, v double")
    origins = spark.createDataFrame([(D(2019, 6, 1),)], "origin date")
    changed = df.withColumn("v", F.when(F.col("d") > "2019-06-01", F.col("v") + 50).otherwise(F.col("v")))
    a, b = (values(models.walk_forward(x, origins, "p", "d", "v"), "p", "last_date", "last") for x in (df, changed))
    assert a == b and a


def test_timing_finds_a_late_player(spark):
    curve_rows = [("M", i * 0.5, 100 + 6.0 * i * 0.5 + (8 if i > 26 else 0)) for i in range(16, 40) for _ in range(6)]
    points = models.curve(spark.createDataFrame(curve_rows, "sex string, age double, v double"), ["sex"], "age", "v", 1.0)
    late = spark.createDataFrame([(1, "M", a / 10, 100 + 6.0 * (a / 10 - 1) + (8 if a / 10 - 1 > 13 else 0)) for a in range(100, 180, 5)], "p long, sex string, age double, v double")
    assert models.timing_shift(late, points, "sex", "p", "age", "v", penalty=0.5).first()["shift"] < -0.3


def test_flags_upsert_and_close(spark):
    held = spark.createDataFrame([("a", "open", 0.5), ("b", "dismissed", 0.4)], "dedupe_key string, status string, confidence double")
    raised = spark.createDataFrame([("a", 0.9), ("b", 0.9), ("c", 0.7)], "dedupe_key string, confidence double")
    assert values(flags.upsert(held, raised), "dedupe_key", "status", "confidence", "change") == [("a", "open", 0.9, "refreshed"), ("b", "dismissed", 0.4, "kept"), ("c", "open", 0.7, "created")]


def test_team_profile_ranks(spark):
    rows = [("c%d" % k, "L", "xg", float(k)) for k in range(9)] + [("c%d" % k, "L", "against", float(k)) for k in range(9)]
    df = spark.createDataFrame(rows, "club string, league string, metric string, value double")
    got = {(r["club"], r["metric"]): (r["rank"], r["bottom"], r["weak"]) for r in seasons.team_profile(df, ["league"], "metric", "value", ["against"], ["xg"]).collect()}
    assert got[("c0", "xg")] == (9, True, True) and got[("c0", "against")][0] == 1
    assert got[("c8", "against")] == (9, True, False)


def test_people_spreadsheet(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text("﻿Full Name;Date-of-Birth\nAmal;2010-01-02\n;\nOmar;2011-02-03\n", encoding="utf-8")
    df = io.read_people(spark, str(path), ["full_name", "date_of_birth"], ["full_name"])
    assert values(df, "full_name", "date_of_birth") == [("Amal", "2010-01-02"), ("Omar", "2011-02-03")]
    with pytest.raises(ValueError):
        io.read_people(spark, str(path), ["full_name"], [])
    with pytest.raises(ValueError):
        io.read_people(spark, str(path), ["full_name", "date_of_birth", "club"], ["club"])


def test_sources_are_replaced_alone(spark, tmp_path):
    folder = str(tmp_path / "t")
    io.replace_source(spark.createDataFrame([(1, "x"), (2, "y")], "v int, source string"), folder)
    io.replace_source(spark.createDataFrame([(9, "x")], "v int, source string"), folder)
    assert values(spark.read.parquet(folder), "v", "source") == [(2, "y"), (9, "x")]


def test_export_and_external_ids(spark, tmp_path):
    import json

    for name in io.SCHEMAS:
        (tmp_path / f"{name}.json").write_text(json.dumps([{"id": "p1", "player_id": "p1", "value": 1.5, "external_ids": {"prov": "7"}}]))
    t = io.read_export(spark, str(tmp_path))
    assert t["measurements"].first()["player_id"] == "p1"
    new = io.resolve_external(spark.createDataFrame([("7",), ("8",)], "k string"), t["players"], "k", "prov")
    got = {r["k"]: r["id"] for r in new.collect()}
    assert got["7"] == "p1" and len(got["8"]) == 32


def test_provider_rows(spark):
    df = spark.createDataFrame([("Forward", 90, 2), ("Coach", 90, 1), ("Forward", 0, 1), ("Forward", 90, -1)], "position string, minutes int, goals int")
    got = [r["reason"] for r in io.provider_season(df, ["goals"], "minutes", "position").collect()]
    assert got == [None, "coach", "no minutes", "goals missing"]
    assert values(io.load_report(io.provider_season(df, ["goals"], "minutes", "position"), "reason"), "reason", "rows") == [("coach", 1), ("goals missing", 1), ("loaded", 1), ("no minutes", 1)]


def test_live_tallies_drop_late_events(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda s: dt.datetime.fromisoformat(s)
    schema = "ts timestamp, player_id long, outcome string"
    for batch in ([("2024-01-01T10:00:00", 1), ("2024-01-01T11:00:00", 1)], [("2024-01-05T10:00:00", 1)], [("2024-01-01T12:00:00", 1), ("2024-01-09T10:00:00", 1)]):
        spark.createDataFrame([(at(t), p, "won") for t, p in batch], schema).coalesce(1).write.mode("append").parquet(src)
        q = jobs.live_tallies(spark.readStream.schema(schema).parquet(src), "ts").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert (D(2024, 1, 1), 2) in values(spark.read.parquet(out), "match_day", "n")


def test_flag_batches_are_repeatable(spark, tmp_path):
    sink = jobs.flag_sink(str(tmp_path / "f"))
    b = lambda rows: spark.createDataFrame(rows, "dedupe_key string, confidence double, raised_at int")
    sink(b([("a", 0.5, 1), ("a", 0.6, 2)]), 0)
    for _ in range(2):
        sink(b([("a", 0.9, 3), ("b", 0.1, 3)]), 1)
    assert values(spark.read.parquet(str(tmp_path / "f/generation=1")), "dedupe_key", "status", "confidence") == [("a", "open", 0.9), ("b", "open", 0.1)]


def test_entry_imports_without_the_training_data_operators(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parent.parent
    shutil.copytree(root / "pitchlake", tmp_path / "pitchlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=60)


def test_a_match_feed(spark):
    """One small match: goals 2-1 with a penalty, an own goal and a shootout that counts for nothing."""
    from pitchlake.operators import feed

    ev = [
        (1, "p1", "Pass", 1, 10, 1, 11, None, "Throw-in", None, None, False),
        (1, "p2", "Pass", 1, 20, 1, 12, None, None, None, None, True),
        (1, "s1", "Shot", 1, 20, 1, 11, "Goal", None, 0.4, "p2", False),
        (1, "p3", "Pass", 1, 30, 1, 12, "Incomplete", None, None, None, False),
        (1, "s2", "Shot", 2, 80, 1, 13, "Goal", "Penalty", 0.76, None, False),
        (1, "o1", "Own Goal For", 2, 60, 2, 21, None, None, None, None, False),
        (1, "d1", "Duel", 2, 60, 2, 21, "Won", None, None, None, False),
        (1, "d2", "Dribble", 2, 61, 2, 21, "Complete", None, None, None, False),
    ]
    names = "match_id int, event_id string, type string, period int, minute int, team_id int, player_id int, outcome string, kind string, xg double, key_pass_id string, goal_assist boolean"
    e = spark.createDataFrame(ev, names).withColumn("possession_team_id", F.col("team_id")).withColumn("duration", F.lit(2.0))
    p = {r["player_id"]: r for r in feed.player_lines(e).collect()}
    assert (p[11]["shots"], p[11]["goals"], p[11]["xg"], p[11]["passes"]) == (1, 1, 0.4, 0)
    assert (p[12]["passes"], p[12]["passes_completed"], p[12]["xa"], p[12]["assists"]) == (2, 1, 0.4, 1)
    assert (p[13]["xg"], p[13]["npxg"]) == (0.76, 0.0) and (p[21]["duels_won"], p[21]["take_ons_won"]) == (1, 1)
    t = {r["team_id"]: r for r in feed.team_lines(e).collect()}
    assert (t[1]["goals"], t[1]["goals_against"], t[1]["points"], t[1]["goals_late"]) == (2, 1, 3, 1)
    assert (t[2]["goals"], t[2]["points"], t[2]["possession_s"]) == (1, 0, 6.0)
    lines = spark.createDataFrame([(1, 1, [(11, [("Striker", "00:00", None, 1, "Starting XI")]), (12, [("Keeper", "00:00", "60:00", 1, "Starting XI"), ("Keeper", "00:00", None, 5, "x")]), (13, [("Wing", "60:00", None, 2, "Sub")])])], "match_id int, team_id int, lineup array<struct<player_id:int,positions:array<struct<position:string,`from`:string,`to`:string,from_period:int,start_reason:string>>>>")
    m = {r["player_id"]: (r["position"], r["minutes"], r["started"]) for r in feed.minutes_played(lines, spark.createDataFrame([(1, 5400.0)], "match_id int, end_s double")).collect()}
    assert m == {11: ("Striker", 90, True), 12: ("Keeper", 60, True), 13: ("Wing", 30, False)}


def test_full_match_lines(spark):
    """Nested events: cards, aerials, an own goal, a set piece, a player without time on the pitch."""
    from pitchlake.operators import feed

    def event(i, kind, team, player, minute=10, period=1, **more):
        return {"match_id": 1, "id": i, "type": {"name": kind}, "period": period, "minute": minute, "team": {"id": team}, "player": {"id": player}, "possession_team": {"id": team}, "duration": 3.0, **more}

    ev = [
        event("p", "Pass", 1, 11, **{"pass": {"aerial_won": True, "goal_assist": True}}),
        event("s", "Shot", 1, 12, minute=30, shot={"outcome": {"name": "Goal"}, "type": {"name": "Open Play"}, "xg": 0.3, "key_pass_id": "p"}, play_pattern={"name": "From Corner"}),
        event("v", "Shot", 2, 21, minute=80, period=2, shot={"outcome": {"name": "Saved"}, "type": {"name": "Open Play"}, "xg": 0.1}),
        event("o", "Own Goal Against", 2, 22, minute=77, period=2),
        event("f", "Foul Committed", 2, 21, minute=81, period=2, foul_committed={"card": {"name": "Second Yellow"}}),
        event("a", "Duel", 2, 21, duel={"type": {"name": "Aerial Lost"}}),
        event("t", "Duel", 1, 12, duel={"type": {"name": "Tackle"}, "outcome": {"name": "Success Out"}}),
        event("x", "Shot", 1, 12, minute=120, period=5, shot={"outcome": {"name": "Goal"}, "type": {"name": "Penalty"}, "xg": 0.7}),
    ]
    import json

    sc = spark.createDataFrame([(json.dumps(e),) for e in ev], "j string")
    schema = "match_id int, id string, type struct<name:string>, period int, minute int, team struct<id:int>, player struct<id:int>, possession_team struct<id:int>, duration double, pass struct<aerial_won:boolean,goal_assist:boolean>, shot struct<outcome:struct<name:string>,type:struct<name:string>,xg:double,key_pass_id:string>, duel struct<type:struct<name:string>,outcome:struct<name:string>>, foul_committed struct<card:struct<name:string>>, play_pattern struct<name:string>"
    flat = feed.flatten(sc.select(F.from_json("j", schema).alias("e")).select("e.*"))
    assert flat.count() == 7
    minutes = spark.createDataFrame([(1, 1, 11, 90, True), (1, 1, 12, 60, True), (1, 2, 21, 81, False)], "match_id int, team_id int, player_id int, minutes int, started boolean")
    p = {r["player_id"]: r for r in feed.match_lines(flat, minutes).collect()}
    assert set(p) == {11, 12, 21}
    assert (p[11]["aerials_won"], p[11]["duels"], p[11]["duels_won"], p[11]["key_passes"], p[11]["xa"], p[11]["starts"]) == (1, 1, 1, 1, 0.3, 1)
    assert (p[12]["shots"], p[12]["goals"], p[12]["tackles_won"], p[12]["duels_won"], p[12]["minutes_played"]) == (1, 1, 1, 1, 60)
    assert (p[21]["shots_on_target"], p[21]["red_cards"], p[21]["yellow_cards"], p[21]["aerials"], p[21]["duels_won"], p[21]["starts"]) == (1, 1, 0, 1, 0, 0)
    homes = spark.createDataFrame([(1, 1, 2, 2, 0), (2, 1, 3, 1, 1)], "match_id int, home int, away int, home_score int, away_score int")
    r = {(x["match_id"], x["team_id"]): x for x in feed.match_results(flat, homes).collect()}
    one, two = r[1, 1], r[1, 2]
    assert (one["goals_for"], one["goals_for_first_half"], one["set_piece_goals_for"], one["home_points"], one["clean_sheets"], one["shots_against"]) == (2, 1, 1, 3, 1, 1)
    assert (two["goals_against_last_15"], two["set_piece_goals_against"], two["losses"], two["away_points"], two["xg_against"]) == (1, 1, 1, 0, 0.3)
    assert (r[2, 3]["points"], r[2, 3]["draws"], r[2, 3]["shots_for"]) == (1, 1, 0)
    t = {x["team_id"]: x for x in feed.team_totals(feed.match_results(flat, homes)).collect()}
    assert (t[1]["matches"], t[1]["points"], t[1]["possession_pct"], t[3]["possession_pct"]) == (2, 4, 42.9, 0.0)
    assert feed.match_lines(flat, minutes.limit(0)).count() == 0 and feed.match_results(flat, homes.limit(0)).count() == 0


def test_team_season_details(spark):
    from pitchlake.operators import seasons

    row = lambda h, a, hg, ag, hx, hs, as_: (2020, h, a, hg, ag, hx, 0.5, 9, 4, 60.0, 40.0, hs, as_)
    names = "y int, home string, away string, home_goals int, away_goals int, home_xg double, away_xg double, home_shots int, away_shots int, home_possession double, away_possession double, home_stamps array<string>, away_stamps array<string>"
    m = spark.createDataFrame([row("A", "B", 2, 1, 1.25, ["45+2", "90+1"], ["76"]), row("C", "D", 0, 0, None, [], []), row("B", "A", 0, 1, 0.5, None, ["46"])], names)
    got = {r["team"]: r for r in seasons.team_season_details(m, F.col("y")).collect()}
    assert set(got) == {"A", "B"}  # a number is missing in the match of C and D
    a, b = got["A"], got["B"]
    assert (a["matches"], a["points"], a["home_points"], a["away_points"], a["clean_sheets"], a["goals_for_first_half"], a["goals_against_last_15"]) == (2, 6, 3, 3, 1, 1, 1)
    assert (b["xg_for"], b["possession_pct"], b["losses"], b["goals_against_first_half"], b["goals_against_last_15"]) == (1.0, 50.0, 2, 1, 1)
