"""Pages of trees and caches, keyed state of arriving readings, candidates of clubs, staff pages."""

import math
import random
from datetime import date as D
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitchlake.operators import matches, people, seasons
from pitchlake.sources import io
from pitchlake.streaming import jobs


class State(SimpleNamespace):
    """The state of one player, as a streaming query hands it over."""

    @property
    def exists(self):
        return hasattr(self, "get")

    def update(self, value):
        self.get = value


def arrive(state, rows):
    frame = pd.DataFrame(rows, columns=["reading_id", "player_id", "measured_at", "value"])
    (out,) = jobs.check_player((1,), iter([frame]), state, 110, 210, 1.5, 2.5)
    return dict(zip(out["reading_id"], out["warnings"])), out


def test_arrivals_late_repeated_and_absent_leave_the_state():
    state = State()
    got, _ = arrive(state, [(2, 1, D(2024, 2, 1), 140.0), (1, 1, D(2024, 1, 1), 150.0)])
    assert got == {1: [], 2: ["drop"]} and state.get[1:] == (2, 140.0)
    got, out = arrive(state, [(2, 1, D(2024, 2, 1), 140.0), (1, 1, D(2024, 1, 1), 150.0), (3, 1, None, 160.0), (4, 1, D(2024, 3, 1), None)])
    assert got == {2: ["repeated"], 1: ["late"], 3: ["absent"], 4: ["absent"]} and state.get[1:] == (2, 140.0) and len(out) == 4
    got, out = arrive(state, [(5, 1, D(2024, 3, 1), 146.0), (5, 1, D(2024, 3, 1), 146.0), (6, 1, D(2024, 3, 2), 300.0)])
    assert sorted(map(tuple, out["warnings"])) == [("fast gain",), ("repeated",), ("unusual", "fast gain")] and state.get[1:] == (6, 300.0)


def test_any_split_into_batches_gives_the_warnings_of_one():
    rng = random.Random(3)
    rows = [(i, 1, D(2020, 1 + i % 12, 1 + i // 12), round(rng.uniform(100, 220), 1)) for i in range(60)]
    rows.sort(key=lambda r: (r[2], r[0]))
    whole, _ = arrive(State(), rows)
    state, parts, at = State(), {}, 0
    while at < len(rows):
        step = rng.randint(1, 9)
        piece = rows[at : at + step]
        rng.shuffle(piece)
        parts.update(arrive(state, piece)[0])
        at += step
    assert parts == whole


def test_a_tree_of_pages_is_read_with_the_ids_of_its_folders(spark, tmp_path):
    e = spark.range(57).select((F.col("id") % 3).alias("match_id"), F.col("id").cast("string").alias("id"), F.lit(1).alias("period"), F.struct(F.lit("Pass").alias("name")).alias("type"))
    io.write_pages(e, f"{tmp_path}/events", "match_id", "id", page=5)
    io.write_pages(e.select("match_id", F.lit(1).alias("team_id"), "id"), f"{tmp_path}/lineups", "match_id", "id")
    io.write_pages(e.select("match_id", F.col("match_id").alias("game")).distinct(), f"{tmp_path}/matches", "match_id", "game")
    assert len(list((tmp_path / "events" / "match_id=0").glob("part-*.txt"))) > 2
    (tmp_path / "events" / "7.json").write_text('[{"id": "900", "period": 2}]')
    got = io.read_event_tree(spark, str(tmp_path))
    rows = {(r["id"], r["match_id"]) for r in got["events"].collect()}
    assert rows == {(str(i), i % 3) for i in range(57)} | {("900", 7)} and got["matches"].count() == 3


def test_paged_caches_and_empty_pages(spark, tmp_path):
    rows = spark.range(20).select((F.col("id") % 2).alias("season"), F.col("id").alias("n"))
    for part in ("players", "matches"):
        io.write_pages(rows, f"{tmp_path}/{part}", "season", "n", "data", page=3)
    io.write_pages(rows.where("season = 1"), f"{tmp_path}/teams", "season", "n", "data")
    got = io.read_provider_cache(spark, str(tmp_path), paged=True)["players"]
    assert sorted((r["season"], r["n"]) for r in got.collect()) == [("season=1", n) for n in range(1, 20, 2)]
    io.write_pages(rows.where("n < 0"), f"{tmp_path}/none", "season", "n")
    assert spark.read.text(f"{tmp_path}/none").count() == 0


def test_club_candidates_against_plain_lists(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(2), i % 2, rng.choice("ABCD"), rng.randrange(1, 9), None if i % 13 == 0 else float(rng.randrange(9)), float(rng.randrange(4))) for i in range(90)]
    p = spark.createDataFrame(rows, "player long, league long, grp long, club string, minutes long, x double, y double")
    needs = [(l, g, c) for l in (0, 1) for g in (0, 1) for c in "ABCD"]
    n = spark.createDataFrame(needs + needs[:3], "league long, grp long, club string")
    got = {(r["league"], r["grp"], r["for_club"], r["place"]): (r["player"], r["mean"]) for r in seasons.club_candidates(p, n, ["league"], "grp", "club", "player", ["x", "y"], "minutes", 4).collect()}

    def percentile(values, i):
        others = values[:i] + values[i + 1 :]
        return max(1, min(99, round(100 * (sum(o < values[i] for o in others) + sum(o == values[i] for o in others) / 2) / len(others))))

    want = {}
    for l, g, c in needs:
        pool = [r for r in rows if r[1] == l and r[2] == g]
        xs, ys = [r for r in pool if r[5] is not None], pool
        means = [(-round((percentile([q[5] for q in xs], xs.index(r)) + percentile([q[6] for q in ys], ys.index(r))) / 2, 1), -r[4], r[0]) for r in xs if r[3] != c]
        for k, (m, _, player) in enumerate(sorted(means)[:4]):
            want[l, g, c, k + 1] = (player, -m)
    assert got == want


def test_scopes_fail_closed_and_saved_players_are_withheld(spark):
    p = spark.createDataFrame([(i,) for i in range(6)], "id long")
    merged, own = F.col("id") == 5, p.where("id in (2, 5)")
    ids = lambda df: {r["id"] for r in df.collect()}
    assert ids(people.visible(p, "all", None, "id", merged)) == {0, 1, 2, 3, 4}
    assert ids(people.visible(p, "own", own, "id", merged)) == {2}
    assert ids(people.visible(p, "own", None, "id", merged)) == ids(people.visible(p, "guest", own, "id", merged)) == set()
    saved = spark.createDataFrame([("a", 1), ("a", 1), ("a", 9), ("b", 9), ("b", None)], "scout string, id long")
    got = {r["scout"]: (r["shown"], r["withheld"]) for r in people.shortlist(saved, p, "scout", "id").collect()}
    assert got == {"a": (1, 1), "b": (0, 2)}


def test_totals_by_tier_and_organisation(spark):
    c = spark.createDataFrame([("abroad", 17, 5, True), ("abroad", 17, 50, False), ("abroad", 25, 50, True), ("pro", 30, 9, True)], "tier string, age int, since int, stale boolean")
    got = {r["tier"]: tuple(r)[1:] for r in people.tier_totals(c, "tier", "age", F.col("since"), F.col("stale"), F.col("age") < 18).collect()}
    assert got == {"abroad": (3, 2, 1, 50.0), "pro": (1, 0, 1, 0.0)}
    current = spark.createDataFrame([(7, 1), (7, 2), (7, 2), (8, 3)], "org long, id long")
    complete, flags = spark.createDataFrame([(1,), (1,), (9,)], "id long"), spark.createDataFrame([(2,), (2,), (9,)], "id long")
    got = {r["org"]: tuple(r)[1:] for r in people.organization_state(current, complete, flags, "org", "id").collect()}
    assert got == {7: (2, 50.0, 2), 8: (1, 0.0, 0)}


def test_strengths_settle_or_raise(spark):
    rows = [(a, b, 40 + (a * 7 + b) % 25, 45) for a in range(12) for b in range(a)] + [(20, 21, 11, 3)]
    m = spark.createDataFrame(rows, "winner long, loser long, high long, low long")
    got = {r["player_id"]: r["theta"] for r in matches.bradley_terry(m).collect()}
    x = dict.fromkeys(got, 0.0)
    for _ in range(4000):
        slope = {p: -x[p] / 0.15**2 for p in x}
        for a, b, f, g in rows:
            d = f - (f + g) / (1 + math.exp(x[b] - x[a]))
            slope[a], slope[b] = slope[a] + d, slope[b] - d
        x = {p: x[p] + 0.001 * slope[p] for p in x}
    assert all(abs(got[p] - x[p]) < 1e-5 for p in x)
    with pytest.raises(RuntimeError):
        matches.bradley_terry(m, rounds=2)
